"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann, collocations, decontam, dedup, licenses, lm, merkle, mixing, pii, simhash, tokens, toxicity, warc
from corpusloom.llm.common import table


def op1_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build_index(vectors), vectors.where("vec_id % 20 = 0"), k=20)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree; one row per document."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(licenses.document_path(F.col("source"), F.col("lang"), F.col("doc_id")).alias("path"), "text")
    found = licenses.scan(files)
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "license", "origin", "cosine", "licensed_from")


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and of documents that lost their line feeds."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: DuckDB: the exact answer, which search with factor one gives.
OP1 = """
with v as (
  select vec_id, embedding::double[] as e, len(embedding) as dim from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
q as (select vec_id, min(e) as e, any_value(dim) as dim from v where vec_id % 20 = 0 group by vec_id),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e) as score from q join v on q.vec_id <> v.vec_id and q.dim = v.dim),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

#: DuckDB: the target shares, then the same highest quotients and the same seeded runs of blocks.
OP6 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, 'mix:' || coalesce(doc_id::varchar, '') as ident from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source),
s1 as (select *, [3, 1, 2][(i % 3 + 1)::int] as weight, 2.0::double * source_size as cap from s0),
s2 as (select *, cap / weight as fill from s1),
s3 as (select *, 1.5::double * sum(source_size) over () - coalesce(sum(cap) over f, 0) as l, (sum(weight) over () - coalesce(sum(weight) over f, 0))::bigint as o
  from s2 window f as (order by fill, i rows between unbounded preceding and 1 preceding)),
s4 as (select *, min(case when fill > l / o then [fill, i, l, o] end) over () as f from s3),
src as (select source, source_size, (case when f is null or fill < f[1] or (fill = f[1] and i < f[2]) then cap else weight * f[3] / f[4] end)::double as target from s4),
v1 as (select 'x' as g, source, null::bigint as shard, target as votes, floor(sum(target) over () / 16 + 0.5)::bigint as seats from src),
a1 as (select *, votes / sum(votes) over () as p, count(*) over () as n, sum(votes) over () as al from v1),
b1 as (select *, case when al > 0 then greatest(0, floor(seats * p + 0.5) - 1 - ceil(n * p))::bigint else 0 end as low from a1),
c1 as (select *, case when al > 0 then seats - sum(low) over () else 0 end as rest from b1),
e1 as (select *, votes / (2 * (low + k) + 1) as q from (select *, unnest(range(0, case when votes > 0 then ceil((rest + n) * p)::bigint + 2 else 1 end)) as k from c1)),
w1 as (select source, any_value(low) + sum(case when rk <= rest and votes > 0 then 1 else 0 end) as blocks from (select *, row_number() over (order by q desc, source nulls last) as rk from e1) group by source),
won as (select src.*, w1.blocks::bigint as blocks, greatest(1, ceil(source_size / 1048576))::bigint as shards from src join w1 on src.source is not distinct from w1.source),
dealt as (select d.*, won.source_size, won.target, won.blocks, case when size > 0 then ('0x' || substr(md5(ident), 1, 15))::bigint % won.shards end as shard from d join won on d.source is not distinct from won.source),
v2 as (select source, shard, sum(size)::bigint as votes, any_value(blocks) as seats from dealt where size > 0 group by source, shard),
a2 as (select *, votes / sum(votes) over (partition by source) as p, count(*) over (partition by source) as n from v2),
b2 as (select *, greatest(0, floor(seats * p + 0.5) - 1 - ceil(n * p))::bigint as low from a2),
c2 as (select *, seats - sum(low) over (partition by source) as rest from b2),
e2 as (select *, votes / (2 * (low + k) + 1) as q from (select *, unnest(range(0, ceil((rest + n) * p)::bigint + 2)) as k from c2)),
w2 as (select source, shard, any_value(votes) as held, (any_value(low) + sum(case when rk <= rest then 1 else 0 end))::bigint as quota
  from (select *, row_number() over (partition by source order by q desc, shard) as rk from e2) group by source, shard),
qu as (select *, least(quota * 16, 2 * held) as words, ('0x' || substr(md5('mix:' || coalesce('s' || source, '') || ':' || shard::varchar), 1, 15))::bigint % ceil(held / 16)::bigint * 16 as lo from w2),
qq as (select *, words // held as rounds, words % held as rest from qu),
laid as (select *, sum(size) over (partition by source, shard order by md5(ident), doc_id nulls last, size rows between unbounded preceding and current row) as hi from dealt where size > 0)
select doc_id, size, source_size, target,
  (rounds * size + greatest(0, least(hi, lo + rest) - greatest(hi - size, lo)) + greatest(0, least(hi, lo + rest - held) - (hi - size)))::bigint as taken
from laid join qq on laid.source is not distinct from qq.source and laid.shard = qq.shard
union all select doc_id, size, source_size, target, 0::bigint from dealt where size = 0
"""

#: DuckDB: digests, owners and types straight from the pages.
OP10 = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as h from p),
o as (select h, max(page_id) as owner, count(*) as n from h group by h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h.h, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest,
  case when n > 1 and owner is not null and (page_id is null or page_id < owner) then 'revisit' else 'response' end as record_type,
  case when n > 1 and owner is not null and (page_id is null or page_id < owner) then owner end as refers_to
from h join o using (h)
"""

def sql_op11() -> str:
    """Trees level by level; siblings by the ancestors' places; tampered leaves folded one level a step."""

    # crc32 of the id's digits, bit by bit
    crc = """list_reduce(list_prepend(4294967295::bigint, list_transform(list_filter(string_split(coalesce(doc_id::varchar, ''), ''), lambda x: x <> ''), lambda x: ascii(x)::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)))"""

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({c})::varchar))::varchar || ':' || ({c})::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str, key: str, base: str) -> str:
        return f"""{name} as (select {key}, 0 as level, idx, h, n from {base} union all
          select {key}, level + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (max(n) + 2) // 3 from {name} where n > 1 group by {key}, level, idx // 3)"""

    def siblings(of: str, in_: str, key: str) -> str:
        return f"""select a.i, string_agg(t.h, '' order by t.level, t.idx) as s from {of} a join {in_} t on a.{key} is not distinct from t.{key}
          and t.n > 1 and t.idx // 3 = a.idx // (3 ** (t.level + 1))::bigint and t.idx <> a.idx // (3 ** t.level)::bigint group by a.i"""

    def fold(name: str, base: str, in_: str, key: str) -> str:
        return f"""{name} as (select i, {key}, idx, 0 as level, h from {base} union all
          select f.i, any_value(f.{key}), any_value(f.idx) // 3, any_value(f.level) + 1, sha256(string_agg(case when t.idx = f.idx then f.h else t.h end, '' order by t.idx))
          from {name} f join {in_} t on f.{key} is not distinct from t.{key} and f.level = t.level and f.idx // 3 = t.idx // 3 and t.n > 1 group by f.i)"""

    return f"""
with recursive d as (select *, row_number() over () as i from documents),
hashed as (select i, doc_id, source, {leaf("text")} as h, case when (4294967295 - {crc}) % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end as tampered from d),
leaves as (select *, row_number() over (partition by source order by doc_id nulls first, h) - 1 as idx, count(*) over (partition by source) as n from hashed),
{tree("own", "source", "leaves")},
subs as (select source, 0 as g, h, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from own where n = 1),
{tree("top", "g", "subs")},
placed as (select l.i, subs.g, subs.idx, subs.h as subroot from leaves l join subs on l.source is not distinct from subs.source),
below as ({siblings("leaves", "own", "source")}),
above as ({siblings("placed", "top", "g")}),
{fold("up", "(select i, source, idx, tampered as h from leaves)", "own", "source")},
risen as (select u.i, placed.g, placed.idx, u.h from (select i, h from up qualify row_number() over (partition by i order by level desc) = 1) u join placed using (i)),
{fold("over_", "risen", "top", "g")},
ended as (select i, h from over_ qualify row_number() over (partition by i order by level desc) = 1),
root as (select h from top where n = 1)
select l.doc_id, l.h as leaf, p.subroot, root.h as root, sha256(coalesce(below.s, '') || coalesce(above.s, '')) as proof_sha256, ended.h as folded_root, ended.h = root.h as verified
from leaves l join placed p using (i) join ended using (i) cross join root left join below using (i) left join above using (i)
"""


#: DuckDB: groups by the digest of the text without white space.
OP12 = r"""
with t as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h, row_number() over () as i from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size, row_number() over w = 1 as kept, h as text_sha256
from t window w as (partition by h order by n desc, doc_id nulls last, i)
"""

#: DuckDB: every phrase counted, then the same thresholds and cuts.
OP13 = r"""
with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from t),
g as (select lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) as k from (select lang, w, unnest(range(1, len(w) + 1)) as i from p)),
f as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select *, string_split(phrase, ' ') as w from f where k > 1 and f >= 100),
s as (select lang, phrase, max(f) as above from (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, f from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c))) group by all),
cut as (select c.lang, c.phrase, c.f as a, j, array_to_string(w[1:j], ' ') as one, array_to_string(w[j + 1:], ' ') as two from (select *, unnest(range(1, k)) as j from c) c left join s using (lang, phrase) where above is null or above < c.f),
sc as (select cut.lang, cut.phrase, a, j, x.f as l, y.f as r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score from cut
  join f x on x.lang = cut.lang and x.phrase = one join f y on y.lang = cut.lang and y.phrase = two join n on n.lang = cut.lang),
best as (select * from sc qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""


#: The placeholders by the consuming patterns that the SQL engine has; two passes reach names that follow each other.
OP3_NAMES = r"([^.!?:\x20\x09-\x0D][\x20\x09])\p{Lu}[\p{L}'-]*"
OP3_NUMBERS = r"[0-9]+([.,:/][0-9]+)*"
OP3_UNITS = rf"(\x{{E000}}[\x20\x09]?)({'|'.join(decontam.UNITS)})([^\p{{L}}\p{{N}}]|$)"


def _templated(text: str) -> str:
    for _ in range(2):
        text = f"regexp_replace({text}, '{OP3_NAMES.replace(chr(39), chr(39) * 2)}', '\\1{decontam.NAME}', 'g')"
    text = f"regexp_replace({text}, '{OP3_NUMBERS}', '{decontam.NUMBER}', 'g')"
    text = f"regexp_replace(lower({text}), '{OP3_UNITS}', '\\1{decontam.UNIT}\\3', 'g')"
    return f"regexp_replace({text}, '{decontam.STRIP}', '', 'g')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{decontam.SPACE}'), lambda w: w <> '')"


def sql_op3() -> str:
    """Windows as strings, joined one by one: templates with slots that agree, and literal words."""
    lower = f"regexp_replace(lower(x), '{decontam.STRIP}', '', 'g')"

    def side(table: str, key: str) -> str:
        return f"""select k, n, pos, case when n >= 5 then array_to_string(t[pos + 1:pos + 5], ' ') else n || '|' || array_to_string(t, ' ') end as h,
          case when n >= 5 then array_to_string(v[pos + 1:pos + 5], ' ') else n || '|' || array_to_string(v, ' ') end as g,
          t[pos + 1:pos + 5] as w, v[pos + 1:pos + 5] as v
        from (select *, len(t) as n, unnest(range(0, greatest(len(t) - 4, 1))) as pos
          from (select k, {_words(_templated("x"))} as t, {_words(lower)} as v
            from (select {key} as k, regexp_replace(coalesce(text, ''), '{decontam.MARKS}', '', 'g') as x from {table} where {key} is not null)) where len(t) > 0)"""

    slot = f"w[i] in ('{decontam.NUMBER}', '{decontam.NAME}', '{decontam.UNIT}')"
    return f"""
with b0 as ({side("benchmark", "item_id")}),
b1 as (select k as item_id, h, pos as ipos, w, v as iv, n, len(list_filter(range(1, len(w) + 1), lambda i: {slot})) as slots from b0),
b2 as (select distinct item_id, h, ipos, w, iv, count(distinct ipos) over (partition by item_id) as total from b1 where n < 5 or len(w) - slots >= {decontam.LITERALS}),
d as ({side("documents", "doc_id")}),
m as (select d.k as doc_id, item_id, total, pos - ipos as diag, ipos,
  list_filter(list_transform(range(1, len(b2.w) + 1), lambda i: case when {slot.replace("w[", "b2.w[")} then [iv[i], d.v[i]] end), lambda p: p is not null) as p from d join b2 on d.h = b2.h),
g0 as (select distinct doc_id, item_id, diag from m),
g1 as (select *, case when diag - lag(diag) over (partition by doc_id, item_id order by diag) <= {decontam.SLIP} then 0 else 1 end as jump from g0),
g as (select *, sum(jump) over (partition by doc_id, item_id order by diag) as part from g1),
mm as (select m.*, g.part from m join g using (doc_id, item_id, diag) union all select *, 0 from m),
l as (select doc_id, item_id, part, any_value(total)::bigint as n_windows, count(distinct ipos)::bigint as n_matched, list_distinct(flatten(list(p))) as p from mm group by all),
l2 as (select doc_id, item_id, n_windows, n_matched, 1 as ord, len(list_filter(p, lambda y: y[1] <> y[2])) > 0 as moved from l
  where len(p) = len(list_distinct(list_transform(p, lambda y: y[1])))),
z as (select distinct k as item_id, g, pos as ipos from b0),
z2 as (select d.k as doc_id, item_id, count(distinct ipos)::bigint as n_matched from d join z using (g) group by all),
z3 as (select doc_id, item_id, total as n_windows, n_matched, 2, false from z2 join (select item_id, count(distinct ipos)::bigint as total from z group by all) using (item_id)),
u as (select * from l2 union all select * from z3)
select doc_id, item_id, n_windows, n_matched, n_matched::double / n_windows as coverage, case when moved then 'reparameterised' else 'verbatim' end as kind
from u where n_matched::double / n_windows >= {decontam.COVERAGE} qualify row_number() over (partition by doc_id, item_id order by ord, n_matched desc, moved) = 1
"""


def sql_op2() -> str:
    """The same vectors over all windows of all files, without the anchors."""
    known = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(licenses.TEMPLATES + licenses.TEXTS))
    terms = f"regexp_extract_all(lower({{}}), '{licenses.TERM}')"
    return f"""
with known(template, license, text) as (values {known}),
f as (select doc_id, '/' || coalesce(source, '_') || '/' || coalesce(lang, '_') || case when doc_id % 10 = 0 then '' else '/' || (doc_id // 100)::varchar end as dir, text from documents),
kt as (select template, license, unnest({terms.format("text")}) as term from known),
kv as (select template, license, term, count(*) as tf from kt group by all),
df as (select term, count(*) as df from (select doc_id, unnest(list_distinct({terms.format("text")})) as term from f) where term in (select term from kv) group by term),
idf as (select term, ln((1.0 + (select count(*) from f)) / (1.0 + coalesce(df, 0))) + 1.0 as idf from (select distinct term from kv) left join df using (term)),
rare as (select ln(1.0 + (select count(*) from f)) + 1.0 as idf),
kw as (select template, license, term, tf * idf as w from kv join idf using (term)),
kn as (select *, w / sqrt(sum(w * w) over (partition by template)) as tw from kw),
ln0 as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: {terms.format("x")}) as ls from f where text is not null),
ln1 as (select *, len(ls) as n, len(flatten(ls)) as file_terms from ln0),
wn as (select doc_id, file_terms, s, k, flatten(ls[s:s + k - 1]) as ts from (select *, unnest(range(1, {licenses.LINES} + 1)) as k from (select *, unnest(range(1, n + 1)) as s from ln1)) where s + k - 1 <= n
  union all select doc_id, file_terms, 1, n, flatten(ls) from ln1 where n > {licenses.LINES}),
lt as (select doc_id, s, k, file_terms, len(ts) as line_terms, unnest(ts) as term from wn where len(ts) > 0),
tf as (select doc_id, s, k, file_terms, line_terms, term, count(*) as tf from lt group by all),
tw as (select tf.*, tf * coalesce(idf.idf, rare.idf) as w from tf left join idf using (term) cross join rare),
own as (select doc_id, s, k, file_terms, line_terms, sqrt(sum(w * w)) as norm from tw group by all),
dot as (select doc_id, s, k, template, license, sum(tw.w * kn.tw) as dot from tw join kn using (term) group by all),
best as (select doc_id, s, k, file_terms, line_terms, template, license, round(dot / norm, 6) as cosine from dot join own using (doc_id, s, k) where round(dot / norm, 6) >= {licenses.COSINE}),
top as (select * from best qualify row_number() over (partition by doc_id order by cosine desc, s, k, template) = 1),
per as (select doc_id, max(line_terms / file_terms) as share from best group by doc_id),
lic as (select doc_id, top.license as own, top.cosine, case when share >= {licenses.FILE_SHARE} then 'file' else 'header' end as kind from per join top using (doc_id)),
votes as (select dir, own, count(*) as n from lic join f using (doc_id) where kind = 'file' group by all),
held as (select * from votes qualify row_number() over (partition by dir order by n desc, own) = 1),
up as (select d.dir, held.dir as above, held.own as passed from (select distinct dir from f) d join held on d.dir = held.dir or starts_with(d.dir, held.dir || '/')
  qualify row_number() over (partition by d.dir order by len(held.dir) desc) = 1)
select f.doc_id, f.dir || '/' || f.doc_id::varchar as path, coalesce(lic.own, passed) as license, coalesce(kind, case when passed is not null then 'inherited' end, 'none') as origin,
  lic.cosine, case when lic.own is null then above end as licensed_from
from f left join lic using (doc_id) left join up on up.dir = f.dir
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": sql_op2(), "op3_template_decontamination": sql_op3(), "op1_vantage_point_search": OP1, "op6_source_mix": OP6, "op10_warc_round_trip": OP10, "op11_merkle_manifest": sql_op11(), "op12_exact_duplicates": OP12, "op13_collocations": OP13}
