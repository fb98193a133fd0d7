"""Text, URL and predicate operators over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import spans
from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.operators import corpus as C
from corpusloom.plans.registry import query, table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


SQUASH = r"trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query("select doc_id, " + SQUASH.format("text") + " as clean from documents")
def txt_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text"), F.col("lang")).alias("clean"))


#: Documents in Arabic letters: each Latin letter stands for one, some for variants, tatweel and diacritics.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyzéèêçßäöü", "أبتثجحخدذرزسشصضطظعغفقكلمنهىةآإـُِو"
LETTERS = f"translate(lower(text), '{LATIN}', '{ARABIC}')"
NORMAL = f"trim(regexp_replace(translate(regexp_replace({LETTERS}, '{T.AR_DIACRITICS}', '', 'g'), 'أإآٱىةـ', 'اااايه'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def in_arabic(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.translate(F.lower("text"), LATIN, ARABIC).alias("t"))


@query(f"select doc_id, {NORMAL} as n from documents")
def txt_normalize_arabic(spark, sf_dir):
    return in_arabic(spark, sf_dir).select("doc_id", T.normalize_arabic(F.col("t")).alias("n"))


@query("select doc_id, len(regexp_extract_all(lower(text), '[a-z]{2,}'))::bigint as n, array_to_string(regexp_extract_all(lower(text), '[a-z]{2,}')[1:10], ' ') as head from documents")
def txt_tokenize(spark, sf_dir):
    ts = T.tokenize(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(ts).cast("long").alias("n"), F.array_join(F.slice(ts, 1, 10), " ").alias("head"))


@query("""with t as (select item_id, regexp_extract_all(lower(text), '[a-z]{3,}') as t from benchmark),
u as (select item_id, t, unnest(t) as w, generate_subscripts(t, 1) as i from t),
d as (select item_id, case w when 'thereding' then 'there' else w end as w, min(i) as i from u group by all)
select item_id, string_agg(w, ' ' order by i) as terms from d group by item_id""")
def txt_query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text"), {"thereding": "there"}), " ").alias("terms"))


@query(r"select conv_id, turn, regexp_replace(regexp_replace(text, '(?i)\bof\b', 'from', 'g'), '(?i)\bthe\b', 'this', 'g') as t from conversations")
def txt_spacing_aliases(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.spacing_aliases(F.col("text"), {"of": "from", "the": "this"}).alias("t"))


@query("""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) as w from documents)
select w, case when length(w) >= 7 and w like '%ies' then left(w, length(w) - 3) || 'y'
  when length(w) >= 6 and regexp_matches(w, '(ses|xes|zes|ches|shes)$') then left(w, length(w) - 2)
  when length(w) >= 5 and w like '%s' and not regexp_matches(w, '(ss|us|is)$') then left(w, length(w) - 1) else w end as stem from w""")
def txt_stem_en(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode_outer(T.tokenize(F.col("text"))).alias("w")).where("w is not null").distinct()
    return words.select("w", T.stem_en(F.col("w")).alias("stem"))


def _stem_sql() -> str:
    front = " ".join(f"when starts_with(w, '{p}') and length(w) - {len(p)} >= 3 then substr(w, {len(p) + 1})" for p in T.AR_PREFIXES)
    back = " ".join(f"when suffix(c, '{x}') and length(c) - {len(x)} >= 3 then left(c, length(c) - {len(x)})" for x in T.AR_SUFFIXES)
    words = f"select distinct unnest(regexp_extract_all({NORMAL}, '[؀-ۿ]{{2,}}')) as w from documents"
    return f"with w as ({words}), c as (select w, case {front} else w end as c from w) select w, case {back} else c end as stem from c"


@query(_stem_sql())
def txt_stem_ar(spark, sf_dir):
    words = in_arabic(spark, sf_dir).select(F.explode(T.tokenize(F.col("t"), "ar")).alias("w")).distinct()
    return words.select("w", T.stem_ar(F.col("w")).alias("stem"))


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS_EN)


@query(f"select item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]{{2,}}'), lambda w: w not in ({STOP})), ' ') as kept from benchmark")
def txt_stopwords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.without_stopwords(T.tokenize(F.col("text"))), " ").alias("kept"))


@query("""with t as (select item_id, regexp_extract_all(lower(text), '[a-z]{2,}') as t from benchmark),
e as (select item_id, list_concat(t, flatten(list_transform(t, lambda w: case when length(w) >= 3 then [w, w || 's', w || 'es'] else [w] end))) as v from t),
u as (select item_id, unnest(v) as w, generate_subscripts(v, 1) as i from e), d as (select item_id, w, min(i) as i from u group by all)
select item_id, string_agg(w, ' ' order by i) as variants from d group by item_id""")
def txt_variants(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.plural_variants(T.tokenize(F.col("text"))), " ").alias("variants"))


@query("""with t as (select item_id, regexp_extract_all(lower(text), '[a-z]{2,}') as t from benchmark)
select item_id, array_to_string(list_transform(list_filter(range(1, len(t)), lambda i: length(t[i]) >= 3 and length(t[i + 1]) >= 3), lambda i: t[i] || ' ' || t[i + 1]), '|') as phrases from t""")
def txt_phrases(spark, sf_dir):
    ts = table(spark, sf_dir, "benchmark").select("item_id", T.tokenize(F.col("text")).alias("t"))
    return ts.select("item_id", F.array_join(T.bigram_phrases(F.col("t")), "|").alias("phrases"))


STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<(script|style|noscript|iframe|svg)[^>]*>.*?</(script|style|noscript|iframe|svg)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', chr(10), 'g'), '(?i)&(nbsp|amp|lt|gt|quot|#[0-9]+);', ' ', 'g')"""


@query(f"select page_id, {SQUASH.format(STRIPPED.format('html'))} as t from pages")
def txt_strip_html(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.squash(T.strip_html(F.col("html"))).alias("t"))


@query(r"select doc_id, case when instr(text, ' the ') - 1 >= 0 and instr(text, ' the ') - 1 < length(text) * 0.7 then regexp_replace(substr(text, instr(text, ' the ') + 5), '^[ |\-]+|[ |\-]+$', '', 'g') else text end as t from documents")
def txt_strip_chrome(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.strip_chrome(F.col("text"), [" the "]).alias("t"))


@query("""select doc_id, rtrim(left(text, least(length(text), case when instr(lower(text), 'all rights') - 1 > floor(length(text) * 0.55) then instr(lower(text), 'all rights') - 1 else length(text) end)::bigint), ' ') as t from documents""")
def txt_cut_footer(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.cut_footer(F.col("text"), ["all rights"]).alias("t"))


@query(r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: not (regexp_matches(x, '(?i)^(Welcome|Logout|Main Menu|Notifications|Favorite List|Follow Up|Consumer Protection)([^a-z0-9_]|$)')
  or regexp_matches(x, '(?i)(swiper|cookie|subscribe|newsletter|chatbot|whatsapp widget|share this|print this)') or regexp_matches(x, '([ \t]*\|[ \t]*[^\n|]{2,40}){4,}'))) as l from documents)
select doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: i = 1 or l[i] <> l[i - 1]), lambda i: l[i]), chr(10)) as t from l""")
def txt_filter_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.filter_lines(F.col("text")).alias("t"))


@query(r"select doc_id, regexp_replace(text || ' {{x}} [[y]] lorem ipsum', '(?i)(\{\{[^}]+\}\}|%\{[^}]+\}%|\[\[[^\]]+\]\]|null\s*undefined|TODO_CONTENT|lorem ipsum)', ' ', 'g') as t from documents")
def txt_placeholders(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.drop_placeholders(F.concat("text", F.lit(" {{x}} [[y]] lorem ipsum"))).alias("t"))


@query()
def txt_clean_document(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.clean_document(F.col("html")).alias("t"))


@query("select doc_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text || ' ' || repeat('QUJD', 40) || ' end', '(data:image/[a-zA-Z0-9.+-]+;base64,)?[A-Za-z0-9+/]{100,}={0,2}', ' ', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')), 'x^', '') as t from documents".replace("\\\\", "\\"))
def txt_strip_base64(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.strip_base64(F.concat("text", F.lit(" " + "QUJD" * 40 + " end"))).alias("t"))


@query("""with n as (select o.o_orderkey as k, list([l_linenumber::varchar, l_returnflag || '|' || l_linestatus] order by l_linenumber, l_returnflag, l_linestatus) as r from orders o join lineitem on l_orderkey = o_orderkey group by 1)
select k, '| a | b | c |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(r, lambda x: '| ' || x[1] || ' | ' || replace(x[2], '|', '\\|') || ' |  |'), chr(10)) as md from n""".replace("\\\\", "\\"))
def txt_table_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(F.col("l_linenumber").cast("string"), F.concat_ws("|", "l_returnflag", "l_linestatus")).alias("r")))).alias("x"))
    head = F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return rows.select("k", T.table_markdown(F.concat(head, F.col("x.r"))).alias("md"))


@query("select c_custkey as k, '[TABLE]' || chr(10) || 'name | ' || c_name || chr(10) || '[/TABLE]' as t from customer")
def txt_table_block(spark, sf_dir):
    rows = F.array(F.array(F.lit("name"), F.lit(" "), F.col("c_name")), F.array(F.lit(""), F.lit(None)))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), T.table_block(rows).alias("t"))


@query("select conv_id, turn, chr(10) || '## ' || role || chr(10) || chr(10) || trim(text) as t from conversations where length(trim(text)) > 2")
def txt_render_blocks(spark, sf_dir):
    block = lambda tag, c: F.struct(F.lit(tag).alias("tag"), c.alias("text"))
    conv = table(spark, sf_dir, "conversations").where("length(trim(text)) > 2")
    return conv.select("conv_id", "turn", T.render_blocks(F.array(block("H2", F.col("role")), block("nav", F.col("text")), block("p", F.col("text")), block("p", F.lit("ab")))).alias("t"))


@query(f"""with d as (select doc_id, {SQUASH.format('lower(text)')} as t from documents),
h as (select *, length(t) as n, list_min(list_filter(list_transform(['heon', 'tion', 'que'], lambda w: instr(t, w)), lambda p: p > 0)) - 1 as a from d),
s as (select *, least(n, greatest(0, a - 60) + 240) as e from h), z as (select *, greatest(0, least(greatest(0, a - 60), e - 240)) as b from s),
c as (select *, trim(substr(t, b + 1, e - b)) as c0 from z), c2 as (select *, case when n > e then regexp_replace(c0, ' [^ ]*$', '') || '…' else c0 end as c1 from c)
select doc_id, case when a is null then case when n > 240 then regexp_replace(left(t, 240), ' [^ ]*$', '') else t end when b > 0 then '…' || regexp_replace(ltrim(c1), '^[^ ]* ', '') else c1 end as s from c2""")
def txt_snippet(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.snippet(F.col("text"), F.array(*map(F.lit, ("heon", "tion", "que")))).alias("s"))


@query("select doc_id, greatest(1, length(text) // 4)::int as n from documents")
def txt_approx_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.approx_tokens(F.col("text")).alias("n"))


@query("select conv_id, turn, regexp_replace(text, '(?i)(tion|the)', '<mark>\\1</mark>', 'g') as t from conversations".replace("\\\\", "\\"))
def txt_highlight(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.highlight(F.col("text"), ["the", "tion"]).alias("t"))


@query("select conv_id, turn, text as summary, role as source from conversations where length(trim(text)) > 0 and text not like '%###%' and text = trim(text, ' ')")
def txt_sections(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").where("length(trim(text)) > 0 and text not like '%###%' and text = trim(text)")
    parts = T.sections(F.concat(F.lit("### Summary\n"), F.col("text"), F.lit("\n### Source\n"), F.col("role")))
    return conv.select("conv_id", "turn", F.try_element_at(parts, F.lit("Summary")).alias("summary"), F.try_element_at(parts, F.lit("Source")).alias("source"))


@query("select conv_id, turn, case when text like '%###%' then text else '### Answer' || chr(10) || text || chr(10) || chr(10) || '### Key Information' || chr(10) || text || chr(10) || chr(10) || '### Source' || chr(10) || role end as t from conversations")
def txt_wrap_answer(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.wrap_answer(F.col("text"), F.lit(None).cast("string"), F.col("role")).alias("t"))


@query(r"select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\f\r]+', ' ', 'g')) as title from pages")
def txt_title(spark, sf_dir):
    found = F.nullif(T.squash(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    head = F.nullif(T.squash(F.regexp_extract("html", r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1)), F.lit(""))
    return pages(spark, sf_dir).select("page_id", F.coalesce(found, head, F.lit("Untitled page")).alias("title"))


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as w, length(text) as n, text from documents),
c as (select *, ceil(greatest(0, len(w) - 373) / 307.0)::int as k from w),
u as (select doc_id, n, w, text, unnest(case when n // 4 <= 280 then [0] else range(0, k + 1) end) as i from c)
select doc_id, i::int as window_no, case when n // 4 <= 280 then trim(text, ' ') else array_to_string(w[i * 307 + 1:i * 307 + 373], ' ') end as t from u""")
def gen_word_windows(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode_outer(T.word_windows(F.col("text"))).alias("window_no", "t"))


@query(r"""with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+') as w from documents)
select doc_id, len(list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(w[i:i + 2], ' '))))::bigint as n from w where len(w) > 0
union all select doc_id, 0 from w where len(w) = 0""")
def gen_shingles(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.shingles(F.col("text"), 3)).cast("long").alias("n"))


SECTIONED = r"'intro' || chr(10) || '## One' || chr(10) || text || chr(10) || '[TABLE]' || chr(10) || 'a | b' || chr(10) || '[/TABLE]' || chr(10) || '## Two'"


@query()
def gen_chunks(spark, sf_dir):
    whole = F.concat(F.lit("intro\n## One\n"), F.col("text"), F.lit("\n[TABLE]\na | b\n[/TABLE]\n## Two"))
    return C.chunks(docs(spark, sf_dir), "doc_id", whole)


@query("select doc_id, 4::bigint as n, 1::bigint as tables from documents")
def gen_chunk_numbers(spark, sf_dir):
    """Short documents: an intro and two sections give three parents; paragraphs, tables first, give the children."""
    whole = F.concat(F.lit("intro\n## One\n"), F.col("doc_id").cast("string"), F.lit("\n[TABLE]\na | b\n[/TABLE]\n## Two"))
    found = C.chunks(docs(spark, sf_dir), "doc_id", whole)
    kids = found.where("level = 'child' or heading = 'Two'")
    return kids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").contains("[TABLE]") & (F.col("level") == "child")).alias("tables"))


CANON = r"lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(.*)$', 1)) || '://' || lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(.*)$', 2)) || regexp_replace(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(.*)$', 3), '/{2,}', '/', 'g') || regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(.*)$', 4)"


@query(f"with p as (select page_id, url_decode(trim(url, ' ')) as u from pages) select page_id, {CANON} as canonical, lower({CANON}) as key, left(sha256({CANON}), 16) as id from p")
def url_canonical(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.canonicalize(u).alias("canonical"), U.key(u).alias("key"), U.document_id(u).alias("id"))


@query("select doc_id, sha256(text) as h from documents")
def url_content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", U.content_hash(F.col("text")).alias("h"))


@query("select page_id, regexp_extract(url || '#/EN/Home/' || page_id || '?x=1', '#/(?:AR/|EN/)?([^?]*)', 1) as slug from pages where url not like '%#%'")
def url_route_slug(spark, sf_dir):
    u = F.concat("url", F.lit("#/EN/Home/"), F.col("page_id").cast("string"), F.lit("?x=1"))
    return pages(spark, sf_dir).where("url not like '%#%'").select("page_id", U.route_slug(u).alias("slug"))


@query("""select event_id, coalesce(lower(props->>'$.k'), '') as k from events""")
def url_json_parameter(spark, sf_dir):
    u = F.concat(F.lit("https://a.example/x?inParams="), F.replace(F.url_encode("props"), F.lit("+"), F.lit("%20")))
    return table(spark, sf_dir, "events").select("event_id", U.json_parameter(u, "inParams", "k").alias("k"))


@query("""select page_id, round(-least(length(url), 500) / 500.0::double - (length(url) - length(replace(url, '%', ''))) * 0.15 - (length(url) - length(replace(url, ' ', ''))) * 0.2
 - case when regexp_matches(lower(url), 'typo|old|legacy') then 0.5 else 0 end, 6) as score from pages where url not like '%#/%'""")
def url_canonicity(spark, sf_dir):
    return pages(spark, sf_dir).where("url not like '%#/%'").select("page_id", F.round(U.canonicity(F.col("url")), 6).alias("score"))


@query("select page_id, case when url like '%/fr/%' then 'fr' when url like '%/de/%' then 'de' when url like '%/es/%' then 'es' else 'en' end as lang, url like 'http%://%' as http from pages")
def url_language(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.language(u, {"/fr/": "fr", "/de/": "de", "/es/": "es"}, "en").alias("lang"), U.is_http(u).alias("http"))


@query(r"select page_id from pages where regexp_matches(regexp_extract(url, '^https?://([^/?#]*)', 1), '(^|\.)example\.com$') and url not like '%utm_%' and not regexp_matches(url, '[ \t\n]')")
def url_admission(spark, sf_dir):
    return pages(spark, sf_dir).where(U.admitted(F.col("url"), ["example.com"], ["utm_"])).select("page_id")


@query("select page_id, url from (select *, row_number() over (partition by lower(url) order by page_id) as r from pages where url like '%example%' and url like '%/en/%') where r = 1 order by page_id limit 20")
def url_needle_search(spark, sf_dir):
    needles = F.array(F.lit("example"), F.lit("/en/"))
    found = pages(spark, sf_dir).where(F.forall(needles, lambda n: F.contains(F.col("url"), n)))
    from corpusloom.operators.ranking import best_per

    return best_per(found, ["url"], F.col("page_id")).orderBy("page_id").limit(20).select("page_id", "url")


@query("""with l as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents)
select doc_id, length(text) >= 200 and ((length(text) - length(replace(text, ' - ', ''))) // 3 >= 12 or (length(text) - length(replace(text, ' | ', ''))) // 3 >= 8
  or (len(l) > 30 and len(list_filter(l, lambda x: length(x) < 80 and contains(x, ' - '))) / greatest(1, len(l)) > 0.6)) as menu from l""")
def cls_menu_heavy(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", C.menu_heavy(F.col("text")).alias("menu"))


@query()
def cls_quality_penalty(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(C.quality_penalty(F.col("text")), 6).alias("penalty"))


@query("select doc_id, case when len(regexp_extract_all(text, '[؀-ۿ]')) >= greatest(3, length(text) // 8) then 'ar' else 'en' end as lang from documents")
def cls_language(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", C.language_of(F.col("text")).alias("lang"))


RULES = [("(?i)(price|cost|fee)", "pricing", 0.95), ("(?i)tion.*ing", "process", 0.8), ("(?i)the", "general", 0.6)]


@query("""select conv_id, turn, case when regexp_matches(text, '(?i)(price|cost|fee)') then 'pricing' when regexp_matches(text, '(?i)tion.*ing') then 'process' when regexp_matches(text, '(?i)the') then 'general' else 'other' end as label,
 case when regexp_matches(text, '(?i)(price|cost|fee)') then 0.95 when regexp_matches(text, '(?i)tion.*ing') then 0.8 when regexp_matches(text, '(?i)the') then 0.6 else 0 end::double as confidence from conversations""")
def cls_intent_rules(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    return C.classify(conv, C.rule_table(spark, RULES), "k", "text", "other").select("k.conv_id", "k.turn", "label", "confidence")


@query("select doc_id, case when regexp_matches(text, '(?i)licensed under|license') then 'license' when regexp_matches(text, '[|].*[|].*[|]') then 'table' when length(text) < 120 then 'stub' else 'prose' end as kind from documents")
def cls_document_rules(spark, sf_dir):
    d = docs(spark, sf_dir)
    chain = C.first_match(d, [("(?i)licensed under|license", "license"), ("[|].*[|].*[|]", "table")], F.col("text"), "prose")
    return d.select("doc_id", F.when((chain == "prose") & (F.length("text") < 120), "stub").otherwise(chain).alias("kind"))


@query(r"""with e as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as value, 'email' as type from documents
 union all select doc_id, unnest(regexp_extract_all(text, '[0-9]+%')), 'percent' from documents) select doc_id, type, value, count(*)::bigint as n from e group by all""")
def cls_entities(spark, sf_dir):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "percent": "[0-9]+%"}

    def typed(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    found = F.flatten(F.array(*[typed(k, p) for k, p in kinds.items()]))
    rows = docs(spark, sf_dir).where(F.col("text").rlike("[@%]")).select("doc_id", F.explode_outer(found).alias("e")).where("e is not null")
    return rows.groupBy("doc_id", "e.type", "e.value").agg(F.count(F.lit(1)).alias("n"))


ENTITY_KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("percent", r"[0-9]+(?:\.[0-9]+)?%"), ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("amount", r"[0-9][0-9,]*(?:\.[0-9]+)?(?: ?(?:USD|EUR|GBP))?")]


@query()
def cls_entity_spans(spark, sf_dir):
    """Entities of every document with their places, none within another; a test holds them against a loop."""
    found = docs(spark, sf_dir).select("doc_id", F.explode(spans.entities(F.col("text"), ENTITY_KINDS)).alias("e"))
    return found.select("doc_id", "e.start", "e.end", "e.kind", "e.value")


@query("select doc_id, array_to_string(list_filter(['tion', 'ing', 'que', 'ung', 'zzz'], lambda k: contains(lower(left(text, 2000)), k))[1:12], ',') as keywords from documents")
def cls_keywords(spark, sf_dir):
    low = F.lower(F.substring("text", 1, 2000))
    found = T.let(low, lambda x: F.filter(F.array(*map(F.lit, ("tion", "ing", "que", "ung", "zzz"))), lambda k: F.contains(x, k)))
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.slice(F.array_distinct(found), 1, 12), ",").alias("keywords"))


@query("select conv_id, turn, coalesce(nullif(upper(regexp_extract(text, '(?i)(^|[^a-z])(supported|unsupported)([^a-z]|$)', 2)), ''), 'PARTIALLY_SUPPORTED') as label from conversations")
def cls_faithfulness(spark, sf_dir):
    label = F.nullif(F.upper(F.regexp_extract("text", "(?i)(^|[^a-z])(supported|unsupported)([^a-z]|$)", 2)), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(label, F.lit("PARTIALLY_SUPPORTED")).alias("label"))


@query("""with k as (select lower(trim(word)) as word, count(*) as n from (select unnest(string_split(text, ' ')) as word from benchmark) group by 1)
select case when word = '' then 'empty' else 'repeated' end as fault, count(*)::bigint as n from k where n > 1 or word = '' group by 1""")
def cls_vocabulary_faults(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).groupBy(F.lower(F.trim("w")).alias("word")).count()
    bad = words.where("count > 1 or word = ''").select(F.when(F.col("word") == "", "empty").otherwise("repeated").alias("fault"))
    return bad.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select conv_id, turn, unnest(string_split_regex(text, '(?i) and | then ')) as part, unnest(range(0, len(string_split_regex(text, '(?i) and | then ')))) as pos from conversations where role = 'user'),
f as (select *, row_number() over (partition by conv_id, turn order by pos) as r, count(*) over (partition by conv_id, turn) as n from p where length(trim(part)) >= 4)
select conv_id, turn, (r - 1)::int as part_no, trim(part) as part from f where r <= 2 and n >= 2""")
def gen_query_split(spark, sf_dir):
    from pyspark.sql import Window

    conv = table(spark, sf_dir, "conversations").where("role = 'user'")
    parts = conv.select("conv_id", "turn", F.posexplode(F.split("text", "(?i) and | then ")).alias("pos", "part")).where("length(trim(part)) >= 4")
    w = Window.partitionBy("conv_id", "turn")
    parts = parts.withColumn("r", F.row_number().over(w.orderBy("pos"))).withColumn("n", F.count(F.lit(1)).over(w))
    return parts.where("r <= 2 and n >= 2").select("conv_id", "turn", (F.col("r") - 1).alias("part_no"), F.trim("part").alias("part"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
g as (select *, sum(case when line like '%.' then 1 else 0 end) over (partition by doc_id order by pos) as field from l)
select doc_id, field::bigint as field, string_agg(line, ' ' order by pos) as value from (select *, row_number() over (partition by doc_id, field order by pos) as r from g) where r <= 8 group by doc_id, field""")
def gen_field_lines(spark, sf_dir):
    """Lines grouped under the label line before them, eight at most."""
    from pyspark.sql import Window

    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("field", F.sum(F.col("line").endswith(".").cast("long")).over(Window.partitionBy("doc_id").orderBy("pos")))
    lines = lines.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "field").orderBy("pos"))).where("r <= 8")
    sorted_ = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("doc_id", "field").agg(F.array_join(F.transform(sorted_, lambda x: x["line"]), " ").alias("value"))
