"""Page admission, query rewriting, titles, blocks, citations and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import quality as Q
from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.plans import registry
from corpusloom.plans.registry import query, table


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


JUNK, LOW, BROKEN = "undefined|null", "utm_|session", "%25|[{}]"


@query(f"select page_id, regexp_matches(url, '(?i){JUNK}') as junk, regexp_matches(url, '(?i){LOW}') as low_value, regexp_matches(url, '(?i){BROKEN}') as broken from pages")
def cls_url_quality(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", Q.matches(u, JUNK).alias("junk"), Q.matches(u, LOW).alias("low_value"), Q.matches(u, BROKEN).alias("broken"))


@query("select page_id, contains(url, 'example') and (contains(url, '/en/') or contains(url, '/de/') or contains(url, '7')) as official from pages")
def cls_official_category(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", Q.official_category(F.col("url"), "example", ["/en/", "/de/", "7"]).alias("official"))


@query("""with c as (select doc_id, lang, len(regexp_extract_all(text, '[؀-ۿ]')) as a, len(regexp_extract_all(text, '[A-Za-z]')) as l from documents)
select doc_id, case when not (case when lang = 'ar' then a >= 20 or a >= 0.15 * l else l >= 30 and a <= 0.5 * l end) then 'language_mismatch:' || lang end as error from c""")
def cls_language_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Q.language_error(F.col("text"), F.col("lang")).alias("error"))


REFUSAL, COMPLEX = "cannot|not able|sorry", "compare|difference|tion.*tion"


@query(f"select conv_id, turn, regexp_matches(text, '(?i){REFUSAL}') as refusal, case when regexp_matches(text, '(?i){COMPLEX}') or length(text) > 120 then 'large' else 'small' end as tier from conversations")
def cls_refusal_and_tier(spark, sf_dir):
    t = F.col("text")
    return conversations(spark, sf_dir).select("conv_id", "turn", Q.matches(t, REFUSAL).alias("refusal"), Q.model_tier(t, COMPLEX).alias("tier"))


@query("""select doc_id, regexp_matches(text, '(?i)rate|percent') as asks,
  regexp_matches(text, '[0-9]+ ?%') and (not regexp_matches(text, '(?i)home|local') or regexp_matches(left(text, 4000), '(?i)eur|usd')) as applicable from documents""")
def cls_rate_context(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", Q.matches(t, "rate|percent").alias("asks"), Q.applicable_rate(t, t, "home|local", "eur|usd").alias("applicable"))


CATALOGUE = [("(types|kinds) of", "types", 0.9), ("the .*the", "overview", 0.7)]


@query("""with l as (select conv_id, turn, role, case when regexp_matches(text, '(?i)(types|kinds) of') then 'types' when regexp_matches(text, '(?i)the .*the') then 'overview' else 'none' end as label from conversations)
select conv_id, turn, label, label <> 'none' and role = 'user' as catalogue from l""")
def cls_catalogue_query(spark, sf_dir):
    conv = conversations(spark, sf_dir).withColumn("k", F.struct("conv_id", "turn", "role"))
    rules = C.rule_table(spark, [(f"(?i){p}", n, c) for p, n, c in CATALOGUE])
    found = C.classify(conv, rules, "k", "text", "none")
    return found.select("k.conv_id", "k.turn", "label", ((F.col("label") != "none") & (F.col("k.role") == "user")).alias("catalogue"))


PAGE_TYPES = [("login|signin", "account"), ("/en/", "article"), ("ing", "guide")]
SUBCATEGORY = {"account": "service", "article": "reading", "guide": "reading"}


@query(r"""with p as (select page_id, lower(url) as u, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\f\r]+', ' ', 'g')) as title, length(html) as n from pages),
t as (select *, case when regexp_matches(u || ' ' || lower(title), 'login|signin') then 'account' when regexp_matches(u || ' ' || lower(title), '/en/') then 'article' when regexp_matches(u || ' ' || lower(title), 'ing') then 'guide' else 'web_page' end as page_type from p)
select page_id, page_type, case page_type when 'account' then 'service' when 'article' then 'reading' when 'guide' then 'reading' end as subcategory,
  case when title like '% - %' then regexp_extract(title, '.* - (.*)$', 1) else title end as product_name,
  round(greatest(0.1, least(1.0, 0.9 - case when n < 1000 then 0.3 else 0.0 end - case when title = '' then 0.6 else 0.0 end)), 6)::double as quality from t""")
def cls_metadata(spark, sf_dir):
    """Page type by the first rule, what it maps to, the title's product and a clamped quality."""
    title = T.squash(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("u"), title.alias("title"), F.length("html").alias("n"))
    rows = rows.withColumn("page_type", C.first_match(rows, PAGE_TYPES, F.concat_ws(" ", "u", F.lower("title")), "web_page"))
    sub = F.create_map(*[F.lit(x) for kv in SUBCATEGORY.items() for x in kv])
    product = F.when(F.contains(F.col("title"), F.lit(" - ")), F.regexp_extract("title", "(?s).* - (.*)$", 1)).otherwise(F.col("title"))
    penalty = F.when(F.col("n") < 1000, 0.3).otherwise(0.0) + F.when(F.col("title") == "", 0.6).otherwise(0.0)
    return rows.select("page_id", "page_type", F.try_element_at(sub, F.col("page_type")).alias("subcategory"), product.alias("product_name"), F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.9 - penalty)), 6).alias("quality"))


@query("""with e as (select page_id as entry, [url, 'https://other.example/' || page_id] as urls from pages)
select entry, contains(urls[1], '/de/') or contains(urls[2], '/de/') or contains(urls[1], '9') or contains(urls[2], '9') as poisoned from e""")
def cls_cache_poison(spark, sf_dir):
    return _cache(spark, sf_dir).select("entry", _poisoned().alias("poisoned"))


@query("""with e as (select page_id as entry, [url, 'https://other.example/' || page_id] as urls from pages)
select entry from e where not (contains(urls[1], '/de/') or contains(urls[2], '/de/') or contains(urls[1], '9') or contains(urls[2], '9'))""")
def ans_cache_purge(spark, sf_dir):
    """What a purge leaves: the cache without its poisoned entries."""
    cache = _cache(spark, sf_dir)
    return cache.join(cache.where(_poisoned()).select("entry"), "entry", "left_anti").select("entry")


def _cache(spark, sf_dir):
    urls = F.to_json(F.array("url", F.concat(F.lit("https://other.example/"), F.col("page_id").cast("string"))))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("entry"), urls.alias("urls"))


def _poisoned():
    return F.exists(F.from_json("urls", "array<string>"), lambda u: Q.holds_any(u, ["/de/", "9"]))


WORDS = {"the": "this", "of": "from", "und": "and"}
EXPANSIONS = [("tion", "process steps"), ("ing", "how to")]
MAPPED = "array_to_string(list_transform(string_split_regex(lower(trim(text)), ' +'), lambda w: case w when 'the' then 'this' when 'of' then 'from' when 'und' then 'and' else w end), ' ')"
EXPANDED = "m || case when regexp_matches(m, '(?i)tion') then ' process steps' when regexp_matches(m, '(?i)ing') then ' how to' else '' end"


@query(f"with q as (select conv_id, turn, {MAPPED} as m from conversations) select conv_id, turn, {EXPANDED} as q from q")
def rwr_colloquial(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", Q.expand_words(F.col("text"), WORDS, EXPANSIONS).alias("q"))


COLLOQUIAL = [("wanna", "want to"), (r"\bthat's\b", "that is")]
ENTITIES = [("[0-9]+ ?%", 2), ("[0-9]+ (days|months|years)", 2)]
REWRITE = rf"""with q0 as (select conv_id, turn, text, regexp_replace(regexp_replace(lower(trim(text)), 'wanna', 'want to', 'g'), '\bthat''s\b', 'that is', 'g') as t from conversations),
q1 as (select conv_id, turn, text, {MAPPED.replace("lower(trim(text))", "lower(trim(t))")} as m from q0),
q2 as (select *, {EXPANDED} as x, list_concat(list_distinct(regexp_extract_all(lower(text), '[0-9]+ ?%')), list_distinct(regexp_extract_all(lower(text), '[0-9]+ (?:days|months|years)'))) as e from q1)"""


@query(REWRITE + " select conv_id, turn, len(e)::int as entities, case when len(e) = 0 then trim(x) end as rewritten from q2 where len(e) < 3")
def rwr_rules(spark, sf_dir):
    """Queries with few entities, whose order is the same on both sides."""
    rows = conversations(spark, sf_dir)
    low = F.lower("text")
    count = sum((F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(p), F.lit(0)))) for p, _ in ENTITIES), F.lit(0))
    text = Q.rewritten(F.col("text"), COLLOQUIAL, WORDS, EXPANSIONS, ENTITIES)
    return rows.select("conv_id", "turn", count.alias("entities"), F.when(count == 0, text).alias("rewritten")).where("entities < 3")


@query(REWRITE + r""", u as (select *, trim(x) as r from q2 where len(e) = 0)
select conv_id, turn, case when len(regexp_extract_all(text, '[؀-ۿ]')) >= greatest(3, length(text) // 8) then 'ar' else 'en' end as lang,
  case when regexp_matches(text, '(?i)price|cost') then 'pricing' when regexp_matches(text, '(?i)tion') then 'process' else 'other' end as intent,
  len(list_filter(list_distinct(regexp_extract_all(r, '[a-z]{2,}')), lambda w: not list_contains(regexp_extract_all(lower(text), '[a-z]{2,}'), w)))::int as added from u""")
def rwr_understanding(spark, sf_dir):
    """Language, intent and rewrite of each query without entities, and how many terms the rewrite adds."""
    rows = conversations(spark, sf_dir)
    low = F.lower("text")
    rows = rows.where(sum((F.size(F.regexp_extract_all(low, F.lit(p), F.lit(0))) for p, _ in ENTITIES), F.lit(0)) == 0)
    rows = rows.withColumn("r", Q.rewritten(F.col("text"), COLLOQUIAL, WORDS, EXPANSIONS, ENTITIES))
    intent = C.first_match(rows, [("(?i)price|cost", "pricing"), ("(?i)tion", "process")], F.col("text"), "other")
    added = F.size(F.array_except(T.tokenize(F.col("r")), T.tokenize(F.col("text"))))
    return rows.select("conv_id", "turn", C.language_of(F.col("text")).alias("lang"), intent.alias("intent"), added.alias("added"))


@query(r"select n_nationkey as k, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || ' |  |' || chr(10) || '| x\|y | ' || n_regionkey || ' |' as md from nation")
def txt_table_truncated(spark, sf_dir):
    s = lambda *c: F.array(*c)
    rows = s(s(F.lit("a"), F.lit("b")), s(F.col("n_name")), s(F.lit(" x|y"), F.col("n_regionkey").cast("string"), F.lit("cut")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), Q.table_truncated(rows).alias("md"))


@query(r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 2 and not regexp_matches(x, '(?i)subscribe|cookie|share this') and not regexp_matches(replace(x, ' ', ''), '^[A-Za-z0-9+/=]{100,}$')) as l from documents)
select doc_id, array_to_string(l, chr(10)) as t from l""")
def txt_admit_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Q.admitted_lines(F.col("text"), "subscribe|cookie|share this").alias("t"))


def _block(tag, text):
    return F.struct(F.lit(tag).alias("tag"), text.alias("text"))


@query("""select conv_id, turn, case when length(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g'))) > 1 and lower(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g'))) <> role then [role, text, 'a link that is long enough to stay'] else [role, 'a link that is long enough to stay'] end as kept from conversations""")
def txt_block_filter(spark, sf_dir):
    t = F.col("text")
    blocks = F.array(_block("p", F.col("role")), _block("p", t), _block("nav", t), _block("p", F.concat(t, F.lit("  "))), _block("a", F.lit("short link")), _block("a", F.lit("a link that is long enough to stay")), _block("p", F.lit("Main Menu")))
    kept = Q.kept_blocks(blocks, ["nav", "script"], F.array(F.lit("main menu")))
    return conversations(spark, sf_dir).select("conv_id", "turn", F.transform(kept, lambda b: b["text"]).alias("kept"))


@query("select n_nationkey as k, '## Title' || chr(10) || 'about ' || n_name || chr(10) || 'T1' || chr(10) || 'end' || chr(10) || '## Tables' || chr(10) || 'T2' as t from nation")
def txt_inline_tables(spark, sf_dir):
    blocks = F.array(_block("h2", F.lit("Title")), _block("p", F.concat(F.lit("about "), F.col("n_name"))), _block("p", F.lit("end")))
    made = lambda head, body: F.struct(head.alias("head"), F.lit(body).alias("body"))
    tables = F.array(made(F.lower(F.col("n_name")), "T1"), made(F.lit("nowhere"), "T2"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), Q.inline_tables(blocks, tables).alias("t"))


@query(r"""with p as (select page_id, case when page_id % 2 = 0 then 'doc_ProductID=big-' || page_id else 'doc_' || page_id end as id, case when page_id % 3 = 0 then null else regexp_replace(url, '[?#].*$', '') end as u from pages)
select page_id, trim(regexp_replace(coalesce(nullif(regexp_extract(id, 'ProductID=([^&/]+)', 1), ''), nullif(regexp_extract(u, '/([^/]+)/?$', 1), ''), regexp_extract(id, '^[^_]*_(.*)$', 1)), '[-_ ]+', ' ', 'g')) as title from p""")
def txt_title_from_id(spark, sf_dir):
    number = F.col("page_id").cast("string")
    doc_id = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("doc_ProductID=big-"), number)).otherwise(F.concat(F.lit("doc_"), number))
    url = F.when(F.col("page_id") % 3 != 0, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", Q.title_from_id(doc_id, url).alias("title"))


@query("select p_partkey as k, case when p_partkey % 3 = 0 then 'Site - ok' when p_partkey % 3 = 1 then p_name else 'SITE | home' end as title from part")
def txt_title_prefix(spark, sf_dir):
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, "Site - ok").when(k == 1, F.concat(F.lit("Site: "), F.col("p_name"))).otherwise("SITE | home")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), Q.without_prefix(title, "site", 3, ["home"]).alias("title"))


@query("""with t as (select p_type, lower(trim(p_name)) as key, p_partkey from part), q as (select lower(p_name) as key, p_partkey as query_id from part where p_size % 10 = 0)
select query_id, min(t.p_partkey) as page, 10000.0::double as score from q join t using (key) group by query_id""")
def rnk_express_tier(spark, sf_dir):
    """Pages whose title is the query, with a fixed score, whether or not any index finds them."""
    from corpusloom.operators import ranking as R

    part = table(spark, sf_dir, "part")
    queries = part.where("p_size % 10 = 0").select(F.col("p_partkey").alias("query_id"), F.upper("p_name").alias("query"))
    return R.exact_titles(queries, part.select(F.col("p_partkey").alias("page"), F.col("p_name").alias("title")))


@query("""with d as (select doc_id, floor(length(text) / 4) as n, list_filter(string_split_regex(text, '\n'), lambda x: trim(x) <> '') as l from documents where length(text) > 0),
m as (select doc_id, n, l, len(list_filter(l, lambda x: starts_with(x, 'The') or starts_with(x, 'Ein'))) as k from d)
select doc_id, case when n > 50 and k >= 2 then k + case when starts_with(l[1], 'The') or starts_with(l[1], 'Ein') then 0 else 1 end else 1 end::int as parts from m where len(l) > 0""")
def gen_field_split(spark, sf_dir):
    parts = Q.field_split(F.col("text"), ["The", "Ein"], 50)
    return table(spark, sf_dir, "documents").where("trim(regexp_replace(text, '\n', ' ')) <> '' and length(text) > 0").select("doc_id", F.size(parts).alias("parts"))


@query("""with r as (select o_custkey as q, o_orderkey as id, o_totalprice / 500000 as score, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rk, o_orderpriority from orders),
a as (select q, avg(case when rk <= 3 then score end) as top, max(case when rk <= 5 then case when o_orderpriority like '%U%' then 1.0 else 0.5 end end) as overlap from r group by q)
select q, round(0.55 * top + 0.45 * overlap, 6) as legacy, round(0.75 * least(1, top) + 0.25 * (0.55 * top + 0.45 * overlap), 6) as confidence from a""")
def agg_legacy_confidence(spark, sf_dir):
    from corpusloom.operators import ranking as R

    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("score"), F.when(F.col("o_orderpriority").contains("U"), 1.0).otherwise(0.5).alias("overlap"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")))
    mean = F.avg(F.when(F.col("rank") <= 3, F.col("score")))
    found = rows.groupBy("q").agg(mean.alias("top"), R.legacy_confidence("rank", "score", "overlap").alias("legacy"))
    return found.select("q", F.round("legacy", 6).alias("legacy"), F.round(0.75 * F.least(F.lit(1.0), F.col("top")) + 0.25 * F.col("legacy"), 6).alias("confidence"))


@query("""with c as (select l_linenumber as g, l_returnflag = 'R' as intent_ok, l_quantity > 10 as hit, l_tax > 0.07 as forbidden, l_discount as ms from lineitem)
select g, round(avg(intent_ok::int), 6) as intent_accuracy, round(avg(hit::int), 6) as top3_hit, round(avg((not forbidden)::int), 6) as avoided,
  avg(intent_ok::int) >= 0.2 and avg(hit::int) >= 0.7 as gate from c group by g""")
def agg_retrieval_gate(spark, sf_dir):
    yes = lambda c: F.avg(c.cast("int"))
    intent, hit = yes(F.col("l_returnflag") == "R"), yes(F.col("l_quantity") > 10)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("g"))
    return rows.agg(F.round(intent, 6).alias("intent_accuracy"), F.round(hit, 6).alias("top3_hit"), F.round(yes(~(F.col("l_tax") > 0.07)), 6).alias("avoided"), ((intent >= 0.2) & (hit >= 0.7)).alias("gate"))


@query("""select event_type, count(*)::bigint as cases, count(case when value > 50 then 1 end)::bigint as passed, count(case when value <= 10 then 1 end)::bigint as warnings, count(case when value is null then 1 end)::bigint as errors, round(avg(value), 6) as mean_latency from events group by event_type""")
def agg_live_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    return rows.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("value") > 50).alias("passed"), F.count_if(F.col("value") <= 10).alias("warnings"), F.count_if(F.col("value").isNull()).alias("errors"), F.round(F.avg("value"), 6).alias("mean_latency"))


@query("""with d as (select doc_id, lang, length(text) as n, sha256(text) as h from documents), o as (select lang, h, min(doc_id) as owner from d group by all)
select lang, count(*)::bigint as attempted, count(case when n >= 120 then 1 end)::bigint as valid, count(case when n < 120 then 1 end)::bigint as failed, count(case when owner < doc_id then 1 end)::bigint as duplicates from d join o using (lang, h) group by lang""")
def snk_rescrape_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"), F.sha2("text", 256).alias("h"))
    rows = C.first_owner(rows, ["lang", "h"], "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("n") >= 120).alias("valid"), F.count_if(F.col("n") < 120).alias("failed"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"))


CITED = """with r as (select o_custkey as q, o_orderkey as id, o_totalprice / 500000 as score, o_orderpriority like '%U%' as phrase, o_orderstatus as cat from orders)"""


@query(CITED + """, k as (select *, row_number() over (partition by q order by round_even(score / 0.02, 0) desc, phrase desc, cat = 'F' desc, score desc, id) as rank from r) select q, id, rank::int as rank from k where rank <= 5""")
def rnk_citation_key(spark, sf_dir):
    from corpusloom.operators import ranking as R

    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("score"), F.col("o_orderpriority").contains("U").alias("phrase"), (F.col("o_orderstatus") == "F").alias("category"))
    keys = R.citation_key(F.col("score"), F.col("phrase"), F.lit(0.0), F.lit(0.0), F.col("category"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*keys, F.desc("score"), "id")))
    return ranked.where("rank <= 5").select("q", "id", "rank")


@query(CITED + """, f as (select *, least(1.0, score + 0.35 * phrase::int) as s from r where score >= 0.05), u as (select *, row_number() over (partition by q, cat order by s desc, id) as r1 from f),
p as (select *, row_number() over (partition by q order by s desc, id) as rank from u where r1 = 1) select q, id, round(s, 8) as s, rank::int as rank from p where rank <= 20""")
def rnk_citation_pool(spark, sf_dir):
    """Quality filter, overlap boost, one row for each place, the best twenty."""
    from corpusloom.operators import ranking as R

    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("score"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("url"))
    rows = rows.where("score >= 0.05").withColumn("s", R.overlap_boost(F.col("score"), F.array(F.lit("u")), F.col("text")))
    return R.citation_pool(rows, "q", "url", "s", "id", 20).select("q", "id", F.round("s", 8).alias("s"), "rank")


@query("""with c as (select p_brand as q, p_partkey as id, p_type as url, case when p_name like '%green%' then 100 when p_name like '%red%' then 80 when p_size > 40 then 40 else 0 end as pr, p_retailprice as price from part where p_size <> 13),
u as (select *, row_number() over (partition by q, url order by pr desc, price desc, id) as r1 from c), r as (select *, row_number() over (partition by q order by pr desc, price desc, id) as rank from u where r1 = 1)
select q, id, pr as priority, rank::int as rank from r where rank <= 5""")
def rnk_card_citations(spark, sf_dir):
    from corpusloom.operators import ranking as R

    rows = table(spark, sf_dir, "part").where("p_size <> 13").select(F.col("p_brand").alias("q"), F.col("p_partkey").alias("id"), F.col("p_type").alias("url"), "p_name", "p_size", "p_retailprice")
    rows = rows.withColumn("priority", F.when(F.col("p_name").contains("green"), 100).when(F.col("p_name").contains("red"), 80).when(F.col("p_size") > 40, 40).otherwise(0))
    return R.citation_pool(rows, "q", "url", "priority", "id", 5, F.desc("p_retailprice")).select("q", "id", "priority", "rank")


@query(f"""with near as ({registry.sql_of("dup_near_shingles")}), s as (select doc_id, len(regexp_extract_all(text, '[^ \t\n]+')) as w from documents),
p as (select a as i, b as j, case when x.w >= y.w then a else b end as canonical, case when x.w >= y.w then b else a end as duplicate from near join s x on x.doc_id = a join s y on y.doc_id = b)
select duplicate, arg_min(canonical, i * 1000000000 + j) as duplicate_of from p group by duplicate""")
def win_near_owner(spark, sf_dir):
    """Of each pair of near copies the longer one owns the other."""
    rows = table(spark, sf_dir, "documents")
    pairs = C.near_duplicates(rows, "doc_id", "lang", F.col("text"))
    words = rows.select("doc_id", F.regexp_count("text", F.lit("[^ \t\n]+")).alias("w"))
    one, two = words.toDF("a", "wa"), words.toDF("b", "wb")
    return C.near_owner(pairs.join(one, "a").join(two, "b"), "a", "b", F.col("wa") >= F.col("wb"))


@query("""with c as (select conv_id, turn, text, min(turn) over (partition by conv_id) as parent from conversations)
select c.conv_id, c.turn, p.text as parent_text from c left join conversations p on p.conv_id = c.conv_id and p.turn = c.parent and c.turn <> c.parent""")
def jon_parent(spark, sf_dir):
    """Children with their parent's text; a parent has none."""
    conv = conversations(spark, sf_dir)
    first = conv.groupBy(F.col("conv_id").alias("c")).agg(F.min("turn").alias("parent"))
    kids = conv.join(first, F.col("conv_id") == F.col("c")).select("conv_id", "turn", F.when(F.col("turn") != F.col("parent"), F.col("parent")).alias("parent"))
    return C.with_parent(kids, conv, ["conv_id"], "parent", "turn", "text")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
f as (select doc_id, case when line like 'The%' then 1 when line like 'Ein%' then 2 when line like '%|%' then 3 end as o, min(pos) as pos from l group by doc_id, o),
v as (select f.doc_id, o, line from f join l using (doc_id, pos) where o is not null)
select doc_id, string_agg('- ' || line, chr(10) order by o) as answer from v group by doc_id""")
def ans_product_detail(spark, sf_dir):
    """The first line of each wanted field, as bullets in the fields' order."""
    fields = ["^The", "^Ein", r"\|"]
    lines = F.split(F.col("text"), "\n")

    def bullet(own, pattern, taken):
        # a line belongs to the first field that it fits
        fits = lambda x: x.rlike(pattern) & ~(x.rlike("|".join(taken)) if taken else F.lit(False))
        return F.get(F.filter(own, fits), 0)

    found = T.let(lines, lambda own: F.filter(F.array(*[bullet(own, f, fields[:i]) for i, f in enumerate(fields)]), lambda x: x.isNotNull()))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("v")).where("size(v) > 0")
    return rows.select("doc_id", F.array_join(F.transform("v", lambda x: F.concat(F.lit("- "), x)), "\n").alias("answer"))
