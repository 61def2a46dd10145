"""Contamination, duplicates, taxonomy, page metadata and the composite corpus builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import builders as bd
from corpusloom.operators import contamination as ct
from corpusloom.operators import dedup as dd
from corpusloom.operators import jsonld as jl
from corpusloom.operators import metrics as mt
from corpusloom.operators import sampling as sp
from corpusloom.operators import taxonomy as tn
from corpusloom.plans.base import LOWER, TOKENS, Registry, hash_int, r6, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
NS = "lang in ('zh', 'ja')"


def _items_sql(src: str, ident: str, n: int = 8, c: int = 16) -> str:
    """(id, gram) of word n-grams, of character c-grams in zh and ja."""
    t = f"case when coalesce({NS}, false) then regexp_split_to_array(regexp_replace({LOWER.format('text')}, '[ \\t\\n\\r\\f\\v]+', '', 'g'), '') else {TOKENS.format('text')} end"
    return f"select distinct id, array_to_string(t[i:i + n - 1], ' ') as gram from (select id, t, n, unnest(range(1, len(t) - n + 2)) as i from (select {ident} as id, {t} as t, case when coalesce({NS}, false) then {c} else {n} end as n from {src} where text is not null) where len(t) >= n)"


OVER = f"dg as ({_items_sql('documents', 'doc_id')}), rg as (select distinct gram from ({_items_sql('unified_test', 'doc_id')})), ov as (select d.doc_id, count(g.gram) as n_grams, coalesce(count(r.gram) / nullif(count(g.gram), 0)::double, 0) as overlap from documents d left join dg g on g.id = d.doc_id left join rg r on r.gram = g.gram group by 1)"


@R.query(f"with {OVER} select doc_id, n_grams, round(overlap, 6) as overlap from ov")
def contamination_overlap(spark, d):
    o = ct.overlap(table(spark, d, "documents"), table(spark, d, "unified_test"), "doc_id", "doc_id")
    return o.select("doc_id", "n_grams", r6("overlap").alias("overlap"))


@R.query(f"with {OVER} select doc_id from ov where overlap < 0.3")
def contamination_filter(spark, d):
    return ct.overlap(table(spark, d, "documents"), table(spark, d, "unified_test"), "doc_id", "doc_id").where("overlap < 0.3").select("doc_id")


@R.query()
def near_dup_pairs(spark, d):
    return dd.near_pairs(table(spark, d, "documents"), "doc_id").select("a", "b", r6("jaccard").alias("jaccard"))


@R.query()
def near_dup_keep(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), sp.hash_order("0", "doc_id").alias("rank"))
    return dd.greedy_keep(docs, dd.near_pairs(table(spark, d, "documents"), "doc_id")).select(F.col("id").alias("doc_id"), "kept")


MODEL_P = "case when ('0x' || substr(md5('a|keep|' || doc_id), 1, 8))::bigint % 100 < 80 then y else (('0x' || substr(md5('a|label|' || doc_id), 1, 8))::bigint % 17)::int end"


@R.query(f"with {OVER}, k as (select d.doc_id, d.lang, d.source, d.gpt_label_id as y, md5(substr(regexp_replace({LOWER.format('text')}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g'), 1, 2000)) as key from documents d join ov using (doc_id) where text is not null and overlap < 0.3), u as (select * from k qualify row_number() over (partition by key order by md5('0|' || doc_id), doc_id) = 1), c as (select * from u qualify row_number() over (partition by lang, source order by md5('0|' || doc_id), doc_id) <= 5), q as (select lang, y, {MODEL_P} as p from c where y >= 0), n as (select lang, y, p, count(*) as n from q group by 1, 2, 3), l as (select lang, label, sum(s) as s, sum(q) as q, sum(t) as t from (select lang, y as label, n as s, 0 as q, case when y = p then n else 0 end as t from n union all select lang, p, 0, n, 0 from n) group by 1, 2), m as (select lang, avg(2.0 * t / (s + q)) as f from l where s > 0 group by 1), a as (select lang, sum(n)::bigint as n, sum(case when y = p then n else 0 end) / sum(n)::double as acc from n group by 1) select a.lang, a.n, round(acc, 6) as accuracy, round(f, 6) as macro_f1 from a join m on a.lang is not distinct from m.lang")
def minimum_slice(spark, d):
    """Contamination filter, exact duplicates, cap of 5 a cell and macro-F1 by language."""
    docs = table(spark, d, "documents")
    clean = ct.overlap(docs, table(spark, d, "unified_test"), "doc_id", "doc_id").where("overlap < 0.3").select("doc_id")
    k = docs.where("text is not null").join(clean, "doc_id").select("doc_id", "lang", "source", F.col("gpt_label_id").alias("y"), tx.dup_key("text").alias("key"))
    u = sp.keep_first(k, ["key"], [sp.hash_order("0", "doc_id"), F.col("doc_id")])
    c = sp.cap(u, ["lang", "source"], 5, "doc_id").where("y >= 0")
    h = lambda salt: hash_int(F.concat(F.lit(f"a|{salt}|"), F.col("doc_id").cast("string")))
    p = c.withColumn("p", F.when(h("keep") % 100 < 80, F.col("y")).otherwise((h("label") % 17).cast("int")))
    s = mt.scores(mt.confusion_counts(p, groups=["lang"]), ["lang"])
    return s.select("lang", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


# --- taxonomy ---

TERMS = "terms as (select case when label not like '(%' then label end as label, iptc_node_id as node, trim(unnest(string_split(section_names, '; '))) as term from mapping_table)"
#: What NFKC and the library's lower case do to the names of the test tables, in SQL: full-width forms, ideographic and no-break spaces, final sigma.
_FROM, _TO = ("".join(map(chr, codes)).replace("'", "''").replace("{", "{{").replace("}", "}}") for codes in ([*range(0xFF01, 0xFF5F), 0x3000, 0xA0], [*range(0x21, 0x7F), 0x20, 0x20]))
LOW = f"lower(replace(translate(nfc_normalize({{0}}), '{_FROM}', '{_TO}'), 'İ', 'i̇'))"
SIGMA = "regexp_replace(" + LOW + r", '(\p{{L}})σ([^\p{{L}}]|$)', '\1ς\2', 'g')"
SIGNS = r"regexp_replace(replace(replace(trim(" + SIGMA + r"), '&amp;', '&'), '’', ''''), '[\"“”«»()\[\]|/\\]+', ' ', 'g')"
NORM = "replace(trim(regexp_replace(" + SIGNS + r", '[ \t\n\r\f\v]+', ' ', 'g'), ' -–—:·.,'), chr(775), '')"


@R.query(f"select distinct value_id, {NORM.format('section_name')} as name from section_values")
def normalise_section(spark, d):
    return table(spark, d, "section_values").select("value_id", tn.normalise("section_name").alias("name")).distinct()


@R.query(f"with {TERMS}, v as (select distinct value_id, {NORM.format('section_name')} as s from section_values), k as (select term, min(label) as label from terms where label is not null group by 1), x as (select value_id, case when length(s) between 1 and 40 then s end as s, trim(regexp_replace(case when length(s) between 1 and 40 then s end, '{tn.AFFIX}', ' ', 'g')) as a from v) select value_id, coalesce(e.label, case when x.a <> x.s then f.label end) as label from x left join k e on e.term = x.s left join k f on f.term = x.a")
def map_section(spark, d):
    v = table(spark, d, "section_values").select("value_id", "section_name", "lang").dropDuplicates(["value_id"])
    return tn.map_sections(v, tn.term_table(table(spark, d, "mapping_table")), None, "section_name", "lang").select("value_id", "label")


@R.query(f"with {TERMS} select 'mapped twice' as problem, term from terms where label is not null group by term having count(distinct label) > 1 union all select distinct 'ambiguous and mapped', term from terms where label is null and term in (select term from terms where label is not null) union all select distinct 'not normalised', term from terms where term <> {NORM.format('term')}")
def validate_terms(spark, d):
    return tn.validate_terms(tn.term_table(table(spark, d, "mapping_table")))


TREE = [(1, "sport", None), (2, "team sport", 1), (3, "football", 2), (4, "politics", None), (5, "election", 4)]


@R.query("with recursive t(id, name, parent) as (values " + ", ".join(f"({i}, '{n}', {p or 'null'})" for i, n, p in TREE) + "), w as (select id, name as path, 1 as depth from t where parent is null union all select t.id, w.path || ' > ' || t.name, depth + 1 from t join w on t.parent = w.id) select id::bigint as id, path, depth from w")
def tree_path(spark, d):
    return tn.tree_paths(spark.createDataFrame(TREE, "id bigint, name string, parent bigint"))


@R.query("select 1::bigint as id, 'sport' as label, 'section' as reason union all select 2, null, 'conflict' union all select 3, null, 'unmapped' union all select 4, null, 'rejected_term' union all select 5, null, 'unmapped' union all select 6, 'sport', 'section' union all select 7, null, 'unmapped' union all select 8, 'health', 'section' union all select 9, 'sport', 'breadcrumb'")
def label_article(spark, d):
    """Fixed cases: section only, conflict, unmapped, reject term in the home crumb, null override, affix, empty, override."""
    rows = [(1, ["sport"], [], "en"), (2, ["sport"], ["home", "trade unions"], "en"), (3, ["whatever"], ["sport"], "en"), (4, ["sport"], ["horoscope"], "en"), (5, ["sport"], [], "xx"), (6, ["latest sport"], ["home", "sport"], "en"), (7, [], [], "en"), (8, ["sport"], [], "yy"), (9, ["whatever"], ["home", "Ｓｐｏｒｔ"], "en")]
    a = spark.createDataFrame(rows, "id bigint, sections array<string>, breadcrumb array<string>, lang string")
    over = spark.createDataFrame([("xx", "sport", None), ("yy", "sport", "health")], "lang string, term string, label string")
    return tn.label_articles(a, tn.term_table(table(spark, d, "mapping_table")), "id", "sections", "breadcrumb", "lang", over)


# --- page metadata ---


def pages_with_json(spark, d):
    """Pages made from extracted_pages: their record as a JSON-LD script, one in five with a trailing comma, one in seven broken."""
    p = table(spark, d, "extracted_pages").dropDuplicates(["page_id"])
    obj = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), "headline", F.struct(F.lit("Organization").alias("@type"), F.col("publisher").alias("name")).alias("publisher"), F.from_json("article_section", "array<string>").alias("articleSection"), F.col("in_language").alias("inLanguage"), F.col("canonical").alias("url")))
    crumb = F.lit('{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"World"},{"position":"1","item":{"name":"Home"}},{"name":"Last"}]}')
    text = F.concat(F.lit('{"@graph":['), obj, F.lit(","), crumb, F.when(F.col("page_id") % 5 == 0, F.lit(",]}")).otherwise(F.lit("]}")), F.when(F.col("page_id") % 7 == 0, F.lit("}}")).otherwise(F.lit("")))
    return p.select("page_id", "url", F.concat(F.lit("<html><head><script type=\"application/ld+json\">"), text, F.lit("</script></head></html>")).alias("html"))


PAGES = "p as (select * from extracted_pages qualify row_number() over (partition by page_id) = 1)"


@R.query(f"with {PAGES} select page_id, 1 as n_blocks from p")
def jsonld_blocks(spark, d):
    return pages_with_json(spark, d).select("page_id", F.size(jl.blocks("html")).alias("n_blocks"))


@R.query(f"with {PAGES} select page_id, case when trim(headline) <> '' then trim(headline) end as headline, case when trim(publisher) <> '' then trim(publisher) end as publisher, coalesce(canonical, url) as canonical, 'newsarticle' as types, 'Home / World / Last' as breadcrumb from p where page_id % 7 <> 0")
def jsonld_articles(spark, d):
    a = jl.extract_articles(pages_with_json(spark, d))
    return a.select("page_id", "headline", "publisher", "canonical", F.array_join("types", ",").alias("types"), F.array_join("breadcrumb", " / ").alias("breadcrumb"))


@R.query()
def page_extraction(spark, d):
    """Pages to article rows: sites of the training split left out, bodies or main texts, one row a URL and canonical URL."""
    p = pages_with_json(spark, d).join(table(spark, d, "extracted_pages").groupBy("page_id").agg(F.min("text").alias("body")), "page_id")
    para = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", "&", "&amp;"), "<", "&lt;"), r"\n+", "</p><p>")
    html = F.concat("html", F.lit("<body><nav><a href='/'>Home</a></nav><article><p>"), para, F.lit("</p></article><footer>Contact</footer></body>"))
    seen = table(spark, d, "articles").where("split = 'train'").select("domain").distinct()
    out = jl.extract_pages(p.select("page_id", "url", html.alias("html")), seen)
    return out.groupBy("lang", "text_source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("sites"), r6(F.avg("n_words")).alias("words"))


@R.query(f"with {PAGES} select page_id, len(from_json(author, '[\"VARCHAR\"]')[1:5]) as authors, array_to_string(from_json(keywords, '[\"VARCHAR\"]')[1:30], '|') as keywords from p where json_valid(author) and json_valid(keywords)")
def list_cap(spark, d):
    p = table(spark, d, "extracted_pages").dropDuplicates(["page_id"])
    cap = lambda c, n: F.slice(F.from_json(c, "array<string>"), 1, n)
    return p.where("author is not null and keywords is not null").select("page_id", F.size(cap("author", jl.MOST_AUTHORS)).alias("authors"), F.array_join(cap("keywords", jl.MOST_KEYWORDS), "|").alias("keywords"))


@R.query("select distinct page_id, case when coalesce(n_words, 0) < 30 then coalesce(headline, '') else md5(text) end as body, case when coalesce(n_words, 0) < 30 then 'fallback' else text_source end as text_source from extracted_pages")
def main_text_fallback(spark, d):
    short = F.coalesce("n_words", F.lit(0)) < 30
    return table(spark, d, "extracted_pages").select("page_id", F.when(short, F.coalesce("headline", F.lit(""))).otherwise(F.md5("text")).alias("body"), F.when(short, F.lit("fallback")).otherwise(F.col("text_source")).alias("text_source")).distinct()


@R.query(f"with {TERMS}, {PAGES}, s as (select page_id, lang, domain, is_free, n_words, text, {NORM.format('x.name')} as name from (select *, unnest(from_json(article_section, '[\"VARCHAR\"]')) as name from p where json_valid(article_section)) x), k as (select term, min(label) as label from terms where label is not null group by 1), l as (select page_id, lang, domain, is_free, n_words, text, min(k.label) as label, count(distinct k.label) as n from s left join k on k.term = s.name group by all), f as (select * from l where n = 1 and coalesce(lower(is_free::varchar), '') not in ('false', '0') and n_words >= 75), c as (select * from f qualify row_number() over (partition by lang, label, domain order by md5('0|' || page_id), page_id) <= 5), t as (select * from c qualify row_number() over (partition by lang, label order by md5('0|' || page_id), page_id) <= 50) select label, count(*) as n, count(distinct domain) as sites, count(distinct lang) as langs from t group by 1")
def silver_sample(spark, d):
    """Pages labelled by section, filtered and capped by site and cell."""
    p = table(spark, d, "extracted_pages").dropDuplicates(["page_id"])
    s = p.select("page_id", "lang", "domain", "is_free", "n_words", F.explode(F.from_json("article_section", "array<string>")).alias("name"))
    known = tn.term_table(table(spark, d, "mapping_table")).where("label is not null").groupBy("term").agg(F.min("label").alias("label"))
    m = s.withColumn("term", tn.normalise("name")).join(F.broadcast(known), "term", "left")
    lab = m.groupBy("page_id", "lang", "domain", "is_free", "n_words").agg(F.min("label").alias("label"), F.count_distinct("label").alias("n"))
    f = lab.where((F.col("n") == 1) & ~F.coalesce(F.lower(F.col("is_free").cast("string")), F.lit("")).isin("false", "0") & (F.col("n_words") >= 75))
    t = sp.two_level_cap(f, ["lang", "label", "domain"], 5, ["lang", "label"], 50, "page_id")
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("sites"), F.count_distinct("lang").alias("langs"))


def _silver(spark, d):
    train = table(spark, d, "articles").where("split = 'train' and text is not null")
    return bd.silver_pool(table(spark, d, "extracted_pages"), tn.term_table(table(spark, d, "mapping_table")), train, "article_id", train.select("domain").where("domain <> 'unknown'"))


@R.query()
def silver_funnel(spark, d):
    """Pages left after each step of the silver builder."""
    return _silver(spark, d)[1]


@R.query()
def silver_pool(spark, d):
    """The silver builder's pool by language and label."""
    return _silver(spark, d)[0].groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("sites"), F.max("train_overlap").alias("most_overlap"))


@R.query("with u as (select 'test' as pool, doc_id, lang, source, label_id, url, domain, 1 as prio from (select distinct doc_id, lang, source, label_id, url, domain from unified_test) union all select 'pool', article_id::varchar, lang, source, gpt_label_id, url, domain, 2 from (select distinct article_id, lang, source, gpt_label_id, url, domain from articles where split = 'test' and gpt_label_id >= 0)), s as (select * from u qualify row_number() over (partition by lang, label_id order by prio, md5('0|' || doc_id), doc_id) <= 10) select pool, lang, count(*) as n, count(distinct domain) as sites from s group by 1, 2")
def unified_sample(spark, d):
    """Heterogeneous sources in one shape, sampled by priority in each cell of language and label."""
    t = table(spark, d, "unified_test").select(F.lit("test").alias("pool"), "doc_id", "lang", "source", "label_id", "url", "domain", F.lit(1).alias("prio")).distinct()
    a = table(spark, d, "articles").where("split = 'test' and gpt_label_id >= 0").select(F.lit("pool").alias("pool"), F.col("article_id").cast("string").alias("doc_id"), "lang", "source", F.col("gpt_label_id").alias("label_id"), "url", "domain", F.lit(2).alias("prio")).distinct()
    s = sp.priority_cap(t.unionByName(a), ["lang", "label_id"], F.col("prio"), 10, "doc_id")
    return s.groupBy("pool", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("sites"))


@R.query(f"with {TERMS}, v as (select distinct value_id, {NORM.format('section_name')} as s from section_values), c as (select s, count(*) as uses, list(value_id order by value_id)[1:3] as ids from v group by 1) select t.label, t.term, coalesce(uses, 0) as uses, coalesce(array_to_string(ids, ','), '') as examples, t.term = lower(t.label) or t.term || 's' = lower(t.label) as auto_ok from terms t left join c on c.s = t.term where t.label is not null")
def mapping_review(spark, d):
    v = table(spark, d, "section_values").select("value_id", tn.normalise("section_name").alias("term")).distinct()
    r = _first3(v)
    t = tn.term_table(table(spark, d, "mapping_table")).where("label is not null")
    return t.join(r, "term", "left").select("label", "term", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("examples", F.lit("")).alias("examples"), ((F.col("term") == F.lower("label")) | (F.concat("term", F.lit("s")) == F.lower("label"))).alias("auto_ok"))


def _first3(v):
    from pyspark.sql import Window

    k = v.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("value_id"))).where("r <= 3")  # pruned before the shuffle
    few = k.groupBy("term").agg(F.array_join(F.array_sort(F.collect_list("value_id")), ",").alias("examples"))
    return v.groupBy("term").agg(F.count(F.lit(1)).alias("uses")).join(few, "term")
