"""Samples, caps, splits, joins and set operations on the corpus tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import sampling as sp
from corpusloom.operators.jsonld import excluded_domains
from corpusloom.plans.base import LOWER, WORDS, Registry, hash_int, r6, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
ORDER = "md5('0|' || {0}::varchar), {0}"
DOC = ORDER.format("doc_id")


@R.query(f"select doc_id, lang, source from documents qualify row_number() over (partition by lang, source order by {DOC}) <= 5")
def cap_per_cell(spark, d):
    return sp.cap(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 5, "doc_id")


@R.query(f"with a as (select doc_id, lang, domain from documents qualify row_number() over (partition by lang, domain order by {DOC}) <= 3) select * from a qualify row_number() over (partition by lang order by {DOC}) <= 50")
def two_level_cap(spark, d):
    return sp.two_level_cap(table(spark, d, "documents").select("doc_id", "lang", "domain"), ["lang", "domain"], 3, ["lang"], 50, "doc_id")


@R.query(f"with u as (select distinct doc_id, lang, label_origin from unified_test) select doc_id, lang from u qualify row_number() over (partition by lang order by case when label_origin like 'human%' then 1 when label_origin like '%category' then 2 else 3 end, {DOC}) <= 20")
def priority_cap(spark, d):
    o = F.col("label_origin")
    p = F.when(F.startswith(o, F.lit("human")), 1).when(F.endswith(o, F.lit("category")), 2).otherwise(3)
    return sp.priority_cap(table(spark, d, "unified_test").select("doc_id", "lang", "label_origin").distinct(), ["lang"], p, 20, "doc_id").select("doc_id", "lang")


@R.query(f"with k as (select doc_id, domain from documents where domain is not null and domain not in ('', 'unknown') qualify row_number() over (partition by domain order by {DOC}) <= 5) select * from k union all select doc_id, domain from documents where domain is null or domain in ('', 'unknown')")
def cap_known_domains(spark, d):
    return sp.cap_known(table(spark, d, "documents").select("doc_id", "domain"), "domain", 5, "doc_id")


@R.query("select doc_id, key from (select doc_id, md5(substr(regexp_replace(" + LOWER.format("text") + r", '[^\p{L}\p{N}_]+', '', 'g'), 1, 2000)) as key from documents where text is not null) qualify row_number() over (partition by key order by " + DOC + ") = 1")
def exact_dedup(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", tx.dup_key("text").alias("key"))
    return sp.keep_first(docs, ["key"], [sp.hash_order("0", "doc_id"), F.col("doc_id")])


@R.query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1")
def keep_last_log(spark, d):
    return sp.keep_first(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id").desc()])


@R.query(f"select doc_id, domain, row_number() over (partition by domain order by {DOC}) as turn from documents")
def round_robin(spark, d):
    return sp.round_robin(table(spark, d, "documents").select("doc_id", "domain"), "domain", "doc_id")


@R.query("with s as (select lang, domain, count(*) as n from documents where lang is not null group by 1, 2), w as (select *, coalesce(sum(n) over (partition by lang order by md5('0|' || domain), domain rows between unbounded preceding and 1 preceding), 0)::bigint as before, floor(sum(n) over (partition by lang) * 0.2)::bigint as target, count(*) over (partition by lang) as c from s) select lang, domain, n, before, target, before < target and c >= 3 as held_out from w")
def domain_split(spark, d):
    s = table(spark, d, "documents").where("lang is not null").groupBy("lang", "domain").agg(F.count(F.lit(1)).alias("n"))
    return sp.hold_out_groups(s, "lang", "domain", "n", 0.2)


@R.query(f"with t as (select domain, count(distinct article_id) as had from articles where split = 'train' group by 1), r as (select d.doc_id, d.domain, d.lang, row_number() over (partition by d.domain order by {ORDER.format('d.doc_id')}) + coalesce(had, 0) as k from documents d left join t on t.domain = d.domain) select doc_id, domain, lang from r where k <= 40 qualify row_number() over (partition by lang order by {DOC}) <= 100")
def expand_corpus(spark, d):
    had = table(spark, d, "articles").where("split = 'train'").groupBy("domain").agg(F.count_distinct("article_id").alias("had"))
    return sp.cap_with_start(table(spark, d, "documents").select("doc_id", "domain", "lang"), had, "domain", "had", 40, "lang", 100, "doc_id")


@R.query(f"select doc_id, printf('u%05d', row_number() over (order by {DOC}) - 1) as uid from documents")
def sequential_ids(spark, d):
    return sp.sequential_ids(table(spark, d, "documents").select("doc_id"), "doc_id", "uid")


@R.query(f"select doc_id, lang, row_number() over (partition by lang order by {DOC}) <= floor(count(*) over (partition by lang) * 0.03) as is_validation from documents")
def train_val_split(spark, d):
    return sp.permutation_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", 0.03, "doc_id")


@R.query("with t as (select *, row_number() over (order by md5('0|' || value_id::varchar), value_id) - 1 as i from (select distinct value_id from section_values) order by i limit 500), m as (select *, count(*) over () as m from t), g as (select value_id, r * m + i as place from m, range(0, 500) as x(r) where r * m + i < 500) select * from g")
def repeat_to_size(spark, d):
    return sp.repeat_to(table(spark, d, "section_values").select("value_id").distinct(), 500, "value_id").select("value_id", F.col("place").cast("bigint").alias("place"))


@R.query("with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events) select user_id, event_id from r where n <= 4 or list_contains(list_transform(range(0, 4), lambda k: floor(k * (n / 4.0) + n / 8.0)::bigint), i)")
def even_spaced_pick(spark, d):
    return sp.even_pick(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 4)


@R.query("select strftime(m, '%Y-%m') as month, count(event_id) as n from (select unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), interval 1 month)) as m from events) left join events on date_trunc('month', ts) = m group by 1")
def month_range(spark, d):
    e = table(spark, d, "events")
    first = lambda f: F.trunc(f("ts").cast("date"), "month")
    months = e.agg(first(F.min).alias("a"), first(F.max).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    n = e.groupBy(F.trunc(F.col("ts").cast("date"), "month").alias("m")).agg(F.count("event_id").alias("n"))
    return months.join(n, "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


@R.query("select doc_id from documents qualify (row_number() over (order by doc_id) - 1) % 4 = 1")
def work_stride(spark, d):
    return sp.by_place(table(spark, d, "documents").select("doc_id"), "doc_id", "p").where(F.pmod("p", F.lit(4)) == 1).select("doc_id")


@R.query(f"select ((row_number() over (partition by lang order by {DOC}) - 1) // 40)::int as batch, lang, doc_id, md5(substr(text, 1, 3000)) as cut from documents")
def batch_files(spark, d):
    docs = sp.ranked(table(spark, d, "documents").select("doc_id", "lang", "text"), "lang", "doc_id", "n").drop("_total")
    return docs.select(F.floor((F.col("n") - 1) / 40).cast("int").alias("batch"), "lang", "doc_id", F.md5(F.substring("text", 1, 3000)).alias("cut"))


# --- joins and set operations ---


@R.query(f"with m as (select distinct doc_id, label, sha1(array_to_string({WORDS.format('text')}, ' ')) as h from unified_test), a as (select distinct sha1(array_to_string({WORDS.format('text')}, ' ')) as h from documents where text is not null) select label, count(*) as n, count(a.h) as matched, round(count(a.h) / count(*), 6) as rate from m left join a on a.h = m.h group by 1")
def manifest_verify(spark, d):
    m = table(spark, d, "unified_test").select("doc_id", "label", tx.collapsed_sha1("text").alias("h")).distinct()
    a = table(spark, d, "documents").where("text is not null").select(tx.collapsed_sha1("text").alias("h")).distinct().withColumn("hit", F.lit(1))
    return m.join(a, "h", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("matched"), r6(F.count("hit") / F.count(F.lit(1))).alias("rate"))


@R.query("select a.article_id, a.domain not in (select domain from documents where domain is not null) as site_unseen from (select distinct article_id, domain from articles where split = 'heldout') a")
def unseen_sites(spark, d):
    seen = table(spark, d, "documents").select("domain").where("domain is not null").distinct().withColumn("seen", F.lit(True))
    a = table(spark, d, "articles").where("split = 'heldout'").select("article_id", "domain").distinct()
    return a.join(seen, "domain", "left").select("article_id", F.col("seen").isNull().alias("site_unseen"))


@R.query("with x as (select distinct domain from unified_test where domain is not null), c as (select domain from x union select regexp_replace(domain, '^www\\.', '') from x union select 'www.' || regexp_replace(domain, '^www\\.', '') from x) select domain, count(*) as n from documents where domain not in (select domain from c) group by 1")
def excluded_domains_www(spark, d):
    x = excluded_domains(table(spark, d, "unified_test"))
    return table(spark, d, "documents").where("domain is not null").join(x, "domain", "left_anti").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@R.query("select doc_id from documents d where url is not null and not exists (select 1 from unified_test u where u.url = d.url)")
def not_in_test_by_url(spark, d):
    u = table(spark, d, "unified_test").select("url").where("url is not null").distinct()
    return table(spark, d, "documents").where("url is not null").join(u, "url", "left_anti").select("doc_id")


@R.query("select doc_id from documents d where text is not null and domain not in (select domain from articles where split = 'heldout') and substr(text, 1, 300) not in (select substr(text, 1, 300) from articles where text is not null)")
def unseen_prefix_and_domain(spark, d):
    a = table(spark, d, "articles")
    dom = a.where("split = 'heldout'").select("domain").distinct()
    pre = a.where("text is not null").select(F.md5(tx.prefix_key("text")).alias("k")).distinct()
    docs = table(spark, d, "documents").where("text is not null and domain is not null").withColumn("k", F.md5(tx.prefix_key("text")))
    return docs.join(dom, "domain", "left_anti").join(pre, "k", "left_anti").select("doc_id")


@R.query("select user_id, event_type from (select distinct user_id, event_type from events) where (user_id, event_type) not in (select distinct user_id, event_type from events where value > 50)")
def resume_antijoin(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_type").distinct().join(e.where("value > 50").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_anti")


@R.query("select domain from documents intersect select domain from articles")
def shared_sites(spark, d):
    return table(spark, d, "documents").select("domain").intersect(table(spark, d, "articles").select("domain"))


@R.query("select lang, source, count(*) as n from (select lang, source from documents union all select lang, source from articles union all select lang, source from unified_test) group by 1, 2")
def pool_union(spark, d):
    a, b, c = (table(spark, d, t).select("lang", "source") for t in ("documents", "articles", "unified_test"))
    return a.unionByName(b).unionByName(c).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@R.query("with m as (select event_type as model, user_id % 7 as grp, avg(value) as v from events group by 1, 2), r as (select model, avg(v) as a, max(v) as b from m group by 1) select x.model as model_a, y.model as model_b from r x join r y on x.model < y.model and sign(x.a - y.a) <> sign(x.b - y.b)")
def model_pair_swaps(spark, d):
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("model"), F.pmod("user_id", F.lit(7)).alias("grp")).agg(F.avg("value").alias("v"))
    r = m.groupBy("model").agg(F.avg("v").alias("a"), F.max("v").alias("b"))  # one row a model
    x, y = r.alias("x"), r.alias("y")
    return x.join(F.broadcast(y), (F.col("x.model") < F.col("y.model")) & (F.signum(F.col("x.a") - F.col("y.a")) != F.signum(F.col("x.b") - F.col("y.b")))).select(F.col("x.model").alias("model_a"), F.col("y.model").alias("model_b"))


@R.query("with s as (select distinct n_regionkey::int as k from nation) select a.k as a, b.k as b, c.k as c from s a join s b on a.k < b.k join s c on b.k < c.k")
def seed_combinations(spark, d):
    s = table(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("k")).distinct()
    a, b, c = s.toDF("a"), s.toDF("b"), s.toDF("c")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).join(F.broadcast(c), F.col("b") < F.col("c"))


@R.query("with g as (select r_name as model, n as grid from region, range(0, 3) as x(n)) select model, grid::bigint as grid from g")
def grid_product(spark, d):
    return table(spark, d, "region").select(F.col("r_name").alias("model")).crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "grid")))


@R.query(f"select split, count(*) as n, count(distinct doc_id) as ids from (select doc_id, case when {{0}} % 100 < 3 then 'validation' else 'train' end as split from documents) group by 1".format("('0x' || substr(md5('split|' || doc_id), 1, 8))::bigint"))
def hashed_split(spark, d):
    h = hash_int(F.concat(F.lit("split|"), F.col("doc_id").cast("string"))) % 100
    return table(spark, d, "documents").groupBy(F.when(h < 3, "validation").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"))
