"""Composite analysis programs over the pseudo-models and the event log as a metric log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import metrics as mt
from corpusloom.operators import sampling as sp
from corpusloom.operators import stats as st
from corpusloom.operators import vectors as vc
from corpusloom.plans.base import HASH_INT, Registry, hash_int, r6, table
from corpusloom.plans.evaluation import COUNTS, ITEMS, KEEP, LOGITS, PREDS, f1_sql, items, predictions, teacher

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _scores(spark, d, *groups):
    return mt.scores(mt.confusion_counts(predictions(spark, d), groups=list(groups)), list(groups))


@R.query("with p as (select distinct domain from documents where domain is not null), t as (select doc_id, min(domain) as domain from unified_test group by 1) select count(*) as items, count(p.domain) as on_pool_sites, count(distinct t.domain) as sites, count(distinct p.domain) as shared_sites from t left join p on p.domain = t.domain")
def site_overlap_audit(spark, d):
    p = table(spark, d, "documents").select("domain").where("domain is not null").distinct().withColumn("hit", F.col("domain"))
    t = table(spark, d, "unified_test").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    return t.join(p, "domain", "left").agg(F.count(F.lit(1)).alias("items"), F.count("hit").alias("on_pool_sites"), F.count_distinct("domain").alias("sites"), F.count_distinct("hit").alias("shared_sites"))


@R.query("with f as (select *, substr(text, 1, 300) as k from documents where text is not null and lang is not null qualify row_number() over (partition by lang, substr(text, 1, 300) order by md5('0|' || doc_id), doc_id) = 1), c as (select * from f qualify row_number() over (partition by domain order by md5('0|' || doc_id), doc_id) <= 20), s as (select lang, domain, count(*) as n from c group by 1, 2), w as (select *, coalesce(sum(n) over (partition by lang order by md5('0|' || domain), domain rows between unbounded preceding and 1 preceding), 0)::bigint as before, floor(sum(n) over (partition by lang) * 0.2)::bigint as target, count(*) over (partition by lang) as c from s) select lang, sum(n) filter (before < target and c >= 3)::bigint as held_out, sum(n)::bigint as n from w group by 1")
def held_out_builder(spark, d):
    """Prefix duplicates, cap per site, whole sites held out."""
    docs = table(spark, d, "documents").where("text is not null and lang is not null").select("doc_id", "lang", "domain", tx.prefix_key("text").alias("k"))
    f = sp.keep_first(docs, ["lang", "k"], [sp.hash_order("0", "doc_id"), F.col("doc_id")])
    s = sp.cap(f, ["domain"], 20, "doc_id").groupBy("lang", "domain").agg(F.count(F.lit(1)).alias("n"))
    return sp.hold_out_groups(s, "lang", "domain", "n", 0.2).groupBy("lang").agg(F.sum(F.when(F.col("held_out"), F.col("n"))).alias("held_out"), F.sum("n").alias("n"))


@R.query("with s as (select lang, domain, count(distinct doc_id) as n from unified_test group by 1, 2), q as (select *, n / sum(n) over (partition by lang) as q from s), e as (select lang, sum(n) as docs, count(domain) as sites, 1 / sum(q * q) as eff, max(q) as top from q group by 1) select lang, docs::bigint as docs, sites, round(eff, 6) as effective, round(top, 6) as top_share, case when lang in ('en', 'de', 'fr', 'es', 'it', 'pl', 'ca', 'tr', 'id') then 'Latin' when lang = 'ru' then 'Cyrillic' when lang = 'el' then 'Greek' when lang = 'hi' then 'Devanagari' else '?' end as script, case when eff >= 10 then 'high' when eff >= 3 then 'medium' else 'low' end as tier from e")
def language_profile(spark, d):
    s = table(spark, d, "unified_test").groupBy("lang", "domain").agg(F.count_distinct("doc_id").alias("n"))
    q = s.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    e = q.groupBy("lang").agg(F.sum("n").alias("docs"), F.count("domain").alias("sites"), (1 / F.sum(F.col("q") * F.col("q"))).alias("eff"), F.max("q").alias("top"))
    script = F.create_map(*[F.lit(x) for kv in {**dict.fromkeys("en de fr es it pl ca tr id".split(), "Latin"), "ru": "Cyrillic", "el": "Greek", "hi": "Devanagari"}.items() for x in kv])
    return e.select("lang", "docs", "sites", r6("eff").alias("effective"), r6("top").alias("top_share"), F.coalesce(F.try_element_at(script, F.col("lang")), F.lit("?")).alias("script"), F.when(F.col("eff") >= 10, "high").when(F.col("eff") >= 3, "medium").otherwise("low").alias("tier"))


@R.query(f"with {PREDS}, {COUNTS('model')}, {f1_sql('counts', 'model')}, gl as (select lang, model, y, p, count(*) as n from preds where y is not null group by 1, 2, 3, 4), {f1_sql('gl', 'lang, model', 'g')}, gm as (select model, avg(macro_f1) as lang_f1 from g group by 1) select f1.model, n::bigint as n, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1, round(lang_f1, 6) as lang_f1, round(100 * macro_f1 / max(macro_f1) over (), 6) as pct from f1 join gm using (model)")
def main_accuracy_table(spark, d):
    g = _scores(spark, d, "lang", "model").groupBy("model").agg(F.avg("macro_f1").alias("lang_f1"))
    s = _scores(spark, d, "model").join(g, "model")
    return s.select("model", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), r6("lang_f1").alias("lang_f1"), r6(100 * F.col("macro_f1") / F.max("macro_f1").over(Window.partitionBy())).alias("pct"))  # one row a model


PAIRS = [("a", "b"), ("a", "c"), ("b", "c")]


@R.query(f"with {PREDS}, w as (select x.model as m1, z.model as m2, count(*) filter (x.p = x.y and z.p <> z.y) as only_1, count(*) filter (z.p = z.y and x.p <> x.y) as only_2 from preds x join preds z on x.doc_id = z.doc_id and x.model < z.model group by 1, 2), q as (select *, least(1.0, 2 * (select sum(exp(lgamma(only_1 + only_2 + 1) - lgamma(i + 1) - lgamma(only_1 + only_2 - i + 1) - (only_1 + only_2) * ln(2))) from range(0, 20000) r(i) where i <= least(only_1, only_2))) as p from w), s as (select *, (count(*) over () - row_number() over (order by p, m1 || m2) + 1) * p as s from q) select m1, m2, only_1, only_2, round(least(1.0, max(s) over (order by p, m1 || m2 rows unbounded preceding)), 6) as p_holm from s")
def paired_significance_table(spark, d):
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("p")))
    w = predictions(spark, d).groupBy("doc_id", "y").agg(*[one(m).alias(f"p_{m}") for m in KEEP])
    right = {m: F.col(f"p_{m}") == F.col("y") for m in KEEP}
    counts = w.agg(*[F.count_if(right[m] & ~right[n]).alias(f"{m}_{n}") for m in KEEP for n in KEEP if m != n]).first()
    rows = [(m, n, counts[f"{m}_{n}"], counts[f"{n}_{m}"]) for m, n in PAIRS]  # three rows
    rows = [(m, n, x, y, min(1.0, 2 * st.log_binomial_tail(min(x, y), x + y)) if x + y else 1.0, m + n) for m, n, x, y in rows]
    out = st.holm(spark.createDataFrame(rows, "m1 string, m2 string, only_1 bigint, only_2 bigint, p double, id string"))
    return out.select("m1", "m2", "only_1", "only_2", r6("p_holm").alias("p_holm"))


@R.query(f"with {PREDS}, {COUNTS('source, model')}, {f1_sql('counts', 'source, model')}, m as (select source, count(*) as items, count(distinct lang) as langs, count(distinct cluster) as sites from items group by 1) select m.*, " + ", ".join(f"round(max(macro_f1) filter (model = '{x}'), 6) as {x}" for x in KEEP) + " from m left join f1 on f1.source = m.source group by all")
def per_source_table(spark, d):
    m = items(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("lang").alias("langs"), F.count_distinct("cluster").alias("sites"))
    s = _scores(spark, d, "source", "model").groupBy("source").agg(*[r6(F.max(F.when(F.col("model") == x, F.col("macro_f1")))).alias(x) for x in KEEP])
    return m.join(s, "source", "left")


@R.query(f"with {PREDS}, {COUNTS('lang, model')}, {f1_sql('counts', 'lang, model')}, w as (select lang, max(n) as n, max(macro_f1) filter (model = 'a') as a, max(macro_f1) filter (model = 'b') as b from f1 group by 1) select lang, n::bigint as n, round(a - b, 6) as gap from w order by round(a - b, 6) desc, lang limit 5")
def language_gap_top(spark, d):
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("macro_f1")))
    w = _scores(spark, d, "lang", "model").groupBy("lang").agg(F.max("n").alias("n"), r6(one("a") - one("b")).alias("gap"))
    return w.orderBy(F.desc("gap"), "lang").limit(5)


@R.query(f"with {PREDS}, {COUNTS('lang, model')}, {f1_sql('counts', 'lang, model')}, x as (select lang, ln(1 + n) as size, macro_f1 as f from f1 where model = 'a'), r as (select rank() over (order by size) + (count(*) over (partition by size) - 1) / 2.0 as ra, rank() over (order by f) + (count(*) over (partition by f) - 1) / 2.0 as rb from x) select round(corr(ra, rb), 6) as rho, count(*) as n from r")
def factor_test(spark, d):
    x = _scores(spark, d, "lang", "model").where("model = 'a'").select(F.log1p(F.col("n").cast("double")).alias("size"), F.col("macro_f1").alias("f"))
    return st.spearman(x, "size", "f").select(r6("rho").alias("rho"), "n")


TIER = "case when {0} = 'en' then 'high' when {0} in ('es', 'de', 'fr') then 'medium' else 'low' end"


@R.query(f"with {PREDS}, t as (select *, {TIER.format('lang')} as tier from preds), counts as (select tier, model, y, p, count(*) as n from t where y is not null group by 1, 2, 3, 4), {f1_sql('counts', 'tier, model')} select tier, round(avg(macro_f1), 6) as mean, round(stddev_samp(macro_f1), 6) as sd, count(*) as models from f1 group by 1")
def ablation_by_tier(spark, d):
    tier = F.when(F.col("lang") == "en", "high").when(F.col("lang").isin("es", "de", "fr"), "medium").otherwise("low")
    s = mt.scores(mt.confusion_counts(predictions(spark, d).withColumn("tier", tier), groups=["tier", "model"]), ["tier", "model"])
    return s.groupBy("tier").agg(r6(F.avg("macro_f1")).alias("mean"), r6(F.stddev_samp("macro_f1")).alias("sd"), F.count(F.lit(1)).alias("models"))


@R.query(f"with {LOGITS}, t as (select tau::double as tau from (values (0.5), (1), (2), (4)) x(tau)), e as (select tau, split, y, p, list_max(s) / list_sum(s) as c from (select tau, split, y, p, list_transform(v, lambda q: exp((q - m) / tau)) as s from probs, t where y >= 0)), g as (select tau, least(floor(c * 15), 14) as bin, count(*) as n, avg(c) as c, avg((y = p)::int) as a from e group by 1, 2), r as (select tau, sum(n * abs(a - c)) / sum(n) as ece from g group by 1) select tau, round(ece, 6) as ece, rank() over (order by round(ece, 9), tau) = 1 as chosen from r")
def temperature_choice(spark, d):
    base = teacher(spark, d).where("y >= 0").select("y", "p", "teacher_logits")
    parts = [base.select("y", "p", F.lit(t).alias("tau"), F.array_max(vc.softmax("teacher_logits", t)).alias("c")) for t in (0.5, 1.0, 2.0, 4.0)]
    e = mt.ece(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), F.col("c"), F.col("y") == F.col("p"), ["tau"]).withColumn("k", F.round("ece", 9))
    return e.select("tau", r6("ece").alias("ece"), (F.rank().over(Window.orderBy("k", "tau")) == 1).alias("chosen"))  # four rows


@R.query(f"with {LOGITS} select split, avg((article_id % 5 = 0)::int) is not null as has, count(*) as n, round(avg(ln(greatest(conf, 1e-12))), 6) as mean_log, round(avg(case when y = p then 1 when y is null then null else 0 end), 6) as agreement from probs group by 1")
def fidelity(spark, d):
    t = teacher(spark, d)
    return t.groupBy("split").agg((F.count(F.lit(1)) > 0).alias("has"), F.count(F.lit(1)).alias("n"), r6(F.avg(F.log(F.greatest("conf", F.lit(1e-12))))).alias("mean_log"), r6(F.avg((F.col("y") == F.col("p")).cast("double"))).alias("agreement"))


@R.query("with a as (select event_type as model, round(avg(value), 4) as acc from events where user_id % 2 = 0 and event_type <> 'error' group by 1), b as (select event_type as model, round(max(value), 4) as speed from events where user_id % 2 = 1 and event_type <> 'click' group by 1) select coalesce(a.model, b.model) as model, acc, speed from a full join b on a.model = b.model")
def accuracy_speed_full_join(spark, d):
    e = table(spark, d, "events")
    a = e.where("user_id % 2 = 0 and event_type <> 'error'").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 4).alias("acc"))
    b = e.where("user_id % 2 = 1 and event_type <> 'click'").groupBy(F.col("event_type").alias("model")).agg(F.round(F.max("value"), 4).alias("speed"))
    return a.join(b, "model", "full")


@R.query("with h as (select user_id as run, event_id % 6 as epoch, avg(value) as agreement, sum(value) as seconds from events group by 1, 2) select run, arg_max(epoch, agreement)::bigint as best_epoch, round(max(agreement), 6) as best, round(sum(seconds), 4) as seconds from h group by 1")
def training_history(spark, d):
    h = table(spark, d, "events").groupBy(F.col("user_id").alias("run"), F.pmod("event_id", F.lit(6)).alias("epoch")).agg(F.avg("value").alias("agreement"), F.sum("value").alias("seconds"))
    return h.groupBy("run").agg(F.max_by("epoch", "agreement").alias("best_epoch"), r6(F.max("agreement")).alias("best"), F.round(F.sum("seconds"), 4).alias("seconds"))


@R.query("with g as (select event_type as cfg, user_id % 4 as baseline, round(avg(value), 4) as f1 from events group by 1, 2), c as (select baseline, max(f1) as best, max(f1) filter (cfg = 'view') as default_f1 from g group by 1) select baseline, best, default_f1, round(best - default_f1, 4) as gain from c")
def grid_against_default(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("cfg"), F.pmod("user_id", F.lit(4)).alias("baseline")).agg(F.round(F.avg("value"), 4).alias("f1"))
    return g.groupBy("baseline").agg(F.max("f1").alias("best"), F.max(F.when(F.col("cfg") == "view", F.col("f1"))).alias("default_f1")).withColumn("gain", F.round(F.col("best") - F.col("default_f1"), 4))


@R.query(f"with {PREDS}, {COUNTS('model, lang')}, done as (select model from counts where lang is not null group by 1 having count(distinct lang) = (select count(distinct lang) from counts)), k as (select model, lang, y, p, n from counts where lang is not null and model in (select model from done)), {f1_sql('k', 'model, lang')} select model, lang, n::bigint as n, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1 from f1")
def seed_table(spark, d):
    counts = mt.confusion_counts(predictions(spark, d), groups=["model", "lang"]).where("lang is not null")
    langs = counts.agg(F.count_distinct("lang").alias("all"))
    done = counts.groupBy("model").agg(F.count_distinct("lang").alias("k")).join(F.broadcast(langs), F.col("k") == F.col("all")).select("model")
    s = mt.scores(counts.join(done, "model", "left_semi"), ["model", "lang"])
    return s.select("model", "lang", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@R.query("with t as (select doc_id, min(label) as label, min(lang) as lang, min(domain) as domain, min(train_overlap) as o from unified_test group by 1) select label, count(*) as items, count(distinct lang) as langs, count(distinct domain) as sites, count(*) filter (o < 0.3) as low_overlap, count(*) filter (o is null) as unknown_overlap from t group by 1")
def dataset_report(spark, d):
    t = table(spark, d, "unified_test").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("lang").alias("lang"), F.min("domain").alias("domain"), F.min("train_overlap").alias("o"))
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("lang").alias("langs"), F.count_distinct("domain").alias("sites"), F.count_if(F.col("o") < 0.3).alias("low_overlap"), F.count_if(F.col("o").isNull()).alias("unknown_overlap"))


@R.query("select distinct doc_id, case when source like '%jsonld%' then 'section' when source like '%pool%' then 'pool' else 'other' end as family, split_part('kind:' || source, ':', 2) as spec, regexp_replace(source, '-news(-hindi)?$', '') as clean from unified_test")
def family_and_spec(spark, d):
    fam = F.when(F.contains("source", F.lit("jsonld")), "section").when(F.contains("source", F.lit("pool")), "pool").otherwise("other")
    return table(spark, d, "unified_test").select("doc_id", fam.alias("family"), F.split_part(F.concat(F.lit("kind:"), "source"), F.lit(":"), F.lit(2)).alias("spec"), F.regexp_replace("source", "-news(-hindi)?$", "").alias("clean")).distinct()


@R.query(f"with {ITEMS}, b as (select b, ({HASH_INT.format(chr(39) + 'doc|' + chr(39) + ' || b || ' + chr(39) + '|' + chr(39) + ' || i')} % (select count(*) from items)) as k from range(0, 20) x(b), range(0, (select count(*) from items)) z(i)), m as (select b, k, count(*) as m from b group by 1, 2), n as (select row_number() over (order by doc_id) - 1 as k, (y % 2)::double as v from items) select b, sum(m)::bigint as draws, round(sum(m * v) / sum(m), 6) as mean from m join n using (k) group by 1")
def document_bootstrap(spark, d):
    n = items(spark, d).select("doc_id", (F.col("y") % 2).cast("double").alias("v")).withColumn("k", F.row_number().over(Window.orderBy("doc_id")) - 1)  # the evaluation items, not the corpus
    size = n.agg(F.count(F.lit(1)).alias("g"))
    b = spark.range(20).withColumnRenamed("id", "b").crossJoin(F.broadcast(size)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("g").cast("int") - 1)))
    m = b.withColumn("k", (hash_int(F.concat_ws("|", F.lit("doc"), F.col("b").cast("string"), F.col("i").cast("string"))) % F.col("g")).cast("int")).groupBy("b", "k").agg(F.count(F.lit(1)).alias("m"))
    return m.join(n, "k").groupBy("b").agg(F.sum("m").alias("draws"), r6(F.sum(F.col("m") * F.col("v")) / F.sum("m")).alias("mean"))


@R.query("with n as (select doc_id, text, lang from documents where text is not null), k as (select unnest([50, 100, 400]) as k) select lang, k::int as k, count(*) as n, round(avg(least(length(text), k)), 6) as kept, round(avg((length(text) > k)::int), 6) as cut from n, k group by 1, 2")
def truncation_sweep(spark, d):
    n = table(spark, d, "documents").where("text is not null").select("lang", F.length("text").alias("c"), F.explode(F.array(*map(F.lit, (50, 100, 400)))).alias("k"))
    return n.groupBy("lang", "k").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.least("c", "k"))).alias("kept"), r6(F.avg((F.col("c") > F.col("k")).cast("double"))).alias("cut"))
