"""Aggregations, metrics, statistics and analysis programs.

Predictions are the arg-max of articles.teacher_logits ("teacher") and deterministic pseudo-models: a model keeps the
reference label for a share of the ids and else gives a hashed one.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import metrics as mt
from corpusloom.operators import stats as st
from corpusloom.operators import vectors as vc
from corpusloom.plans.base import HASH_INT, TOKENS, Registry, hash_int, r6, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

KEEP = {"a": 80, "b": 70, "c": 50}


def _h(model: str, salt: str, id_col: str = "doc_id"):
    return hash_int(F.concat(F.lit(f"{model}|{salt}|"), F.col(id_col).cast("string")))


def items(spark, d):
    """Distinct test items with their label y and site cluster."""
    t = table(spark, d, "unified_test").select("doc_id", "source", "label_origin", "lang", F.col("label_id").alias("y"), "domain").distinct()
    known = F.col("domain").isNotNull() & (F.col("domain") != "")
    return t.withColumn("cluster", F.when(known, F.col("domain")).otherwise(F.concat(F.lit("src:"), "source"))).drop("domain")


def predictions(spark, d):
    """(item columns, model, p) for the three pseudo-models, one scan."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.when(_h(m, "keep") % 100 < k, F.col("y")).otherwise((_h(m, "label") % 17).cast("int")).alias("p")) for m, k in KEEP.items()])
    return items(spark, d).withColumn("x", F.explode(models)).select("*", "x.*").drop("x")


def _hsql(m, salt):
    return HASH_INT.format(f"'{m}|{salt}|' || doc_id")


ITEMS = "items as (select distinct doc_id, source, label_origin, lang, label_id as y, case when domain is not null and domain <> '' then domain else 'src:' || source end as cluster from unified_test)"
PREDS = ITEMS + ", preds as (" + " union all ".join(f"select *, '{m}' as model, case when {_hsql(m, 'keep')} % 100 < {k} then y else ({_hsql(m, 'label')} % 17)::int end as p from items" for m, k in KEEP.items()) + ")"


def f1_sql(src: str, keys: str, name: str = "f1") -> str:
    """CTEs: {name} has (keys, n, accuracy, macro_f1) from src with (keys, y, p, n)."""
    on = " and ".join(f"a.{k} is not distinct from b.{k}" for k in keys.split(", "))
    return f"""{name}_l as (select {keys}, label, sum(s) as s, sum(q) as q, sum(t) as t from (
        select {keys}, y as label, n as s, 0 as q, case when y = p then n else 0 end as t from {src}
        union all select {keys}, p, 0, n, 0 from {src}) group by {keys}, label),
      {name}_m as (select {keys}, avg(2.0 * t / (s + q)) as macro_f1 from {name}_l where s > 0 group by {keys}),
      {name}_a as (select {keys}, sum(n) as n, sum(case when y = p then n else 0 end) / sum(n)::double as accuracy from {src} group by {keys}),
      {name} as (select a.*, b.macro_f1 from {name}_a a join {name}_m b on {on})"""


def COUNTS(keys: str) -> str:
    return f"counts as (select {keys}, y, p, count(*) as n from preds where y is not null and p is not null group by {keys}, y, p)"


# --- aggregations ---


@R.query("select source, count(*) as docs, count(distinct lang) as langs, count(distinct domain) as sites from documents group by 1")
def corpus_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("lang").alias("langs"), F.count_distinct("domain").alias("sites"))


@R.query("select source, lang, count(*) as n, round(count(*) / sum(count(*)) over (partition by source), 6) as share from documents group by 1, 2")
def value_shares(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("source"))))


LANGS = ["en", "es", "de", "fr", "it", "tr"]


#: The columns of the cross-tab; the total counts all rows, those of other and of no language too.
ALL_LANGS = "en es de fr it tr id pl ru el hi zh ja".split()


@R.query("select source, " + ", ".join(f'count(*) filter (lang = \'{x}\') as "{x}"' for x in ALL_LANGS) + ", count(*) as total from documents group by 1")
def crosstab(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(*[F.count_if(F.col("lang") == x).alias(x) for x in ALL_LANGS], F.count(F.lit(1)).alias("total"))


@R.query("select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, min(value) as lo, max(value) as hi, round(median(value), 6) as med, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def latency_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), r6(F.median("value")).alias("med"), r6(F.percentile("value", 0.95)).alias("p95"))


@R.query("with k as (select user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type, event_id // 1000 order by event_id desc) = 1), m as (select event_type, user_id % 5 as model, median(value) as med, max(value) as mx, min(value) as mn, count(*) as runs from k group by 1, 2) select model, " + ", ".join(f"round(max(med) filter (event_type = '{e}'), 6) as {e}" for e in ("click", "view", "error")) + ", sum(runs)::bigint as runs, round(max(greatest(mx - med, med - mn) / med), 6) as spread from m group by 1")
def efficiency_pivot(spark, d):
    w = Window.partitionBy("user_id", "event_type", F.floor(F.col("event_id") / 1000)).orderBy(F.col("event_id").desc())
    last = table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r = 1")
    m = last.groupBy("event_type", F.pmod("user_id", F.lit(5)).alias("model")).agg(F.median("value").alias("med"), F.max("value").alias("mx"), F.min("value").alias("mn"), F.count(F.lit(1)).alias("runs"))
    one = lambda e: r6(F.max(F.when(F.col("event_type") == e, F.col("med")))).alias(e)
    return m.groupBy("model").agg(*map(one, ("click", "view", "error")), F.sum("runs").alias("runs"), r6(F.max(F.greatest(F.col("mx") - F.col("med"), F.col("med") - F.col("mn")) / F.col("med"))).alias("spread"))


@R.query("select domain, string_agg(distinct lang, ', ' order by lang) as langs, min_by(doc_id, doc_id) as first_id, mode_lang from (select *, first_value(lang) over (partition by domain order by n desc, lang) as mode_lang from (select *, count(*) over (partition by domain, lang) as n from documents where lang is not null)) group by domain, mode_lang")
def sorted_string_agg(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    n = docs.groupBy("domain", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("f"))
    return n.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("langs"), F.min("f").alias("first_id"), F.min(F.struct((-F.col("n")).alias("m"), "lang"))["lang"].alias("mode_lang"))


@R.query("with s as (select lang, domain, count(*) as n from documents where lang is not null group by 1, 2), q as (select *, n / sum(n) over (partition by lang) as q from s) select lang, round(1 / sum(q * q), 6) as effective, round(max(q), 6) as top_share, count(*) as sites, arg_max(domain, n * 1000000 - ascii(domain)) is not null as has_top from q group by 1")
def effective_clusters(spark, d):
    s = table(spark, d, "documents").where("lang is not null").groupBy("lang", "domain").agg(F.count(F.lit(1)).alias("n"))
    q = s.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    return q.groupBy("lang").agg(r6(1 / F.sum(F.col("q") * F.col("q"))).alias("effective"), r6(F.max("q")).alias("top_share"), F.count(F.lit(1)).alias("sites"), F.max_by("domain", "n").isNotNull().alias("has_top"))


@R.query("with s as (select lang, count(distinct doc_id) as docs, count(distinct domain) as sites from documents where lang is not null group by 1) select lang, docs, case when docs = 0 then 'none' when docs < 500 then 'low' else 'high' end as doc_tier, case when sites >= 10 then 'broad' when sites >= 3 then 'some' else 'few' end as site_tier from s")
def tier_bucketing(spark, d):
    s = table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("domain").alias("sites"))
    return s.select("lang", "docs", F.when(F.col("docs") == 0, "none").when(F.col("docs") < 500, "low").otherwise("high").alias("doc_tier"), F.when(F.col("sites") >= 10, "broad").when(F.col("sites") >= 3, "some").otherwise("few").alias("site_tier"))


@R.query("with e as (select distinct doc_id, label, unnest(from_json(source_label, '[\"VARCHAR\"]')) as name from unified_test where json_valid(source_label)), c as (select label, lower(trim(name)) as name, count(*) as n from e group by 1, 2) select label, name, n from c qualify row_number() over (partition by label order by n desc, name) <= 12")
def top_terms_per_label(spark, d):
    e = table(spark, d, "unified_test").select("doc_id", "label", F.explode(F.from_json("source_label", "array<string>")).alias("name")).distinct()
    c = e.groupBy("label", F.lower(F.trim("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "name"))).where("r <= 12").drop("r")


@R.query(f"with t as (select doc_id, unnest({TOKENS.format('text')}) as token from documents where text is not null) select token, count(*) as cf, count(distinct doc_id) as df from t group by 1 having count(*) >= 5")
def token_frequency(spark, d):
    from corpusloom.functions.text import tokens

    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(tokens("text")).alias("token"))
    return t.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("df")).where("cf >= 5")


@R.query("select count(*) as all_rows, count(*) filter (text is not null) as has_text, count(*) filter (text is not null and lang is not null) as has_lang, count(*) filter (text is not null and lang is not null and n_chars >= 200) as long, count(*) filter (text is not null and lang is not null and n_chars >= 200 and url is not null) as has_url from documents")
def funnel(spark, d):
    steps = {"has_text": "text is not null", "has_lang": "lang is not null", "long": "n_chars >= 200", "has_url": "url is not null"}
    cond, out = F.lit(True), [F.count(F.lit(1)).alias("all_rows")]
    for name, c in steps.items():
        cond = cond & F.expr(c)
        out.append(F.count_if(cond).alias(name))
    return table(spark, d, "documents").agg(*out)


@R.query("with m as (select user_id, avg(value) as v from events group by 1) select least(floor(v / 5), 19)::bigint as bin, count(*) as n from m group by 1")
def mean_histogram(spark, d):
    m = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    return m.groupBy(F.least(F.floor(F.col("v") / 5), F.lit(19)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# --- metrics ---


@R.query(f"with {PREDS}, {COUNTS('model')}, {f1_sql('counts', 'model')} select model, n::bigint as n, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1 from f1")
def macro_f1(spark, d):
    s = mt.scores(mt.confusion_counts(predictions(spark, d), groups=["model"]), ["model"])
    return s.select("model", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@R.query(f"with {PREDS}, {COUNTS('model')}, {f1_sql('counts', 'model')}, l as (select x as label from range(0, 17) r(x)), g as (select m.model, l.label from (select distinct model from counts) m, l) select g.model, g.label::int as label, coalesce(s, 0)::bigint as support, coalesce(q, 0)::bigint as predicted, round(coalesce(2.0 * t / nullif(s + q, 0), 0), 6) as f1 from g left join f1_l f on f.model = g.model and f.label = g.label")
def per_label_f1(spark, d):
    labels = mt.per_label(mt.confusion_counts(predictions(spark, d), groups=["model"]), ["model"])
    grid = spark.createDataFrame([(m,) for m in KEEP], "model string").crossJoin(spark.range(17).select(F.col("id").cast("int").alias("label")))
    out = grid.join(labels, ["model", "label"], "left").na.fill(0, ["support", "predicted"]).na.fill(0.0, ["f1"])
    return out.select("model", "label", "support", "predicted", r6("f1").alias("f1"))


@R.query(f"with {PREDS}, {COUNTS('model')} select y, p, n, round(n / greatest(sum(n) over (partition by y), 1), 6) as share from counts where model = 'a'")
def confusion_normalised(spark, d):
    return mt.normalised_confusion(mt.confusion_counts(predictions(spark, d).where("model = 'a'"))).withColumn("share", r6("share"))


@R.query(f"with {PREDS}, {COUNTS('lang')}, {f1_sql('counts', 'lang')} select round(avg(macro_f1), 6) as grouped_macro_f1, count(*) as groups from f1")
def grouped_macro_f1(spark, d):
    return mt.grouped_macro_f1(mt.confusion_counts(predictions(spark, d), groups=["lang"]), "lang").withColumn("grouped_macro_f1", r6("grouped_macro_f1"))


LOGITS = "z as (select distinct article_id, split, source, lang, gpt_label_id as y, list_transform(teacher_logits, lambda v: v::double) as v from articles where teacher_logits is not null), zm as (select *, list_max(v) as m, list_transform(v, lambda x: exp(x - list_max(v))) as e from z), probs as (select *, m_e / list_sum(e) as conf, list_position(v, m) - 1 as p from (select *, list_max(e) as m_e from zm))"


def teacher(spark, d):
    a = table(spark, d, "articles").where("teacher_logits is not null").select("article_id", "split", "source", "lang", F.col("gpt_label_id").alias("y"), "teacher_logits").distinct()
    return a.withColumn("conf", F.array_max(vc.softmax("teacher_logits"))).withColumn("p", vc.argmax("teacher_logits"))


@R.query(f"with {LOGITS}, b as (select split, least(floor(conf * 15), 14) as bin, conf, (y = p)::int as ok from probs where y is not null), g as (select split, bin, count(*) as n, avg(conf) as c, avg(ok) as a from b group by 1, 2) select split, sum(n)::bigint as n, round(sum(n * abs(a - c)) / sum(n), 6) as ece from g group by 1")
def ece(spark, d):
    t = teacher(spark, d).where("y is not null")
    return mt.ece(t, F.col("conf"), F.col("y") == F.col("p"), ["split"]).select("split", "n", r6("ece").alias("ece"))


@R.query(f"with {LOGITS}, b as (select split, ceil(conf * 15) as bin, conf, (y = p)::int as ok from probs where y is not null and conf > 0), g as (select split, bin, count(*) as n, avg(conf) as c, avg(ok) as a from b group by 1, 2) select split, sum(n)::bigint as n, round(sum(n * abs(a - c)) / sum(n), 6) as ece from g group by 1")
def ece_half_open(spark, d):
    t = teacher(spark, d).where("y is not null")
    return mt.ece(t, F.col("conf"), F.col("y") == F.col("p"), ["split"], half_open_low=True).select("split", "n", r6("ece").alias("ece"))


@R.query(f"with {LOGITS} select least(floor(conf * 10), 9)::int as bin, count(*) as n, round(avg(conf), 6) as confidence, round(avg((y = p)::int), 6) as accuracy from probs where y is not null group by 1")
def reliability(spark, d):
    t = teacher(spark, d).where("y is not null")
    return mt.reliability(t, F.col("conf"), F.col("y") == F.col("p"), []).select("bin", "n", r6("confidence").alias("confidence"), r6("accuracy").alias("accuracy"))


@R.query(f"with {PREDS}, c as (select a.p as y, b.p as p, count(*) as n from preds a join preds b on a.doc_id = b.doc_id where a.model = 'a' and b.model = 'b' group by 1, 2), m as (select label, sum(a) as a, sum(b) as b from (select y as label, n as a, 0 as b from c union all select p, 0, n from c) group by 1), x as (select sum(a * b)::double as ab, sum((a + b) * (a + b - 1))::double as same, sum(a)::double as n from m), o as (select sum(case when y = p then n else 0 end)::double / sum(n) as po from c) select n::bigint as n, round(po, 6) as agreement, round((po - ab / (n * n)) / (1 - ab / (n * n)), 6) as kappa, round(1 - (1 - po) / (1 - same / (2 * n * (2 * n - 1))), 6) as alpha from x, o")
def rater_agreement(spark, d):
    w = predictions(spark, d).groupBy("doc_id").pivot("model", ["a", "b"]).agg(F.first("p"))
    r = mt.agreement(w.groupBy(F.col("a").alias("y"), F.col("b").alias("p")).agg(F.count(F.lit(1)).alias("n")))
    return r.select("n", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"), r6("alpha").alias("alpha"))


@R.query(f"with {PREDS}, {COUNTS('model')}, {f1_sql('counts', 'model')} select model, round(100 * macro_f1 / max(macro_f1) filter (model = 'a') over (), 6) as pct_of_a from f1")
def percent_of_best(spark, d):
    s = mt.scores(mt.confusion_counts(predictions(spark, d), groups=["model"]), ["model"])
    return s.select("model", r6(100 * F.col("macro_f1") / F.max(F.when(F.col("model") == "a", F.col("macro_f1"))).over(Window.partitionBy())).alias("pct_of_a"))  # one row a model


# --- statistics ---

B = 50
DRAWS = f"clusters as (select cluster, row_number() over (order by cluster) - 1 as k from (select distinct cluster from preds)), g as (select count(*) as g from clusters), draws as (select b, cluster, count(*) as m from (select b, {HASH_INT.format(chr(39) + '0|' + chr(39) + ' || b || ' + chr(39) + '|' + chr(39) + ' || i')} % g as k from range(0, {B}) x(b), g, range(0, (select g from g)) y(i)) t join clusters using (k) group by 1, 2)"
CL = "cl as (select cluster, model, y, p, count(*) as n from preds where y is not null and p is not null group by 1, 2, 3, 4)"
BOOT = f"{PREDS}, {DRAWS}, {CL}, mult as (select b, model, y, p, sum(n * m) as n from cl join draws using (cluster) group by 1, 2, 3, 4), {f1_sql('mult', 'b, model', 'bf')}"


def _boot(spark, d):
    counts = mt.confusion_counts(predictions(spark, d), groups=["cluster", "model"])
    return st.bootstrap_scores(counts, "cluster", B, ["model"])


@R.query(f"with {BOOT} select model, round(avg(macro_f1), 6) as mean, round(quantile_cont(macro_f1, 0.025), 6) as lo, round(quantile_cont(macro_f1, 0.975), 6) as hi from bf group by 1")
def cluster_bootstrap_ci(spark, d):
    return st.percentile_interval(_boot(spark, d), "macro_f1", ["model"]).select("model", *[r6(c).alias(c) for c in ("mean", "lo", "hi")])


@R.query(f"with {BOOT}, dd as (select x.b, x.macro_f1 - y.macro_f1 as diff from bf x join bf y on x.b = y.b where x.model = 'a' and y.model = 'b') select round(avg(diff), 6) as mean, round(quantile_cont(diff, 0.025), 6) as lo, round(quantile_cont(diff, 0.975), 6) as hi, round(least(1.0, 2 * least(avg((diff <= 0)::int), avg((diff >= 0)::int))), 6) as p, round(quantile_cont(diff, 0.05), 6) as lo90, round(quantile_cont(diff, 0.95), 6) as hi90, round(greatest(avg((diff <= -0.1)::int), avg((diff >= 0.1)::int)), 6) as p_equivalence, quantile_cont(diff, 0.05) > -0.1 and quantile_cont(diff, 0.95) < 0.1 as equivalent from dd")
def paired_bootstrap_tost(spark, d):
    w = _boot(spark, d).groupBy("b").agg((F.max(F.when(F.col("model") == "a", F.col("macro_f1"))) - F.max(F.when(F.col("model") == "b", F.col("macro_f1")))).alias("diff"))
    r = st.paired_summary(w, margin=0.1)
    return r.select(*[r6(c).alias(c) for c in r.columns if c != "equivalent"], "equivalent")


@R.query(f"with {BOOT}, v as (select b, case when model = 'a' then 'x' else 'y' end as variant, avg(macro_f1) as f from bf group by 1, 2), dd as (select a.f - c.f as diff from v a join v c on a.b = c.b where a.variant = 'x' and c.variant = 'y') select round(avg(diff), 6) as mean, round(quantile_cont(diff, 0.025), 6) as lo, round(quantile_cont(diff, 0.975), 6) as hi from dd")
def paired_bootstrap_seeds(spark, d):
    v = _boot(spark, d).groupBy("b").agg((F.avg(F.when(F.col("model") == "a", F.col("macro_f1"))) - F.avg(F.when(F.col("model") != "a", F.col("macro_f1")))).alias("diff"))
    return st.percentile_interval(v, "diff").select(*[r6(c).alias(c) for c in ("mean", "lo", "hi")])


@R.query(f"with {PREDS}, w as (select a.doc_id, a.y, a.p as pa, b.p as pb from preds a join preds b on a.doc_id = b.doc_id where a.model = 'a' and b.model = 'b'), c as (select count(*) filter (pa = y and pb <> y) as only_a, count(*) filter (pb = y and pa <> y) as only_b from w) select only_a, only_b, round(case when only_a + only_b = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) from range(0, 100000) r(i) where i <= least(only_a, only_b))) end, 6) as p from c")
def mcnemar(spark, d):
    w = predictions(spark, d).groupBy("doc_id", "y").agg(F.max(F.when(F.col("model") == "a", F.col("p"))).alias("pa"), F.max(F.when(F.col("model") == "b", F.col("p"))).alias("pb"))
    return st.mcnemar(w.groupBy("y", "pa", "pb").agg(F.count(F.lit(1)).alias("n"))).withColumn("p", r6("p"))


PV = "pv as (select user_id as id, user_id % 3 as family, count(*) filter (event_type = 'error')::double / count(*) as p from events group by 1)"


def _pv(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg((F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("p")).withColumn("family", F.pmod("id", F.lit(3)))


@R.query(f"with {PV}, s as (select *, (count(*) over (partition by family) - row_number() over (partition by family order by p, id) + 1) * p as s from pv) select id, family, round(p, 6) as p, round(least(1.0, max(s) over (partition by family order by p, id rows unbounded preceding)), 6) as p_holm from s")
def holm(spark, d):
    return st.holm(_pv(spark, d), "p", ["family"]).select("id", "family", r6("p").alias("p"), r6("p_holm").alias("p_holm"))


@R.query("with s as (select event_type = 'click' as side, value from events where event_type in ('click', 'view')), a as (select avg(value) filter (side) as m1, var_samp(value) filter (side) as v1, count(value) filter (side) as n1, avg(value) filter (not side) as m0, var_samp(value) filter (not side) as v0, count(value) filter (not side) as n0 from s) select round(m1 - m0, 6) as delta, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as t, round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 3) as dof from a")
def welch_stat(spark, d):
    e = table(spark, d, "events").where("event_type in ('click', 'view')").withColumn("side", F.col("event_type") == "click")
    return st.welch(e, "value", "side").select(r6("delta").alias("delta"), r6("t").alias("t"), F.round("dof", 3).alias("dof"))


UV = "uv as (select user_id, round(avg(value) filter (event_type = 'click'), 3) as a, round(avg(value) filter (event_type = 'view'), 3) as b, user_id % 4 as g from events group by 1)"


def _uv(spark, d):
    one = lambda e, n: F.round(F.avg(F.when(F.col("event_type") == e, F.col("value"))), 3).alias(n)
    return table(spark, d, "events").groupBy("user_id").agg(one("click", "a"), one("view", "b")).withColumn("g", F.pmod("user_id", F.lit(4)))


@R.query(f"with {UV}, x as (select round(a - b, 3) as d from uv where a <> b), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from x) select count(*) as n, round(least(coalesce(sum(r) filter (d > 0), 0), coalesce(sum(r) filter (d < 0), 0)), 6) as w from r")
def wilcoxon_w(spark, d):
    return st.wilcoxon(_uv(spark, d).withColumn("diff", F.round(F.col("a") - F.col("b"), 3)), "diff").withColumn("w", r6("w"))


@R.query(f"with {UV}, r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from uv where a is not null and b is not null) select round(corr(ra, rb), 6) as rho, count(*) as n from r")
def spearman(spark, d):
    return st.spearman(_uv(spark, d), "a", "b").select(r6("rho").alias("rho"), "n")


@R.query(f"with {UV}, r as (select a, g, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as r from uv where a is not null), t as (select sum(t * t * t - t)::double as ties from (select count(*) as t from r group by a)), q as (select sum(s * s / k) as q, sum(k)::double as n, count(*) as groups from (select sum(r) as s, count(*) as k from r group by g)) select round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) as h, groups from q, t")
def kruskal_h(spark, d):
    return st.kruskal(_uv(spark, d), "a", "g").select(r6("h").alias("h"), "groups")


@R.query(f"with {UV} select count(*) filter (a > b) as wins, count(*) filter (a < b) as losses, count(*) filter (a = b) as ties from uv")
def win_loss(spark, d):
    return _uv(spark, d).agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))


# --- programs ---


@R.query(f"with {PREDS}, {COUNTS('source, model')}, s as (select distinct source from counts), loo as (select s.source as left_out, model, y, p, sum(n) as n from counts c, s where c.source <> s.source group by 1, 2, 3, 4), {f1_sql('loo', 'left_out, model')} select left_out, model, n::bigint as n, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1, (rank() over (partition by left_out order by round(macro_f1, 9) desc) + (count(*) over (partition by left_out, round(macro_f1, 9)) - 1) / 2.0)::double as rank from f1")
def leave_one_source_out(spark, d):
    counts = mt.confusion_counts(predictions(spark, d), groups=["source", "model"])
    loo = mt.leave_one_out_counts(counts, "source", ["model", "y", "p"])
    s = mt.scores(loo, ["left_out", "model"]).withColumn("f", F.round("macro_f1", 9))
    return s.select("left_out", "model", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), st.average_rank("f", ["left_out"], True).cast("double").alias("rank"))


@R.query(f"with {PREDS}, {COUNTS('lang, model')}, {f1_sql('counts', 'lang, model')} select lang, max(n)::bigint as n, " + ", ".join(f"round(max(macro_f1) filter (model = '{m}'), 6) as {m}" for m in KEEP) + ", round(max(macro_f1) filter (model = 'b') / nullif(max(macro_f1) filter (model = 'a'), 0), 6) as b_of_a from f1 where n >= 5 group by 1")
def subgroup_scores(spark, d):
    s = mt.scores(mt.confusion_counts(predictions(spark, d), groups=["lang", "model"]), ["lang", "model"]).where("n >= 5")
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("macro_f1")))
    return s.groupBy("lang").agg(F.max("n").alias("n"), *[r6(one(m)).alias(m) for m in KEEP], r6(F.try_divide(one("b"), F.when(one("a") != 0, one("a")))).alias("b_of_a"))


@R.query(f"with {PREDS}, k as (select * from preds qualify cluster like 'src:%' or row_number() over (partition by model, cluster order by md5('0|' || doc_id), doc_id) <= 2), counts as (select model, y, p, count(*) as n from k where y is not null group by 1, 2, 3), {f1_sql('counts', 'model')} select model, n::bigint as n, round(macro_f1, 6) as macro_f1 from f1")
def cap_sensitivity(spark, d):
    from corpusloom.operators.sampling import cap

    p = predictions(spark, d)
    free = F.startswith("cluster", F.lit("src:"))
    k = cap(p.where(~free), ["model", "cluster"], 2, "doc_id").unionByName(p.where(free))
    return mt.scores(mt.confusion_counts(k, groups=["model"]), ["model"]).select("model", "n", r6("macro_f1").alias("macro_f1"))


@R.query(f"with {LOGITS}, c as (select source, y, p, count(*) as n from probs where y >= 0 group by 1, 2, 3), t as (select source, y, sum(n) as total, sum(n) filter (y = p) as same from c group by 1, 2), o as (select source, y, p as alternative, n from c where y <> p qualify row_number() over (partition by source, y order by n desc, p) = 1) select t.source, t.y, total::bigint as total, round(coalesce(same, 0) / total, 6) as agreement, alternative::int as alternative, round(n / total, 6) as share from t left join o on o.source = t.source and o.y = t.y where total >= 10")
def mapping_check(spark, d):
    c = teacher(spark, d).where("y >= 0").groupBy("source", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    other = F.when(F.col("y") != F.col("p"), F.struct((-F.col("n")).alias("m"), F.col("p").alias("p")))
    t = c.groupBy("source", "y").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("same"), F.min(other).alias("o")).where("total >= 10")
    return t.select("source", "y", "total", r6(F.col("same") / F.col("total")).alias("agreement"), F.col("o.p").alias("alternative"), r6(-F.col("o.m") / F.col("total")).alias("share"))


@R.query(f"with {LOGITS}, t as (select x as theta from (values (0.0), (0.5), (0.6), (0.7), (0.8), (0.9), (1.01)) v(x)), k as (select theta::double as theta, y, conf >= theta as keep, case when conf >= theta then p else y end as p, p as own from probs, t where y >= 0) select theta, count(*) as n, round(avg(keep::int), 6) as coverage, round(avg((own = y)::int) filter (keep), 6) as kept_accuracy, round(avg((p = y)::int), 6) as accuracy, round(1 / (1 / 539.0 + (1 - avg(keep::int)) / 0.34), 6) as docs_per_sec from k group by 1")
def cascade(spark, d):
    t = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01)])).alias("theta")
    k = teacher(spark, d).where("y >= 0").select("y", "p", "conf", t).withColumn("keep", F.col("conf") >= F.col("theta"))
    cover, ok = F.avg(F.col("keep").cast("double")), (F.col("p") == F.col("y")).cast("double")
    return k.groupBy("theta").agg(F.count(F.lit(1)).alias("n"), r6(cover).alias("coverage"), r6(F.avg(F.when(F.col("keep"), ok))).alias("kept_accuracy"), r6(F.avg(F.when(F.col("keep"), ok).otherwise(1.0))).alias("accuracy"), r6(1 / (1 / F.lit(539.0) + (1 - cover) / F.lit(0.34))).alias("docs_per_sec"))


@R.query(f"with {LOGITS}, c as (select y, p, count(*) as n from probs where y >= 0 and y <> p group by 1, 2) select y, p::int as p, n from c order by n desc, y, p limit 5")
def top_confusions(spark, d):
    return mt.confusion_counts(teacher(spark, d).where("y >= 0")).where("y <> p").orderBy(F.desc("n"), "y", "p").limit(5)


@R.query(f"with {PREDS}, w as (select a.doc_id, a.label_origin from preds a join preds b on a.doc_id = b.doc_id where a.model = 'a' and b.model = 'b' and a.p = a.y and b.p <> b.y) select doc_id, label_origin from w qualify row_number() over (partition by label_origin order by md5('0|' || doc_id), doc_id) <= 2")
def error_sample(spark, d):
    from corpusloom.operators.sampling import cap

    w = predictions(spark, d).groupBy("doc_id", "label_origin", "y").agg(F.max(F.when(F.col("model") == "a", F.col("p"))).alias("pa"), F.max(F.when(F.col("model") == "b", F.col("p"))).alias("pb"))
    return cap(w.where("pa = y and pb <> y").select("doc_id", "label_origin"), ["label_origin"], 2, "doc_id")


@R.query(f"with n as (select lang, len({TOKENS.format('text')}) as n from documents where text is not null) select lang, count(*) as docs, round(avg((n > 200)::int), 6) as truncated, round(median(least(n, 200)), 6) as kept from n group by 1")
def truncation_audit(spark, d):
    from corpusloom.functions.text import tokens

    n = table(spark, d, "documents").where("text is not null").select("lang", F.size(tokens("text")).alias("n"))
    return n.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), r6(F.avg((F.col("n") > 200).cast("double"))).alias("truncated"), r6(F.median(F.least("n", F.lit(200)))).alias("kept"))


@R.query(f"with t as (select doc_id, lang, unnest({TOKENS.format('text')}) as token from documents where text is not null and lang is not null), f as (select token, count(*) as cf from t group by 1) select lang, count(*) as occurrences, round(avg((cf >= 10)::int), 6) as covered from t join f using (token) group by 1")
def token_coverage(spark, d):
    from corpusloom.functions.text import tokens

    t = table(spark, d, "documents").where("text is not null and lang is not null").select("lang", F.explode(tokens("text")).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    f = t.groupBy("token").agg(F.sum("n").alias("cf"))
    return t.join(f, "token").groupBy("lang").agg(F.sum("n").alias("occurrences"), r6(F.sum(F.when(F.col("cf") >= 10, F.col("n")).otherwise(0)) / F.sum("n")).alias("covered"))


@R.query(f"with {LOGITS} select lang, count(*) as n, round(avg(conf), 6) as confidence, round(avg((p = 11)::int), 6) as politics_share from probs group by 1")
def teacher_confidence(spark, d):
    return teacher(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("conf")).alias("confidence"), r6(F.avg((F.col("p") == 11).cast("double"))).alias("politics_share"))


@R.query(f"with {PREDS}, {COUNTS('label_origin, model')}, {f1_sql('counts', 'label_origin, model')} select label_origin, model, n::bigint as n, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1 from f1")
def label_validity(spark, d):
    s = mt.scores(mt.confusion_counts(predictions(spark, d), groups=["label_origin", "model"]), ["label_origin", "model"])
    return s.select("label_origin", "model", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@R.query("with v as (select event_type as code, user_id % 6 as seed, avg(value) as v from events group by 1, 2) select code, count(*) as seeds, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, max_by(seed, v)::bigint as best_seed from v group by 1")
def ablation_table(spark, d):
    v = table(spark, d, "events").groupBy(F.col("event_type").alias("code"), F.pmod("user_id", F.lit(6)).alias("seed")).agg(F.avg("value").alias("v"))
    return v.groupBy("code").agg(F.count(F.lit(1)).alias("seeds"), r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("sd"), F.max_by("seed", "v").alias("best_seed"))


@R.query()
def ablation_significance(spark, d):
    """Each variant's seed means against the base variant's: Welch's test, adjusted by Holm."""
    v = table(spark, d, "events").groupBy(F.col("event_type").alias("code"), F.pmod("user_id", F.lit(6)).alias("seed")).agg(F.avg("value").alias("v"))
    out = st.against_base(v, "code", "view", "v")
    return out.select("code", "n", *[r6(c).alias(c) for c in ("mean", "sd", "delta", "t", "dof", "p", "p_holm")])


@R.query()
def factor_tests(spark, d):
    """Seven factors of a user's mean click value, four numeric and three categories, adjusted by Holm."""
    u = table(spark, d, "events").groupBy("user_id").agg(
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("target"), F.count(F.lit(1)).cast("double").alias("events"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("views"),
        F.max("value").alias("largest"), F.count_if(F.col("event_type") == "purchase").cast("double").alias("purchases"))
    u = u.withColumn("g2", F.pmod("user_id", F.lit(2))).withColumn("g4", F.pmod("user_id", F.lit(4))).withColumn("g7", F.pmod("user_id", F.lit(7)))
    out = st.factor_tests(u, "target", ["events", "views", "largest", "purchases"], ["g2", "g4", "g7"])
    return out.select("factor", "test", r6("statistic").alias("statistic"), "n", r6("p").alias("p"), r6("p_holm").alias("p_holm"))
