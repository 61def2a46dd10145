"""Models trained on the corpus tables, result logs, and the common shape of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import models as md
from corpusloom.operators import subword as sw
from corpusloom.operators import vectors as vc
from corpusloom.plans.base import TOKENS, Registry, r6, table
from corpusloom.sources import files as fs
from corpusloom.streaming import scoring

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _docs(spark, d):
    a = table(spark, d, "articles").where("text is not null and teacher_logits is not null").dropDuplicates(["article_id"])
    return md.features(a.select("article_id", "split", "lang", "text", "gpt_label_id", "teacher_logits"), bits=11)


@R.query()
def distilled_student(spark, d):
    """Agreement of a student distilled on the training split with the teacher, by split."""
    docs = _docs(spark, d)
    m = md.distil(docs.where("split = 'train'"), "teacher_logits", 2.0, 12)
    s = md.student_logits(m, docs, 2.0)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("student_label") == vc.argmax("teacher_logits")).cast("double"))).alias("agreement"))


@R.query()
def svm_classifier(spark, d):
    """All 17 classes: accuracy on the other splits and the mean decision score of the class chosen."""
    docs = _docs(spark, d).where("gpt_label_id between 0 and 16").withColumnRenamed("gpt_label_id", "y")
    m = md.train_svm(docs.where("split = 'train'"), "y", 5)
    s = md.svm_scores(m, docs.where("split <> 'train'"), 17)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((vc.argmax("scores") == F.col("y")).cast("double"))).alias("accuracy"), r6(F.avg(F.array_max("scores"))).alias("score"))


@R.query()
def language_id(spark, d):
    """Identified against declared language; profiles from articles, applied to documents."""
    prof = md.language_profiles(table(spark, d, "articles").where("split = 'train'"))
    docs = table(spark, d, "documents")
    lid = md.identify_language(docs.select("doc_id", "text"), prof, "doc_id")
    return docs.join(lid, "doc_id").groupBy("lang", "lid_lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("lid_conf")).alias("confidence"))


@R.query("with g as (select user_id % 3 as baseline, event_type as tokens, user_id as cfg, round(avg(value), 4) as f1 from events group by 1, 2, 3) select baseline, cfg, tokens, f1 from g qualify row_number() over (partition by baseline order by f1 desc, cfg, tokens) = 1")
def grid_choice(spark, d):
    g = table(spark, d, "events").groupBy(F.pmod("user_id", F.lit(3)).alias("baseline"), F.col("event_type").alias("tokens"), F.col("user_id").alias("cfg")).agg(F.round(F.avg("value"), 4).alias("f1"))
    g = g.withColumn("tie", F.struct("cfg", "tokens"))
    return md.best_of_grid(g, ["baseline"], "f1", "tie").select("baseline", "cfg", "tokens", "f1")


@R.query("select doc_id, label_id, list_transform(range(0, 17), lambda i: case when i = label_id then 0.0 else -10000.0 end)::double[] as head from (select distinct doc_id, label_id from unified_test)")
def label_logits(spark, d):
    u = table(spark, d, "unified_test").select("doc_id", "label_id").distinct()
    return u.select("doc_id", "label_id", md.label_logits(F.col("label_id"), 17).alias("head"))


@R.query(f"select md5('__label__' || gpt_label_id || ' ' || array_to_string({TOKENS.format('text')}, ' ')) as line, count(*) as n from documents where gpt_label_id >= 0 and text is not null group by 1")
def fasttext_file(spark, d):
    docs = table(spark, d, "documents").where("gpt_label_id >= 0 and text is not null").withColumn("tok", F.array_join(tokens("text"), " "))
    return fs.fasttext_lines(docs, "gpt_label_id", "tok", "doc_id").groupBy(F.md5("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@R.query(r"with u as (select 'docs' as source, lang, null as source_label, null as headline, text as body, url, domain from documents union all select 'pages', 'xx', article_section, headline, text, url, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '')) from extracted_pages) select source, lang, count(*) as n, count(headline) as with_headline, count(distinct domain) as sites, count(source_label) as labelled from u group by 1, 2")
def source_normaliser(spark, d):
    a = fs.normalise_source(table(spark, d, "documents"), "docs", lang_from="lang", body="text", url="url", domain="domain")
    b = fs.normalise_source(table(spark, d, "extracted_pages"), "pages", "xx", source_label="article_section", headline="headline", body="text", url="url")
    u = fs.union_sources([a, b])
    return u.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count("headline").alias("with_headline"), F.count_distinct("domain").alias("sites"), F.count("source_label").alias("labelled"))


@R.query("with e as (select event_type as g, value as v from events), m as (select g, avg(v) as m from e group by 1), a as (select avg(v) as a from e) select count(*) as n, round(1 - sum((v - m) ** 2) / sum((v - a) ** 2), 6) as r2 from e join m using (g), a")
def ols_r2(spark, d):
    """Share of the variance of value that the event type explains: a regression on dummies only."""
    e = table(spark, d, "events").select(F.lit(0.0).alias("zero"), "value", "event_type")
    r2, n = md.ols(e, "value", ["zero"], "event_type")
    return spark.createDataFrame([(n, round(r2, 6))], "n bigint, r2 double")


@R.query()
def class_offset_calibration(spark, d):
    """Offsets of all classes that raise the teacher's macro-F1 on the dev split, with the macro-F1 before and, out of fold, after."""
    a = table(spark, d, "articles").where("split = 'dev' and gpt_label_id between 0 and 16 and teacher_logits is not null").select("article_id", "gpt_label_id", "teacher_logits").distinct()
    off, before, after = md.class_offsets(a, "article_id", "gpt_label_id", "teacher_logits", 17)
    return spark.createDataFrame([(k, float(x), before, after) for k, x in enumerate(off)], "class int, offset double, macro_f1 double, macro_f1_out_of_fold double")


@R.query()
def subword_tokens(spark, d):
    """Ids by a public subword vocabulary for every document: how many, and the least and largest."""
    ids = sw.subword_ids(table(spark, d, "documents"), "doc_id")
    return ids.select("doc_id", F.size("ids").alias("n"), F.array_min("ids").alias("least"), F.array_max("ids").alias("largest"))


HAS = "('0x' || substr(md5('has|' || token), 1, 6))::bigint % 10 > 0"


WHOLE = "[" + ", ".join(f"(('0x' || substr(md5('{k}|' || token), 1, 6))::bigint % 1000)" for k in range(17)) + "]"


@R.query(
    f"with tok as (select doc_id, unnest({TOKENS.format('text')}) as token from documents where text is not null), t as (select token, {WHOLE} as row from (select distinct token from tok) where {HAS}), "
    "x as (select doc_id, unnest(row) as z, unnest(range(17)) as pos from tok join t using (token)), m as (select doc_id, pos, sum(z)::double / count(*) + 0.25 as z from x group by 1, 2), "
    "k as (select doc_id, pos, z from m qualify row_number() over (partition by doc_id order by z desc, pos) = 1) "
    "select d.doc_id, coalesce(k.pos, 0)::int as label, round(coalesce(k.z, 0.25), 6) as best from documents d left join k using (doc_id) where text is not null"
)
def score_documents(spark, d):
    """The table-scoring path: tokens, lookup of 17 columns, mean, bias, label. The table's values are whole numbers, so that sums are exact."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    num = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(k), F.col("token"))), 1, 6), 16, 10).cast("bigint")
    t = docs.select(F.explode(tokens("text")).alias("token")).distinct().where(num("has|") % 10 > 0)
    t = t.select("token", F.array(*[(num(f"{k}|") % 1000).cast("double") for k in range(17)]).alias("row"))
    return scoring.score(docs, t, [0.25] * 17).select("doc_id", "label", r6(F.array_max("logits")).alias("best"))
