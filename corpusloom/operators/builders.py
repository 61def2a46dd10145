"""Corpus builders: pages of the web to a labelled pool, with a count after each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import contamination as ct
from corpusloom.operators import dedup as dd
from corpusloom.operators import sampling as sp
from corpusloom.operators import taxonomy as tn
from corpusloom.session import cut

#: Old language codes and what they are now.
LEGACY = {"in": "id", "iw": "he", "ji": "yi", "mo": "ro", "sh": "sr"}
FIRST_DAY, LEAST_CONFIDENCE, MOST_OVERLAP = "2024-01-01", 0.7, 0.3


def resolved_language(declared: Column, detected: Column, confidence: Column) -> Column:
    """The declared language if the detected one agrees; without a declared one the detected one from LEAST_CONFIDENCE on; else null."""
    low = F.lower(declared)
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEGACY.items() for x in kv]), low), low)
    return F.when(declared.isNotNull() & (declared != ""), F.when(code == detected, code)).when(confidence >= LEAST_CONFIDENCE, detected)


def silver_pool(pages: DataFrame, terms: DataFrame, reference: DataFrame, ref_id: str, seen: DataFrame | None = None, overrides: DataFrame | None = None, per_site: int = 5, per_cell: int = 50, id_col: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(pool, funnel) of extracted page records.

    In turn: one row a page; sites of `seen` and free access; a language; a day from FIRST_DAY up to the crawl's; a label by section or breadcrumb; enough
    words; the first of exact duplicates; less than MOST_OVERLAP of the n-grams in `reference`; caps a site in each cell of language and label,
    then a cell. The funnel has (place, step, n). Null fields fail the step that needs them; an empty table gives a funnel of zeros.
    """
    p = pages.groupBy(id_col).agg(F.min(F.struct(*[c for c in pages.columns if c != id_col])).alias("r")).select(id_col, "r.*")
    p = p.withColumn("lang", resolved_language(F.col("in_language"), F.col("lid_lang"), F.col("lid_conf")))
    day, crawl = F.try_to_date(tx.iso_date("date_published"), "yyyy-MM-dd"), F.try_to_date(F.substring("warc_date", 1, 10), "yyyy-MM-dd")
    names = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    labels = tn.label_articles(p.select(id_col, names("article_section").alias("s"), names("breadcrumb").alias("b"), "lang"), terms, id_col, "s", "b", "lang", overrides)
    p = p.join(labels.withColumnRenamed("reason", "label_source"), id_col)
    if seen is not None:
        p = p.join(F.broadcast(seen.select("domain").where("domain is not null").distinct().withColumn("_seen", F.lit(True))) if seen.count() <= 1_000_000 else seen.select("domain").distinct().withColumn("_seen", F.lit(True)), "domain", "left")
    else:
        p = p.withColumn("_seen", F.lit(None).cast("boolean"))
    tests = {
        "site": F.col("_seen").isNull(),
        "free": ~F.coalesce(F.lower(F.col("is_free").cast("string")), F.lit("")).isin("false", "0"),
        "language": F.col("lang").isNotNull(),
        "date": F.coalesce(day.between(F.lit(FIRST_DAY).cast("date"), crawl), F.lit(False)),
        "label": F.col("label").isNotNull(),
        "length": F.coalesce(tx.long_enough("text", "lang"), F.lit(False)),
    }
    passed, all_of = [], F.lit(True)
    for test in tests.values():
        all_of = all_of & test
        passed.append(all_of)
    p = cut(p.withColumn("_passed", sum((x.cast("int") for x in passed), F.lit(0))).drop("_seen"))
    first = p.agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col("_passed") > i).alias(k) for i, k in enumerate(tests)]).first()
    kept = p.where(F.col("_passed") == len(tests)).drop("_passed")
    single = cut(dd.exact_dedup(kept, [sp.hash_order("0", id_col), F.col(id_col)]))
    overlap = ct.overlap(single, reference.where(F.col(ref_id).isNotNull()), id_col, ref_id).select(id_col, F.col("overlap").alias("train_overlap"))
    clean = cut(single.join(overlap, id_col).where(F.col("train_overlap") < MOST_OVERLAP))
    pool = cut(sp.two_level_cap(clean, ["lang", "label", "domain"], per_site, ["lang", "label"], per_cell, id_col))
    steps = [*first.asDict().items(), ("exact duplicates", single.count()), ("overlap", clean.count()), ("caps", pool.count())]
    funnel = pages.sparkSession.createDataFrame([(i, k, n) for i, (k, n) in enumerate(steps)], "place int, step string, n bigint")
    return pool, funnel
