"""Registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.boilerplate import boilerplate_lines
from corpusloom.llm.byte_bpe import encode_texts
from corpusloom.llm.canonical import map_values, reference_forms
from corpusloom.llm.leakage import leaked_passages
from corpusloom.llm.near_duplicates import near_duplicate_groups
from corpusloom.llm.packing import pack, pack_report
from corpusloom.llm.quota_sample import LABEL_TREE, LANGUAGE_TREE, quota_report, quota_sample
from corpusloom.llm.residue import residue_documents
from corpusloom.llm.segment_join import split_links, split_overlap


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    forms = reference_forms(_t(spark, d, "mapping_table"), _t(spark, d, "section_names_en"))
    return map_values(_t(spark, d, "section_values"), forms, "value_id", "section_name")


def p1_misses(spark: SparkSession, d: str) -> DataFrame:
    """The names that stand for no entry, with how many values have them."""
    found = p1_found(spark, d).where("entry = '(unmatched)'").select("value_id")
    return _t(spark, d, "section_values").join(found, "value_id").groupBy("section_name").agg(F.count_distinct("value_id").alias("n_values"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap(_t(spark, d, "articles"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: overlapping pairs, evaluation articles in them, and all its articles."""
    a = _t(spark, d, "articles").where("split in ('dev', 'heldout', 'test')").select("article_id", "split", "source").distinct()
    pairs = split_overlap(_t(spark, d, "articles")).select(F.explode(F.array("article_id_a", "article_id_b")).alias("article_id"), F.struct("article_id_a", "article_id_b").alias("pair"))
    hits = a.join(pairs.groupBy("article_id").agg(F.count("pair").alias("n")), "article_id", "left")
    return hits.groupBy("split", "source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("n").alias("overlapping_articles"), F.count(F.lit(1)).alias("articles"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """One row for each overlapping article: its class of equal texts and its number of links."""
    return split_links(_t(spark, d, "articles"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaked_passages(_t(spark, d, "documents"), _t(spark, d, "unified_test"), "doc_id", "doc_id")
    return found.selectExpr("doc as doc_id", "item as test_doc_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(_t(spark, d, "documents")).selectExpr("first as first_doc_id", "id as doc_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate_lines(_t(spark, d, "extracted_pages"))


FIELDS = {"lang": LANGUAGE_TREE, "gpt_label_id": LABEL_TREE}


def _train(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "articles").where("split = 'train'").select("article_id", *FIELDS)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return quota_report(_train(spark, d), _t(spark, d, "sample_targets"), FIELDS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_report(spark, d).where("short").select("field_name", "category")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    train, report = _train(spark, d), p6_report(spark, d)
    a, b = (quota_sample(train, report, f) for f in FIELDS)
    return a.unionByName(b)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(_t(spark, d, "documents"), "doc_id", tokenizer="byte_bpe_50k")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(_t(spark, d, "documents"), _t(spark, d, "pack_specs"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    specs = _t(spark, d, "pack_specs")
    return pack_report(pack(_t(spark, d, "documents"), specs), specs)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_documents(_t(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_misses, p2_found, p2_report, p2_links, p3_found, p4_found, p5_found, p6_found, p6_report, p6_sample, p7_ids, p8_packing, p8_report, p9_found)
}
SQL: dict[str, str] = {
    "p6_found": """
        with c as (
          select 'lang' as field_name, lang as category, article_id from articles where split = 'train' and lang is not null
          union all
          select 'gpt_label_id', cast(gpt_label_id as varchar), article_id from articles
          where split = 'train' and gpt_label_id is not null and gpt_label_id <> -1),
        k as (select field_name, category, count(distinct article_id) as n from c group by 1, 2),
        t as (select field_name, cast(floor(sum(n) / 2) as bigint) as n from k group by 1)
        select s.field_name, s.category from sample_targets s
        left join k on k.field_name = s.field_name and k.category = s.category
        left join t on t.field_name = s.field_name
        where coalesce(k.n, 0) < greatest(s.min_rows, cast(ceil(s.target_permille * coalesce(t.n, 0) / 1000.0) as bigint))""",
}
