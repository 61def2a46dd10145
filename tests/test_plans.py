"""Plans: filters and columns reach the scan, no Cartesian products, Python only where it is meant to be."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
#: Queries that call Python by design: models, metadata trees, MinHash bands, NFKC of names.
PYTHON = {"jsonld_articles", "near_dup_pairs", "near_dup_keep", "silver_sample"}
LLM = {f"p{i}" for i in range(1, 10)}


def plan(spark, name):
    return entry.queries()[name](spark, str(DATA))._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["word_count", "train_val_split", "batch_files", "work_stride", "contamination_overlap", "minimum_slice", "token_frequency", "macro_f1", "leave_one_source_out", "silver_sample", "domain_split", "manifest_verify", "near_dup_keep"])
def test_no_cartesian_product(spark, name):
    p = plan(spark, name).split("== Physical Plan ==")[-1]
    assert "CartesianProduct" not in p
    assert name in PYTHON or not any(x in p for x in ("ArrowEvalPython", "MapInArrow", "MapInPandas", "BatchEvalPython"))


def test_columns_and_filters_reach_the_scan(spark):
    p = plan(spark, "url_host").split("== Physical Plan ==")[-1]
    assert "ReadSchema: struct<url:string>" in p
    p = plan(spark, "unseen_sites").split("== Physical Plan ==")[-1]
    assert "EqualTo(split,heldout)" in p and "teacher_logits" not in p
    p = plan(spark, "corpus_summary").split("== Physical Plan ==")[-1]
    assert "text:string" not in p


def test_caps_are_pruned_before_the_shuffle(spark):
    p = plan(spark, "cap_per_cell").split("== Physical Plan ==")[-1]
    assert "WindowGroupLimit" in p


def test_every_query_is_registered_with_sql_or_by_design(spark):
    without = {n for n in entry.queries() if n not in entry.oracle_sql() and n.split("_")[0] not in LLM}
    assert without == {"near_dup_pairs", "near_dup_keep", "hashed_bigrams", "distilled_student", "svm_classifier", "language_id", "class_offset_calibration", "subword_tokens", "page_extraction", "silver_funnel", "silver_pool", "ablation_significance", "factor_tests"}


@pytest.mark.parametrize("name", ["train_val_split", "round_robin", "batch_files"])
def test_no_window_over_a_whole_language_or_site(spark, name):
    p = plan(spark, name).split("== Physical Plan ==")[-1]
    rows = [line for line in p.splitlines() if "Window" in line and "row_number" in line]
    assert rows and all("_b#" in line for line in rows)
