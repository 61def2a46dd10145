"""Every query of the reference's operators against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
LLM = {"p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9"}
NAMES = [n for n in entry.queries() if n.split("_")[0] not in LLM]


def cell(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or hasattr(x, "dtype") and not hasattr(x, "__len__"):
        return repr(round(float(x), 5) + 0.0)
    if hasattr(x, "__len__") and not isinstance(x, str):
        return str([cell(y) for y in x])
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


#: What must hold for the results of queries without SQL; brute-force comparisons are in test_operators.py.
CHECKS = {
    "near_dup_pairs": lambda d: all(r.a < r.b and 0.7 <= r.jaccard <= 1 for r in d) and len({(r.a, r.b) for r in d}) == len(d),
    "near_dup_keep": lambda d: len({r.doc_id for r in d}) == len(d) and 0 < sum(r.kept for r in d) < len(d),
    "hashed_bigrams": lambda d: all(None not in r for r in d),
    "distilled_student": lambda d: all(r.n > 0 and 0 <= r.agreement <= 1 for r in d) and max(r.agreement for r in d) > 0.5,
    "svm_classifier": lambda d: all(r.n > 0 and 0 <= r.accuracy <= 1 and -1e4 < r.score < 1e4 for r in d),
    "language_id": lambda d: sum(r.n for r in d if r.lang == r.lid_lang) > 0.9 * sum(r.n for r in d if r.lang),
    "class_offset_calibration": lambda d: [r["class"] for r in d] == list(range(17)) and all(0 < r.macro_f1 <= 1 and 0 < r.macro_f1_out_of_fold <= 1 for r in d),
    "subword_tokens": lambda d: all(0 < r.n <= 512 and 0 <= r.least <= r.largest for r in d),
    "silver_funnel": lambda d: len(d) == 10 and [r.n for r in sorted(d, key=lambda r: r.place)] == sorted((r.n for r in d), reverse=True),
    "silver_pool": lambda d: all(0 < r.n <= 50 and 0 < r.sites <= r.n and r.most_overlap < 0.3 for r in d),
    "ablation_significance": lambda d: all(r.p is None or 0 <= r.p <= r.p_holm <= 1 for r in d) and sum(r.p is None for r in d) == 1,
    "factor_tests": lambda d: len(d) == 7 and all(0 <= r.p <= r.p_holm <= 1 for r in d),
    "page_extraction": lambda d: {r.text_source for r in d} >= {"main text"} and all(r.n >= r.sites > 0 and r.words > 0 for r in d),
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    data = got.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert data and CHECKS[name](data)
        return
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, data) == rows(columns, want.fetchall())
