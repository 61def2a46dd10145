"""Hand-made cases: nulls, empty tables, ties, long texts, clashing columns, and the semantics the tables do not exercise."""

import gzip
import json
from pathlib import Path
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import contamination, dedup, jsonld, metrics, models, sampling, stats, taxonomy, vectors
from corpusloom.sources import bounded, files
from corpusloom.streaming import scoring


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


def test_words_and_truncation(spark):
    assert one(spark, tx.word_count("t"), t=None) == 0
    assert one(spark, tx.word_count("t"), t=" a\tb\n\nc ") == 3
    assert one(spark, tx.truncate_words("t", 2), t=" a  b c") == "a b"
    assert len(one(spark, tx.truncate_for_lang("t", "l"), t="字" * 3000, l="zh")) == 2000
    assert one(spark, tx.long_enough("t", "l"), t="w " * 75, l="en") is True
    assert one(spark, tx.long_enough("t", "l"), t="字" * 199, l="ja") is False
    assert one(spark, tx.long_enough("t", "l"), t=None, l=None) is False


def test_title_merge(spark):
    assert one(spark, tx.merge_title("t", "b"), t="T", b="body") == "T\n\nbody"
    assert one(spark, tx.merge_title("t", "b"), t="None", b="body") == "body"
    assert one(spark, tx.merge_title("t", "b"), t="bo", b="body") == "body"
    assert one(spark, tx.merge_title("t", "b", False), t="None", b="body") == "None\n\nbody"


def test_parsers(spark):
    assert one(spark, tx.url_authority("u"), u="HTTPS://User@Ex.com:80/a") == "user@ex.com:80"
    assert one(spark, tx.url_authority("u"), u="no url") is None
    assert one(spark, tx.lang_code("u"), u="EN-us") == "en"
    assert one(spark, tx.lang_code("u"), u="english") is None
    assert one(spark, tx.iso_date("u"), u="on 2024-13-01x") == "2024-13-01"
    assert one(spark, tx.html_lang("u"), u="<!x><HTML data-a='1' lang='pt-BR'>") == "pt"


def test_ngrams_edges(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],), (None,)], "t array<string>")
    got = [r[0] for r in df.select(tx.ngrams(F.col("t"), 2)).collect()]
    assert got == [[], [], ["a b", "b c"], []]
    assert [r[0] for r in df.where("t is not null").select(tx.shingles(F.col("t"), 2)).collect()] == [[], ["a"], ["a b", "b c"]]


def test_caps_and_splits(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(60)], "id int, g string")
    assert sampling.cap(df, ["g"], 7, "id").groupBy("g").count().select("count").distinct().collect()[0][0] == 7
    small = sampling.cap(df.repartition(1), ["g"], 7, "id").select("id")
    many = sampling.cap(df.repartition(16), ["g"], 7, "id").select("id")
    assert sorted(small.collect()) == sorted(many.collect())
    assert sampling.repeat_to(df.select("id").limit(0), 10, "id").count() == 0
    assert sorted(r.place for r in sampling.repeat_to(df.select("id").where("id < 4"), 10, "id").collect()) == list(range(10))
    ids = [r.uid for r in sampling.sequential_ids(df, "id", "uid").collect()]
    assert sorted(ids) == [f"u{i:05d}" for i in range(60)]
    held = sampling.hold_out_groups(spark.createDataFrame([("x", "a", 5), ("x", "b", 5)], "p string, g string, n int"), "p", "g", "n", 0.5)
    assert held.where("held_out").count() == 0


def test_macro_f1_only_over_reference_labels(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 5), (None, 1)], "y int, p int")
    s = metrics.scores(metrics.confusion_counts(df)).first()
    assert s.n == 4 and s.accuracy == 0.5
    assert s.macro_f1 == pytest.approx((2 / 3 + 2 / 4) / 2)
    assert metrics.scores(metrics.confusion_counts(df.limit(0))).count() == 0


def test_leave_one_out_equals_filter(spark):
    df = spark.createDataFrame([(i % 3, i % 2, (i * 7) % 2) for i in range(30)], "g int, y int, p int")
    counts = metrics.confusion_counts(df, groups=["g"])
    loo = {(r.left_out, r.y, r.p): r.n for r in metrics.leave_one_out_counts(counts, "g", ["y", "p"]).collect()}
    for g in range(3):
        for r in metrics.confusion_counts(df.where(F.col("g") != g)).collect():
            assert loo[g, r.y, r.p] == r.n


def test_holm_is_monotone_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, 1.0)], "id int, p double")
    got = {r.id: r.p_holm for r in stats.holm(df).collect()}
    assert got[1] == pytest.approx(0.04) and got[3] == pytest.approx(0.09) and got[2] == pytest.approx(0.09) and got[4] is None and got[5] == 1.0


def test_tests_of_pairs(spark):
    r = stats.mcnemar(spark.createDataFrame([(1, 1, 1, 5)], "y int, pa int, pb int, n int")).first()
    assert (r.only_a, r.only_b, r.p) == (0, 0, 1.0)
    r = stats.mcnemar(spark.createDataFrame([(1, 1, 0, 8), (1, 0, 1, 1)], "y int, pa int, pb int, n int")).first()
    assert r.p == pytest.approx(2 * 10 / 512)
    d = spark.createDataFrame([(x,) for x in (0.0, 0.0, 0.1, -0.1)], "diff double")
    assert stats.paired_summary(d).first().p == 1.0


def test_distribution_functions():
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.chi2_upper(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert stats.normal_two_sided(1.96) == pytest.approx(0.05, abs=1e-4)
    assert stats.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1000.0, 1000.0]), (2, [1.0, 3.0]), (3, None), (4, [])], "id int, v array<double>")
    got = {r.id: (r.s, r.a, r.b) for r in df.select("id", vectors.softmax("v").alias("s"), vectors.argmax("v").alias("a"), vectors.second_best("v").alias("b")).collect()}
    assert got[1] == ([0.5, 0.5], 0, 1)
    assert got[2][1:] == (1, 0) and math.isclose(sum(got[2][0]), 1)
    assert got[3] == (None, None, None)
    q = {r.id: r.q for r in df.where("id < 3").select("id", vectors.quantise("v").alias("q")).collect()}
    assert list(q[2].q) == [42, 127]


def test_fold_equals_unfolded(spark):
    table = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -1.0])], "token string, row array<double>")
    head = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.5, -1.0])], "label int, w array<double>")
    tok = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "zz")], "doc int, token string")
    folded = vectors.fold_head(table, head, "token", "row", "label", "w").withColumnRenamed("row", "r")
    direct = {(r.doc, r.pos): r.x for r in vectors.pool(tok, table, "doc", "token", "row", 2).collect()}
    after = {(r.doc, r.pos): r.x for r in vectors.pool(tok, folded, "doc", "token", "r", 2).collect()}
    assert after[1, 0] == pytest.approx(direct[1, 0] + direct[1, 1]) and after[1, 1] == pytest.approx(0.5 * direct[1, 0] - direct[1, 1])


def test_greedy_keep_is_not_components(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, rank int")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert {r.id: r.kept for r in dedup.greedy_keep(nodes, pairs).collect()} == {"a": True, "b": False, "c": True, "d": True}


def test_near_pairs_and_exact(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en"), (2, base, "en"), (3, base + " more", "en"), (4, "other words only here", "en"), (5, None, None), (6, "", "en")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = [(r.a, r.b) for r in dedup.near_pairs(df, "doc_id").collect()]
    assert got == [(1, 3)]
    kept = {r.doc_id for r in dedup.exact_dedup(df, [F.col("doc_id")]).collect()}
    assert kept == {1, 3, 4, 5, 6}
    assert dedup.near_pairs(df.limit(0), "doc_id").count() == 0


def test_contamination_edges(spark):
    ref = spark.createDataFrame([(1, "a b c d e f g h i", "en"), (2, None, None)], "rid int, text string, lang string")
    docs = spark.createDataFrame([(1, "a b c d e f g h", "en"), (2, "short", "en"), (3, None, "en"), (4, "x b c d e f g h i", "en")], "doc_id int, text string, lang string")
    got = {r.doc_id: r.overlap for r in contamination.overlap(docs, ref, "doc_id", "rid").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.5}


def test_sections(spark):
    terms = spark.createDataFrame([("sport", "n", "sport"), (None, "", "region"), ("health", "m", "asayiş")], "label string, node string, term string")
    names = [("Sport",), ("Latest Sport",), ("x" * 41,), ("Region",), (None,), ("",), ("«SPORT»",), ("ASAYİŞ",)]
    df = spark.createDataFrame(names, "name string").withColumn("lang", F.lit("en"))
    got = {r.name: r.label for r in taxonomy.map_sections(df, terms, None, "name", "lang").collect()}
    assert got == {"Sport": "sport", "Latest Sport": "sport", "x" * 41: None, "Region": None, None: None, "": None, "«SPORT»": "sport", "ASAYİŞ": "health"}
    assert df.limit(1).select(taxonomy.normalise(F.lit("ＳＰＯＲＴ"))).first()[0] == "sport"
    bad = spark.createDataFrame([("a", "1", "t"), ("b", "2", "t"), (None, "", "t"), ("a", "1", "Upper")], "label string, node string, term string")
    assert {r.problem for r in taxonomy.validate_terms(bad).collect()} == {"mapped twice", "ambiguous and mapped", "not normalised"}


LD = '<script type = "application/ld+json">{}</script>'


def test_jsonld_cases(spark):
    art = {"@type": ["Thing", "NewsArticle"], "headline": "A &amp; <b>B</b>", "mainEntityOfPage": {"@id": "http://c"}, "author": [{"name": "X"}, "Y"], "keywords": ["a, b", "", {"name": "c"}], "articleBody": ["one", "<i>two</i>"], "url": [None, {"@value": "http://c"}]}
    crumbs = {"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "name": "two"}, {"position": "1", "item": {"name": "one"}}, {"name": "three"}]}
    poor = {"@type": "Article", "headline": "poor"}
    pages = [
        (1, "u1", LD.format(json.dumps({"@graph": [poor, art, crumbs]}))),
        (2, "u2", LD.format('{"@type": "Article", "headline": "tail",}')),
        (3, "u3", LD.format('{"@type": "Article", "headline": "con\x01trol"}')),
        (4, "u4", LD.format("{broken")),
        (5, "u5", LD.format('{"@type": "Product"}')),
        (6, "u6", None),
        (7, "u7", "<p>none</p>"),
    ]
    got = {r.page_id: r for r in jsonld.extract_articles(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].headline.split() == ["A", "&", "B"]
    assert got[1].canonical == "http://c" and got[1].author == ["X", "Y"] and got[1].keywords == ["a, b", "c"] and got[1].body == "one two" and got[1].breadcrumb == ["one", "two", "three"]
    assert got[2].headline == "tail" and got[2].canonical == "u2"
    assert jsonld.crumb_names(jsonld.things('{"itemListElement": [{"position": 2, "name": "B"}, {"name": "A"}]}')[:1]) == ["A", "B"]
    twins = '{"@type": "Article", "n": 1, "x": {"@type": "Article", "n": 2, "y": 3}, "z": {"@type": "Article", "n": 4, "y": 3}}'
    assert [t.fields["n"] for t in jsonld.things(twins)] == [1, 2, 4]
    assert {r.domain for r in jsonld.excluded_domains(spark.createDataFrame([("www.a.b",), (None,)], "domain string")).collect()} == {"www.a.b", "a.b"}


def test_files(spark, tmp_path):
    p = str(tmp_path / "x.jsonl.gz")
    with gzip.open(p, "wt", encoding="utf8") as f:
        f.write('{"document_id": "1", "text": "t", "label": "sport", "split": "dev"}\nnot json\n{"document_id": "2", "label": "odd", "split": "train"}\n')
    a = files.read_articles(spark, p, {"sport": 15})
    assert {(r.document_id, r.label_id) for r in a.collect()} == {("1", 15), ("2", None)}
    assert files.read_articles(spark, p, {"sport": 15}, "dev").count() == 1
    assert files.read_jsonl(spark, str(tmp_path / "absent*.jsonl"), "a int", missing_ok=True).count() == 0
    (tmp_path / "c.csv").write_text('LABELS,Text\nx,"a\nb"\ny,\n', encoding="utf8")
    assert [tuple(r) for r in files.read_labelled_csv(spark, str(tmp_path / "c.csv")).collect()] == [("x", "a\nb")]
    preds = spark.createDataFrame([("m", "s", "1", [0.5]), ("m", "t", "1", [0.1])], files.PREDICTION)
    files.write_predictions(preds, str(tmp_path / "p"))
    assert files.read_predictions(spark, str(tmp_path / "p"), "m", "t").count() == 1
    log = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 2.0)], "model string, line int, v double")
    files.append_log(log, str(tmp_path / "log"))
    files.append_log(log.withColumn("line", F.col("line") + 2), str(tmp_path / "log"))
    assert files.keep_last(spark.read.json(str(tmp_path / "log")), ["model"], "line").first().line == 4
    assert files.unfinished(log, log.where("line = 1"), ["model", "line"]).first().line == 2
    assert files.merge_best(log, spark.createDataFrame([("k", 9, 9.0)], log.schema), "model").count() == 1


def test_warc_and_bounded_stream(spark, tmp_path):
    def record(kind, uri, body):
        b = body.encode()
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-01\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"

    ok = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>ü</p>"
    data = record("request", "a", "GET") + record("response", "b", ok) + record("response", "c", ok.replace("200 OK", "404 NO")) + record("response", "d", ok.replace("text/html", "image/png"))
    (tmp_path / "w.warc.gz").write_bytes(gzip.compress(data) + b"broken tail")
    got = files.read_warc(spark, str(tmp_path / "*.warc.gz")).collect()
    assert [(r.uri, r.html) for r in got] == [("b", "<p>ü</p>")]
    bounded.register(spark)
    lines = "".join(json.dumps({"title": f"t{i}", "url": None}) + "\n" for i in range(100))
    (tmp_path / "s.json.gz").write_bytes(gzip.compress(lines.encode())[:-12])
    df = spark.read.format("bounded_jsonl").option("urls", str(tmp_path / "s.json.gz")).option("maxRecords", "7").load()
    assert [r.title for r in df.collect()] == [f"t{i}" for i in range(7)]


def test_language_identification(spark):
    text = {"en": "the cat and the dog are in the house with the man", "de": "der hund und die katze sind im haus mit dem mann und", "fr": "le chat et le chien sont dans la maison avec les"}
    train = spark.createDataFrame([(k, v) for k, v in text.items()], "lang string, text string")
    test = spark.createDataFrame([(1, "the man and the cat"), (2, "der mann und die katze"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.lid_lang for r in models.identify_language(test, models.language_profiles(train), "id").collect()}
    assert got[1] == "en" and got[2] == "de" and 3 not in got


def test_scorer_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb"), (2, None), (3, "")], "doc_id int, text string")
    z = {r.doc_id: list(r.logits) for r in models.predict_batches(docs, lambda ts: [[len(t), 0.0] for t in ts], "doc_id").collect()}
    assert z == {1: [5.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    table = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [0.0, 4.0])], "token string, row array<double>")
    docs.write.parquet(str(tmp_path / "in"))
    scoring.score_stream(spark, str(tmp_path / "in"), "doc_id int, text string", table, [0.5, 0.0], str(tmp_path / "out"), str(tmp_path / "cp"))
    scoring.score_stream(spark, str(tmp_path / "in"), "doc_id int, text string", table, [0.5, 0.0], str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.doc_id: (r.label, list(r.logits)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (1, [1.0, 2.0]), 2: (0, [0.5, 0.0]), 3: (0, [0.5, 0.0])}


def test_model_store_and_cache(spark, tmp_path):
    t = spark.createDataFrame([("a", [1.0])], "token string, row array<double>")
    files.write_model(t, {"bias": [0.5], "labels": ["é"]}, str(tmp_path / "m"))
    got, meta = files.read_model(spark, str(tmp_path / "m"))
    assert got.first().token == "a" and meta == {"bias": [0.5], "labels": ["é"]}
    built = []
    for _ in range(2):
        assert files.cached_table(spark, str(tmp_path / "c"), lambda: built.append(1) or t).count() == 1
    assert built == [1]


def test_class_offsets_raise_macro_f1(spark):
    rows = [(0, [1.0, 0.9]), (0, [1.0, 0.0]), (1, [0.5, 0.3]), (1, [0.6, 0.3]), (1, [0.0, 1.0]), (None, [0.0, 1.0]), (1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, y int, z array<double>")
    off = list(models.class_offsets(df, "id", "y", "z", 2)[0])
    f = lambda o: metrics.scores(metrics.confusion_counts(df.where("y is not null and z is not null").withColumn("p", vectors.argmax(F.zip_with("z", F.array(*map(F.lit, o)), lambda a, b: a + b))))).first().macro_f1
    assert f(off) > f([0.0, 0.0])


def test_page_extraction(spark):
    long = " ".join(f"w{i}" for i in range(40))
    art = lambda **k: LD.format(json.dumps({"@type": "NewsArticle", "headline": "h", **k}))
    page = '<html class="a" lang = "de-DE"><body><nav><a href="/">Home page</a></nav><article><p>Main &amp; text of the page.</p><p><a>all of it a link</a></p></article><p>Footer</p>{}</body></html>'
    rows = [
        (1, "http://a.x/1", page.format(art(articleBody=long, inLanguage="en-US", url="http://a.x/c"))),
        (2, "http://a.x/2", page.format(art(articleBody="teaser"))),
        (3, "http://a.x/c", page.format(art(articleBody=long))),
        (4, "http://www.bad.x/4", page.format(art(articleBody=long))),
        (5, "http://a.x/5", art(articleBody="")),
        (6, None, None),
    ]
    got = {r.page_id: r for r in jsonld.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string"), spark.createDataFrame([("bad.x",)], "domain string")).collect()}
    assert set(got) == {1, 2}
    assert got[1].n_words == 40 and got[1].lang == "en" and got[1].html_lang == "de" and got[1].text_source == "articleBody"
    assert got[2].text == "Main & text of the page." and got[2].text_source == "main text" and got[2].domain == "a.x"
    assert jsonld.main_text(None) == "" and jsonld.main_text("<p>a<br>b</p>") == "a\nb"


def test_deep_trees_and_nodes(spark):
    chain = spark.createDataFrame([(i, str(i), i - 1 if i else None) for i in range(24)] + [(90, "x", 91), (91, "y", 90)], "id bigint, name string, parent bigint")
    got = {r.id: r.depth for r in taxonomy.tree_paths(chain).collect()}
    assert got == {i: i + 1 for i in range(24)}
    terms = spark.createDataFrame([("a", "1", "t"), ("a", "2", "u"), ("b", "3", "v"), ("b", "4", "w")], "label string, node string, term string")
    nodes = spark.createDataFrame([(1, "n", None, "top a", False), (2, "n", None, "top b", False), (3, "n", None, "top b", True)], "id bigint, name string, parent bigint, top_name string, retired boolean")
    tops = spark.createDataFrame([("a", "top a"), ("b", "top b")], "label string, top_name string")
    assert {tuple(r) for r in taxonomy.validate_terms(terms, nodes, tops).collect()} == {("node missing or retired", "3"), ("node missing or retired", "4"), ("node under another top", "2")}


def test_scoring_by_matrix_and_by_join(spark):
    from corpusloom.streaming import scoring

    docs = spark.createDataFrame([(1, "a b a zz"), (2, ""), (3, None), (4, "zz")], "doc_id int, text string")
    t = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [4.0, 0.0]), (None, [9.0, 9.0])], "token string, row array<double>")
    want = {1: (1, [2.5, 2.0]), 2: (0, [0.5, 0.0]), 3: (0, [0.5, 0.0]), 4: (0, [0.5, 0.0])}
    want[1] = (0, [2.5, 2.0])
    for most in (0, 10):
        assert {r.doc_id: (r.label, r.logits) for r in scoring.score(docs, t, [0.5, 0.0], most_rows=most).collect()} == want
    assert {r.label for r in scoring.score(docs, t.limit(0), [0.5, 0.0]).collect()} == {0}


def test_long_chains_settle(spark):
    n = 230
    nodes = spark.createDataFrame([(i, f"{i:04d}") for i in range(n)], "id int, rank string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 12)], "a int, b int")
    kept = {r.id: r.kept for r in dedup.greedy_keep(nodes, pairs).collect()}
    assert [kept[i] for i in range(13)] == [i % 2 == 0 for i in range(13)] and kept[n - 1]


def test_cuts_are_released(spark):
    from corpusloom import session

    t = session.cut(spark.range(3))
    path = session._CUTS[-1]
    assert t.count() == 3 and files.exists(spark, path)
    assert session.release(spark) >= 1 and not session._CUTS and not files.exists(spark, path)


def test_subword_ids():
    pytest.importorskip("tokenizers")
    from corpusloom.operators import subword

    assert subword.truncate_and_drop([5, 0, 7, 8], 3, 0) == [5, 7]
    assert subword.truncate_and_drop([], 3, None) == subword.truncate_and_drop([0], 3, 0) == [0]


def test_subword_ids_of_rows(spark):
    pytest.importorskip("tokenizers")
    from corpusloom.operators import subword

    if not Path(subword.FOLDER, "word_bpe_49k.json").exists():
        pytest.skip("no vocabularies")
    rows = [(1, "Hello world, hello"), (2, ""), (3, None), (None, "hello"), (1, "Hello world, hello")]
    got = subword.subword_ids(spark.createDataFrame(rows, "id int, text string"), "id", most=3).collect()
    assert sorted((r.id or 0, len(r.ids)) for r in got) == [(0, 1), (1, 3), (1, 3), (2, 1), (3, 1)]
    assert [r.ids for r in got if r.id in (2, 3)] == [[0], [0]]
    some = next(r.ids for r in got if r.id == 1)
    for known in ([some[0]], [some[0], *range(-200, -1)]):
        kept = subword.known_ids(spark.createDataFrame([(1, some), (2, some[1:2])], "id int, ids array<int>"), known).collect()
        assert {r.id: r.ids for r in kept} == {1: [x for x in some if x == some[0]], 2: [0] if some[1] != some[0] else [some[0]]}


def test_offsets_raise_macro_f1(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 300)
    z = np.eye(3)[y] * 0.6 + rng.normal(0, 0.3, (300, 3)) - np.array([0.0, 0.4, 0.0])
    df = spark.createDataFrame([(int(i), int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, z))], "id int, y int, z array<double>")
    off, before, after = models.class_offsets(df, "id", "y", "z", 3)
    assert after > before and off[1] > 0
    assert models.class_offsets(df.limit(0), "id", "y", "z", 3)[1:] == (0.0, 0.0)


def test_ranks_and_p_values(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = [float(v) for v in rng.integers(0, 40, 500)]
    got = {(r.x, r.r) for r in stats.with_ranks(spark.createDataFrame([(v,) for v in x], "x double"), "x", "r").collect()}
    order = np.sort(x)
    assert got == {(v, (np.searchsorted(order, v) + np.searchsorted(order, v, "right") + 1) / 2) for v in x}
    assert stats.with_ranks(spark.createDataFrame([], "x double"), "x", "r").count() == 0
    assert stats.wilcoxon_p(3, 0) == 0.25 and stats.wilcoxon_p(0, 0) == 1.0 and abs(stats.wilcoxon_p(60, 915.0) - 1) < 1e-9
    assert abs(stats.chi2_upper(3.0, 2) - math.exp(-1.5)) < 1e-12 and stats.spearman_p(1.0, 9) == 0.0
    assert abs(stats.spearman_p(0.5, 27) - stats.t_two_sided(0.5 * math.sqrt(25 / 0.75), 25)) < 1e-15
    assert [round(v, 9) for v in stats.holm_list([0.04, 0.01, 0.03])] == [0.06, 0.03, 0.06]
    rows = [("base", v) for v in (1.0, 2.0, 3.0)] + [("same", v) for v in (1.0, 2.0, 3.0)] + [("far", v) for v in (11.0, 12.0, 13.0)] + [("one", 5.0), (None, 1.0)]
    r = {x.code: x for x in stats.against_base(spark.createDataFrame(rows, "code string, v double"), "code", "base", "v").collect()}
    assert abs(r["same"].p - 1) < 1e-12 and r["far"].p_holm < 0.001 and abs(r["far"].dof - 4) < 1e-9 and r["one"].p is None and r["base"].p is None


def test_silver_pool(spark):
    from corpusloom.operators import builders

    long = lambda tag: " ".join(f"{tag}{i}" for i in range(80))
    ok = dict(in_language="en", lid_lang="en", lid_conf=0.9, domain="new.x", is_free=None, date_published="2024-05-01T10:00", warc_date="2024-06-01", article_section='["Sport"]', breadcrumb=None, text=long("a"))
    cases = [ok, {**ok, "domain": "old.x"}, {**ok, "is_free": "False"}, {**ok, "lid_lang": "de"}, {**ok, "date_published": "2023-05-01"}, {**ok, "article_section": None}, {**ok, "text": "short"}, ok, {**ok, "text": long("seen")}]
    schema = "page_id int, in_language string, lid_lang string, lid_conf double, domain string, is_free string, date_published string, warc_date string, article_section string, breadcrumb string, text string"
    pages = spark.createDataFrame([(i, *c.values()) for i, c in enumerate(cases)], schema)
    terms = spark.createDataFrame([("sport", "1", "sport")], "label string, node string, term string")
    ref = spark.createDataFrame([(1, long("seen"), "en"), (None, "x", "en")], "ref int, text string, lang string")
    pool, funnel = builders.silver_pool(pages, terms, ref, "ref", spark.createDataFrame([("old.x",), (None,)], "domain string"))
    assert [r.n for r in funnel.orderBy("place").collect()] == [9, 8, 7, 6, 5, 4, 3, 2, 1, 1]
    r = pool.collect()
    assert len(r) == 1 and r[0].page_id in (0, 7) and r[0].label == "sport" and r[0].label_source == "section" and r[0].train_overlap == 0.0
    pool, funnel = builders.silver_pool(pages.limit(0), terms, ref, "ref")
    assert pool.count() == 0 and {r.n for r in funnel.collect()} == {0}


def test_svm_of_the_classes_that_occur(spark):
    texts = {0: "ball goal team match", 2: "vote party law minister", 5: "rain wind storm cloud"}
    rows = [(i, texts[k] + f" extra{i % 7}", k) for i, k in enumerate([0, 2, 5] * 12)] + [(99, "nothing", None)]
    docs = models.features(spark.createDataFrame(rows, "id int, text string, y int"), bits=8)
    m = models.train_svm(docs, "y", 5)
    assert sorted(m) == [0, 2, 5]
    got = models.svm_scores(m, docs.where("y is not null"), 6).select("y", "scores").collect()
    assert all(max(range(6), key=lambda k: r.scores[k]) == r.y and r.scores[1] == models.MISSING for r in got)
    one = models.train_svm(docs.where("y = 2"), "y", 5)
    assert models.svm_scores(one, docs, 3).first().scores == [models.MISSING, models.MISSING, 0.0]
