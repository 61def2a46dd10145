"""The training-data operators against brute force, libraries, round trips and hand-made cases."""

import functools
import html
import itertools
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bitmap, boilerplate, byte_bpe, canonical, leakage, near_duplicates, packing, quota_sample, residue, segment_join, wordkernel
from corpusloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "&amp;co don’t", "ＦＵＬＬ width ½ ²", "x\x1ey​z", "Σίσυφος ΣΑΣ", "中文 字，符", "İstanbul ıŞık", "é́", "a" * 5000, "\U0001f600 ok"]


@functools.cache
def sign(c):
    return " " if unicodedata.category(c)[0] in "PS" else c


def words(text, lang):
    t = "".join(map(sign, unicodedata.normalize("NFKC", html.unescape(text)).lower()))
    return [c for c in t if not c.isspace()] if lang in ("zh", "ja") else t.split()


def run_set(text, lang):
    w, k = words(text, lang), 10 if lang in ("zh", "ja") else 5
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def alike(a, b):
    both = len(a & b)
    return both and both >= 0.7 * (len(a) + len(b) - both)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- words, filter, components ---


@pytest.mark.parametrize("lang", ["en", "zh", None])
def test_words_equal_plain_python(lang):
    texts = [*ODD, None]
    h, o = wordkernel.word_hashes(texts, [lang] * len(texts))
    want = [words(t or "", lang) for t in texts]
    assert np.diff(o).tolist() == [len(w) for w in want]
    by_word, flat = {}, [w for x in want for w in x]
    for w, v in zip(flat, h.tolist()):
        assert by_word.setdefault(w, v) == v
    assert len(set(by_word.values())) == len(by_word)


def test_runs_stay_inside_texts():
    h, o = wordkernel.word_hashes(["a b c", "a b", "b c a b c"], ["en"] * 3)
    r, ro = wordkernel.runs(h, o, 3)
    assert np.diff(ro).tolist() == [1, 0, 3] and r[0] == r[3]


def test_filter_never_drops(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64)
    bits = bitmap.build(spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "k bigint"), "k", 14)
    assert bitmap.contains(bits.value, keys.view(np.uint64)).all()
    empty = bitmap.build(spark.createDataFrame([], "k bigint"), "k", 14)
    assert not bitmap.contains(empty.value, keys.view(np.uint64)).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b"), "node", "root"))
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


# --- p1 ---


def reference(spark):
    m = spark.createDataFrame([("crime", "weather forecast; police blotter; house & garden"), ("sport", "sport; fußballbundesliga"), ("(not mapped: ambiguous)", "region")], "label string, section_names string")
    g = spark.createDataFrame([("fußballbundesliga", "football league"), ("region", "district")], "section_name string, gloss_en string")
    return canonical.reference_forms(m, g)


def test_canonical_names(spark):
    cases = {
        "Weather  FORECAST": "weather forecast", "forecast, weather": "weather forecast", "wether forecsat": "weather forecast", "Home > weather forecast | News": "weather forecast",
        "house &amp; garden": "house & garden", "House and Garden": "house & garden", "ｈｏｕｓｅ＆ｇａｒｄｅｎ": "house & garden", "FUSSBALLBUNDESLIGA": "fußballbundesliga", "Football League page": "fußballbundesliga",
        "sprt": "(unmatched)", "Region": "(unmatched)", "district": "(unmatched)", "passport": "(unmatched)", "news": "(unmatched)", "weatherforecast": "weather forecast", "x" * 9000: "(unmatched)",
    }
    rows = [(i, n, "z") for i, n in enumerate(cases)] + [(100, None, "z"), (101, "  \t", "z"), (None, "sport", "z"), (0, next(iter(cases)), "z")]
    got = dict(rows_of(canonical.map_values(spark.createDataFrame(rows, "value_id bigint, name string, entry string"), reference(spark), "value_id", "name"), "value_id", "entry"))
    assert got == {i: e for i, e in enumerate(cases.values())}
    none = canonical.map_values(spark.createDataFrame([(1, "sport")], "id int, n string"), spark.createDataFrame([], "form string, entry string, often bigint"), "id", "n")
    assert rows_of(none, "entry") == [("(unmatched)",)]


def test_distance_against_brute_force():
    @functools.cache
    def osa(a, b):
        if not a or not b:
            return len(a) + len(b)
        d = min(osa(a[:-1], b) + 1, osa(a, b[:-1]) + 1, osa(a[:-1], b[:-1]) + (a[-1] != b[-1]))
        return min(d, osa(a[:-2], b[:-2]) + 1) if len(a) > 1 and len(b) > 1 and a[-1] == b[-2] and a[-2] == b[-1] else d

    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in "ab")
        d = osa(a, b)
        assert canonical.weighted_distance(a, b, 3)[0] == (d if d <= 3 else 4)
        if d <= 2:
            assert canonical.deletes(a, 2) & canonical.deletes(b, 2)


# --- p2 ---


def test_banded_distance():
    rng = random.Random(5)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    pairs = [([rng.randrange(1, 4) for _ in range(rng.randrange(12))], [rng.randrange(1, 4) for _ in range(rng.randrange(12))]) for _ in range(300)]
    la, lb = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    ma, mb = (np.array([p[k] + [0] * (12 - len(p[k])) for p in pairs], np.uint64) for k in (0, 1))
    for band in (1, 3, 5):
        got = segment_join.banded_distance(ma, mb, la, lb, band)
        assert got.tolist() == [min(full(a, b), band + 1) for a, b in pairs]


def story(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def small_corpus(seed=1, n=40):
    """Texts with copies, edits, insertions, moved parts, shared phrases, null and empty ones."""
    rng = random.Random(seed)
    phrase, out = story(rng, 12), []
    for k in range(n):
        base = story(rng, rng.randrange(45, 160)) + phrase
        out.append(base)
        for kind in rng.sample(range(5), 2):
            w = list(base)
            if kind == 1:
                for _ in range(rng.randrange(1, 6)):
                    w[rng.randrange(len(w))] = "edit"
            elif kind == 2:
                at = rng.randrange(len(w))
                w[at:at] = story(rng, rng.randrange(1, len(w) // 3))
            elif kind == 3:
                at = rng.randrange(len(w))
                w = w[at:] + w[:at]
            elif kind == 4:
                w = w[: len(w) - rng.randrange(1, len(w) // 3)]
            out.append(w)
    texts = [" ".join(w) for w in out] + [None, "", "  ", "one two", "Ｏne two"]
    return [(i, t, "en") for i, t in enumerate(texts)] + [(len(texts), "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(300)), "zh")]


def test_segment_join_against_brute_force(spark):
    rows = [(i, t, lang, ("train", "dev", "test", None)[i % 4]) for i, t, lang in small_corpus()]
    rows += [(501, f"{rows[0][1]} {rows[0][1]} {rows[0][1]}", "en", "dev" if rows[0][3] == "train" else "train")]
    rows += [(500, rows[-2][1][:290], "zh", "train"), (rows[0][0], rows[0][1], "en", rows[0][3])]
    df = spark.createDataFrame(rows, "article_id bigint, text string, lang string, split string")
    sets = {i: (run_set(t, lang), s) for i, t, lang, s in rows if t}
    want = sorted({(min(a, b), max(a, b)) for a, b in itertools.permutations(sets, 2) if sets[a][1] == "train" and sets[b][1] in ("dev", "test") and alike(sets[a][0], sets[b][0])})
    assert want and rows_of(segment_join.split_overlap(df), "article_id_a", "article_id_b") == want
    assert segment_join.split_overlap(df.limit(0)).count() == 0


def test_short_text_against_a_longer_one_that_repeats_it(spark):
    text = " ".join(story(random.Random(16), 20))
    rows = [(1, text, "en", "test"), (2, " ".join([text] * 3), "en", "train")]
    df = spark.createDataFrame(rows, "article_id bigint, text string, lang string, split string")
    assert alike(run_set(text, "en"), run_set(rows[1][1], "en")) and rows_of(segment_join.split_overlap(df), "article_id_a", "article_id_b") == [(1, 2)]


# --- p3 ---


def test_leaked_passages(spark):
    rng = random.Random(9)
    item = story(rng, 200)
    other = lambda n: [f"x{rng.randrange(9000)}" for _ in range(n)]
    edited = list(item[50:110])
    for k in (9, 22, 35, 47):
        edited[k] = "changed"
    docs = {
        1: other(40) + item[20:60] + other(40), 2: other(30) + item[20:43] + other(30), 3: edited, 4: [w.upper() + "," for w in item], 5: other(100),
        6: sum(([w, "between"] for w in item[:60]), []), 7: item[100:112] + other(5) + item[112:130], 12: item[100:112] + other(3) + item[112:130],
    }
    zh = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(150))
    rows = [(i, " ".join(w), "en", "x") for i, w in docs.items()] + [(8, zh[30:100] + "另外", "zh", "x"), (9, zh[30:80], "zh", "x"), (10, None, "en", "x"), (11, "", "en", "x"), (1, " ".join(docs[1]), "en", "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, item string")
    t = spark.createDataFrame([("t", " ".join(item), "en"), ("t", " ".join(item), "en"), ("z", zh, "zh"), ("n", None, "en"), ("s", "too short", "en")], "doc_id string, text string, lang string")
    got = rows_of(leakage.leaked_passages(d, t, "doc_id", "doc_id"), "doc", "item")
    assert got == [(1, "t"), (3, "t"), (4, "t"), (8, "z"), (12, "t")]
    assert leakage.leaked_passages(d, t.limit(0), "doc_id", "doc_id").count() == 0
    assert leakage.leaked_passages(d.limit(0), t, "doc_id", "doc_id").count() == 0


def test_leaked_text_that_many_items_share(spark):
    rng = random.Random(11)
    shared = " ".join(story(rng, 80))
    items = spark.createDataFrame([(f"t{i}", shared + " " + " ".join(story(rng, 40)), "en") for i in range(30)], "doc_id string, text string, lang string")
    d = spark.createDataFrame([(1, "before " + shared, "en")], "doc_id bigint, text string, lang string")
    assert leakage.leaked_passages(d, items, "doc_id", "doc_id").count() == 30


def test_short_passage_between_the_items_own_text_that_many_items_share(spark):
    rng = random.Random(12)
    shared = {i: story(rng, n) for i, n in enumerate((24, 30, 40, 45))}
    own = lambda: [f"y{rng.randrange(10**6)}" for _ in range(60)]
    items = spark.createDataFrame([(f"t{i}-{j}", " ".join(own() + w + own()), "en") for i, w in shared.items() for j in range(12)], "doc_id string, text string, lang string")
    d = spark.createDataFrame([(i, " ".join(w), "en") for i, w in shared.items()], "doc_id bigint, text string, lang string")
    got = rows_of(leakage.leaked_passages(d, items, "doc_id", "doc_id"), "doc", "item")
    assert got == sorted((i, f"t{i}-{j}") for i in shared for j in range(12))


def holds_by_brute_force(doc, item, least=24):
    """A plain table for each start in both texts; the first and the last word of a passage are unchanged."""
    for s, d in itertools.product(range(len(item) - least + 1), range(len(doc))):
        if item[s] != doc[d]:
            continue
        row = list(range(len(doc) - d))
        for n, w in enumerate(item[s + 1 :], 2):
            last, row[0] = row[0], n - 1
            for j, x in enumerate(doc[d + 1 :], 1):
                if n >= least and x == w and 10 * last <= n:
                    return True
                last, row[j] = row[j], min(last + (x != w), row[j] + 1, row[j - 1] + 1)
            if min(row) > 8:
                break
    return False


def test_passage_verification_is_exact():
    item = np.arange(1, 61, dtype=np.uint64)
    for a, b in itertools.combinations(range(1, 23), 2):  # all placements of two changes inside 24 words
        doc = item[10:34].copy()
        doc[[a, b]] = 900, 901
        assert leakage.holds_passage(doc, item, 24)
    doc = item[:50].copy()
    doc[22:27] = np.arange(900, 905)
    assert leakage.holds_passage(doc, item, 24)
    rng, seen = random.Random(13), Counter()
    for _ in range(200):
        n, edits = rng.randrange(24, 50), rng.randrange(2, 8)
        item = [rng.randrange(1, 40) if rng.random() < 0.2 else 1000 + k for k in range(60)]
        doc = item[5 : 5 + n]
        for _ in range(edits):
            k = rng.randrange(len(doc))
            doc[k : k + 1] = rng.choice([[], [7000 + k], [doc[k], 8000 + k]])
        doc = [1, 2, *doc, 3]
        want = holds_by_brute_force(doc, item)
        seen[want] += 1
        assert leakage.holds_passage(np.array(doc, np.uint64), np.array(item, np.uint64), 24) == want
    assert min(seen.values()) > 20


def test_passages_with_edits_anywhere(spark):
    rng = random.Random(14)
    own = lambda n: [f"y{rng.randrange(10**6)}" for _ in range(n)]
    long, short, mid = own(500), own(24), own(30)
    docs = {1: [w if k % 10 else "changed" for k, w in enumerate(long)], 2: [w if k % 8 != 7 else "changed" for k, w in enumerate(mid)], 3: [w if k % 8 else "changed" for k, w in enumerate(long)]}
    for n, (a, b) in enumerate(itertools.combinations(range(1, 23), 2)):
        docs[100 + n] = own(10) + [w if k not in (a, b) else "changed" for k, w in enumerate(short)] + own(10)
    zh = [chr(0x4E00 + rng.randrange(3000)) for _ in range(300)]
    rows = [(i, " ".join(w), "en") for i, w in docs.items()] + [(4, "".join(c if k % 10 else "改" for k, c in enumerate(zh)), "zh")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    items = [("long", " ".join(long), "en"), ("short", " ".join(short), "en"), ("mid", " ".join(mid), "en"), ("zh", "".join(zh), "zh")]
    t = spark.createDataFrame(items, "doc_id string, text string, lang string")
    got = rows_of(leakage.leaked_passages(d, t, "doc_id", "doc_id"), "doc", "item")
    assert got == [(1, "long"), (2, "mid"), (3, "long"), (4, "zh")] + [(i, "short") for i in sorted(docs) if i >= 100]


def test_texts_are_read_once_for_all_blocks_and_copies_are_compared_once(spark):
    rng = random.Random(15)
    items = {f"t{i}": story(rng, 60) for i in range(12)}
    docs = {i: story(rng, 20) + items[f"t{i % 12}"][10:40] + story(rng, 20) for i in range(24)}
    t = spark.createDataFrame([(k + c, " ".join(w), "en") for k, w in items.items() for c in "ab"], "doc_id string, text string, lang string")
    d = spark.createDataFrame([(100 * c + i, " ".join(w) + "!" * c, "en") for i, w in docs.items() for c in range(4)], "doc_id bigint, text string, lang string")
    found = leakage.leaked_passages(d, t, "doc_id", "doc_id", block_words=150)
    assert rows_of(found, "doc", "item") == sorted((100 * c + i, f"t{i % 12}{x}") for i in docs for c in range(4) for x in "ab")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_surroundings_let_every_passage_through_and_few_templates():
    rng = np.random.default_rng(16)
    word = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    for least, width, size in ((24, leakage.TERM, leakage.FINE), (60, leakage.TERM_CJK, leakage.FINE_CJK)):
        around, looked = leakage.Around(least, width, size), 0
        for n in [*range(least, 2 * least + 4)] * 3:
            item, part = word(30 + n + 30), []
            edits = set(rng.choice(np.arange(1, n - 1), n // 10, replace=False).tolist())
            for k, w in enumerate(item[30 : 30 + n]):
                part += [[], word(1).tolist(), [int(w), *word(1).tolist()]][int(rng.integers(3))] if k in edits else [int(w)]
            doc = np.concatenate([word(int(rng.integers(40))), np.array(part, np.uint64), word(int(rng.integers(40)))])
            assert leakage.holds_passage(doc, item, least)
            at = {tuple(doc[d : d + width]): d for d in range(len(doc) - width + 1)}
            seeds = [(at[tuple(item[i : i + width])], i) for i in range(len(item) - width + 1) if tuple(item[i : i + width]) in at]
            seeds = [(d, i) for d, i in seeds if i == 0 or d == 0 or doc[d - 1] != item[i - 1]]
            looked += len(seeds)
            d, i = np.array(seeds).T
            assert around.passes(around.runs(doc), d, around.runs(item), i).any()
        assert looked > 100
        frame, texts = word(40), [word(600) for _ in range(2)]
        for x in texts:  # a template with a third of its words filled in
            x[: 14 * 40] = np.where(np.arange(40) % 12 < 8, frame, x[: 14 * 40].reshape(14, 40)).ravel()
        k = 40 * np.arange(4, 11)
        assert not around.passes(around.runs(texts[0]), k, around.runs(texts[1]), k).any()


# --- p4 ---


def groups_by_brute_force(rows, least=40, least_cjk=120):
    sets = {i: run_set(t, lang) for i, t, lang in rows if t and len(words(t, lang)) >= (least_cjk if lang in ("zh", "ja") else least)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if alike(sets[a], sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((find(i), i) for i in sets if find(i) != i)


def test_any_pair_in_the_radius_collides():
    for far in itertools.combinations(range(near_duplicates.SYMBOLS), 2):
        assert any(not set(far) & set(m) for m in near_duplicates.MASKS)


def test_near_duplicates_against_brute_force(spark):
    rows = small_corpus(4)
    df = spark.createDataFrame([(*r, "k") for r in rows] + [(*rows[0], "k")], "doc_id bigint, text string, lang string, keys string")
    want = groups_by_brute_force(rows)
    assert want and rows_of(near_duplicates.near_duplicate_groups(df), "first", "id") == want
    assert near_duplicates.near_duplicate_groups(df.limit(0)).count() == 0


def test_hot_bucket_of_near_copies_keeps_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SMALL", 6)
    rng = random.Random(8)
    base, rows = story(rng, 90), []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(90)] = f"e{i}"
        rows.append((i, " ".join(w), "en"))
    far = list(base)
    for k in range(0, 90, 22):
        far[k] = "far"
    rows += [(100, " ".join(far + story(rng, 12)), "en"), (101, " ".join(base[:70] + story(rng, 20)), "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert rows_of(near_duplicates.near_duplicate_groups(df), "first", "id") == groups_by_brute_force(rows)


# --- p5 ---


def test_page_frame(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).title()
    para = lambda: " ".join(f"{name()} said the {rng.choice(['mill', 'bridge', 'harbour'])} of {name()} would {rng.choice(['open', 'close'])} on {rng.randrange(90)} days." for _ in range(3))
    rows, want = [], set()
    for i in range(60):
        head = f"{name()}: costly bridge, {name()}"
        lines = [("Skip to content", 1), ("Home / Sport / Weather", 1), (head, 0), (f"By {name()}", 0), (para(), 0), ("Advertisement", 1), ("What happens next", 0), (para(), 0), ("", 0), (para(), 0)]
        lines += [("Share this article", 1), ("You may also like", 1), (f"{name()}: costly bridge, {name()}", 1), (f"© {2000 + i} {name()} Group", 1), ("#one, #two", 1)]
        rows.append((i, "en", f"h{i % 20}.example", "" if i == 59 else head, "\n".join(x for x, _ in lines)))
        want |= {(i, k + 1) for k, (_, gone) in enumerate(lines) if gone}
    rows += [(100, None, None, None, None), (101, "en", "h", "x", ""), (102, "qq", None, "Only", "Only\nline one\nline two"), rows[0]]
    df = spark.createDataFrame(rows, "page_id bigint, lang string, domain string, headline string, text string").withColumn("id", F.lit("clash"))
    assert set(rows_of(boilerplate.boilerplate_lines(df), "page_id", "line_no")) == want
    assert boilerplate.boilerplate_lines(df.limit(0)).count() == 0


# --- p6 ---


def test_allocation_goes_to_siblings_then_cousins():
    tree = {"a": ("x", "p"), "b": ("x", "p"), "c": ("x", "q"), "d": ("y", "r")}
    plan = {r["category"]: r for r in quota_sample.allocate([("a", 400, 0), ("b", 300, 0), ("c", 200, 0), ("d", 100, 5)], {"a": 10, "b": 35, "c": 100, "d": 2}, 100, tree)}
    assert plan["a"]["short"] and plan["d"]["short"] and not plan["b"]["short"]
    assert plan["b"]["from_siblings"] == 5 and plan["b"]["taken"] == 35
    assert plan["c"]["taken"] == 100 - 10 - 35 - 2 and sum(r["taken"] for r in plan.values()) == 100


def test_quota_sample(spark):
    rows = [(i, "en" if i % 2 else "fr", i % 3 - 1) for i in range(90)] + [(i, "en" if i % 2 else "fr", i % 3 - 1) for i in range(10)] + [(None, "en", 1), (1000, None, None)]
    df = spark.createDataFrame(rows, "article_id bigint, lang string, gpt_label_id int")
    t = spark.createDataFrame([("lang", "en", 800, 1), ("lang", "fr", 100, 9), ("lang", "sw", 100, 3), ("other", "en", 1, 1)], "field_name string, category string, target_permille int, min_rows int")
    report = quota_sample.quota_report(df, t, {"lang": quota_sample.LANGUAGE_TREE})
    got = {r.category: r for r in report.collect()}
    assert (got["en"].quota, got["en"].short, got["fr"].quota, got["sw"].available, got["sw"].short) == (36, False, 9, 0, True)
    s = quota_sample.quota_sample(df, report, "lang").collect()
    assert Counter(r.category for r in s) == {c: r.taken for c, r in got.items() if r.taken}
    assert len({r.article_id for r in s}) == len(s) == 36 + 9 + 5
    assert all(r.short for r in quota_sample.quota_report(df.limit(0), t, {"lang": {}}).collect() if r.quota)


# --- p7 ---


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import tiktoken

    texts = [*ODD, "<|endoftext|> x", "  lead", "it's I'LL", "аб вг", "१२३ हिन्दी", "\r\n\n \t", "日本語テキスト" * 60, "zzzzqqqqxxxx" * 50]
    t = tokenizers.Tokenizer.from_file(f"{byte_bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate([*texts, None])], "doc_id bigint, text string, ids int")
    got = dict(rows_of(byte_bpe.encode_texts(df, "doc_id"), "doc_id", "ids"))
    assert [got[i] for i in range(len(texts))] == want and got[len(texts)] == []
    assert [byte_bpe.load("byte_bpe_50k").encode(x).tolist() for x in texts] == want
    ranks = byte_bpe.load_ranks(f"{byte_bpe.FOLDER}/byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [byte_bpe.ByteBPE(ranks).encode(x).tolist() for x in texts] == [e.encode_ordinary(x) for x in texts]
    assert byte_bpe.ByteBPE(byte_bpe.load_ranks(f"{byte_bpe.FOLDER}/byte_bpe_50k.json")).encode(texts[3]).tolist() == want[3]


def test_encoding_decodes_to_the_text():
    bpe, rng = byte_bpe.load("byte_bpe_50k"), random.Random(1)
    for _ in range(200):
        s = "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0x80, 0x2000), rng.randrange(0x4E00, 0x9000)))) for _ in range(rng.randrange(60)))
        assert "".join(bpe.tokens[i] for i in bpe.encode(s).tolist()).encode("latin-1").decode("utf8") == s


# --- p8 ---


def test_sweep_places_every_item():
    rng = random.Random(6)
    for cap in (1, 7, 50):
        sizes = dict(Counter(rng.randrange(1, cap + 1) for _ in range(400)))
        plan, containers = packing.sweep(sizes, cap)
        load, seen = defaultdict(int), defaultdict(list)
        for size, lo, hi, first, each in plan:
            for r in range(lo, hi):
                load[first + (r - lo) // each] += size
                seen[size].append(r)
        assert all(sorted(v) == list(range(sizes[s])) for s, v in seen.items()) and set(seen) == set(sizes)
        assert max(load.values()) <= cap and set(load) == set(range(containers))
        assert containers <= 1.25 * -(-sum(s * n for s, n in sizes.items()) // cap) + 1


def test_packing(spark):
    rows = [(i, "word " * (i * 7 % 60), "c") for i in range(200)] + [(900, "long " * 700, "c"), (901, None, "c"), (902, "", "c"), (3, "word", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "piece_bpe_32k", 500), (3, None, 5)], "spec_id int, tokenizer string, capacity int")
    got = packing.pack(df, specs).collect()
    for spec, cap, name in ((1, 64, "byte_bpe_50k"), (2, 500, "piece_bpe_32k")):
        mine = [r for r in got if r.spec_id == spec]
        load, total = Counter(), Counter()
        for r in mine:
            load[r.container_id] += r.tokens
            total[r.doc_id] += r.tokens
        assert max(load.values()) <= cap and set(load) == set(range(max(load) + 1))
        want = Counter()
        for i, t, _ in rows:
            want[i] += packing.count_all(t, [name])[0]
        assert total == want and set(total) == {i for i, _, _ in rows}
        parts = sorted((r.piece, r.start, r.tokens) for r in mine if r.doc_id == 900)
        assert all(t == cap for _, _, t in parts[:-1]) and [s for _, s, _ in parts] == [k * cap for k in range(len(parts))]
        assert {r.piece for r in mine if r.doc_id != 900} == {0}
    assert packing.pack(df, specs.where("spec_id = 3")).count() == 0 and packing.pack(df.limit(0), specs).count() == 0


def test_piece_counts_equal_the_library():
    spm = pytest.importorskip("sentencepiece")
    m = spm.SentencePieceProcessor(model_file=f"{byte_bpe.FOLDER}/piece_bpe_32k.model")
    count = packing.counter("piece_bpe_32k")[1]
    rng = random.Random(4)
    texts = [*ODD, *("".join(rng.choice(" \n\tab中é.") for _ in range(rng.randrange(40))) for _ in range(300))]
    assert [count(t) for t in texts if t] == [len(m.encode(t)) for t in texts if t]


# --- p9 ---

RESIDUE = [
    "Please enable JavaScript to read this.", "A story.\n\n404 – the page /x-1 could not be found on this server.", "The {{ name }} of the town", "Hello ${author.name} there", "Traceback (most recent call last): KeyError: 'x'",
    "ARADIĞINIZ SAYFA BULUNAMADI: /A-1", "Lorem ipsum dolor sit amet consectetur elit magna aliqua.", "Η σελίδα /x δεν βρέθηκε.", "服务器错误，编号 12", "By @@BYLINE@@ in town", "cost [INSERT QUOTE HERE] million", "a &lt;!-- teaser --&gt; b",
    "Loading x-1 … if nothing happens, allow scripts and cookies.", "In <<placename>> it rained.", "Test test test 5 please ignore",
]
CLEAN = [
    "“Please enable JavaScript” is the sentence she hates.", "A course shows how `{{ user.name }}` is replaced.", "The museum printed “lorem ipsum” on posters.", "The witness [name withheld] said {sic} so.", "The placeholder budget of 3 million will be replaced.",
    "Programmers taught pupils that JavaScript is required for the quiz.", "She saw a “404 – not found” notice.", "Der Blindtext auf 5 Broschüren war ein Scherz.", "", None, "   ", "\x01 bell", "Room 404 was full. Page 500 was not.",
]


def test_residue(spark):
    rows = [(i, t, "x") for i, t in enumerate(RESIDUE + CLEAN)] + [(0, RESIDUE[0], "x"), (500, "word " * 40_000, "x")]
    got = rows_of(residue.residue_documents(spark.createDataFrame(rows, "doc_id bigint, text string, id string")), "doc_id")
    assert [i for (i,) in got] == list(range(len(RESIDUE)))
    assert residue.residue_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_residue_spreads_to_near_copies(spark):
    seed = "Page not found because the story you asked for was moved to another section of the site by our editors."
    near = "Pages not found because the story you asked for was moved to another section of the site by our editors."
    assert not residue.messages(near)
    rows = [(1, seed), (2, near), (3, "Nothing to see in this ordinary story about a bridge and a mill in the town.")]
    sims = residue.simhash(*wordkernel.word_hashes([residue.masked(seed), residue.masked(near)], [None] * 2))
    got = {i for (i,) in rows_of(residue.residue_documents(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id")}
    assert 1 in got and 3 not in got
    assert (2 in got) == (int(sims[0] ^ sims[1]).bit_count() <= residue.RADIUS)


def test_residue_spreads_in_chinese_and_in_long_segments(spark):
    def near(seed, lang, units, join):  # a copy with one unit changed, inside the radius, that no pattern starts
        h = lambda x: residue.simhash(*wordkernel.word_hashes([residue.masked(x)], [lang]))[0]
        for k in range(500):
            x = join.join([chr(0x5000 + k) if lang else f"q{chr(97 + k % 26)}{chr(97 + k // 26)}", *units[1:]])
            if not residue.messages(x) and int(h(seed) ^ h(x)).bit_count() <= residue.RADIUS:
                return x
        return None

    rng = random.Random(15)
    tail = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    long = " ".join(["lorem", *tail]).replace("lorem", "Page not found because")
    copy = near(long, None, long.split(), " ")
    head = next(x for x in ("页面不存在", "页面未找到", "您访问的页面不存在", "找不到页面", "您访问的页面") if residue.messages(x))
    zh = head + "".join(chr(0x4E00 + 7 * k) for k in range(90))
    zh_copy = near(zh, "zh", list(zh), "")
    assert copy and zh_copy
    rows = [(1, long), (2, copy), (3, zh), (4, zh_copy), (5, "Nothing to see in this ordinary story about a bridge.")]
    assert rows_of(residue.residue_documents(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id") == [(1,), (2,), (3,), (4,)]


def test_slot_in_double_guillemets():
    assert residue.has_slot("Bonjour ««prenom»», voici les nouvelles.")


def test_residue_spreads_along_long_chains(spark):
    """Each step changes a word more, within the radius of the one before only."""
    rng = random.Random(17)
    units = ["Page", "not", "found", "because", *(f"w{chr(97 + k % 26)}{chr(97 + rng.randrange(26))}{chr(97 + k // 26)}" for k in range(60))]
    sim = lambda u: residue.simhash(*wordkernel.word_hashes([residue.masked(" ".join(u))], [None]))[0]
    chain = [units]
    for step in range(7):
        for k in range(5000):
            new = list(chain[-1])
            new[step] = f"q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}"
            far = [int(sim(new) ^ sim(c)).bit_count() for c in chain]
            if far[-1] <= residue.RADIUS and all(x > residue.RADIUS for x in far[:-1]):
                break
        else:
            pytest.fail("no chain")
        chain.append(new)
    texts = [" ".join(c) for c in chain]
    assert not any(map(residue.messages, texts[1:]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert rows_of(residue.residue_documents(d), "doc_id") == [(i,) for i in range(len(texts))]


# --- the whole tables, and where results must not depend on partitions ---


@pytest.mark.parametrize("name", ["p2_found", "p4_found"])
def test_whole_small_tables(spark, name):
    import pandas as pd

    from corpusloom.llm.queries import QUERIES

    got = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    if name == "p4_found":
        d = pd.read_parquet(f"{SF}/documents.parquet")
        assert got == groups_by_brute_force(list(zip(d.doc_id, d.text, d.lang)))
    else:
        d = pd.read_parquet(f"{SF}/articles.parquet").drop_duplicates("article_id")
        s = {i: (run_set(t, lang), sp) for i, t, lang, sp in zip(d.article_id, d.text, d.lang, d.split) if t and sp}
        ev = [i for i in s if s[i][1] != "train"]
        want = {(min(a, b), max(a, b)) for a in ev for b in s if s[b][1] == "train" and alike(s[a][0], s[b][0])}
        assert got == sorted(want)


def test_same_result_for_any_partitioning(spark):
    rows = small_corpus(7, 12)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert len({tuple(rows_of(near_duplicates.near_duplicate_groups(df.repartition(n)), "first", "id")) for n in (1, 4, 16)}) == 1


def test_packing_of_large_capacities(spark):
    df = spark.createDataFrame([(i, "word " * 50) for i in range(6)], "doc_id bigint, text string")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 1 << 30), (2, "byte_bpe_50k", 120), (3, "byte_bpe_50k", 0), (4, None, 5)], "spec_id int, tokenizer string, capacity int")
    got = packing.pack(df, specs).collect()
    assert {r.spec_id for r in got} == {1, 2} and {r.container_id for r in got if r.spec_id == 1} == {0}
    assert all(sum(1 for r in got if r.spec_id == s) == 6 for s in (1, 2))


def test_names_of_many_words_and_many_forms(spark):
    name = "Business Politics Science Weather Travel Opinion"
    forms = spark.createDataFrame([(name, name, 1), ("Sport", "Sport", 1), ("Sports", None, 1)], "form string, entry string, often bigint")
    rows = [(1, "opinion travel weather science politics business"), (2, "OPINION: Travel, Weathr | Science & Politics, Business"), (3, "News section page latest top home archive Sport"), (4, "Sports"), (5, "Nothing of it")]
    want = {1: name, 2: name, 3: "Sport", 4: "(unmatched)", 5: "(unmatched)"}
    for most in (20_000, 1):
        got = canonical.map_values(spark.createDataFrame(rows, "value_id int, n string"), forms, "value_id", "n", most_forms=most)
        assert dict(rows_of(got, "value_id", "entry")) == want


def test_pairs_of_passages_side_by_side():
    rng = np.random.default_rng(3)
    docs, items, want = [], [], []
    for n in range(60):
        item = rng.integers(1, 1 << 40, 90).astype(np.uint64)
        part = item[20 : 20 + 24 + n % 30].tolist()
        for k in sorted(rng.choice(np.arange(1, len(part) - 1), int(len(part) * 0.1) + n % 2, replace=False).tolist(), reverse=True):
            part[k : k + 1] = [[], [int(rng.integers(1 << 41, 1 << 42))], [part[k], 7]][int(rng.integers(3))]
        doc = np.concatenate([rng.integers(1 << 43, 1 << 44, 30), part, rng.integers(1 << 43, 1 << 44, 30)]).astype(np.uint64)
        docs.append(doc)
        items.append(item)
        want.append(leakage.holds_passage(doc, item, 24))
    assert leakage.holds_passages(docs, items, 24).tolist() == want and 20 < sum(want) < 60
    assert leakage.holds_passages([], [], 24).tolist() == []


def test_filter_sizes_follow_the_keys():
    assert bitmap.log2_size(0) == bitmap.LEAST_LOG2 and bitmap.log2_size(1 << 40) == bitmap.MOST_LOG2
    assert (1 << bitmap.log2_size(1_000_000)) >= bitmap.BITS_A_KEY * 1_000_000


def test_table_keys_meet_within_the_radius():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, residue.RADIUS, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    assert (residue.table_keys(a) == residue.table_keys(b)).any(1).all()
    assert not (residue.table_keys(a) == residue.table_keys(np.roll(a, 1))).any()


def test_wrapper_alignment():
    a, b, c, d, e, u, v = range(7)
    pages = [([a, b, u, c, d], "HHMTT"), ([a, c, c, d], "HTTT"), ([a, b, v, c, e, d], "HHMTTT"), ([a, b, c, e, d], "HHTTT")]
    got = boilerplate.align(pages)
    assert [n.token for n in got] == [a, b, c, e, d]
    assert [n.optional for n in got] == [False, True, False, True, False]
    assert [n.repeated for n in got] == [False, False, True, False, False]
    assert [n.at["H"] + n.at["T"] for n in got] == [4, 3, 4, 2, 4]
    assert boilerplate.align([]) == [] and boilerplate.align([([a, b], "HH")]) == []


def test_links_count_what_pairs_list(spark):
    base = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    rows = [(1, "train", base[0]), (2, "train", base[0]), (3, "train", base[1]), (4, "train", "other text of no kind"), (5, "dev", base[0]), (6, "test", base[0] + " end"), (7, "heldout", base[2]), (8, None, base[0]), (2, "train", base[0]), (9, "dev", None)]
    a = spark.createDataFrame([(*r, "en") for r in rows], "article_id bigint, split string, text string, lang string")
    pairs = rows_of(segment_join.split_overlap(a), "article_id_a", "article_id_b")
    assert pairs == [(1, 5), (1, 6), (2, 5), (2, 6)]
    got = {r.article_id: (r.side, r.links) for r in segment_join.split_links(a).collect()}
    assert got == {1: ("train", 2), 2: ("train", 2), 5: ("evaluation", 2), 6: ("evaluation", 2)}
    assert segment_join.split_links(a.limit(0)).count() == 0
