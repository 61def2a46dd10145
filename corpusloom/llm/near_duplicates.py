"""Near-duplicate groups by covering locality-sensitive hashing.

Each text becomes GROUPS vectors of 7 MinHash symbols over its word runs. Position i of a vector has the code word
i + 1 of F_2^3; for each of the 7 non-zero v, the mask keeps the positions whose code word has odd inner product with v
(the complements of the lines of the Fano plane: 4 of 7 positions). Any 2 positions lie on a line, so **every pair of
vectors within Hamming radius 2 agrees on all positions of at least one mask and collides in that table** (covering
LSH, Pagh 2016). Beyond the radius a collision is likely, not sure: over 4 groups a pair of similarity 0.7 is found with
probability 0.99, of 0.8 with 0.9998. Candidates are verified with exact run sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bitmap
from corpusloom.llm.arrowmap import map_arrow, ragged
from corpusloom.llm.components import connected_components
from corpusloom.llm.wordkernel import groups_by_width, mix, runs, take, text_class, word_hashes
from corpusloom.session import cut

SYMBOLS, GROUPS = 7, 4
MASKS = [[i for i in range(SYMBOLS) if bin((i + 1) & v).count("1") % 2] for v in range(1, 8)]
SMALL = 64


def covering_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, GROUPS * 7) table keys from the run hashes of texts with at least one run each."""
    keys = np.empty((len(offsets) - 1, GROUPS * len(MASKS)), np.uint64)
    for g in range(GROUPS):
        symbols = [np.minimum.reduceat(mix(hashes, 1 + g * SYMBOLS + i), offsets[:-1]) for i in range(SYMBOLS)]
        for t, mask in enumerate(MASKS):
            k = np.full(len(offsets) - 1, g * len(MASKS) + t + 1, np.uint64)
            for i in mask:
                k = mix(k ^ symbols[i], i)
            keys[:, g * len(MASKS) + t] = k
    return keys


def sketches(docs: DataFrame, least_words: int = 40, least_words_cjk: int = 120, width: int = 5, width_cjk: int = 10) -> DataFrame:
    """(id, cls, keys) of each text that is long enough; cls is one value for equal word sequences."""

    def fn(c: dict) -> dict:
        langs = c["lang"].to_pylist()
        h, o = word_hashes(c["text"].to_pylist(), langs)
        cls, n, ids = text_class(h, o), np.diff(o), c["id"].to_numpy(zero_copy_only=False)
        rows, keys = [np.zeros(0, np.int64)], [np.zeros((0, GROUPS * len(MASKS)), np.uint64)]
        for w, at in groups_by_width(langs, width, width_cjk):
            at = at[n[at] >= max(w, least_words if w == width else least_words_cjk)]
            if len(at):
                rows.append(at)
                keys.append(covering_keys(*runs(*take(h, o, at), w)))
        at, keys = np.concatenate(rows), np.concatenate(keys)
        return {"id": ids[at], "cls": cls[at], "keys": ragged(keys.ravel(), np.arange(len(at) + 1, dtype=np.int64) * keys.shape[1], "int64")}

    return map_arrow(docs.where("id is not null and text is not null"), fn, "id bigint, cls bigint, keys array<bigint>")


def run_sets(docs: DataFrame, bits, width: int = 5, width_cjk: int = 10) -> DataFrame:
    """(id, runs) of the texts whose hashed id is in the bit map; runs are distinct."""

    def fn(c: dict) -> dict:
        at = np.flatnonzero(bitmap.contains(bits.value, c["k"].to_numpy().view(np.uint64)))
        texts, langs = [c["text"][int(i)].as_py() for i in at], [c["lang"][int(i)].as_py() for i in at]
        h, o = word_hashes(texts, langs)
        ids, sets = [], []
        for w, sub in groups_by_width(langs, width, width_cjk):
            r, ro = runs(*take(h, o, sub), w)
            ids.extend(at[sub])
            sets.extend(np.unique(r[a:b]) for a, b in zip(ro[:-1], ro[1:]))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)
        return {"id": c["id"].to_numpy()[np.asarray(ids, np.int64)], "runs": ragged(np.concatenate([*sets, np.zeros(0, np.uint64)]), offsets, "int64")}

    return map_arrow(docs.where("id is not null and text is not null").withColumn("k", F.xxhash64("id")), fn, "id bigint, runs array<bigint>")


def _pairs_of_small(exploded: DataFrame, sizes: DataFrame) -> DataFrame:
    ids = exploded.join(sizes.where(f"n between 3 and {SMALL}").select("key"), "key").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return ids.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with both = shared runs and all = runs in either."""
    j = pairs.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    return j.withColumn("both", F.size(F.array_intersect("ra", "rb"))).withColumn("all", F.size("ra") + F.size("rb") - F.col("both")).drop("ra", "rb")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", threshold_pct: int = 70, **sketch) -> DataFrame:
    """(first, id): for every document of a near-duplicate group but its smallest id, that smallest id.

    Two texts are linked if they share at least threshold_pct % of the word runs in either; groups are the connected
    components. Null ids, null and empty texts and texts under the word minimum are in no group; repeated rows of one id
    count once. Copies are collapsed before anything is compared. Buckets of up to SMALL distinct texts give all
    their pairs. A larger bucket gives the pairs with its pivot first. Once these are verified, texts of one component need no
    further comparison; a text outside the bucket's main component is compared, in salted blocks, with those of other
    components that the triangle inequality of the Jaccard distance leaves possible. No link is lost to a bucket's size.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sk = cut(sketches(src, **sketch))
    reps = sk.groupBy("cls").agg(F.min(F.struct("id", "keys")).alias("r"))
    exploded = reps.select("r.id", F.explode("r.keys").alias("key"))
    # the pivot of a bucket is random by key, so a large group meets a different one in every table
    pivot = F.min_by("id", F.xxhash64("id", "key"))
    sizes = cut(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), pivot.alias("p")).where("n > 1"))
    of = lambda x: x.agg(F.max("n")).first()[0] or 0
    most = of(sizes)
    pairs = sizes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    if most > 2:
        pairs = pairs.union(_pairs_of_small(exploded, sizes))
    if most > SMALL:
        hot = exploded.join(sizes.where(f"n > {SMALL}").select("key", "p"), "key")
        pairs = pairs.union(hot.where("id <> p").select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")))
    pairs = cut(pairs.distinct())
    bits = bitmap.build(pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("k")).distinct(), "k")
    sets = run_sets(src, bits, sketch.get("width", 5), sketch.get("width_cjk", 10)).dropDuplicates(["id"])
    linked = f"100 * both >= {threshold_pct} * all"
    if most > SMALL:
        sets = cut(sets)
        scored = cut(similarity(pairs, sets))
        known = cut(scored.where(linked).select("a", "b"))
        dist = scored.select("a", "b", (1 - F.col("both") / F.col("all")).alias("d"))
        far = hot.withColumn("a", F.least("p", "id")).withColumn("b", F.greatest("p", "id")).join(dist, ["a", "b"], "left").select("key", "id", F.coalesce("d", F.lit(0.0)).alias("d"))
        root = connected_components(known, "a", "b").withColumnRenamed("node", "id")
        rows = cut(far.join(root, "id", "left").withColumn("root", F.coalesce("root", "id")))
        of_key = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        salts, reach = 16, 1 - threshold_pct / 100 + 1e-9
        open_ = rows.join(of_key.select("key", "main"), "key")
        rest = open_.where("root <> main").select("key", F.col("id").alias("a"), F.col("d").alias("da"), F.col("root").alias("ra"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
        more = open_.select("key", F.col("id").alias("b"), F.col("d").alias("db"), F.col("root").alias("rb"), (F.col("root") == F.col("main")).alias("in_main"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("s")).join(rest, ["key", "s"])
        more = more.where((F.abs(F.col("da") - F.col("db")) <= reach) & (F.col("ra") != F.col("rb")) & (F.col("in_main") | (F.col("a") < F.col("b")))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        scored = known.union(similarity(more, sets).where(linked).select("a", "b"))
    else:
        scored = similarity(pairs, sets).where(linked)
    roots = connected_components(scored, "a", "b")
    members = sk.select("id", "cls").join(sk.groupBy("cls").agg(F.min("id").alias("rep")), "cls").distinct()
    root = F.coalesce("root", "rep")
    return members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").where(F.col("id") != root).select(root.alias("first"), "id").distinct()
