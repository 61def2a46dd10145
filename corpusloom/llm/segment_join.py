"""Edit-distance segment join: evaluation texts that stand, exactly or nearly, in the training split.

Each evaluation text is cut into segments of 8 words (16 characters in zh and ja; short texts as long as one run). Two texts whose word runs agree to `threshold_pct` keep
most segments: an edit of a word breaks the runs over it, one of which is a segment, so about
(100 - threshold_pct) % of the segments can be lost. With k that number plus a margin, any k + 1 segments
hold an intact one, and any k + m hold m; the k + m that are rarest among the evaluation texts are taken, so phrases that
stand in a large share of all texts generate no candidates. Every training text's substrings of that width are matched against them at the
allowed positions, and the pairs verified: a banded dynamic program over words accepts pairs whose edit
distance alone proves the similarity; the others are decided by their exact run sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import bitmap
from corpusloom.llm.arrowmap import map_arrow, ragged
from corpusloom.llm.wordkernel import CJK_LANGS, groups_by_width, runs, take, text_class, word_hashes
from corpusloom.session import cut


def _offsets(lists: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)


def _lists(lists: list[np.ndarray], dtype=np.uint64) -> pa.Array:
    return ragged(np.concatenate([*lists, np.zeros(0, dtype)]), _offsets(lists), "int64" if dtype == np.uint64 else "int32")


#: run width: (segment width, texts of fewer words than this are cut into segments of the run width instead)
SEGMENTS = {5: (8, 24), 10: (16, 48)}


def _pass(df: DataFrame, width: int, width_cjk: int, bits) -> DataFrame:
    """(id, cls, w, segs, pos, words): the segments of each text, or with bits the substrings that the filter has."""

    def fn(c: dict) -> dict:
        langs = c["lang"].to_pylist()
        h, o = word_hashes(c["text"].to_pylist(), langs)
        cls, ids = text_class(h, o), c["id"].to_numpy(zero_copy_only=False)
        rows, widths, segs, pos, words = [], [], [], [], []
        for w, at in groups_by_width(langs, width, width_cjk):
            hw, ow = take(h, o, at)
            n = np.diff(ow)
            long, short = SEGMENTS.get(w, (w, 0))
            text, hit, place = [], [], []
            for size in {w, long}:
                r, ro = runs(hw, ow, size)
                of = np.repeat(np.arange(len(at)), np.diff(ro))
                where = np.arange(len(r)) - ro[of]
                if bits is None:
                    k = np.flatnonzero((where % size == 0) & ((n[of] >= short) == (size == long)))
                else:
                    k = np.flatnonzero(bitmap.contains(bits.value, r))
                text.append(of[k])
                hit.append(r[k])
                place.append(where[k].astype(np.int32))
            text = np.concatenate(text)
            by = np.argsort(text, kind="stable")
            text, hit, place = text[by], np.concatenate(hit)[by], np.concatenate(place)[by]
            edge = np.searchsorted(text, np.arange(len(at) + 1))
            for i in np.flatnonzero(np.diff(edge)):
                rows.append(at[i])
                widths.append(w)
                segs.append(hit[edge[i] : edge[i + 1]])
                pos.append(place[edge[i] : edge[i + 1]])
                words.append(hw[ow[i] : ow[i + 1]])
        rows = np.asarray(rows, np.int64)
        return {"id": ids[rows], "cls": cls[rows], "w": np.asarray(widths, np.int32), "segs": _lists(segs), "pos": _lists(pos, np.int32), "words": _lists(words)}

    return map_arrow(df, fn, "id bigint, cls bigint, w int, segs array<bigint>, pos array<int>, words array<bigint>")


def banded_distance(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, band: int) -> np.ndarray:
    """Edit distance of each pair of rows of two padded word matrices if it is at most `band`, else band + 1."""
    pairs, far = len(la), np.int32(1 << 20)
    t = np.arange(2 * band + 1, dtype=np.int32)
    row = np.where(t < band, far, t - band)[None, :].repeat(pairs, 0).astype(np.int32)
    padded = np.zeros((pairs, a.shape[1] + 2 * band + 1), b.dtype)
    padded[:, band : band + b.shape[1]] = b[:, : padded.shape[1] - band]
    out = np.full(pairs, band + 1, np.int32)
    end = lb - la + band
    fits = (end >= 0) & (end <= 2 * band)
    done = fits & (la == 0)
    out[done] = row[done, end[done]]
    for i in range(1, a.shape[1] + 1):
        j = i + t - band
        step = row + ((a[:, i - 1, None] != padded[:, i - 1 : i + 2 * band]) | (j < 1) | (j[None, :] > lb[:, None]))
        step[:, j < 1] = far
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        if i <= band:
            step[:, band - i] = i
        step = np.minimum.accumulate(step - t, axis=1) + t
        row = step.astype(np.int32)
        done = fits & (la == i)
        out[done] = np.minimum(row[done, end[done]], band + 1)
    return out


def alike(a: list[np.ndarray], b: list[np.ndarray], w: np.ndarray, threshold_pct: int) -> np.ndarray:
    """Whether the shared runs of each pair are at least threshold_pct % of the runs in either."""
    ok = np.zeros(len(a), np.bool_)
    sets: dict[int, np.ndarray] = {}

    def distinct(x: np.ndarray, width: int) -> np.ndarray:
        got = sets.get(id(x))
        if got is None:
            got = sets[id(x)] = np.unique(runs(x, np.array([0, len(x)]), width)[0])
        return got

    na = np.array([len(distinct(x, int(k))) for x, k in zip(a, w)])
    nb = np.array([len(distinct(x, int(k))) for x, k in zip(b, w)])
    live = np.flatnonzero((np.minimum(na, nb) * 100 >= np.maximum(na, nb) * threshold_pct) & (na > 0))
    # d edits leave at least na - w * d shared runs and add at most w * d: d <= safe proves the similarity
    safe = (na * (100 - threshold_pct)) // ((100 + threshold_pct) * w)
    for lo in range(0, len(live), 256):
        part = live[lo : lo + 256]
        part = part[(safe[part] > 0) & (safe[part] < 64)]
        if len(part):
            la, lb = np.array([len(a[i]) for i in part]), np.array([len(b[i]) for i in part])
            ma, mb = np.zeros((len(part), la.max()), np.uint64), np.zeros((len(part), lb.max()), np.uint64)
            for n, i in enumerate(part):
                ma[n, : la[n]], mb[n, : lb[n]] = a[i], b[i]
            ok[part] = banded_distance(ma, mb, la, lb, int(safe[part].max())) <= safe[part]
    for i in live[~ok[live]]:
        both = len(np.intersect1d(distinct(a[i], int(w[i])), distinct(b[i], int(w[i])), assume_unique=True))
        ok[i] = both * 100 >= threshold_pct * (na[i] + nb[i] - both)
    return ok


def class_join(train: DataFrame, evaluation: DataFrame, id_col: str, text_col: str = "text", lang_col: str = "lang", width: int = 5, width_cjk: int = 10, threshold_pct: int = 70, max_shift: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of alike classes (ecls, tcls), evaluation members (eval_id, ecls), training members (train_id, tcls)); a class is one word sequence.

    max_shift: how far, as a share of the longer text, a segment may stand from its place in the evaluation text. The
    default allows every place, as texts whose parts changed places are alike too. Null ids, null and empty texts and texts
    shorter than one run are in no pair; repeated rows count once. Copies are collapsed on both sides,
    so a text that a third of the rows repeats is compared once.
    """
    pick = lambda d: d.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null")
    ev = cut(_pass(pick(evaluation), width, width_cjk, None))
    ev_words = ev.dropDuplicates(["cls"]).select("cls", "w", "segs", "pos", "words")
    seg = ev_words.select("cls", F.size("words").alias("n"), F.size("segs").alias("s"), F.explode(F.arrays_zip("segs", "pos")).alias("x")).select("cls", "n", "s", F.col("x.segs").alias("h"), F.col("x.pos").alias("pos"))
    rarity = seg.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("df", "pos"))
    lost = F.ceil(F.col("s") * (100 - threshold_pct + 5) / 100) + 1
    more = F.floor(F.col("s") / 8)
    seg = cut(seg.join(rarity, "h").withColumn("k", rank).where(F.col("k") <= lost + 1 + more).select("h", "cls", "n", "pos", (more + 1).alias("need")))
    bits = bitmap.build(seg, "h")
    tr = cut(_pass(pick(train), width, width_cjk, bits))
    tr_words = tr.dropDuplicates(["cls"])
    sub = tr_words.select(F.col("cls").alias("tcls"), F.size("words").alias("tn"), F.explode(F.arrays_zip("segs", "pos")).alias("x")).select("tcls", "tn", F.col("x.segs").alias("h"), F.col("x.pos").alias("tpos"))
    near = F.abs(F.col("pos") - F.col("tpos")) <= F.greatest("n", "tn") * F.lit(max_shift)
    pairs = seg.join(sub, "h").where(near).groupBy(F.col("cls").alias("ecls"), "tcls").agg(F.count_distinct("pos").alias("n"), F.min("need").alias("need")).where("n >= need").select("ecls", "tcls")
    with_words = pairs.join(ev_words.select(F.col("cls").alias("ecls"), "w", F.col("words").alias("ew")), "ecls").join(tr_words.select(F.col("cls").alias("tcls"), F.col("words").alias("tw")), "tcls")

    def verify(c: dict) -> dict:
        a, b = ([x.values.to_numpy().view(np.uint64) for x in c[k]] for k in ("ew", "tw"))
        ok = np.flatnonzero(alike(a, b, c["w"].to_numpy(), threshold_pct))
        return {k: c[k].to_numpy()[ok] for k in ("ecls", "tcls")}

    found = map_arrow(with_words, verify, "ecls bigint, tcls bigint")
    return found.distinct(), ev.select(F.col("id").alias("eval_id"), F.col("cls").alias("ecls")).distinct(), tr.select(F.col("id").alias("train_id"), F.col("cls").alias("tcls")).distinct()


def segment_join(train: DataFrame, evaluation: DataFrame, id_col: str, **kw) -> DataFrame:
    """(eval_id, train_id) of all pairs of alike texts: the pairs of classes (`class_join`) with their members."""
    found, ev, tr = class_join(train, evaluation, id_col, **kw)
    return found.join(ev, "ecls").join(tr, "tcls").select("eval_id", "train_id").where("eval_id <> train_id").distinct()


def split_links(articles: DataFrame, train_split: str = "train", eval_splits: tuple[str, ...] = ("dev", "heldout", "test"), id_col: str = "article_id", **kw) -> DataFrame:
    """(id_col, side, class_id, links): one row for each article of an overlap, with its class of equal texts and how many articles of the other side it is alike to.

    Members are counted by class and never joined with each other, so a text that stands in a third of both splits costs one row an article. An id that
    stands on both sides counts itself.
    """
    found, ev, tr = class_join(articles.where(F.col("split") == train_split), articles.where(F.col("split").isin(*eval_splits)), id_col, **kw)
    found = cut(found)
    size = lambda d, c: d.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    of_ev = found.join(size(tr, "tcls"), "tcls").groupBy("ecls").agg(F.sum("n").alias("links"))
    of_tr = found.join(size(ev, "ecls"), "ecls").groupBy("tcls").agg(F.sum("n").alias("links"))
    a = ev.join(of_ev, "ecls").select(F.col("eval_id").alias(id_col), F.lit("evaluation").alias("side"), F.col("ecls").alias("class_id"), "links")
    return a.union(tr.join(of_tr, "tcls").select("train_id", F.lit("train"), "tcls", "links"))


def split_overlap(articles: DataFrame, train_split: str = "train", eval_splits: tuple[str, ...] = ("dev", "heldout", "test"), id_col: str = "article_id", **kw) -> DataFrame:
    """(article_id_a, article_id_b), a < b: alike texts of which one is in the training split and one in another."""
    found = segment_join(articles.where(F.col("split") == train_split), articles.where(F.col("split").isin(*eval_splits)), id_col, **kw)
    return found.select(F.least("eval_id", "train_id").alias("article_id_a"), F.greatest("eval_id", "train_id").alias("article_id_b")).distinct()
