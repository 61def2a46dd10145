"""Test passages in training text: BM25 over an inverted index of test items, with WAND pruning.

Terms are runs of 6 words (7 characters in zh and ja), few enough words that the edits of a passage leave 7 (12) of its terms whole
wherever they stand (`_bounds`). The items are the query set: their index is cut into blocks of bounded size, and every training text is run against
every block. A training text first drops terms that no item has (Bloom filter) and then terms in no stretch that has as many as a passage
keeps. In a block, an item's threshold is the least score its passages can keep; its pivot terms are those left when each passage's commonest
terms that together stay below the threshold are taken out, and only their postings start candidates. A candidate's upper
bound, summed over the terms that a signature of the item admits, must reach the threshold; then its exact score must, and the shared terms must be as dense as a
passage's in some band of diagonals. Every bound is one that all passages meet, so no step drops one. What remains is verified by alignment.
A term counts once in an item, so the item's length norm multiplies its score and its threshold alike and is left out of both.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from corpusloom.llm import bitmap
from corpusloom.llm.arrowmap import _slices, map_arrow, ragged
from corpusloom.llm.segment_join import _lists
from corpusloom.llm.wordkernel import CJK_LANGS, groups_by_width, mix, runs, take, text_class, word_hashes
from corpusloom.session import cut, ship

#: Words, and characters in zh and ja, of a term.
TERM, TERM_CJK = 6, 7
#: A block of the index has about this many words at most (one item may have more).
BLOCK_WORDS = 1_000_000
#: Words, and characters in zh and ja, of the runs that the surroundings of a shared pivot are compared by: of these an edit breaks few.
FINE, FINE_CJK = 2, 4
#: Bits of an item's signature for each of its terms.
SIGN_BITS = 16
#: Candidate terms, words of texts, and compared runs around pivots that a worker looks at side by side: what fits into a core's cache.
AT_ONCE, WORDS_AT_ONCE, AROUND_AT_ONCE = 500_000, 120_000, 100_000
#: Bytes of texts that a worker holds while it reads one block after the other.
HELD = 48 << 20


def _budget(least: int, share: float = 0.1) -> np.ndarray:
    """The edits that passages may have, by their words from 0 to the most that need a look.

    A longer one, its first and last words unchanged as of any passage, can be cut behind an unchanged word, without the edits that follow, into
    two of `least` or more words; their edits add up to at most the whole's, so one of them is a passage too.
    """
    budget = np.floor(np.arange(4 * least) * share + 1e-9).astype(np.int32)
    return budget[: np.flatnonzero(np.arange(4 * least) < 2 * least + budget)[-1] + 1]


def _bounds(least: int, width: int) -> list[tuple[int, int]]:
    """(terms, places): every document that holds a passage has, for one of them, that many of its terms within that many places.

    An edit breaks at most `width` terms and adds at most a word to the document. A word more without an edit more adds one to both
    numbers, which a stretch shorter by a place also has, so the first length of each number of edits stands for all.
    """
    budget = _budget(least).tolist()
    first = [n for n in range(least, len(budget)) if n == least or budget[n] > budget[n - 1]]
    bounds = [(n - width + 1 - width * budget[n], n + budget[n] - width + 1) for n in first]
    if min(bounds)[0] < 1:
        raise ValueError(f"passages of {least} words may hold no whole run of {width}")
    return bounds


def _dense(k: np.ndarray, offsets: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Of ascending term places those in a stretch of one text with as many of them as one of the bounds asks for."""
    text, keep = np.searchsorted(offsets, k, "right"), np.zeros(len(k), np.bool_)
    for least, span in bounds:
        if len(k) >= least:
            last, edge = least - 1, np.zeros(len(k) + 1, np.int32)
            ok = np.flatnonzero((k[last:] - k[: len(k) - last] < span) & (text[last:] == text[: len(k) - last]))
            edge[ok] += 1
            edge[ok + least] -= 1
            keep |= np.cumsum(edge[:-1]) > 0
    return np.flatnonzero(keep)


def _close_flat(pair: np.ndarray, at: np.ndarray, pairs: int, bounds: list[tuple[int, int]], wide: int) -> np.ndarray:
    """Which pairs have shared terms, (place in doc) << 32 | (place in item), as dense as a passage's within `wide` diagonals."""
    ok = np.zeros(pairs, np.bool_)
    if not len(pair):
        return ok
    place = at >> 32
    step = wide + 1
    for shift in (0, step):  # two tilings: diagonals that differ by `wide` share a tile of one
        tile = (place - (at & 0xFFFFFFFF) + shift) // (2 * step)
        by = np.lexsort((place, tile, pair))
        group, place_, pair_ = tile[by], place[by], pair[by]
        new = np.concatenate([[True], (np.diff(pair_) != 0) | (np.diff(group) != 0)])
        once = new | np.concatenate([[True], np.diff(place_) != 0])
        number = (np.cumsum(new) - 1)[once]
        # _dense wants ascending places over all texts: each tile's begin where no stretch reaches from the one before
        far = np.int64(1) << 32
        k = place_[once] + number * far
        ok[pair_[once][_dense(k, np.arange(number[-1] + 2) * far, bounds)]] = True
    return ok


def _grams(c: dict):
    """(row, zh or ja, terms, their offsets, words, their offsets) of each text with terms."""
    langs = c["lang"].to_pylist()
    h, o = word_hashes(c["text"].to_pylist(), langs)
    for kind, at in groups_by_width(langs, 0, 1):
        words = take(h, o, at)
        yield kind, at, *runs(*words, TERM_CJK if kind else TERM), *words


def _terms(items: DataFrame) -> DataFrame:
    """(term): the terms of the items, each once in a batch."""

    def fn(c: dict) -> dict:
        return {"term": np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in _grams(c))])).view(np.int64)}

    return map_arrow(items, fn, "term bigint")


def _hits(docs: DataFrame, id_type: str, bits, least: tuple[int, int]) -> DataFrame:
    """(doc, key, cjk, terms, pos, words): the terms that some item has, in stretches with as many of them as a passage keeps, all words, and one value for them."""

    def fn(c: dict) -> dict:
        rows, kinds, terms, pos, words, keys = [], [], [], [], [], [np.zeros(0, np.int64)]
        for kind, at, g, go, hw, ow in _grams(c):
            k = np.flatnonzero(bitmap.contains(bits.value, g))
            k = k[_dense(k, go, _bounds(least[kind], TERM_CJK if kind else TERM))]
            edge = np.searchsorted(k, go)
            keys.append(text_class(hw, ow)[np.diff(edge) > 0])
            for i in np.flatnonzero(np.diff(edge)):
                x = k[edge[i] : edge[i + 1]]
                rows.append(at[i])
                kinds.append(bool(kind))
                terms.append(g[x])
                pos.append((x - go[i]).astype(np.int32))
                words.append(hw[ow[i] : ow[i + 1]])
        return {"doc": c["id"].take(pa.array(rows, pa.int64())), "key": np.concatenate(keys), "cjk": kinds, "terms": _lists(terms), "pos": _lists(pos, np.int32), "words": _lists(words)}

    return map_arrow(docs, fn, f"doc {id_type}, key bigint, cjk boolean, terms array<bigint>, pos array<int>, words array<bigint>")


def _pivots(idf: np.ndarray, go: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each term is a pivot, the threshold of each item) of items given by the idf of their terms in order.

    A passage of n words keeps `need` of its terms. The threshold is the least sum of `need` terms of a stretch of n words. In each
    stretch the need - 1 commonest terms stay below it, so a passage that keeps no other term does not exist.
    """
    budget = _budget(least).tolist()
    pivot, theta = np.zeros(len(idf), np.bool_), np.full(len(go) - 1, np.inf)
    for n in (n for n in range(least, len(budget)) if n == least or budget[n] > budget[n - 1]):
        span, need = n - width + 1, n - width + 1 - width * budget[n]
        count = np.maximum(np.diff(go) - span + 1, 0)
        item = np.repeat(np.arange(len(count)), count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + go[item]
        for lo in range(0, len(start), 100_000):
            at = start[lo : lo + 100_000, None] + np.arange(span)
            x = idf[at]
            order = np.argpartition(x, need - 1, axis=1)
            pivot[np.take_along_axis(at, order[:, need - 1 :], 1).ravel()] = True
            np.minimum.at(theta, item[lo : lo + 100_000], np.take_along_axis(x, order[:, :need], 1).sum(1))
    return pivot, theta * 0.9999  # for sums in another order


def _index(items: DataFrame, id_type: str, least: tuple[int, int]) -> DataFrame:
    """(block, item, number, cjk, words, rank, idf, pivot, theta) of items (id, text, lang, block): idf and the order of postings within the block, pivots and threshold."""
    ship(items.sparkSession)
    schema = f"block bigint, item {id_type}, number int, cjk boolean, words array<bigint>, rank array<int>, idf array<float>"
    to = to_arrow_schema(_parse_datatype_string(schema))

    def weigh(t: pa.Table) -> pa.Table:
        langs = t["lang"].to_pylist()
        h, o = word_hashes(t["text"].to_pylist(), langs)
        parts = []
        for kind, at in groups_by_width(langs, 0, 1):
            hw, ow = take(h, o, at)
            g, go = runs(hw, ow, TERM_CJK if kind else TERM)
            item = np.repeat(np.arange(len(at)), np.diff(go))
            by = np.lexsort((item, g))
            new = np.concatenate([[True], np.diff(g[by]) != 0])[: len(by)]
            first = new | np.concatenate([[True], np.diff(item[by]) != 0])[: len(by)]
            term = np.cumsum(new) - 1
            df = np.bincount(term[first], minlength=1)
            n = np.count_nonzero(np.diff(go))
            idf = np.empty(len(g), np.float32)
            idf[by] = np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
            rank = np.empty(len(g), np.int32)
            rank[by] = np.arange(len(g), dtype=np.int32)
            some = pa.array(at)
            columns = [t["block"].combine_chunks().take(some), t["id"].combine_chunks().take(some), pa.array(np.arange(len(at))), pa.array(np.full(len(at), bool(kind)))]
            columns += [ragged(hw, ow, "int64"), ragged(rank, go, "int32"), ragged(idf, go, "float32")]
            parts.append(pa.Table.from_arrays([x if x.type == f.type else x.cast(f.type) for x, f in zip(columns, to)], schema=to))
        return pa.concat_tables(parts)

    def mark(c: dict) -> dict:
        cjk = np.asarray(c["cjk"].to_pylist(), np.bool_)
        out, kinds = [], []
        for kind in (False, True):
            at = np.flatnonzero(cjk == kind)
            idf = c["idf"].take(pa.array(at))
            go = np.concatenate([[0], np.cumsum(idf.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            pivot, theta = _pivots(idf.flatten().to_numpy(), go, least[kind], TERM_CJK if kind else TERM)
            kinds.append(at)
            out.append((ragged(pivot, go, pa.bool_()), theta))
        by = pa.array(np.concatenate(kinds))
        return {k: c[k].take(by) for k in ("block", "item", "number", "cjk", "words", "rank", "idf")} | {"pivot": pa.concat_arrays([p for p, _ in out]), "theta": np.concatenate([t for _, t in out])}

    weighed = items.groupBy("block").applyInArrow(weigh, schema)
    spread = 2 * items.sparkSession.sparkContext.defaultParallelism + 1
    return map_arrow(weighed.repartition(spread, "item"), mark, schema + ", pivot array<boolean>, theta double")


class Signature:
    """For each item some bits for each of its terms, set by the term's hash: a term whose bit is not set is not in the item."""

    def __init__(self, terms: np.ndarray, offsets: np.ndarray):
        self.size = np.maximum(SIGN_BITS * np.diff(offsets), 64)
        self.base = np.cumsum(self.size) - self.size
        self.bits = np.zeros(int(self.size.sum()), np.bool_)
        self.bits[self._at(terms, np.repeat(np.arange(len(self.size)), np.diff(offsets)))] = True

    def _at(self, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        return self.base[item] + ((term >> np.uint64(40)).astype(np.int64) % self.size[item])

    def may_hold(self, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        return self.bits[self._at(term, item)]


class Around:
    """Compares what stands around a term that a text and an item share, by runs of `size` words.

    A passage of n words with e edits leaves n - size + 1 - size * e of its runs whole, all on diagonals that differ by e at most from that of any term
    it keeps. As in `_bounds` the first length of each number of edits stands for all: it can be cut from the passage around the term.
    Of terms that follow one another on a diagonal the first stands for all, as a passage that holds one can be widened, without more edits, to hold each.
    Runs are compared by 16 bits, and those of the neighbours of short texts too, which only lets more through.
    """

    def __init__(self, least: int, width: int, size: int):
        budget = _budget(least).tolist()
        self.kinds = [(n, n - size + 1, n - size + 1 - size * budget[n]) for n in range(least, len(budget)) if n == least or budget[n] > budget[n - 1]]
        self.width, self.size, self.wide = width, size, int(budget[-1])
        self.left, self.right = self.kinds[-1][0] - width, self.kinds[-1][0] - size
        self.pad = self.left + self.wide

    def runs(self, words: np.ndarray) -> np.ndarray:
        """16 bits of the run that begins at each word, behind and before room for what the first and last words look at."""
        total = np.zeros(len(words), np.uint64)
        for t in range(self.size):
            total[: len(words) - t] += words[t:] * np.uint64(0x9E3779B97F4A7C15 + 2 * t * 0xD6E8FEB86659)
        return np.concatenate([np.zeros(self.pad, np.uint16), (total >> np.uint64(48)).astype(np.uint16), np.zeros(self.right + self.wide, np.uint16)])

    def passes(self, doc: np.ndarray, d: np.ndarray, item: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Whether a passage may hold the term at word d of the texts and word i of the items, given by their runs."""
        many = self.left + self.right + 1
        docs, items = np.lib.stride_tricks.sliding_window_view(doc, many + 2 * self.wide), np.lib.stride_tricks.sliding_window_view(item, many)
        ok, step = np.zeros(len(d), np.bool_), max(AROUND_AT_ONCE // many, 1)
        for lo in range(0, len(d), step):
            x, y = np.ascontiguousarray(docs[d[lo : lo + step]].T), np.ascontiguousarray(items[i[lo : lo + step] + self.wide].T)
            same = x[:many] == y
            one = np.empty_like(same)
            for c in range(1, 2 * self.wide + 1):
                np.logical_or(same, np.equal(x[c : c + many], y, out=one), out=same)
            sums, n = {1: same.astype(np.uint8 if self.kinds[-1][1] < 256 else np.uint32)}, 1
            while 2 * n <= self.kinds[-1][1]:  # of 1, 2, 4, ... runs in a row
                sums[2 * n] = sums[n][:-n] + sums[n][n:]
                n *= 2
            for n, span, need in self.kinds:
                at, starts, total = self.left + self.width - n, n - self.width + 1, 0
                for k in (k for k in sums if span & k):
                    total = total + sums[k][at : at + starts]
                    at += k
                ok[lo : lo + step] |= total.max(0) >= need
        return ok


class Block:
    """A block of the index of items of one kind (zh and ja or not), in memory."""

    def __init__(self, t: pa.Table, kind: bool, least: int):
        t = t.filter(pa.array(np.asarray(t["cjk"].to_pylist(), np.bool_) == kind)).sort_by("number").combine_chunks()
        part = lambda name: t[name].chunk(0) if t[name].num_chunks else pa.array([], t[name].type)
        self.ids, words = part("item"), part("words")  # ids are bounded by the block's size
        width = TERM_CJK if kind else TERM
        words, to = _joined(words)
        words = words.view(np.uint64), to
        self.words, self.to = words
        g, self.go = runs(*words, width)
        idf, self.pivot = part("idf").flatten().to_numpy(), part("pivot").flatten().to_numpy(zero_copy_only=False)
        self.theta = part("theta").to_numpy()
        item = np.repeat(np.arange(len(self.ids)), np.diff(self.go)).astype(np.int32)
        by = np.empty(len(g), np.int32)  # postings by term, then by item
        by[part("rank").flatten().to_numpy()] = np.arange(len(g), dtype=np.int32)
        terms = g[by]
        new = np.concatenate([[True], terms[1:] != terms[:-1]])[: len(terms)]
        first = np.flatnonzero(new)
        self.distinct, number = terms[first], (np.cumsum(new) - 1).astype(np.int32)
        self.idf, self.places, self.postings = idf[by][first], (by - self.go[item[by]]).astype(np.int32), number.astype(np.int64) * len(self.ids) + item[by]
        self.number = np.empty(len(g), np.int32)
        self.number[by] = number
        keep = np.flatnonzero(self.pivot[by])
        self.pivots, self.pivot_edge = by[keep], np.append(0, np.cumsum(np.bincount(number[keep], minlength=len(first))))
        self.item, self.shift = item, (self.to[:-1] - self.go[:-1])
        self.sign = Signature(g, self.go)
        self.runs = Around(least, width, FINE_CJK if kind else FINE).runs(self.words)

    def numbers(self, terms: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The number in the block of each term, given in ascending order, at the places of `order`; -1 where there is none."""
        out = np.full(len(terms), -1, np.int32)
        if len(self.distinct):
            k = np.minimum(np.searchsorted(self.distinct, terms), len(self.distinct) - 1)
            own = self.distinct[k] == terms
            out[order[own]] = k[own]
        return out

    def candidates(self, number: np.ndarray, term: np.ndarray, pos: np.ndarray, offsets: np.ndarray, texts: np.ndarray, begin: np.ndarray, bounds: list[tuple[int, int]], around: Around) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of the pairs that may share a passage; rows are texts given by their terms, the numbers of these and their places in order, their runs as `around` makes them, and the word each begins at."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        mine = np.flatnonzero(number >= 0)
        k, row = number[mine], (np.searchsorted(offsets, mine, "right") - 1).astype(np.int64)
        far = np.int64(1) << 32  # one ascending scale of places, texts far apart
        keep = _dense(pos[mine] + row * far, np.arange(len(offsets)) * far, bounds)
        if not len(keep):
            return none
        k, row, term, pos = k[keep], row[keep], term[mine[keep]], pos[mine[keep]].astype(np.int64)
        place = begin[row] + pos
        before = np.where(np.concatenate([[False], (np.diff(row) == 0) & (np.diff(pos) == 1)]), np.roll(k, 1), -1)  # the term a place before
        pairs = [np.zeros(0, np.int64)]
        many = self.pivot_edge[k + 1] - self.pivot_edge[k]
        for lo, hi in _runs_of(many, AT_ONCE):
            n = many[lo:hi]
            at = self.pivots[np.repeat(self.pivot_edge[k[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            hit, item = np.repeat(np.arange(lo, hi), n), self.item[at]
            last = np.maximum(at - 1, 0)
            new = (self.number[last] != before[hit]) | ~self.pivot[last] | (self.item[last] != item) | (at == 0)
            at, hit, item = at[new], hit[new], item[new]
            ok = around.passes(texts, place[hit], self.runs, at + self.shift[item])
            pairs.append(_distinct(row[hit[ok]] * len(self.ids) + item[ok]))
        pairs = _distinct(np.concatenate(pairs))
        edge = np.searchsorted(row, np.arange(len(offsets)))
        out = [np.zeros(0, np.int64)]
        for lo, hi in _runs_of(edge[pairs // len(self.ids) + 1] - edge[pairs // len(self.ids)], AT_ONCE):
            out.append(pairs[lo:hi][self._reach(pairs[lo:hi], k, term, pos, edge, bounds, around.wide)])
        out = np.concatenate(out)
        return out // len(self.ids), out % len(self.ids)

    def _reach(self, pairs: np.ndarray, k: np.ndarray, term: np.ndarray, pos: np.ndarray, edge: np.ndarray, bounds: list[tuple[int, int]], wide: int) -> np.ndarray:
        """Places of the pairs whose upper bound, exact score and density reach those of a passage."""
        row, item = pairs // len(self.ids), pairs % len(self.ids)
        n = edge[row + 1] - edge[row]
        pair = np.repeat(np.arange(len(pairs)), n)
        hit = np.repeat(edge[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keep = self.sign.may_hold(term[hit], item[pair])
        pair, hit = pair[keep], hit[keep]
        for exact in (False, True):
            if exact:  # the places in the item of each shared term
                key = k[hit] * len(self.ids) + item[pair]
                a = np.searchsorted(self.postings, key)
                m = np.searchsorted(self.postings, key, "right") - a
                at = np.repeat(a - np.cumsum(m) + m, m) + np.arange(m.sum())
                pair, hit = np.repeat(pair, m), np.repeat(hit, m)
            new = np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(hit) != 0)])[: len(pair)]
            score = np.bincount(pair[new], self.idf[k[hit[new]]], minlength=len(pairs))
            far = np.int64(1) << 32
            dense = np.zeros(len(pairs), np.bool_)
            dense[pair[new][_dense(pos[hit[new]] + pair[new] * far, np.arange(len(pairs) + 1) * far, bounds)]] = True
            ok = (score >= self.theta[item]) & dense
            keep = ok[pair]
            pair, hit = pair[keep], hit[keep]
            if exact:
                at = at[keep]
        left, group = np.unique(pair, return_inverse=True)
        ok = _close_flat(group, (pos[hit] << 32) | self.places[at], len(left), bounds, wide)
        return left[ok]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], np.diff(x) != 0])[: len(x)]]


def _runs_of(sizes: np.ndarray, most: int):
    """(from, to) cuts of a list into runs whose sizes add up to `most` at most, or hold one element."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


@functools.lru_cache(1)
def _load(path: str, number: int, least: tuple[int, int]) -> tuple[Block, Block]:
    where, folder = fs.FileSystem.from_uri(f"{path}/block={number}")
    t = ds.dataset(folder, format="parquet", filesystem=where, exclude_invalid_files=False).to_table()
    return Block(t, False, least[0]), Block(t, True, least[1])


class Shared:
    """A block of the index, read by each Python worker from its own folder in the shared one, or sent where it cannot reach that."""

    def __init__(self, table: DataFrame, number: int, least: tuple[int, int]):
        self.path, self.number, self.least, self.sent = table.inputFiles()[0].rpartition("/block=")[0], number, least, None
        try:
            fs.FileSystem.from_uri(self.path)
        except (OSError, ValueError):  # an address that only Hadoop understands; a block has a bounded size
            self.sent = table.sparkSession.sparkContext.broadcast(table.where(F.col("block") == number).toArrow())

    @property
    def value(self) -> tuple[Block, Block]:
        return (Block(self.sent.value, False, self.least[0]), Block(self.sent.value, True, self.least[1])) if self.sent else _load(self.path, self.number, self.least)


def _joined(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _search(hits: DataFrame, blocks: list[Shared], doc_type: str, item_type: str, least: tuple[int, int]) -> DataFrame:
    """(doc, item) of the pairs of texts and items of the blocks that share a passage: the texts are read once, and held while the blocks pass."""
    ship(hits.sparkSession)
    schema = f"doc {doc_type}, item {item_type}"
    to_schema = to_arrow_schema(_parse_datatype_string(schema))
    bounds = _bounds(least[0], TERM), _bounds(least[1], TERM_CJK)
    around = Around(least[0], TERM, FINE), Around(least[1], TERM_CJK, FINE_CJK)

    def prepared(t: pa.Table) -> list[tuple[list[tuple], np.ndarray, np.ndarray]]:
        t, out = t.combine_chunks(), ([], [])
        c = {k: t[k].chunk(0) for k in t.column_names}
        cjk = np.asarray(c["cjk"].to_pylist(), np.bool_)
        many = c["words"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for kind in (False, True):
            of = np.flatnonzero(cjk == kind)
            for lo, hi in _runs_of(many[of], WORDS_AT_ONCE):
                some = pa.array(of[lo:hi])
                (terms, to), (pos, _), (words, wo) = (_joined(c[k].take(some)) for k in ("terms", "pos", "words"))
                words = words.view(np.uint64)
                out[kind].append((c["doc"].take(some), terms.view(np.uint64), to, pos, words, wo, around[kind].runs(words)))
        terms = [np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in part)]) for part in out]
        order = [np.argsort(x) for x in terms]
        return [(part, x[by], by) for part, x, by in zip(out, terms, order)]

    def look(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = prepared(pa.Table.from_batches(parts))
        for block in blocks:
            both = block.value
            for kind in (False, True):
                own, (mine, terms, order) = both[kind], texts[kind]
                number = np.split(own.numbers(terms, order), np.cumsum([len(x[1]) for x in mine])[:-1])
                pairs = [own.candidates(n, terms, pos, to, runs_, wo, bounds[kind], around[kind]) for n, (_, terms, to, pos, _, wo, runs_) in zip(number, mine)]
                docs = [words[wo[i] : wo[i + 1]] for (*_, words, wo, _), (row, _) in zip(mine, pairs) for i in row]
                if not docs:
                    continue
                item = np.concatenate([i for _, i in pairs])
                ok = np.zeros(len(item), np.bool_)
                for p, q in _runs_of(np.fromiter(map(len, docs), np.int64) + np.diff(own.to)[item], WORDS_AT_ONCE):
                    ok[p:q] = holds_passages(docs[p:q], [own.words[own.to[i] : own.to[i + 1]] for i in item[p:q]], least[kind])
                ids = pa.concat_arrays([x[0].take(pa.array(row)) for x, (row, _) in zip(mine, pairs)])
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), own.ids.take(pa.array(item[ok]))], schema=to_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for part in _slices(batch):
                parts.append(part)
                size += part.nbytes
                if size >= HELD:
                    yield from look(parts)
                    parts, size = [], 0
        if parts:
            yield from look(parts)

    return hits.mapInArrow(run, schema)


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*lists, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, lists)])


def _pieces(doc: np.ndarray, do: np.ndarray, item: np.ndarray, io: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """(pair, place in item, place in doc, words) of the maximal common runs of `seed` or more words of each pair of texts.

    Texts and places are those of the joined lists.
    """

    def keyed(x: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, go = runs(x, o, seed)
        pair = np.repeat(np.arange(len(o) - 1), np.diff(go))
        return mix(g ^ mix(pair.astype(np.uint64), 3), 5), pair, np.arange(len(g)) - go[pair] + o[pair]

    gd, pair, dplace = keyed(doc, do)
    gi, _, iplace = keyed(item, io)
    seen, slot = np.zeros(1 << 22, np.bool_), np.uint64(42)
    seen[gi >> slot] = True
    some = seen[gd >> slot]
    gd, pair, dplace = gd[some], pair[some], dplace[some]
    order = np.argsort(gi, kind="stable")
    gi = gi[order]
    lo, hi = np.searchsorted(gi, gd, "left"), np.searchsorted(gi, gd, "right")
    n = hi - lo
    d = np.repeat(np.arange(len(gd)), n)
    i = iplace[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(d))]]
    pair, d = pair[d], dplace[d]
    by = np.lexsort((i, i - d, pair))
    pair, d, i = pair[by], d[by], i[by]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(i - d) != 0) | (np.diff(i) != 1) | (np.diff(pair) != 0)])[: len(d)])
    return pair[new], i[new], d[new], np.diff(np.append(new, len(d))) + seed - 1


def _union(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The whole numbers in any of the ranges lo to hi, ascending."""
    if not len(lo):
        return lo
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    lo, hi = lo[new], hi[np.append(new[1:], len(hi)) - 1]
    n = hi - lo + 1
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def holds_passages(docs: list[np.ndarray], items: list[np.ndarray], least: int, share: float = 0.1) -> np.ndarray:
    """For each pair whether some `least` or more consecutive words of the item, the first and the last unchanged, stand in doc with at most `share` of them edited; exact.

    The edits of a passage leave a common run of `seed` words, and their number bounds how far it strays over the diagonals, so it lies within a
    tile of one of two tilings of them. An edit distance within the tile, from each start in item, finds it. Tried are the starts from which
    on the tile has as many shorter runs as a passage leaves whole, and which stand behind words that differ: unchanged words before a
    passage, fewer than `least`, make a longer one with the same edits. All pairs are aligned side by side.
    """
    budget = _budget(least, share)
    wide, seed = int(budget[-1]), min(-(-(n - e) // (e + 1)) for n, e in enumerate(budget.tolist()) if n >= least)
    kinds = [n for n in range(least, len(budget)) if n == least or budget[n] > budget[n - 1]]
    budget = np.floor(np.arange(len(budget) + least) * share + 1e-9).astype(np.int32)
    most, width, step = len(budget) - 1, max(seed // 2, 1), wide + 1
    leaves = [(max(n - width + 1 - width * int(budget[n]), 1), n - width + 1) for n in kinds]
    (doc, do), (item, io) = _flat(docs), _flat(items)
    pair, pi, pd, ps = _pieces(doc, do, item, io, width)
    ok = np.zeros(len(docs), np.bool_)
    ok[pair[ps >= least]] = True
    pair, pi, pd, ps = (x[~ok[pair]] for x in (pair, pi, pd, ps))
    m, long = ps - width + 1, ps >= seed
    place = np.repeat(pi - np.cumsum(m) + m, m) + np.arange(m.sum())
    first, last = np.maximum(pi + seed - most, io[pair])[long], np.minimum(pi + ps - seed, io[pair + 1] - least)[long]
    fits = last >= first
    for shift in (0, step):
        tile = (pd - pi + shift) // (2 * step)
        by = np.lexsort((tile, pair))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(np.concatenate([[True], (np.diff(pair[by]) != 0) | (np.diff(tile[by]) != 0)])[: len(by)]) - 1
        base = np.zeros(len(by), np.int64)
        base[rank] = tile * 2 * step - shift
        hits = np.sort((np.repeat(rank, m) << 32) | place)  # a place that counts twice only lets more through
        enough = np.zeros(len(by) + 1, np.bool_)  # tiles with a stretch that has as many
        for need, span in leaves:
            far = max(len(hits) - need + 1, 0)
            enough[hits[:far][hits[need - 1 :] - hits[:far] < span] >> 32] = True
        some = fits & enough[rank[long]]
        tiles = rank[long][some] << 32
        todo = _union(tiles | first[some], tiles | last[some])
        here, padded = np.searchsorted(hits, todo), np.append(hits, np.full(max(leaves)[0], np.iinfo(np.int64).max))
        todo = todo[np.any([padded[here + need - 1] < todo + span for need, span in leaves], axis=0)]
        at, diagonal = todo & 0xFFFFFFFF, base[todo >> 32]
        of = np.searchsorted(io, at, "right") - 1
        for lo in range(0, len(at), 8192):
            part = lo + np.flatnonzero(~ok[of[lo : lo + 8192]])
            if len(part):
                ok[_aligned(doc, do, item, io, of[part], at[part], diagonal[part], 2 * step, least, budget, wide)] = True
    return ok


def holds_passage(doc: np.ndarray, item: np.ndarray, least: int, share: float = 0.1) -> bool:
    """holds_passages of one pair."""
    return bool(holds_passages([doc], [item], least, share)[0])


def _aligned(doc, do, item, io, pair, start, diagonal, columns: int, least: int, budget: np.ndarray, wide: int) -> np.ndarray:
    """The pairs of which a passage begins at one of the starts and stays within so many diagonals from the given one on.

    A passage that holds no shorter one has, at its k-th word of item, at most a share of k + least - 1 words of edits: else what follows,
    if it is long enough, is a passage by itself.
    """
    t = np.arange(columns, dtype=np.int32)
    at = (start + diagonal)[:, None] + t  # the place in doc that column t of the band is at
    lo, hi, end = do[pair][:, None], do[pair + 1][:, None], io[pair + 1]
    inside = (at > lo) & (at <= hi) & (start > io[pair])[:, None]
    before = inside & (doc[np.clip(at - 1, 0, len(doc) - 1)] == item[np.maximum(start - 1, 0)][:, None])
    same = (at >= lo) & (at < hi) & (doc[np.clip(at, 0, len(doc) - 1)] == item[start][:, None])
    row = np.where(same & ~before, 0, wide + 1).astype(np.int32)
    row = np.minimum.accumulate(row - t, axis=1) + t
    found = [pair[:0]]
    for n in range(2, len(budget)):
        most = min(int(budget[min(n + least - 2, len(budget) - 1)]), wide)
        live = (row.min(1) <= most) & (start + n <= end)
        if not live.all():
            row, at, start, pair, lo, hi, end = (x[live] for x in (row, at, start, pair, lo, hi, end))
        if not len(row):
            break
        at = at + 1
        word = item[start + n - 1][:, None]
        same = (at >= lo) & (at < hi) & (doc[np.clip(at, 0, len(doc) - 1)] == word)
        if n >= least:
            hit = (same & (row <= budget[n])).any(1)
            if hit.any():
                found.append(np.unique(pair[hit]))
                left = ~np.isin(pair, found[-1])
                row, at, start, pair, lo, hi, end, same = (x[left] for x in (row, at, start, pair, lo, hi, end, same))
        step = row + ~same
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)  # a word of item is missing
        row = np.minimum.accumulate(step - t, axis=1) + t  # doc has words more
    return np.concatenate(found)


def leaked_passages(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text_col: str = "text", lang_col: str = "lang", least: int = 24, least_cjk: int = 60, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, item): documents that hold a passage of `least` words (characters in zh and ja) of a test item.

    Null ids, null and empty texts and shorter items give no row; rows that repeat an id count once, of different texts under one item id the
    first in order. Items made of common phrases, and passages that many items share, are found as all others. Equal items are compared
    once, and equal documents where they are more than a tenth. The documents that hold terms of items are read once for all blocks of the index.
    """
    texts = lambda d, i: d.select(F.col(i).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null")
    item_type, doc_type = dict(items.dtypes)[item_id], dict(docs.dtypes)[doc_id]
    span = least, least_cjk
    src = cut(texts(items, item_id).groupBy("id").agg(F.min(F.struct("text", "lang")).alias("t")).selectExpr("id", "t.*", "min(id) over (partition by t.text, t.lang) as same"))
    same_item, src = src.select(F.col("same").alias("item"), F.col("id").alias("copy")), src.where("id = same").drop("same")
    words = F.length("text") / F.when(F.col("lang").isin(*CJK_LANGS), 1).otherwise(5)  # about as many as there are
    about = int(src.agg(F.sum(words)).first()[0] or 0)
    blocks = -(-about // block_words)
    bits = bitmap.build(_terms(src), "term", bitmap.log2_size(about))
    hits = cut(_hits(texts(docs, doc_id), doc_type, bits, span))
    src = src.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1))))
    index = cut(_index(src, item_type, span).repartition(max(blocks, 1), "block"), "block")
    if index.isEmpty():
        return hits.select("doc", F.lit(None).cast(item_type).alias("item")).limit(0)
    first = hits.groupBy("key", "cjk").agg(F.min("doc").alias("doc"))
    distinct, every = first.count(), hits.count()
    copied = distinct < 0.9 * every
    some = hits.join(first, ["key", "cjk", "doc"], "left_semi") if copied else hits
    numbers = [r[0] for r in index.select("block").distinct().collect()]
    found = _search(some.drop("key"), [Shared(index, k, span) for k in sorted(numbers)], doc_type, item_type, span)
    found = found.join(same_item, "item").select("doc", F.col("copy").alias("item"))
    if copied:
        key = hits.select("key", "cjk", F.col("doc").alias("copy"))
        found = found.join(first, "doc").join(key, ["key", "cjk"]).select(F.col("copy").alias("doc"), "item")
    return found.distinct()
