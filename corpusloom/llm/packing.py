"""Filling containers of fixed capacity by bulk-synchronous best fit.

Sizes and gaps are whole numbers up to the capacity, so the range-sorted documents and gaps of a round are two histograms. A
sweep walks the sizes from large to small; each is matched to its successor among the gaps, the smallest that holds
it. Equal sizes contend for equal gaps by rank: ranks lo to hi of a size take the containers from c on, and what is
left over goes on to the next gap or opens containers. Gaps are updated and the sweep goes on until every item
is placed. The sweep handles at most capacity + 1 classes whatever the number of documents; ranking the documents and
giving each its container is distributed.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrowmap import map_arrow
from corpusloom.llm.byte_bpe import CACHE, CACHED_LENGTH, FOLDER, SPLIT, load
from corpusloom.session import cut

SALTS = 32
#: Distinct sizes of one spec that the driver sweeps over at most; more are refused with an error, none is dropped.
MOST_SIZES = 5_000_000
#: A sweep's matches are broadcast up to this many rows, joined beyond it.
MOST_BROADCAST = 200_000


class _Counts(dict):
    """word -> number of its tokens, filled on demand, of bounded size."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


class PieceCounter:
    """Token counts of a SentencePiece BPE model, word by word where that is exact.

    If no piece holds a space mark after another character or a line end beside one, no merge joins a word to the spaces or
    line end after it, so a word with the spaces before it is encoded the same wherever it stands. A model with
    other pieces, or one that treats the probes differently, is run over whole texts.
    """

    PROBES = ("a  b\n c\td", "\n", " \n x", "x \n\ny  ", "  ", "é\r\nß ½")

    def __init__(self, model):
        self.model = model
        self.find = re.compile(r" *[^ \n]+|\n| +").findall
        self.words = _Counts(lambda w: len(model.encode(w[1:])) if w[0] == " " and w != " " * len(w) else len(model.encode("\n" + w)) - 2)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.exact = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and all(self.count(p) == len(model.encode(p)) for p in self.PROBES)

    def count(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = self.find(text)
        return len(self.model.encode(first)) + sum(map(self.words.__getitem__, rest))

    def __call__(self, text: str) -> int:
        return self.count(text) if self.exact else len(self.model.encode(text))


@functools.lru_cache(8)
def counter(name: str, folder: str = FOLDER):
    """(split, count): tokens of a text without special tokens are count(split(text)); once per worker process.

    Vocabularies with equal split functions share one call for each text.
    """
    if os.path.exists(path := os.path.join(folder, f"{name}.model")):
        import sentencepiece

        return str, PieceCounter(sentencepiece.SentencePieceProcessor(model_file=path))
    if os.path.exists(os.path.join(folder, f"{name}.tiktoken")):
        bpe = load(name, folder)
        words = _Counts(lambda w: len(bpe.encode_word(w.encode("utf8").decode("latin-1"))))
        return SPLIT, lambda found: sum(map(words.__getitem__, found))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    t.encode_special_tokens = True
    return str, lambda text: len(t.encode(text, add_special_tokens=False).ids)


def count_all(text: str | None, names: list[str], folder: str = FOLDER) -> list[int]:
    if not text:
        return [0] * len(names)
    parts: dict = {}
    out = []
    for split, count in (counter(n, folder) for n in names):
        if split not in parts:
            parts[split] = split(text)
        out.append(count(parts[split]))
    return out


def token_counts(df: DataFrame, id_col: str, text_col: str, names: list[str], folder: str = FOLDER) -> DataFrame:
    """(id, sizes): for each row one token count for each vocabulary; 0 for null and empty texts."""
    kind = dict(df.dtypes)[id_col]

    def fn(c: dict) -> dict:
        return {"id": c["id"], "sizes": [count_all(t, names, folder) for t in c["text"].to_pylist()]}

    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fn, f"id {kind}, sizes array<int>")


def sweep(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Matches (size, first rank, last rank + 1, first container, items a container) and the number of containers.

    sizes: how many items there are of each size from 1 to capacity.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first container, how many)
    order: list[int] = []  # gaps that have containers, ascending
    out, opened = [], 0

    def add(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    for size in sorted(sizes, reverse=True):
        rank, left = 0, sizes[size]
        while left:
            k = bisect.bisect_left(order, size)
            if k < len(order):
                gap = order[k]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(k)
            else:
                gap, first = capacity, opened
                many = -(-left // (capacity // size))
                opened += many
            each = gap // size
            full = min(many, left // each)
            if full:
                out.append((size, rank, rank + full * each, first, each))
                rank, left = rank + full * each, left - full * each
                add(gap - each * size, first, full)
            if left and full < many:  # the last container takes what is left over
                out.append((size, rank, rank + left, first + full, left))
                add(gap - left * size, first + full, 1)
                add(gap, first + full + 1, many - full - 1)
                rank, left = rank + left, 0
            else:
                add(gap, first + full, many - full)
    return out, opened


def pack(df: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER) -> DataFrame:
    """(spec_id, container_id, id_col, piece, start, tokens): where each piece of each row goes, for each spec.

    A row larger than the capacity is cut into full containers and a rest; no other row is split. Null and empty texts
    have 0 tokens and stand in container 0. Repeated rows are items of their own. Specs with a null field or a capacity
    under 1 are ignored; no specs or no rows give no result. Containers count from 0 in each spec.
    """
    spark = df.sparkSession
    wanted = [(r.spec_id, r.tokenizer, r.capacity) for r in specs.select("spec_id", "tokenizer", "capacity").dropna().where("capacity >= 1").collect()]
    kind = dict(df.dtypes)[id_col]
    columns = f"spec_id int, container_id bigint, `{id_col}` {kind}, piece int, start bigint, tokens int"
    if not wanted:
        return spark.createDataFrame([], columns)
    names = sorted({t for _, t, _ in wanted})
    counted = cut(token_counts(df, id_col, text_col, names, folder))
    of = F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).alias("capacity"), F.element_at("sizes", names.index(t) + 1).alias("all")) for s, t, c in wanted])
    items = counted.select("id", F.explode(of).alias("s")).select("id", "s.*")
    pieces = F.when(F.col("all") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil(F.col("all") / F.col("capacity")).cast("int") - 1))
    items = items.withColumn("piece", F.explode(pieces)).withColumn("start", F.col("piece").cast("bigint") * F.col("capacity"))
    items = items.withColumn("size", F.least(F.col("capacity").cast("bigint"), F.col("all") - F.col("start")).cast("int"))
    items = items.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(SALTS)).cast("int"))
    key = ["spec_id", "size", "salt"]
    counts = cut(items.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    plan = []
    totals = counts.groupBy("spec_id", "size").agg(F.sum("n").alias("n"))  # at most capacity + 1 rows a spec
    totals = totals.limit(MOST_SIZES * len(wanted) + 1).collect()
    if len(totals) > MOST_SIZES * len(wanted):
        raise ValueError(f"more than {MOST_SIZES} distinct sizes a spec")
    for s, _, c in wanted:
        matches, _ = sweep({r["size"]: r["n"] for r in totals if r.spec_id == s and r["size"] > 0}, c)
        plan += [(s, *m) for m in matches]
    plan += [(s, 0, 0, 1 << 62, 0, 1 << 62) for s, _, _ in wanted]
    table = spark.createDataFrame(plan, "spec_id int, size int, lo bigint, hi bigint, first bigint, each bigint")
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("spec_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*key).orderBy("id", "piece")) - 1
    ranked = items.join(before, key).withColumn("rank", rank)
    table = F.broadcast(table) if len(plan) <= MOST_BROADCAST else table
    placed = ranked.join(table, ["spec_id", "size"]).where("rank >= lo and rank < hi")
    container = F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))
    return placed.select("spec_id", container.cast("bigint").alias("container_id"), F.col("id").alias(id_col), "piece", "start", F.col("size").alias("tokens"))


def pack_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the fewest containers any packing needs, and the share of room used."""
    used = packed.groupBy("spec_id").agg(F.max("container_id").alias("last"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    r = used.join(specs.select("spec_id", "capacity"), "spec_id").withColumn("containers", F.col("last") + 1)
    return r.select("spec_id", "capacity", "pieces", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used"))
