"""Samples whose category shares follow given targets, by top-down allocation over a category tree.

Each category's quota is the larger of its minimum and its share of the sample. What a category cannot meet is passed to its
siblings in the tree that have rows to spare, then to its cousins, then further up. Rows are drawn at the leaves by the
dense rank of a keyed permutation of their ids. The allocation runs on one row per category; counting and drawing
are distributed, and no window spans a whole category.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Default trees, one path of groups from the root for each category.
LANGUAGE_TREE = {
    **dict.fromkeys(("es", "fr", "it", "ca", "pt", "ro", "gl"), ("indo-european", "romance")),
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no"), ("indo-european", "germanic")),
    **dict.fromkeys(("pl", "ru", "uk", "cs", "hr", "sl", "bg", "sr"), ("indo-european", "slavic")),
    "el": ("indo-european", "hellenic"),
    "hi": ("indo-european", "indic"),
    "tr": ("turkic", "oghuz"),
    "id": ("austronesian", "malayic"),
    "sw": ("niger-congo", "bantu"),
    "zh": ("east-asian", "sinitic"),
    "ja": ("east-asian", "japonic"),
}
LABEL_TREE = {
    **dict.fromkeys(("1", "2", "3", "11"), ("public affairs", "state and conflict")),
    **dict.fromkeys(("4", "9"), ("public affairs", "economy")),
    **dict.fromkeys(("5", "7", "12", "14"), ("people", "society")),
    **dict.fromkeys(("0", "8", "10", "15"), ("people", "leisure")),
    **dict.fromkeys(("6", "13", "16"), ("nature", "science")),
}
MOST_CATEGORIES = 10_000
BUCKET_BITS = 12


def _spread(amount: int, room: dict[str, int], weight: dict[str, int]) -> dict[str, int]:
    """Share out `amount` by weight without exceeding any room: largest remainders, ties by name."""
    out = dict.fromkeys(room, 0)
    while amount > 0:
        open_ = {c: max(weight[c], 1) for c in room if out[c] < room[c]}
        if not open_:
            break
        total = sum(open_.values())
        part = {c: min(room[c] - out[c], amount * w // total) for c, w in open_.items()}
        if not any(part.values()):
            order = sorted(open_, key=lambda c: (-Fraction(amount * open_[c] % total, total), c))[:amount]
            part = {c: 1 for c in order}
        for c, k in part.items():
            out[c] += k
        amount -= sum(part.values())
    return out


def allocate(targets: list[tuple[str, int, int]], counts: dict[str, int], n: int, tree: dict[str, tuple[str, ...]]) -> list[dict]:
    """One record per target (category, permille, min_rows): quota, available, kept, received at each level, short."""
    quota = {c: max(least or 0, ceil(Fraction((permille or 0) * n, 1000))) for c, permille, least in targets}
    weight = {c: permille or 0 for c, permille, _ in targets}
    have = {c: counts.get(c, 0) for c in quota}
    take = {c: min(quota[c], have[c]) for c in quota}
    own = dict(take)
    path = {c: tree.get(c, ()) for c in quota}
    got: dict[str, dict[int, int]] = {c: {} for c in quota}
    unmet = {c: quota[c] - take[c] for c in quota}
    depth = max((len(p) for p in path.values()), default=0)
    for up in range(depth + 1):  # 0: siblings under one parent, 1: cousins, ..., depth: the whole tree
        groups: dict[tuple, list[str]] = {}
        for c in sorted(quota):
            p = path[c] + ("",) * (depth - len(path[c]))
            groups.setdefault(p[: depth - up], []).append(c)
        for members in groups.values():
            lack = sum(unmet[c] for c in members)
            room = {c: have[c] - take[c] for c in members if have[c] > take[c]}
            if not lack or not room:
                continue
            given = _spread(lack, room, weight)
            for c, k in given.items():
                take[c] += k
                if k:
                    got[c][up] = got[c].get(up, 0) + k
            left = sum(given.values())
            for c in sorted(members, key=lambda c: (-unmet[c], c)):
                used = min(left, unmet[c])
                unmet[c] -= used
                left -= used
    return [
        {"category": c, "available": have[c], "quota": quota[c], "taken": take[c], "from_siblings": got[c].get(0, 0), "from_cousins": sum(v for k, v in got[c].items() if k), "unplaced": unmet[c], "short": own[c] < quota[c]}
        for c in quota
    ]


REPORT = "field_name string, category string, available bigint, quota bigint, taken bigint, from_siblings bigint, from_cousins bigint, unplaced bigint, short boolean"


def _rows(df: DataFrame, field: str, id_col: str) -> DataFrame:
    value = F.col(field).cast("string")
    return df.where(F.col(id_col).isNotNull() & F.col(field).isNotNull() & (value != "-1")).select(F.col(id_col).alias("id"), value.alias("category")).distinct()


def quota_report(df: DataFrame, targets: DataFrame, fields: dict[str, dict], id_col: str = "article_id", share: float = 0.5) -> DataFrame:
    """Allocation of each field's sample; the sample size is `share` of the field's distinct ids, rounded down.

    Null values and -1 are in no category; repeated rows count once. A category without rows is reported with 0
    available. Targets of other fields are ignored; an empty table reports every target as short.
    """
    t = targets.where(F.col("field_name").isin(*fields)).limit(MOST_CATEGORIES + 1).collect()
    if len(t) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} target categories")
    both = None
    for f in fields:
        part = _rows(df, f, id_col).groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("field_name", F.lit(f))
        both = part if both is None else both.unionByName(part)
    wanted = F.broadcast(targets.select("field_name", "category").distinct())  # at most MOST_CATEGORIES rows
    sums = both.join(wanted.withColumn("wanted", F.lit(True)), ["field_name", "category"], "left").groupBy("field_name", F.when(F.col("wanted"), F.col("category")).alias("category")).agg(F.sum("n").alias("n")).collect()
    out = []
    for f, tree in fields.items():
        total = sum(r.n for r in sums if r.field_name == f)
        counts = {r.category: r.n for r in sums if r.field_name == f and r.category is not None}
        plan = allocate([(r.category, r.target_permille, r.min_rows) for r in t if r.field_name == f], counts, int(total * Fraction(share)), tree)
        out += [(f, *(x[k] for k in ("category", "available", "quota", "taken", "from_siblings", "from_cousins", "unplaced", "short"))) for x in plan]
    return df.sparkSession.createDataFrame(out, REPORT)


def quota_sample(df: DataFrame, report: DataFrame, field: str, id_col: str = "article_id", seed: int = 7) -> DataFrame:
    """(field_name, category, id_col, draw): the rows drawn for one field; draw is the dense rank in the permutation.

    The permutation's top bits cut each category into buckets whose counts give every bucket's first rank, so a category with
    a third of all rows is ranked by 4,096 tasks' worth of groups and not by one.
    """
    kind = dict(df.dtypes)[id_col]
    plan = F.broadcast(report.where(F.col("field_name") == field).select("category", "taken"))  # one row per target
    rows = _rows(df, field, id_col).join(plan, "category").withColumn("h", F.xxhash64(F.lit(seed), F.col("id"))).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    size = rows.groupBy("category", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = size.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("category").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = rows.join(before, ["category", "bucket"]).where("before < taken")
    ranked = ranked.withColumn("draw", F.col("before") + F.dense_rank().over(Window.partitionBy("category", "bucket").orderBy("h", "id")))
    return ranked.where("draw <= taken").select(F.lit(field).alias("field_name"), "category", F.col("id").cast(kind).alias(id_col), "draw")
