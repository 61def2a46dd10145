"""Deterministic samples: every order is that of a keyed hash and the id, so results do not depend on partitions.

Caps of n rows a group are row_number() <= n; Spark prunes each task's groups to n rows before the shuffle, so a group
with a large share of all rows sends at most n rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def _rank(groups: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*groups).orderBy(*order))


def cap(df: DataFrame, groups: list[str], n: int, id_col: str, seed: str = "0") -> DataFrame:
    """At most n rows of each group, in hashed order. Null group values form a group."""
    return df.withColumn("_r", _rank(groups, [hash_order(seed, id_col), F.col(id_col)])).where(F.col("_r") <= n).drop("_r")


def two_level_cap(df: DataFrame, inner: list[str], n_inner: int, outer: list[str], n_outer: int, id_col: str, seed: str = "0") -> DataFrame:
    """First at most n_inner rows of each inner group, then at most n_outer of each outer one, in one order."""
    return cap(cap(df, inner, n_inner, id_col, seed), outer, n_outer, id_col, seed)


def priority_cap(df: DataFrame, groups: list[str], priority: Column, n: int, id_col: str, seed: str = "0") -> DataFrame:
    return df.withColumn("_r", _rank(groups, [priority, hash_order(seed, id_col), F.col(id_col)])).where(F.col("_r") <= n).drop("_r")


def cap_known(df: DataFrame, group: str, n: int, id_col: str, unknown: tuple[str, ...] = ("", "unknown"), seed: str = "0") -> DataFrame:
    """Caps rows of known groups; rows of unknown or null groups all pass."""
    free = F.col(group).isNull() | F.col(group).isin(*unknown)
    return cap(df.where(~free), [group], n, id_col, seed).unionByName(df.where(free))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", _rank(keys, order)).where("_r = 1").drop("_r")


def round_robin(df: DataFrame, group: str, id_col: str, seed: str = "0") -> DataFrame:
    """Adds turn: the row's place within its group; ordering by it takes one row of each group in turn."""
    return ranked(df, group, id_col, "turn", seed).drop("_total")


def hold_out_groups(sizes: DataFrame, part: str, group: str, size: str, share: float, seed: str = "0") -> DataFrame:
    """Assigns whole groups to the held-out side, in hashed order, until `share` of each part's rows is reached.

    A group is held out if the groups before it hold less than the target; parts of fewer than 3 groups hold none
    out. Works on one row per group.
    """
    w = Window.partitionBy(part).orderBy(hash_order(seed, group), group)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = Window.partitionBy(part)
    target = F.floor(F.sum(size).over(everything) * F.lit(share))
    return sizes.withColumn("before", before.cast("bigint")).withColumn("target", target.cast("bigint")).withColumn("held_out", (F.col("before") < F.col("target")) & (F.count(F.lit(1)).over(everything) >= 3))


def cap_with_start(df: DataFrame, start: DataFrame, group: str, count: str, most: int, part: str, n_part: int, id_col: str, seed: str = "0") -> DataFrame:
    """Rows of each group up to `most` together with what it already has, then at most n_part rows a part."""
    r = df.join(start.select(group, F.col(count).alias("_had")), group, "left").withColumn("_r", _rank([group], [hash_order(seed, id_col), F.col(id_col)]))
    return cap(r.where(F.col("_r") + F.coalesce("_had", F.lit(0)) <= most).drop("_r", "_had"), [part], n_part, id_col, seed)


def sequential_ids(df: DataFrame, id_col: str, name: str, pattern: str = "u%05d", seed: str = "0", buckets_log2: int = 8) -> DataFrame:
    """Numbers all rows from 0 in hashed order.

    The order's leading hex digits cut the rows into buckets; each is numbered by itself after the sizes of those before, so no
    window holds all rows.
    """
    digits = max(1, buckets_log2 // 4)
    h = df.withColumn("_h", hash_order(seed, id_col)).withColumn("_b", F.substring("_h", 1, digits))
    sizes = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # 16 ** digits rows
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col)) - 1
    return h.join(F.broadcast(first), "_b").withColumn(name, F.format_string(pattern, place.cast("bigint"))).drop("_h", "_b", "_first")


def ranked(df: DataFrame, part: str, id_col: str, name: str, seed: str = "0", digits: int = 2) -> DataFrame:
    """Adds each row's place in its part in hashed order, from 1; a null part is a part of its own.

    The order's leading hex digits cut each part into 16 ** digits buckets, numbered by themselves after the sizes of those before, so a part with a third
    of all rows is no single task's window.
    """
    h = df.withColumn("_h", hash_order(seed, id_col)).withColumn("_b", F.substring("_h", 1, digits))
    sizes = h.groupBy(F.col(part).alias("_part"), "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy("_part"))
    first = sizes.select("_part", F.col("_b").alias("_bucket"), before.alias("_first"), total.alias("_total"))
    place = F.col("_first") + F.row_number().over(Window.partitionBy(part, "_b").orderBy("_h", id_col))
    j = h.join(first, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_b") == F.col("_bucket")))
    return j.withColumn(name, place).drop("_h", "_b", "_part", "_bucket", "_first")


def by_place(df: DataFrame, order: str, name: str, buckets: int = 4096) -> DataFrame:
    """Adds each row's place, from 0, in the order of a whole-number column without nulls.

    The column's range is cut into `buckets` even parts, each numbered by itself after the sizes of those before.
    """
    ends = F.broadcast(df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi")))  # one row
    b = df.crossJoin(ends).withColumn("_b", F.floor((F.col(order) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo") + 1) / F.lit(float(buckets)))))
    n = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    first = n.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # `buckets` rows
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return b.join(F.broadcast(first), "_b").withColumn(name, place).drop("_b", "_lo", "_hi", "_first")


def permutation_split(df: DataFrame, part: str, share: float, id_col: str, seed: str = "0") -> DataFrame:
    """Adds is_validation: the first floor(n * share) rows of each part in hashed order."""
    r = ranked(df, part, id_col, "_r", seed)
    return r.withColumn("is_validation", F.col("_r") <= F.floor(F.col("_total") * F.lit(share))).drop("_r", "_total")


def repeat_to(df: DataFrame, n: int, id_col: str, seed: str = "0") -> DataFrame:
    """Rows in hashed order, repeated in turn to exactly n rows (none for an empty table); adds place, from 0.

    Meant for benchmark samples: n bounds the rows kept.
    """
    w = Window.orderBy("_h", id_col)
    top = df.withColumn("_h", hash_order(seed, id_col)).orderBy("_h", id_col).limit(n)
    base = top.withColumn("_i", F.row_number().over(w) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    turns = F.explode(F.sequence(F.lit(0), F.ceil(F.lit(n) / F.col("_m")).cast("int") - 1))
    return base.withColumn("_t", turns).withColumn("place", F.col("_t") * F.col("_m") + F.col("_i")).where(F.col("place") < n).drop("_h", "_i", "_m", "_t")


def even_pick(df: DataFrame, part: str, order: str, k: int) -> DataFrame:
    """k rows of each part, evenly spaced in its order: the rows at int(i * step + step / 2)."""
    w = Window.partitionBy(part)
    r = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.col("_n") / F.lit(k)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * step + step / 2))
    return r.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i").cast("bigint"))).drop("_i", "_n")
