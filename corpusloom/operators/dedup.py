"""Exact and near-duplicate removal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import char_tokens, dup_key, is_no_space, tokens
from corpusloom.operators.sampling import keep_first
from corpusloom.session import cut, ship


def exact_dedup(df: DataFrame, order: list[Column], text: str = "text") -> DataFrame:
    """The first row, in `order`, of each duplicate key; rows with a null text are kept."""
    keyed = df.withColumn("_k", dup_key(text))
    return keep_first(keyed.where("_k is not null"), ["_k"], order).unionByName(keyed.where("_k is null")).drop("_k")


def _bands(df: DataFrame, id_col: str, text: str, lang: str, perms: int, rows: int) -> DataFrame:
    chars = is_no_space(lang)
    t = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.when(chars, char_tokens(text)).otherwise(tokens(text)).alias("t"), F.when(chars, 10).otherwise(5).alias("n"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - F.col("n") + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("t", i, F.col("n")), " ")))
    base = t.where(F.size("t") > 0).select("id", F.array_distinct(runs).alias("set"))
    ship(df.sparkSession)
    return base.withColumn("keys", F.pandas_udf(_band_keys(perms, rows), "array<bigint>")("set"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _band_keys(perms: int, rows: int):
    """Band keys of MinHash signatures, vectorised: lambdas over arrays are interpreted in the JVM and take ten times as long."""

    def keys(sets: pd.Series) -> pd.Series:
        if not len(sets):
            return pd.Series([], dtype=object)
        flat = np.concatenate([np.asarray(s, np.int64) for s in sets]).view(np.uint64)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
        out = np.empty((len(sets), perms // rows), np.uint64)
        for b in range(perms // rows):
            k = np.full(len(sets), b + 1, np.uint64)
            for r in range(rows):
                seed = np.uint64((b * rows + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                k = _mix(k ^ np.minimum.reduceat(_mix(flat ^ seed), starts))
            out[:, b] = k
        return pd.Series(list(out.view(np.int64)))

    return keys


def near_pairs(df: DataFrame, id_col: str, text: str = "text", lang: str = "lang", threshold: float = 0.7, perms: int = 64, rows: int = 4) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of different texts whose shingle sets reach the threshold.

    MinHash bands give the candidates, exact set similarity decides. Equal sets are collapsed to their smallest id, so copies
    give no pairs among themselves.
    """
    sets = _bands(df, id_col, text, lang, perms, rows)
    reps = cut(sets.groupBy(F.xxhash64(F.array_sort("set")).alias("h")).agg(F.min(F.struct("id", "set", "keys")).alias("r")).select("r.*"))
    e = reps.select("id", F.explode("keys").alias("key"))
    cand = e.alias("x").join(e.alias("y"), F.col("x.key") == F.col("y.key")).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    s = reps.select("id", "set")
    j = cand.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return j.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def greedy_keep(nodes: DataFrame, pairs: DataFrame, id_col: str = "id", rank: str = "rank") -> DataFrame:
    """(id_col, kept): the rows a pass in rank order keeps if it drops each row similar to one already kept.

    Computed in rounds: a row whose earlier neighbours are all dropped is kept, one with a kept earlier neighbour
    is dropped. Every round settles the first open row of each cluster at least; rows of a chain settle one after another, others in the first rounds.
    """
    edges = cut(pairs.select("a", "b").union(pairs.select("b", "a")).toDF("u", "v").join(nodes.select(F.col(id_col).alias("u"), F.col(rank).alias("ru")), "u").join(nodes.select(F.col(id_col).alias("v"), F.col(rank).alias("rv")), "v").where("rv < ru").select("u", "v"))
    state = cut(edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    open_before = None
    while left := state.where("kept is null").count():
        if left == open_before:
            raise RuntimeError("the keep rule made no progress")
        open_before = left
        seen = edges.join(state.select(F.col("id").alias("v"), F.col("kept").alias("kv")), "v").groupBy(F.col("u").alias("id")).agg(F.coalesce(F.bool_or("kv"), F.lit(False)).alias("hit"), F.bool_or(F.col("kv").isNull()).alias("open"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        state = cut(state.join(seen, "id", "left").select("id", new.alias("kept")))
    return nodes.select(id_col).join(state.select(F.col("id").alias(id_col), "kept"), id_col, "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
