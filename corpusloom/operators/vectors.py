"""Operators on arrays of numbers: softmax, arg-max, folding a linear head into a token table, pooling, ensembles, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def softmax(v: Column | str, temperature: float = 1.0) -> Column:
    """Max-shifted softmax of v / temperature; null for a null or empty array."""
    x = doubles(v)
    top = F.array_max(x)
    e = F.transform(x, lambda a: F.exp((a - top) / F.lit(float(temperature))))
    return F.transform(e, lambda a: a / F.aggregate(e, F.lit(0.0), lambda s, b: s + b))


def argmax(v: Column | str) -> Column:
    """Index of the first largest element, from 0; null for a null or empty array."""
    x = doubles(v)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def second_best(v: Column | str) -> Column:
    """Index of the second largest element; of equal ones the later index comes second."""
    x = doubles(v)
    ordered = F.array_sort(F.transform(x, lambda a, i: F.struct((-a).alias("v"), i.alias("i"))))
    return F.try_element_at(ordered, F.lit(2))["i"]


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def gelu(x: Column) -> Column:
    """The tanh form."""
    return 0.5 * x * (1 + F.tanh(F.lit(0.7978845608028654) * (x + 0.044715 * x * x * x)))


def vector_mean(df: DataFrame, v: str, keys: list[str]) -> DataFrame:
    """Element-wise mean by key as an array; exploded, so partial sums are combined before the shuffle."""
    x = df.where(F.col(v).isNotNull()).select(*keys, F.posexplode(doubles(v)).alias("pos", "x"))
    m = x.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(v))


def fold_head(table: DataFrame, head: DataFrame, id_col: str, v: str, label: str, weights: str) -> DataFrame:
    """(id_col, row): the table's vectors times every weight row, in label order. The head has one row a label."""
    both = table.crossJoin(F.broadcast(head.select(F.col(label).alias("_l"), F.col(weights).alias("_w"))))
    z = both.select(id_col, "_l", dot(v, "_w").alias("z"))
    return z.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_l", "z"))), lambda s: s["z"]).alias("row"))


def pool(tokens: DataFrame, table: DataFrame, doc: str, token: str, v: str, dims: int, weight: str | None = None) -> DataFrame:
    """(doc, pos, x): mean, or weighted mean, of the table rows of each document's tokens, element by element.

    Tokens without a row are dropped; repeated tokens of a document are counted before the join. With the number of
    columns known, a document's sums are one aggregation row, not one for each element.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    n = tokens.groupBy(doc, token).agg(F.sum(w).alias("_w"))
    j = n.join(table.select(token, doubles(v).alias("_v")), token)
    sums = j.groupBy(doc).agg(F.sum("_w").alias("_n"), *[F.sum(F.col("_w") * F.element_at("_v", i + 1)).alias(f"_{i}") for i in range(dims)])
    return sums.select(doc, F.posexplode(F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(dims)])).alias("pos", "x"))


def smoothed_idf(df: Column, n: Column, power: float = 1.0) -> Column:
    x = F.log((1 + n) / (1 + df)) + 1
    return x if power == 1.0 else F.pow(x, F.lit(power))


def tfidf(terms: DataFrame, doc: str, term: str, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(doc, term, weight): (1 + ln tf) * smoothed idf, L2-normalised; the vocabulary is the most frequent terms."""
    tf = terms.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    if max_features:
        df = df.orderBy(F.desc("cf"), term).limit(max_features)
    n = terms.select(doc).distinct().agg(F.count(F.lit(1)).alias("n"))
    w = tf.join(df.drop("cf"), term).crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * smoothed_idf(F.col("df"), F.col("n")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.select(doc, term, (F.col("w") / norm).alias("weight"))


def quantise(v: Column | str) -> Column:
    """struct(scale, q): int8 rows with one scale a row; scale 1 for a row of zeros."""
    x = doubles(v)
    top = F.array_max(F.transform(x, F.abs))
    scale = F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(x, lambda a: F.bround(a / scale).cast("tinyint")).alias("q"))


def compact_vocabulary(counts: DataFrame, token: str, text: str, count: str, least: int) -> DataFrame:
    """Tokens kept (frequent, of one character, or special ids 0 and 1) with new ids from 0 in old order."""
    keep = (F.col(count) >= least) | (F.length(F.regexp_replace(text, "^[▁Ġ]", "")) == 1) | F.col(token).isin(0, 1)
    return counts.where(keep).withColumn("new_id", F.row_number().over(Window.orderBy(token)) - 1)  # one row a token of the vocabulary


def hashed_bigram(a: Column, b: Column, bits: int) -> Column:
    """Bucket of an ordered token pair."""
    return F.pmod(F.xxhash64(a, b), F.lit(1 << bits))
