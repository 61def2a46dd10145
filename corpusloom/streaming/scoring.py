"""Scoring with a token table, and the file stream scored by it: documents that arrive as files, one micro-batch each, without state."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators.vectors import argmax, doubles
from corpusloom.session import ship

#: A table of up to so many rows is sent to the workers (17 columns: 68 MB as float64); a larger one is joined by token.
MOST_ROWS = 500_000


def _joined(docs: DataFrame, table: DataFrame, bias: list[float], doc: str, text: str) -> DataFrame:
    t = docs.select(doc, F.explode_outer(tokens(text)).alias("token"))
    n = t.groupBy(doc, "token").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(table.select("token", doubles("row").alias("row")), "token", "left")
    weighted = [F.sum(F.col("n") * F.element_at("row", i + 1)) for i in range(len(bias))]
    total = F.sum(F.when(F.col("row").isNotNull(), F.col("n")))
    logits = F.array(*[F.coalesce(w / total, F.lit(0.0)) + F.lit(float(b)) for w, b in zip(weighted, bias)])
    return j.groupBy(doc).agg(logits.alias("logits")).select(doc, argmax("logits").alias("label"), "logits")


def score(docs: DataFrame, table: DataFrame, bias: list[float], doc: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc, label, logits): mean of the table rows of a document's tokens plus bias; a document without any gets the bias.

    Null and empty texts have no tokens. The table (token, row) is read once: up to `most_rows` rows are a matrix in each worker, and a document is one
    row of one pass without a shuffle; a larger table is joined by token, and then ids must be unique. Of rows that repeat a token one counts.
    """
    spark, k = docs.sparkSession, len(bias)
    rows = table.where("token is not null and row is not null").select("token", doubles("row").alias("row")).limit(most_rows + 1).toArrow()
    if rows.num_rows > most_rows:
        return _joined(docs, table, bias, doc, text)
    ship(spark)
    vocabulary = rows["token"].combine_chunks()
    matrix = np.asarray(rows["row"].combine_chunks().flatten()).reshape(-1, k) if rows.num_rows else np.zeros((0, k))
    sent, kind = spark.sparkContext.broadcast((vocabulary, matrix)), dict(docs.dtypes)[doc]

    def run(batches):
        words, values = sent.value
        zero = np.vstack([values, np.zeros((1, k))])  # tokens without a row, which are not counted
        for b in batches:
            lists = b.column("t")
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), len(words)).to_numpy(zero_copy_only=False) if len(words) else np.zeros(len(lists.flatten()), np.int64)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            n = np.bincount(row, at < len(words), minlength=len(size))
            sums = np.zeros((len(size), k))
            some = np.flatnonzero(size)
            if len(some):
                sums[some] = np.add.reduceat(zero[at], (np.cumsum(size) - size)[some], axis=0)
            logits = sums / np.maximum(n, 1)[:, None] + np.asarray(bias, np.float64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * k, pa.int32()), pa.array(logits.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(logits.argmax(1).astype(np.int32)), flat], names=[doc, "label", "logits"])

    return docs.select(F.col(doc).alias("id"), tokens(text).alias("t")).mapInArrow(run, f"`{doc}` {kind}, label int, logits array<double>")


def score_stream(spark: SparkSession, folder: str, schema: str, table: DataFrame, bias: list[float], out: str, checkpoint: str):
    """Scores all files of a folder that are new since the checkpoint and stops; returns the finished query."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def batch(df: DataFrame, _: int) -> None:
        score(df, table, bias).write.mode("append").parquet(out)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
