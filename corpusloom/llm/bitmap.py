"""A blocked Bloom filter (three bits in one 64-bit word), used to drop rows that can have no partner.

Its size follows the number of keys up to a fixed limit. Built over more keys than fit, it only lets more rows
through: it never drops a row whose key was put in, so results stay whole at every size.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

LOG2_BITS = 27  # 16 MB
#: A filter has about BITS_A_KEY bits a key, from 2**LEAST_LOG2 to 2**MOST_LOG2 bits (64 MB) in all.
BITS_A_KEY, LEAST_LOG2, MOST_LOG2 = 24, 16, 29


def log2_size(keys: int) -> int:
    """log2 of the bits of a filter for so many keys."""
    return min(max((max(keys, 1) * BITS_A_KEY - 1).bit_length(), LEAST_LOG2), MOST_LOG2)


class Bits:
    """A filter stored as a table in the shared folder (path) that each Python worker loads once, or sent (value)."""

    def __init__(self, log2_bits: int, path: str | None = None, sent=None):
        self.log2_bits, self.path, self.sent = log2_bits, path, sent

    @property
    def value(self) -> np.ndarray:
        return _load(self.path, self.log2_bits) if self.path else self.sent.value


def _fill(log2_bits: int, i: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << (log2_bits - 6), np.uint64)
    bits[i.astype(np.int64)] = b.astype(np.int64).view(np.uint64)
    return bits


@functools.lru_cache(1)
def _load(path: str, log2_bits: int) -> np.ndarray:
    where, folder = fs.FileSystem.from_uri(path)
    t = ds.dataset(folder, format="parquet", filesystem=where, exclude_invalid_files=False).to_table()
    return _fill(log2_bits, t["i"].to_numpy(), t["b"].to_numpy())


def build(df: DataFrame, key: str, log2_bits: int = LOG2_BITS) -> Bits:
    """Filter of a BIGINT column of hashes; nulls are left out.

    Its non-zero words, at most 2**(log2_bits - 6), are written to the shared folder, where the workers read them; only
    if they cannot reach that folder by its address they are sent through the driver.
    """
    one = lambda shift: f"shiftleft(1L, cast(shiftrightunsigned({key}, {shift}) & 63 as int))"
    words = (
        df.where(F.col(key).isNotNull())
        .selectExpr(f"cast(shiftrightunsigned({key}, {70 - log2_bits}) as int) as i", f"{one(0)} | {one(6)} | {one(12)} as b")
        .groupBy("i")
        .agg(F.bit_or("b").alias("b"))
    )
    table = cut(words)
    path = table.inputFiles()[0].rpartition("/")[0] if table.inputFiles() else None
    if path is None:
        return Bits(log2_bits, sent=df.sparkSession.sparkContext.broadcast(_fill(log2_bits, np.zeros(0), np.zeros(0))))
    try:
        fs.FileSystem.from_uri(path)
    except (OSError, ValueError):  # an address that only Hadoop understands
        rows = table.toPandas()
        return Bits(log2_bits, sent=df.sparkSession.sparkContext.broadcast(_fill(log2_bits, rows["i"].to_numpy(), rows["b"].to_numpy())))
    return Bits(log2_bits, path=path)


def contains(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For unsigned 64-bit keys; word and bits are made of the key's own bits, so keys must be hashes."""
    word = bits[(keys >> np.uint64(65 - int(len(bits)).bit_length())).astype(np.int64)]
    hit = np.ones(len(keys), np.bool_)
    for shift in (0, 6, 12):
        hit &= (word >> ((keys >> np.uint64(shift)) & np.uint64(63))) & np.uint64(1) != 0
    return hit
