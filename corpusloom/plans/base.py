"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Six decimals: sums of floats differ in their last bits between engines."""
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double"), 6)


#: SQL fragments that mean the same as the library's column functions.
LOWER = "lower(replace(replace({0}, 'İ', 'i̇'), 'Σ', 'σ'))"
WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r\f\v]+'), lambda w: w <> '')"
TOKENS = r"regexp_extract_all(" + LOWER + r", '[\p{{L}}\p{{N}}_]+')"
NO_SPACE = "coalesce({0} in ('ja', 'zh', 'th', 'my', 'km', 'lo'), false)"
HASH_INT = "('0x' || substr(md5({0}), 1, 8))::bigint"


def hash_int(text: Column) -> Column:
    """The first 8 hex digits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
