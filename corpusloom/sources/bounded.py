"""A data source that reads the start of gzip JSON-line streams: up to a number of compressed bytes and of records."""

from __future__ import annotations

import gzip
import json
from urllib.parse import urlparse
from urllib.request import url2pathname, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Counted:
    """A stream that ends after `most` bytes."""

    def __init__(self, raw, most: int):
        self.raw, self.left = raw, most

    def read(self, n: int = -1) -> bytes:
        data = self.raw.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(data)
        return data


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = [f.name for f in schema.fields]
        self.urls = [u for u in options.get("urls", options.get("path", "")).split(",") if u]
        self.most_bytes = int(options.get("maxbytes", 50_000_000))
        self.most_records = int(options.get("maxrecords", 25_000))

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        u = urlparse(partition.value)
        raw = open(url2pathname(u.path), "rb") if u.scheme in ("", "file") else urlopen(partition.value, timeout=60)  # noqa: S310
        n = 0
        with raw:
            try:
                for line in gzip.GzipFile(fileobj=_Counted(raw, self.most_bytes)):
                    try:
                        row = json.loads(line)
                    except ValueError:
                        continue
                    if n >= self.most_records:
                        return
                    n += 1
                    yield tuple(None if row.get(f) is None else str(row[f]) for f in self.fields)
            except (EOFError, OSError):  # cut or broken stream: what was read so far counts
                return


class BoundedJsonLines(DataSource):
    """Format 'bounded_jsonl': options urls (comma separated), maxBytes, maxRecords; string columns by the given schema."""

    @classmethod
    def name(cls) -> str:
        return "bounded_jsonl"

    def schema(self) -> str:
        return "title string, maintext string, language string, fasttext_language string, source_domain string, url string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoundedJsonLines)
