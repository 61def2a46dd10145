"""Readers and sinks for files: declared schemas, tolerant reads, several sources in one shape, logs and line formats."""

from __future__ import annotations

import io
import itertools
import json
import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.session import ship

ARTICLE = "document_id string, lang string, text string, label string, split string"
CORPUS = "text string, lang string, domain string, url string"
PREDICTION = "model string, `set` string, doc_id string, logits array<float>"
METRIC = "model string, threads int, run int, value double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches something on any file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType, missing_ok: bool = False) -> DataFrame:
    """JSON lines, gzip by extension, with a declared schema; lines that are no JSON are dropped.

    With missing_ok absent paths are left out, and none at all gives an empty table of the schema.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if missing_ok:
        paths = [p for p in paths if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def read_articles(spark: SparkSession, path: str, label_ids: dict[str, int], split: str | None = None) -> DataFrame:
    """Annotated articles with label_id (null for a label without id), of one split or of all; the filter reaches the scan."""
    df = read_jsonl(spark, path, ARTICLE)
    if split:
        df = df.where(F.col("split") == split)
    ids = F.create_map(*[F.lit(x) for kv in label_ids.items() for x in kv])
    return df.withColumn("label_id", F.element_at(ids, F.col("label")))


def pick_columns(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns found by any of their spellings without regard to case; missing ones are null strings."""
    have = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name, spellings in wanted.items():
        found = next((have[s.lower()] for s in spellings if s.lower() in have), None)
        out.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of a CSV whose label column is called label or labels; rows without text are dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return pick_columns(raw, {"label": ("label", "labels"), "text": ("text", "body", "article")}).where("text is not null")


NORMAL = ("source", "lang", "source_label", "headline", "body", "url", "domain")


def normalise_source(df: DataFrame, source: str, lang: str | None = None, lang_from: str | None = None, **columns: str) -> DataFrame:
    """One dataset in the common shape; columns maps the common names to the dataset's, others are null.

    The language is fixed by `lang` or taken from the column `lang_from`.
    """
    col = lambda n: F.col(columns[n]).cast("string") if n in columns else F.lit(None).cast("string")
    url = col("url")
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    given = {"source": F.lit(source), "lang": F.lit(lang) if lang else F.col(lang_from).cast("string") if lang_from else F.lit(None).cast("string"), "domain": F.coalesce(col("domain"), F.when(host != "", F.lower(host)))}
    return df.select(*[given.get(n, col(n)).alias(n) for n in NORMAL])


def union_sources(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no sources")
    return out


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in `order`, as for an append-only log."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Keyed predictions, partitioned so that one model and set is one folder."""
    df.write.mode("append").partitionBy("model", "set").parquet(path)


def read_predictions(spark: SparkSession, path: str, model: str | None = None, set_: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    for name, v in (("model", model), ("set", set_)):
        if v is not None:
            df = df.where(F.col(name) == v)
    return df


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work whose keys are not among the finished ones."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def fasttext_lines(df: DataFrame, label: str, tokens: str, id_col: str, seed: str = "0") -> DataFrame:
    """(value): '__label__<label> <tokens>' lines in hashed order; null labels and tokens are left out."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    return df.where(F.col(label).isNotNull() & F.col(tokens).isNotNull()).orderBy(h, id_col).select(F.concat(F.lit("__label__"), F.col(label).cast("string"), F.lit(" "), F.col(tokens)).alias("value"))


def write_lines(df: DataFrame, path: str, kind: str, **options: str) -> None:
    """Sinks: 'jsonl', 'csv' (with header), 'text' or 'parquet'."""
    w = df.write.options(**options)
    {"jsonl": w.json, "csv": w.option("header", True).csv, "text": w.text, "parquet": w.parquet}[kind](path)


def merge_best(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The current table with the rows of `new` in place of those of equal key."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


# --- web archives ---

WARC = "uri string, date string, status int, content_type string, html string"


class _Gunzip(io.RawIOBase):
    """Reads gzip members of a file one after another; ends where the data are broken, keeping what was read before."""

    def __init__(self, source):
        self.source, self.raw, self.part, self.out = source, b"", None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.out:
            self.raw = self.raw or self.source.read(1 << 20)
            if not self.raw:
                break
            try:
                self.part = self.part or zlib.decompressobj(31)
                self.out = self.part.decompress(self.raw, 1 << 20)
                self.raw = self.part.unconsumed_tail
                if self.part.eof:
                    self.raw, self.part = self.part.unused_data, None
            except zlib.error:
                self.raw, self.source = b"", io.BytesIO()
        n = min(len(out), len(self.out))
        out[:n], self.out = self.out[:n], self.out[n:]
        return n


def _warc_records(source):
    stream = io.BufferedReader(source) if isinstance(source, io.RawIOBase) else source
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(_Gunzip(stream))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (h := stream.readline().strip()):
            k, _, v = h.partition(b":")
            head[k.strip().lower()] = v.strip()
        try:
            body = stream.read(int(head.get(b"content-length", b"0")))
        except ValueError:
            return
        yield head, body


def html_responses(source):
    """Of an archive open for reading: (uri, date, status, content type, text) of the HTML responses with status 200; a broken tail ends the file."""
    for head, body in _warc_records(source):
        if head.get(b"warc-type") == b"response":
            top, _, page = body.partition(b"\r\n\r\n")
            lines = top.split(b"\r\n")
            code = lines[0].split()[1:2]
            status = int(code[0]) if code and code[0].isdigit() else 0
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
            kind = fields.get(b"content-type", b"").decode("latin-1")
            if status == 200 and "html" in kind.lower():
                yield head.get(b"warc-target-uri", b"").decode("utf8", "replace"), head.get(b"warc-date", b"").decode("latin-1"), status, kind, page.decode("utf8", "replace")


#: A batch of pages has at most so many rows and about so many characters.
PAGE_ROWS, PAGE_CHARS = 200, 16 << 20


def read_warc(spark: SparkSession, path: str, most_pages: int | None = None) -> DataFrame:
    """HTML responses of WARC files, at most `most_pages` of each file if given.

    A gzip archive cannot be split, so one task reads one file; it is read as a stream, record by record, and pages are handed on in batches of
    bounded size, so archives may be larger than memory. Where the workers cannot open the files by their address, Spark hands them over whole.
    """
    ship(spark)
    rows = spark.read.format("binaryFile").load(path)
    named = rows.select("path").limit(1).first()
    direct = bool(named) and _opens(named[0])
    files = rows.select("path") if direct else rows.select("content")
    count = max(files.count(), 1) if direct else None
    files = files.repartition(count, "path") if direct else files

    def run(batches):
        import pandas as pd

        for b in batches:
            for x in b["path" if direct else "content"]:
                with _open(x) if direct else io.BufferedReader(io.BytesIO(bytes(x))) as source:
                    page_rows, size = [], 0
                    for page in itertools.islice(html_responses(source), most_pages):
                        page_rows.append(page)
                        size += len(page[-1])
                        if len(page_rows) >= PAGE_ROWS or size >= PAGE_CHARS:
                            yield pd.DataFrame(page_rows, columns=["uri", "date", "status", "content_type", "html"])
                            page_rows, size = [], 0
                    yield pd.DataFrame(page_rows, columns=["uri", "date", "status", "content_type", "html"])

    return files.mapInPandas(run, WARC)


def _open(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return io.BufferedReader(where.open_input_stream(name, compression=None))


def _opens(path: str) -> bool:
    try:
        _open(path).close()
    except (OSError, ValueError):
        return False
    return True


def cached_table(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at `path`, built and written first if it is not there yet."""
    if not exists(spark, path + "/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_model(table: DataFrame, meta: dict, path: str) -> None:
    """A token table as Parquet and its metadata (bias, labels, tokenizer name) as one JSON line beside it."""
    table.write.mode("overwrite").parquet(path + "/table")
    table.sparkSession.createDataFrame([(json.dumps(meta, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/meta")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(path + "/table"), json.loads(spark.read.text(path + "/meta").first().value)
