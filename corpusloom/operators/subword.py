"""Subword token ids of a public vocabulary, as the models that score by token take them."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship

FOLDER = "/opt/tokenizers"


@functools.lru_cache(4)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of a batch of texts without special tokens, by a .json (tokenizers), .model (sentencepiece) or .tiktoken (tiktoken, one-to-one ranks) file."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.encode_special_tokens = True  # their names in a text are ordinary text
        return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: m.encode(texts)
    raise ValueError(f"no encoder for {path}")


@functools.lru_cache(4)
def unknown_id(path: str) -> int | None:
    """The id that stands for what the vocabulary lacks; None if there is none."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).unk_id()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    name = getattr(t.model, "unk_token", None)
    return t.token_to_id(name) if name else None


def truncate_and_drop(ids: list[int], most: int, unknown: int | None) -> list[int]:
    """The first `most` ids, then without unknown ones; [0] if nothing is left."""
    return [i for i in ids[:most] if i != unknown] or [0]


def subword_ids(df: DataFrame, id_col: str, text: str = "text", tokenizer: str = "word_bpe_49k.json", most: int = 512, folder: str = FOLDER) -> DataFrame:
    """(id_col, ids): each row's token ids: cut to `most` first, unknown ones dropped then, [0] for texts without any.

    Null and empty texts give [0]; null ids and repeated rows stay rows. One Arrow pass without a shuffle.
    """
    ship(df.sparkSession)
    kind, path = dict(df.dtypes)[id_col], os.path.join(folder, tokenizer)

    def run(batches):
        encode, unknown = encoder(path), unknown_id(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = [truncate_and_drop(x, most, unknown) for x in encode([t or "" for t in part.column("text").to_pylist()])]
                offsets = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=[id_col, "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def known_ids(df: DataFrame, known: list[int], ids: str = "ids") -> DataFrame:
    """The ids a table has rows for, in order; [0] where none is left. `known` is a vocabulary of bounded size, sent once."""
    few = F.array(*[F.lit(int(i)) for i in known]) if len(known) <= 100 else None
    if few is not None:
        kept = F.filter(ids, lambda x: F.array_contains(few, x))
        return df.withColumn(ids, F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(0))))
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(np.unique(np.asarray(known, np.int32)))

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(ids)
            lists = b.column(at)
            x, n = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            keep, row = np.isin(x, sent.value), np.repeat(np.arange(len(n)), n)
            left = np.bincount(row[keep], minlength=len(n))
            values = [v if len(v) else np.zeros(1, np.int32) for v in np.split(x[keep], np.cumsum(left)[:-1])] if len(n) else []
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([flat if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)
