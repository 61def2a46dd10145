"""mapInArrow with functions on plain column dictionaries, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from corpusloom.session import ship

#: A slice has at most so many rows, and so many bytes of text unless one row alone has more.
ROWS, BYTES = 2000, 8 << 20


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | str) -> pa.Array:
    """A list column without a Python object per element."""
    values = values.view(np.int64) if values.dtype == np.uint64 else values
    kind = pa.type_for_alias(kind) if isinstance(kind, str) else kind
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _typed(x, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.Array):
        return x if x.type == kind else x.cast(kind)
    return pa.array(x, kind)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            size += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, base + BYTES, "right"))))
        yield batch.slice(at, to - at)
        at = to


def map_arrow(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """`fn` gets {column: pyarrow Array} for up to ROWS rows and returns {column: array}, of any length."""
    ship(df.sparkSession)
    to = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                out = fn({n: c for n, c in zip(part.schema.names, part.columns)})
                yield pa.RecordBatch.from_arrays([_typed(out[f.name], f.type) for f in to], schema=to)

    return df.mapInArrow(run, schema)
