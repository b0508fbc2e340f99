"""Arrow batches of texts as byte buffers, in slices of bounded size, and columns appended to a table by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as strings with 32-bit offsets, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 places where they begin and end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of ``batch`` whose texts have at most ``limit`` bytes together, with those texts."""
    texts = text_array(batch.column(column))
    _, offsets = text_bytes(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low), texts.slice(low, high - low)
        low = high


def append_columns(
    df: DataFrame, column: str, added: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]]
) -> DataFrame:
    """``df`` with the columns named in the DDL string ``added``, computed from the texts of ``column`` batch by batch.

    ``make`` builds the function of a task once. An input column that has the name of an added one is replaced.
    """
    new = T.StructType.fromDDL(added)
    taken = {name.lower() for name in new.names}
    kept = df.select(*[c for c in df.columns if c.lower() not in taken or c == column])
    if column.lower() in taken:
        raise ValueError(f"the text column {column!r} can't have the name of a result")
    schema = T.StructType(kept.schema.fields + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part, texts in slices(batch, column):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(texts)], names=schema.names)

    return kept.mapInArrow(run, schema)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column from flat values and the n + 1 places where the lists begin and end."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
