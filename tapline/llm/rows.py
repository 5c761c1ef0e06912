"""Arrow batches in and out of the operators' tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_CHARS = 4_000_000


def text_slices(batches: Iterable[pa.RecordBatch], text: int = 1, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` bytes of text each, and the texts, null as ''.

    It bounds what a task holds at once; a single longer text is a slice of its own.
    """
    for batch in batches:
        column = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [x or "" for x in part.column(text).to_pylist()]
            start = stop


def id_and_text(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names, so that no other column's name can clash."""
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def id_type(rows: DataFrame, id_col: str) -> str:
    return rows.select(F.col(f"`{id_col}`")).schema.fields[0].dataType.simpleString()


def map_texts(
    rows: DataFrame, id_col: str, text_col: str, one: Callable[[], Callable[[list[str]], list[pa.Array]]], columns: str | list[str]
) -> DataFrame:
    """``id`` and, from every text, the columns that ``one()`` makes of a list of texts.

    ``one`` is called once in each task and returns the function that is applied to every slice.
    """
    kind = id_type(rows, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = one()
        for part, texts in text_slices(batches):
            made = apply(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["id", *names])

    columns = columns.split(", ") if isinstance(columns, str) else columns
    names = [c.split(" ")[0] for c in columns]
    return id_and_text(rows, id_col, text_col).mapInArrow(run, ", ".join([f"id {kind}", *columns]))
