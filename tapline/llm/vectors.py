"""Feature vectors of flows in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_vector(vector: Column) -> Column:
    """Whether the array is not null, not empty, and holds neither null nor a non-finite entry; never null."""
    entry = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def matrices(batch: pa.RecordBatch, column: int, dimensions: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) for each length of vector in a batch, or for the one given."""
    lists = batch.column(column)
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    out = []
    for size in np.unique(sizes).tolist() if dimensions is None else [dimensions]:
        at = np.flatnonzero(sizes == size)
        if len(at):
            flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            out.append((at, flat.astype(np.float64).reshape(len(at), size)))
    return out
