"""Vectors as whole numbers in rows of bytes, and sums over them that need no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlattice.llm.common import materialize, text_rows

Batches = Iterator[pa.RecordBatch]


def whole_vectors(vectors: DataFrame, id_col: str, vector: str, scale: int, shift: int, name: str, **more: Column) -> DataFrame:
    """(id, x, ..) of the rows whose vector has no null, NaN or infinite entry: x holds floor(scale * entry) + shift as 64-bit integers.

    Written to the shared folder. Rows without a vector, and empty vectors, are left out; a vector of another length than its batch's others, or an
    entry beyond 2^50, is an error. ``more``: further columns by name."""
    rows = text_rows(vectors, F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), *[c.alias(n) for n, c in more.items()]).where("v is not null and size(v) > 0")
    others = list(more)
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("x", T.BinaryType()), *[rows.schema[n] for n in others]])

    def run(batches: Batches) -> Batches:
        for b in batches:
            v = b.column("v")
            at = v.offsets.to_numpy()
            values, start = v.values.to_numpy(zero_copy_only=False), at[:-1]  # nulls become NaN
            keep = np.logical_and.reduceat(np.isfinite(values[: at[-1]]), start) if len(start) else np.zeros(0, bool)
            size = np.unique(np.diff(at)[keep])
            if len(size) > 1:
                raise ValueError(f"vectors of different lengths: {size.tolist()}")
            if not keep.any():
                continue
            x = np.floor(values[start[keep][:, None] + np.arange(size[0])] * scale)
            if np.abs(x).max() > 2.0**50:
                raise ValueError("a vector's entry is too large")
            x = np.ascontiguousarray(x.astype("<i8") + shift)
            rest = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([rest.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), *[rest.column(n) for n in others]], names=["id", "x", *others])

    return materialize(rows.mapInArrow(run, schema), name)


def stacked(column: pa.Array, kind: str = "<i8") -> np.ndarray:
    """The rows of a binary column of equal lengths as a matrix."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], most: bool = False) -> np.ndarray | None:
    """The sum of ``of`` over all batches (with ``most`` the entrywise maximum); None without rows.

    Each task adds up its own rows and sends one array. The tasks are two for each core of the cluster, whatever the table's size, so what the driver
    receives is bounded by the cluster and not by the data.
    """
    add = np.maximum if most else np.add

    def run(batches: Batches) -> Batches:
        total = None
        for b in batches:
            if b.num_rows:
                total = of(b) if total is None else add(total, of(b))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.dtype.str]), pa.array([",".join(map(str, total.shape))]), pa.array([total.tobytes()], pa.binary())], names=["kind", "shape", "sum"])

    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, 2)
    parts = rows.coalesce(tasks).mapInArrow(run, "kind string, shape string, sum binary").collect()
    out = None
    for r in parts:
        part = np.frombuffer(r["sum"], r["kind"]).reshape([int(n) for n in r["shape"].split(",") if n])
        out = part if out is None else add(out, part)
    return out
