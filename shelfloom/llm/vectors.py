"""Integer vectors in blocks, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Components are held between minus and plus this, so that squared distances of up to 128 components fit a long.
MOST = 1 << 26


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none null, NaN or infinite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, fine), F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    """Floor of ``scale`` times each component, taken as a double."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int"))


def vector_blocks(rows: DataFrame, keep: list[str], dims: int, size: int, arrange: Callable[[np.ndarray], tuple[np.ndarray, bytes]] | None = None) -> DataFrame:
    """``rows`` (columns ``keep`` and ``q``) in blocks of at most ``size`` vectors,
    a row each: ``block``, a list of each kept column, ``vectors`` (32-bit numbers).
    ``arrange`` gives an order of a block's vectors and what is stored as
    ``shape`` beside them."""
    types = {c: rows.schema[c].dataType for c in keep}
    schema = T.StructType().add("block", "string")
    for c, kind in types.items():
        schema = schema.add(c, T.ArrayType(kind))
    schema = schema.add("vectors", "binary").add("shape", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                piece = batch.slice(start, size)
                vectors = piece.column("q").flatten().to_numpy().reshape(piece.num_rows, dims)
                order, shape = arrange(vectors) if arrange else (np.arange(len(vectors)), b"")
                lists = [pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(c).take(pa.array(order))) for c in keep]
                yield pa.record_batch(
                    [pa.array([f"{task}-{number}"]), *lists, pa.array([np.ascontiguousarray(vectors[order], np.int32).tobytes()], pa.binary()), pa.array([shape], pa.binary())],
                    ["block", *keep, "vectors", "shape"],
                )
                number += 1

    return rows.select(*keep, "q").mapInArrow(run, schema)


def block_vectors(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], np.int32).reshape(-1, dims).astype(np.int64)


def floor_means(sums: list[list[int]], counts: list[int], old: list[list[int]]) -> list[list[int]]:
    """Componentwise exact floor of sum over count; the old one where nothing was counted."""
    return [[s // n for s in total] if n else before for total, n, before in zip(sums, counts, old, strict=True)]
