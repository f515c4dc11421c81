"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

The codebooks are fitted by Lloyd's rounds that keep what the round before knew:
the codes of all parts, in a table, and for each entry the sum and number of
its parts. A round assigns all parts, but shuffles only what changed: a part
that moves from one entry to another takes its components from the one's sum and
adds them to the other's, added up a block first. In the first round every part
comes from nowhere. Sums are whole numbers, so the running ones are exact.

Vectors are written once, bucketed by block, and so are each round's codes:
they meet without a shuffle of the vectors. The driver holds codebooks and
running sums, nothing that grows with the vectors.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import join_classes, materialize, shared_folder
from .vectors import block_vectors, floor_means, quantised, usable, vector_blocks

#: Vectors of a block.
BLOCK = 8192
#: Vectors of a bucket, and the fewest buckets.
BUCKET, LEAST_BUCKETS = 1 << 18, 16
#: Code of a part before the first round.
NOWHERE = 255
#: Below this, squared distances by matrix product are exact in doubles.
SMALL = 1 << 22


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all parts (of equal entries the first) and the vectors' squared
    distances summed over parts. ``books``: part, entry, component."""
    parts, _, width = books.shape
    codes, error = np.empty((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
    exact = max(np.abs(vectors).max(initial=0), np.abs(books).max(initial=0)) < SMALL
    for p in range(parts):
        x, c = vectors[:, p * width : (p + 1) * width], books[p]
        if exact:
            x, c = x.astype(float), c.astype(float)
            squared = (np.square(x).sum(axis=1)[:, None] - 2 * (x @ c.T) + np.square(c).sum(axis=1)).astype(np.int64)
        else:
            squared = np.stack([np.square(x - e).sum(axis=1) for e in c], axis=1)
        codes[:, p] = squared.argmin(axis=1)
        error += squared.min(axis=1)
    return codes, error


def moves(vectors: np.ndarray, before: np.ndarray, after: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries (part times ``entries`` plus number) whose parts changed, and for
    each the change of its number of parts and of its sum."""
    parts = after.shape[1]
    width = vectors.shape[1] // parts
    change = np.zeros((parts * entries, 1 + width), np.int64)
    touched = np.zeros(parts * entries, bool)
    for p in range(parts):
        moved = before[:, p] != after[:, p]
        x = np.concatenate([np.ones((moved.sum(), 1), np.int64), vectors[moved, p * width : (p + 1) * width]], axis=1)
        old, new = before[moved, p].astype(int), p * entries + after[moved, p].astype(int)
        had = old != NOWHERE
        np.add.at(change, new, x)
        np.subtract.at(change, p * entries + old[had], x[had])
        touched[new] = touched[p * entries + old[had]] = True
    cells = np.flatnonzero(touched)
    return cells, change[cells]


_MOVES = "array<struct<cell: int, change: array<bigint>>>"


def _round(vectors: DataFrame, codes: DataFrame | None, dims: int, books: np.ndarray) -> DataFrame:
    """``block``, new ``codes`` and ``moves`` against the codes before."""
    parts, entries = books.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = block_vectors(row, dims)
                after, _ = assign(x, books)
                before = np.frombuffer(row["codes"], np.uint8).reshape(-1, parts) if row["codes"] else np.full_like(after, NOWHERE)
                cells, change = moves(x, before, after, entries)
                moved = [{"cell": int(c), "change": list(map(int, d))} for c, d in zip(cells, change, strict=True)]
                kind = pa.list_(pa.struct([("cell", pa.int32()), ("change", pa.list_(pa.int64()))]))
                yield pa.record_batch([pa.array([row["block"]]), pa.array([after.tobytes()], pa.binary()), pa.array([moved], kind)], ["block", "codes", "moves"])

    if codes is None:
        rows = vectors.select("block", "vectors", F.lit(None).cast("binary").alias("codes"))
    else:
        rows = vectors.select("block", "vectors").join(codes.select("block", "codes").hint("shuffle_hash"), "block")
    return rows.mapInArrow(run, f"block string, codes binary, moves {_MOVES}")


class _Buckets:
    """Tables in the shared folder, bucketed by block; the catalog knows them for as long as they are in use."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.names = spark, n, []
        self.folder = f"{shared_folder(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"

    def written(self, df: DataFrame) -> DataFrame:
        self.names.append(f"codes_{uuid.uuid4().hex}")
        df.write.bucketBy(self.n, "block").option("path", f"{self.folder}/{len(self.names)}").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")


def vector_codes(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, dims: int = 64, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per usable vector: id, ``code`` (two hex digits a part), ``error``
    (squared distances to the final entries), ``label_error`` (summed over equal
    labels, nulls together) and ``codebooks_sha256``.

    Vectors that are null, hold null or non-finite components, or have another
    length than ``dims`` (no codebook fits those) are left out; components become
    whole numbers, floor of ``scale`` times the component, beyond 2^26 that bound.
    Codebooks start as the parts of the vectors with the smallest ids (equal ids by
    vector, null last); with fewer vectors there are fewer entries. Ids and labels
    may be null or repeated, each row is a vector of its own. An empty table gives
    an empty one. Other columns are ignored. A sum of errors beyond a long is null.
    """
    if dims % parts or entries > NOWHERE:
        raise ValueError("parts must be equally long, and an entry's number fit a byte")
    spark, width = rows.sparkSession, dims // parts
    kept = rows.where(usable(F.col(vector_col), dims)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), quantised(F.col(vector_col), scale).alias("q"))
    first = [list(r.q) for r in kept.select("id", "q").orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()]
    id_kind, label_kind = kept.schema["id"].dataType, kept.schema["label"].dataType
    if not first:
        return spark.createDataFrame([], T.StructType().add(id_col, id_kind).add("code", "string").add("error", "long").add("label_error", "long").add("codebooks_sha256", "string"))
    entries = len(first)
    books = [v[p * width : (p + 1) * width] for p in range(parts) for v in first]

    tables = _Buckets(spark, max(LEAST_BUCKETS, kept.count() // BUCKET))
    vectors = tables.written(vector_blocks(kept, ["id", "label"], dims, block).drop("shape").repartition(tables.n, "block"))
    as_array = lambda: np.array(books, np.int64).reshape(parts, entries, width)
    sums, counts, codes = [[0] * width for _ in books], [0] * len(books), None
    for _ in range(rounds):
        codes = tables.written(_round(vectors, codes, dims, as_array()))
        moved = codes.select(F.explode("moves").alias("m")).select("m.cell", F.posexplode("m.change").alias("place", "part"))
        for cell, place, part in moved.groupBy("cell", "place").agg(F.sum(F.col("part").cast("decimal(38,0)"))).collect():
            if place:
                sums[cell][place - 1] += int(part)
            else:
                counts[cell] += int(part)
        books = floor_means(sums, counts, books)

    final, id_type, label_type = as_array(), to_arrow_type(id_kind), to_arrow_type(label_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, error = assign(block_vectors(row, dims), final)
                yield pa.record_batch([pa.array(row["id"], id_type), pa.array(row["label"], label_type), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], ["id", "label", "code", "error"])

    coded = materialize(vectors.mapInArrow(run, T.StructType().add("id", id_kind).add("label", label_kind).add("code", "string").add("error", "long")))
    tables.forget()
    digest = hashlib.sha256(",".join(str(x) for entry in books for x in entry).encode()).hexdigest()
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = materialize(keyed.groupBy("key").agg(total.try_cast("long").alias("label_error"), F.count("*").alias("n")))
    out = join_classes(keyed, labels, "key", "n")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
