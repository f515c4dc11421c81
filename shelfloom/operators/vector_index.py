"""A stored vector index: lists around coarse centroids.

The centroids are fitted once, on a bounded sample (the rows with the smallest
hashes of their ids, ``SAMPLE`` at most); every row, then and later, is kept in
the list of its nearest centroid, a partition of the stored table. A search compares
its vectors with the rows of the lists whose centroids are nearest, or of all (exact).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfloom.sources import tables

from .retrieval import _unit, nearest

#: Rows that the centroids are fitted on at most; lists at most.
SAMPLE, MOST_LISTS = 20_000, 1024
ROUNDS = 8


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids by rounds of assignment and mean; an empty list takes over the worst placed row."""
    dice = np.random.default_rng(seed)
    middle = sample[dice.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = sample @ middle.T
        mine = near.argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, mine, sample)
        empty = np.flatnonzero(np.bincount(mine, minlength=len(middle)) == 0)
        sums[empty] = sample[near.max(axis=1).argsort()[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(length > 0, sums / np.maximum(length, 1e-300), middle)
    return middle


@dataclass
class VectorIndex:
    """``middle``: the centroids, a bounded parameter; ``folder``: one that all executors share."""

    spark: SparkSession
    folder: str
    middle: np.ndarray

    @classmethod
    def fit(cls, vectors: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fit centroids (about the square root of the rows) and store every row with
        a usable vector: not null, not all zeros, as long as the sample's first."""
        rows = vectors.select(F.col(id_col).alias("id"), _unit(vector_col).alias("v")).where("v is not null")
        taken = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], float)
        lists = lists or int(min(MOST_LISTS, max(1, round(rows.count() ** 0.5))))
        return cls(vectors.sparkSession, folder, centroids(taken, lists) if len(taken) else np.zeros((1, 1))).append(vectors, id_col, vector_col)

    def append(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """Store more rows in the lists there are; nothing is fitted again."""
        rows = vectors.select(F.col(id_col).alias("id"), _unit(vector_col).alias("v")).where((F.size("v") == self.middle.shape[1]) & F.col("v").isNotNull())
        placed = rows.mapInArrow(self._nearest(1), f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, list int")
        # a list that holds many rows is split among tasks by AQE
        placed.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(self.folder)
        return self

    def _nearest(self, n: int, whole: bool = True):
        """Rows (id, v) once for each of their n nearest lists; not ``whole``: without v."""
        middle = self.middle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1) @ middle.T
                best = near.argmax(axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
                kept = ["id", "v"] if whole else ["id"]
                yield pa.record_batch([*(batch.column(c).take(rows) for c in kept), pa.array(best.ravel().astype(np.int32))], [*kept, "list"])

        return run

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.select(F.col("query").alias("id"), _unit("query_embedding").alias("v")).where((F.size("v") == self.middle.shape[1]) & F.col("v").isNotNull()).dropDuplicates(["id"])

    def probed(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """(query, list) of rows (query, query_embedding); all lists without ``probes``."""
        asked = self._asked(queries)
        return asked.mapInArrow(self._nearest(probes or len(self.middle), whole=False), f"id {asked.schema['id'].dataType.simpleString()}, list int").select(F.col("id").alias("query"), "list")

    def _read(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """(query, q, lists): the lists that a query reads as bits, null for all of them."""
        asked, middle = self._asked(queries), self.middle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = None
                if probes and probes < len(middle) and batch.num_rows:
                    near = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1) @ middle.T
                    read = np.zeros(near.shape, bool)
                    np.put_along_axis(read, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                    bits = pa.array([row.tobytes() for row in np.packbits(read, axis=1)], pa.binary())
                yield pa.record_batch([batch.column("id"), batch.column("v"), pa.nulls(batch.num_rows, pa.binary()) if bits is None else bits], ["query", "q", "lists"])

        return tables.written(asked.mapInArrow(run, f"query {asked.schema['id'].dataType.simpleString()}, q array<double>, lists binary"))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query, vec_id, similarity, rank) of the k nearest other rows by cosine."""
        asked, rows = self._read(queries, probes), self.rows()
        tag = F.lit(None).cast("string").alias("tag")
        near = nearest(asked.select("query", "q", tag, "lists"), rows.select(F.col("id").alias("vec_id"), "v", tag, "list"), (rows.count(), asked.count()), k)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 6)), "vec_id"))
        return near.select("query", "vec_id", "similarity").withColumn("rank", place).where(F.col("rank") <= k)

    def sides(self, queries: DataFrame, own: DataFrame, tags: DataFrame, k: int = 10) -> DataFrame:
        """(query, vec_id, similarity, passes): of every query the k nearest other rows
        with its tag and the k nearest with another one or none. ``own`` (query, tag)
        and ``tags`` (vec_id, tag) name the tags; what isn't in them is left out."""
        asked, rows = tables.written(self._read(queries, None).join(own, "query")), self.rows().withColumnRenamed("id", "vec_id").join(tags, "vec_id")
        near = nearest(asked, rows, (self.rows().count(), asked.count()), k)
        return near.select("query", "vec_id", "similarity", F.col("same").alias("passes"))

    def rows_read(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """(query, read): stored rows in each query's lists."""
        sizes = self.rows().groupBy("list").agg(F.count("*").alias("n"))
        return self.probed(queries, probes).join(sizes, "list").groupBy("query").agg(F.sum("n").alias("read"))
