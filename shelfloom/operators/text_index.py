"""A stored inverted index: postings by term bucket, with maxima of document blocks.

Texts are cut once, when they are written or appended, and packed by blocks: the
documents that a worker took one after another. The folder holds

- ``postings``, partitioned by the term's bucket: (term, block, places, tfs), a row
  for each term of a block, with marks: how many documents of the block have it, the
  largest tf and the smallest length. A bucket of their own has the blocks' documents;
- ``docs``: (doc, length, block, place, shared), by which new documents are told from
  known ones; ``shared`` if several rows came with the same id.

All postings of a document are in its block, so a task scores a block by itself and
hands on each query's best. A search reads the asked terms' buckets alone. The marks give document frequencies
and bound the score that any document of a block can reach: blocks that can't reach
the k-th best score of the most promising ones may be left out, with the same result.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfloom.sources.tables import written

from .retrieval import K1, B, tokens

#: Partitions of the postings.
BUCKETS = 16
#: Postings and documents after which a block is full; places fit 16 bits.
BLOCK_TERMS, BLOCK_DOCS = 500_000, 32_000
#: Postings that a worker gathers before it hands them on.
TERMS_AT_ONCE = 100_000


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


_TERM = re.compile("[가-힣]+|[a-z]+|[0-9]+")


def _counting(at_once: int):
    """Batches (doc, text) to batches (doc, length, terms) of about ``at_once`` terms."""

    def packed(doc, lengths, ends, terms, tfs):
        pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], ["term", "tf"])
        return pa.record_batch([doc, pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["doc", "length", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, lengths, ends, terms, tfs = 0, [], [0], [], []
            for i, text in enumerate(batch.column("text"), 1):
                counts = Counter(w.group() for w in _TERM.finditer(text.as_py() or "") if w.end() - w.start() > 1)
                lengths.append(counts.total())
                terms += counts.keys()
                tfs += counts.values()
                ends.append(len(terms))
                if len(terms) >= at_once or i == batch.num_rows:
                    yield packed(batch.column("doc").slice(first, i - first), lengths, ends, terms, tfs)
                    first, lengths, ends, terms, tfs = i, [], [0], [], []

    return run


def _packing(stamp: int, terms_at_most: int, docs_at_most: int):
    """Batches (doc, text) to one batch a block. A worker holds the postings of a block
    and of ``TERMS_AT_ONCE``, whatever a batch has."""
    counting = _counting(TERMS_AT_ONCE)  # here, so that workers need not import this module
    lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.frombuffer(x, kind) for x in parts])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (stamp << 40) + (TaskContext.get().partitionId() << 20)
        docs, lengths, terms, held = [], [], defaultdict(lambda: (array("h"), array("i"))), 0

        def full() -> Iterator[pa.RecordBatch]:
            names = sorted(terms)
            places, tfs = [terms[x][0] for x in names], [terms[x][1] for x in names]
            own, n = np.array(lengths, np.int32), len(names)
            row = lambda values, kind, last=None: pa.concat_arrays([values if isinstance(values, pa.Array) else pa.array(values, kind), pa.array([last], kind)])
            places_list, tfs_list = lists(places, np.int16), lists(tfs, np.int32)
            none = lambda kind: pa.nulls(n, pa.list_(kind))
            kind = pa.concat_arrays(docs).type
            yield pa.record_batch(
                [
                    row(names, pa.string()), pa.array([block] * (n + 1), pa.int64()), row([len(x) for x in places], pa.int64()), row([max(x) for x in tfs], pa.int32()), row([int(own[np.frombuffer(x, np.int16)].min()) for x in places], pa.int32()),
                    row(places_list, pa.list_(pa.int16())), row(tfs_list, pa.list_(pa.int32())), row(none(kind), pa.list_(kind), pa.concat_arrays(docs).to_pylist()), row(none(pa.int32()), pa.list_(pa.int32()), lengths),
                ],
                ["term", "block", "n", "tf", "length", "places", "tfs", "docs", "lengths"],
            )

        for batch in counting(batches):
            counts = batch.column("terms")
            ends, words, tfs = counts.offsets.to_pylist(), counts.values.field(0).to_pylist(), counts.values.field(1).to_pylist()
            for i, length in enumerate(batch.column("length").to_pylist()):
                if not length:
                    continue
                if docs and (held + ends[i + 1] - ends[i] > terms_at_most or len(docs) >= docs_at_most):
                    yield from full()
                    block, held = block + 1, 0
                    docs.clear(), lengths.clear(), terms.clear()
                for j in range(ends[i], ends[i + 1]):
                    places, numbers = terms[words[j]]
                    places.append(len(docs))
                    numbers.append(tfs[j])
                held += ends[i + 1] - ends[i]
                docs.append(batch.column("doc").slice(i, 1))
                lengths.append(length)
        if docs:
            yield from full()

    return run


def _scoring(mean: float, k: int | None):
    """Postings and documents of a block to (query, doc, score)."""

    def run(posts: pa.Table, docs: pa.Table) -> pa.Table:
        found = ([], [], [])
        if posts.num_rows and docs.num_rows:
            docs, posts = docs.sort_by("place"), posts.sort_by("term")  # equal texts add up in the same order
            shared, names = docs["shared"].to_numpy(), docs["doc"].combine_chunks()
            order = np.empty(len(names), np.int64)
            order[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
            weight = K1 * (1 - B + B * docs["length"].to_numpy() / mean)
            places, terms = [x.values.to_numpy() for x in posts["places"]], defaultdict(list)
            parts = []
            for n, (tfs, idf, queries) in enumerate(zip(posts["tfs"], posts["idf"].to_pylist(), posts["queries"].to_pylist(), strict=True)):
                tf = tfs.values.to_numpy().astype(float)
                parts.append(idf * tf * (K1 + 1) / (tf + weight[places[n]]))
                for q in queries:
                    terms[q].append(n)
            for q, own in terms.items():
                score = np.zeros(len(names))
                for n in own:
                    score[places[n]] += parts[n]
                at = np.flatnonzero(score > 0)
                if k and len(at) > k:
                    whole = at[~shared[at]]  # the others' parts are summed over blocks first
                    if len(whole) > k:
                        whole = whole[score[whole] >= np.partition(score[whole], len(whole) - k)[len(whole) - k] - 2e-6]
                        whole = whole[np.lexsort((order[whole], -score[whole]))]
                        # of copies the first k by id
                        whole = whole[np.arange(len(whole)) - np.searchsorted(-score[whole], -score[whole], "left") < k]
                    at = np.concatenate([whole, at[shared[at]]])
                found[0].extend([q] * len(at))
                found[1].append(names.take(pa.array(at)))
                found[2].append(score[at])
        types = posts.schema.field("queries").type.value_type, docs.schema.field("doc").type
        return pa.table({"query": pa.array(found[0], types[0]), "doc": pa.chunked_array(found[1], types[1]), "score": pa.array(np.concatenate(found[2]) if found[2] else [], pa.float64())})

    return run


@dataclass
class TextIndex:
    """``folder`` is one that all executors share."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS
    _known: tuple[int, float, int] | None = None

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: bool = False) -> TextIndex:
        """Add the documents whose id the index doesn't have; of rows that share an
        id all count as one document's. Null ids and texts without terms are left out."""
        docs = docs.where(F.col(id_col).isNotNull())
        stamp = 0
        if not first:
            docs = docs.join(self._read("docs").select(F.col("doc").alias(id_col)), id_col, "left_anti")
            stamp = ((self._of([self.buckets], "postings").agg(F.max("block")).first()[0] or 0) >> 40) + 1
        rows = docs.select(F.col(id_col).alias("doc"), F.lower(text_col).alias("text"))
        kind = rows.schema["doc"].dataType.simpleString()
        packed = rows.mapInArrow(_packing(stamp, BLOCK_TERMS, BLOCK_DOCS), f"term string, block long, n long, tf int, length int, places array<smallint>, tfs array<int>, docs array<{kind}>, lengths array<int>")
        bucket = F.when(F.col("term").isNull(), F.lit(self.buckets)).otherwise(_bucket(F.col("term"), self.buckets))
        # one exchange by bucket; a bucket of frequent terms is split by AQE, not gathered
        packed.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/postings")
        heads = self._of([self.buckets], "postings").where(F.shiftright("block", 40) == stamp).select("block", F.posexplode(F.arrays_zip("docs", "lengths")).alias("place", "x"))
        shared = F.count("*").over(Window.partitionBy("doc")) > 1
        heads.select(F.col("x.docs").alias("doc"), F.col("x.lengths").alias("length"), "block", "place").withColumn("shared", shared).write.mode("append").parquet(f"{self.folder}/docs")  # last: what it names is complete
        self._known = None
        return self

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query, term, bucket, idf) of rows (query, text), a written table."""
        rows = written(queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).withColumn("bucket", _bucket(F.col("term"), self.buckets)))
        wanted = rows.select("bucket", "term").distinct()
        df = self._marks(self._chosen(rows)).join(wanted, ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        docs = self._totals()[0]
        return written(rows.join(df, "term").select("query", "term", "bucket", F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))

    def _chosen(self, asked: DataFrame) -> list[int]:
        """The asked terms' buckets, ``buckets`` at most."""
        return [r[0] for r in asked.select("bucket").distinct().collect()]

    def _of(self, chosen: list[int], name: str) -> DataFrame:
        return self._read(name).where(F.col("bucket").isin(chosen))

    def _marks(self, chosen: list[int]) -> DataFrame:
        return self._of(chosen, "postings").select("bucket", "term", "block", "n", "tf", "length")

    def _totals(self) -> tuple[int, float, int]:
        """Documents, their mean length, and how many share their id."""
        if self._known is None:
            n, length, shared = self._read("docs").agg(F.count("*"), F.sum("length"), F.count_if("shared")).first()
            self._known = n, (length or 0) / n if n else 1.0, shared
        return self._known

    def _impact(self) -> Column:
        return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / self._totals()[1]))

    def scores(self, asked: DataFrame, pairs: DataFrame | None = None, chosen: list[int] | None = None, k: int | None = None) -> DataFrame:
        """(query, doc, score) of every document with an asked term; with ``pairs``
        (query, block) of those blocks only; with ``k`` only of those in a block that
        can be among the query's k best, ordered by score to six digits, then document."""
        chosen = chosen or self._chosen(asked)
        postings = self._of(chosen, "postings")
        of, keys = asked, ["bucket", "term"]
        if pairs is not None:
            of, keys = self._marks(chosen).select(*keys, "block").join(asked, keys).join(pairs, ["query", "block"], "left_semi"), [*keys, "block"]
        hits = postings.join(of.groupBy(*keys).agg(F.first("idf").alias("idf"), F.collect_list("query").alias("queries")), keys).select("block", "term", "places", "tfs", "idf", "queries")
        docs = self._read("docs")
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        schema = f"query {kind(asked, 'query')}, doc {kind(docs, 'doc')}, score double"
        rows = hits.groupBy("block").cogroup(docs.groupBy("block")).applyInArrow(_scoring(self._totals()[1], k), schema)
        return rows.groupBy("query", "doc").agg(F.sum("score").alias("score")) if self._totals()[2] else rows

    def search(self, queries: DataFrame, k: int = 10, prune: bool = False) -> DataFrame:
        """(query, doc, score, rank) of the k best documents for rows (query, text).
        ``prune`` leaves out blocks that can't hold one, which pays for a few rare
        terms; questions of forty frequent words reach every block."""
        asked = self.asked(queries)
        chosen = self._chosen(asked)
        best = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "doc"))).where(F.col("rank") <= k)
        return best(self.scores(asked, self.promising(asked, k, chosen) if prune else None, chosen, k))

    def promising(self, asked: DataFrame, k: int, chosen: list[int] | None = None) -> DataFrame:
        """(query, block) that can hold one of the k best documents."""
        marks = self._marks(chosen or self._chosen(asked)).join(asked, ["bucket", "term"])
        bounds = written(marks.groupBy("query", "block").agg(F.sum(self._impact()).alias("bound"), F.max("n").alias("n")))
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
        lead = bounds.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < k).select("query", "block")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        least = self.scores(asked, lead, chosen, k).withColumn("place", place).where(F.col("place") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        return written(bounds.join(least, "query").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 1e-5).select("query", "block"))


_KNOWN: dict[tuple[str, str], TextIndex] = {}


def index_of(docs: DataFrame, name: str, folder: str) -> TextIndex:
    """The index of a table, written on its first use in this application; ``name`` tells tables apart."""
    key = (docs.sparkSession.sparkContext.applicationId, name)
    if key not in _KNOWN:
        _KNOWN[key] = TextIndex(docs.sparkSession, folder).append(docs, first=True)
    return _KNOWN[key]
