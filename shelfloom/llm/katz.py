"""Katz backoff language model, trained and evaluated in one corpus pass.

Counts of n-grams up to ``order`` are discounted after Good and Turing. What a
history loses by discounting goes to the words that never followed it, in the
proportions of the next lower order: its backoff weight is the lost share over
one minus the lower-order probabilities of its known followers, so that each
history's probabilities, the one of unknown words included, add up to one.

How Spark does it:

1. Each task cuts its texts into blocks of about ``BLOCK`` tokens, a row each:
   ids, lengths, the block's vocabulary and its tokens as places therein.
2. Each block sends its distinct n-grams of every order with their training
   counts to the bucket of their hash; a frequent n-gram is one entry a block.
   Buckets are as many as the corpus needs for a bounded size. They write the
   table of counts (by order and bucket) and answer each block with the counts
   of its n-grams and which of them it is the first to have.
3. Each block turns the counts into probabilities. What its own first n-grams
   take from their histories goes to the table of backoff weights (by history).
4. A token whose n-gram was counted has its probability then; else its history
   is looked up in that table and the next shorter n-gram is taken. Both tables
   are joined by key, none is broadcast or collected.

Words and n-grams are 64-bit hashes; of a thousand million distinct ones, two
coincide with a chance of three percent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .common import as_bytes, materialize, shared_folder, sliced

#: Tokens of a block, more only for a longer text.
BLOCK = 1 << 19
#: Tokens of the corpus for each bucket of n-grams, and the fewest buckets.
BUCKET, LEAST_BUCKETS = 1 << 20, 128
#: Counts up to this one are discounted after Good and Turing.
LIMIT = 5
#: Begin and end of a text; words hold no blanks, so none is like them.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" begin", b" end"))


def _pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed byte planes of the numbers, or of their differences."""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b"", 1)


def _unpack(data: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.decompress(data), np.uint8), np.dtype(kind).itemsize
    values = np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if ascending else values


def codes(text: bytes) -> np.ndarray:
    """Hashes of begin, lower-cased words and end."""
    words = text.lower().split()
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = START, END
    out[1:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return out


def _mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a history's hash and one more word."""
    x = (history ^ (history >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Grams:
    """The n-grams of one length in a block: hashes, ascending; the places that
    end one, and which it is; for each a place that ends it."""

    keys: np.ndarray
    at: np.ndarray
    which: np.ndarray
    first: np.ndarray


class Block:
    """A block's tokens and n-grams. ``hashes[n - 1]`` has for each place the hash of the n-gram that ends there."""

    def __init__(self, row: dict, order: int):
        self.held = np.array(row["held"], bool)
        self.lengths = _unpack(row["lengths"], np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.place = (np.arange(len(self.doc)) - np.repeat(starts, self.lengths)).astype(np.int32)
        self.train = ~self.held[self.doc]
        word = _unpack(row["vocabulary"], np.uint64, True)[_unpack(row["tokens"], np.int32)]
        self.hashes, self.grams = [word], []
        for n in range(1, order + 1):
            if n > 1:
                longer = np.zeros_like(word)
                longer[1:] = _mixed(self.hashes[-1][:-1], word[1:])
                self.hashes.append(longer)
            at = np.flatnonzero(self.place >= max(1, n - 1))
            keys, first, which = np.unique(self.hashes[-1][at], return_index=True, return_inverse=True)
            self.grams.append(Grams(keys, at, which, at[first]))


def _rows(fields: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values, kind) for values, kind in fields.values()], list(fields))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    ids, held, texts, total = [], [], [], 0

    def row(kind: pa.DataType) -> pa.RecordBatch:
        vocabulary, tokens = np.unique(np.concatenate(texts), return_inverse=True)
        return _rows({
            "block": ([f"{task}-{number}"], pa.string()), "ids": ([ids], pa.list_(kind)), "held": ([held], pa.list_(pa.bool_())),
            "lengths": ([_pack(np.array([len(t) for t in texts]))], pa.binary()), "vocabulary": ([_pack(vocabulary, True)], pa.binary()),
            "tokens": ([_pack(tokens.astype(np.int32))], pa.binary()), "n_tokens": ([total], pa.int64()),
        })

    kind = pa.int64()
    for piece in sliced(batches, "text"):
        kind = piece.schema.field("id").type
        for doc_id, out, text in zip(piece.column("id").to_pylist(), piece.column("held").to_pylist(), as_bytes(piece, "text"), strict=True):
            ids.append(doc_id)
            held.append(out)
            texts.append(codes(text))
            total += len(texts[-1]) - 1
            if total >= size:
                yield row(kind)
                ids, held, texts, total, number = [], [], [], 0, number + 1
    if texts:
        yield row(kind)


def _requests(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's n-grams with training counts, cut by bucket: equal ranges of the hashes, so answers joined in order fit the hashes again."""
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row, order)
            for n, grams in enumerate(block.grams, 1):
                counts = np.bincount(grams.which, block.train[grams.at], len(grams.keys)).astype(np.int64)
                bucket = ((grams.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = [*np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets))), len(bucket)]
                parts = list(zip(cuts, cuts[1:], strict=False))
                yield _rows({
                    "bucket": ([int(bucket[a]) for a, _ in parts], pa.int64()), "level": ([n] * len(parts), pa.int32()), "block": ([row["block"]] * len(parts), pa.string()),
                    "keys": ([_pack(grams.keys[a:b], True) for a, b in parts], pa.binary()), "counts": ([_pack(counts[a:b]) for a, b in parts], pa.binary()),
                })


_COUNTED = "kind string, level int, bucket long, block string, keys binary, counts binary, first binary, classes array<long>, total long, types long"


def _count(table: pa.Table) -> pa.Table:
    """One bucket's counts, and the answers to its blocks."""
    out: list[dict] = []
    every = sorted(table.to_pylist(), key=lambda r: r["block"])
    for level in sorted({r["level"] for r in every}):
        rows = [r for r in every if r["level"] == level]
        asked = [_unpack(r["keys"], np.uint64, True) for r in rows]
        given = np.concatenate([_unpack(r["counts"], np.int64) for r in rows])
        flat = np.concatenate(asked)
        seen = np.flatnonzero(given)
        keys, first, which = np.unique(flat[seen], return_index=True, return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, which, given[seen])
        at = np.searchsorted(keys, flat)
        at[at == len(keys)] = 0
        counts = np.where(keys[at] == flat, sums[at], 0) if len(keys) else np.zeros(len(flat), np.int64)
        own = np.zeros(len(flat), np.uint8)
        own[seen[first]] = 1
        bucket = rows[0]["bucket"]
        classes = [int((sums == r).sum()) for r in range(1, LIMIT + 2)]
        out.append({"kind": "count", "level": level, "bucket": bucket, "keys": _pack(keys, True), "counts": _pack(sums), "classes": classes, "total": int(sums.sum()), "types": len(keys)})
        end = 0
        for r, keys_of in zip(rows, asked, strict=True):
            start, end = end, end + len(keys_of)
            out.append({"kind": "answer", "level": level, "bucket": bucket, "block": r["block"], "counts": _pack(counts[start:end]), "first": _pack(own[start:end])})
    return pa.Table.from_pylist(out, pa.schema([("kind", pa.string()), ("level", pa.int32()), ("bucket", pa.int64()), ("block", pa.string()), ("keys", pa.binary()), ("counts", pa.binary()), ("first", pa.binary()), ("classes", pa.list_(pa.int64())), ("total", pa.int64()), ("types", pa.int64())]))


@dataclass
class Discount:
    """What of each count is kept. ``lost[r]`` for counts up to LIMIT and one more, which stands for all larger ones."""

    lost: np.ndarray

    @classmethod
    def fit(cls, classes: list[int]) -> Discount:
        """Katz's discounts by Turing's estimate, where the counts of counts allow
        them (each between nothing and the whole count); else half a count. Counts
        above LIMIT, which Katz leaves whole, lose as much as LIMIT does: a history
        that only such words follow could give nothing to others otherwise."""
        r = np.arange(1, LIMIT + 1)
        half = np.full(LIMIT + 2, 0.5)
        if len(classes) < LIMIT + 1 or min(classes) <= 0:
            return cls(half)
        n = np.array(classes, float)
        common = (LIMIT + 1) * n[LIMIT] / n[0]
        if common >= 1:
            return cls(half)
        ratio = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common)
        lost = r * (1 - ratio)
        if ratio.min() <= 0 or ratio.max() >= 1:
            return cls(half)
        return cls(np.concatenate([[0.0], lost, lost[-1:]]))

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.lost[np.minimum(counts, LIMIT + 1)], 0.0)


@dataclass
class Totals:
    """Sums over the training tokens: their number, their types, the discounts by order and the probability of an unknown word."""

    tokens: int
    types: int
    discounts: list[Discount]
    unknown: float

    @classmethod
    def of(cls, levels: list[tuple[list[int], int, int]]) -> Totals:
        """``levels``: for each order counts of counts, sum of the counts and distinct n-grams."""
        (classes, tokens, types), discounts = levels[0], [Discount.fit(c) for c, _, _ in levels]
        lost = discounts[0].lost
        taken = sum(lost[r] * n for r, n in enumerate(classes[:LIMIT], 1)) + lost[LIMIT + 1] * (types - sum(classes[:LIMIT]))
        return cls(tokens, types, discounts, taken / tokens if tokens else 1.0)


def _resolve(state: pa.Table, answers: pa.Table, order: int, totals: Totals, kind: pa.DataType, schema: pa.Schema) -> pa.Table:
    """A block's documents with what is known of their scores, its share of the backoff weights, and the histories that are still to be looked up."""
    rows = state.to_pylist()
    if not rows:
        return schema.empty_table()
    row, block = rows[0], Block(rows[0], order)
    given = sorted(answers.to_pylist(), key=lambda r: (r["level"], r["bucket"]))
    counts, first = ([np.concatenate([np.zeros(0, t), *(_unpack(r[c], t) for r in given if r["level"] == n)]) for n in range(1, order + 1)] for c, t in (("counts", np.int64), ("first", np.uint8)))
    size = len(block.doc)
    # counts of the n-grams that end at each place; the begin was as often as the end
    ends = block.grams[0]
    n_docs = counts[0][np.searchsorted(ends.keys, END)]
    at_place, share = [], []
    for n, grams in enumerate(block.grams):
        here = np.zeros(size, np.int64)
        here[grams.at] = counts[n][grams.which]
        if not n:
            here[block.place == 0] = n_docs
        at_place.append(here)
        of = at_place[n - 1][grams.first - 1] if n else np.full(len(grams.keys), totals.tokens)
        kept = counts[n] - totals.discounts[n].of(counts[n])
        share.append(np.divide(kept, of, out=np.zeros(len(kept)), where=counts[n] > 0))
    tables = [_documents(row, block, counts[0], totals, kind)]
    score, missing = np.zeros(size), block.place > 0
    open_at, open_history = [], []
    for n in range(order - 1, -1, -1):
        grams = block.grams[n]
        there = np.zeros(size)
        there[grams.at] = share[n][grams.which]
        found = missing & (there > 0)
        score[found] = np.log10(there[found])
        missing &= ~found
        if n:
            asks = np.flatnonzero(missing & (block.place >= n))
            asks = asks[at_place[n - 1][asks - 1] > 0]
            open_at.append(asks)
            open_history.append(block.hashes[n - 1][asks - 1])
            own = np.flatnonzero(first[n])
            last = grams.first[own]
            history, group = np.unique(block.hashes[n - 1][last - 1], return_inverse=True)
            lost = totals.discounts[n].of(counts[n][own]) / at_place[n - 1][last - 1]
            lower = np.zeros(size)
            lower[block.grams[n - 1].at] = share[n - 1][block.grams[n - 1].which]
            tables.append({"history": history.view(np.int64), "lost": np.bincount(group, lost, len(history)), "lower": np.bincount(group, lower[last], len(history)), "kind": "weight"})
    score[missing] = np.log10(totals.unknown)
    tables[0]["score"] = np.bincount(block.doc, score, len(block.lengths))
    doc, (history, number) = block.doc[np.concatenate(open_at)].astype(np.int64), np.unique(np.concatenate(open_history), return_inverse=True)
    pairs, times = np.unique(doc * np.int64(max(1, len(history))) + number, return_counts=True)
    tables.append({"kind": "open", "doc": pairs // max(1, len(history)), "history": history[pairs % max(1, len(history))].view(np.int64), "times": times})
    return pa.concat_tables([_filled(t, row["block"], schema) for t in tables])


def _documents(row: dict, block: Block, counts: np.ndarray, totals: Totals, kind: pa.DataType) -> dict:
    grams, n = block.grams[0], len(block.lengths)
    doc, of = block.doc[grams.at], counts[grams.which]
    base = np.log10((of + 0.5) / (totals.tokens + 0.5 * (totals.types + 1)))
    return {"kind": "doc", "doc": np.arange(n), "id": pa.array(row["ids"], kind), "held_out": block.held, "n_tokens": block.lengths - 1, "n_known": np.bincount(doc, of > 0, n).astype(np.int64), "base_score": np.bincount(doc, base, n)}


def _filled(columns: dict, block: str, schema: pa.Schema) -> pa.Table:
    n = max(len(v) for v in columns.values() if not isinstance(v, str))
    columns = columns | {"block": block}
    value = lambda f: pa.nulls(n, f.type) if f.name not in columns else pa.array([columns[f.name]] * n, f.type) if isinstance(columns[f.name], str) else pa.array(columns[f.name], f.type)
    return pa.table([value(f) for f in schema], schema=schema)


def katz_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens`` (words and the end),
    ``n_known``, ``train_tokens``, ``base_score`` (additive smoothing of words)
    and ``score``, the base 10 logarithm of the text's probability.

    Rows whose ``held_out`` is true (null: false) are scored but not learned from.
    A null or empty text has the end only; texts of any length are used whole
    (a task holds one with some hundred bytes a word); repeated rows count and
    are scored as often as they come; ids may be null or repeated. Without
    training rows every word is unknown, with probability one. An empty table
    gives an empty one. Other columns are ignored. The model's tables stay in
    ``folder`` (below ``spark.checkpoint.dir`` if none is given): counts by order
    and bucket, backoff weights by history.
    """
    if order < 2:
        raise ValueError("a backoff model needs an order of two at least")
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/katz-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    state_type = T.StructType().add("block", "string").add("ids", T.ArrayType(id_type)).add("held", T.ArrayType(T.BooleanType())).add("lengths", "binary").add("vocabulary", "binary").add("tokens", "binary").add("n_tokens", "long")
    state = materialize(rows.mapInArrow(lambda batches: _blocks(batches, block), state_type))
    buckets = max(LEAST_BUCKETS, -(-(state.agg(F.sum("n_tokens")).first()[0] or 0) // BUCKET))

    asked = state.mapInArrow(lambda batches: _requests(batches, order, buckets), "bucket long, level int, block string, keys binary, counts binary")
    asked.groupBy("bucket").applyInArrow(_count, _COUNTED).write.partitionBy("kind", "level").parquet(f"{folder}/counts")
    counted = spark.read.schema(_COUNTED).parquet(f"{folder}/counts")
    sums = counted.where("kind = 'count'").groupBy("level").agg(*(F.sum(F.get("classes", F.lit(i))) for i in range(LIMIT + 1)), F.sum("total"), F.sum("types")).collect()
    by_level = {r[0]: (list(r[1 : LIMIT + 2]), r[-2], r[-1]) for r in sums}
    totals = Totals.of([by_level.get(n, ([0] * (LIMIT + 1), 0, 0)) for n in range(1, order + 1)])

    resolved_type = T.StructType().add("kind", "string").add("block", "string").add("doc", "long").add("id", id_type).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double").add("history", "long").add("times", "long").add("lost", "double").add("lower", "double")
    schema, kind = to_arrow_schema(resolved_type), to_arrow_type(id_type)
    answers = counted.where("kind = 'answer'").select("block", "level", "bucket", "counts", "first")
    both = state.groupBy("block").cogroup(answers.groupBy("block"))
    both.applyInArrow(lambda a, b: _resolve(a, b, order, totals, kind, schema), resolved_type).write.partitionBy("kind").parquet(f"{folder}/resolved")
    resolved = spark.read.schema(resolved_type).parquet(f"{folder}/resolved")

    weights = resolved.where("kind = 'weight'").groupBy("history").agg(F.sum("lost").alias("lost"), F.sum("lower").alias("lower"))
    weights.select("history", F.log10(F.col("lost") / (1 - F.col("lower"))).alias("weight")).write.parquet(f"{folder}/weights")
    weights = spark.read.schema("history long, weight double").parquet(f"{folder}/weights")
    looked_up = resolved.where("kind = 'open'").select("block", "doc", "history", "times").join(weights, "history")
    backed_off = looked_up.groupBy("block", "doc").agg(F.sum(F.col("times") * F.col("weight")).alias("backoff"))
    out = resolved.where("kind = 'doc'").select("block", "doc", "id", "held_out", "n_tokens", "n_known", "base_score", "score").join(backed_off, ["block", "doc"], "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("backoff", F.lit(0.0))).alias("score"),
    )
