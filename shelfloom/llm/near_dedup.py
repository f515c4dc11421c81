"""MinHash near-deduplication with bottom-k sketches of one hash function.

1. One Arrow pass hashes the word shingles of every text and keeps the ``k``
   smallest distinct hash values (the sketch) and the size of the full set.
2. Texts with the same word sequence fall into one class by a SHA-256 of that
   sequence, so copies cost one sketch whatever their number.
3. Inverted lists of retained values generate overlaps. Values are ordered from
   rare to common over the whole corpus; two sketches that share ``t`` values
   share one among the ``size - t + 1`` rarest of each, so only those are
   listed. A passage that very many texts share falls out of the lists, unless
   it is most of a text.
4. Within a list every member is compared with one pivot (a star, so work is
   linear in the list): the member whose retained values most texts have, as an
   original has them among its copies. If lists still hold many pairs of
   different components, further stars follow: members outside a list's largest
   component meet another pivot from inside it and the most typical of their own.
   The members of whatever lists are then still open are listed anew by their
   full sets, whose prefixes are exact and half as long, and the pairs of
   different components in these lists are enumerated. Two texts that share
   several lists are enumerated in the first only: if they also have the same
   list before this one, they meet there.
5. The sketch of the union (the ``k`` smallest of both) estimates the overlap
   and drops pairs; the survivors' full shingle sets are built from the texts
   and compared exactly.
6. Components of the confirmed links come from contraction on executors.

``t`` is exact for sets that fit into a sketch; for larger ones it lies 4.2
standard deviations below the expected overlap at the threshold. A pair exactly
at the threshold is missed with a probability of about 3e-5, one at 0.8 with
less than 1e-7, and a class is mostly held together by several links. With
``exact`` every text is listed by its full set and no sketch drops a pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, join_classes, materialize, sliced
from .components import connected_components

WORDS_PER_SHINGLE = 5
SKETCH_SIZE = 64
#: A link needs 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 75
#: Further stars are made while the rest holds more than this many pairs a posting (a pair counts in each list that has it).
REST_PER_POSTING = 64
MAX_STARS = 8
_WORD_CACHE = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], known: dict, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    m = min(size, n)
    out = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        out = _mixed(out * np.uint64(0xD6E8FEB86659FD93) + h[i : n - m + 1 + i])
    return np.unique(out.view(np.int64))  # signed, the order of Spark's longs


def shingle_set(text: bytes, size: int = WORDS_PER_SHINGLE) -> set[bytes]:
    """The full set itself, as joined words."""
    words = text.lower().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH_SIZE, size: int = WORDS_PER_SHINGLE) -> DataFrame:
    """``(id, n_shingles, same, sketch)`` per row; ``same`` identifies the word
    sequence and is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in sliced(batches, "text"):
            counts, same, kept = [], [], []
            for text in as_bytes(batch, "text"):
                words = text.lower().split()
                h = shingle_hashes(words, known, size)
                counts.append(len(h))
                same.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
                kept.append(h[:k])
            offsets = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            values = np.concatenate(kept) if kept else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))],
                names=["id", "n_shingles", "same", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, same binary, sketch array<long>")


def least_overlap(k: int, percent: int) -> int:
    """Shared sketch values that a linked pair of large sets has at least."""
    p = percent / 100
    return max(1, math.floor(k * p - 4.2 * math.sqrt(k * p * (1 - p))))


def _postings(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """``(value, node, n, weight, previous)``: the rarest retained values of every
    node that others have too. ``weight`` is how many texts have a retained value
    of the node on average, ``previous`` the node's next rarer listed value."""
    listed = nodes.select("node", "n", F.explode("sketch").alias("value"))
    shared = listed.groupBy("value").count().where("count > 1")
    per_node = Window.partitionBy("node", "n")
    small = int(k * percent / 100)
    held = F.least("n", F.lit(k))
    need = F.when(F.col("n") <= small, F.ceil(F.col("n") * percent / 100)).otherwise(least_overlap(k, percent))
    rare = (
        listed.join(shared, "value")
        .withColumn("place", F.row_number().over(per_node.orderBy("count", "value")))
        .withColumn("unique", held - F.count("*").over(per_node))
        .withColumn("weight", F.sum("count").over(per_node) / held)
        .where(F.col("place") + F.col("unique") <= held - need + 1)
        .select("value", "node", "n", "place", "weight")
    )
    several = rare.join(rare.groupBy("value").count().where("count > 1").select("value"), "value", "left_semi")
    return several.withColumn("previous", F.lag("value").over(Window.partitionBy("node").orderBy("place"))).drop("place")


def _full_postings(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``(value, node, n, component, previous, onward)`` for ``members`` (node,
    component): the rarest values of every full set, as many as leave no linked
    pair without a common one. ``onward`` counts the shared values of the set from
    this one on, so two sets whose first common value it is share no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in sliced(batches, "text", 1 << 20):
            sets = [shingle_hashes(t.lower().split(), known, size) for t in as_bytes(batch, "text")]
            each = np.array([len(h) for h in sets], np.int64)
            place = pa.array(np.repeat(np.arange(len(sets)), each))
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(place), batch.column("body").take(place), pa.array(np.repeat(each, each)), pa.array(values, pa.int64())], names=["node", "body", "n", "value"]
            )

    # an id that occurs with several texts has a set for each of them
    chosen = texts.join(members, "node", "left_semi").select("node", F.xxhash64("text").alias("body"), "text")
    listed = materialize(chosen.mapInArrow(run, "node long, body long, n long, value long"))
    shared = listed.groupBy("value").count().where("count > 1")
    per_text = Window.partitionBy("node", "body")
    in_order = per_text.orderBy("count", "value")
    return (
        listed.join(shared, "value")
        .withColumn("place", F.row_number().over(in_order))
        .withColumn("previous", F.lag("value").over(in_order))
        .withColumn("onward", F.count("*").over(per_text) - F.col("place") + 1)
        .where(F.col("onward") * 100 >= F.col("n") * percent)
        .join(members, "node")
        .select("value", "node", "n", "component", "previous", "onward")
    )


def _compared(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, size: int, percent: int, estimate: bool = True) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough. Without ``estimate``
    only sets that the sketches hold whole are settled by them."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    settled = common * 100 >= percent * F.size(union)
    likely = common >= least_overlap(k, percent) if estimate else F.lit(True)
    hopeful = (
        pairs.join(left, "a").where("na > 0").join(right, "b")
        .where((F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")))
        .where(F.when(whole & (F.size(F.array_union("sa", "sb")) <= k), settled).otherwise(likely))
        .select("a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple] = {"a": (None, None, None), "b": (None, None, None)}
        for batch in sliced(batches, "ta"):
            ids = {s: batch.column(s).to_pylist() for s in "ab"}
            texts = {s: as_bytes(batch, f"t{s}") for s in "ab"}
            keep = []
            for i in range(batch.num_rows):
                for s in "ab":
                    if last[s][:2] != (ids[s][i], texts[s][i]):
                        last[s] = (ids[s][i], texts[s][i], shingle_set(texts[s][i], size))
                one, two = last["a"][2], last["b"][2]
                both = len(one & two)
                keep.append(100 * both >= percent * (len(one) + len(two) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ta, tb = (texts.select(F.col("node").alias(s), F.col("text").alias(f"t{s}")) for s in "ab")
    return hopeful.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH_SIZE, size: int = WORDS_PER_SHINGLE, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id
    reachable over links, itself included) and ``kept`` (id = component_id).

    Null text counts as empty. A text without words is linked with nothing; one of
    any length has its full set. Equal texts are one node. Rows that share an id
    are one document: what one of them links to, all reach. A row without an id is
    linked with nothing; its component is null and it is kept. Ids are whole
    numbers. An empty table gives an empty result; other columns are ignored.
    ``exact`` misses no link, at the price of full sets for all texts.
    """
    rows = materialize(sketch(docs, id_col, text_col, k, size))
    nodes = materialize(
        rows.where("id is not null and same is not null").groupBy("same")
        .agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    )
    postings = materialize(_postings(nodes, k, percent))
    listed = nodes.select("node") if exact else postings.select("node").distinct()
    # shuffled once with the long side; only texts that some list mentions go on
    texts = materialize(
        docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
        .join(listed.hint("shuffle_hash"), "node").select("node", "text")
    )
    inside = materialize(nodes.join(listed, "node", "left_semi").select("node", "n", "sketch"))

    links = materialize(_same_id(rows, nodes))
    done = None
    typical = F.max_by("node", F.struct("weight", -F.col("node"))).alias("pivot")
    pivots = postings.groupBy("value").agg(typical)
    outside = postings
    before = None
    for turn in range(1, MAX_STARS + 1):
        fresh = outside.join(pivots, "value").where("node <> pivot").select(*_pair("node", "pivot")).distinct()
        if done is not None:
            fresh = fresh.join(done, ["a", "b"], "left_anti")
        fresh = materialize(fresh)
        links = materialize(links.unionByName(_compared(fresh, inside, texts, k, size, percent)))
        done = fresh if done is None else done.unionByName(fresh)
        labels = materialize(connected_components(links))
        apart = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        groups = apart.groupBy("value", "component").agg(F.count("*").alias("c"))
        open_lists = materialize(
            groups.groupBy("value").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max_by("component", "c").alias("main")).where("n * n > sq")
        )
        lists = materialize(apart.join(open_lists.select("value", "main"), "value"))
        rest = open_lists.agg(F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2), F.sum("n")).first()
        if not rest[0] or rest[0] <= REST_PER_POSTING * rest[1] or (before and rest[0] > 0.8 * before):
            break
        before = rest[0]
        # for those that are not in the list's largest component: a member of it, and the most typical among themselves
        outside = lists.where("component <> main").select("value", "node", "weight")
        inner = lists.where("component = main").groupBy("value").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot"))
        pivots = inner.unionByName(outside.groupBy("value").agg(typical))
    if rest[0] or exact:
        members = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component")) if exact else lists.select("node", "component").distinct()
        full = materialize(_full_postings(members, texts, size, percent))
        # linked sets differ in size by the threshold's factor at most, so a list is split by their magnitude
        magnitude = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
        full = full.withColumn("magnitude", magnitude)
        near = F.explode(F.sequence(F.col("magnitude") - 1, F.col("magnitude") + 1)).alias("magnitude")
        other = full.select("value", near, *(F.col(c).alias(f"{c}2") for c in ("node", "component", "n", "previous", "onward")))
        fresh = (
            full.join(other, ["value", "magnitude"])
            .where("node < node2 and component <> component2 and not coalesce(previous = previous2, false)")
            .where(F.least("onward", "onward2") * (100 + percent) >= percent * (F.col("n") + F.col("n2")))
            .select(*_pair("node", "node2")).distinct().join(done, ["a", "b"], "left_anti")
        )
        found = materialize(_compared(materialize(fresh), inside, texts, k, size, percent, not exact))
        if not found.isEmpty():
            labels = materialize(connected_components(links.unionByName(found)))

    # classes of many copies are joined apart; a row without words has a key of its own
    classes = nodes.select("same", "node", "copies").join(labels, "node", "left")
    classes = materialize(classes.select(F.hex("same").alias("key"), F.coalesce("component", "node").alias("reached"), "copies"))
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    result = (
        join_classes(rows.select("id", "n_shingles", F.coalesce(F.hex("same"), alone).alias("key")), classes, "key", "copies")
        .select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("reached", "id")).alias("component_id"))
    )
    return result.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _same_id(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the classes that hold different texts of one id."""
    repeated = (
        rows.where("id is not null and same is not null").groupBy("id")
        .agg(F.min(F.xxhash64("same")).alias("one"), F.max(F.xxhash64("same")).alias("other"))
        .where("one <> other").select("id")
    )
    return rows.join(repeated, "id").join(nodes.select("same", "node"), "same").where("node <> id").select(*_pair("node", "id")).distinct()
