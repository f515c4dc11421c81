"""Lloyd's clustering by two trees.

Every block of vectors carries a cover tree, built once: a node's children are
more than half its scale apart and cover its vectors within that distance, the
first child has the node's own centre. In every round each task builds a tree
over the centroids and walks both trees together: a pair of nodes goes when its
least possible distance is above the largest possible distance of another
pair of the same vectors. Pairs of leaves are compared with whole numbers, so
the result is Lloyd's to the last digit, whatever the blocks are.

A round reads the blocks and shuffles one sum a centroid, component and task;
the driver holds centroids and those sums, nothing that grows with the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize
from .vectors import block_vectors, floor_means, quantised, usable, vector_blocks

#: Vectors of a block.
BLOCK = 1024
#: Vectors of a cover tree's leaf at most, unless they are equal.
LEAF = 8
#: Exact comparisons at a time.
SLICE = 1 << 15
#: Bounds are doubles: pairs within this share of each other are both kept.
SLACK = 1e-9

_NODE = np.dtype([("centre", "i4"), ("radius", "f8"), ("child", "i4"), ("children", "i4"), ("start", "i4"), ("stop", "i4")])


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...i,...i->...", x, x))


def cover_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the vectors and nodes, breadth first, root first: each with its
    centre and its range of vectors (places in that order), its radius and its children."""
    points = vectors.astype(float)
    found: list[list] = [[0, 0.0, 0, 0, 0, 0]]
    members, reach = [np.arange(len(points))], [_length(points - points[:1])]
    scale = [1.0]
    while scale[0] < reach[0].max(initial=0):
        scale[0] *= 2
    number = 0
    while number < len(found):
        inside, away = members[number], reach[number]
        found[number][1] = radius = float(away.max(initial=0))
        if len(inside) > LEAF and radius > 0:
            half = scale[number] / 2
            while half >= radius:
                half /= 2
            found[number][2], centre = len(found), found[number][0]
            while len(inside):
                near = away <= half
                found.append([centre, 0.0, 0, 0, 0, 0])
                members.append(inside[near])
                reach.append(away[near])
                scale.append(half)
                inside = inside[~near]
                if len(inside):
                    centre = inside[0]
                    away = _length(points[inside] - points[centre])
            found[number][3] = len(found) - found[number][2]
        number += 1
    # depth first, so that a node's vectors are one range
    order, stack = [], [0]
    while stack:
        n = stack.pop()
        if found[n][3]:
            stack.extend(range(found[n][2] + found[n][3] - 1, found[n][2] - 1, -1))
        else:
            order.append(members[n])
    order = np.concatenate(order)
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    for node, inside in zip(found, members, strict=True):
        at = place[inside]
        node[0], node[4], node[5] = place[node[0]], at.min(), at.max() + 1
    return order, np.array([tuple(n) for n in found], _NODE)


@dataclass
class CentroidTree:
    """Centroids halved by their distance to two that are far apart; ``members`` of the leaves, one centroid or several equal ones."""

    centre: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    members: list[np.ndarray]

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidTree:
        points, members, children = centroids.astype(float), [np.arange(len(centroids))], []
        centre, radius, number = [], [], 0
        while number < len(members):
            inside = members[number]
            middle = points[inside].mean(axis=0)
            away = _length(points[inside] - middle)
            centre.append(middle)
            radius.append(away.max())
            one = points[inside[away.argmax()]]
            to_one = _length(points[inside] - one)
            if to_one.max() > 0:
                other = points[inside[to_one.argmax()]]
                left = to_one <= _length(points[inside] - other)
                children.append((len(members), len(members) + 1))
                members += [inside[left], inside[~left]]
            else:
                children.append((-1, -1))
            number += 1
        return cls(np.array(centre), np.array(radius), np.array(children), members)


def leaf_pairs(vectors: np.ndarray, nodes: np.ndarray, tree: CentroidTree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that no bound excludes. Each step holds pairs of nodes as two arrays."""
    points = vectors.astype(float)
    most = np.full(len(nodes), np.inf)
    a, b, done = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(a):
        apart = _length(points[nodes["centre"][a]] - tree.centre[b])
        reach = nodes["radius"][a] + tree.radius[b]
        np.minimum.at(most, a, apart + reach)
        keep = apart - reach <= most[a] * (1 + SLACK) + SLACK
        a, b = a[keep], b[keep]
        leaf_a, leaf_b = nodes["children"][a] == 0, tree.children[b, 0] < 0
        done.append((a[leaf_a & leaf_b], b[leaf_a & leaf_b]))
        first = ~leaf_a & (leaf_b | (nodes["radius"][a] >= tree.radius[b]))
        second = ~first & ~leaf_b
        n = nodes["children"][a[first]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        below = np.repeat(nodes["child"][a[first]], n) + step
        most[below] = np.minimum(most[below], np.repeat(most[a[first]], n))
        a, b = np.concatenate([below, np.repeat(a[second], 2)]), np.concatenate([np.repeat(b[first], n), tree.children[b[second]].ravel()])
    a, b = (np.concatenate(x) for x in zip(*done, strict=True))
    # what a leaf learned later holds for its earlier pairs too
    apart, reach = _length(points[nodes["centre"][a]] - tree.centre[b]), nodes["radius"][a] + tree.radius[b]
    keep = apart - reach <= most[a] * (1 + SLACK) + SLACK
    return a[keep], b[keep]


def nearest(vectors: np.ndarray, nodes: np.ndarray, centroids: np.ndarray, tree: CentroidTree) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the nearest centroid, of equal ones the first, and the squared distance."""
    a, b = leaf_pairs(vectors, nodes, tree)
    sizes, widths = nodes["stop"][a].astype(np.int64) - nodes["start"][a], np.array([len(m) for m in tree.members])[b]
    least = np.full(len(vectors), np.iinfo(np.int64).max)
    label = np.full(len(vectors), len(centroids))
    ends = np.cumsum(sizes * widths)
    cuts = [0, *np.flatnonzero(np.diff(ends // SLICE)) + 1, len(a)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if low == high:
            continue
        point = np.concatenate([np.repeat(np.arange(nodes["start"][x], nodes["stop"][x]), w) for x, w in zip(a[low:high], widths[low:high], strict=True)])
        centre = np.concatenate([np.tile(tree.members[y], s) for y, s in zip(b[low:high], sizes[low:high], strict=True)])
        gap = vectors[point] - centroids[centre]
        squared = np.einsum("ij,ij->i", gap, gap)
        before = least.copy()
        np.minimum.at(least, point, squared)
        label[least < before] = len(centroids)
        ties = squared == least[point]
        np.minimum.at(label, point[ties], centre[ties])
    return label, least


def _assigned(batches: Iterator[pa.RecordBatch], dims: int, centroids: np.ndarray) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    tree = CentroidTree.build(centroids)
    for batch in batches:
        for row in batch.to_pylist():
            vectors = block_vectors(row, dims)
            yield row, vectors, *nearest(vectors, np.frombuffer(row["shape"], _NODE), centroids, tree)


def _sums(blocks: DataFrame, dims: int, centroids: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Each centroid's sum and number of vectors."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, vectors, label, _ in _assigned(batches, dims, centroids):
            np.add.at(sums, label, vectors)
            counts += np.bincount(label, minlength=k)
        whole = np.concatenate([counts[:, None], sums], axis=1)
        cell = np.flatnonzero(np.repeat(counts > 0, dims + 1))
        yield pa.record_batch([pa.array(cell), pa.array(whole.ravel()[cell])], ["cell", "part"])

    rows = blocks.select("vectors", "shape").mapInArrow(run, "cell long, part long").groupBy("cell").agg(F.sum(F.col("part").cast("decimal(38,0)"))).collect()
    whole = [[0] * (dims + 1) for _ in range(k)]
    for cell, total in rows:
        whole[cell // (dims + 1)][cell % (dims + 1)] = int(total)
    return [w[1:] for w in whole], [w[0] for w in whole]


def lloyd(rows: DataFrame, start_key: Column, k: int, rounds: int, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per usable vector: id, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Vectors that are null, have another length than ``dims`` or hold null or
    non-finite components are left out; components become whole numbers, floor of
    ``scale`` times the component, beyond 2^26 that bound. Centroids start as the
    k vectors with the smallest ``start_key`` (a column of the id; equal keys by
    id, then vector; null last); with fewer vectors there are fewer. Ids may be null
    or repeated, each row is a vector of its own. An empty table gives an empty
    one. Other columns are ignored. An inertia beyond a long is null.
    """
    spark = rows.sparkSession
    kept = rows.where(usable(F.col(vector_col), dims)).select(F.col(id_col).alias("id"), start_key.alias("start"), quantised(F.col(vector_col), scale).alias("q"))
    first = kept.orderBy(F.col("start").asc_nulls_last(), F.col("id").asc_nulls_last(), "q").limit(k).collect()
    kind = kept.schema["id"].dataType
    if not first:
        return spark.createDataFrame([], T.StructType().add(id_col, kind).add("cluster", "integer").add("distance", "long").add("cluster_inertia", "long").add("inertia", "long").add("centroid_sha256", "string"))
    centroids = [list(r.q) for r in first]

    def arrange(vectors: np.ndarray) -> tuple[np.ndarray, bytes]:
        order, nodes = cover_tree(vectors)
        return order, nodes.tobytes()

    blocks = materialize(vector_blocks(kept, ["id"], dims, block, arrange))
    for _ in range(rounds):
        centroids = floor_means(*_sums(blocks, dims, np.array(centroids, np.int64)), centroids)

    last, id_type = np.array(centroids, np.int64), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, label, squared in _assigned(batches, dims, last):
            yield pa.record_batch([pa.array(row["id"], id_type), pa.array(label.astype(np.int32)), pa.array(squared)], ["id", "cluster", "distance"])

    assigned = materialize(blocks.mapInArrow(run, T.StructType().add("id", kind).add("cluster", "integer").add("distance", "long")))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()
    fits = lambda n: int(n) if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by_cluster = spark.createDataFrame([(c, fits(n), digest[c]) for c, n in sums], "cluster int, cluster_inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(by_cluster), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(fits(sum(n for _, n in sums))).cast("long").alias("inertia"), "centroid_sha256")
