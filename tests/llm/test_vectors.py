"""Clustering and vector codes against plain whole-number versions."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import clusters, codebooks, queries

SF = "/root/testdata/sf0.001"


def sound(v, dims=64):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(x * scale) for x in v]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_lloyd(vectors, centroids, rounds):
    for number in range(rounds + 1):
        labels = [min(range(len(centroids)), key=lambda k: (squared(v, centroids[k]), k)) for v in vectors]
        if number == rounds:
            return labels, centroids
        for k in range(len(centroids)):
            if own := [v for v, c in zip(vectors, labels, strict=True) if c == k]:
                centroids = [*centroids[:k], [sum(x) // len(own) for x in zip(*own, strict=True)], *centroids[k + 1 :]]


def start_key(i):
    return hashlib.sha256(f"1:{i}".encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 7) for i, v, label in rows], "vec_id long, embedding array<double>, label int, q int")


def made_up(seed, n, dims=64, groups=5):
    dice = np.random.default_rng(seed)
    middle = dice.normal(0, 0.3, (groups, dims))
    rows = [(i, list(map(float, middle[i % groups] + dice.normal(0, 0.05, dims))), i % 3 if i % 7 else None) for i in range(n)]
    rows += [(n + i, rows[3][1], 1) for i in range(n // 3)]  # a hot vector
    ties = [(2 * n + i, [0.5 if j == i else 0.0 for j in range(dims)], 2) for i in range(6)]
    none = [(3 * n, None, 1), (3 * n + 1, [0.1] * (dims - 1), 1), (3 * n + 2, [None] + [0.1] * (dims - 1), 1), (3 * n + 3, [math.nan] * dims, 1), (3 * n + 4, [math.inf] * dims, None), (3 * n + 5, [], 1)]
    return rows + ties + none


def run_lloyd(spark, rows, **options):
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return clusters.lloyd(frame(spark, rows), key, **{"k": 16, "rounds": 3, "dims": 64, "scale": 64, **options}).collect()


@pytest.mark.parametrize(("seed", "block", "k"), [(1, 64, 16), (2, 1024, 16), (3, 100, 40), (4, 30, 1)])
def test_lloyd_equals_the_plain_version(spark, seed, block, k):
    rows = made_up(seed, 200)
    kept = [(i, whole(v, 64)) for i, v, _ in rows if sound(v)]
    first = sorted(kept, key=lambda r: start_key(r[0]))[:k]
    labels, centroids = plain_lloyd([v for _, v in kept], [v for _, v in first], 3)
    out = {r.vec_id: r for r in run_lloyd(spark, rows, block=block, k=k)}
    assert set(out) == {i for i, _ in kept}
    apart = {i: squared(v, centroids[c]) for (i, v), c in zip(kept, labels, strict=True)}
    for (i, _), c in zip(kept, labels, strict=True):
        r = out[i]
        assert (r.cluster, r.distance, r.inertia) == (c, apart[i], sum(apart.values()))
        assert r.cluster_inertia == sum(apart[j] for (j, _), other in zip(kept, labels, strict=True) if other == c)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree(seed):
    dice = np.random.default_rng(seed)
    points = np.floor(dice.normal(0, 40, (300, 5)) + 200 * dice.integers(0, 3, (300, 1))).astype(np.int64)
    points[50:120] = points[7]
    order, nodes = clusters.cover_tree(points)
    moved = points[order]
    assert sorted(order) == list(range(300)) and (nodes[0]["start"], nodes[0]["stop"]) == (0, 300)
    for node in nodes:
        inside = moved[node["start"] : node["stop"]]
        away = np.sqrt(((inside - moved[node["centre"]]) ** 2).sum(axis=1))
        assert away.max() <= node["radius"] + 1e-9
        below = nodes[node["child"] : node["child"] + node["children"]]
        if len(below):
            # children part the node's vectors, lie apart, cover theirs, and the first has the same centre
            assert sum(below["stop"] - below["start"]) == len(inside) and below[0]["centre"] == node["centre"]
            centres = moved[below["centre"]]
            gaps = [np.sqrt(((a - b) ** 2).sum()) for i, a in enumerate(centres) for b in centres[:i]]
            assert not gaps or min(gaps) >= below["radius"].max()
        else:
            assert len(inside) <= clusters.LEAF or node["radius"] == 0


def test_bounds_prune_pairs():
    dice = np.random.default_rng(9)
    middle = dice.normal(0, 4000, (16, 64))
    points = np.floor(middle[dice.integers(0, 16, 1000)] + dice.normal(0, 20, (1000, 64))).astype(np.int64)
    order, nodes = clusters.cover_tree(points)
    tree = clusters.CentroidTree.build(np.floor(middle).astype(np.int64))
    a, b = clusters.leaf_pairs(points[order], nodes, tree)
    compared = ((nodes["stop"][a] - nodes["start"][a]) * np.array([len(tree.members[x]) for x in b])).sum()
    assert compared < 2 * len(points)  # of 16,000 pairs


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096, dims=64):
    kept = [(i, whole(v, scale), label) for i, v, label in rows if sound(v, dims)]
    width, codes, error, digits = dims // parts, {i: "" for i, _, _ in kept}, {i: 0 for i, _, _ in kept}, []
    for p in range(parts):
        cut = lambda v: v[p * width : (p + 1) * width]  # noqa: E731, B023
        labels, book = plain_lloyd([cut(v) for _, v, _ in kept], [cut(v) for _, v, _ in sorted(kept)[:entries]], rounds)
        for (i, v, _), c in zip(kept, labels, strict=True):
            codes[i] += f"{c:02x}"
            error[i] += squared(cut(v), book[c])
        digits += [str(x) for e in book for x in e]
    by_label = {}
    for i, _, label in kept:
        by_label[label] = by_label.get(label, 0) + error[i]
    digest = hashlib.sha256(",".join(digits).encode()).hexdigest()
    return {i: (codes[i], error[i], by_label[label], digest) for i, _, label in kept}


@pytest.mark.parametrize(("seed", "block"), [(5, 37), (6, 8192)])
def test_codes_equal_the_plain_version(spark, seed, block):
    rows = made_up(seed, 90)
    out = codebooks.vector_codes(frame(spark, rows), block=block).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in out} == plain_codes(rows)


def test_moves_are_the_difference_of_sums():
    dice = np.random.default_rng(3)
    x = dice.integers(-100, 100, (500, 16))
    before, after = (dice.integers(0, 4, (500, 2)).astype(np.uint8) for _ in range(2))
    whole_sums = lambda codes: np.array([[[(codes[:, p] == e).sum(), *x[codes[:, p] == e, 8 * p : 8 * p + 8].sum(axis=0)] for e in range(4)] for p in range(2)]).reshape(8, 9)
    cells, change = codebooks.moves(x, before, after, 4)
    full = np.zeros((8, 9), np.int64)
    full[cells] = change
    assert (full == whole_sums(after) - whole_sums(before)).all()
    assert not len(codebooks.moves(x, after, after, 4)[0])


def test_large_numbers_are_exact():
    x = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 3]], np.int64)
    books = np.array([[[1 << 26, 1 - (1 << 26)], [0, 0]]], np.int64)
    codes, error = codebooks.assign(x, books)
    assert codes.ravel().tolist() == [0, 1] and error.tolist() == [1, ((1 << 26) - 1) ** 2 + 9]


def test_odd_tables(spark):
    assert run_lloyd(spark, []) == [] and codebooks.vector_codes(frame(spark, [])).collect() == []
    assert run_lloyd(spark, [(1, None, 1)]) == [] and codebooks.vector_codes(frame(spark, [(1, None, 1)])).collect() == []
    rows = [(None, [0.1] * 64, None), (None, [0.1] * 64, None), (5, [0.2] * 64, 1), (5, [0.3] * 64, 1), (6, [1e30] * 64, 1)]
    out = run_lloyd(spark, rows)
    assert sorted(str(r.vec_id) for r in out) == ["5", "5", "6", "None", "None"] and {r.distance for r in out} == {0}
    out = codebooks.vector_codes(frame(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in out) == ["5", "5", "6", "None", "None"] and {r.label_error for r in out} == {0}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("codes_")]


@pytest.mark.parametrize("name", ["op12_clusters", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    wanted = duckdb.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(wanted.columns)]
    key = "vec_id"
    assert got.sort_values(key).values.tolist() == wanted.sort_values(key).values.tolist() and len(got)
