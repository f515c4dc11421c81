"""Document retrieval: chunks, BM25, vector search, rank and confidence fusion.

Queries are rows too, so one plan serves a batch of them. The indexes that terms
and vectors are stored in have modules of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.sources.tables import written

K1, B = 1.5, 0.75
RRF_K = 60


def tokens(c: Column) -> Column:
    """Hangul, Latin or digit runs longer than one character, lower case."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[가-힣]+|[a-z]+|[0-9]+"), F.lit(0)), lambda x: F.length(x) > 1)


def paragraphs(docs: DataFrame, size: int = 500) -> DataFrame:
    """Cut texts at line ends and long lines into pieces of ``size`` characters: (doc_id, chunk, content)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body")).where(F.length("body") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / size).cast("int")), lambda i: F.substring(F.col("body"), i * size + 1, F.lit(size)))
    return lines.select("doc_id", "line", F.posexplode(parts).alias("part", "content"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


#: Rows of one block of vectors and query vectors of one block at most, on average: a
#: task holds one of each, and their products in pieces of ``PIECE`` numbers.
ROW_BLOCK, QUERY_BLOCK, PIECE = 32_768, 32_768, 4_000_000


def _unit(name: str) -> Column:
    """The vector at length 1, null for a vector of zeros."""
    v = F.transform(F.col(name), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    # the norm as an array: inside a lambda it would be taken again for every component
    return F.when(norm > 0, F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n))


def blocks_of(n: int, size: int) -> int:
    return max(1, -(-n // size))


def nearest(asked: DataFrame, rows: DataFrame, sizes: tuple[int, int], k: int = 10, block: int = QUERY_BLOCK, own: bool = False) -> DataFrame:
    """(query, vec_id, similarity, same) of the k nearest other rows (vec_id, v, tag, list)
    of every row (query, q, tag, lists), each of the two values of ``same`` (equal tags,
    not null) for itself: k of those with it, k of those without. Ties of rounded
    similarity go by vec_id. ``lists``: bits of the lists that a query reads, null for
    all. ``own``: rows and queries without a vector, or of other lengths, meet with a
    null similarity; else they don't meet. ``sizes``: rows and queries.

    Both sides go in blocks by a hash; a block of vectors and one of queries meet in a
    task as matrices, and the k best of each query leave it."""
    tall, wide = blocks_of(sizes[0], ROW_BLOCK), blocks_of(sizes[1], block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.select("vec_id", "v", "tag", "list", part("vec_id", tall).alias("_row"), every(wide).alias("_query"))
    right = asked.select("query", "q", "tag", "lists", every(tall).alias("_row"), part("query", wide).alias("_query"))
    piece = PIECE

    def matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Places and vectors by length; without length: none."""
        flat = vectors.combine_chunks()
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        length = pc.fill_null(pc.list_value_length(flat), -1).to_numpy(zero_copy_only=False)
        numbers, out = flat.flatten().to_numpy(zero_copy_only=False), {}
        starts = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        for n in np.unique(length[length >= 0]).tolist():
            places = np.flatnonzero(length == n)
            out[n] = places, numbers.reshape(-1, n) if n and len(places) == len(length) else numbers[starts[places][:, None] + np.arange(n)]
        return out

    def plain(column: pa.ChunkedArray) -> np.ndarray:
        return column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), str)

    #: No number ranks above all, no vector below, and what doesn't count lowest.
    above, absent, out = 9.0, -8.0, -9.0

    def best(rated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each row's k largest by six digits, then column."""
        groups = rated.shape[1] // 64
        least = np.full((len(rated), 1), (absent + out) / 2)
        if groups > k:  # k groups reach the k-th largest of their maxima
            heads = rated[:, : groups * 64].reshape(len(rated), groups, 64).max(axis=2)
            least = np.maximum(least, np.partition(heads, groups - k, axis=1)[:, groups - k, None] - 2e-6)
        i, j = np.nonzero(rated >= least)
        if len(i) > 400 * len(rated) and rated.shape[1] > k:  # copies: of those equal to the last, as many as are missing
            key = np.floor(rated * 1e6 + 0.5)
            last = np.partition(key, key.shape[1] - k, axis=1)[:, key.shape[1] - k, None]
            over, level = key > last, key == last
            level &= np.cumsum(level, axis=1, dtype=np.int32) <= k - over.sum(axis=1)[:, None]
            i, j = np.nonzero((over | level) & (rated >= least))
        key = np.floor(rated[i, j] * 1e6 + 0.5)
        places = np.lexsort((j, -key, i))
        i, j = i[places], j[places]
        kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        return i[kept], j[kept]

    def meet(v: pa.Table, q: pa.Table) -> pa.Table:
        ids, names = plain(v["vec_id"]), plain(q["query"])
        vt, qt = (np.array([x or "" for x in t["tag"].to_pylist()], str) for t in (v, q))
        list_of, read = v["list"].to_numpy(), q["lists"].to_pylist()
        order = np.argsort(ids, kind="stable")
        found = ([], [], [], [])
        vs, qs = matrices(v["v"]), matrices(q["q"])
        of_row, in_row = np.full(len(ids), -1), np.zeros(len(ids), int)
        for n, (places, _) in vs.items():
            of_row[places], in_row[places] = n, np.arange(len(places))
        ids, of_row, in_row, vt, list_of = ids[order], of_row[order], in_row[order], vt[order], list_of[order]
        # ids ascend now: of equal similarities the first k count
        aligned = {n: vs[n][1][in_row[of_row == n]] for n in vs}
        of_query, in_query = np.full(len(names), -1), np.zeros(len(names), int)
        for n, (places, _) in qs.items():
            of_query[places], in_query[places] = n, np.arange(len(places))
        tagged = bool((qt != "").any() and (vt != "").any())
        same_id = np.searchsorted(ids, names, "left"), np.searchsorted(ids, names, "right")
        step = max(1, piece // max(1, len(ids)))
        for at in range(0, len(names), step):
            mine = slice(at, at + step)
            lengths = np.unique(of_query[mine]).tolist()
            if len(lengths) == 1 and lengths[0] in aligned and len(aligned[lengths[0]]) == len(ids):
                sim, there = qs[lengths[0]][1][in_query[mine]] @ aligned[lengths[0]].T, None
                rated = sim
            else:
                sim = np.zeros((len(names[mine]), len(ids)))
                there = np.zeros(sim.shape, bool)
                for n in lengths:
                    if n in aligned:
                        both = np.ix_(np.flatnonzero(of_query[mine] == n), np.flatnonzero(of_row == n))
                        sim[both], there[both] = qs[n][1][in_query[mine][both[0].ravel()]] @ aligned[n].T, True
                rated = np.where(there, sim, absent if own else out)
            if np.isnan(rated).any():
                rated = np.where(np.isnan(rated), above, rated)
            elif rated is sim:
                rated = sim.copy()
            for i, (low, high) in enumerate(zip(same_id[0][mine], same_id[1][mine], strict=True)):
                rated[i, low:high] = out
            bits = read[mine]
            for i in (i for i, x in enumerate(bits) if x is not None):
                rated[i, ~np.unpackbits(np.frombuffer(bits[i], np.uint8)).astype(bool)[list_of]] = out
            same = (qt[mine][:, None] == vt[None, :]) & (vt != "")[None, :] if tagged else None
            for side in (False, True) if tagged else (False,):
                i, j = best(rated if same is None else np.where(same == side, rated, out))
                found[0].append(at + i)
                found[1].append(order[j])
                found[2].append(pa.array(sim[i, j], mask=None if there is None else ~there[i, j]))
                found[3].append(np.full(len(i), side))
        if not found[0]:
            return pa.table({"query": q["query"][:0], "vec_id": v["vec_id"][:0], "similarity": pa.array([], pa.float64()), "same": pa.array([], pa.bool_())})
        take = lambda column, places: column.take(pa.array(np.concatenate(places)))
        return pa.table({"query": take(q["query"], found[0]), "vec_id": take(v["vec_id"], found[1]), "similarity": pa.chunked_array(found[2], pa.float64()), "same": pa.array(np.concatenate(found[3]))})

    kind = lambda t, c: t.schema[c].dataType.simpleString()
    schema = f"query {kind(asked, 'query')}, vec_id {kind(rows, 'vec_id')}, similarity double, same boolean"
    return left.groupBy("_row", "_query").cogroup(right.groupBy("_row", "_query")).applyInArrow(meet, schema)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top-k of a stated set of query vectors against all rows:
    (query, vec_id, similarity, rank). Norms are taken once a row."""
    null = lambda kind: F.lit(None).cast(kind)
    asked = written(queries.select("query", _unit("query_embedding").alias("q")).where("query is not null").dropDuplicates(["query"]))
    rows = vectors.select("vec_id", _unit("embedding").alias("v")).where("vec_id is not null")
    sizes = vectors.count(), asked.count()
    near = nearest(asked.select("query", "q", null("string").alias("tag"), null("binary").alias("lists")), rows.select("vec_id", "v", null("string").alias("tag"), F.lit(0).alias("list")), sizes, k, block, own=True)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 6)), "vec_id"))
    return near.select("query", "vec_id", "similarity").withColumn("rank", place).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], keys: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists with the same keys and a ``rank``."""
    both = lists[0].select(*keys, "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select(*keys, "rank"))
    return both.groupBy(*keys).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.count("*").alias("lists"))


def fuse(scores: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Confidence fusion of (key, source, score): weights of the sources present
    are rescaled to 1; weighted sum, harmonic, geometric, max, min, conflict and level."""
    w = F.element_at(F.create_map(*(x for s, v in weights.items() for x in (F.lit(s), F.lit(v)))), F.col("source"))
    rows = scores.where("score between 0 and 1").withColumn("w", w / F.sum(w).over(Window.partitionBy(key)))
    s = F.col("score")
    out = rows.groupBy(key).agg(
        F.sum(F.col("w") * s).alias("weighted"), F.when(F.min(s) <= 0, 0.0).otherwise(1 / F.sum(F.col("w") / F.nullif(s, F.lit(0.0)))).alias("harmonic"),
        F.when(F.min(s) <= 0, 0.0).otherwise(F.exp(F.sum(F.col("w") * F.log(F.nullif(s, F.lit(0.0)))))).alias("geometric"), F.max(s).alias("highest"), F.min(s).alias("lowest"), (F.max(s) - F.min(s) > 0.3).alias("conflict"),
    )
    return out.withColumn("level", F.when(F.col("weighted") >= 0.75, "high").when(F.col("weighted") >= 0.5, "medium").otherwise("low"))


def min_max(scores: DataFrame, key: str, value: str) -> DataFrame:
    """Min-max normalisation inside each key; equal values become 1."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return scores.withColumn(value, F.when(high == low, 1.0).otherwise((F.col(value) - low) / (high - low)))


#: First matching group decides, in this order.
INTENTS = (("trend", "trend|over time|history"), ("compare", "compare|versus|better"), ("price", "price|cost|cheap"), ("why", "why|reason|cause"), ("definition", "what is|define|meaning"))


def intent(text: Column) -> Column:
    out = F.lit("general")
    for name, words in reversed(INTENTS):
        out = F.when(F.lower(text).rlike(words), name).otherwise(out)
    return out


def gate(text: Column) -> Column:
    """Whether a turn needs retrieval: not a greeting and not a few characters."""
    return F.when(F.lower(F.trim(text)).rlike(r"^(hi|hello|thanks|thank you|bye)[!. ]*$"), "greeting").when(F.length(F.trim(text)) < 5, "short").otherwise("retrieve")


#: Patterns with what replaces them, applied in this order.
SECRETS = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"), (r"\+?[0-9][0-9() -]{8,}[0-9]", "<phone>"), (r"[0-9a-f]{32,}", "<key>"))


#: Keys and tokens of log lines with what stands for them, fixed values, applied in this order.
KEYS = (
    (r"sk-[a-zA-Z0-9]{20,}", "sk-****"), (r"apify_api_[a-zA-Z0-9]{20,}", "apify_api_****"), (r"tvly-[a-zA-Z0-9]{20,}", "tvly-****"),
    (r"""(?i)(api[_-]?key|token|secret|password)["']?\s*[:=]\s*["']?([a-zA-Z0-9_\-]{16,})["']?""", "$1=****"), (r"Bearer\s+[a-zA-Z0-9_\-\.]{20,}", "Bearer ****"), (r"\b[a-zA-Z0-9_\-]{40,}\b", "****"),
)


def masked(text: Column, patterns=SECRETS) -> Column:
    """Secrets replaced."""
    for pattern, name in patterns:
        text = F.regexp_replace(text, pattern, name)
    return text


def over_best(hits: DataFrame, key: str = "query", score: str = "score") -> DataFrame:
    """Scores over the key's best one: 0 to 1; all 0 if the best is."""
    best = F.max(score).over(Window.partitionBy(key))
    return hits.withColumn(score, F.when(best > 0, F.col(score) / best).otherwise(0.0))


def fused_lists(lists: dict[str, DataFrame], key: str, content: str, k: int = RRF_K, top: int = 10) -> DataFrame:
    """Named ranked lists (key, content, rank) fused by content: equal texts are one
    (by SHA-256), with their sources in order of name. (key, hash, score, sources, rank)."""
    both = None
    for name, rows in lists.items():
        part = rows.select(key, F.substring(F.sha2(F.col(content), 256), 1, 16).alias("hash"), "rank", F.lit(name).alias("source"))
        both = part if both is None else both.unionByName(part)
    fused = both.groupBy(key, "hash").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "hash"))
    return fused.withColumn("rank", place).where(F.col("rank") <= top)


def source_scores(hits: DataFrame, key: str, best: int = 3) -> DataFrame:
    """One score a source from rows (key, source, score): vectors the mean of the
    best three, the ontology its best, entities their mean; scores outside 0 to 1 are left out."""
    place = F.row_number().over(Window.partitionBy(key, "source").orderBy(F.desc("score")))
    rows = hits.where("score between 0 and 1").withColumn("_n", place)
    s = F.when((F.col("source") == "vector") & (F.col("_n") > best), None).when((F.col("source") == "ontology") & (F.col("_n") > 1), None).otherwise(F.col("score"))
    return rows.groupBy(key, "source").agg(F.avg(s).alias("score"))


def normalised(scores: DataFrame, key: str, value: str, mode: str) -> DataFrame:
    """Scores of a key: ``min_max``, ``softmax``, ``z`` or ``none``; equal values are 1 by min-max and 0.5 by z."""
    if mode == "none":
        return scores
    if mode == "min_max":
        return min_max(scores, key, value)
    w = Window.partitionBy(key)
    if mode == "softmax":
        e = F.exp(F.col(value) - F.max(value).over(w))
        return scores.withColumn("_e", e).withColumn(value, F.col("_e") / F.sum("_e").over(w)).drop("_e")
    spread, mean = F.stddev_pop(value).over(w), F.avg(value).over(w)
    return scores.withColumn(value, F.when(spread > 1e-12, 1 / (1 + F.exp(-(F.col(value) - mean) / spread))).otherwise(0.5))


def weighted_merge(parts: dict[str, tuple[DataFrame, float, int]], key: str) -> DataFrame:
    """Rows (key, item, score) of several kinds, each weighted and cut to its own
    number a key: (key, kind, item, score)."""
    out = None
    for kind, (rows, weight, keep) in parts.items():
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "item"))
        part = rows.select(key, F.lit(kind).alias("kind"), "item", (F.col("score") * weight).alias("score")).withColumn("_n", place).where(F.col("_n") <= keep).drop("_n")
        out = part if out is None else out.unionByName(part)
    return out


def hybrid(queries: DataFrame, search, expand, k: int = 10) -> DataFrame:
    """Search end to end for rows (query, text) with whole numbers as ``query``:
    gated, searched (``search``: rows to ranked rows) as asked and as expanded
    (``expand``: Column to Column) at once, both lists fused by rank: (query, doc,
    score, lists, rank)."""
    asked = queries.where(gate(F.col("text")) == "retrieve")
    both = asked.select((F.col("query") * 2).alias("query"), "text").union(asked.select(F.col("query") * 2 + 1, expand(F.col("text"))))
    found = search(both).select(F.floor(F.col("query") / 2).alias("query"), "doc", "rank")
    return fused([found], k)


def fused(lists: list[DataFrame], k: int = 10) -> DataFrame:
    """The k best of ranked lists (query, doc, rank) by reciprocal rank: (query, doc, score, lists, rank)."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc"))
    return rrf(lists, ["query", "doc"]).withColumn("rank", place).where(F.col("rank") <= k)


def with_fallback(scores: DataFrame, k: int = 10, least: int = 3) -> DataFrame:
    """The k best of rows (query, doc, score, passes) that pass a filter; for a query
    of which fewer than ``least`` pass, the k best of all: (query, doc, score, rank,
    filtered). Each side is cut to k rows a query first, so what decides is small."""
    order = [F.desc(F.round("score", 6)), "doc"]
    head = scores.withColumn("n", F.row_number().over(Window.partitionBy("query", "passes").orderBy(*order))).where(F.col("n") <= max(k, least))
    passing = F.count_if("passes").over(Window.partitionBy("query"))
    chosen = head.withColumn("filtered", passing >= least).where(F.col("passes") | ~F.col("filtered"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return chosen.withColumn("rank", place).where(F.col("rank") <= k).select("query", "doc", "score", "rank", "filtered")
