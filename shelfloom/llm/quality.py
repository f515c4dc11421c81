"""Quality classifier: linear support vectors on Naive Bayes features.

A text's features are indicators of the byte trigrams it holds and of n-grams
of its outline (runs of capitals, small letters, digits, blanks and punctuation,
and repeated words), hashed into a fixed number of places. Counted over the
labelled sample is how many texts of each class have a feature; an indicator is
scaled by the log ratio of the two smoothed counts. A hinge-loss model on the
unit-length rows is fitted by dual coordinate descent, and a logistic curve of
out-of-fold margins turns margins into probabilities; a fold's model and scale
come from the other folds alone.

Fitting uses at most ``SAMPLE_ROWS`` labelled texts of each class, chosen by a
hash of id and text, and of these as many as have ``SAMPLE_FEATURES`` features in
all. Only their feature lists (two bytes a feature) reach the driver. Scoring
covers every row and whole texts, in one Arrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize, sliced

#: Bound of the labelled rows that the fit uses, for each class.
SAMPLE_ROWS = 3000
#: Bound of the sample's features: 64 MB on the driver, whatever the texts' lengths.
SAMPLE_FEATURES = 1 << 25
#: Feature places.
PLACES = 1 << 16
#: Lengths of the n-grams of the outline.
OUTLINE_GRAMS = (3, 5)
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 15
THRESHOLD = 0.3


def _classes() -> bytes:
    """Byte to outline class: A capital, a small or non-ASCII, 0 digit, blank, line end, else the byte."""
    table = bytearray(range(256))
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or "a" <= c <= "z":
            table[b] = ord("a")
        elif "A" <= c <= "Z":
            table[b] = ord("A")
        elif "0" <= c <= "9":
            table[b] = ord("0")
        elif c in "\t\x0b\x0c\r ":
            table[b] = ord(" ")
    return bytes(table)


_CLASSES = _classes()


def _hashed(windows: list[np.ndarray], salt: int) -> np.ndarray:
    code = np.full(len(windows[0]), salt, np.uint64)
    for w in windows:
        code = code * np.uint64(0x100000001B3) + w
    code *= np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - (PLACES.bit_length() - 1))).astype(np.int64)


def _grams(data: bytes, n: int, salt: int) -> np.ndarray:
    if len(data) < n:
        return np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    return _hashed([raw[i : len(raw) - n + 1 + i] for i in range(n)], salt)


def features(text: bytes, stamp: np.ndarray) -> np.ndarray:
    """Distinct feature places of a text. ``stamp`` is scratch of ``PLACES`` numbers."""
    outline = np.frombuffer(text.translate(_CLASSES), np.uint8)
    if len(outline):
        outline = outline[np.flatnonzero(np.diff(outline, prepend=0))]
    words = text.split()
    same = bytes(map(bytes.__eq__, words, words[1:]))
    runs = [_grams(same, n, 100 + n) for n in (1, 3)]
    found = [_grams(text, 3, 1), *(_grams(outline.tobytes(), n, 10 + n) for n in OUTLINE_GRAMS), *(r for r in runs)]
    places = np.concatenate(found)
    order = np.arange(len(places), dtype=np.int32)
    stamp[places] = order
    return places[stamp[places] == order]


@dataclass
class Model:
    weights: np.ndarray
    scale: np.ndarray
    slope: float
    offset: float

    def margin(self, places: np.ndarray) -> float:
        norm = np.sqrt(np.square(self.scale[places]).sum())
        return float(self.weights[places].sum() / norm) if norm > 0 else 0.0

    def score(self, places: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-(self.slope * self.margin(places) + self.offset))))


def _descend(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 11) -> np.ndarray:
    """Dual coordinate descent for the hinge loss on unit-length rows of scaled
    indicators; returns weights on the unscaled, unnormalized indicators."""
    lengths = np.array([np.sqrt(np.square(scale[places]).sum()) for places in rows])
    w, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    # each class weighs alike
    most = cost * np.maximum(np.where(signs > 0, (signs < 0).mean(), (signs > 0).mean()) * 2, 1e-6)
    dice = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in dice.permutation(len(rows)):
            if not lengths[i]:
                continue
            values = scale[rows[i]] / lengths[i]
            gradient = signs[i] * float(values @ w[rows[i]]) - 1
            new = min(most[i], max(0.0, alpha[i] - gradient))
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * signs[i] * values
                alpha[i] = new
    return w * scale


def _log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of good and bad rows that have a feature."""
    have = np.zeros((2, PLACES))
    for places, g in zip(rows, good, strict=True):
        have[int(g)][places] += 1  # a row's places are distinct
    shares = [(have[i] + SMOOTHING) / (n + 2 * SMOOTHING) for i, n in ((0, (~good).sum()), (1, good.sum()))]
    return np.log(shares[1]) - np.log(shares[0])


def _curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, with softened targets."""
    p, n = good.sum(), (~good).sum()
    aim = np.where(good, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a * margins + b)))
        g = np.array([((q - aim) * margins).sum() + 1e-3 * a, (q - aim).sum()])
        s = q * (1 - q) + 1e-9
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def _featurize(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp = np.zeros(PLACES, np.int32)
        for batch in sliced(batches, "text"):
            found = [np.sort(features(t, stamp)).astype("<u2") for t in as_bytes(batch, "text")]
            packed = pa.array([f.tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "body", "label")), pa.array(map(len, found), pa.int64()), packed], names=["id", "body", "label", "n", "places"])

    return rows.select("id", "body", "label", "text").mapInArrow(run, "id long, body long, label int, n long, places binary")


def _sample(docs: DataFrame, usable: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """``(id, body, label, n, places)`` of the rows to fit on, bounded as the module says."""
    one = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).alias("other")).where("label = other").drop("other")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("body", F.xxhash64("text"))
    # by id first, so that few rows of the documents go on; then by row, as an id may have many
    first = (F.broadcast(_least(one, sample_rows, "id")), "id")
    rows = texts.join(*first).select("id", "label", "body").distinct()
    chosen = materialize(_least(rows, sample_rows, "id", "body"))
    found = _featurize(texts.join(F.broadcast(chosen), ["id", "body"]))
    sample = materialize(found.groupBy("id", "body", "label").agg(F.first("n").alias("n"), F.first("places").alias("places")))
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("id", "body"), "id", "body").rowsBetween(Window.unboundedPreceding, 0))  # the sample, without its features
    kept = sample.select("id", "body", "n").withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_FEATURES).select("id", "body")
    return sample.join(F.broadcast(kept), ["id", "body"])


def _least(rows: DataFrame, k: int, *key: str) -> DataFrame:
    """Of each class the k rows with the least hash of the key."""
    parts = [rows.where(F.col("label") == value).orderBy(F.xxhash64(*key), *key).limit(k) for value in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows for which ``held_out`` (over ``id_col``) is false.

    Rows without an id or label, and ids with both labels, are not used; rows
    that repeat another in id and text count once. If one class is missing, every
    score is the share of good labels (one half without any)."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out)
    data = _sample(docs, usable, id_col, text_col, label_col, sample_rows).orderBy("id", "body").select("label", "places").toArrow()
    good = data.column("label").to_numpy() == 1
    if not good.any() or good.all():
        share = 0.5 if not len(good) else float(good.mean())
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(PLACES), np.zeros(PLACES), 0.0, float(np.log(share / (1 - share))))
    rows = [np.frombuffer(p.as_buffer(), "<u2") for p in data.column("places")]
    signs = np.where(good, 1.0, -1.0)
    margins = np.zeros(len(rows))
    fold = np.arange(len(rows)) % 3
    for f in range(3):
        inside = np.flatnonzero(fold != f)
        if len(set(signs[inside])) < 2:
            continue
        own = [rows[i] for i in inside]
        scale = _log_ratios(own, good[inside])
        part = Model(_descend(own, signs[inside], scale, epochs=6), scale, 1.0, 0.0)
        for i in np.flatnonzero(fold == f):
            margins[i] = part.margin(rows[i])
    slope, offset = _curve(margins, good)
    scale = _log_ratios(rows, good)
    return Model(_descend(rows, signs, scale), scale, slope, offset)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with a score (0 to 1) beside its own columns, under a name that none of them has."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stamp = np.zeros(PLACES, np.int32)
        for column in texts:
            plain = column.cast(pa.binary())
            yield pa.array([sent.value.score(features(t.as_py() or b"", stamp)) for t in plain], pa.float64())

    return docs.withColumn(score_col, scores(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, ``held_out`` (CRC-32 of the id modulo 5 is 0), ``score``,
    ``predicted`` (1 from ``threshold`` on).

    Null and empty texts get the score of a text without features, texts of any
    length are read whole. A null id is not held out, but has no label either.
    Repeated rows give repeated results, an empty table an empty one; other
    columns are ignored."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs, labels, held, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return score(rows, model, "text", "score").select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
