"""The Katz model against a plain one that keeps all n-grams in dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import katz, queries

SF = "/root/testdata/sf0.001"
#: Chance of the words of made-up texts: few frequent, many rare.
WORDS = [f"w{i}" for i in range(300)]
CHANCE = 1 / np.arange(1, 301)


def words(text):
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


class Plain:
    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for t in map(words, texts):
            for n in range(1, order + 1):
                self.counts[n - 1].update(tuple(t[i : i + n]) for i in range(len(t) - n + 1) if (n, i) != (1, 0))
        self.total, self.histories = sum(self.counts[0].values()), Counter()
        self.followers = defaultdict(list)
        self.lost = []
        for c in self.counts:
            n = [sum(v == r for v in c.values()) for r in range(1, 7)]
            common = 6 * n[5] / n[0] if n[0] else 1
            ratios = [((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) if min(n) and common < 1 else 0 for r in range(1, 6)]
            good = all(0 < x < 1 for x in ratios)
            self.lost.append([0, *(r * (1 - x) for r, x in enumerate(ratios, 1))] if good else [0] + [0.5] * 5)
        for c in self.counts[1:]:
            for g, v in c.items():
                self.histories[g[:-1]] += v
                self.followers[g[:-1]].append(g[-1])
        self.unknown = 1 - sum(self.kept(1, c) for c in self.counts[0].values()) / self.total if self.total else 1.0
        self.known = {}

    def kept(self, n, c):
        return c - self.lost[n - 1][min(c, 5)]

    def p(self, word, history):
        if not history:
            c = self.counts[0][(word,)]
            return self.kept(1, c) / self.total if c else self.unknown
        c = self.counts[len(history)][(*history, word)]
        if c:
            return self.kept(len(history) + 1, c) / self.histories[history]
        if not self.histories[history]:
            return self.p(word, history[1:])
        return self.weight(history) * self.p(word, history[1:])

    def weight(self, history):
        if history not in self.known:
            ws = self.followers[history]
            self.known[history] = (1 - sum(self.p(w, history) for w in ws)) / (1 - sum(self.p(w, history[1:]) for w in ws))
        return self.known[history]

    def score(self, text):
        t = words(text)
        return sum(math.log10(self.p(t[i], tuple(t[max(0, i - self.order + 1) : i]))) for i in range(1, len(t)))

    def base(self, text):
        n, v = self.total, len(self.counts[0])
        return sum(math.log10((self.counts[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in words(text)[1:])


def made_up(seed, n):
    dice = np.random.default_rng(seed)
    texts = [" ".join(dice.choice(WORDS, dice.integers(0, 120), p=CHANCE / CHANCE.sum())) for _ in range(n)]
    return list(enumerate([*texts, *texts[:5], None, "", "  \n", "Never Seen BEFORE " * 3, "w0 " * 3000]))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def run(spark, texts, **options):
    frame = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts], "doc_id long, text string, block string, score double")
    return katz.katz_scores(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, **options).collect()


@pytest.mark.parametrize(("order", "seed", "block"), [(2, 1, 500), (2, 2, 1 << 21), (3, 3, 700), (4, 4, 900)])
def test_scores_equal_the_plain_model(spark, order, seed, block):
    texts = made_up(seed, 120)
    model = Plain([t for i, t in texts if not held(i)], order)
    rows = {r.doc_id: r for r in run(spark, texts, order=order, block=block)}
    assert len(rows) == len(texts)
    for i, t in texts:
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(words(t)) - 1, model.total)
        assert r.n_known == sum(model.counts[0][(w,)] > 0 for w in words(t)[1:])
        assert r.base_score == pytest.approx(model.base(t), rel=1e-9) and r.score == pytest.approx(model.score(t), rel=1e-9)


def test_every_history_adds_up_to_one():
    texts = made_up(5, 80)
    model = Plain([t for _, t in texts], 3)
    vocabulary = [w for (w,) in model.counts[0]]
    for history in [(), ("<s>",), ("w0",), ("w1", "w2"), ("<s>", "w0"), ("w250",), ("nobody",), ("w0", "w0")]:
        assert sum(model.p(w, history) for w in vocabulary) + model.p("<unknown>", history) == pytest.approx(1, abs=1e-9)


def test_good_turing_discounts():
    d = katz.Discount.fit([1000, 400, 220, 140, 100, 75])
    r = np.arange(1, 6)
    star = (r + 1) * np.array([400, 220, 140, 100, 75]) / np.array([1000, 400, 220, 140, 100])
    common = 6 * 75 / 1000
    assert d.lost[1:6] == pytest.approx(r * (1 - (star / r - common) / (1 - common)))
    # Katz's condition: all that is taken is the chance of what was never seen
    assert sum(d.lost[1:6] * np.array([1000, 400, 220, 140, 100])) == pytest.approx(1000)
    assert d.lost[6] == d.lost[5]
    for odd in ([0] * 6, [5, 0, 1, 1, 1, 1], [1, 9, 9, 9, 9, 9], []):
        assert set(katz.Discount.fit(odd).lost) == {0.5}


def test_odd_rows(spark):
    long = "word " * 200_000
    texts = [(None, "alone here"), (1, None), (2, ""), (3, long), (4, "same text"), (5, "same text"), (5, "same text"), (6, " \n ")]
    rows = run(spark, texts, block=50)
    assert sorted(r.n_tokens for r in rows) == sorted(len(words(t)) - 1 for _, t in texts)
    model = Plain([t for i, t in texts if not held(i)], 2)
    assert sorted(r.score for r in rows) == pytest.approx(sorted(model.score(t) for _, t in texts), rel=1e-9)
    empty = run(spark, [])
    assert empty == []
    only_held = [(i, "a b") for i in range(60) if held(i)]
    assert {(r.score, r.n_known, r.train_tokens) for r in run(spark, only_held)} == {(0.0, 0, 0)}
    with pytest.raises(ValueError):
        run(spark, texts, order=1)


def test_query_on_the_given_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    model = Plain([t for i, t in texts if not held(i)], 2)
    rows = {r.doc_id: r for r in queries.queries()["op11_katz_score"](spark, SF).collect()}
    assert {i: r.score for i, r in rows.items()} == pytest.approx({i: model.score(t) for i, t in texts}, rel=1e-8)
    assert {i: r.base_score for i, r in rows.items()} == pytest.approx({i: model.base(t) for i, t in texts}, rel=1e-8)
    out = [r for r in rows.values() if r.held_out]
    # on texts it has not learned from, the model beats words alone
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
