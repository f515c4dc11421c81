"""The corpus operators against brute force, round trips and planted cases."""

import gzip
import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfloom.llm import bpe, components, exact_dedup, html_text, licenses, mixing, near_dedup, quality, queries, rules, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def odd_rows():
    """Null id, null and empty text, a long text, ties and a repeated row."""
    long = "word " * 20000
    return [(None, "alone"), (1, None), (2, ""), (3, long), (4, "same text here ok now"), (5, "same text here ok now"), (5, "same text here ok now"), (6, " \n ")]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- 1


def brute_components(texts):
    sets = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[a : a + 5]) for a in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        one, two = sets[a], sets[b]
        if one and two and 100 * len(one & two) >= 75 * len(one | two):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near(spark, texts, **options):
    out = near_dedup.near_duplicates(docs(spark, texts), **options).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}, out


def planted(seed=3, groups=6, copies=8, passage=True):
    dice = random.Random(seed)
    word = lambda: "".join(dice.choices("abcdefghij", k=5))
    shared = [word() for _ in range(60)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(dice.choice([6, 30, 120, 400]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(dice.randrange(0, 4)):
                own[dice.randrange(len(own))] = word()
            texts.append(" ".join(own))
    if passage:
        texts += [" ".join(shared + [word() for _ in range(dice.choice([10, 20, 60, 200]))]) for _ in range(40)]
    texts += ["A b C", "a B c", "a b d", "", None, "  "]
    dice.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = planted(seed)
    got, rows = near(spark, texts)
    assert got == brute_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_with_several_stars(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REST_PER_POSTING", 0)
    monkeypatch.setattr(near_dedup, "MAX_STARS", 3)
    texts = planted(5, groups=2, copies=25)
    assert near(spark, texts)[0] == brute_components(texts)


def test_near_duplicates_on_table(spark):
    texts = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_near_dedup(spark, SF).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_odd_rows(spark):
    out = near_dedup.near_duplicates(docs(spark, odd_rows())).collect()
    assert len(out) == 8
    assert {(r.doc_id, r.component_id) for r in out} == {(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6)}
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_texts_of_one_id_reach_each_other(spark):
    got = near_dedup.near_duplicates(docs(spark, [(3, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (4, "u v w x y z")])).collect()
    assert {r.component_id for r in got} == {3}


def test_components(spark):
    dice = random.Random(1)
    edges = [(dice.randrange(300), dice.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(20)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in edges if a != b for i in (a, b)}


@pytest.mark.parametrize("seed", [3, 11])
def test_near_duplicates_exact(spark, seed):
    texts = planted(seed)
    assert near(spark, texts, exact=True)[0] == brute_components(texts)


# --- 2


def brute_license(text):
    words = licenses.words_of(text or "")
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({v for _, v in found}))


def test_license_base(spark):
    extra = ["Under the MIT license, under the MIT License! cc-by-nc", "under the mıt license", "UNDER THE Mit LICENSE\nApache License, Version 2.0", "licensed under the kit license", "the CC BY NC CC BY NC", None, "", "x " * 30000 + "cc by nc"]
    texts = [(r.doc_id, r.text) for r in table(spark, "documents").collect()] + [(10_000 + i, t) for i, t in enumerate(extra)]
    out = licenses.license_labels(docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out} == {i: brute_license(t) for i, t in texts}
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in out)


def test_license_altered_notice_and_odd_rows(spark):
    altered = "intro words here. Redistribution and use in source and binary forms, with or without any modification, are permitted provided that these conditions are met. tail"
    got = {r.doc_id: r for r in licenses.license_labels(docs(spark, [(1, altered), (2, "no license at all in this text")])).collect()}
    assert got[1].labels == "bsd" and got[1].n_base == 0 and 0.7 <= got[1].score < 1
    assert got[2].labels == "" and got[2].score == 0
    assert len(licenses.license_labels(docs(spark, odd_rows())).collect()) == 8
    assert licenses.license_labels(docs(spark, [])).count() == 0


@pytest.mark.parametrize("opening", ["this is free ", "this is free and ", "this is free and unencumbered "])
def test_license_after_repeated_openings(spark, opening):
    notice = "this is free and unencumbered software released into the public domain"
    texts = [(1, opening * 10 + notice[13:]), (2, opening * 10 + notice), (3, notice), (4, notice + " " + opening * 10), (5, "word " * 50 + notice + " word" * 50 + " " + notice), (6, opening * 10)]
    got = {r.doc_id: r for r in licenses.license_labels(docs(spark, texts)).collect()}
    assert all(got[i].labels == "unlicense" and got[i].score == 1.0 for i in (2, 3, 4, 5)) and got[1].labels == "unlicense" and got[6].labels == ""
    spans = licenses.scan_licenses(docs(spark, texts)).where("doc = 5 and label = 'unlicense'").collect()
    assert sorted((r.start, r.end) for r in spans) == [(50, 61), (111, 122)]


def brute_cover(words, notice):
    """Best share of a notice that lies on neighbouring diagonals, by plain search."""
    t, k = notice.split(), licenses.K
    hits = sorted((p - a, a) for a in range(len(t) - k + 1) for p in range(len(words) - k + 1) if words[p : p + k] == t[a : a + k])
    best = 0.0
    for low, _ in hits:
        part = {a + i for d, a in hits if low <= d <= low + len(t) // 2 for i in range(k)}
        best = max(best, len(part) / len(t))
    return best


def test_license_scores_equal_brute_force(spark):
    """Exact on any text without drift; a drifting one has at least what half a window holds."""
    dice = random.Random(8)
    notices = list(licenses.NOTICES)
    texts = []
    for i in range(120):
        words = dice.choice(notices).split()
        for _ in range(dice.randrange(0, 4)):
            at = dice.randrange(len(words))
            words[at : at + dice.randrange(0, 2)] = dice.choice([[], ["inserted"]])
        texts.append((i, " ".join(dice.choices(["alpha", "beta", "gamma"], k=9) + words + ["omega"] * 5)))
    got = {r.doc_id: r for r in licenses.license_labels(docs(spark, texts)).collect()}
    for i, text in texts:
        cover = {n: brute_cover(text.split(), n) for n in notices}
        base = brute_license(text)[4]
        cover["base"] = float(bool(base))
        want = {licenses.NOTICES[n] for n, c in cover.items() if n != "base" and c >= licenses.COVER} | set(filter(None, base.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == want and got[i].score == pytest.approx(max([c for c in cover.values() if c >= licenses.COVER], default=0.0)), text


# --- 3


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x"), (2, "http://example.net/fr/"), (3, "http://example.com/de/a?b"), (4, "x.org/fr/"), (5, "http://b.org/fr/casino-win"), (6, None), (7, "http://x.org/my-casino/jackpot"),
            (8, "http://notexample.com/de/"), (9, "http://x.com#/de/"), (10, "http://x.com/adult-x"), (11, "http://x.com/cheapest/pillsbury"), (12, "http://"), (13, "http://x.net"), (13, "http://x.net")]
    out = [tuple(r)[:5] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    assert len(out) == 14
    got = {r[0]: r[1:] for r in out}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/fr/", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6] == ("", "", None, "allow") and got[7][3] == "block"
    assert got[8][2:] == (None, "allow") and got[9][:2] == ("x.com", "") and got[10][3] == "block" and got[11][3] == "allow"
    assert got[12] == ("", "", None, "allow") and got[13] == ("x.net", "", None, "allow")


def test_url_terms_are_decoded_and_given(spark):
    rows = [(1, "http://a.com/p%6Frn/x"), (2, "http://a.com/%20PORN%2f"), (3, "http://a.com/100%"), (4, "http://a.com/acme/widgets"), (5, "http://shop.com/free-ads/win-a-bet")]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(frame).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    strict, soft = urls.vocabulary_of(spark.createDataFrame([("Acme", 0.5), ("widgets", 0.5), ("100", 2.0), (None, 1.0), ("", 1.0)], "term string, weight double"))
    assert (strict, soft) == (("100",), ("acme", "widgets"))
    assert {r.page_id: r.verdict for r in urls.filter_urls(frame, strict=strict, soft=soft).collect()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow"}


# --- 4


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_equals_library(spark):
    made = [None, "", "  ", "ΑΣ ΣΑΣ. İstanbul", "a<|startoftext|>B <|ENDOFTEXT|> <|endoftext|>x", "it's they'RE 12½ ²³ Ⅷ", "x\x1cy\x85z", "日本語", "a" * 5000, "don''t é Å", "!" * 700]
    texts = [(r.doc_id, r.text) for r in table(spark, "documents").collect()] + [(10_000 + i, t) for i, t in enumerate(made)]
    lib = library()
    got = {r.doc_id: r for r in bpe.encode_documents(docs(spark, texts), queries.vocabulary(), outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    for i, text in texts:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == decoded
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_tree_equals_plain_merging():
    with open(queries.vocabulary(), encoding="utf-8") as file:
        model = bpe.WordBpe(file.read())
    import json

    with open(queries.vocabulary(), encoding="utf-8") as file:
        spec = json.load(file)["model"]
    rank = {tuple(m): i for i, m in enumerate(spec["merges"])}
    chars = bpe.byte_characters()

    def plain(word):
        parts = [chars[b] for b in word]
        parts[-1] += "</w>"
        while len(parts) > 1:
            best, at = min((rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return b"".join(spec["vocab"][p].to_bytes(4, "little") for p in parts)

    dice = random.Random(2)
    words = ["".join(dice.choices("aehinorst", k=dice.randrange(1, 40))).encode() for _ in range(500)] + [bytes(dice.choices(range(256), k=9)) for _ in range(50)]
    assert model.merge(words) == [plain(w) for w in words]


def own_bpe():
    with open(queries.vocabulary(), encoding="utf-8") as file:
        return bpe.WordBpe(file.read())


def test_bpe_every_code_point_equals_library():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b !{c} 1{c} e{c}\u0301\u0323 e\u0301{c}" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    model, lib = own_bpe(), library()
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        for text, ids, want in zip(part, model.encode_batch(part), lib.encode_batch(part, add_special_tokens=False), strict=True):
            assert ids.tolist() == want.ids, text


def test_bpe_random_sequences_equal_library():
    dice = random.Random(6)
    odd = [chr(c) for r in (bpe.NO_LETTERS, bpe.NO_MARKS) for a, b in r for c in (a, b)] + list(map(chr, bpe.SMALL)) + list("aeΣé\u0301\u0323\u0345\u1df6 1'<|>\x1c") + ["<|endoftext|>"]
    texts = ["".join(dice.choices(odd, k=dice.randrange(1, 12))) for _ in range(20_000)]
    model, lib = own_bpe(), library()
    for text, ids, want in zip(texts, model.encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text


def test_bpe_long_words():
    import time

    dice = random.Random(7)
    texts = ["".join(dice.choices("etaoinshr", k=100_000)), "a" * 70_000, "".join(dice.choices("ab", k=bpe.LONG + 1)), "é" * 3000]
    started = time.perf_counter()
    made = own_bpe().encode_batch(texts)
    assert time.perf_counter() - started < 10
    lib = library()
    assert [m.tolist() for m in made] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_odd_rows(spark):
    assert len(bpe.encode_documents(docs(spark, odd_rows()), queries.vocabulary()).collect()) == 8
    assert bpe.encode_documents(docs(spark, []), queries.vocabulary()).count() == 0


# --- 5


def test_classifier_on_held_out(spark):
    out = queries.op5_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in out)
    assert right / len(out) > 0.97
    assert sum(r.predicted == 0 for r in out if r.quality == 1) / sum(r.quality == 1 for r in out) < 0.01
    assert all(0 <= r.score <= 1 for r in out)


def test_classifier_odd_rows(spark):
    rows = docs(spark, odd_rows())
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.classify(rows, labels).collect()) == 8
    assert {r.score for r in quality.classify(rows, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs(spark, []), labels).count() == 0


def test_classifier_fit_is_bounded(spark, monkeypatch):
    """An id that many rows share, an id with both labels, and long texts stay within the sample's bounds."""
    dice = random.Random(3)
    texts = [(1, "good words " * 5 + str(i)) for i in range(300)] + [(2, "BAD!! " * 9)] * 300 + [(3, "either")] + [(10 + i, "".join(dice.choices("abcdefghijk ", k=400))) for i in range(60)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 0), (3, 1, 0)] + [(10 + i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    sample = lambda n: quality._sample(docs(spark, texts), labels, "doc_id", "text", "quality", n).collect()
    rows = sample(50)
    assert Counter(r.label for r in rows) == {1: 50, 0: 31} and not any(r.id == 3 for r in rows) and sum(r.id == 2 for r in rows) == 1
    monkeypatch.setattr(quality, "SAMPLE_FEATURES", 2000)
    assert 0 < sum(r.n for r in sample(50)) <= 2000
    assert quality.classify(docs(spark, texts), labels).count() == len(texts)


def test_descent_reaches_the_hinge_optimum():
    """Against subgradient steps on the primal."""
    import numpy as np

    dice = np.random.default_rng(1)
    rows = [np.sort(dice.choice(12, 5, replace=False)) for _ in range(60)]
    signs = np.where([1.0 if (r < 6).sum() > 2 else -1.0 for r in rows], [1.0 if (r < 6).sum() > 2 else -1.0 for r in rows], 0)
    scale = dice.normal(size=12)
    x = np.zeros((60, 12))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt(np.square(scale[r]).sum())
    most = np.where(signs > 0, (signs < 0).mean(), (signs > 0).mean()) * 2
    loss = lambda w: w @ w / 2 + (most * np.maximum(0, 1 - signs * (x @ w))).sum()
    ours = quality._descend(rows, signs, scale, epochs=300) / scale
    w, best = np.zeros(12), np.inf
    for t in range(1, 20_000):
        g = w - ((most * signs * (signs * (x @ w) < 1)) @ x)
        w = w - g / (t + 10)
        best = min(best, loss(w))
    assert loss(ours) <= best * 1.001


# --- 6


def test_exact_odd_rows(spark):
    got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(docs(spark, odd_rows())).drop("text_sha256").collect()), key=str)
    assert got == sorted([(None, None, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (6, 6, 1, True)], key=str)
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_exact_keep_least(spark):
    assert {r.keep_id for r in exact_dedup.exact_duplicates(docs(spark, [(4, "x"), (9, "x")]), keep="min").collect()} == {4}


# --- 7


def test_mix(spark):
    rows = table(spark, "documents").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    per = Counter()
    for i, n in size.items():
        per[source[i]] += n
    weight = dict(zip(sorted(per), itertools.cycle((5, 2, 1)), strict=False))
    full: set = set()
    while True:
        left = sum(per.values()) - sum(3 * per[s] for s in full)
        aim = {s: 3 * per[s] if s in full else left * weight[s] / sum(weight[x] for x in per if x not in full) for s in per}
        over = {s for s in per if aim[s] > 3 * per[s]}
        if not over:
            break
        full |= over
    out = queries.op7_source_mix(spark, SF).collect()
    again = queries.op7_source_mix(spark, SF).collect()
    assert sorted(out) == sorted(again)
    taken = Counter()
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == per[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(aim[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - aim[s]) <= 4 for s in per)


def seat_by_seat(votes, seats):
    won, order = Counter(), []
    for _ in range(seats):
        best = min(votes, key=lambda s: (-votes[s] / (2 * won[s] + 1), s is None, s or ""))
        order.append((best, won[best]))
        won[best] += 1
    return order


def test_seats_equal_seat_by_seat(spark):
    dice = random.Random(9)
    for n, seats in ((1, 5), (7, 40), (30, 33), (30, 400)):
        votes = {f"s{i}": float(dice.randrange(1, 1000)) for i in range(n)} | {None: 7.0}
        frame = spark.createDataFrame(list(votes.items()), "source string, target double")
        dealt = mixing.deal_seats(frame, seats, 3).collect()
        assert [(r.source, r.seat) for r in sorted(dealt, key=lambda r: r.rank)] == seat_by_seat(votes, seats)
        assert all(r.shard == r.rank * 3 // seats for r in dealt)
    quotas = mixing.shard_quotas(mixing.deal_seats(frame, 400, 3)).collect()
    assert sum(r.quota for r in quotas) == 400 and all(r.quota > 0 for r in quotas)


def test_mix_equals_brute_force(spark):
    """Blocks are laid out and drawn one by one."""
    dice = random.Random(5)
    sizes = {i: dice.randrange(0, 60) for i in range(60)}
    source = {i: dice.choice(["a", "a", "a", "b", "c", None]) for i in range(60)}
    rows = [(i, " ".join(["w"] * n), "en", source[i], n) for i, n in sizes.items()] + [(3, " ".join(["w"] * sizes[3]), "en", source[3], 0)] * 2
    frame = spark.createDataFrame(rows, DOCS)
    options = {"blocks": 80, "shards": 4}
    placed, quotas = mixing.plan_mix(frame, **options)
    placed, quotas = placed.collect(), quotas.collect()
    taken, shard, words = Counter(), {}, Counter()
    for name in {r.source for r in placed}:
        mine = [r for r in placed if r.source == name]
        block, held, seats, offset = mine[0].block, mine[0].held, mine[0].seats, mine[0].offset
        stream = [(r.id, c) for r in sorted(mine, key=lambda r: (r["from"], r.size > 0)) for c in range(r.n) for _ in range(r.size)]
        assert len(stream) == mine[0].source_size and held == -(-len(stream) // block)
        of = {s: q.shard for q in quotas if q.source == name for s in range(q.first, q.first + q.quota)}
        for seat in range(seats):
            at = (offset + seat) % held
            for key in stream[at * block : (at + 1) * block]:
                taken[key] += 1
                shard.setdefault(key, of[seat])
                words[key[0], of[seat], seat // held] += 1
    want = Counter((r.id, r.size, taken[r.id, c], shard.get((r.id, c))) for r in placed for c in range(r.n))
    assert Counter((r.doc_id, r.size, r.taken, r.shard) for r in mixing.mix(frame, **options).collect()) == want
    pieces = Counter()
    for r in mixing.mix_pieces(frame, **options).collect():
        pieces[r.doc_id, r.shard, r.round] += r.last_word - r.first_word + 1
    assert pieces == words


def test_mix_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 10)
    frame = docs(spark, [(None, "a b c")] * 95 + [(i, "x y") for i in range(50)])
    out = mixing.mix(frame).collect()
    assert len(out) == 145 and sum(r.taken for r in out) == 95 * 3 + 100


def test_mix_odd_rows(spark):
    out = mixing.mix(docs(spark, odd_rows(), {4: None, 5: None})).collect()
    assert len(out) == 8 and all(r.taken <= 3 * r.size for r in out)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None)])).first().taken == 0


# --- 8


def test_warc_odd_rows(spark):
    rows = [(3, "http://a", "x"), (1, None, "x"), (2, "http://b\r\nWARC/1.1", None), (4, "u", ""), (None, "u", "x"), (5, "u", "WARC/1.1\r\n\r\n" * 3), (6, "u", "é\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {3: (1, "revisit", 1), 1: (1, "response", None), 2: (0, "response", None), 4: (0, "revisit", 2), None: (1, "response", None), 5: (36, "response", None), 6: (6, "response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def record(i, body):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha1:{warc.sha1_base32(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def ids(archive):
    return [int(r.headers["warc-record-id"][10:-1]) for r in archive.records]


@pytest.mark.parametrize("packed", [False, True])
def test_warc_salvage(packed):
    parts = [record(i, b"page %d WARC/1.1\r\n" % i * 5) for i in range(6)]
    if packed:
        parts = [gzip.compress(p) for p in parts]
    whole = b"".join(parts)
    assert ids(warc.read_archive(whole)) == list(range(6)) and not warc.read_archive(whole).gaps
    start = len(parts[0]) + len(parts[1])
    for damage in (lambda b: b[: start + 40] + bytes([b[start + 40] ^ 255]) + b[start + 41 :], lambda b: b[: start + 30] + b[start + len(parts[2]) :], lambda b: b[:start] + b"junk" * 9 + b[start + len(parts[2]) :]):
        archive = warc.read_archive(damage(whole))
        assert ids(archive) == [0, 1, 3, 4, 5]
        assert len(archive.gaps) == 1 and archive.gaps[0].offset == start and archive.gaps[0].length > 0
    cut = warc.read_archive(whole[:-10])
    assert ids(cut) == list(range(5)) and cut.gaps[0].offset == len(whole) - len(parts[5])


def test_warc_plain_archive_with_packed_payloads():
    packed = gzip.compress(b"a packed page")
    parts = [record(0, b"x" * 5000), record(1, packed), record(2, b"y"), record(3, packed)]
    whole = b"".join(parts)
    archive = warc.read_archive(b"J" + whole[1:])
    assert ids(archive) == [1, 2, 3] and [(g.offset, g.length) for g in archive.gaps] == [(0, len(parts[0]))]
    broken = parts[0] + b"J" + parts[1][1:] + parts[2] + gzip.compress(parts[3])
    assert ids(warc.read_archive(broken)) == [0, 2, 3]


def test_warc_logs_every_gap_of_a_member():
    inner = b"junk" * 3 + record(0, b"a") + b"more junk" + record(1, b"b") + b"end"
    archive = warc.read_archive(gzip.compress(inner) + gzip.compress(record(2, b"c")))
    assert ids(archive) == [0, 1, 2] and [g.length for g in archive.gaps] == [12, 9, 3]


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    noise = random.Random(1)
    pages = spark.createDataFrame([(i, "u", "".join(noise.choices("abcdefghijklmnop", k=20_000))) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(pages, str(tmp_path / "w"), file_bytes=50_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").iterdir()]
    assert max(sizes) <= 50_000 and len(sizes) > 2 and sorted(sizes) == sorted(r.bytes for r in files.collect())
    assert len(ids(warc.read_archive(b"".join(f.read_bytes() for f in (tmp_path / "w").iterdir())))) == 20
    assert files.agg({"records": "sum"}).first()[0] == 20


def test_warc_junk_before_plain_records():
    parts = [record(i, b"\x1f\x8b\x08 payload") for i in range(5)]
    archive = warc.read_archive(b"j" * 5000 + b"".join(parts))
    assert ids(archive) == list(range(5)) and [(g.offset, g.length) for g in archive.gaps] == [(0, 5000)]


@pytest.mark.parametrize(
    "change",
    [lambda r: r.replace(b"WARC-Record-ID", b"WARC-Rec\xc3\xb6rd-ID"), lambda r: r.replace(b"WARC-Type: response\r\n", b""), lambda r: r.replace(b"WARC-Type: response\r\n", b"WARC-Type: response\r"),
     lambda r: r.replace(b"WARC-Type: response\r\n", b"WARC-Type: response\r\nWARC-Type: response\r\n"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: x"), lambda r: r[:60]],
)
def test_warc_headers_are_checked(change):
    parts = [record(i, b"body") for i in range(3)]
    bad = change(parts[1])
    archive = warc.read_archive(parts[0] + bad + parts[2])
    assert ids(archive) == [0, 2] and [(g.offset, g.length) for g in archive.gaps] == [(len(parts[0]), len(bad))]


def test_warc_large_members_are_read_as_far_as_their_headers_say(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1 << 16)
    dice = random.Random(5)
    noise = lambda n: bytes(dice.choices(b"abcdefghij", k=n))
    alone = gzip.compress(record(1, noise(1 << 17)))
    several = gzip.compress(record(2, noise(100)) + record(3, noise(1 << 18)) + record(4, noise(1 << 17)))
    bomb = gzip.compress(b"\0" * (1 << 22))
    archive = warc.read_archive(alone + several + bomb + gzip.compress(record(5, b"end")))
    assert [r.headers["warc-record-id"] for r in archive.records] == [f"<urn:page:{i}>" for i in range(1, 6)]
    assert len(archive.gaps) == 1


def test_warc_broken_member_gives_what_it_holds():
    noise = random.Random(2)
    whole = gzip.compress(b"".join(record(i, noise.randbytes(3000)) for i in range(20)))
    archive = warc.read_archive(whole[: len(whole) // 2])
    assert 8 <= len(archive.records) <= 10 and ids(archive) == list(range(len(archive.records))) and len(archive.gaps) == 1


def test_warc_reading_is_linear():
    import time

    members = gzip.compress(record(1, b"x" * 300)) * 8000
    broken = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\n" for _ in range(50_000)) + record(7, b"end")
    started = time.perf_counter()
    assert len(warc.read_archive(members).records) == 8000
    assert ids(warc.read_archive(broken)) == [7] and ids(warc.read_archive(b"WARC/1.1\r\n" * 100_000)) == []
    assert time.perf_counter() - started < 20


def test_warc_header_that_is_no_number(spark, tmp_path):
    text = record(1, b"a").replace(b"WARC-Type: response", b"WARC-Type: revisit\r\nX-Payload-Length: 1x")
    (tmp_path / "a.warc").write_bytes(text)
    assert [(r.record_type, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path)).collect()] == [("revisit", None)]


def test_warc_repeated_rows(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x")]
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_warc_reads_damaged_files_in_spark(spark, tmp_path):
    body = record(1, b"a") + record(2, b"b")[:-30] + record(3, b"c")
    (tmp_path / "one.warc").write_bytes(body)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(record(4, b"d")))
    rows = warc.read_archives(spark, str(tmp_path), payloads=True).collect()
    assert {r.page_id: bytes(r.payload) for r in rows if r.record_type} == {1: b"a", 3: b"c", 4: b"d"}
    assert [r.reason for r in rows if r.gap_bytes] and all(r.gap_bytes for r in rows if not r.record_type)


# --- 9


def test_html_layout():
    page = """<html><head><title>t</title><style>p{}</style></head><body><h1>A &amp; B</h1><p>one<p>two <b>bold</b>text<br>next
      <ul><li>a<li>b<ol><li>x<li>y</ol></ul><table><tr><th>N<th>Value<tr><td>long name<td>1</table>
      <div style="display:none">no</div><div hidden>no</div><pre>  a
    b</pre><!-- c --><script>if (a<b) "</p>"</script>end"""
    assert html_text.page_text(page).split("\n") == ["A & B", "", "one", "", "two boldtext", "next", "", "- a", "- b", "  1. x", "  2. y", "", "N          Value", "long name  1", "", "  a", "    b", "", "end"]


def test_html_loses_no_visible_text(spark):
    pages = table(spark, "pages").collect()
    got = {r.page_id: r for r in queries.op9_html_text(spark, SF).collect()}
    for p in pages:
        plain = re.sub(r"(?s)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", p.html)
        import html

        plain = html.unescape(re.sub(r"<[^>]*>", " ", plain))
        strip = lambda t: re.sub(r"[\s]+|(?m:^ *- )", "", t)
        assert strip(got[p.page_id].text).replace("-", "") == strip(plain).replace("-", "")
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


@pytest.mark.parametrize(
    "page,want",
    [('<p title="the hidden valley">a</p>', "a"), ('<div class="nav hidden md:block">b</div>', "b"), ("<p aria-hidden=true>c</p>", "c"), ('<p data-style="display:none">d</p>', "d"),
     ("<p hidden>no</p><p HIDDEN=''>no</p><p title='a' hidden>no</p><p style='color:red; display : none !important'>no</p>e", "e"), ("<div class=a / hidden>no</div>f", "f"),
     ("<head><title>T</title><p>text", "text"), ("<head><meta charset=x>text", "text"), ("<head><style>s</style><link rel=x></head><body>b", "b"),
     ('<div><svg width="1"/>after<math/>more</div>', "aftermore"), ('<div><svg><path d="x"/></svg>after</div>', "after"), ("<svg width=1/>no</svg>g", "g"), ("<svg><path><p>h</p>", "h"),
     ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"), ("<select><option>one<option>two</select>", "one\ntwo"), ("<video>no</video><p>i", "i")],
)
def test_html_visibility(page, want):
    assert html_text.page_text(page) == want


class Plain(__import__("html.parser", fromlist=["x"]).HTMLParser):
    """A second, simple renderer: the visible words in order, without layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = [], []

    def handle_starttag(self, tag, attrs):
        unseen = tag in ("head", "script", "style", "template") or any(k == "hidden" or (k == "style" and "display:none" in (v or "")) for k, v in attrs)
        if tag not in html_text.VOID:
            self.hidden.append((tag, unseen))
        if tag in html_text.BLOCK or tag in ("br", "td", "th", "table"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        for i in range(len(self.hidden) - 1, -1, -1):
            if self.hidden[i][0] == tag:
                del self.hidden[i:]
                break
        if tag in html_text.BLOCK or tag in ("td", "th", "table"):
            self.out.append(" ")

    def handle_data(self, data):
        if not any(h for _, h in self.hidden):
            self.out.append(data)


def random_page(dice, depth=0):
    word = lambda: "".join(dice.choices("abcdefg", k=4))
    parts = []
    for _ in range(dice.randrange(1, 4)):
        kind = dice.choice(["text", "p", "div", "ul", "table", "b", "hidden", "script"] if depth < 4 else ["text"])
        inner = random_page(dice, depth + 1) if kind not in ("text", "p", "script") else word()
        parts.append(
            {"text": word() + " &amp; " + word(), "ul": f"<ul><li>{inner}</li><li>{word()}</li></ul>", "table": f"<table><tr><td title='a > b'>{inner}</td><td colspan=2>{word()}</td></tr></table>",
             "hidden": f"<div {dice.choice(['hidden', 'style=display:none', chr(34).join(['style=', 'display:none', ''])])}>{inner}</div>", "script": f"<script>if (a<b) '{inner}'</script>"}.get(kind, f"<{kind}>{inner}</{kind}>")
        )
    return " ".join(parts)


def test_html_words_equal_a_second_renderer():
    for seed in range(200):
        page = f"<html><head><title>no</title></head><body>{random_page(random.Random(seed))}</body></html>"
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert [w for w in html_text.page_text(page).split() if w != "-"] == "".join(plain.out).split(), page


@pytest.mark.parametrize(
    "page,want",
    [("<table>" * 5000 + "<tr><td>deep", "deep"), ("<div>" * 50_000 + "x", "x"), ("<p>a</p>" + "<a b='" * 100_000, None), ("<a b='" * 50_000 + ">t", None), ("<a b='" * 50_000 + "'>'", None), ("<a b='" * 50_001 + "'>'", None), ("<b><table>" + "<div></b>" * 20_000 + "y", "y"),
     ("<![CDATA[" * 50_000, None), ("<li>" * 20_000 + "z", None), ("<ul>" * 3000 + "<li>w", None)],
)
def test_html_is_linear(page, want):
    import time

    started = time.perf_counter()
    text = html_text.page_text(page)
    assert time.perf_counter() - started < 5 and (want is None or text == want)


def test_html_breaks_spans_and_quotes():
    assert html_text.page_text("a<br><br>b<br>c") == "a\n\nb\nc"
    assert html_text.page_text("<table><tr><td>aaaa<td>bb<td>c<tr><td colspan=2>x<td>d</table>") == "aaaa  bb  c\nx         d"
    assert html_text.page_text("<a title='a > b'>t</a> <a title=don't>u</a> <p title='open>v</p>w") == "t u\n\nv\n\nw"
    assert html_text.page_text("<table><tr><td><ul><li>a<li>b</ul><p>c</p><table><tr><td>d<td>e</table></table>") == "- a - b c d e"


def test_html_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<div>" * 5000 + "deep"), (4, "</p></li><td>x"), (5, "<"), (5, "<"), (None, "a<!-- open"), (6, "<table><tr><td>")]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert len(out) == 8
    assert {r.page_id: r.text for r in out} == {1: "", 2: "", 3: "deep", 4: "x", 5: "<", None: "a", 6: ""}


# --- 10


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_rules_equal_brute_force(spark):
    extra = ["a\nb\na\n\n\n", "x y z x y z w", "é|é <b>", None, "", "   ", "spam " * 80]
    texts = [(r.doc_id, r.text) for r in table(spark, "documents").collect()] + [(10_000 + i, t) for i, t in enumerate(extra)]
    out = rules.quality_rules(docs(spark, texts)).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in out} == {i: brute_rules(t) for i, t in texts}
    assert not any(r.kept and r.base_failed for r in out)


def brute_kept(text):
    import zstandard

    data = (text or "").encode()
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    limits = lambda n: next((low, high) for top, low, high in rules.BANDS if top is None or n <= top)
    parts = [data] + [data[a : a + 4096] if a + 4096 <= len(data) else data[max(0, len(data) - 4096) :] for a in range(0, len(data), 4096)]
    return not brute_rules(text)[5] and all(limits(len(p))[0] <= ratio(p) <= limits(len(p))[1] for p in parts)


def test_rules_kept_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = queries.op10_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.kept for r in out} == {i: brute_kept(t) for i, t in texts.items()}


def test_compression_bands(spark):
    dice = random.Random(4)
    words = ["".join(dice.choices("etaoinshrdlu", k=dice.randrange(2, 9))) for _ in range(400)]
    prose = " ".join(dice.choices(words, k=900))
    noise = " ".join("".join(chr(dice.randrange(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(900))
    stamp = " ".join(f"entry {i} of the list" for i in range(900))
    got = {r.doc_id: r.kept for r in rules.quality_rules(docs(spark, [(1, prose), (2, noise), (3, stamp)])).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert len(rules.quality_rules(docs(spark, odd_rows())).collect()) == 8
    assert rules.quality_rules(docs(spark, [])).count() == 0


@pytest.mark.parametrize("prose_bytes,bad_bytes", [(60_000, 45_000), (3_900, 3_600)])
def test_one_bad_stretch_rejects_wherever_it_lies(spark, prose_bytes, bad_bytes):
    dice = random.Random(4)
    prose = " ".join("".join(dice.choices("etaoinshrdlu", k=dice.randrange(2, 9))) for _ in range(20_000))[:prose_bytes]
    bad = ("incomprehensible characterizations notwithstanding everything. " * 2000)[:bad_bytes]
    at = len(prose) // 2
    texts = [(0, prose), (1, bad + prose), (2, prose + bad)] + ([(3, prose[:at] + bad + prose[at:])] if bad_bytes > 2 * rules.CHUNK_BYTES else [])
    out = {r.doc_id: r for r in rules.quality_rules(docs(spark, texts)).collect()}
    assert not any(r.base_failed for r in out.values()) and all(rules.in_bands(len(t), out[i].ratio, 0) for i, t in texts)
    assert {i: r.kept for i, r in out.items()} == {i: i == 0 for i, _ in texts}
    assert all(r.chunks == -(-len(dict(texts)[i]) // rules.CHUNK_BYTES) for i, r in out.items())


# --- all

EXTRA = "id value key n text_sha256 kept kept_id keep_id group_size copy copies taken taken_id size source_size target shard quality_score score label body same sketch n_shingles component_id h d k w doc words".split()


def with_extra(frame):
    """Columns whose names the operators use inside, or return."""
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(f"own {c}") for c in EXTRA if c not in frame.columns})


OPERATORS = {
    "op1": (near_dedup.near_duplicates, {}), "op2": (licenses.license_labels, {}), "op4": (lambda d: bpe.encode_documents(d, queries.vocabulary()), {}), "op6": (exact_dedup.exact_duplicates, {}),
    "op7": (mixing.mix, {}), "op10": (rules.quality_rules, {}),
}


@pytest.mark.parametrize("name", [*OPERATORS, "op5"])
def test_documents_with_clashing_columns(spark, name):
    frame = docs(spark, odd_rows())
    if name == "op5":
        labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
        plan = lambda d: quality.classify(d, with_extra(labels) if d is not frame else labels)
    else:
        plan = OPERATORS[name][0]
    assert sorted(map(str, plan(with_extra(frame)).collect())) == sorted(map(str, plan(frame).collect()))
    assert len(plan(frame).collect()) == 8 and plan(frame.limit(0)).count() == 0


@pytest.mark.parametrize("plan", [urls.filter_urls, html_text.extract_text, warc.round_trip])
def test_pages_with_clashing_columns(spark, plan):
    rows = [(1, "http://a.net/", "<p>x"), (1, "http://a.net/", "<p>x"), (None, None, None), (2, "", ""), (3, "u" * 70_000, "y" * 2_000_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    extra = with_extra(frame).withColumnRenamed("text_sha256", "record").withColumnRenamed("size", "first")
    assert sorted(map(str, plan(extra).collect())) == sorted(map(str, plan(frame).collect()))
    assert plan(frame).count() == 5 and plan(frame.limit(0)).count() == 0


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows = table(spark, "documents")
    kept = [rows.count()]
    frame, names = rows, rows.columns
    for name, stage in p.STAGES:
        frame = stage(spark, frame, SF)
        frame.write.parquet(str(tmp_path / name.replace(" ", "_")))
        frame = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        kept.append(frame.count())
        if name != "bpe":
            assert frame.columns == names
        if name == "exact dedup":
            assert frame.select("text").distinct().count() == kept[-1]
        if name == "near dedup":
            texts = [(r.doc_id, r.text) for r in frame.collect()]
            assert all(c == i or not n for i, (n, c) in brute_components(texts).items())
    assert kept[0] > kept[1] >= kept[2] > kept[3] and kept[4] == kept[5]
    lib = library()
    mixed = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "source_mix")).collect()}
    assert all(r.ids == lib.encode(mixed[r.doc_id], add_special_tokens=False).ids for r in frame.collect())


@pytest.mark.parametrize("number", range(4))
def test_pipeline_stages_with_clashing_columns(spark, number):
    import corpus_pipeline as p

    frame, stage = docs(spark, odd_rows()), p.STAGES[number][1]
    plain, more = stage(spark, frame, SF), with_extra(frame)
    got = stage(spark, more, SF)
    assert got.columns == more.columns
    assert sorted(map(str, got.select(*frame.columns).collect())) == sorted(map(str, plain.collect()))
    assert all(r[c] == f"own {c}" for r in got.collect() for c in EXTRA if c not in frame.columns)


def test_pipeline_stages_odd_rows(spark):
    import corpus_pipeline as p

    frame = docs(spark, odd_rows())
    assert sorted((r.doc_id or 0) for r in p.drop_copies(spark, frame, SF).collect()) == [0, 2, 3, 5, 6]
    # one row repeated very often, and rows without id that are all alike
    hot = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same").alias("text")).unionByName(spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("no id").alias("text")))
    assert {tuple(r) for r in p.drop_copies(spark, hot, SF).groupBy("doc_id").count().collect()} == {(7, 1), (None, 300)}
    assert sorted((r.doc_id or 0) for r in p.drop_near_copies(spark, frame, SF).collect()) == [0, 1, 2, 3, 4, 6]
    assert p.mix_sources(spark, frame, SF).count() > 0
    for _, stage in p.STAGES:
        assert stage(spark, docs(spark, []), SF).count() == 0


def test_near_duplicates_of_hot_classes(spark):
    """A third of the rows is one class, a third has no words."""
    n = 3000
    text = F.when(F.col("id") % 3 == 0, "one two three four five six").when(F.col("id") % 3 == 1, " ").otherwise(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" b c d e f")))
    out = near_dedup.near_duplicates(spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(i, 0 if i % 3 == 0 else i) for i in range(n)}
