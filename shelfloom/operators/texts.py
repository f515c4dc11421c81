"""Texts as rows: splitting, understanding of questions, grounding, guards.

Lists of words are parameters: each becomes one expression a row, no join.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import folds


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 500) -> DataFrame:
    """Chunks ``(id, kind, section, part, title, content)``: pipe tables whole, the
    text between them by level-two headings, long sections packed to ``size``."""
    table = r"((?:\|[^\n]+\|\n){2,})"
    rows = docs.select(F.col(id_col).alias("id"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")).alias("t"))
    cut = rows.select("id", F.regexp_extract_all("t", F.lit(table), F.lit(1)).alias("tables"), F.split("t", table, -1).alias("pieces"))

    def before(i):
        """The text's end before a table: six lines reach over three tables at most."""
        parts = F.transform(F.sequence(F.greatest(F.lit(0), i - 3), i), lambda j: F.concat(F.get(F.col("pieces"), j), F.when(j < i, F.get(F.col("tables"), j)).otherwise("")))
        lines = F.split(F.array_join(parts, ""), "\n")
        return F.filter(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 5), F.lit(6)), lambda x: F.trim(x).rlike(r"^(#|\*\*)"))

    tables = cut.select("id", F.posexplode(F.transform("tables", lambda c, i: F.struct(c.alias("content"), F.try_element_at(before(i), F.lit(-1)).alias("head")))).alias("section", "x"))
    title = F.trim(F.regexp_replace(F.coalesce("x.head", F.lit("")), r"[#*]", ""))
    named = tables.select("id", F.lit("table").alias("kind"), "section", F.lit(0).alias("part"), F.when(title == "", F.concat(F.lit("Table "), F.col("section") + 1)).otherwise(title).alias("title"), F.regexp_replace("x.content", r"\s+$", "").alias("content"))
    plain = rows.select("id", F.posexplode(F.split(F.regexp_replace("t", table, "\n"), "\n## ")).alias("section", "body")).where(F.trim(F.regexp_replace("body", r"\s", "")) != "")
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    head = F.trim(F.regexp_replace(F.substring_index(body, "\n", 1), "#", ""))
    parts = plain.select("id", F.lit("text").alias("kind"), "section", head.alias("title"), F.posexplode(packed(body, size)).alias("part", "content"))
    return named.unionByName(parts)


def packed(text: Column, size: int) -> Column:
    """Paragraphs packed in order into pieces of at most ``size`` characters; a
    longer paragraph is cut hard."""
    pieces = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substring(p, i * size + 1, F.lit(size)))
    start = F.struct(folds.empty("string").alias("done"), F.lit("").alias("open"))
    opened = lambda acc: F.when(acc["open"] == "", F.array().cast("array<string>")).otherwise(F.array(acc["open"]))

    def step(acc, p):
        fits = F.length(acc["open"]) + F.length(p) + 2 <= size
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        short = F.length(p) <= size
        closed = F.when(short, opened(acc)).otherwise(F.concat(opened(acc), cut(p)))
        return F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(
            F.struct(folds.added(acc["done"], closed).alias("done"), F.when(short, p).otherwise("").alias("open"))
        )

    return F.aggregate(pieces, start, step, lambda acc: F.concat(folds.whole(acc["done"]), opened(acc)))


def sentences(text: Column) -> Column:
    """Sentences: ended by ``. ! ?`` before white space, but not after a digit or a
    capital, or by a line end."""
    marked = F.regexp_replace(text, r"(?<![0-9A-Z])([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.trim(s)), lambda s: s != "")


def overlapping(units: Column, size: int) -> Column:
    """Sentences gathered to at most ``size`` characters (each counts one more),
    the last of a chunk opens the next."""
    start = F.struct(folds.empty("string").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("used"))
    joined = lambda acc: F.array(F.array_join(acc["open"], " "))

    def step(acc, s):
        full = (acc["used"] + F.length(s) > size) & (F.size(acc["open"]) > 0)
        last = F.slice(acc["open"], -1, 1)
        return F.when(
            full,
            F.struct(folds.added(acc["done"], joined(acc)).alias("done"), F.array_append(last, s).alias("open"), (F.length(F.try_element_at(acc["open"], F.lit(-1))) + F.length(s) + 2).alias("used")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.array_append(acc["open"], s).alias("open"), (acc["used"] + F.length(s) + 1).alias("used")))

    return F.aggregate(units, start, step, lambda acc: F.concat(folds.whole(acc["done"]), F.when(F.size(acc["open"]) > 0, joined(acc)).otherwise(F.array().cast("array<string>"))))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text contains, whatever the case."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))


def expanded(text: Column, synonyms: dict[str, list[str]], per_key: int = 2, most: int = 3) -> Column:
    """The text with up to ``most`` synonyms of its words that it lacks, in parentheses."""
    low = F.lower(text)
    offers = F.array(*(F.when(F.contains(low, F.lit(k.lower())) & ~F.contains(low, F.lit(s.lower())), F.lit(s)) for k, ss in synonyms.items() for s in ss[:per_key]))
    added = F.slice(F.filter(offers, lambda x: x.isNotNull()), 1, most)
    return F.when(F.size(added) > 0, F.concat(text, F.lit(" ("), F.array_join(added, ", "), F.lit(")"))).otherwise(text)


def query_type(text: Column, groups: dict[str, dict[str, list[str]]], least: float = 1.5) -> Column:
    """struct(type, confidence, score): keywords weigh 2, indicators and entities
    1.5, patterns 1; the first type of the highest score, unknown below ``least``."""
    weights = {"keywords": 2.0, "indicators": 1.5, "patterns": 1.0, "entities": 1.5}
    scores = {name: sum((hits(text, words) * weights[kind] for kind, words in kinds.items()), F.lit(0.0)) for name, kinds in groups.items()}
    best, total = F.greatest(*scores.values(), F.lit(0.0)), sum(scores.values(), F.lit(0.0))
    name = F.lit("unknown")
    for n, score in reversed(scores.items()):
        name = F.when(score == best, n).otherwise(name)
    known = best >= least
    return F.struct(F.when(known, name).otherwise("unknown").alias("type"), F.when(known, best / total).otherwise(0.0).alias("confidence"), best.alias("score"))


def score_level(score: Column) -> Column:
    """high from 5, medium from 3, low from 1.5, else unknown."""
    return F.when(score >= 5, "high").when(score >= 3, "medium").when(score >= 1.5, "low").otherwise("unknown")


def context_score(facts: Column, docs: Column, inferences: Column, entities: Column) -> Column:
    """Score of a context from its counts: 1.5 a fact and 1 a document and entity up to three, 2 an inference up to two."""
    return 1.5 * F.least(facts, F.lit(3)) + F.least(docs, F.lit(3)) + 2.0 * F.least(inferences, F.lit(2)) + F.least(entities, F.lit(3))


def complexity(text: Column, words: list[str]) -> Column:
    """complex with a word of the list or two of ``,`` and ``?``; moderate beyond 50 characters; else simple."""
    marks = F.length(text) - F.length(F.translate(text, ",?", ""))
    return F.when((hits(text, words) > 0) | (marks >= 2), "complex").when(F.length(text) > 50, "moderate").otherwise("simple")


def compound(text: Column) -> Column:
    """Parts of a question of several: cut at question marks and at joining words."""
    parts = F.filter(F.transform(F.split(text, r"(?i)\?\s*|\s+(?:and then|and also|as well as)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return parts


def keyword_relevance(text: Column, words: list[str]) -> Column:
    """A fifth for each word found, 1 at most."""
    return F.least(F.lit(1.0), 0.2 * hits(text, words))


def grounding(answer: Column, context: Column, names: list[str]) -> Column:
    """Mean of the shares of the answer's numbers and names that the context has, of those it has any of; 1 without any."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+\.?[0-9]*%?"), F.lit(0)))
    said = F.size(numbers(answer))
    number = F.when(said > 0, F.size(F.array_intersect(numbers(answer), numbers(context))) / said)
    low, there = F.lower(answer), F.lower(context)
    named = sum((F.contains(low, F.lit(n)).cast("int") for n in names), F.lit(0))
    both = sum(((F.contains(low, F.lit(n))) & (F.contains(there, F.lit(n)))).cast("int") for n in names)
    parts = F.filter(F.array(number, F.when(named > 0, both / named)), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 0, 1.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))


def overlap_ratio(sentence: Column, other: Column, words) -> Column:
    """Share of a sentence's words that another text has; ``words`` cuts a text."""
    mine = F.array_distinct(words(sentence))
    return F.when(F.size(mine) == 0, 0.0).otherwise(F.size(F.array_intersect(mine, words(other))) / F.size(mine))


def nfkc(text: Column) -> Column:
    """Compatibility form: full-width and other look-alike letters become the plain ones."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return run(text)


def guarded(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether an input holds none of the blocked patterns, in whatever letters."""
    return ~F.coalesce(F.lower(nfkc(text)).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def redacted(text: Column, patterns: tuple[str, ...], mark: str = "[REDACTED]") -> Column:
    """An answer with what must not get out replaced, whatever its case."""
    for p in patterns:
        text = F.regexp_replace(text, f"(?i){p}", mark)
    return text


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def numbered_sources(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Citation numbers: sources equal in ``keys`` are one, numbered by first mention
    within ``order[0]``'s group."""
    group, *place = order
    first = rows.groupBy(group, *keys).agg(F.min(F.struct(*place)).alias("_first"))
    number = F.row_number().over(Window.partitionBy(group).orderBy("_first"))
    return first.withColumn("number", number).drop("_first")


def suppressed(events: DataFrame, keys: list[str], at: str = "ts", seconds: int = 60, most: int = 3) -> DataFrame:
    """Of equal events the first ``most`` of every tumbling window of ``seconds``."""
    rows = events.withColumn("_w", F.window(at, f"{seconds} seconds").start)
    place = F.row_number().over(Window.partitionBy(*keys, "_w").orderBy(at, *[c for c in events.columns if c not in (*keys, at)][:1]))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).drop("_n", "_w")


def reference_type(tier: Column, source: Column, tiers: dict[str, str], parts: list[tuple[str, str]]) -> Column:
    """Type of a reference: by its tier, else by the first part that its source contains, else article."""
    out = F.lit("article")
    for word, kind in reversed(parts):
        out = F.when(F.contains(F.lower(source), F.lit(word)), kind).otherwise(out)
    return F.coalesce(F.create_map(*(F.lit(x) for p in tiers.items() for x in p))[tier], out)


def extracted(text: Column, pattern: str, least: int = 3, most: int = 10) -> Column:
    """Distinct matches of a pattern's first group, of at least ``least`` characters, the first ``most``."""
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.length(x) >= least)), 1, most)


def allowed_kinds(text: Column, intents: list[tuple[list[str], list[str]]]) -> Column:
    """Kinds of insight that a question asks for: those of every intent with a word in it; null (no filter) without any."""
    found = F.flatten(F.array(*(F.when(hits(text, words) > 0, F.array(*map(F.lit, kinds))).otherwise(F.array().cast("array<string>")) for words, kinds in intents)))
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found)))


def mentioned_recall(answer: Column, wanted: Column) -> Column:
    """Share of the wanted names that stand in an answer as whole words; 1 without any."""
    there = F.filter(wanted, lambda w: F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(answer), "[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.lower(w), F.lit(" "))))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(there) / F.size(wanted))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector of every key, one aggregation per dimension and key."""
    parts = rows.select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("mean"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def chunk_means(units: DataFrame) -> DataFrame:
    """``(doc, chunk, part, mean)``: mean vector of a chunk's own sentences (doc,
    chunk, place, vector), by component; the sentence that a chunk repeats from the
    one before belongs to that one alone."""
    parts = units.select("doc", "chunk", F.posexplode("vector").alias("part", "x"))
    return parts.groupBy("doc", "chunk", "part").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def chunk_similarity(units: DataFrame) -> DataFrame:
    """``(doc, chunk, sentences, similarity)``: mean cosine of each sentence with the
    one before it, that which the chunk repeats included; null for a text of one sentence."""
    before = F.lag("vector").over(Window.partitionBy("doc").orderBy("place"))
    rows = units.withColumn("before", before)
    cos = _dot(F.col("vector"), F.col("before")) / F.nullif(F.sqrt(_dot(F.col("vector"), F.col("vector"))) * F.sqrt(_dot(F.col("before"), F.col("before"))), F.lit(0.0))
    return rows.groupBy("doc", "chunk").agg(F.count("*").alias("sentences"), F.avg(cos).alias("similarity"))


def expanded_by_insight(text: Column, kinds: Column, indicators: Column, added, named) -> Column:
    """A question with the words of the kinds of insight found for it and of its indicators, in the tables' order."""
    words = [F.when(F.arrays_overlap(kinds, F.array(*map(F.lit, k))), F.lit(w)) for k, w in added] + [F.when(F.array_contains(indicators, i), F.lit(w)) for i, w in named]
    return F.concat_ws(" ", text, *words)


def semantic_chunks(units: DataFrame, share: float = 0.25, least: float = 0.5, low: int = 100, high: int = 1000) -> DataFrame:
    """Chunk numbers of sentences (doc, place, size, vector): a chunk ends where the
    cosine to the next sentence is below the document's ``share`` quantile (``least``
    at least) and it holds ``low`` characters, or where it holds ``high``. Vectors
    meet only their neighbour; the fold sees one document's sizes and cuts. A vector of zeros has cosine 0."""
    w = Window.partitionBy("doc").orderBy("place")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = units.withColumns({"_next": F.lead("vector").over(w), "_norm": F.sqrt(dot(F.col("vector"), F.col("vector")))}).withColumn("_after", F.lead("_norm").over(w))
    rows = rows.select("doc", "place", "size", F.when(F.col("_next").isNotNull(), F.coalesce(dot(F.col("vector"), F.col("_next")) / F.nullif(F.col("_norm") * F.col("_after"), F.lit(0.0)), F.lit(0.0))).alias("sim"))
    limit = F.greatest(F.percentile("sim", share).over(Window.partitionBy("doc")), F.lit(least))
    cut = rows.select("doc", F.struct("place", "size", F.coalesce(F.col("sim") < limit, F.lit(False)).alias("cut")).alias("s"))
    start = F.struct(folds.empty("int").alias("chunks"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("chunk"))

    def step(acc, s):
        used = acc["used"] + s["size"]
        ends = (s["cut"] & (used >= low)) | (used >= high)
        return F.struct(folds.added(acc["chunks"], F.array(acc["chunk"])).alias("chunks"), F.when(ends, F.lit(0).cast("long")).otherwise(used).alias("used"), (acc["chunk"] + ends.cast("int")).alias("chunk"))

    folded = cut.groupBy("doc").agg(F.array_sort(F.collect_list("s")).alias("s")).select("doc", "s", F.aggregate("s", start, step, lambda acc: folds.whole(acc["chunks"])).alias("c"))
    return folded.select("doc", F.explode(F.arrays_zip(F.col("s")["place"].alias("place"), F.col("c").alias("chunk"))).alias("x")).select("doc", F.col("x.place").alias("place"), F.col("x.chunk").alias("chunk"))
