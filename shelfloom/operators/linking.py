"""Entities in texts by a dictionary table, and product codes with their ranks.

Aliases and texts are cut into words; runs of up to ``longest`` words meet by
equality, so the dictionary may have any size. A match inside a longer one goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.sources.tables import written

#: A product code: B0 and eight capitals or digits, fixed.
CODE = r"\bB0[A-Z0-9]{8}\b"


def words(text: Column) -> Column:
    """Runs of letters, digits and ``#``, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}#]+"), F.lit(0))


#: Bits of the sieve of aliases for each alias, and at most: 8 MB.
SIEVE_BITS, SIEVE_MOST = 16, 1 << 26


def _places(alias: Column, bits: int) -> list[Column]:
    """Three bits of a sieve for an alias, ``bits`` a power of two."""
    h = F.xxhash64(alias)
    return [F.shiftrightunsigned(h, n).bitwiseAND(F.lit(bits - 1)) for n in (0, 20, 38)]


def _sieve(names: DataFrame, bits: int) -> DataFrame:
    """One row with the aliases' bits, as an array of whole numbers of 64."""
    at = names.select(F.explode(F.array(*_places(F.col("alias"), bits))).alias("at")).select(F.shiftright("at", 6).alias("n"), F.expr("shiftleft(1L, int(at & 63))").alias("b"))
    every = names.sparkSession.range(bits // 64).select(F.col("id").alias("n"), F.lit(0).cast("long").alias("b"))
    words = at.groupBy("n").agg(F.bit_or("b").alias("b")).union(every).groupBy("n").agg(F.bit_or("b").alias("b"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "b"))), lambda x: x["b"]).alias("sieve"))


def _passes(alias: Column, bits: int) -> Column:
    there = lambda at: F.get("sieve", F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))) != 0
    first, second, third = map(there, _places(alias, bits))
    return first & second & third


def linked(texts: DataFrame, aliases: DataFrame, longest: int = 4) -> DataFrame:
    """``(id, start, length, alias, entity)`` for texts (id, text) and a dictionary
    (alias, entity): words that spell an alias, the longest where several cover each
    other. An alias of several entities gives them all; equal rows of the dictionary
    count once, aliases of more than ``longest`` words are never found.

    Runs of words that a sieve of the aliases holds back never leave their task (at
    most 8 MB; a run that it lets through by chance meets no alias). Entities come
    last, so what is shuffled doesn't grow with the number of entities of an alias."""
    known = written(aliases.select(F.array_join(words(F.col("alias")), " ").alias("alias"), "entity").where("alias <> ''").distinct())
    names = known.select("alias").distinct()
    bits = 1 << min(max(SIEVE_BITS * known.count() - 1, 4095).bit_length(), SIEVE_MOST.bit_length() - 1)
    cut = texts.select("id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(i.alias("start"), n.alias("length")))))
    fits = F.filter(spans, lambda s: s["start"] + s["length"] - 1 <= F.size("w"))
    grams = cut.select("id", "w", F.explode(fits).alias("s")).select("id", F.col("s.start").alias("start"), F.col("s.length").alias("length"), F.array_join(F.slice("w", F.col("s.start"), F.col("s.length")), " ").alias("alias"))
    sieved = grams.crossJoin(F.broadcast(written(_sieve(names, bits)))).where(_passes(F.col("alias"), bits)).select("id", "start", "length", "alias")
    found = sieved.join(names, "alias")
    end = F.col("start") + F.col("length") - 1
    # covered: an earlier start reaches as far, or the same start reaches further
    order = (F.col("start").cast("long") * (longest + 1) - F.col("length")).alias("order")
    before = Window.partitionBy("id").orderBy("order").rangeBetween(Window.unboundedPreceding, -1)
    kept = found.select("id", "start", "length", "alias", order).withColumn("reach", F.max(end).over(before)).where(F.col("reach").isNull() | (F.col("reach") < end))
    return kept.join(known, "alias").select("id", "start", "length", "alias", "entity")


def coded(texts: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(id, code, rank)`` of every product code in a text, once each, with the best
    rank that ``ranks`` (code, rank) has for it, else null."""
    codes = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CODE), F.lit(0)))).alias("code"))
    return codes.join(ranks.groupBy("code").agg(F.min("rank").alias("rank")), "code", "left").select("id", "code", "rank")
