"""Mix sources to target weights by Sainte-Laguë apportionment.

The mix is cut into at most ``BLOCKS`` blocks of equal token counts. Blocks go
to the sources one by one to the highest quotient ``target / (2 * seats + 1)``;
the first blocks so given form the first output shard, the next ones the second,
so every shard has integer quotas per source and the shards add up to the whole.

Inside a source the documents stand in an order seeded by a digest of the id, and
the stream of their tokens is cut into blocks. The source's quotas, shard after
shard, select blocks from a seeded place of that stream on, around it as often
as the quotas ask. A document's share follows from its position alone.

Positions come from two running sums: over the digest's leading bits per
source, and inside one such bucket. Documents that agree in id, source and size
are one row with a count until the end, so a repeated id is no hot bucket. The
ranking of quotients runs over buckets of their logarithm. No window holds a
whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, text_or_empty

#: Blocks of the whole mix at most: the grain of the apportionment, whatever the size of the corpus.
BLOCKS = 1 << 18
#: Output shards.
SHARDS = 16
#: Buckets of the seeded order per source.
ORDER_BUCKETS = 4096
#: Buckets of a quotient's logarithm.
PRICE_BUCKETS = 256
#: Copies of one document that are written out in one go.
COPIES = 10_000
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place (from 0) in code-point order, null last: ranges
    are ordered apart and their sizes added up."""
    key = [F.col("source").isNull(), F.col("source")]
    parts = materialize(sources.repartitionByRange(64, *key).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 64 rows
    starts = parts.groupBy("part").agg(F.count("*").alias("c")).select(F.col("part").alias("p"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1
    return parts.withColumn("inside", inside).join(starts, F.col("part") == F.col("p")).withColumn("place", F.col("start") + F.col("inside")).drop("part", "p", "start", "inside")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, weight, target)``.

    Sources in code-point order, null last, take the weights in turn. ``share``
    of all tokens is dealt by weight; a source stops at ``max_repeat`` times its
    size and the excess is dealt again by weight until none is above. The level
    (tokens a unit of weight) rises to its fixed point; the driver holds that
    one number.
    """
    wheel = F.array(*(F.lit(float(w)) for w in weights))
    table = materialize(
        _numbered(sources).withColumn("weight", F.element_at(wheel, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("most", (F.col("source_size") * max_repeat).cast("double"))
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, aim = 0.0, total * share
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        held, weight = table.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not weight or (aim - held) / weight <= level:
            break
        level = (aim - held) / weight
    return table.select("source", "source_size", "weight", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def deal_seats(table: DataFrame, seats: int, shards: int = 1, votes: str = "target") -> DataFrame:
    """Sainte-Laguë: ``(source, seat, rank, shard)`` for every seat given, a
    source's seats and the ranks of all from 0, ties by source and null last.

    Every source offers the quotients of the seats it can come to; they are
    ranked inside buckets of their logarithm, and the buckets' sizes are added up.
    """
    total = table.agg(F.sum(votes)).first()[0] or 0.0
    if total <= 0 or seats <= 0:
        return table.select("source", F.lit(0).cast("long").alias("seat"), F.lit(0).cast("long").alias("rank"), F.lit(0).alias("shard")).limit(0)
    # a divisor at which more seats than wanted are given, so all winners are offered
    offers = lambda price: F.floor(F.col(votes) * price + 0.5).cast("long")
    price = (seats + 1) / total
    while table.agg(F.sum(offers(price))).first()[0] < seats:
        price *= 1.25
    bucket = F.floor(F.log(F.lit(total) / F.col("quotient")) * PRICE_BUCKETS)
    ranked = materialize(
        table.where(offers(price) > 0).select("source", F.col(votes).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), offers(price) - 1)).alias("seat"))
        .withColumn("quotient", F.col("v") / (2 * F.col("seat") + 1)).withColumn("bucket", bucket).select("source", "seat", "quotient", "bucket")
    )
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # log(2 * seats) * PRICE_BUCKETS rows at most
    starts = ranked.groupBy("bucket").agg(F.count("*").alias("c")).select(F.col("bucket").alias("b"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("quotient"), F.asc_nulls_last("source"))) - 1
    out = ranked.withColumn("inside", inside).join(starts, F.col("bucket") == F.col("b")).withColumn("rank", F.col("start") + F.col("inside")).where(F.col("rank") < seats)
    return out.select("source", "seat", "rank", F.floor(F.col("rank") * shards / seats).cast("int").alias("shard"))


def shard_quotas(dealt: DataFrame) -> DataFrame:
    """``(source, shard, quota, first)`` from dealt seats: how many blocks of each
    source a shard holds, and the number of the source's first block there."""
    return dealt.groupBy("source", "shard").agg(F.count("*").alias("quota"), F.min("seat").alias("first"))


def _digest(*parts: Column) -> Column:
    """60 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 1, 15), 16, 10).cast("long")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The documents on their sources' streams, and the shards' quotas.

    Documents: ``(id, source, size, n, from)``, ``n`` equal ones from token
    ``from`` of the stream on, with ``source_size``, ``target``, ``block`` (tokens
    a block), ``held`` (blocks of the stream), ``seats`` (blocks taken), ``offset``
    (the block where selection starts) and ``spans`` (the shards' quotas as ranges
    of seats). Quotas: as ``shard_quotas``.
    """
    same = ["source", "id", "size"]
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_or_empty(text_col)).alias("size"))
        .groupBy(*same).agg(F.count("*").alias("n")).withColumn("place", _digest(F.lit(seed), F.col("id"), F.col("size")))
        .withColumn("bucket", F.floor(F.col("place") / (1 << 60) * ORDER_BUCKETS).cast("int"))
    )
    buckets = materialize(rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("bucket_size")))
    table = materialize(targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_repeat))
    total = table.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, math.ceil(total / blocks))
    dealt = deal_seats(table, round(total / block), shards)
    quotas = materialize(shard_quotas(dealt))
    # a source has one row a shard at most
    span = F.struct(F.col("first").alias("lo"), (F.col("first") + F.col("quota")).alias("hi"), "shard")
    won = quotas.groupBy(F.col("source").alias("w")).agg(F.sum("quota").alias("won"), F.collect_list(span).alias("spans"))
    held = F.ceil(F.col("source_size") / block)
    table = (
        table.join(won, F.col("source").eqNullSafe(F.col("w")), "left").withColumn("held", held)
        .select(
            F.col("source").alias("s"), "source_size", "target", "held", F.lit(block).cast("long").alias("block"),
            F.least(F.coalesce("won", F.lit(0)), F.col("held") * max_repeat).alias("seats"), F.when(F.col("held") > 0, F.pmod(_digest(F.lit(seed), F.lit("start"), F.col("source")), F.col("held"))).otherwise(0).alias("offset"), "spans",
        )
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .join(table, F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("bucket").alias("b"), "s", "start", "source_size", "target", "block", "held", "seats", "offset", "spans")
    )
    so_far = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (
        rows.withColumn("end", so_far).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("from", F.col("start") + F.col("end") - F.col("size") * F.col("n"))
    )
    return placed.select(*same, "n", "from", "source_size", "target", "block", "held", "seats", "offset", "spans"), quotas


def _copies(placed: DataFrame) -> DataFrame:
    """One row per document again; many equal ones are written out by several tasks."""
    few = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))
    runs = placed.withColumn("run", F.explode(few))
    many = runs.where(F.col("n") > COPIES).repartition("run", "from")
    each = F.sequence(F.col("run") * COPIES, F.least(F.col("n"), (F.col("run") + 1) * COPIES) - 1)
    runs = runs.where(F.col("n") <= COPIES).unionByName(many)
    return runs.withColumn("copy", F.explode(each)).withColumn("from", F.col("from") + F.col("copy") * F.col("size")).drop("run", "copy", "n")


def _selected(x: Column) -> Column:
    """How many of a stream's first x tokens the selection takes: whole rounds,
    and the blocks from ``offset`` on, around the stream's end, in the last one."""
    size, block = F.col("source_size"), F.col("block")
    rounds, rest = F.floor(F.col("seats") / F.col("held")), F.col("seats") % F.col("held")
    start, stop = F.col("offset") * block, (F.col("offset") + rest) * block
    upto = lambda end: F.least(x, F.least(end, size))
    last = F.greatest(F.lit(0), upto(stop) - start)
    around = F.least(x, F.greatest(F.lit(0), F.col("offset") + rest - F.col("held")) * block)
    return rounds * x + last + around


def _shard(seat: str) -> Column:
    """The shard whose quota of the source holds a seat."""
    return F.element_at(F.filter("spans", lambda x: (x["lo"] <= F.col(seat)) & (F.col(seat) < x["hi"])), 1)["shard"]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per row: id, ``size`` (words), ``source_size``, ``target``, ``taken`` (words
    the mix takes, repeats counted) and ``shard`` (the first that takes of it, null
    if none does).

    Null text has size 0 and is never taken; a null source is a source of its
    own, the last; null ids are ids of their own kind. Rows that repeat an id are
    separate documents at neighbouring places of the order, and equal rows are
    interchangeable. Texts of any length are counted whole and may be taken in
    part. ``taken`` is at most ``max_repeat * size``, and a source's sum differs
    from its target by a block a round at most. An empty table gives an empty
    result; other columns are ignored. Reruns agree.
    """
    placed, _ = plan_mix(docs, id_col, text_col, source_col, **options)
    rows = _copies(placed)
    taken = F.when((F.col("held") > 0) & (F.col("size") > 0), _selected(F.col("from") + F.col("size")) - _selected(F.col("from"))).otherwise(0)
    # the first block of the document in the order of selection
    first, last = F.floor(F.col("from") / F.col("block")), F.floor((F.col("from") + F.greatest(F.col("size"), F.lit(1)) - 1) / F.col("block"))
    turn = F.when((first < F.col("offset")) & (last >= F.col("offset")), 0).otherwise(F.pmod(first - F.col("offset"), F.greatest("held", F.lit(1))))
    rows = rows.withColumns({"taken": taken.cast("long"), "turn": turn})
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, _shard("turn")).alias("shard"))


def mix_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: ``(id, source, shard, round, first_word, last_word)``, which
    words of a document (from 0, the last included) a shard takes in which round.
    A block that reaches over several documents is a piece of each."""
    placed, _ = plan_mix(docs, id_col, text_col, source_col, **options)
    rows = _copies(placed).where("size > 0 and held > 0")
    block = F.explode(F.sequence(F.floor(F.col("from") / F.col("block")), F.floor((F.col("from") + F.col("size") - 1) / F.col("block"))))
    rows = rows.withColumn("number", block).withColumn("turn", F.pmod(F.col("number") - F.col("offset"), F.col("held")))
    # a block is taken in the rounds 0, 1, ... as far as the seats reach
    times = F.ceil((F.col("seats") - F.col("turn")) / F.col("held"))
    rows = rows.where(times > 0).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).withColumn("seat", F.col("round") * F.col("held") + F.col("turn"))
    begin, end = F.greatest(F.col("number") * F.col("block"), "from"), F.least((F.col("number") + 1) * F.col("block"), F.col("from") + F.col("size"))
    return rows.select(F.col("id").alias(id_col), "source", _shard("seat").alias("shard"), "round", (begin - F.col("from")).alias("first_word"), (end - F.col("from") - 1).alias("last_word"))
