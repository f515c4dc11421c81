"""Lists that grow within a fold over an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that a growing list copies at once.
STEP = 64


def empty(kind: str) -> Column:
    """A list that folds add to, kept as full pieces of ``STEP`` items and an open
    one: adding an item copies that piece, and the list of pieces once a piece, not
    the whole list."""
    return F.struct(F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("some"))


def added(acc: Column, items: Column) -> Column:
    """The list with the items of an array."""
    room = F.size(acc["some"]) < STEP
    return F.struct(
        F.when(room, acc["full"]).otherwise(F.array_append(acc["full"], acc["some"])).alias("full"), F.when(room, F.concat(acc["some"], items)).otherwise(items).alias("some")
    )


def whole(acc: Column) -> Column:
    return F.concat(F.flatten(acc["full"]), acc["some"])
