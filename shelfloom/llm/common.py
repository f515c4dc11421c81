"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex for a run of non-blank characters (blank: space and \x09-\x0D).
BLANK_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(BLANK_WORD)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Only a local session without that setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shelfloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read it again: the
    lineage ends there, the rows survive lost executors and are computed once,
    and later plans know their true size. The folder's owner removes them."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/shelfloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the same with underscores, whatever no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key counts as hot if it has more than one of this many rows.
HOT = 1000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, n: str) -> DataFrame:
    """``rows``, each with the columns of its class, null without one.

    ``classes`` is a written table, one row a key; ``n`` counts the rows of a
    key. Keys with over a thousandth of the classed rows are fewer than a
    thousand, so these classes are broadcast; their rows spread over the tasks
    of the second join, which has no hot key.
    """
    values = [c for c in classes.columns if c != key]
    total = classes.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT > total
    named = lambda part, mark: part.select(F.col(key).alias(f"{mark}{key}"), *(F.col(v).alias(f"{mark}{v}") for v in values))
    some = rows.join(F.broadcast(named(classes.where(hot), "_hot_")), F.col(key) == F.col(f"_hot_{key}"), "left")
    spread = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    some = some.withColumn("_key", F.when(F.col(f"_hot_{key}").isNull(), F.col(key)).otherwise(spread))
    every = some.join(named(classes.where(~hot), "_rest_"), F.col("_key") == F.col(f"_rest_{key}"), "left")
    return every.select(*rows.columns, *(F.coalesce(f"_hot_{v}", f"_rest_{v}").alias(v) for v in values))


def sliced(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``max_bytes`` of the
    column, whatever the length of the texts; a longer text is alone."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, int(n * max_bytes / max(1, batch.column(column).nbytes)))
        for start in range(0, n, step):
            yield batch.slice(start, step)


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
