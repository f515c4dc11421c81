"""Tables that plans write on their way and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key-wise aggregate that one task takes, on average.
TASK_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local session without it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shelfloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe from lost
    executors, of known size. The folder's owner clears it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows by a hash of ``key``, about ``TASK_ROWS`` a task however large the table is
    (``rows``); a number of tasks of its own, as tasks that are merged by their bytes
    hold more groups the larger the table. Small tables are left to the session."""
    return df.repartition(-(-rows // TASK_ROWS), F.col(key)) if rows > TASK_ROWS else df.repartition(F.col(key))
