"""Streams read to their end: figures over the last samples of every key, kept in
state, and actions by a static table of rules."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfloom.operators.rules import thresholds
from shelfloom.sources import stored

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that transformWithState needs, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def last_figures(events: DataFrame, key: str, at: str, number: str, value: str, most: int = 100) -> DataFrame:
    """``(key, n, mean, least, p50, p90, p99)`` of a key's last ``most`` samples by
    time, then number, after each batch that has some of the key's. Late samples take
    their place; a sample read twice (equal time and number) counts once. The state
    is a list of ``most`` samples a key, whatever the stream's length. Quantiles are
    the sample at floor(share times n)."""

    class Last(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getListState("kept", "at double, number long, value double")

        def handleInputRows(self, of, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            kept = {(a, n): v for a, n, v in self.kept.get()}
            for part in rows:
                # a part is cut at once: no key's batch is held whole
                kept |= {(a, n): v for a, n, v in zip(part["at"], part["number"], part["value"], strict=True)}
                kept = dict(sorted(kept.items())[-most:])
            self.kept.put([(float(a), int(n), float(v)) for (a, n), v in kept.items()])
            values = sorted(kept.values())
            share = lambda q: values[min(len(values) - 1, int(len(values) * q))]
            yield pd.DataFrame({"key": [of[0]], "n": [len(values)], "mean": [math.fsum(values) / len(values)], "least": [values[0]], "p50": [share(0.5)], "p90": [share(0.9)], "p99": [share(0.99)]})

        def close(self) -> None:
            pass

    rows = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").cast("double").alias("at"), F.col(number).cast("long").alias("number"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(Last(), f"key {kind}, n long, mean double, least double, p50 double, p90 double, p99 double", "Update", "None")
    return out.withColumnRenamed("key", key)


def read_to_end(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """The last row of every key that a stream in update mode gives until its source
    is read; each batch is written under its number, so one that is run again replaces itself."""
    spark = stream.sparkSession
    save = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
    with state_store(spark):
        stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    plain = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*plain), "batch").alias("x")).select(*keys, "x.*")


def rule_actions(events: DataFrame, rules: DataFrame, folder: str, keys: list[str], state: str) -> None:
    """Read a stream of rows (metric, value and others) to its end against a static
    table of rules (metric, op, limit, severity) and store what holds, batch by batch,
    as an upsert on ``keys`` by severity: a batch that is run again, or an event that
    comes twice, leaves one row."""

    def store(rows: DataFrame, batch: int) -> None:
        stored.upsert(rows, folder, [*keys, "severity"], "severity")

    thresholds(events, rules).writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
