"""Event-driven parts as Structured Streaming jobs.

Late events are accepted for ten minutes of event time (our choice). The same
functions run on a batch DataFrame, so a stream read to its end equals the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATENESS = "10 minutes"


def _timed(events: DataFrame) -> DataFrame:
    """A stream gets a zoned event time and the watermark; a batch needs neither."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS) if events.isStreaming else events


def windows(events: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and mean value per event-time window and type."""
    rows = _timed(events)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "events", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = _timed(events)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def threshold_alerts(events: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Events over their type's limit; the limits are a small fixed map."""
    limit = F.element_at(F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v)))), F.col("event_type"))
    return events.where(F.col("value") > limit).select("event_id", "event_type", "value", limit.alias("limit"))


def breaker(events: DataFrame, failures: int = 3, cool_seconds: int = 60) -> DataFrame:
    """Circuit breaker per user over (ts, event_type): opens after consecutive
    errors, tries again after the cooling time. One row per state change. A batch
    holds time and kind of a user's events only (9 bytes each) and is taken in
    order of time; events older than the last of the batches before are late and
    are left out."""
    schema = "user_id long, ts timestamp, state string"

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, count, since, last = state.get if state.exists else ("closed", 0, 0.0, float("-inf"))
        out = []
        parts = [(c["ts"].to_numpy("datetime64[ns]"), (c["event_type"] == "error").to_numpy()) for c in chunks]
        times, errors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        for i in np.argsort(times, kind="stable"):
            ts = pd.Timestamp(times[i])
            before, at = now, ts.timestamp()
            if at < last:
                continue
            last = at
            if now == "open" and at - since >= cool_seconds:
                now = "half_open"
            if errors[i]:
                count += 1
                if now == "half_open" or (now == "closed" and count >= failures):
                    now, since = "open", at
            elif now != "open":
                now, count = "closed", 0
            if now != before:
                out.append((key[0], ts, now))
        state.update((now, count, since, last))
        yield pd.DataFrame(out, columns=["user_id", "ts", "state"])

    return events.select("user_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(step, schema, "now string, count int, since double, last double", "append", GroupStateTimeout.NoTimeout)


def deliver(alerts: DataFrame, folder: str, checkpoint: str):
    """Alerts to Parquet, once: each batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
