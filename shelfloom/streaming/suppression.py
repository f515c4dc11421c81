"""Suppression of repeated events on a stream, in order of event time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfloom.streaming.windows import state_store

#: After the first suppressed event, every tenth is let through with the count so far.
REPORTED = 10
#: Windows in a stretch of time whose waiting events are packed together.
STRETCH = 8


def suppressed(events: DataFrame, name: str, at: str, number: str, seconds: int = 60, most: int = 3, lateness: str = "10 minutes") -> DataFrame:
    """``(name, number, at, suppressed)`` of the events that pass. A name's first event
    opens a window of ``seconds``; in it the first ``most`` pass with 0, of the
    others the first and every tenth, with how many were held back so far. An event
    later than the window's end opens the next.

    Events wait in map state until the watermark has passed them and are then taken
    by time, then number; so arrival order doesn't matter, and an event read twice
    (equal time and number) counts once. They are packed: what a batch of rows has of
    one stretch of time (``STRETCH`` windows) is one value, and stretches are taken
    one after the other. Events later than ``lateness`` are dropped by the
    watermark, and the stream's last ``lateness`` waits for a later event of any key.
    The state of a key is its open window and what still waits. Events without name,
    time or number are left out, and so are those before 1970, where a watermark
    begins."""
    length = seconds * 1_000_000

    def passing(events: np.ndarray, first: int | None, count: int) -> tuple[np.ndarray, int | None, int]:
        """(at, number, suppressed) of the events (at, number), in order, that pass, and
        the window that is open behind them; one step a window, not an event."""
        out, at = [np.empty((0, 3), np.int64)], 0
        while at < len(events):
            if first is None or events[at, 0] - first > length:
                first, count = int(events[at, 0]), 0
            end = int(np.searchsorted(events[:, 0], first + length, side="right"))
            over = np.maximum(0, np.arange(count + 1, count + 1 + end - at) - most)
            kept = (over <= 1) | (over % REPORTED == 0)
            out.append(np.column_stack([events[at:end][kept], over[kept]]))
            count, at = count + end - at, end
        return np.concatenate(out), first, count

    class Hold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "stretch long, part long", "events binary")
            self.window = handle.getValueState("window", "first long, count long, parts long")

        def opened(self) -> tuple[int | None, int, int]:
            return self.window.get() if self.window.exists() else (None, 0, 0)

        def handleInputRows(self, of, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            first, count, parts = self.opened()
            least = None
            for part in rows:
                packed = np.column_stack([part["micros"].to_numpy(np.int64), part["number"].to_numpy(np.int64)])
                stretch = packed[:, 0] // (STRETCH * length)
                order = np.argsort(stretch, kind="stable")
                ends = np.flatnonzero(np.diff(stretch[order])) + 1
                for places in np.split(order, ends):
                    self.waiting.updateValue((int(stretch[places[0]]), parts), (packed[places].tobytes(),))
                parts += 1
                low = int(packed[:, 0].min())
                least = low if least is None else min(least, low)
            if least is not None:
                self.window.update((first, count, parts))
                # one timer a call, not after the first event that it brought
                self.handle.registerTimer(-(-least // 1000))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            first, count, parts = self.opened()
            keys = sorted((s, n) for s, n in self.waiting.keys())  # noqa: SIM118
            later = None
            for stretch, own in groupby(keys, key=lambda k: k[0]):
                if stretch * STRETCH * length > passed:
                    later = stretch * STRETCH * length
                    break
                own = list(own)
                packed = np.concatenate([np.frombuffer(self.waiting.getValue(k)[0], np.int64).reshape(-1, 2) for k in own])
                packed = packed[np.lexsort((packed[:, 1], packed[:, 0]))]
                packed = packed[np.append(True, (packed[1:] != packed[:-1]).any(axis=1))]
                due = int(np.searchsorted(packed[:, 0], passed, side="right"))
                if due == 0 and len(own) == 1:  # all of it still waits, as it is
                    later = int(packed[0, 0])
                    break
                for k in own:
                    self.waiting.removeKey(k)
                if due < len(packed):
                    self.waiting.updateValue((stretch, parts), (packed[due:].tobytes(),))
                    parts, later = parts + 1, int(packed[due, 0])
                out, first, count = passing(packed[:due], first, count)
                if len(out):
                    yield pd.DataFrame({"key": [key[0]] * len(out), "number": out[:, 1], "micros": out[:, 0], "suppressed": out[:, 2]})
                if later is not None:
                    break
            if keys:
                self.window.update((first, count, parts))
            if later is not None:
                self.handle.registerTimer(-(-later // 1000))

        def close(self) -> None:
            pass

    rows = events.select(F.col(name).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(number).cast("long").alias("number")).dropna()
    rows = rows.withColumn("micros", F.unix_micros("at")).withWatermark("at", lateness)
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(Hold(), f"key {kind}, number long, micros long, suppressed long", "Append", "EventTime")
    return out.select(F.col("key").alias(name), F.col("number").alias(number), F.timestamp_micros("micros").alias(at), "suppressed")


def appended(stream: DataFrame, folder: str) -> DataFrame:
    """All rows that a stream in append mode gives until its source is read. A batch
    that is run again replaces itself."""
    spark = stream.sparkSession
    save = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
    with state_store(spark):
        stream.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{folder}/state-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)
