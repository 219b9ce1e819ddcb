"""Deliveries paired with message ids on a stream: one pending delivery per session, given up after a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

FIELDS = ["file", "line_no", "sess", "t", "u", "verdict", "score", "folder"]
STATE = StructType([StructField(f, LongType() if f == "line_no" else StringType()) for f in FIELDS])
OUT = StructType([*STATE.fields, StructField("msgid", StringType())])
#: Milliseconds a delivery waits for its message id.
PATIENCE_MS = 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stitcher(StatefulProcessor):
    """Keyed by file and session. A newer delivery replaces the pending one; a timer flushes what stays alone."""

    def __init__(self, timers: bool = True):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("line_no")
        out = []
        for r in pdf.itertuples(index=False):
            if r.kind == "D":
                self.pending.update(tuple(getattr(r, f) for f in FIELDS))
            elif r.kind == "M" and self.pending.exists():
                out.append((*self.pending.get(), r.msgid))
                self.pending.clear()
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if self.timers and self.pending.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + PATIENCE_MS)
        yield pd.DataFrame(out, columns=[*FIELDS, "msgid"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(*self.pending.get(), None)] if self.pending.exists() else []
        self.pending.clear()
        yield pd.DataFrame(rows, columns=[*FIELDS, "msgid"])

    def close(self) -> None:
        pass


def stitch_stream(events: DataFrame, timers: bool = True) -> DataFrame:
    """Stitched deliveries of a stream of events (``kind`` D or M). Needs the RocksDB state store.

    A replay of a bounded input has no timers: with pending ones it would run on until they expire.
    """
    e = events.filter(F.col("kind").isin("D", "M")).select("kind", *FIELDS, "msgid")
    return e.groupBy("file", "sess").transformWithStateInPandas(Stitcher(timers), OUT, "Append", "ProcessingTime" if timers else "None")


def daily_counts(events: DataFrame, at: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Events per day (and key) of a stream, with a watermark: a day is final once the stream is ``late`` past it."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("window.start").alias("d"), *keys, "n")
    )
