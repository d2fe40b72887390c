"""Storm sessions on a stream of threshold crossings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SPAN = "first_us long, last_us long, n long"


def merged_spans(spans, gap_us):
    """Sorted, disjoint (first, last, n) of spans at most ``gap_us`` apart (closed)."""
    out: list[list[int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] <= gap_us:
            out[-1][1], out[-1][2] = max(out[-1][1], last), out[-1][2] + n
        else:
            out.append([first, last, n])
    return [tuple(s) for s in out]


class OpenSessions(StatefulProcessor):
    """Per key the sessions that later rows may still extend; a timer at the end of each one's gap puts it out and forgets it."""

    def __init__(self, key: str, gap_us: int):
        self.key, self.gap_us = key, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", SPAN)

    def _timer(self, last_us: int) -> int:
        """The first millisecond of the watermark at which no row on time is within the gap."""
        return (last_us + self.gap_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        spans = list(held)
        for batch in rows:  # merged batch by batch, so a busy key never stands in memory as a whole
            spans = merged_spans(spans + list(zip(batch["first_us"].tolist(), batch["last_us"].tolist(), batch["n"].tolist())), self.gap_us)
        for last in {s[1] for s in spans} - {s[1] for s in held}:
            self.handle.registerTimer(self._timer(last))
        self.open.put(spans)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        spans = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        ended = [s for s in spans if self._timer(s[1]) <= at]
        kept = [s for s in spans if self._timer(s[1]) > at]
        if kept:
            self.open.put(kept)
        else:
            self.open.clear()
        if ended:
            yield pd.DataFrame({self.key: [key[0]] * len(ended), "first_us": [s[0] for s in ended], "last_us": [s[1] for s in ended], "n": [s[2] for s in ended]})

    def close(self) -> None:
        pass


def storm_session_stream(stream: DataFrame, key: str, ts: str, gap_hours: int, late: str = "1 day") -> DataFrame:
    """Sessions per key with a gap of at most ``gap_hours`` (closed): (key, n, first_ts, last_ts), each put out once.

    A session is put out, and its state dropped, when the watermark (``late`` behind the latest row) has passed its end by
    more than the gap; rows behind the watermark are dropped. Crossings are merged within each task before the shuffle, so a
    key with most rows ships few; rows without a key or time are left out. Needs a state store with several column families.
    """
    gap_us = gap_hours * 3_600_000_000
    kind = stream.schema[key].dataType.simpleString()

    def merge(batches):
        for batch in batches:
            parts = []
            for value, times in batch.groupby(key, sort=False)["us"]:
                parts += [(value, *s) for s in merged_spans(((t, t, 1) for t in times.tolist()), gap_us)]
            yield pd.DataFrame(parts, columns=[key, "first_us", "last_us", "n"])

    rows = stream.select(key, F.unix_micros(ts).alias("us")).dropna()
    spans = rows.mapInPandas(merge, f"{key} {kind}, {SPAN}").withColumn("at", F.timestamp_micros("last_us")).withWatermark("at", late)
    ended = spans.groupBy(key).transformWithStateInPandas(
        statefulProcessor=OpenSessions(key, gap_us), outputStructType=f"{key} {kind}, {SPAN}", outputMode="Append", timeMode="EventTime")
    return ended.select(key, "n", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"))


def open_sessions(spark, folder: str, key: str) -> DataFrame:
    """Sessions that a run of :func:`storm_session_stream` with its state in ``folder`` has not put out, as no row passed their gap yet."""
    held = spark.read.format("statestore").option("stateVarName", "open").load(folder)
    d = held.select(F.col("key")[key].alias(key), "list_element.*")
    return d.select(key, "n", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"))
