"""Keyed state that puts days in order: rows may come shuffled within the watermark, and timers, not later rows, close things.

Days are held in state until the watermark has passed their end; only then are they folded, in order, so the result doesn't
depend on how batches cut the feed, and a query that restarts from its checkpoint goes on as if it had never stopped. Rows
later than the watermark are dropped by Spark and left to the restatement (restate.py). State is bounded by the days inside
the watermark. The RocksDB state store holds it: call use_rocksdb() once a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """List, map and timer state need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _days(times: pd.Series) -> list[int]:
    """Days since 1970 of UTC timestamps."""
    return [int(t.timestamp() * 1000) // DAY for t in times]


def _date(day: int):
    return pd.Timestamp(day * DAY, unit="ms").date()


class _OverdraftRuns(StatefulProcessor):
    """held: days not yet folded. run: the first and last negative day of the open run and its length."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "day long", "eod double")
        self.run = handle.getValueState("run", "first long, last long, days int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for day, eod in zip(_days(frame["ts"]), frame["eod"]):
                self.held.updateValue((day,), (float(eod),))  # a day told twice keeps its last balance
                self.handle.registerTimer((day + 1) * DAY)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY - 1
        eod = self.held.getValue((day,)) if self.held.containsKey((day,)) else None
        run = tuple(self.run.get()) if self.run.exists() else None
        if eod is not None:
            self.held.removeKey((day,))
        if run and (day - run[1] > self.gap or eod is None and day - run[1] == self.gap or eod is not None and eod[0] >= 0):
            yield pd.DataFrame({"business_id": [key[0]], "first_day": [_date(run[0])], "last_day": [_date(run[1])], "days": [run[2]]})
            self.run.clear()
            run = None
        if eod is not None and eod[0] < 0:
            self.run.update((run[0], day, run[2] + 1) if run else (day, day, 1))
            self.handle.registerTimer((day + self.gap + 1) * DAY)

    def close(self) -> None:
        pass


def overdraft_runs(days: DataFrame, late: str = "2 days", gap: int = 3) -> DataFrame:
    """days (business_id, ts, eod) to closed runs of negative days (business_id, first_day, last_day, days). A run ends with a day that isn't negative, or by a timer when no day has come for gap days."""
    own = days.withWatermark("ts", late).groupBy("business_id")
    return own.transformWithStateInPandas(_OverdraftRuns(gap), "business_id long, first_day date, last_day date, days int", "append", "EventTime")


class _BreakSignals(StatefulProcessor):
    """held: a list of days not yet folded. sums: the two sums of the CUSUM."""

    def __init__(self, k: float, h: float):
        self.k, self.h = k, h

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "day long, inflow double, mean double, sd double")
        self.sums = handle.getValueState("sums", "up double, down double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            days = _days(frame["ts"])
            self.held.appendList([(d, float(i), float(m), float(s)) for d, i, m, s in zip(days, frame["inflow"], frame["mean"], frame["sd"])])
            for day in set(days):
                self.handle.registerTimer((day + 1) * DAY)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        through = expiredTimerInfo.getExpiryTimeInMs() // DAY - 1
        held = [tuple(r) for r in self.held.get()]
        due, rest = sorted(r for r in held if r[0] <= through), [r for r in held if r[0] > through]
        if not due:
            return
        self.held.put(rest) if rest else self.held.clear()
        up, down = tuple(self.sums.get()) if self.sums.exists() else (0.0, 0.0)
        hits = []
        for day, inflow, mean, sd in due:
            z = (inflow - mean) / sd if sd else 0.0
            up, down = max(0.0, up + z - self.k), max(0.0, down - z - self.k)
            if up > self.h or down > self.h:
                hits.append((day, "up" if up > self.h else "down"))
                up = down = 0.0
        self.sums.update((up, down))
        if hits:
            yield pd.DataFrame({"business_id": [key[0]] * len(hits), "day": [_date(d) for d, _ in hits], "side": [s for _, s in hits]})

    def close(self) -> None:
        pass


def break_signals(days: DataFrame, late: str = "2 days", k: float = 0.5, h: float = 5.0) -> DataFrame:
    """days (business_id, ts, inflow, mean, sd; one a day) to every day on which a two-sided CUSUM of inflow signalled, with its side."""
    own = days.withWatermark("ts", late).groupBy("business_id")
    return own.transformWithStateInPandas(_BreakSignals(k, h), "business_id long, day date, side string", "append", "EventTime")


class _FirstSightings(StatefulProcessor):
    """seen: ids met, each forgotten after its time to live."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id long", "n long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = []
            for i, d in enumerate(frame["transaction_id"]):
                if not self.seen.containsKey((int(d),)):
                    self.seen.updateValue((int(d),), (1,))
                    new.append(i)
            if new:
                yield frame.iloc[new]

    def close(self) -> None:
        pass


def first_sightings(feed: DataFrame, keep_days: int = 7) -> DataFrame:
    """feed's rows (business_id, transaction_id, ...) without those whose id its business has told within keep_days of processing time: a connector that replays its file adds nothing. Processing-time state asks for empty batches without end; a query that should stop (availableNow) sets spark.sql.streaming.noDataMicroBatches.enabled to false."""
    return feed.groupBy("business_id").transformWithStateInPandas(_FirstSightings(keep_days * DAY), feed.schema, "append", "ProcessingTime")
