"""Streaming forms of the ledger's rollups: daily totals with a watermark, activity sessions, and overdraft runs as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_rollup(feed: DataFrame, late: str = "2 days") -> DataFrame:
    """feed (business_id, ts, direction, cents) to totals by business and day; rows later than the watermark are dropped and left to the batch restatement."""
    w = feed.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "business_id")
    return w.agg(F.expr("sum(if(direction = 'in', cents, 0))").alias("inflow"), F.expr("sum(if(direction = 'out', cents, 0))").alias("outflow"), F.count("*").alias("n")).select("business_id", F.to_date("w.start").alias("date"), "inflow", "outflow", "n")


def sessions(feed: DataFrame, gap: str = "3 days", late: str = "2 days") -> DataFrame:
    """Runs of activity of a business with no pause longer than the gap."""
    s = feed.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "business_id")
    return s.agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).select("business_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "cents")


def overdraft_runs(days: DataFrame) -> DataFrame:
    """days (business_id, date, eod) to the current and the longest run of negative days, kept as state of two counters a business. A batch's days follow those before it."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, best = state.get if state.exists else (0, 0)
        days_here = pd.concat(list(frames)).sort_values("date")
        for negative in days_here["eod"].to_numpy() < 0:
            run = run + 1 if negative else 0
            best = max(best, run)
        state.update((run, best))
        yield pd.DataFrame({"business_id": [key[0]], "through": [days_here["date"].iloc[-1]], "run": [run], "longest": [best]})

    return days.groupBy("business_id").applyInPandasWithState(update, "business_id long, through date, run int, longest int", "run int, longest int", "append", GroupStateTimeout.NoTimeout)


def trailing_totals(feed: DataFrame, days: int = 90, late: str = "2 days") -> DataFrame:
    """Totals of a business over each window of some days that ends with a day: a sliding window by one day."""
    w = feed.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), "business_id")
    t = w.agg(F.expr("sum(if(direction = 'in', cents, 0))").alias("inflow"), F.expr("sum(if(direction = 'out', cents, 0))").alias("outflow"), F.count("*").alias("n"))
    return t.select("business_id", F.date_sub(F.to_date("w.end"), 1).alias("through"), "inflow", "outflow", "n")


def break_signals(days: DataFrame, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """days (business_id, date, inflow, mean, sd) to the last day on which a two-sided CUSUM of inflow signalled, kept as two sums a business. A batch's days follow those before it."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, last = state.get if state.exists else (0.0, 0.0, None)
        days_here = pd.concat(list(frames)).sort_values("date")
        for r in days_here.itertuples():
            z = (r.inflow - r.mean) / r.sd if r.sd else 0.0
            up, down = max(0.0, up + z - k), max(0.0, down - z - k)
            if up > h or down > h:
                up, down, last = 0.0, 0.0, r.date
        state.update((up, down, last))
        yield pd.DataFrame({"business_id": [key[0]], "through": [days_here["date"].iloc[-1]], "last_signal": [last]})

    return days.groupBy("business_id").applyInPandasWithState(update, "business_id long, through date, last_signal date", "up double, down double, last date", "append", GroupStateTimeout.NoTimeout)
