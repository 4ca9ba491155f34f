"""Operators of the real-data adapter, the generator and the reports: chains of balances, measured frequencies, thinning, pairs in a band, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def balance_chain(daily: DataFrame) -> DataFrame:
    """(business_id, pairs, broken, worst): consecutive days whose closing balance differs from the one before and the day's net flow."""
    prev = F.expr("lag(struct(date, eod)) over (partition by business_id order by date)")
    d = daily.withColumn("prev", prev).where("prev.date = date_sub(date, 1)").withColumn("residual", F.expr("abs(eod - prev.eod - net)"))
    return d.groupBy("business_id").agg(F.count("*").alias("pairs"), F.expr("count_if(residual <> 0)").alias("broken"), F.max("residual").alias("worst"))


def filled_balances(daily: DataFrame) -> DataFrame:
    """Closing balances where only days with movement are verified: carried forward, and the opening balance before the first."""
    known = "last(if(inflow_count + outflow_count > 0, eod, null), true) over (partition by business_id order by date rows unbounded preceding)"
    return daily.select("business_id", "date", F.expr(f"coalesce({known}, opening_cents)").alias("balance"), F.expr("inflow_count + outflow_count > 0").alias("verified"))


def frequencies(tx: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, executions, median_gap, frequency): the class of the median gap between a series' dates; two dates at least."""
    part = ", ".join(keys)
    days = tx.select(*keys, "date").distinct().withColumn("gap", F.expr(f"datediff(date, lag(date) over (partition by {part} order by date))"))
    g = days.groupBy(*keys).agg(F.count("*").alias("executions"), F.expr("median(gap)").alias("median_gap")).where("executions >= 2")
    kind = "case when median_gap between 25 and 35 then 'monthly' when median_gap between 5 and 9 then 'weekly' when median_gap between 80 and 100 then 'quarterly' else 'unknown' end"
    return g.withColumn("frequency", F.expr(kind))


def held_days(daily: DataFrame) -> DataFrame:
    """(business_id, balance days): how long each balance stood, the opening one from the first day on, up to the next change or the window's end."""
    stands = daily.withColumn("place", F.expr("row_number() over (partition by business_id order by date)")).where("place = 1 or net <> 0")
    nxt = "coalesce(lead(date) over (partition by business_id order by date), date_add(window_end, 1))"
    return stands.withColumn("days", F.expr(f"datediff({nxt}, date)")).groupBy("business_id").agg(F.expr("count_if(net <> 0)").alias("changes"), F.sum("days").alias("days_held"), F.max("days").alias("longest"))


def band_pairs(tx: DataFrame, amount: Column, days: int) -> DataFrame:
    """Opposite movements of an equal amount inside a business, up to some days apart: an equi-join on business, amount and day block, each outflow meeting the two blocks its band touches."""
    t = tx.select("business_id", "transaction_id", "date", "direction", amount.alias("amount")).withColumn("day", F.expr("datediff(date, date'1970-01-01')"))
    width = 2 * days + 1
    out = t.where("direction = 'out'").withColumn("block", F.explode(F.array_distinct(F.array(F.expr(f"(day - {days}) div {width}"), F.expr(f"(day + {days}) div {width}")))))
    inn = t.where("direction = 'in'").withColumn("block", F.expr(f"day div {width}"))
    o, i = out.alias("o"), inn.alias("i")
    met = o.join(i, ["business_id", "amount", "block"]).where(f"abs(o.day - i.day) <= {days}")
    return met.select("business_id", F.col("o.transaction_id").alias("out_id"), F.col("i.transaction_id").alias("in_id"))


def thinned(tx: DataFrame, keep_one_in: int) -> DataFrame:
    """A sample of inflows by a hash of the id, weighted by its inverse rate; outflows stay."""
    pick = F.expr(f"direction = 'out' or conv(substring(md5(cast(transaction_id as string)), 1, 4), 16, 10) % {keep_one_in} = 0")
    return tx.where(pick).withColumn("sample_weight", F.expr(f"if(direction = 'in', {keep_one_in}.0D, 1.0D)"))


def counterparty_windows(clipped: DataFrame) -> DataFrame:
    """(business_id, counterparty_id, six totals): what thinning must not change, taken before it."""
    cut = lambda d, lo, hi: F.expr(f"sum(if(direction = '{d}' and dbe between {lo} and {hi}, cents, 0))").alias(f"{d}_d{lo}_{hi}")
    return clipped.where("counterparty_id is not null").groupBy("business_id", "counterparty_id").agg(*(cut(d, lo, hi) for d in ("in", "out") for lo, hi in ((0, 29), (30, 89), (90, 179))))


def windows_as_rows(windows: DataFrame) -> DataFrame:
    """Window totals as ledger rows dated at the window's near edge, so that counterparty features read them like transactions."""
    names = [c for c in windows.columns if c.startswith(("in_", "out_"))]
    long = windows.unpivot(["business_id", "counterparty_id"], names, "w", "cents").where("cents > 0")
    return long.select("business_id", "counterparty_id", F.expr("split(w, '_')[0]").alias("direction"), F.expr("cast(substring(split(w, '_')[1], 2) as int)").alias("dbe"), "cents")


def receipt(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, receipt): SHA-256 of a row's values as canonical text, nulls marked."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in names))
    return df.select(key, F.sha2(text, 256).alias("receipt"))


def page(df: DataFrame, key: str, id_prefix: str = "", offset: int = 0, limit: int = 50, **equal: object) -> DataFrame:
    """A page of df in the key's order: rows whose key's text starts with id_prefix and whose columns have the given values. An empty prefix takes all; a null key never matches one."""
    rows = df.where(F.col(key).cast("string").startswith(id_prefix)) if id_prefix else df
    for column, value in equal.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(key).offset(offset).limit(limit)
