"""The profile as of earlier dates, from panes: one mergeable state a business and 30 days, combined into every window.

A pane's state holds what two neighbours need to become one: counts and sums, sums of squares and products (of whole cents as
decimals, so that they are exact and a constant series has no variance), first and last days of inflow, heads and tails of overdraft runs, the first and last
seven net flows for the lagged products, the least balance, and its days in order for the two recursive features. merge()
is associative; a trailing window is the fold of three panes, the window before it the sum of three older ones. Days are
read once, by the exchange on business_id that the running balance needs anyway; no row is copied for a point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import features_of

STEP, POINTS, LAG, PANES = 30, 12, 7, 3
_BIG = "decimal(38, 0)"


def _squares(a: str, b: str | None = None) -> str:
    """SQL of the exact product of two amounts in cents."""
    return f"cast({a} as decimal(18, 0)) * cast({b or a} as decimal(18, 0))"


#: Sums that two panes add.
_SUMS = {
    "n": "count(*)", "active": "count_if(inflow_count + outflow_count > 0)", "sum_in": "sum(inflow)", "sum_out": "sum(outflow)", "sum_rec": "sum(recurring)",
    "cnt_in": "sum(inflow_count)", "cnt_out": "sum(outflow_count)", "in_days": "count_if(inflow_count > 0)", "negative": "count_if(eod < 0)", "sum_eod": "sum(eod)", "sum_net": "sum(net)",
    "n_op": "count_if(not weekend)", "gaps_op": "count_if(not weekend and inflow_count + outflow_count = 0)",
    "down2": f"sum(if(net < 0, {_squares('net')}, 0BD))", "up2": f"sum(if(net > 0, {_squares('net')}, 0BD))", "in2": f"sum({_squares('inflow')})",
    "gap_n": "count(gap)", "gap1": "coalesce(sum(gap), 0)", "gap2": "coalesce(sum(gap * gap), 0)", "islands": "count_if(eod < 0 and (off = 0 or not before < 0))",
    "lag_n": "count(net7)", "x1": "coalesce(sum(if(net7 is null, null, net)), 0L)", "y1": "coalesce(sum(net7), 0L)",
    **{k: f"coalesce(sum({e}), cast(0 as {_BIG}))" for k, e in {"x2": f"if(net7 is null, null, {_squares('net')})", "y2": _squares("net7"), "xy": _squares("net", "net7")}.items()},
}
#: What else a pane keeps: bounds, ends and its days.
_ENDS = {
    "eod_min": "min(eod)", "eod_last": "max_by(eod, date)", "slope": f"try_divide(double(count(*) * sum({_squares('eod', 'off')}) - sum(off) * cast(sum(eod) as decimal(18, 0))), double(count(*) * sum(off * off) - sum(off) * sum(off)))", "net30": "avg(net)", "first_in": "min(if(inflow_count > 0, pos, null))", "last_in": "max(if(inflow_count > 0, pos, null))",
    "days": "array_sort(collect_list(struct(date, inflow, outflow, recurring, net, eod)))",
}


def panes(daily: DataFrame) -> DataFrame:
    """One row for each business and 30 days before its as-of date (pane 0 ends on it): the state as one struct. Every day of the operating period has a row, as in L.daily."""
    own = "over (partition by business_id order by date)"
    d = daily.withColumn("pos", F.expr(f"row_number() {own}")).withColumns({
        "pane": F.expr(f"cast(dbe div {STEP} as int)"), "off": F.expr(f"{STEP - 1} - dbe % {STEP}"),
        "before": F.expr(f"coalesce(lag(eod) {own}, 0)"), "weekend": F.expr("if(data_source = 'external_real', weekday(date) in (5, 6), weekday(date) in (4, 5))"),
        "net7": F.expr(f"lag(net, {LAG}) {own}"), "seen": F.expr("last(if(inflow_count > 0, pos, null), true) over (partition by business_id order by date rows between unbounded preceding and 1 preceding)"),
    })
    d = d.withColumns({"net7": F.expr(f"if(off >= {LAG}, net7, null)"), "gap": F.expr("if(inflow_count > 0 and pos - seen <= off, pos - seen, null)")})
    p = d.groupBy("business_id", "window_end", "data_source", "pane").agg(*(F.expr(e).alias(k) for k, e in {**_SUMS, **_ENDS}.items()))
    runs = "aggregate(days, named_struct('all', 0, 'head', 0, 'run', 0, 'best', 0), (a, x) -> named_struct('all', a.all + 1, 'head', if(x.eod < 0 and a.head = a.all, a.head + 1, a.head), 'run', if(x.eod < 0, a.run + 1, 0), 'best', greatest(a.best, if(x.eod < 0, a.run + 1, 0))))"
    p = p.withColumn("runs", F.expr(runs)).withColumns({
        "len": F.expr("cast(n as int)"), "head": F.col("runs.head"), "tail": F.col("runs.run"), "best": F.col("runs.best"),
        "first_nets": F.expr(f"transform(slice(days, 1, {LAG}), x -> x.net)"), "last_nets": F.expr(f"transform(slice(days, greatest(size(days) - {LAG - 1}, 1), {LAG}), x -> x.net)"),
    }).drop("runs")
    keys = ["business_id", "window_end", "data_source", "pane"]
    return p.select(*keys, F.struct(*(c for c in p.columns if c not in keys)).alias("s"))


def merge(a: str, b: str) -> str:
    """SQL of the state of an older and a newer neighbour together."""
    cross = f"zip_with({a}.last_nets, {b}.first_nets, (u, v) -> named_struct('u', u, 'v', v))"
    fold = lambda e: f"aggregate({cross}, cast(0 as {_BIG}), (t, p) -> cast(t + {e} as {_BIG}))"
    total = lambda names: f"aggregate({names}, 0L, (t, x) -> t + x)"
    between = f"({b}.first_in - {a}.last_in)"  # null unless both have a day of inflow
    more = {
        "gap_n": f"if({between} is null, 0, 1)", "gap1": f"coalesce({between}, 0)", "gap2": f"coalesce({between} * {between}, 0)", "islands": f"- if({a}.tail > 0 and {b}.head > 0, 1, 0)",
        "lag_n": f"{LAG}", "x1": total(f"{b}.first_nets"), "y1": total(f"{a}.last_nets"), "x2": fold(_squares("p.v")), "y2": fold(_squares("p.u")), "xy": fold(_squares("p.u", "p.v")),
    }
    out = {k: f"{a}.{k} + {b}.{k}" + (f" + {more[k]}" if k in more else "") for k in _SUMS}
    out |= {
        "eod_min": f"least({a}.eod_min, {b}.eod_min)", "eod_last": f"{b}.eod_last", "slope": f"{b}.slope", "net30": f"{b}.net30", "first_in": f"coalesce({a}.first_in, {b}.first_in)", "last_in": f"coalesce({b}.last_in, {a}.last_in)",
        "days": f"concat({a}.days, {b}.days)", "len": f"{a}.len + {b}.len", "head": f"if({a}.head = {a}.len, {a}.len + {b}.head, {a}.head)", "tail": f"if({b}.tail = {b}.len, {b}.len + {a}.tail, {b}.tail)",
        "best": f"greatest({a}.best, {b}.best, {a}.tail + {b}.head)", "first_nets": f"{a}.first_nets", "last_nets": f"{b}.last_nets",
    }
    return "named_struct(" + ", ".join(f"'{k}', {e}" for k, e in out.items()) + ")"


def window_stats(panes_: DataFrame, points: int = POINTS) -> DataFrame:
    """The statistics of profile.daily_stats for every as-of date whose whole trailing window lies in the data, with its last day as window_end and the runs already merged."""
    order = "partition by business_id order by pane desc"
    p = panes_.withColumns({
        "held": F.expr(f"collect_list(s) over ({order} rows between {PANES - 1} preceding and current row)"), "history_days": F.expr(f"sum(s.n) over ({order} rows unbounded preceding)"),
        **{f"prior_{k}": F.expr(f"coalesce(sum(s.{k}) over ({order} rows between {2 * PANES - 1} preceding and {PANES} preceding), 0)") for k in ("n", "sum_in", "sum_out", "in2")},
    }).where(f"pane < {points} and size(held) = {PANES}")
    p = p.withColumn("w", F.expr(f"aggregate(slice(held, 2, {PANES - 1}), held[0], (a, x) -> {merge('a', 'x')})")).where(f"w.n = {PANES * STEP}")
    big = lambda e: f"cast({e} as {_BIG})"
    spread = lambda n, s1, s2, t1=None: f"double({big(s2)} * {n} - {big(s1)} * {big(t1 or s1)})"
    sd = lambda *of: f"sqrt({spread(*of)}) / {of[0]}"
    sums = {k: f"w.{k}" for k in ("n", "sum_in", "sum_out", "sum_rec", "cnt_in", "cnt_out", "in_days", "negative", "islands", "eod_min", "eod_last", "net30", "slope", "n_op", "gaps_op", "days")}
    sums |= {k: f"double(w.{k}) / 10000.0D" for k in ("down2", "up2")}
    return p.select(
        "business_id", F.expr(f"date_sub(window_end, pane * {STEP})").alias("window_end"), "data_source", "history_days", *(F.expr(e).alias(k) for k, e in sums.items()),
        F.col("prior_n").alias("n_prior"), F.expr("w.active").alias("coverage_days_90d"), F.col("prior_sum_in").alias("prior_in"), F.col("prior_sum_out").alias("prior_out"),
        F.expr("try_divide(prior_sum_in, prior_n)").alias("prior_mean"), F.expr(f"if(prior_n > 0, {sd('prior_n', 'prior_sum_in', 'prior_in2')}, null)").alias("prior_sd"),
        F.expr("try_divide(w.gap1, w.gap_n)").alias("gap_mean"), F.expr(f"if(w.gap_n > 0, {sd('w.gap_n', 'w.gap1', 'w.gap2')}, null)").alias("gap_sd"),
        F.expr(sd("w.n", "w.sum_net", "w.down2 + w.up2")).alias("net_sd"), F.expr("w.sum_eod / w.n").alias("eod_mean"),
        F.expr(f"try_divide({spread('w.lag_n', 'w.x1', 'w.xy', 'w.y1')}, sqrt({spread('w.lag_n', 'w.x1', 'w.x2')}) * sqrt({spread('w.lag_n', 'w.y1', 'w.y2')}))").alias("autocorr"), F.expr("w.lag_n").alias("pairs7"), F.expr("w.best").alias("longest"),
    )


def history(daily: DataFrame, points: int = POINTS) -> DataFrame:
    """The daily features with their reasons as of each business's as-of date and every 30 days before it; dates without enough coverage are left out, as are those whose window isn't whole."""
    return features_of(window_stats(panes(daily), points)).where("status <> 'insufficient_data'").withColumnRenamed("window_end", "as_of")
