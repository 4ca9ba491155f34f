"""Cash-flow projection: methods over each business's last 90 days, path minima at horizons, and the shortage alert.

Flat methods (naive30, naive90, blend, ewma) are window averages; structural adds weekday effects and repeats recurring
payments; ols_damped takes the weekday means away, fits one slope to what is left, and damps it ahead. Hazards replay
blocks of past days in an order that a hash draws. Everything is aggregates and folds over arrays of 90 days at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extensions import Methods

HORIZONS, HALF_LIFE, DAMPING, MIN_DAYS = (30, 60, 90), 21.0, 0.5, 30


def flat_rates(daily: DataFrame) -> DataFrame:
    """(business_id, method, rate, balance): the flat methods' daily net flow in cents."""
    ages = "pow(0.5D, dbe / 21.0D)"
    rates = {"naive30": "avg(if(dbe < 30, net, null))", "naive90": "avg(if(dbe < 90, net, null))", "ewma": f"sum(if(dbe < 90, net * {ages}, 0)) / sum(if(dbe < 90, {ages}, 0))"}
    d = daily.groupBy("business_id").agg(F.count("*").alias("days"), F.expr("max_by(eod, date)").alias("balance"), *(F.expr(e).alias(k) for k, e in rates.items())).where(f"days >= {MIN_DAYS}")
    d = d.withColumn("blend", F.expr("0.5D * naive30 + 0.5D * naive90"))
    return d.unpivot(["business_id", "balance"], ["naive30", "naive90", "blend", "ewma"], "method", "rate")


def flat_paths(rates: DataFrame, horizons=HORIZONS) -> DataFrame:
    """A row for each method and horizon: projected net flow, balance and minimum. A flat path's minimum is at one of its ends."""
    p = rates.withColumn("horizon_days", F.explode(F.array(*map(F.lit, horizons))))
    return p.select("business_id", "method", "horizon_days", (F.col("rate") * F.col("horizon_days")).alias("flow"), (F.col("balance") + F.col("rate") * F.col("horizon_days")).alias("end"), (F.col("balance") + F.least(F.col("rate"), F.col("rate") * F.col("horizon_days"))).alias("low"))


def structural_path(daily: DataFrame, horizon: int = 90) -> DataFrame:
    """(business_id, day, net): level of the last 30 days plus weekday effects of the last 90, less recurring payments repeated every 30 days."""
    d = daily.where("dbe < 90").withColumn("plain", F.expr("net + recurring"))
    level = d.groupBy("business_id", "window_end").agg(F.expr("avg(if(dbe < 30, plain, null))").alias("level"), F.avg("plain").alias("mean"), F.expr("max_by(eod, date)").alias("balance"), F.expr("transform(array_sort(collect_list(if(dbe < 30, struct(date, recurring), null))), x -> x.recurring)").alias("past"))
    dow = d.groupBy("business_id", F.weekday("date").alias("dow")).agg(F.avg("plain").alias("dow_mean"))
    # the days ahead repeat the recurring outflows of the last 30 days, or of as many as there are, the oldest first
    ahead = level.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("recurring", F.expr("past[(day - 1) % size(past)]")).withColumn("dow", F.expr("weekday(date_add(window_end, day))"))
    out = ahead.join(dow, ["business_id", "dow"], "left")
    return out.select("business_id", "day", "balance", F.expr("level + coalesce(dow_mean - mean, 0) - recurring").alias("net"))


def ols_damped_path(daily: DataFrame, horizon: int = 90, damping: float = DAMPING) -> DataFrame:
    """(business_id, day, balance, net) of a least-squares trend and weekday effects over the last 90 days, the trend damped ahead.

    Least squares on a trend and a level for each weekday is the slope between what deviates from the weekdays' own means
    (sums of products by weekday, then by business), through each weekday's mean point.
    """
    d = daily.where("dbe < 90").select("business_id", "window_end", "date", "net", "eod", (-F.col("dbe")).cast("double").alias("t"), F.weekday("date").alias("dow"))
    points = d.groupBy("business_id", "window_end", "dow").agg(
        F.count("*").alias("n"), F.avg("t").alias("t0"), F.avg("net").alias("y0"), F.expr("covar_pop(t, net) * count(*)").alias("ty"), F.expr("var_pop(t) * count(*)").alias("tt"), F.expr("max_by(eod, date)").alias("eod"), F.max("date").alias("last"))
    fit = points.groupBy("business_id", "window_end").agg(F.expr("coalesce(try_divide(sum(ty), sum(tt)), 0.0D)").alias("slope"), F.expr("max_by(eod, last)").alias("balance"), F.sum("n").alias("days"), F.expr("map_from_entries(collect_list(struct(dow, struct(t0, y0))))").alias("at")).where(f"days >= {MIN_DAYS}")
    ahead = fit.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("p", F.expr("at[weekday(date_add(window_end, day))]"))
    return ahead.select("business_id", "day", "balance", F.expr(f"coalesce(p.y0, 0.0D) + slope * ({damping}D * day - coalesce(p.t0, 0.0D))").alias("net"))


#: Methods that give a path day by day: daily to (business_id, day, balance, net). add() puts one beside them in forecast_selection.
PATHS = Methods({"structural": structural_path, "ols_damped": ols_damped_path})


def path_summary(path: DataFrame, horizons=HORIZONS) -> DataFrame:
    """A row for each business and horizon of a day-by-day path: net flow, balance, minimum and the first day below zero."""
    p = path.withColumn("at", F.expr("balance + sum(net) over (partition by business_id order by day rows unbounded preceding)"))
    p = p.withColumn("horizon_days", F.explode(F.array(*map(F.lit, horizons)))).where("day <= horizon_days")
    return p.groupBy("business_id", "horizon_days").agg(F.sum("net").alias("flow"), F.expr("max_by(at, day)").alias("end"), F.min("at").alias("low"), F.expr("min(if(at < 0, day, null))").alias("first_below"))


def alert(rates: DataFrame, hazard: DataFrame, method: str = "naive90", alert_at: float = 0.5, watch_at: float = 0.2) -> DataFrame:
    """(business_id, first_below, level): crunch, watch or none, from the flat path's first day below zero and the hazards."""
    r = rates.where(F.col("method") == method).join(hazard, "business_id", "left")
    first = F.expr("case when balance + rate < 0 then 1 when rate < 0 and balance + 90 * rate < 0 then if(balance + floor(balance / -rate) * rate < 0, floor(balance / -rate), floor(balance / -rate) + 1) end")
    r = r.withColumn("first_below", first.cast("int"))
    level = F.expr(f"case when first_below <= 30 or coalesce(hazard_30d, 0) >= {alert_at} then 'crunch' when first_below is not null or coalesce(hazard_30d, 0) >= {watch_at} or coalesce(hazard_90d, 0) >= {alert_at} then 'watch' else 'none' end")
    return r.select("business_id", "first_below", level.alias("level"))


def hazard(daily: DataFrame, seed: int = 0, sims: int = 500, block: int = 7) -> DataFrame:
    """(business_id, hazard_30d, hazard_60d, hazard_90d): the share of replayed paths below zero within each horizon.

    A path joins blocks of consecutive past days from today's balance; a hash of seed, business and path draws where
    each begins. Every possible block is summed once for its length and its lowest points, so a path costs a step a block.
    """
    d = daily.where("dbe < 90").groupBy("business_id").agg(F.expr("transform(array_sort(collect_list(struct(date, net))), x -> x.net)").alias("nets"), F.expr("max_by(eod, date)").alias("balance"))
    return hazard_of(d, seed, sims, block)


def hazard_of(d: DataFrame, seed: int = 0, sims: int = 500, block: int = 7) -> DataFrame:
    """hazard() from (business_id, nets, balance): each business's last net flows in order, 90 at most, and its balance."""
    steps = -(-max(HORIZONS) // block)
    tail = {h: h - block * (-(-h // block) - 1) for h in HORIZONS}  # days of a horizon's last block
    lows = ", ".join(f"'l{n}', if(k < {n}, least(a.l{n}, a.s + nets[least(i + k, size(nets) - 1)]), a.l{n})" for n in sorted({*tail.values(), block}))
    start = "named_struct('s', 0L, " + ", ".join(f"'l{n}', 9223372036854775807L" for n in sorted({*tail.values(), block})) + ")"
    # a row a business is little to ship and much to work on: a fixed number of partitions keeps it from being coalesced
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "business_id")
    d = d.withColumn("m", F.expr(f"greatest(size(nets) - {block}, 1)"))
    d = d.withColumn("blocks", F.expr(f"transform(sequence(0, m - 1), i -> aggregate(sequence(0, {block - 1}), {start}, (a, k) -> named_struct('s', a.s + nets[least(i + k, size(nets) - 1)], {lows})))"))
    d = d.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    # 16 bits of the path's hash for each of up to 16 blocks
    d = d.withColumn("hash", F.expr(f"sha2(concat_ws('|', '{seed}', business_id, sim), 256)"))
    pick = "blocks[cast(conv(substring(hash, 1 + 4 * j, 4), 16, 10) as int) % m]"
    d = d.withColumn("drawn", F.expr(f"transform(sequence(0, {steps - 1}), j -> {pick})"))
    first = "named_struct('j', 0, 'at', balance, 'low', 9223372036854775807L, " + ", ".join(f"'h{h}', 9223372036854775807L" for h in HORIZONS) + ")"
    seen = ", ".join(f"'h{h}', if(a.j = {-(-h // block) - 1}, least(a.low, a.at + e.l{tail[h]}), a.h{h})" for h in HORIZONS)
    d = d.withColumn("path", F.expr(f"aggregate(drawn, {first}, (a, e) -> named_struct('j', a.j + 1, 'at', a.at + e.s, 'low', least(a.low, a.at + e.l{block}), {seen}))"))
    return d.groupBy("business_id").agg(*(F.expr(f"avg(if(path.h{h} < 0, 1.0D, 0.0D))").alias(f"hazard_{h}d") for h in HORIZONS))
