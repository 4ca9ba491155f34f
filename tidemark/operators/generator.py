"""A generator of businesses and their ledgers in DataFrame expressions: every draw is an inverse distribution function of an md5 of seed, purpose and ids, so a business is the same whatever else is generated.

Latent traits are Beta(2, 5), the second least of six uniforms; a logistic of them draws the label, and observables mix them
with noise at a correlation. Daily rates follow a first-order autoregression on a log scale (a running sum of noise over
powers of its coefficient), counts are Poisson, amounts lognormal, and customers share a business by a flat Dirichlet law.
Rent, payroll and a loan fall on days of the month. Scenarios overlay rates, costs and a shock, inside bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, DAYS, SEED = "2024-01-01", 90, "g1"
SECTORS, SECTOR_SHARES = ("construction", "professional_services", "food_beverage", "retail_trade"), (0.30, 0.50, 0.75, 1.0)
SIZES, SIZE_SHARES, SIZE_RATES = ("small", "medium", "large"), (0.60, 0.90, 1.0), (1.0, 2.0, 4.0)
TRAIT_MEAN, TRAIT_SD, RHO, BANDS = 2 / 7, 0.15971914124998499, 0.6, (-0.8416, -0.2533, 0.2533, 0.8416)
PHI, SIGMA, CUSTOMERS, MOST = 0.8, 0.15, 8, 60
#: The overlays: allowed keys with their bounds, and the library.
BOUNDS = {"rate": (0.2, 3.0), "cost": (0.2, 3.0), "shock": (0.0, 2.0), "shock_from": (0, DAYS - 1), "shock_days": (0, DAYS)}
BASELINE = {"rate": 1.0, "cost": 1.0, "shock": 1.0, "shock_from": 0, "shock_days": 0}
LIBRARY = {"baseline": {}, "slow_sales": {"rate": 0.7}, "dear_inputs": {"cost": 1.4}, "closed_month": {"shock": 0.1, "shock_from": 30, "shock_days": 30}}


def uniform(seed: str, what: str, *keys: str) -> Column:
    """A uniform number in (0, 1)."""
    text = F.concat_ws("|", F.lit(seed), F.lit(what), *(F.col(k).cast("string") for k in keys))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(seed: str, what: str, *keys: str) -> Column:
    """A standard normal number, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(seed, what + "1", *keys))) * F.cos(6.283185307179586 * uniform(seed, what + "2", *keys))


def picked(u: Column, names: tuple, shares: tuple) -> Column:
    """The first name whose cumulative share reaches u."""
    return F.coalesce(*(F.when(u <= s, F.lit(n)) for n, s in zip(names, shares)))


def businesses(ids: DataFrame, seed: str = SEED, rho: float = RHO) -> DataFrame:
    """(business_id, sector, size, rate, age_days, resilience, discipline, pd, label, resilience_band, discipline_band) for ids (business_id)."""
    b = ids.select("business_id").withColumn("sector", picked(uniform(seed, "sector", "business_id"), SECTORS, SECTOR_SHARES)).withColumn("_z", uniform(seed, "size", "business_id"))
    b = b.withColumn("size", picked(F.col("_z"), SIZES, SIZE_SHARES)).withColumn("rate", picked(F.col("_z"), SIZE_RATES, SIZE_SHARES)).withColumn("age_days", (60 + F.floor(1940 * uniform(seed, "age", "business_id"))).cast("int"))
    for t in ("resilience", "discipline"):
        b = b.withColumn(t, F.sort_array(F.array(*(uniform(seed, f"{t}{k}", "business_id") for k in range(6))))[1])
    logit = -2.0 - 1.2 * (F.col("resilience") - TRAIT_MEAN) / TRAIT_SD - 0.8 * (F.col("discipline") - TRAIT_MEAN) / TRAIT_SD
    b = b.withColumn("pd", 1 / (1 + F.exp(-logit))).withColumn("label", (uniform(seed, "label", "business_id") < F.col("pd")).cast("int"))
    for t in ("resilience", "discipline"):
        x = rho * (F.col(t) - TRAIT_MEAN) / TRAIT_SD + (1 - rho * rho) ** 0.5 * normal(seed, f"{t}_seen", "business_id")
        b = b.withColumn(f"{t}_band", sum(((x > c).cast("int") for c in BANDS), F.lit(0)))
    return b.drop("_z")


def overlays(scenarios: dict[str, dict] = LIBRARY) -> list[dict]:
    """The scenarios' settings over the baseline; a key that isn't allowed or a value out of bounds raises ValueError."""
    out = []
    for name, given in scenarios.items():
        for k, v in given.items():
            if k not in BOUNDS or not BOUNDS[k][0] <= v <= BOUNDS[k][1]:
                raise ValueError(f"{name}: {k} = {v} is not allowed")
        out.append({"scenario": name, **BASELINE, **given})
    return out


def rates(b: DataFrame, scenarios: list[dict], days: int = DAYS, seed: str = SEED) -> DataFrame:
    """(scenario, cost, business_id, day, date, rate, count): each day's Poisson count at a rate of the business, its own drift, the weekday and the scenario."""
    own = F.array(*(F.struct(*(F.lit(float(v) if k in ("rate", "cost", "shock") else v).alias(f"s_{k}") for k, v in s.items())) for s in scenarios))
    d = b.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("date", F.expr(f"date_add(date'{START}', day)"))
    d = d.withColumn("_e", SIGMA * normal(seed, "drift", "business_id", "day") * F.pow(F.lit(PHI), -F.col("day")))
    d = d.withColumn("_x", F.expr(f"sum(_e) over (partition by business_id order by day rows unbounded preceding) * pow({PHI}D, day)"))
    d = d.select("*", F.inline(own))
    shock = F.expr("if(day >= s_shock_from and day < s_shock_from + s_shock_days, s_shock, 1.0D)")
    d = d.withColumn("lam", F.col("rate") * 1.5 * F.exp("_x") * F.expr("if(weekday(date) in (4, 5), 0.6D, 1.0D)") * F.col("s_rate") * shock).withColumn("_u", uniform(seed, "count", "business_id", "day"))
    count = F.expr(f"aggregate(sequence(1, {MOST}), named_struct('p', exp(-lam), 'c', exp(-lam), 'n', if(_u > exp(-lam), 1, 0)), (a, k) -> named_struct('p', a.p * lam / k, 'c', a.c + a.p * lam / k, 'n', a.n + if(_u > a.c + a.p * lam / k, 1, 0)), a -> a.n)")
    return d.withColumn("count", count).select(F.col("s_scenario").alias("scenario"), F.col("s_cost").alias("cost"), "business_id", "rate", "day", "date", "lam", "count")


def receipts(r: DataFrame, seed: str = SEED) -> DataFrame:
    """(scenario, business_id, day, k, customer, amount): the sales of each day, whole amounts."""
    # no filter on count: pushed below its projection it would draw the count's md5 again at each of the MOST steps
    t = r.withColumn("k", F.explode(F.expr(f"slice(sequence(1, {MOST}), 1, count)")))
    weights = F.transform(F.sequence(F.lit(1), F.lit(CUSTOMERS)), lambda c: -F.log((F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("share"), F.col("business_id").cast("string"), c.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0))
    t = t.withColumn("_w", weights).withColumn("_u", uniform(seed, "customer", "business_id", "day", "k"))
    least = "aggregate(_w, named_struct('c', 0.0D, 'n', 1), (a, w) -> named_struct('c', a.c + w, 'n', a.n + if(a.c + w < _u * aggregate(_w, 0.0D, (s, x) -> s + x), 1, 0)), a -> a.n)"
    t = t.withColumn("customer", F.expr(least)).withColumn("amount", F.round(F.exp(4.0 + 0.5 * normal(seed, "amount", "business_id", "day", "k"))).cast("long"))
    return t.select("scenario", "business_id", "day", "k", "customer", "amount")


def payments(r: DataFrame, seed: str = SEED) -> DataFrame:
    """(scenario, business_id, day, amount, recurring): daily costs, and rent, payroll and a loan on days 1, 27 and 5 of a month."""
    dom = F.dayofmonth("date")
    recurring = F.when(dom == 1, 600).when(dom == 27, 900).when(dom == 5, 300).otherwise(0) * F.col("rate")
    varying = F.round(F.col("cost") * 55 * F.col("rate") * (0.5 + uniform(seed, "costs", "business_id", "day")))
    return r.select("scenario", "business_id", "day", (varying + recurring).cast("long").alias("amount"), recurring.cast("long").alias("recurring"))


def daily(r: DataFrame, seed: str = SEED) -> DataFrame:
    """(scenario, business_id, day, inflow, outflow, recurring, net): sales and payments by day, summed as one stream, so that no side of a join is broadcast whatever the estimate of exploded rows."""
    keys, none = ["scenario", "business_id", "day"], F.lit(0).cast("long")
    s = receipts(r, seed).select(*keys, none.alias("outflow"), none.alias("recurring"), F.col("amount").alias("inflow"))
    p = payments(r, seed).select(*keys, F.col("amount").alias("outflow"), "recurring", none.alias("inflow"))
    d = p.unionByName(s).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("outflow", "recurring", "inflow")))
    return d.withColumn("net", F.col("inflow") - F.col("outflow"))
