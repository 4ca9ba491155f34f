"""Transaction review: robust amounts, rare hours and categories, new and two-way counterparties, repeats, hard rules and an isolation forest.

Everything but the forest is windows over a business (or its counterparties); medians are exact. scanned() cuts the
ledger to the scan window before. A forest grows from bounded samples, drawn by a hash of tree and row, and scores a
business's rows in parts of about ROWS in different tasks, each of which grows the same trees from the same sample.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import BELOW, TOTAL, positions

REPEAT_MODES = ("off", "window", "exact", "rarity")
ROWS, SAMPLE, BATCH = 20_000, 256, 2048
FOREST = ["amount_z", "hour_rarity", "category_rarity", "new_counterparty", "both_directions", "direction_in"]


def _robust(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Robust z of log_amount in groups: median and 1.4826 MAD, else the deviation, else 1; with the group's size."""
    by = ", ".join(keys)
    df = df.withColumn("_m", F.expr(f"median(log_amount) over (partition by {by})")).withColumn("_a", F.expr("abs(log_amount - _m)"))
    df = df.withColumn("_d", F.expr(f"median(_a) over (partition by {by}) * 1.4826D")).withColumn("_s", F.expr(f"stddev_pop(log_amount) over (partition by {by})"))
    z = F.expr("(log_amount - _m) / coalesce(nullif(_d, 0), nullif(_s, 0), 1.0D)")
    return df.withColumn(out, z).withColumn(f"{out}_n", F.expr(f"count(*) over (partition by {by})")).drop("_m", "_a", "_d", "_s")


def scanned(tx: DataFrame, days: int = 180) -> DataFrame:
    """The rows of the scan window: the days up to each business's last."""
    return dealt(tx, "business_id").withColumn("_last", F.expr("max(date) over (partition by business_id)")).where(F.expr(f"date > date_sub(_last, {days})")).drop("_last")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to all of spark.sql.shuffle.partitions: by a number that is given, so that small exchanges aren't put together into a task a core, whose memory would grow with the table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def features(tx: DataFrame, seasons: list[tuple[str, str]] = (), burn_in: int = 30, band: float = 0.10, least: int = 3) -> DataFrame:
    """tx (business_id, transaction_id, date, hour, direction, cents, counterparty_id, category) with the six features and the recurring flag."""
    t = dealt(tx, "business_id").withColumn("log_amount", F.expr("log1p(greatest(cents, 0) / 100.0D)")).withColumn("direction_in", F.expr("if(direction = 'in', 1, 0)"))
    season = " or ".join(f"date between date'{a}' and date'{b}'" for a, b in seasons) or "false"
    t = t.withColumn("in_season", F.expr(season))
    # every sort of a task holds its rows: the narrowest window comes first, and the wider ones use its order
    t = _robust(t, ["business_id", "direction", "category", "in_season"], "z_sea")
    t = _robust(t, ["business_id", "direction", "category"], "z_cat")
    t = _robust(t, ["business_id", "direction"], "z_dir")
    t = t.withColumn("any_season", F.expr("bool_or(in_season) over (partition by business_id)"))
    t = t.withColumn("amount_z", F.expr("case when any_season and z_sea_n >= 5 then z_sea when z_cat_n >= 5 then z_cat else z_dir end"))
    t = t.withColumn("n", F.expr("count(*) over (partition by business_id)"))
    t = t.withColumn("hour_share", F.expr("count(*) over (partition by business_id, hour) / n"))
    t = t.withColumn("_med", F.expr("median(cents) over (partition by business_id, category, counterparty_id)"))
    t = t.withColumn("_in", F.expr(f"counterparty_id is not null and _med <> 0 and abs(cents / _med - 1) <= {band}D"))
    t = t.withColumn("recurring", F.expr(f"_in and count_if(_in) over (partition by business_id, category, counterparty_id) >= {least}"))
    t = t.withColumn("category_share", F.expr("count(*) over (partition by business_id, category) / n"))
    t = t.withColumn("hour_rarity", F.expr("-ln(hour_share)")).withColumn("category_rarity", F.expr("if(recurring, 0.0D, -ln(category_share))"))
    first = "row_number() over (partition by business_id, counterparty_id order by date, hour, transaction_id) = 1"
    t = t.withColumn("_first", F.expr(first)).withColumn("_start", F.expr("min(date) over (partition by business_id)"))
    t = t.withColumn("new_counterparty", F.expr(f"if(counterparty_id is not null and _first and date >= date_add(_start, {burn_in}), 1, 0)"))
    both = "size(collect_set(direction) over (partition by business_id, counterparty_id)) = 2"
    t = t.withColumn("both_directions", F.expr(f"if(counterparty_id is not null and {both}, 1, 0)"))
    return t.drop("_med", "_in", "_first", "_start", "any_season", "z_dir", "z_cat", "z_sea", "z_dir_n", "z_cat_n", "z_sea_n", "log_amount")


_COUNTERPARTY = ["business_id", "counterparty_id"]


def close_amounts(payments: DataFrame, tolerance: float = 0.01, count: str = "1") -> DataFrame:
    """(business_id, counterparty_id, cents, m, close, above, size): for each distinct positive amount of a counterparty, how many payments have it, how many others lie within the tolerance of it, how many larger ones do not exceed it by more, and how many payments the counterparty has. count: SQL of how many
    payments a row stands for.

    Payments are counted by amount first. Each amount asks for three places in the counterparty's order, the ends of its
    band; what lies before a place comes from ranges and prefix sums (ranks.positions). So no two payments are paired, and
    a counterparty with a million equal payments is one row.
    """
    m = payments.where("cents > 0").groupBy(*_COUNTERPARTY, "cents").agg(F.expr(f"sum(cast({count} as bigint))").alias("m"))
    near = f"abs({{b}} / double({{a}}) - 1) <= {tolerance}D"
    around = lambda centre: f"sequence(cast(floor({centre}) as bigint) - 2, cast(floor({centre}) as bigint) + 3)"
    low = f"get(filter({around(f'cents / (1 + {tolerance}D)')}, x -> x > 0 and {near.format(a='x', b='cents')}), 0)"
    # the last whole amount that passes the test, from a few about the bound, which rounding may shift by one
    last = lambda centre, test: f"array_max(concat(array(cents), filter({around(centre)}, x -> x > 0 and {test})))"
    high, up = last(f"cents / (1 - {tolerance}D)", near.format(a="x", b="cents")), last(f"cents * (1 + {tolerance}D)", near.format(a="cents", b="x"))
    asked = F.expr(f"array(struct(cents as at, 1 as kind, m as w, 'own' as asks), struct({low} as at, 0 as kind, 0L as w, 'low' as asks), struct({high} as at, 2 as kind, 0L as w, 'high' as asks), struct({up} as at, 2 as kind, 0L as w, 'up' as asks))")
    placed = positions(m.select(*_COUNTERPARTY, "cents", "m", F.inline(asked)), _COUNTERPARTY, ["at", "kind"], "w")
    place = lambda k: f"max(if(asks = '{k}', {BELOW}, null))"
    return placed.groupBy(*_COUNTERPARTY, "cents", "m").agg(F.expr(f"{place('high')} - {place('low')} - 1").alias("close"), F.expr(f"{place('up')} - {place('own')} - max(m)").alias("above"), F.max(TOTAL).alias("size"))


def repeats(t: DataFrame, mode: str = "exact", tolerance: float = 0.01, gap: int = 3, rarity: float = 0.01) -> DataFrame:
    """t with repeat_payment: an outflow that repeats an earlier one to the same counterparty, neither recurring.

    window: an amount within the tolerance, up to `gap` days before; exact: the same cents on the same day; rarity: as
    window where close amounts are rare for the counterparty. For window, payments alike in day and amount are one row of
    which all but the first repeat; the first ones meet others by an equi-join on blocks of days and of the amounts'
    logarithms, so only different amounts of a percent and of a few days meet. Amounts of zero or less repeat nothing.
    """
    if mode not in REPEAT_MODES:
        raise ValueError(f"unknown repeat mode {mode!r}")
    if mode == "off":
        return t.withColumn("repeat_payment", F.lit(False))
    columns = t.columns
    t = t.withColumn("_own", F.expr("direction = 'out' and counterparty_id is not null and not recurring"))
    if mode == "exact":
        key = "business_id, counterparty_id, date, cents, _own"
        return t.withColumn("repeat_payment", F.expr(f"_own and row_number() over (partition by {key} order by hour, transaction_id) > 1")).drop("_own")
    own = t.where("_own and cents > 0").withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    alike = [*_COUNTERPARTY, "_day", "cents"]
    first = own.groupBy(*alike).agg(F.min(F.struct("hour", "transaction_id")).alias("_first"))
    block = first.withColumns({"_block": F.expr(f"cast(floor(ln(cents) / {2 * np.log1p(tolerance)}D) as long)"), "_days": F.expr(f"_day div {gap + 1}")})
    spread = block.withColumn("_block", F.explode(F.array(*(F.col("_block") + k for k in (-1, 0, 1))))).withColumn("_days", F.explode(F.array("_days", F.col("_days") + 1)))
    before, after, on = spread.alias("a"), block.alias("b"), [*_COUNTERPARTY, "_block", "_days"]
    met = before.join(after, on).where(f"b._day - a._day between 0 and {gap} and (a._day < b._day or a._first < b._first) and abs(b.cents / double(a.cents) - 1) <= {tolerance}D")
    hit = met.select(*_COUNTERPARTY, F.col("b._day").alias("_day"), F.col("b.cents").alias("cents")).distinct().withColumn("_met", F.lit(True))
    t = t.withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date"))).join(first.join(hit, alike, "left"), alike, "left")
    t = t.withColumn("repeat_payment", F.expr("_own and cents > 0 and coalesce(_met or struct(hour, transaction_id) <> _first, false)"))
    if mode == "rarity":
        pairs = close_amounts(t.where("_own"), tolerance).groupBy(*_COUNTERPARTY).agg(F.expr("try_divide(sum(m * (m - 1) / 2.0D + m * above), max(size) * (max(size) - 1) / 2.0D)").alias("_rate"))
        t = t.join(pairs, _COUNTERPARTY, "left").withColumn("repeat_payment", F.expr(f"repeat_payment and coalesce(_rate < {rarity}D, false)"))
    return t.select(*columns, "repeat_payment")


def rules(t: DataFrame, amount_z: float = 3.0, rare_hour: float = 0.01, new_z: float = 2.0, rare_category: float = 0.01) -> DataFrame:
    """t with the hard rules' hit and the reason that a flag on the row would carry, the most specific first."""
    t = t.withColumn("rule_hit", F.expr(f"amount_z >= {amount_z}D or hour_share < {rare_hour}D or repeat_payment"))
    reason = f"""case when repeat_payment then 'repeat_payment' when amount_z >= {amount_z}D then 'amount_outlier' when new_counterparty = 1 and amount_z >= {new_z}D then 'new_counterparty_large_amount'
      when both_directions = 1 then 'counterparty_both_directions' when hour_share < {rare_hour}D then 'unusual_hour' when not recurring and category_share < {rare_category}D then 'rare_category' else 'multivariate_outlier' end"""
    return t.withColumn("flag_reason", F.expr(reason))


def _expected(k):
    return np.where(k > 2, 2 * (np.log(np.maximum(k - 1, 1)) + 0.5772156649) - 2 * (k - 1) / np.maximum(k, 1), np.where(k == 2, 1.0, 0.0))


@lru_cache(maxsize=12)
def _numbers(trees: int, levels: int, width: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The random numbers of each level's nodes, the same for every forest of this shape: they are drawn once a worker."""
    rng = np.random.default_rng(seed)
    return [(rng.random((trees << k, width)), rng.random(trees << k)) for k in range(levels + 1)]


def grow(x: np.ndarray, drawn: np.ndarray, rng: np.random.Generator | int) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """By level the column, cut, end and depth of each node of the trees over the drawn rows of x (trees x sample), and the depth at which each drawn row ends. All trees grow together; only nodes that hold rows are worked on. rng: a generator, or a seed whose numbers are kept."""
    (trees, m), width = drawn.shape, x.shape[1]
    levels = int(np.ceil(np.log2(max(m, 2))))
    numbers = _numbers(trees, levels, width, rng) if isinstance(rng, int) else None
    at, row = np.repeat(np.arange(trees), m), drawn.ravel()  # by node: where each open row is, and which it is
    place, out, depth = np.arange(trees * m), [], np.empty(trees * m)
    for level in range(levels + 1):
        size = trees << level
        choose, share = numbers[level] if numbers else (rng.random((size, width)), rng.random(size))
        choice, cut, leaf, ends = np.zeros(size, np.int64), np.zeros(size), np.ones(size, bool), np.full(size, float(level))
        out.append((choice, cut, leaf, ends))
        if not len(at):
            continue
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        node, count = at[starts], np.diff(np.append(starts, len(at)))
        alone = np.repeat(count == 1, count)  # a row by itself ends here, as out has it
        depth[place[alone]] = level
        at, row, place, node, count = at[~alone], row[~alone], place[~alone], node[count > 1], count[count > 1]
        if not len(at):
            continue
        starts, values = np.cumsum(count) - count, x[row]
        low = np.minimum.reduceat(values, starts)
        spread = np.maximum.reduceat(values, starts) - low
        choice[node] = which = (choose[node] * (spread > 0)).argmax(axis=1)
        wide, each = spread[np.arange(len(node)), which], np.repeat(np.arange(len(node)), count)
        leaf[node] = ended = (wide <= 0) | (level == levels)
        cut[node] = bound = np.where(ended, 0, low[np.arange(len(node)), which]) + share[node] * wide
        ends[node] = deep = level + _expected(count)
        closed = ended[each]
        depth[place[closed]] = deep[each[closed]]
        kept = ~closed
        right = values[np.arange(len(row)), which[each]] >= bound[each]
        # rows stay in the order of their nodes: the left ones of a node, then its right ones
        at, row, place = (2 * at + right)[kept], row[kept], place[kept]
        order = np.argsort(at, kind="stable")
        at, row, place = at[order], row[order], place[order]
    return out, depth.reshape(trees, m)


def _score(depth: np.ndarray, m: int) -> np.ndarray:
    """Scores from the depths of rows (trees x rows)."""
    return 2 ** (-depth.mean(axis=0) / max(float(_expected(np.array(m))), 1e-9))


def scores_in(forest: list[tuple[np.ndarray, ...]], x: np.ndarray, trees: int, m: int) -> np.ndarray:
    """Isolation scores of rows, higher for easier to isolate: 2 to the minus mean depth over its expectation. Rows go in batches."""
    tree, out = np.arange(trees)[:, None], np.empty(len(x))
    for lo in range(0, len(x), BATCH):
        part = x[lo : lo + BATCH]
        rows, open_, depth = np.zeros((trees, len(part)), np.int64), np.ones((trees, len(part)), bool), np.zeros((trees, len(part)))
        for level, (choice, cut, leaf, ends) in enumerate(forest):
            key = (tree << level) + rows
            ended = open_ & leaf[key]
            depth[ended] = ends[key[ended]]
            open_ &= ~ended
            rows = 2 * rows + (part[np.arange(len(part))[None, :], choice[key]] >= cut[key])
        out[lo : lo + BATCH] = _score(depth, m)
    return out


def isolation_scores(x: np.ndarray, trees: int = 200, sample: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """Isolation scores of the rows of x by trees over samples of them."""
    rng, m = np.random.default_rng(seed), min(sample, len(x))
    drawn = rng.random((trees, len(x))).argsort(axis=1)[:, :m]
    return scores_in(grow(x, drawn, rng)[0], x, trees, m)


@lru_cache(maxsize=4)
def _masks(trees: int, seed: int) -> np.ndarray:
    return np.array([np.random.default_rng([seed, k]).integers(1 << 63, dtype=np.uint64) for k in range(trees)])


def draws(h: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """A number below 1 for each tree and row hash, by which the tree draws its sample."""
    z = h.astype(np.uint64)[None, :] ^ _masks(trees, seed)[:, None]
    for mixer in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(mixer)
    return (z ^ (z >> np.uint64(31))) / 2.0**64


def scored(t: DataFrame, trees: int = 200, seed: int = 0, least: int = 30) -> DataFrame:
    """(business_id, transaction_id, date, hour, rule_hit, flag_reason, score): the rows of businesses with `least` rows or more."""
    kept = ["business_id", "transaction_id", "date", "hour", "rule_hit", "flag_reason"]
    rows = t.select(*kept, *FOREST).withColumn("n", F.expr("count(*) over (partition by business_id)")).where(F.col("n") >= least)
    rows = rows.withColumn("h", F.xxhash64("business_id", "transaction_id")).withColumn("parts", F.expr(f"int(ceil(n / {ROWS}))")).withColumn("part", F.expr("pmod(xxhash64(h), parts)"))

    @F.pandas_udf("boolean")
    def may_be_drawn(h: pd.Series, n: pd.Series) -> pd.Series:
        # eight deviations more than a sample on the whole; the least draws of each tree are taken from these
        share, x = (SAMPLE + 8 * SAMPLE**0.5) / n.to_numpy(), h.to_numpy()
        drawn, some = share >= 1, np.flatnonzero(share < 1)
        for lo in range(0, len(some), BATCH):
            part = some[lo : lo + BATCH]
            drawn[part] = (draws(x[part], trees, seed) < share[part]).any(axis=0)
        return pd.Series(drawn)

    sample = rows.where(may_be_drawn("h", "n")).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1L)")))

    def part_scores(pdf: pd.DataFrame) -> pd.DataFrame:
        sampled = pdf["sampled"].to_numpy(bool)
        pdf, drawn_from = pdf[~sampled], pdf[sampled]
        if not len(pdf):
            return pdf[kept].assign(score=0.0)
        drawn_from = drawn_from.sort_values(["h", *FOREST])
        x, h, m = drawn_from[FOREST].to_numpy(float), drawn_from["h"].to_numpy(), min(SAMPLE, len(drawn_from))
        drawn = np.argsort(draws(h, trees, seed), axis=1, kind="stable")[:, :m]
        forest, ended = grow(x, drawn, seed)
        if m == len(pdf) == len(drawn_from) == pdf["n"].iloc[0]:  # every tree has drawn every row, and knows where it ends
            depth = np.empty((trees, m))
            np.put_along_axis(depth, drawn, ended, axis=1)
            return drawn_from[kept].assign(score=_score(depth, m))
        return pdf[kept].assign(score=scores_in(forest, pdf[FOREST].to_numpy(float), trees, m))

    both = rows.withColumn("part", F.col("part").cast("long")).withColumn("sampled", F.lit(False)).unionByName(sample.withColumn("sampled", F.lit(True)))
    return dealt(both, "business_id", "part").groupBy("business_id", "part").applyInPandas(part_scores, "business_id long, transaction_id long, date date, hour int, rule_hit boolean, flag_reason string, score double")


def detect(t: DataFrame, contamination: float = 0.01, most: int = 10, trees: int = 200, seed: int = 0, least: int = 30) -> DataFrame:
    """(business_id, transaction_id, rank, flag_reason): up to `most` flags a business, rule hits first and then forest outliers, most isolated first. Scores stay inside."""
    s = scored(t, trees, seed, least).withColumn("bound", F.expr(f"percentile(score, {1 - contamination}D) over (partition by business_id)"))
    s = s.where("score > bound or rule_hit").withColumn("rank", F.expr("row_number() over (partition by business_id order by rule_hit desc, score desc, date, hour, transaction_id)"))
    return s.where(F.col("rank") <= most).select("business_id", "transaction_id", "rank", "flag_reason")


#: Planted kinds: days later (least, most), cents as a share (least, most), what changes.
KINDS = {"duplicate_payment": (0, 0, 1.0, 1.0), "late_repeat_charge": (1, 7, 0.97, 1.03), "resent_payment": (1, 2, 1.0, 1.0), "vendor_record_duplicate": (0, 1, 1.0, 1.0), "round_trip_transfer": (1, 3, 0.97, 1.0)}


def planted(t: DataFrame, seed: str = "p1") -> DataFrame:
    """Rows to plant in a ledger, with their anomaly_type, one case of each kind for each business that has an outflow to repeat.

    An outflow is drawn by md5 of seed, kind and id among those that leave room for the days; days, share and hour come
    from md5 of seed, kind and business. A round trip is a transfer of six to twelve times the median outflow and most of
    it back; a record duplicate names the counterparty by a second id.
    """
    u = lambda kind, what: F.expr(f"(conv(substring(md5(concat_ws('|', '{seed}', '{kind}', '{what}', business_id)), 1, 8), 16, 10) + 0.5D) / 4294967296.0D")
    out, end = None, F.expr("max(date) over (partition by business_id)")
    own = t.withColumn("_end", end).where("direction = 'out' and counterparty_id is not null").withColumn("_median", F.expr("median(cents) over (partition by business_id)"))
    for at, (kind, (least, most, low, high)) in enumerate(KINDS.items(), 1):
        lag = (least + F.floor((most - least + 1) * u(kind, "lag"))).cast("int")
        d = own.withColumn("_lag", lag).where("date_add(date, _lag) <= _end")
        d = d.withColumn("_r", F.expr(f"row_number() over (partition by business_id order by md5(concat_ws('|', '{seed}', '{kind}', transaction_id)), transaction_id)")).where("_r = 1")
        d = d.withColumn("transaction_id", F.col("transaction_id") + at * 10_000_000_000).withColumn("anomaly_type", F.lit(kind))
        share = low + (high - low) * u(kind, "share")
        hour = F.least(F.col("hour") + 1, F.lit(23)) if kind == "duplicate_payment" else (9 + F.floor(8 * u(kind, "hour")))
        if kind == "round_trip_transfer":
            d = d.withColumn("cents", F.round(F.col("_median") * (6 + 6 * u(kind, "size"))).cast("long")).withColumn("counterparty_id", F.expr("concat('RT-', business_id)")).withColumn("category", F.lit("transfer"))
            back = d.withColumn("transaction_id", F.col("transaction_id") + 5_000_000_000).withColumn("direction", F.lit("in")).withColumn("date", F.expr("date_add(date, _lag)")).withColumn("cents", F.round(F.col("cents") * share).cast("long")).withColumn("hour", F.lit(15))
            d = d.withColumn("hour", F.lit(11)).unionByName(back)
        else:
            d = d.withColumn("date", F.expr("date_add(date, _lag)")).withColumn("hour", hour.cast("int")).withColumn("cents", F.round(F.col("cents") * share).cast("long"))
            if kind == "vendor_record_duplicate":
                d = d.withColumn("counterparty_id", F.concat("counterparty_id", F.lit("-B")))
        d = d.drop("_end", "_median", "_lag", "_r")
        out = d if out is None else out.unionByName(d)
    return out
