"""Smaller operators: exact tests, calendars, prices, quotes, evidence classes, real-data adapters and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import MEAN_RANK, TOTAL, matched, ranked_values

#: Evidence classes from the strongest to the weakest.
EVIDENCE = ("bank_feed", "registry", "derived", "declared", "generated")
#: Explanations of screen rules in two languages; {} is the rule's subject.
TEMPLATES = {
    "ACT-HARD": ("The declared activity {} is on the excluded list.", "النشاط المصرح به {} مدرج في قائمة المستبعد."),
    "ACT-SOFT": ("The declared activity {} needs a review.", "النشاط المصرح به {} يحتاج إلى مراجعة."),
    "ACT-NOMCC": ("No activity code is declared; the sector {} needs a review.", "لا يوجد رمز نشاط مصرح به؛ القطاع {} يحتاج إلى مراجعة."),
    "INC-FI": ("A share of the income comes from financial institutions.", "جزء من الدخل يأتي من مؤسسات مالية."),
}


def percent_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with pct: each value's mean rank inside its group as a share of the group's size. Values are counted before they are ranked, so ties cost one row."""
    ranks = ranked_values(df, by, value).select(*by, value, F.expr(f"{MEAN_RANK} / {TOTAL}").alias("pct"))
    return matched(df, ranks, [*by, value], "left")


def log_factorial(n: Column) -> Column:
    """ln n!, by a fold; n of a table of counts."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """df, a row for each 2 x 2 table of counts, with p: the two-sided probability of tables no likelier than the one seen, and odds, null where a product is zero."""
    n = [F.col(x).cast("long") for x in (a, b, c, d)]
    row, col, total = n[0] + n[1], n[0] + n[2], n[0] + n[1] + n[2] + n[3]
    fixed = sum(map(log_factorial, (row, total - row, col)), log_factorial(total - col)) - log_factorial(total)
    t = df.withColumn("_x", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), row + col - total), F.least(row, col))))
    x = F.col("_x")
    t = t.withColumn("_p", F.exp(fixed - log_factorial(x) - log_factorial(row - x) - log_factorial(col - x) - log_factorial(total - row - col + x)))
    keys = df.columns
    t = t.withColumn("_seen", F.max(F.when(x == n[0], F.col("_p"))).over(Window.partitionBy(*keys)))
    g = t.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(F.when(F.col("_p") <= F.col("_seen") * (1 + 1e-9), F.col("_p")).otherwise(0.0))).alias("p"))
    return g.withColumn("odds", F.expr(f"try_divide(double({a}) * {d}, double({b}) * {c})"))


def lunar_date(day: Column) -> dict[str, Column]:
    """The year, month and day of the tabular Islamic calendar (civil epoch, 30-year cycle) of a date, in whole numbers."""
    i = lambda e: F.expr(e)
    d = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") + 2440588 - 1948440 + 10632
    steps = F.struct(d.alias("l"))
    steps = F.transform(F.array(steps), lambda s: F.struct(((s["l"] - 1) / 10631).cast("long").alias("n"), s["l"].alias("l")))
    steps = F.transform(steps, lambda s: F.struct(s["n"].alias("n"), (s["l"] - 10631 * s["n"] + 354).alias("l")))
    steps = F.transform(steps, lambda s: F.struct(s["n"].alias("n"), s["l"].alias("l"), (((10985 - s["l"]) / 5316).cast("long") * ((50 * s["l"]) / 17719).cast("long") + (s["l"] / 5670).cast("long") * ((43 * s["l"]) / 15238).cast("long")).alias("j")))
    steps = F.transform(steps, lambda s: F.struct(s["n"].alias("n"), s["j"].alias("j"), (s["l"] - ((30 - s["j"]) / 15).cast("long") * ((17719 * s["j"]) / 50).cast("long") - (s["j"] / 16).cast("long") * ((15238 * s["j"]) / 43).cast("long") + 29).alias("l")))
    s = F.get(steps, F.lit(0))
    month = (24 * s["l"] / 709).cast("long")
    return {"lunar_year": 30 * s["n"] + s["j"] - 30, "lunar_month": month, "lunar_day": s["l"] - (709 * month / 24).cast("long")}


def month_prices(metal: DataFrame, rates: DataFrame, implied: DataFrame, most: float = 0.001, grams: float = 31.1034768) -> DataFrame:
    """(month, price_per_gram, gap) from (month, per_ounce), (month, rate) and (month, implied_rate); where the two rates differ by more than `most`, reading a row raises."""
    m = metal.join(rates, "month").join(implied, "month").withColumn("gap", F.abs(F.col("rate") / F.col("implied_rate") - 1))
    price = F.when(F.col("gap") > most, F.raise_error(F.concat(F.lit("rates disagree in "), F.col("month"))).cast("double")).otherwise(F.col("per_ounce") * F.col("rate") / grams)
    return m.select("month", price.alias("price_per_gram"), "gap")


def judged_quotes(quotes: DataFrame, as_of: DataFrame, most_days: int = 3) -> DataFrame:
    """quotes (business_id, quoted_on, price) with a verdict against each business's as-of date: used, or why it is refused."""
    q = quotes.join(as_of.select("business_id", "window_end"), "business_id")
    why = F.expr(f"case when price is null or isnan(price) or price <= 0 then 'no_price' when quoted_on > window_end then 'newer_than_as_of' when quoted_on < date_sub(window_end, {most_days}) then 'stale' else 'used' end")
    return q.withColumn("verdict", why)


def weakest_evidence(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, evidence): of the classes in parts (key, evidence) the weakest; an unknown class raises."""
    rank = F.array_position(F.array(*map(F.lit, EVIDENCE)), F.col("evidence"))
    known = F.when(rank == 0, F.raise_error(F.concat(F.lit("no such evidence: "), F.col("evidence"))).cast("long")).otherwise(rank)
    g = parts.groupBy(*key).agg(F.max(known).cast("int").alias("r"))
    return g.select(*key, F.element_at(F.array(*map(F.lit, EVIDENCE)), F.col("r")).alias("evidence"))


def adapted(raw: DataFrame, purposes: list[tuple[str, str]]) -> DataFrame:
    """Bank rows (direction, amount, bank, account, purpose, operation) as ledger rows: signed amounts, a partner key of both parts or null, blanks as null, and the first purpose of the list that the row names, else its operation."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    named = F.coalesce(*(F.when(blank("purpose") == code, F.lit(name)) for code, name in purposes), F.lower(blank("operation")), F.lit("unknown"))
    partner = F.when(blank("bank").isNotNull() & blank("account").isNotNull(), F.concat_ws("-", blank("bank"), blank("account")))
    return raw.withColumn("signed", F.expr("if(direction = 'out', -amount, amount)")).withColumn("partner", partner).withColumn("category", named)


def explained(screens: DataFrame) -> DataFrame:
    """(business_id, rule, text_en, text_ar): a row for each rule that a screen names, in two languages."""
    r = screens.where("rules_triggered <> ''").select("business_id", F.explode(F.split("rules_triggered", ",")).alias("rule"))
    kind, subject = F.expr("array_join(slice(split(rule, '-'), 1, 2), '-')"), F.expr("array_join(slice(split(rule, '-'), 3, 9), '-')")
    text = lambda at: F.replace(F.coalesce(*(F.when(kind == k, F.lit(v[at])) for k, v in TEMPLATES.items())), F.lit("{}"), subject)
    return r.select("business_id", "rule", text(0).alias("text_en"), text(1).alias("text_ar"))


def one_to_one(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """A join that raises, when its rows are read, where a key is twice on a side."""
    def once(df: DataFrame, name: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*key))
        ok = F.when(n > 1, F.raise_error(F.lit(f"a key is twice on the {name} side")).cast("boolean")).otherwise(F.lit(True))
        return df.withColumn("_once", ok).where("_once").drop("_once")

    return once(left, "left").join(once(right, "right"), key, how)


def nearest_of_other_label(df: DataFrame, key: str, value: str, label: str, by: list[str]) -> DataFrame:
    """(by, key, gap): each row's distance to the nearest value of another label. In the order of values the nearest lies at the last or next row whose label differs, which two windows over runs of labels find."""
    part = ", ".join(by)
    w = f"over (partition by {part} order by {value}, {key}"
    d = df.where(f"{value} is not null").withColumn("_run", F.expr(f"if({label} = lag({label}) {w}), 0, 1)")).withColumn("_run", F.expr(f"sum(_run) {w} rows unbounded preceding)"))
    ends = d.groupBy(*by, "_run").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ends = ends.withColumn("before", F.expr(f"lag(hi) over (partition by {part} order by _run)")).withColumn("after", F.expr(f"lead(lo) over (partition by {part} order by _run)"))
    return d.join(ends, [*by, "_run"]).select(*by, key, F.least(F.abs(F.col(value) - F.col("before")), F.abs(F.col("after") - F.col(value))).alias("gap"))


def growth(yearly: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """(key, first_year, last_year, cagr, weighted_growth): compound growth from the first year to the last, and the mean of yearly ratios weighted by the year before."""
    y = yearly.withColumn("_prev", F.expr(f"lag({value}) over (partition by {key} order by {year})"))
    return y.groupBy(key).agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.expr(f"pow(try_divide(max_by({value}, {year}), min_by({value}, {year})), try_divide(1.0D, max({year}) - min({year}))) - 1").alias("cagr"),
        F.expr(f"try_divide(sum(if(_prev is not null, {value}, null)), sum(_prev)) - 1").alias("weighted_growth"))


def temporal_splits(df: DataFrame, date: str, parts: int = 5) -> DataFrame:
    """(fold, train_rows, test_rows, test_from, test_to): expanding windows over equal parts of the dates; part k is tested by what came before it. Dates are counted first, so a part is a range of days, never a split day."""
    days = df.groupBy(date).agg(F.count("*").alias("n")).withColumn("at", F.expr(f"(sum(n) over (order by {date}) - n) / double(sum(n) over ())")).withColumn("part", F.expr(f"least(cast(floor(at * {parts}) as int), {parts - 1})"))
    p = days.groupBy("part").agg(F.sum("n").alias("test_rows"), F.min(date).alias("test_from"), F.max(date).alias("test_to"))
    p = p.withColumn("train_rows", F.expr("sum(test_rows) over (order by part rows between unbounded preceding and 1 preceding)"))
    return p.where("train_rows is not null").select(F.col("part").alias("fold"), "train_rows", "test_rows", "test_from", "test_to")
