"""URL filters by a temporal list join (operator 2).

List entries are dated events: on a day a list ("block" or "allow") takes a domain up ("add") or drops it ("drop").
They become validity intervals by a window over each list and domain; an as-of join then judges every capture by what
was in force on the day of its fetch, for its host and each parent domain: the most specific domain in force decides,
and of equal ones "allow".

Captures are first reduced to their distinct hosts and days, so a host with a third of all captures costs its days.
Intervals are cut at multiples of SPAN days, into those spans that hold captures, and joined by domain and span: an equi-join
whatever the length of a history, and an entry that never drops costs a row for each span with captures.

Rows: a null or unreadable URL has no host and is not listed; a null day is judged as not listed; entries with nulls or other actions
are left out; of entries of a list and domain on one day the drop counts; an add after an add keeps the first day, an
entry that never drops stays in force to the last day of the calendar; repeated rows each get their verdict; other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh

SPAN = 128


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, without user, port and a final dot; null where there is none."""
    host = F.rtrim(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("."))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, since, until): when each list held each domain, until not included (null: still)."""
    fine = entries.where("list in ('block', 'allow') and action in ('add', 'drop') and domain is not null and day is not null")
    daily = fine.groupBy("list", F.lower("domain").alias("domain"), "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "domain").orderBy("day")
    turns = daily.withColumn("last", F.lag("action").over(w)).where("action <> coalesce(last, 'drop')")
    return turns.withColumn("until", F.lead("day").over(w)).where("action = 'add'").select("list", "domain", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", span: int = SPAN) -> DataFrame:
    """captures with host, verdict ("block", "allow" or null), the domain that decided (listed_domain) and since when; of these names those that captures have are led by an underscore."""
    part = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / span)
    host, verdict, listed, since = fresh(captures.columns, "host", "verdict", "listed_domain", "since")
    tmp, h, d, best = fresh([*captures.columns, host, verdict, listed, since], "fetched_on", "h", "d", "best")
    rows = captures.withColumn(host, host_of(F.col(f"`{url}`"))).withColumn(tmp, F.col(f"`{fetched}`").cast("date"))
    asked = rows.select(F.col(host).alias("h"), F.col(tmp).alias("d")).where("h is not null and d is not null").distinct().withColumn("part", part(F.col("d")))
    # the spans with captures: their number is bounded by the calendar
    spans = asked.agg(F.sort_array(F.collect_set("part"))).scalar()
    labels = F.split("h", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = asked.withColumn("domain", F.explode(parents))
    held = intervals(entries)
    met = F.filter("spans", lambda p: (p >= part(F.col("since"))) & F.coalesce(p <= part(F.date_sub("until", 1)), F.lit(True)))
    held = held.withColumn("spans", spans).withColumn("part", F.explode(met)).drop("spans")
    found = asked.join(held, ["domain", "part"]).where("since <= d and (until is null or d < until)")
    most = F.min(F.struct((-F.length("domain")).alias("n"), F.col("list").alias("verdict"), "domain", "since"))
    verdicts = found.groupBy(F.col("h").alias(h), F.col("d").alias(d)).agg(most.alias(best))
    out = rows.join(verdicts, (F.col(host) == F.col(h)) & (F.col(tmp) == F.col(d)), "left")
    return out.select(*(F.col(f"`{c}`") for c in captures.columns), host, F.col(f"{best}.verdict").alias(verdict), F.col(f"{best}.domain").alias(listed), F.col(f"{best}.since").alias(since))
