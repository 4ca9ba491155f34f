"""Files in and out: CSV with explicit schemas and declared domains, a keyed store for lookups, hash sidecars and decision lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def mapped(df: DataFrame, columns: dict[str, tuple[str, str]], domains: dict[str, list[str]] | None = None) -> DataFrame:
    """df with source columns renamed and cast as columns says (new -> (old, type)); `yymmdd` reads six-digit dates. Values outside a declared domain raise when the rows are read."""
    picked = []
    for new, (old, kind) in columns.items():
        c = F.col(f"`{old}`")
        c = F.to_date(F.concat(F.lit("19"), F.substring(c.cast("string"), 1, 6)), "yyyyMMdd") if kind == "yymmdd" else c.cast(kind)
        if domains and new in domains:
            bad = c.isNotNull() & ~c.isin(domains[new])
            c = F.when(bad, F.raise_error(F.concat(F.lit(f"{new} outside its domain: "), c.cast("string"))).cast(kind)).otherwise(c)
        picked.append(c.alias(new))
    return df.select(*picked)


def write_store(df: DataFrame, path: str, key: str, order: list[str]) -> None:
    """A table laid out for lookups: ranges of the key in files, sorted inside, so a key's filter reads few row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key, *order).write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, ids: list, order: list[str]) -> DataFrame:
    """Rows of some keys, in order; an absent key raises KeyError."""
    rows = spark.read.parquet(path).where(F.col(key).isin(ids))
    absent = set(ids) - {r[0] for r in rows.select(key).distinct().collect()}  # at most the ids asked for
    if absent:
        raise KeyError(sorted(absent))
    return rows.orderBy(key, *order)


def hash_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of archived files, for writing beside them or for comparing with what stands there."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def decision_lines(df: DataFrame, key: str) -> DataFrame:
    """One JSON object a row with its receipt, the SHA-256 of its canonical text."""
    body = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))))
    return df.select(key, body.alias("value"), F.sha2(body, 256).alias("receipt"))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """df as CSV with a header, sorted by ranges of its order, doubles as they are."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def altered(spark: SparkSession, path: str, sidecars: DataFrame) -> DataFrame:
    """(path, verdict) of files that differ from their sidecars (path, sha256, length): changed, missing or new."""
    now = hash_sidecars(spark, path).select("path", F.col("sha256").alias("_now"))
    d = now.join(sidecars.select("path", "sha256"), "path", "full")
    return d.withColumn("verdict", F.expr("case when _now is null then 'missing' when sha256 is null then 'new' when _now <> sha256 then 'changed' end")).where("verdict is not null").select("path", "verdict")


def read_statistics(spark: SparkSession, path: str, labels: dict[str, str], total: str = "Total", tolerance: float = 0.005) -> DataFrame:
    """(period, series, value) of an official table (Period, Series, Value; a byte-order mark may lead it), series relabelled. Where a period's series differ from its total by more than the tolerance, reading it raises."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.lstrip("\ufeff").strip().lower() for c in raw.columns))
    t = raw.select("period", F.trim("series").alias("series"), F.regexp_replace("value", ",", "").cast("double").alias("value"))
    sums = t.groupBy("period").agg(F.sum(F.when(F.col("series") != total, F.col("value"))).alias("_parts"), F.max(F.when(F.col("series") == total, F.col("value"))).alias("_total"))
    off = F.abs(F.col("_parts") - F.col("_total")) > tolerance * F.abs(F.col("_total"))
    value = F.when(F.coalesce(off, F.lit(False)), F.raise_error(F.concat(F.lit("series don't add up in "), F.col("period"))).cast("double")).otherwise(F.col("value"))
    name = F.coalesce(*(F.when(F.col("series") == old, F.lit(new)) for old, new in labels.items()), F.col("series"))
    return t.join(sums, "period").where(F.col("series") != total).select("period", name.alias("series"), value.alias("value"))


def write_report(df: DataFrame, path: str, title: str) -> None:
    """A small result (a report's rows) as one text file in Markdown; past 10,000 rows it raises."""
    if df.count() > 10_000:
        raise ValueError("a report has at most 10,000 rows")
    names = df.columns
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names)), F.lit(" |"))
    body = df.agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("b"))
    head = f"# {title}\n\n| " + " | ".join(names) + " |\n|" + "-|" * len(names) + "\n"
    body.select(F.concat(F.lit(head), F.col("b")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def without_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """df without the rows of a year that isn't typical; rows without a date stay out too, as their year isn't known."""
    return df.where(F.year(column) != year)
