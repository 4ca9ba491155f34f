"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 7), in DataFrame functions only.

Each source's documents, in an order that a hash permutes, form a line of words; a source's target is cut from the start
of its line, which is repeated up to MOST times, into blocks of equal words. The blocks of all sources are an exact
quota each at the root of a binary tree over the output shards. Every node sends half of its quota left, as a uniform
draw without replacement would (so each source's share is multivariate hypergeometric), down to the shards. A shard then
draws that many of the source's blocks from one permutation of them, so draws are disjoint, and orders its documents by
a hash. All orders come from md5 of stable values: reruns agree.

Places on a line are prefix sums in two steps (4096 hash buckets a source, then inside a bucket), so a source with a
third of all rows is spread over its buckets. A document goes with the block where it starts, and whole; a copy is taken
if its middle lies before the cut, so a source misses its target by half a document at most.

Rows: a null text has size 0, as an empty one; a null source is a source of its own, last; sources without words have
target 0 and are not taken; repeated rows each have their place, null ids too; rows alike in id and text are ordered by a
hash of their other columns (maps left out), so reruns agree; other columns pass through in mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD

SHARDS, BLOCKS_A_SHARD, MOST, BUCKET_DIGITS, SEED = 64, 16, 3, 3, "mix"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def _order(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(s, source_size, no, target) of (s, source_size): shares by weight 1, 2, 3, repeating, none above `most` times its source's size."""
    w = Window.orderBy(F.col("s").isNull(), "s")
    t = sizes.withColumn("no", F.row_number().over(w)).withColumn("weight", 1 + F.pmod(F.col("no") - 1, F.lit(3)))
    t = t.withColumn("ratio", most * F.col("source_size").cast("double") / F.col("weight"))
    before = Window.orderBy("ratio", "no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    used = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    t = t.withColumn("level", (F.sum("source_size").over(every) - most * used("source_size")).cast("double") / (F.sum("weight").over(every) - used("weight")))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no", "level"))
    t = t.withColumn("level", F.min(fits).over(every)["level"])
    return t.select("s", "source_size", "no", F.least(most * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(no, shard, quota) of (no, blocks): the exact quotas of every shard; shards is a power of two."""
    unit = quotas.where("blocks > 0").select("no", F.explode(F.sequence(F.lit(1), F.col("blocks"))).alias("unit")).withColumn("node", F.lit(0))
    for level in range((shards - 1).bit_length()):
        rank = F.row_number().over(Window.partitionBy("node").orderBy(_order(seed, F.lit(level), F.col("no"), F.col("unit"))))
        half = F.ceil(F.count("*").over(Window.partitionBy("node")) / 2)
        unit = unit.withColumn("node", 2 * F.col("node") + (rank > half).cast("int"))
    return unit.groupBy("no", F.col("node").alias("shard")).agg(F.count("*").alias("quota"))


def block_shards(tree: DataFrame, seed: str = SEED) -> DataFrame:
    """(no, shards): for each source the shard of every block, in block order. Shards draw from one permutation of the source's blocks."""
    drawn = tree.select("no", "shard", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("k"))
    drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy("shard", "k")))
    blocks = drawn.select("no", (F.col("rank") - 1).alias("block"))
    blocks = blocks.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(_order(seed, "block", F.col("no"), F.col("block")), "block")))
    met = blocks.join(drawn.select("no", "rank", "shard"), ["no", "rank"])
    return met.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "shard"))), lambda x: x["shard"]).alias("shards"))  # as many as the tree has blocks at most


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, blocks_a_shard: int = BLOCKS_A_SHARD, most: int = MOST, seed: str = SEED, keep: bool = False) -> DataFrame:
    """(row, size, source_size, target, copies): for each row its whole columns as a struct (keep) or its id, and the copies taken, each with its number, block and shard."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if keep else F.col(f"`{id_col}`")
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("binary"))
    tied = [F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()] if keep else []
    rows = docs.select(own.alias("row"), F.col(f"`{source}`").cast("string").alias("s"), word_count(text).alias("size"), key.alias("key"))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)).withColumn("tie", F.xxhash64(*tied) if tied else F.lit(0).cast("long"))
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    sources = targets(sums.groupBy("s").agg(F.sum("words").alias("source_size")), most)
    total = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sources = sources.withColumn("take", F.round("target").cast("long")).withColumn("wide", F.greatest(F.lit(1), F.ceil(total / (shards * blocks_a_shard))).cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("take") / F.col("wide")).cast("int"))
    drawn = block_shards(splitting_tree(sources.select("no", "blocks"), shards, seed), seed)
    sources = sources.join(drawn, "no", "left").withColumnRenamed("s", "s_")
    at = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sums.withColumn("at", at).join(sources, F.col("s").eqNullSafe(F.col("s_"))).drop("s_")
    times = F.sequence(F.lit(0), F.lit(most - 1))
    low = lambda c: F.floor((c * F.col("source_size") + F.col("at")) / F.col("wide")).cast("int")
    high = lambda c: F.floor((c * F.col("source_size") + F.col("at") + F.col("words")) / F.col("wide")).cast("int")
    empty = F.array().cast("array<int>")
    places = places.withColumn("lows", F.transform(times, low)).withColumn("parts", F.transform(times, lambda c: F.slice(F.coalesce("shards", empty), low(c) + 1, high(c) - low(c) + 1)))
    places = places.select(F.col("s").alias("s_"), F.col("bucket").alias("b_"), "at", "source_size", "target", "take", "wide", "lows", "parts")
    rows = rows.join(places, F.col("s").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_"))).drop("s_", "b_")
    inside = F.sum("size").over(Window.partitionBy("s", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.col("at") + F.coalesce(inside, F.lit(0)))
    taken = F.filter(times, lambda c: 2 * (c * F.col("source_size") + F.col("at")) + F.col("size") < 2 * F.col("take"))

    def drawn_copy(c: Column) -> Column:
        block = F.floor((c * F.col("source_size") + F.col("at")) / F.col("wide")).cast("int")
        return F.struct(c.alias("copy"), block.alias("block"), F.get(F.get("parts", c), block - F.get("lows", c)).alias("shard"))

    return rows.select("row", "key", "size", "source_size", "target", F.transform(taken, drawn_copy).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, **more) -> DataFrame:
    """The mixture: a row for each copy taken, with the columns of docs, dealt to shards and shuffled inside each."""
    rows = plan(docs, id_col, text, source, shards, keep=True, **more)
    rows = rows.select("row", "key", F.explode("copies").alias("c")).select("row", F.col("c.shard").alias("shard"), _order("local", F.col("key"), F.col("c.copy")).alias("place"))
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select("row.*")  # a shard may span tasks


def sql(shards: int = SHARDS, blocks_a_shard: int = BLOCKS_A_SHARD, most: int = MOST, seed: str = SEED) -> str:
    """The same plan for a table documents in DuckDB."""
    levels, last = [], "u0"
    for k in range((shards - 1).bit_length()):
        levels.append(f"u{k + 1} AS (SELECT no, unit, 2*node + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY md5('{seed}|{k}|' || no || '|' || unit)) > ceil(count(*) OVER (PARTITION BY node) / 2.0) THEN 1 ELSE 0 END AS node FROM u{k})")
        last = f"u{k + 1}"
    return f"""
WITH d AS (SELECT doc_id, source AS s, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key FROM documents),
z AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY s NULLS LAST) AS no FROM d GROUP BY s),
w AS (SELECT *, 1 + (no - 1) % 3 AS weight, {most} * CAST(source_size AS DOUBLE) / (1 + (no - 1) % 3) AS ratio FROM z),
l AS (SELECT *, CAST(sum(source_size) OVER () - {most} * coalesce(sum(source_size) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM w WINDOW b AS (ORDER BY ratio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT s, no, source_size, least({most} * CAST(source_size AS DOUBLE), (SELECT arg_min(level, ratio * 1000000 + no) FROM l WHERE level <= ratio) * weight) AS target,
             (SELECT greatest(1, CAST(ceil(sum(source_size) / {shards * blocks_a_shard}.0) AS BIGINT)) FROM z) AS wide FROM l),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS take, CAST(ceil(round(target) / wide) AS BIGINT) AS blocks FROM t),
u0 AS (SELECT no, unnest(range(1, blocks + 1)) AS unit, 0 AS node FROM q WHERE blocks > 0),
{", ".join(levels)},
r AS (SELECT no, node AS shard, row_number() OVER (PARTITION BY no ORDER BY node, unit) AS rank FROM {last}),
p AS (SELECT no, rank - 1 AS block, row_number() OVER (PARTITION BY no ORDER BY md5('{seed}|block|' || no || '|' || (rank - 1)), rank) AS rank FROM r),
b AS (SELECT p.no, p.block, r.shard FROM p JOIN r ON p.no = r.no AND p.rank = r.rank),
a AS (SELECT d.*, q.no, source_size, target, take, wide, coalesce(sum(size) OVER (PARTITION BY d.s ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN q ON d.s IS NOT DISTINCT FROM q.s),
c AS (SELECT a.doc_id, a.key, copy, b.shard FROM a JOIN (SELECT unnest(range(0, {most})) AS copy) ON 2 * (copy * source_size + pos) + size < 2 * take
      JOIN b ON b.no = a.no AND b.block = (copy * source_size + pos) // wide),
n AS (SELECT doc_id, key, count(*) AS n, string_agg(CAST(shard AS VARCHAR), ',' ORDER BY copy) AS shards FROM c GROUP BY doc_id, key)
SELECT a.doc_id, a.size, a.source_size, a.target, CAST(a.size * coalesce(n.n, 0) AS BIGINT) AS taken, coalesce(n.shards, '') AS shards
FROM a LEFT JOIN n ON a.doc_id IS NOT DISTINCT FROM n.doc_id AND a.key = n.key
"""
