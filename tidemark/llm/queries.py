"""The registered queries of this package, thin over its operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, embeddings, fill_in_middle, language_model, licenses, media, mixing, quality, simhash, token_counts, token_files, url_filters, whitening
from .shared import crc32_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of pages: md5 of a domain picks about a quarter of them, a list, and days to add, drop and add again."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("h")).where("h is not null").distinct()
    parent = F.array_join(F.slice(F.split("h", r"\."), 2, 64), ".")
    names = hosts.select(F.explode(F.array("h", parent)).alias("domain")).where("domain like '%.%'").distinct()
    n = lambda at: F.conv(F.substring(F.md5(F.col("domain").cast("binary")), at, 4), 16, 10).cast("int")
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int"))
    first, second, third = n(5) % 200, n(5) % 200 + 20 + n(9) % 100, n(5) % 200 + 150 + n(9) % 100
    events = F.array(F.struct(day(first).alias("day"), F.lit("add").alias("action")), F.struct(day(second).alias("day"), F.lit("drop").alias("action")), F.struct(day(third).alias("day"), F.lit("add").alias("action")))
    picked = names.where(n(1) % 4 == 0).withColumn("list", F.when(n(13) % 3 == 0, "allow").otherwise("block"))
    return picked.select("list", "domain", F.explode(F.slice(events, F.lit(1), 1 + n(13) % 3)).alias("e")).select("list", "domain", "e.day", "e.action")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on a day of 2024 that the id gives; the tables hold neither dates nor lists, so both are derived by rule."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return url_filters.judge(captures, list_entries(pages)).select("page_id", "host", "fetched", "verdict", "listed_domain", "since")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.to_png(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    back = media.read_media(stored, keep=["doc_id", "n_bytes"])
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("low_hash")).alias("feature"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, "piece_bpe_32k.model").select("doc_id", "n_words", "n_tokens", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_automaton.encode_decode(docs, "word_bpe_49k.json")
    line = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(line, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, quality.learners(labels))
    held = F.pmod(crc32_of("doc_id"), F.lit(5)) == 0
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    shards = F.array_join(F.col("copies.shard").cast("array<string>"), ",")
    return rows.select(F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size(F.filter("copies", lambda c: c["shard"].isNotNull()))).alias("taken"), shards.alias("shards"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents").select("doc_id", "text"), language_model.learners())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def crcs(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        data = ids.astype("<u4")
        return pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())

    back = token_files.store(docs, "byte_bpe_50k.json", end_id=2, more={"ids_crc32": ("long", crcs)})
    return back.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = fill_in_middle.restore(fill_in_middle.transform(docs))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    rows = whitening.transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, model.explained or [0.0])), F.col("place") + 1)
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = licenses.scan(docs)
    label = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    n_base = F.size("places").cast("long")
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        label(F.col("places.label")).alias("base_labels"), label(F.concat("places.label", "blocks.label")).alias("labels"), F.when(n_base > 0, 1.0).otherwise(best).alias("score"),
    )


QUERIES = {"op1_embeddings": op1_embeddings, "op2_url_filters": op2_url_filters, "op3_media": op3_media, "op4_token_counts": op4_token_counts, "op5_bpe": op5_bpe, "op6_quality": op6_quality, "op7_mixing": op7_mixing, "op8_lm": op8_lm, "op9_simhash": op9_simhash, "op10_token_files": op10_token_files, "op11_fill_in_middle": op11_fill_in_middle, "op12_whitening": op12_whitening, "op13_licenses": op13_licenses}
SQL: dict[str, str] = {}

SQL["op1_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.fine AND b.fine AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""

SQL["op7_mixing"] = mixing.sql()

SQL["op2_url_filters"] = r"""
WITH p AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
                  nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS host FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
n AS (SELECT DISTINCT domain FROM (SELECT host AS domain FROM h UNION ALL SELECT array_to_string(list_slice(string_split(host, '.'), 2, 64), '.') FROM h) WHERE domain LIKE '%.%'),
x AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 4) AS INTEGER) AS a, CAST('0x' || substr(md5(domain), 5, 4) AS INTEGER) % 200 AS b,
             CAST('0x' || substr(md5(domain), 9, 4) AS INTEGER) % 100 AS c, CAST('0x' || substr(md5(domain), 13, 4) AS INTEGER) % 3 AS k FROM n),
e AS (SELECT domain, CASE WHEN k = 0 THEN 'allow' ELSE 'block' END AS list, i, CASE i WHEN 1 THEN 'drop' ELSE 'add' END AS action,
             DATE '2024-01-01' + CAST(CASE i WHEN 0 THEN b WHEN 1 THEN b + 20 + c ELSE b + 150 + c END AS INTEGER) AS day
      FROM x, (SELECT unnest(range(0, 3)) AS i) WHERE a % 4 = 0 AND i <= k),
t AS (SELECT *, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until FROM e),
v AS (SELECT p.host, p.fetched, t.list, t.domain, t.day AS since,
             row_number() OVER (PARTITION BY p.host, p.fetched ORDER BY length(t.domain) DESC, t.list, t.domain, t.day) AS r
      FROM (SELECT DISTINCT host, fetched FROM p) p JOIN t ON t.action = 'add' AND t.day <= p.fetched AND (t.until IS NULL OR p.fetched < t.until)
       AND (p.host = t.domain OR ends_with(p.host, '.' || t.domain)))
SELECT p.page_id, p.host, p.fetched, v.list AS verdict, v.domain AS listed_domain, v.since
FROM p LEFT JOIN v ON p.host = v.host AND p.fetched = v.fetched AND v.r = 1
"""

SQL["op11_fill_in_middle"] = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tok, sha256('1:' || doc_id) AS d FROM documents),
g AS (SELECT *, len(tok)::BIGINT AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(tok[1:a], '') AS prefix, array_to_string(tok[a + 1:b], '') AS middle, array_to_string(tok[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

SQL["op13_licenses"] = licenses.sql()
