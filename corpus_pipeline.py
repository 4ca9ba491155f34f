"""The corpus pipeline: quality classifier, SimHash near-dedup, mixing to target weights, BPE encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet below spark.checkpoint.dir and reads again for the next. All but the last return the columns of documents. Empty
tables, nulls, repeated rows and further columns are handled as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_automaton, mixing, quality, simhash
from tidemark.llm.shared import fresh, scratch

#: Near-duplicate stages on word shingles take five words and this similarity.
SHINGLE, SIMILARITY = 5, 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels outside the held-out fold."""
    model = quality.fit(docs, quality.learners(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    return simhash.keep_one(docs, shingle=SHINGLE, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mixture takes, shuffled inside its shard."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ids, the text decoded from them, and their number; of these names those that docs have are led by an underscore."""
    ids, decoded, n = fresh(docs.columns, "ids", "decoded", "n_tokens")
    out = bpe_automaton.encode_decode(docs, "word_bpe_49k.json", ids=ids, decoded=decoded)
    return out.withColumn(n, F.size(ids).cast("long"))


STAGES = [("quality", keep_quality), ("simhash", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: XXH64, Cholesky factors and merges are out of SQL's reach; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
