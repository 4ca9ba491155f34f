"""Sealed decisions audited after a saved row and an input were damaged, with the SQL of what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import new_path, saved
from ..operators import compare as C
from ..operators import verification as V
from ..sources import ledger as L
from .lenses import decisions
from .measures import _NAMES
from .profiles import register

_WIDTH = f"greatest(1, CAST(ceil((max(transaction_id) - min(transaction_id) + 1) / {1 << C.DEPTH}.0::DOUBLE) AS BIGINT))"


@register(f"""m AS (SELECT max(transaction_id) AS k, min(transaction_id) AS lo, {_WIDTH} AS w FROM tx)
SELECT 'damaged row' AS finding, 'decisions' AS table_name, NULL AS column_name, min(business_id) AS first_key, min(business_id) AS last_key FROM biz
UNION ALL SELECT 'changed input', 'transactions', 'category', lo + (k - lo) // w * w, lo + (k - lo) // w * w + w - 1 FROM m""")
def decision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions are sealed with digests of transactions and obligations; then one saved row and the category of one transaction are damaged: the audit names both and nothing else."""
    folder, damaged = new_path(spark, "sealed"), new_path(spark, "damaged")
    tx, obligations = saved(L.transactions(spark, sf_dir)), L.obligations(spark, sf_dir)
    inputs = lambda t: {"transactions": (t, "transaction_id"), "obligations": (obligations, "obligation_id")}
    made = saved(decisions(spark, sf_dir))
    V.seal(made, "business_id", _NAMES, inputs(tx), folder)
    held = spark.read.parquet(f"{folder}/decisions")
    first = held.agg(F.min("business_id").alias("_least"))
    held.crossJoin(F.broadcast(first)).withColumn("tier", F.expr("if(business_id = _least, 'none such', tier)")).drop("_least").write.parquet(f"{damaged}/decisions")  # one row
    spark.read.parquet(f"{folder}/inputs").write.parquet(f"{damaged}/inputs")
    last = tx.agg(F.max("transaction_id").alias("_last"))
    other = tx.crossJoin(F.broadcast(last)).withColumn("category", F.expr("if(transaction_id = _last, 'other', category)")).drop("_last")  # one row
    return V.audit(spark, damaged, "business_id", _NAMES, decisions(spark, sf_dir), inputs(other))
