"""Parameter sweeps in one pass: settings meet shared statistics, not the ledger.

A feature is a formula over sufficient statistics (one row for each entity, gathered once and kept) with one parameter in
it. All settings of all parameters are an array of literals that each row carries laterally, so every setting's values,
AUC, rank correlation and share of values other than zero come from one frame; its size is entities times settings, whatever
the ledger's. Ranks inside a setting are dealt by range (ranks.py).

Rows: a null value has no part in its setting; a setting in which a statistic isn't defined has null there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import saved
from . import stats

BY = ["parameter", "setting"]


def settings(base: DataFrame, parameters: dict[str, tuple[list[float], str]], keep: list[str], digits: int = 6) -> DataFrame:
    """(keep, parameter, setting, value): parameters are name: (levels, SQL with v for the level)."""
    each = [F.struct(F.lit(name).alias("parameter"), F.lit(float(v)).alias("setting"), F.round(F.expr(formula.replace("{v}", f"{float(v)!r}D")), digits).alias("value")) for name, (levels, formula) in parameters.items() for v in levels]
    return base.select(*keep, F.inline(F.array(*each)))


def sweep(base: DataFrame, parameters: dict[str, tuple[list[float], str]], label: str, target: str) -> DataFrame:
    """(parameter, setting, n, auc, rho, nonzero_share) of each setting: the AUC against a label, the rank correlation with a target."""
    held = saved(settings(base, parameters, [label, target]))
    shares = held.groupBy(*BY).agg(F.count("value").alias("n"), F.expr("try_divide(count_if(value <> 0), count(value))").alias("nonzero_share"))
    auc = stats.auc(held, "value", label, BY).select(*BY, "auc")
    return shares.join(auc, BY, "left").join(stats.spearman(held, "value", target, BY), BY, "left").select(*BY, "n", "auc", "rho", "nonzero_share")
