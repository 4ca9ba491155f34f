"""Least squares by group, of several factors at once: Gram matrices as sums of products, solved by folds over arrays.

One aggregate by group gathers the sums that the normal equations need, p (p + 1) / 2 + p of them for p terms, so rows are
combined before they are shuffled and no group is ever collected. The Cholesky factor is a fold that appends rows, and two
further folds substitute. A term that the ones before it explain (its pivot is under TOLERANCE of its own square) is
dropped: its coefficient is null and it is named; the others are those of the equations without it.

Rows with a null in any term or in y are left out. A group needs no minimum of rows; terms that its rows can't tell apart are
dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-10


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (u, v) -> u * v), 0.0D, (t, w) -> t + w)"


def _factor(p: int) -> str:
    """SQL of the Cholesky factor's rows of _gram (a row has the entries up to its diagonal); a dropped term has a diagonal of 0."""
    pivot = f"_gram[i][i] - {_dot('r', 'r')}"
    diagonal = f"if({pivot} <= {TOLERANCE}D * _gram[i][i] or _gram[i][i] <= 0.0D, 0.0D, sqrt({pivot}))"
    below = f"if(get(get(l, j), j) = 0.0D, 0.0D, (_gram[i][j] - {_dot('r', 'slice(get(l, j), 1, j)')}) / get(get(l, j), j))"
    row = f"aggregate(sequence(0, i), cast(array() as array<double>), (r, j) -> concat(r, array(if(j = i, {diagonal}, {below}))))"
    return f"aggregate(sequence(0, {p - 1}), cast(array() as array<array<double>>), (l, i) -> concat(l, array({row})))"


def fit(df: DataFrame, y: str, terms: dict[str, str], by: list[str]) -> DataFrame:
    """(by, term, coefficient, dropped, n): terms are name: SQL of a number; the first one is usually an intercept, '1.0D'."""
    p, names = len(terms), list(terms)
    x = [f"_x{i}" for i in range(p)]
    rows = df.select(*by, F.expr(f"cast({y} as double)").alias("_y"), *(F.expr(f"cast({e} as double)").alias(c) for c, e in zip(x, terms.values()))).where(" and ".join(f"{c} is not null" for c in ["_y", *x]))
    sums = {f"_g{i}_{j}": f"sum({x[i]} * {x[j]})" for i in range(p) for j in range(i + 1)} | {f"_b{i}": f"sum({x[i]} * _y)" for i in range(p)}
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.expr(e).alias(k) for k, e in sums.items()))
    gram = "array(" + ", ".join("array(" + ", ".join(f"_g{max(i, j)}_{min(i, j)}" for j in range(p)) + ")" for i in range(p)) + ")"
    g = g.select(*by, "n", F.expr(gram).alias("_gram"), F.expr("array(" + ", ".join(f"_b{i}" for i in range(p)) + ")").alias("_rhs")).withColumn("_low", F.expr(_factor(p)))
    own = "_low[i][i]"
    forward = f"aggregate(sequence(0, {p - 1}), cast(array() as array<double>), (z, i) -> concat(z, array(if({own} = 0.0D, 0.0D, (_rhs[i] - {_dot('z', 'slice(_low[i], 1, i)')}) / {own}))))"
    # from the last term on; the solution so far stands in front of the array
    column = f"transform(sequence(0, {p - 1} - i), k -> if(k = 0, 0.0D, _low[i + k][i]))"
    back = f"aggregate(reverse(sequence(0, {p - 1})), cast(array() as array<double>), (s, i) -> concat(array(if({own} = 0.0D, 0.0D, (_half[i] - {_dot('s', f'slice({column}, 2, {p})')}) / {own})), s))"
    g = g.withColumn("_half", F.expr(forward)).withColumn("_solved", F.expr(back))
    each = F.expr("array(" + ", ".join(f"struct('{n}' as term, if(_low[{i}][{i}] = 0.0D, null, _solved[{i}]) as coefficient, _low[{i}][{i}] = 0.0D as dropped)" for i, n in enumerate(names)) + ")")
    return g.select(*by, "n", F.inline(each)).select(*by, "term", "coefficient", "dropped", "n")
