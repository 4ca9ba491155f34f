"""The registered queries of the ledger engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable


def queries() -> dict[str, Callable]:
    from . import adapters, audit, checks, generated, history, intervals, measures, registry, runs, sweeps, thinning, training  # noqa: F401  (each adds its own)

    return dict(adapters.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from . import adapters

    return dict(adapters.SQL)
