"""Aggregates that give NULL where a statistic is undefined."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over complete pairs; NULL where either side does not vary.

    The built-in corr raises a division error on a constant column in ANSI mode.
    """
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
