"""Registered queries: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinfold.plans.fixtures import Inputs, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a function of `Inputs`; `covers` is the operator id of the survey."""

    def add(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        QUERIES[key], COVERS[key] = run, covers
        if sql:
            ORACLES[key] = oracle(sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round computed doubles, so that the order of a sum does not show."""
    return df.select(*[r(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def r(col: Column | str, digits: int = 6) -> Column:
    return F.round(col, digits) + F.lit(0.0)
