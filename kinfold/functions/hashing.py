"""Deterministic pseudo-random columns: the same value on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_key(seed: str, *keys) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys]))


def hash_bits(seed: str, *keys) -> Column:
    """First 52 bits of the md5 as bigint."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 13), 16, 10).cast("bigint")


def uniform(seed: str, *keys) -> Column:
    """Uniform on (0, 1); never 0, so that ln() stays finite."""
    return (hash_bits(seed, *keys) + F.lit(0.5)) / F.lit(float(2**52))


def exponential_key(seed: str, weight: Column, *keys) -> Column:
    """-ln(u)/w: ascending order of these keys is a weighted draw without replacement."""
    return -F.log(uniform(seed, *keys)) / weight
