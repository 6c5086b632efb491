"""Ranks, running totals and quantiles that survive a hot group.

A window over (partition by group order by value) sorts a whole group in one
task. Here equal values are first merged into one weighted row, then a group
with many distinct values is cut into value ranges. Each range is one window
partition, and the ranges are stitched together by a table of range totals.
The cuts only steer the placement; the results do not depend on them. They
come from a sample chosen by hash, one value in SAMPLE_MOD, so that a
recomputed task sees the same cuts and a range holds about SAMPLE_MOD values.
A smaller group meets no sampled value, or few, and stays in one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SAMPLE_MOD = 1 << 18
RANGES = 4096
STEP = 64


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Equi join on group keys in which NULL is a group of its own."""
    other = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    other = F.broadcast(other) if small else other
    cond = None
    for c in keys:
        one = left[c].eqNullSafe(other[f"_k_{c}"])
        cond = one if cond is None else cond & one
    return left.join(other, cond, how).drop(*[f"_k_{c}" for c in keys])


def with_ranges(df: DataFrame, group: Sequence[str], key: str, sample_mod: int = SAMPLE_MOD, ranges: int = RANGES) -> DataFrame:
    """Add `_range`, non-decreasing in the numeric column `key` within a group.

    The cut table holds one value in `sample_mod` of the distinct values, 30 MB
    for 10^12 of them, so it may be broadcast. A place among the cuts is found
    in two steps, every 64th cut first.
    """
    value = F.col(key).cast("double")
    thin = F.ceil(F.size("_s") / F.lit(ranges)).cast("int")
    cuts = (
        df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(sample_mod)) == 0)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_set(value)).alias("_s"))
        .withColumn("_thin", thin)
        .withColumn("_cuts", F.filter("_s", lambda c, i: i % F.col("_thin") == F.col("_thin") - 1))
        .withColumn("_coarse", F.filter("_cuts", lambda c, i: i % STEP == STEP - 1))
        .select(*group, "_cuts", "_coarse")
    )
    placed = _join_groups(df, cuts, list(group), "left", small=True).withColumn(
        "_i", F.size(F.filter("_coarse", lambda c: c < value))
    )
    near = F.slice("_cuts", F.col("_i") * STEP + 1, F.lit(STEP))
    place = F.col("_i") * STEP + F.size(F.filter(near, lambda c: c < value))
    return placed.withColumn("_range", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(place)).drop("_cuts", "_coarse", "_i")


def cumulative(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    weight: str | Column | None = None,
    key: str | None = None,
    sample_mod: int = SAMPLE_MOD,
    ranges: int = RANGES,
) -> DataFrame:
    """One row per distinct (group, order) with `n`, `below`, `upto`, `total`.

    `n` is the row count (or the sum of `weight`), `below` the sum of n over
    smaller order values, `upto` = below + n, `total` the sum of the group.
    `key` is the numeric column that places rows in ranges; it must be the
    first order column or rise with it.
    """
    group, order = list(group), list(order)
    key = key or order[0]
    keep = group + order + ([key] if key not in order else [])
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    one = not group
    if one:
        df, group = df.withColumn("_g", F.lit(0)), ["_g"]
        keep = ["_g"] + keep
    merged = with_ranges(df.groupBy(*keep).agg(amount.alias("n")), group, key, sample_mod, ranges)

    local = W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*group).orderBy("_range")
    totals = (
        merged.groupBy(*group, "_range").agg(F.sum("n").alias("_s"))
        .withColumn("_upto", F.sum("_s").over(across.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("total", F.sum("_s").over(W.partitionBy(*group)))
        .select(*group, "_range", (F.col("_upto") - F.col("_s")).alias("_off"), "total")
    )
    out = (
        _join_groups(merged.withColumn("_l", F.sum("n").over(local)), totals, group + ["_range"])
        .withColumn("upto", F.col("_off") + F.col("_l"))
        .withColumn("below", F.col("upto") - F.col("n"))
    )
    return out.select(*[c for c in keep if c != "_g"], "n", "below", "upto", "total")


def suffix_min(df: DataFrame, group: Sequence[str], order: str, value: str, out: str,
               sample_mod: int = SAMPLE_MOD, ranges: int = RANGES) -> DataFrame:
    """`out` = the least `value` over the rows of the group with order >= own order.

    `order` must be unique within the group.
    """
    group = list(group)
    placed = with_ranges(df, group, order, sample_mod, ranges)
    local = W.partitionBy(*group, "_range").orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy(*group).orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    tail = (
        placed.groupBy(*group, "_range").agg(F.min(value).alias("_m"))
        .withColumn("_tail", F.min("_m").over(later)).drop("_m")
    )
    return (
        _join_groups(placed.withColumn("_l", F.min(value).over(local)), tail, group + ["_range"])
        .withColumn(out, F.least("_l", "_tail"))
        .drop("_l", "_tail", "_range")
    )


def average_rank() -> Column:
    """Average rank of tied rows, from the columns of `cumulative`."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def grouped_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of `probs`."""
    group = list(group)
    cum = cumulative(df.where(F.col(value).isNotNull()), group, [value])
    aggs = [F.max("total").alias("n")]
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        aggs += [
            F.min(F.when(F.col("upto") > F.floor(pos), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("upto") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"),
        ]
    wide = cum.groupBy(*group).agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return wide.select(*group, "n", *cols)
