"""From fit reports to result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.functions.labels import clamp, size_bin


def heritability(components: DataFrame, names: list[str]) -> DataFrame:
    return components.where(F.coalesce(F.col("component").isin(names), F.lit(False)))


def loglik(report: DataFrame, out: str, keys: list[str], value: str = "x1", name: str = "Alt_Likelihood") -> DataFrame:
    """Log-likelihood rows of key/value reports; text that is no number becomes NULL."""
    return report.where(F.col("key").eqNullSafe(F.lit(name))).select(*keys, F.col(value).try_cast("double").alias(out))


def test_predictions(pheno: DataFrame, preds: DataFrame, folds: DataFrame) -> DataFrame:
    """Phenotypes with their predictions (kept without one), then only the test samples of each fold.

    The inner join on the fold columns also drops phenotypes without a prediction.
    """
    joined = pheno.join(preds, ["fid", "iid", "trait"], "left")
    return joined.join(folds, ["fid", "iid", "cvnum", "fold"], "inner")


def likelihood_ratio(multi: DataFrame, single: DataFrame, on=("trait",), alt2: str = "null_llik", alt1: str = "gblup_llik") -> DataFrame:
    return multi.join(single, list(on), "left").withColumn("lr", F.lit(2.0) * (F.col(alt2) - F.col(alt1)))


def with_size_bin(df: DataFrame, size: str = "size", width: int = 10000, top: int = 50000) -> DataFrame:
    return df.withColumn("group_size", size_bin(F.col(size), width, top))


def null_results(lr: DataFrame, shares: DataFrame, sizes: DataFrame, keys: list[str], size_keys: list[str]) -> DataFrame:
    """LR with shares and group sizes; rows without a match stay."""
    return lr.join(shares.join(sizes, size_keys, "left"), keys, "left")


def null_audit(null: DataFrame) -> DataFrame:
    """Per trait: usable groups, failed fits (negative SD), negative LR; a NULL condition counts as neither."""
    bad = (F.col("sd") < 0) | (F.col("lr") < 0)
    return null.groupBy("trait").agg(
        F.sum(F.when(bad, 0).when(~bad, 1)).alias("n_groups"),
        F.sum(F.when(F.col("sd") < 0, 1).when(F.col("sd") >= 0, 0)).alias("n_failed"),
        F.sum(F.when(F.col("lr") < 0, 1).when(F.col("lr") >= 0, 0)).alias("n_negative_lr"),
    )


def share_audit(shares: DataFrame, exclude: list[str], component: str = "Share_K1") -> DataFrame:
    """Failed and negative shares per pathway."""
    kept = F.coalesce(~F.col("pathway").isin(exclude), F.lit(True))  # a NULL pathway is not an excluded one
    rows = shares.where((F.col("component") == component) & kept)
    rows = rows.where((F.col("sd") < 0) | (F.col("share") < 0))
    return rows.groupBy("pathway").agg(
        F.count_if(F.col("sd") < 0).alias("n_failed"), F.count_if(F.col("share") < 0).alias("n_negative")
    )


def clamp_shares(df: DataFrame, col: str = "share") -> DataFrame:
    return df.withColumn(col, clamp(F.col(col)))


def usable_null(null: DataFrame, component: str = "Share_K1", drop_nonconverged: bool = True) -> DataFrame:
    rows = null.where(F.col("component") == component)
    return rows.where((F.col("sd") > 0) & (F.col("lr") >= 0)) if drop_nonconverged else rows


def null_ranges(null: DataFrame, cols=("n_genes", "n_snps")) -> DataFrame:
    return null.groupBy("pathway").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in cols for f in (F.min, F.max)])
