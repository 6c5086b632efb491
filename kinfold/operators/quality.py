"""Prediction quality. Every statistic is a map-side combined aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.functions.labels import FAMILY_ORDER, label_rank
from kinfold.functions.ranking import cumulative, grouped_quantiles
from kinfold.functions.stats import safe_corr
from kinfold.operators.phenotype import classify_trait
from kinfold.session import join_sized

FOLD = ["cvnum", "fold"]


def _safe_slope(y: Column, x: Column) -> Column:
    a = F.when(y.isNotNull(), x)
    return F.when(F.min(a) < F.max(a), F.regr_slope(y, x))


def fold_metrics(preds: DataFrame, h2: DataFrame, by: list[str], total: str = "total", phenotype: str = "phenotype",
                 h2_on=("trait",)) -> DataFrame:
    """Accuracy, reliability (r2 / h2), calibration slope and mean squared error per group."""
    y, x = F.col(phenotype), F.col(total)
    stats = preds.where(y.isNotNull()).groupBy(*by).agg(
        safe_corr(x, y).alias("pa"), _safe_slope(y, x).alias("bias_slope"), F.avg((y - x) * (y - x)).alias("mse"),
        F.count(F.lit(1)).alias("n"),
    )
    return stats.join(h2, list(h2_on), "left").withColumn(
        "reliability", F.col("pa") * F.col("pa") / F.nullif(F.col("h2"), F.lit(0.0))
    )


def trait_summary(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """Means and standard errors over folds per trait; the error divides by all rows, missing ones too."""
    cols = ["pa", "reliability", "bias_slope", "mse"]
    rows = F.sqrt(F.count(F.lit(1)).cast("double"))
    out = metrics.groupBy("trait").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], *[(F.stddev_samp(c) / rows).alias(f"{c}_se") for c in cols]
    ).withColumn("rmse", F.sqrt("mse_mean"))
    kept = ["pa_mean", "pa_se", "reliability_mean", "reliability_se", "bias_slope_mean", "mse_mean", "rmse"]
    labelled = classify_trait(out)
    return labelled.orderBy("aa_cat", label_rank(F.col("family"), FAMILY_ORDER), "trait").select(
        "aa_cat", "family", "trait", *[F.bround(c, digits).alias(c) for c in kept]
    )


def compare_models(single: DataFrame, multi: DataFrame, exclude: list[str] = (), keys=("trait", "cvnum", "fold")) -> DataFrame:
    """Two-kernel minus one-kernel statistics per trait, pathway and fold."""
    names = ["pa", "reliability", "bias_slope", "mse"]
    a = single.select(*keys, *[F.col(c).alias(f"single_{c}") for c in names])
    b = multi.select(*keys, "pathway", *[F.col(c).alias(f"multi_{c}") for c in names])
    gap = lambda c: F.abs(F.col(c) - 1)
    return (
        a.join(b, list(keys), "left").where(~F.coalesce(F.col("pathway").isin(list(exclude)), F.lit(False)))
        .select(
            "trait", "pathway", *[k for k in keys if k != "trait"],
            (F.col("multi_pa") - F.col("single_pa")).alias("pa_diff"),
            (F.col("multi_reliability") - F.col("single_reliability")).alias("reliability_diff"),
            "single_bias_slope", "multi_bias_slope",
            (gap("multi_bias_slope") - gap("single_bias_slope")).alias("bias_slope_diff"),
            "single_mse", "multi_mse", (F.col("multi_mse") - F.col("single_mse")).alias("mse_diff"),
        )
    )


def mean_differences(cmp: DataFrame) -> DataFrame:
    cols = ["pa_diff", "reliability_diff", "single_bias_slope", "multi_bias_slope", "bias_slope_diff", "single_mse",
            "multi_mse", "mse_diff"]
    out = cmp.groupBy("trait", "pathway").agg(*[F.avg(c).alias(c) for c in cols])
    return out.withColumn("single_rmse", F.sqrt("single_mse")).withColumn("multi_rmse", F.sqrt("multi_mse")).withColumn(
        "rmse_diff", F.col("multi_rmse") - F.col("single_rmse")
    )


def calibration(preds: DataFrame, by: list[str], total: str = "total", phenotype: str = "phenotype") -> DataFrame:
    y, x = F.col(phenotype), F.col(total)
    varies = F.min(F.when(y.isNotNull(), x)) < F.max(F.when(y.isNotNull(), x))
    return preds.groupBy(*by).agg(
        F.when(varies, F.regr_slope(y, x)).alias("slope"), F.when(varies, F.regr_intercept(y, x)).alias("intercept"),
        F.regr_count(y, x).alias("n"),
    )


def having_mean(df: DataFrame, key: str, col: str, above: float) -> DataFrame:
    """All rows of the keys whose mean exceeds a limit: aggregate and semi join, no window over a whole key."""
    keys = df.groupBy(key).agg(F.avg(col).alias("_m")).where(F.col("_m") > above)
    return join_sized(df, keys.select(key), [key], "left_semi")


def order_by_stat(df: DataFrame, key: str, col: str) -> DataFrame:
    """Keys ranked by decreasing median; equal medians share a rank."""
    med = grouped_quantiles(df, [key], col, {"median": 0.5})
    med = med.withColumn("_neg", -F.col("median"))
    steps = cumulative(med.select("_neg").distinct(), [], ["_neg"])
    return med.join(steps.select("_neg", F.col("upto").cast("int").alias("position")), "_neg").select(
        key, "median", "position"
    )


def melt_metrics(metrics: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    return metrics.unpivot(ids, cols, "statistic", "measurement")
