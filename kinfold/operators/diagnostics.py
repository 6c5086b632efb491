"""Checks of the null distribution and summaries for figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from kinfold.functions.distributions import chi2_cdf, chi2_quantile_column
from kinfold.functions.labels import pathway_category
from kinfold.functions.ranking import cumulative, grouped_quantiles
from kinfold.operators.intervals import complete_grid
from kinfold.operators.phenotype import recode
from kinfold.session import join_sized

DISTS = ["1", "1.5", "2"]
CHUNK = 10000


def ks_distance(null: DataFrame, by=("trait",), value: str = "lr", dists=DISTS) -> DataFrame:
    """Kolmogorov-Smirnov distance to chi-square with df 1, df 2 and their 50:50 mixture ('1.5').

    Works on distinct values with cumulative counts, so ties cost nothing.
    """
    cum = cumulative(null.where(F.col(value).isNotNull()), list(by), [value])
    n = F.col("total").cast("double")
    return cum.groupBy(*by).agg(F.max("total").alias("n"), *[
        F.max(F.greatest(F.col("upto") / n - chi2_cdf(F.col(value), d), chi2_cdf(F.col(value), d) - F.col("below") / n)).alias(
            "d" + d.replace(".", "_"))
        for d in dists
    ])


def chisq_gof(null: DataFrame, by=("trait",), value: str = "lr", bins: int = 20, dists=DISTS) -> DataFrame:
    """Chi-square statistic of observed counts in equal-probability bins of each distribution."""
    long = null.where(F.col(value).isNotNull()).select(*by, F.explode(F.array(*[
        F.struct(F.lit(d).alias("df"), F.least(F.floor(chi2_cdf(F.col(value), d) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
        for d in dists
    ])).alias("_x")).select(*by, "_x.df", "_x.bin")
    counts = long.groupBy(*by, "df", "bin").agg(F.count(F.lit(1)).alias("o"))
    agg = counts.groupBy(*by, "df").agg(
        F.sum("o").alias("n"), F.sum(F.col("o").cast("double") * F.col("o")).alias("oo")
    )
    # sum (o - e)^2 / e over all bins, empty ones included, with e = n / bins
    return agg.select(*by, "df", "n", (F.col("oo") * F.lit(float(bins)) / F.col("n") - F.col("n")).alias("x2"))


def best_fit(ks: DataFrame, by=("trait",)) -> DataFrame:
    """The distribution with the smallest distance; the lower df wins a tie."""
    names = dict(zip(["d1", "d1_5", "d2"], DISTS))
    long = ks.unpivot(list(by), list(names), "name", "d")
    df = recode(F.col("name"), names)
    return long.withColumn("df", df).groupBy(*by).agg(F.min_by("df", F.struct("d", "df")).alias("df"), F.min("d").alias("d"))


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)


def qq_points(null: DataFrame, by: list[str], value: str = "lr", df: float = 2) -> DataFrame:
    """Sorted values against theoretical quantiles, one row per observation.

    Tied values are counted, ranked as one, and spread again in chunks, so that
    neither a hot group nor a hot value sits in one task.
    """
    cum = cumulative(null.where(F.col(value).isNotNull()), by, [value])
    chunks = cum.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.lit(CHUNK)))))
    # a number of tasks is given: a chunk is a short row, and rows so small would be put together in one task
    chunks = chunks.repartition(_tasks(null.sparkSession), *by, value, "_c")
    lo = F.col("below") + F.col("_c") * CHUNK + 1
    hi = F.least(F.col("upto"), F.col("below") + (F.col("_c") + 1) * CHUNK)
    points = chunks.withColumn("i", F.explode(F.sequence(lo, hi)))
    n = F.col("total").cast("double")
    p = F.when(F.col("total") > 10, (F.col("i") - 0.5) / n).otherwise((F.col("i") - 0.375) / (n + 0.25))
    return points.select(*by, "i", F.col(value).alias("sample"), chi2_quantile_column(p, df).alias("theoretical"))


def size_step(size: Column, width: int) -> Column:
    return F.floor(size / F.lit(float(width))).cast("int")


def quantile_curve(null: DataFrame, y: str, tau: float = 0.95, width: int = 1000, by: str = "trait") -> DataFrame:
    """Monotone upper-quantile curve: the quantile per size bin, then its running maximum along size.

    Bins per trait are few (the size range over `width`), so the running
    maximum is a window over bins, not rows. A step curve stands in for a
    monotone smoothing spline; it is not numerically the same.
    """
    binned = null.withColumn("size_bin", size_step(F.col("size"), width))
    q = grouped_quantiles(binned, [by, "size_bin"], y, {"q": tau})
    along = W.partitionBy(by).orderBy("size_bin").rowsBetween(W.unboundedPreceding, 0)
    return q.select(by, "size_bin", "n", "q", F.max("q").over(along).alias("threshold"))


def flag_exceed(null: DataFrame, curve: DataFrame, y: str, width: int = 1000, by: str = "trait") -> DataFrame:
    binned = null.withColumn("size_bin", size_step(F.col("size"), width))
    return join_sized(binned, curve.select(by, "size_bin", "threshold"), [by, "size_bin"], "left").withColumn(
        "exceeds", F.col(y) >= F.col("threshold")
    )


def infinitesimal(df: DataFrame, snps: DataFrame, size: str = "size") -> DataFrame:
    """Expected share if every SNP had the same effect: size over the number of SNPs."""
    m = snps.agg(F.count(F.lit(1)).alias("m"))
    return df.withColumn("expected_share", F.col(size) / m.scalar().cast("double"))


def histogram(df: DataFrame, col: str, by=(), width: float | None = None, bins: int | None = None) -> DataFrame:
    """Counts per bin of fixed width, or in a fixed number of bins between the group's extremes."""
    by, rows = list(by), df.where(F.col(col).isNotNull())
    if width is not None:
        return rows.groupBy(*by, F.floor(F.col(col) / F.lit(float(width))).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    ends = rows.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    joined = join_sized(rows, ends, by) if by else rows.withColumn("_e", ends.select(F.struct("_lo", "_hi")).scalar()).select(*rows.columns, "_e.*")
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    step = F.floor((F.col(col) - F.col("_lo")) / span * bins)
    place = F.when(span.isNull(), F.lit(0)).otherwise(F.least(step, F.lit(bins - 1)))
    return joined.groupBy(*by, place.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and the number of outliers."""
    rows = df.where(F.col(value).isNotNull())
    q = grouped_quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    fenced = join_sized(rows.select(*by, value), q, by).withColumn(
        "_in", F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    )
    return fenced.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(F.col("_in"), F.col(value))).alias("whisker_low"),
        F.max(F.when(F.col("_in"), F.col(value))).alias("whisker_high"),
        F.count_if(~F.col("_in")).alias("n_outliers"),
    )


def snp_locations(sets: DataFrame, lengths: DataFrame) -> DataFrame:
    """Positions in Mb with pathway, category and chromosome labels; every chromosome appears for every pathway."""
    labelled = sets.withColumn("category", pathway_category(F.col("pathway")))
    grid = complete_grid(labelled.select("chromosome", "pathway", "category", "snp_id", "position"), "chromosome", ["pathway", "category"])
    return grid.join(lengths, "chromosome", "left").select(
        "pathway", "category", F.concat(F.lit("chr"), F.col("chromosome").cast("string")).alias("chromosome"),
        "snp_id", (F.col("position") / 1e6).alias("position_mb"), (F.col("length") / 1e6).alias("length_mb"),
    )
