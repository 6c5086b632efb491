"""End-to-end chains: prediction of traits, pathway models, significance against matched random groups.

Each step of a chain is a table in the shared folder, so a later step reads
columns of a file and a lost session repeats one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.operators import genotype as ge, kinship as ki, models as mo, quality as qu, results as re_, significance as si
from kinfold.plans.fixtures import Inputs
from kinfold.plans.queries_annotation import RANDOM_GROUPS, all_sets, matched_kernels_of
from kinfold.session import staged
from kinfold.sources import tables as tb

COVARIATES = ["pc1", "pc2"]
TRAIT_BLOCKS = 4
REPEATS, FOLDS = 5, 10


def prepared(x: Inputs) -> tuple[DataFrame, DataFrame]:
    """Quality-filtered minor-allele dosages and the surviving panel."""
    geno, panel = ge.qc_filter(x.geno, x.panel)
    return ge.stored(ge.to_minor_dosage(geno), "geno"), panel


def one_kernel(x: Inputs, folds: DataFrame | None = None, full: bool = True, data=None) -> DataFrame:
    geno, panel = data or prepared(x)
    packed = ki.packed_kernels(ki.kinship(geno).withColumn("partition", F.lit(1)))
    return _fit(x, panel, mo.model_kernels(packed), folds, full, by_repeat=folds is not None)


def two_kernel(x: Inputs, folds: DataFrame | None = None, full: bool = True, data=None, sets: DataFrame | None = None) -> DataFrame:
    geno, panel = data or prepared(x)
    sets = staged(all_sets(x).withColumnRenamed("pathway", "set_id"), "sets") if sets is None else sets
    return _fit(x, panel, ki.set_kernels(geno, sets), folds, full)


def panel_folds(panel: DataFrame, repeats: int = REPEATS, k: int = FOLDS) -> DataFrame:
    """Folds of the samples that are left after quality control."""
    return staged(mo.cv_folds(panel.select(F.explode("iids").alias("iid")), repeats, k), "folds")


def null_models(x: Inputs, reps: int = RANDOM_GROUPS, data=None, done: DataFrame | None = None) -> DataFrame:
    """Two-kernel fits of `reps` matched random groups per pathway; groups whose set_id is in `done` are left out."""
    geno, panel = data or prepared(x)
    sets, scopes, outside = matched_kernels_of(x, reps)
    sets = sets if done is None else tb.pending(sets, done, ["set_id"])
    return _fit(x, panel, ki.set_kernels(geno, sets, scopes=scopes, outside=outside), None, True)


def _fit(x: Inputs, panel: DataFrame, kernels: DataFrame, folds: DataFrame | None, full: bool, by_repeat: bool = False) -> DataFrame:
    traits = mo.pheno_arrays(x.pheno_long, panel)
    grid = mo.model_grid(kernels, traits, 1 if by_repeat else TRAIT_BLOCKS)
    covar = mo.covariate_arrays(x.covariates(2), panel, COVARIATES)
    return mo.fit_variance(grid, covar, mo.fold_arrays(folds, panel) if folds is not None else None, full, by_repeat=by_repeat)


def _observed(x: Inputs, preds: DataFrame, folds: DataFrame) -> DataFrame:
    """Test-fold predictions beside the phenotypes."""
    fam = F.lit("family").alias("fid")
    pheno = x.pheno_long.select(fam, "iid", "trait", F.col("value").alias("phenotype"))
    named = preds.withColumnRenamed("cv", "cvnum").withColumn("fid", F.lit("family"))
    split = folds.select(fam, "iid", F.col("cv").alias("cvnum"), "fold")
    return re_.test_predictions(pheno, named, split)


def _h2(fits: DataFrame) -> DataFrame:
    return fits.where(F.col("cv").isNull()).select("trait", "h2")


def predict_traits(x: Inputs, repeats: int = REPEATS, k: int = FOLDS) -> DataFrame:
    """Quality control, kinship, folds, one-kernel fits, test predictions, metrics per trait."""
    data = prepared(x)
    folds = panel_folds(data[1], repeats, k)
    fits = staged(one_kernel(x, folds, data=data), "fits")
    observed = _observed(x, mo.prediction_table(fits, data[1]), folds)
    return qu.trait_summary(qu.fold_metrics(observed, _h2(fits), ["trait", "cvnum", "fold"]))


def compare_pathway_models(x: Inputs, repeats: int = REPEATS, k: int = FOLDS) -> DataFrame:
    """Two-kernel against one-kernel prediction, per trait and pathway."""
    data = prepared(x)
    folds = panel_folds(data[1], repeats, k)
    one = staged(one_kernel(x, folds, data=data), "one")
    two = staged(two_kernel(x, folds, full=False, data=data), "two")
    single = qu.fold_metrics(_observed(x, mo.prediction_table(one, data[1]), folds), _h2(one), ["trait", "cvnum", "fold"])
    named = mo.prediction_table(two, data[1]).withColumnRenamed("set_id", "pathway")
    multi = qu.fold_metrics(_observed(x, named, folds), _h2(one), ["trait", "pathway", "cvnum", "fold"])
    return qu.mean_differences(qu.compare_models(single, multi))


def pathway_significance(x: Inputs, reps: int = RANDOM_GROUPS) -> DataFrame:
    """Share and likelihood ratio of every pathway against its matched random groups, with FDR."""
    data = prepared(x)
    one = staged(one_kernel(x, data=data), "one")
    base = one.select("trait", F.col("loglik").alias("gblup_llik"))

    def ratios(fits: DataFrame) -> DataFrame:
        rows = fits.where(F.col("loglik").isNotNull()).select(
            "set_id", "trait", F.col("loglik").alias("null_llik"), F.get("shares", 0).alias("share")
        )
        return re_.likelihood_ratio(rows, base)

    observed = ratios(staged(two_kernel(x, data=data), "two")).withColumnRenamed("set_id", "pathway")
    null = ratios(staged(null_models(x, reps, data), "null"))
    null = null.withColumn("pathway", F.split_part("set_id", F.lit("|"), F.lit(1)))
    pvals = staged(si.empirical_p(observed, null), "pvals")
    return si.bh_adjust(pvals, ["trait"], ["pathway"], {"share_pval": "h2_fdr", "lr_pval": "lr_fdr"})
