"""Folds, variance models, effects, scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from kinfold.operators import effects as ef, kinship as ki, models as mo
from kinfold.plans import chains, reml_sql
from kinfold.plans.fixtures import Inputs
from kinfold.plans.queries_annotation import all_sets
from kinfold.plans.queries_genotype import set_pieces
from kinfold.plans.registry import query, r, rounded
from kinfold.session import staged

FOLDS = """fo AS (SELECT s_suppkey AS iid, CAST(cv AS INTEGER) AS cv, CAST(ntile({k}) OVER (PARTITION BY cv
    ORDER BY md5('cv|'||cv||'|'||s_suppkey), s_suppkey) AS INTEGER) AS fold FROM supplier, (SELECT unnest(range(1,{reps}+1)) AS cv))"""


def samples(x: Inputs):
    return x.table("supplier").select(F.col("s_suppkey").alias("iid"))


@query("M1", f"WITH {FOLDS.format(k=10, reps=5)} SELECT * FROM fo")
def cv_folds(x):
    return mo.cv_folds(samples(x), 5, 10)


FIT_COLS = ["set_id", "trait", "cv", "fold", "n_train", "loglik", "h2", "h2_sd", "shares", "converged", "iterations", "status"]


@query("M2")
def one_kernel_fits(x):
    return chains.one_kernel(x).select(*FIT_COLS)


@query("M3")
def one_kernel_fold_fits(x):
    data = chains.prepared(x)
    return chains.one_kernel(x, chains.panel_folds(data[1]), full=False, data=data).select(*FIT_COLS)


def told_fits(fits, *keys: str):
    """Likelihood, heritability and total variance, rounded for a comparison."""
    total = F.aggregate("variances", F.lit(0.0), lambda a, v: a + v)
    return fits.select("set_id", "trait", *keys, "n_train", r("loglik", 4).alias("loglik"), r("h2", 3).alias("h2"), r(F.log(total), 4).alias("log_variance"), "status")


@query("M2", reml_sql.FULL_FITS)
def one_kernel_reml(x):
    """The one-kernel fits beside a likelihood search in SQL."""
    return told_fits(chains.one_kernel(x))


@query("M3", reml_sql.with_folds(reml_sql.FOLD_FITS, 5, 10))
def one_kernel_fold_reml(x):
    data = chains.prepared(x)
    return told_fits(chains.one_kernel(x, chains.panel_folds(data[1], 5, 10), full=False, data=data), "cv", "fold")


@query("M10", reml_sql.with_folds(reml_sql.FOLD_PREDICTIONS, 5, 10))
def fold_reml_predictions(x):
    """Predictions of the test samples of every fold, of prices in thousands."""
    data = chains.prepared(x)
    rows = mo.prediction_table(chains.one_kernel(x, chains.panel_folds(data[1], 5, 10), full=False, data=data), data[1])
    return rounded(rows.withColumn("total", F.when(F.col("trait") == "price", F.col("total") / 1000).otherwise(F.col("total"))), 3, "total")


@query("M4")
def two_kernel_fits(x):
    return chains.two_kernel(x).select(*FIT_COLS)


@query("M5")
def two_kernel_fold_fits(x):
    data = chains.prepared(x)
    return chains.two_kernel(x, chains.panel_folds(data[1]), full=False, data=data).select(*FIT_COLS)


@query("M6")
def null_fits(x):
    return chains.null_models(x).select(*FIT_COLS)


HE = """WITH y AS (SELECT iid, trait, (value-avg(value) OVER (PARTITION BY trait))/CASE WHEN trait='price' THEN 1000 ELSE 1 END AS y FROM fx_pheno_long),
    w AS (SELECT set_id, i, j, max(k) FILTER (partition=1) AS k1, max(k) FILTER (partition=2) AS k2 FROM kin_parts WHERE i<j GROUP BY ALL),
    p AS (SELECT w.*, a.trait, a.y*b.y AS yy FROM w JOIN y a ON a.iid=w.i JOIN y b ON b.iid=w.j AND b.trait=a.trait),
    m AS (SELECT set_id, trait, count(*) AS n_pairs, regr_slope(yy,k1) AS s, var_pop(k1) AS c11, var_pop(k2) AS c22, covar_pop(k1,k2) AS c12,
        covar_pop(k1,yy) AS c1y, covar_pop(k2,yy) AS c2y FROM p GROUP BY ALL)
    SELECT set_id, trait, n_pairs, round(s,8) AS var_single, round((c1y*c22-c2y*c12)/(c11*c22-c12*c12),8) AS var_in,
    round((c2y*c11-c1y*c12)/(c11*c22-c12*c12),8) AS var_out FROM m"""


@query("M7", HE)
def moment_fits(x):
    scale = F.when(F.col("trait") == "price", F.col("value") / 1000).otherwise(F.col("value"))
    traits = mo.pheno_arrays(x.pheno_long.withColumn("value", scale), x.panel)
    out = mo.fit_he_pieces(set_pieces(x), traits)
    return rounded(out, 8, "var_single", "var_in", "var_out")


ALPHA = """ym AS (SELECT iid, trait, value-avg(value) OVER (PARTITION BY trait) AS alpha FROM fx_pheno_long),
    c AS (SELECT sum(z*z)/count(DISTINCT iid) AS c FROM zgeno),
    u AS (SELECT ym.trait AS fit_id, z.snp_id, sum(z.z*ym.alpha)/(SELECT c FROM c) AS effect FROM zgeno z JOIN ym ON ym.iid=z.iid GROUP BY ALL)"""


def given_alphas(x: Inputs):
    """Sample weights per trait: the centred phenotype over the kinship scale."""
    means = x.pheno_long.groupBy("trait").agg(F.avg("value").alias("m"))
    centred = x.pheno_long.join(means, "trait").withColumn("v", F.col("value") - F.col("m"))
    scale = ki.mean_diagonal(x.geno)
    rows = mo.pheno_arrays(centred, x.panel, "v").withColumn("c", scale.scalar())
    return rows.select(F.col("trait").alias("fit_id"), F.lit(1).alias("partition"),
                       F.transform("y", lambda v: v / F.col("c")).alias("alpha"))


@query("M8", f"WITH {ALPHA} SELECT fit_id, snp_id, round(effect,7) AS effect FROM u")
def snp_effects(x):
    return mo.snp_effects(x.geno, given_alphas(x)).select("fit_id", "snp_id", r("effect", 7).alias("effect"))


@query("M9", f"""WITH {ALPHA}, {FOLDS.format(k=10, reps=2)}, sc AS (SELECT u.fit_id, z.iid, sum(z.z*u.effect) AS score FROM zgeno z JOIN u ON u.snp_id=z.snp_id GROUP BY ALL)
    SELECT sc.fit_id, sc.iid, round(sc.score,5) AS score, fo.cv, fo.fold FROM sc JOIN fo ON fo.iid=sc.iid""")
def snp_scores(x):
    effects = mo.snp_effects(x.geno, given_alphas(x))
    folds = mo.cv_folds(samples(x), 2, 10)
    return rounded(mo.score(x.geno, effects, x.panel).join(folds, "iid"), 5, "score")


@query("M8")
def fold_snp_effects(x):
    """SNP effects of every training-fold fit with one kernel."""
    data = chains.prepared(x)
    fits = chains.one_kernel(x, chains.panel_folds(data[1]), full=False, data=data)
    return ef.fit_effects(data[0], fits).select("trait", "cv", "fold", "snp_id", "effect")


@query("M8")
def pathway_snp_effects(x):
    """SNP effects of the two-kernel fits: a SNP has that of the part it is in."""
    data = chains.prepared(x)
    sets = staged(all_sets(x).withColumnRenamed("pathway", "set_id"), "sets")
    fits = chains.two_kernel(x, data=data, sets=sets)
    return ef.fit_effects(data[0], fits, sets).select("set_id", "trait", "partition", "snp_id", "effect")


@query("M9")
def fold_scores(x):
    """Genetic scores of the test samples of every training-fold fit."""
    data = chains.prepared(x)
    folds = chains.panel_folds(data[1])
    fits = chains.one_kernel(x, folds, full=False, data=data)
    return ef.fold_scores(data[0], fits, data[1], mo.fold_arrays(folds, data[1])).drop("fit_id", "set_id")


def training_alphas(x: Inputs, fold_rows):
    """Sample weights of every trait and fold: the training phenotypes, centred, over the kinship scale; 0 for test samples."""
    scale = ki.mean_diagonal(x.geno)
    split = fold_rows.select(F.inline("folds")).withColumnRenamed("fold", "of").withColumn("fold", F.explode(F.array_distinct("of")))
    rows = mo.pheno_arrays(x.pheno_long, x.panel).crossJoin(F.broadcast(split)).withColumn("c", scale.scalar())  # folds: repeats x k rows
    return rows.select(
        F.concat_ws("|", "trait", "cv", "fold").alias("fit_id"), "trait", "cv", "fold", F.lit(1).alias("partition"), F.lit(1).alias("parts"),
        F.transform(_centred_training("y", "of", "fold"), lambda v: F.coalesce(v / F.col("c"), F.lit(0.0))).alias("alpha"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _centred_training(y: pa.Array, of: pa.Array, fold: pa.Array) -> pa.Array:
    """A mean beside a lambda is put into it by the optimizer and taken again for every sample; here it is taken once a row."""
    out = []
    for values, folds, own in zip(y, of, fold.to_pylist()):
        v, f = (x.values.to_numpy(zero_copy_only=False).astype(float) for x in (values, folds))
        called = ~np.isnan(v) & ~np.isnan(f) & (f != own)
        out.append(np.where(called, v - v[called].sum() / max(called.sum(), 1), 0.0))
    return pa.array(out, pa.list_(pa.float64()))


@query("M9", f"""WITH {FOLDS.format(k=10, reps=5)}, g AS (SELECT DISTINCT cv, fold FROM fo),
    tr AS (SELECT p.trait, g.cv, g.fold, p.iid, p.value-avg(p.value) OVER (PARTITION BY p.trait, g.cv, g.fold) AS alpha FROM fx_pheno_long p
        JOIN fo ON fo.iid=p.iid JOIN g ON g.cv=fo.cv AND g.fold<>fo.fold),
    c AS (SELECT sum(z*z)/count(DISTINCT iid) AS c FROM zgeno),
    u AS (SELECT tr.trait, tr.cv, tr.fold, z.snp_id, sum(z.z*tr.alpha)/(SELECT c FROM c) AS effect FROM zgeno z JOIN tr ON tr.iid=z.iid GROUP BY ALL)
    SELECT u.trait, u.cv, u.fold, z.iid, round(sum(z.z*u.effect),5) AS score FROM u JOIN fo ON fo.cv=u.cv AND fo.fold=u.fold
    JOIN zgeno z ON z.iid=fo.iid AND z.snp_id=u.snp_id GROUP BY ALL""")
def fold_scores_given(x):
    """Scores of the test samples from effects of given weights of the training samples."""
    fold_rows = staged(mo.fold_arrays(mo.cv_folds(samples(x), 5, 10), x.panel), "folds")
    weights = ef.weight_blocks(training_alphas(x, fold_rows))
    return rounded(ef.score_rows(ef.genotype_blocks(x.geno), weights, x.panel, fold_rows).select("trait", "cv", "fold", "iid", "score"), 5, "score")


@query("M10")
def fold_predictions(x):
    data = chains.prepared(x)
    return mo.prediction_table(chains.one_kernel(x, chains.panel_folds(data[1]), full=False, data=data), data[1])


@query("E1")
def predict_traits(x):
    return chains.predict_traits(x)


@query("E2")
def compare_pathway_models(x):
    return chains.compare_pathway_models(x)


@query("E3")
def pathway_significance(x):
    return chains.pathway_significance(x)
