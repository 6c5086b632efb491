"""Folds, likelihoods, effects, predictions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import kinship as ki, models as mo, reml
from kinfold.plans import queries_models

N, M = 120, 300


def reml_loglik(y, w, kernels, s):
    v = s[-1] * np.eye(len(y)) + sum(x * k for x, k in zip(s, kernels))
    vi = np.linalg.inv(v)
    wvw = w.T @ vi @ w
    p = vi - vi @ w @ np.linalg.inv(wvw) @ w.T @ vi
    return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(wvw)[1] + y @ p @ y + (len(y) - w.shape[1]) * np.log(2 * np.pi)), p


@pytest.fixture(scope="module")
def simulated():
    rng = np.random.default_rng(11)
    x = (rng.random((M, N)) < 0.3).astype(float) * 2
    z = x - x.mean(axis=1, keepdims=True)
    inside = np.arange(M) < 60
    kernels = [z[s].T @ z[s] / (np.trace(z[s].T @ z[s]) / N) for s in (inside, ~inside)]
    w = np.column_stack([np.ones(N), rng.normal(size=N)])
    g = np.linalg.cholesky(2.0 * kernels[0] + 0.5 * kernels[1] + 1e-9 * np.eye(N)) @ rng.normal(size=N)
    y = w @ [3.0, 1.0] + g + rng.normal(size=N) * 0.5
    return x, z, kernels, w, y


def test_one_kernel_is_the_maximum(simulated):
    _, z, _, w, y = simulated
    k = z.T @ z / (np.trace(z.T @ z) / N)
    fit = reml.fit_one(y, reml.Basis(w, [k]))
    best, p = reml_loglik(y, w, [k], fit.variances)
    assert fit.converged and np.isclose(fit.loglik, best) and np.allclose(p @ y, fit.py)
    for f in (0.9, 1.1):
        for i in range(2):
            s = fit.variances.copy()
            s[i] *= f
            assert reml_loglik(y, w, [k], s)[0] <= best + 1e-9


def test_two_kernels_are_the_maximum(simulated):
    _, _, kernels, w, y = simulated
    fit = reml.fit_many(y, reml.Basis(w, kernels))
    best, p = reml_loglik(y, w, kernels, fit.variances)
    assert fit.converged and np.isclose(fit.loglik, best) and np.allclose(p @ y, fit.py)
    for f in (0.9, 1.1):
        for i in range(3):
            s = fit.variances.copy()
            s[i] *= f
            assert reml_loglik(y, w, kernels, s)[0] <= best + 1e-6
    vi = np.linalg.inv(fit.variances[2] * np.eye(N) + fit.variances[0] * kernels[0] + fit.variances[1] * kernels[1])
    assert np.allclose(fit.theta, np.linalg.solve(w.T @ vi @ w, w.T @ vi @ y))


def test_nested_models_agree(simulated):
    """Twice the same kernel adds nothing: equal likelihood, shares sum to one."""
    _, _, kernels, w, y = simulated
    one = reml.fit_one(y, reml.Basis(w, kernels[:1]))
    two = reml.fit_many(y, reml.Basis(w, [kernels[0], kernels[0]]))
    assert abs(one.loglik - two.loglik) < 1e-3


def test_recovers_heritability():
    rng = np.random.default_rng(0)
    n = 400
    z = rng.normal(size=(600, n))
    k = z.T @ z / 600
    root = np.linalg.cholesky(k + 1e-9 * np.eye(n))
    got = []
    for _ in range(10):
        y = root @ rng.normal(size=n) * np.sqrt(0.6) + rng.normal(size=n) * np.sqrt(0.4)
        s = reml.fit_one(y, reml.Basis(np.ones((n, 1)), [k])).variances
        got.append(s[0] / s.sum())
    assert abs(np.mean(got) - 0.6) < 0.08


def test_sd_of_one_kernel_matches_the_general_form(simulated):
    _, z, _, w, y = simulated
    basis = reml.Basis(w, [z.T @ z / (np.trace(z.T @ z) / N)])
    one, many = reml.fit_one(y, basis), reml.fit_many(y, basis)
    assert np.allclose(one.variances, many.variances, rtol=1e-2)
    assert np.isclose(reml.ratio_sd(one, np.array([1.0, 0.0]), np.ones(2)), reml.ratio_sd(many, np.array([1.0, 0.0]), np.ones(2)), rtol=2e-2)


def test_null_trait_sits_at_the_boundary(simulated):
    _, _, kernels, w, _ = simulated
    y = np.random.default_rng(5).normal(size=N)
    fit = reml.fit_many(y, reml.Basis(w, kernels))
    assert (fit.variances >= 0).all() and np.isfinite(fit.loglik)


@pytest.fixture(scope="module")
def tables(spark, simulated):
    x, _, _, w, y = simulated
    rows = [(f"S{j}", [int(v) for v in x[j]]) for j in range(M)]
    geno = spark.createDataFrame(rows, "snp_id string, dosages array<tinyint>").repartition(4)
    panel = spark.createDataFrame([(list(range(N)),)], "iids array<bigint>")
    values = [None if i == 7 else float(v) for i, v in enumerate(y)]
    long = spark.createDataFrame([(i, "t1", v) for i, v in enumerate(values)] + [(i, "flat", 1.0) for i in range(N)],
                                 "iid long, trait string, value double")
    covar = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w[:, 1])], "iid long, pc1 double")
    sets = spark.createDataFrame([("in", f"S{j}") for j in range(60)], "set_id string, snp_id string")
    return geno, panel, long, covar, sets


def test_grid_scores_and_predictions(spark, simulated, tables):
    x, _, kernels, w, y = simulated
    geno, panel, long, covar, sets = tables
    packed = ki.packed_kernels(ki.partition_kinship(geno, sets))
    grid = mo.model_grid(mo.model_kernels(packed), mo.pheno_arrays(long, panel), blocks=2)
    folds = mo.cv_folds(panel.select(F.explode("iids").alias("iid")), 1, 4)
    fits = mo.fit_variance(grid, mo.covariate_arrays(covar, panel, ["pc1"]), mo.fold_arrays(folds, panel)).persist()
    rows = fits.collect()
    assert len(rows) == 2 * 5
    assert all(r["status"].startswith("error") for r in rows if r["trait"] == "flat")
    whole = next(r for r in rows if r["trait"] == "t1" and r["cv"] is None)
    keep = np.arange(N) != 7
    direct = reml.fit_many(y[keep], reml.Basis(w[keep], [k[np.ix_(keep, keep)] for k in kernels]))
    assert np.isclose(whole["loglik"], direct.loglik, atol=1e-5) and np.isclose(sum(whole["shares"]), 1)

    preds = {(r["fold"], r["iid"]): r["total"] for r in mo.prediction_table(fits, panel).collect()}
    assert len(preds) == N  # every sample is a test sample once
    # SNP effects, kept per partition, scored on the panel, give the genetic part of the prediction
    alphas = mo.alpha_table(fits.where("cv is not null"))
    for width in (256, 2):  # all fits in one block, and in several
        effects = mo.keep_partition(mo.snp_effects(geno, alphas), alphas, sets)
        scores = mo.score(geno, effects.select("fit_id", "snp_id", "effect"), panel, width).collect()
        theta = {f"in|t1|1|{r['fold']}": np.array(r["theta"]) for r in rows if r["trait"] == "t1" and r["cv"]}
        seen = 0
        for r in scores:
            key = (int(r["fit_id"].split("|")[3]), r["iid"])
            if key in preds:
                assert np.isclose(r["score"] + w[r["iid"]] @ theta[r["fit_id"]], preds[key], atol=1e-6)
                seen += 1
        assert seen == N
    comps = mo.component_table(fits.where("cv is null and trait = 't1'")).collect()
    assert {c["component"] for c in comps} == {"Her_ALL", "Share_K1", "Share_K2"}


def test_a_set_of_all_snps_has_an_empty_complement(spark, tables):
    geno, panel, long, covar, _ = tables
    everything = geno.select(F.lit("all").alias("set_id"), "snp_id")
    long_form = ki.partition_kinship(geno, everything)
    assert long_form.where("partition = 2 and k is not null").count() == 0
    rows = []
    for kernels in (ki.set_kernels(geno, everything), mo.model_kernels(ki.packed_kernels(long_form))):
        grid = mo.model_grid(kernels, mo.pheno_arrays(long.where("trait = 't1'"), panel))
        rows.append(mo.fit_variance(grid, mo.covariate_arrays(covar, panel, ["pc1"])).first())
    one = mo.model_kernels(ki.packed_kernels(ki.kinship(geno).withColumn("partition", F.lit(1))))
    single = mo.fit_variance(mo.model_grid(one, mo.pheno_arrays(long.where("trait = 't1'"), panel)), mo.covariate_arrays(covar, panel, ["pc1"])).first()
    for r in rows:
        assert r["status"] == "ok" and np.isclose(r["loglik"], single["loglik"]) and r["shares"] == [1.0, 0.0]
        assert r["variances"][1] == 0 and r["scales"][1] == 0


def test_only_failed_fits_become_a_status():
    n = 30
    splits = [(None, None, np.zeros(n, bool))]
    rows = list(mo._fit_rows("s", [("t", np.zeros(n))], np.ones((n, 1)), [np.eye(n)], [1.0], splits, 5, 5, True))
    assert "constant" in rows[0]["status"]
    with pytest.raises(TypeError):  # a defect ends the job
        list(mo._fit_rows("s", [("t", np.arange(n, dtype=float))], np.ones((n, 1)), [None], [1.0], splits, 5, 5, True))


def test_folds(spark):
    ids = spark.range(103).select(F.col("id").alias("iid"))
    got = mo.cv_folds(ids, 5, 10).toPandas()
    assert len(got) == 515 and got.groupby("cv")["iid"].nunique().eq(103).all()
    sizes = got.groupby(["cv", "fold"]).size()
    assert len(sizes) == 50 and sizes.max() - sizes.min() == 1
    wide = got.pivot(index="iid", columns="cv", values="fold")
    assert all(not wide[a].equals(wide[b]) for a in wide for b in wide if a < b)
    few = mo.cv_folds(spark.range(4).select(F.col("id").alias("iid")), 1, 10).toPandas()
    assert sorted(few["fold"]) == [1, 2, 3, 4]


def test_moment_estimate_is_least_squares(spark, simulated, tables):
    _, _, kernels, _, y = simulated
    geno, panel, long, _, sets = tables
    full = long.where("trait = 't1' and value is not null")
    pairs = ki.name_samples(ki.partition_kinship(geno, sets), panel)
    got = mo.fit_he(pairs, full).first()
    keep = [i for i in range(N) if i != 7]
    c = y - y[keep].mean()
    i, j = np.triu_indices(N, 1)
    ok = (i != 7) & (j != 7)
    i, j = i[ok], j[ok]
    design = np.column_stack([np.ones(len(i)), kernels[0][i, j], kernels[1][i, j]])
    beta = np.linalg.lstsq(design, c[i] * c[j], rcond=None)[0]
    assert np.allclose([got["var_in"], got["var_out"]], beta[1:]) and got["n_pairs"] == len(i)


def test_moment_estimates_of_pieces(spark, tables):
    """the sums of the pieces are those of whole kernels, also for a set without a complement and missing values."""
    geno, panel, long, _, sets = tables
    sets = sets.unionByName(geno.select(F.lit("every").alias("set_id"), "snp_id"))
    traits = mo.pheno_arrays(long, panel)
    want = {(r["set_id"], r["trait"]): r for r in mo.fit_he_packed(ki.set_kernels(geno, sets), traits).collect()}
    got = {(r["set_id"], r["trait"]): r for r in mo.fit_he_pieces(ki.kernel_pieces(geno, sets, piece=100, band_bytes=20_000), traits).collect()}
    assert got.keys() == want.keys() and ("every", "t1") in got
    for key, row in want.items():
        assert got[key]["n_pairs"] == row["n_pairs"]
        for name in ("var_single", "var_in", "var_out"):
            assert got[key][name] == row[name] or np.isclose(got[key][name], row[name])


def test_queries_take_the_counts_of_an_analysis(spark, monkeypatch):
    """The registered chains draw 1,000 random groups a pathway and 5 repeats of 10 folds."""
    import __spark_entry__ as entry
    from kinfold.plans import chains

    counts = []

    class Drawn(Exception):
        pass

    def draw(x, reps):
        counts.append(reps)
        raise Drawn

    monkeypatch.setattr(chains, "matched_kernels_of", draw)
    for name in ("null_fits", "pathway_significance"):
        with pytest.raises(Drawn):
            entry.queries()[name](spark, entry.SMOKE_DIR)
    assert counts == [1000, 1000]
    for name in ("one_kernel_fold_fits", "two_kernel_fold_fits", "fold_predictions"):
        assert entry.queries()[name](spark, entry.SMOKE_DIR).select("cv", "fold").distinct().count() == 50


def test_training_weights_take_a_mean_once_a_row(spark):
    rows = [([1.0, None, 3.0, 8.0], [1, 1, 2, 1], 2), ([1.0, 2.0, 3.0, 8.0], [1, None, 2, 1], 1)]
    df = spark.createDataFrame(rows, "y array<double>, of array<int>, fold int").coalesce(1)
    out = df.select("fold", queries_models._centred_training("y", "of", "fold").alias("v"))
    assert {r["fold"]: r["v"] for r in out.collect()} == {2: [-3.5, 0.0, 0.0, 3.5], 1: [0.0, 0.0, 0.0, 0.0]}
