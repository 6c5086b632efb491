"""Fits without kernels beside the dense ones, and fold fits from one decomposition beside direct ones."""

import numpy as np
import pytest
from kinfold.operators import kinship as ki, large_reml as lr, models as mo, reml
from pyspark.sql import functions as F

N, M = 60, 240


def panel_of(rng, n, m):
    freq = rng.uniform(0.1, 0.9, m)
    return np.where(rng.random((m, n)) < freq[:, None], 2, 0).astype(np.int8)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(4)
    x = panel_of(rng, N, M)
    z = x - x.mean(axis=1, keepdims=True)
    w = rng.normal(size=N)
    ys = {"a": z[:80].T @ rng.normal(size=80) * 0.3 + 2 * w + rng.normal(size=N), "b": rng.normal(size=N), "c": z.T @ rng.normal(size=M) + 0.1 * rng.normal(size=N)}
    geno = spark.createDataFrame([(f"S{j}", [None if (i + j) % 37 == 0 else int(v) for i, v in enumerate(x[j])]) for j in range(M)],
                                 "snp_id string, dosages array<tinyint>").repartition(3)
    panel = spark.createDataFrame([(list(range(N)),)], "iids array<bigint>")
    long = spark.createDataFrame([(i, t, None if i == 7 and t == "a" else float(v)) for t, y in ys.items() for i, v in enumerate(y)] + [(i, "flat", 1.0) for i in range(N)],
                                 "iid long, trait string, value double")
    covar = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "iid long, pc1 double")
    sets = spark.createDataFrame([("s", f"S{j}") for j in range(80)] + [("t", f"S{j}") for j in range(60, 200)], "set_id string, snp_id string")
    folds = mo.cv_folds(panel.select(F.explode("iids").alias("iid")), 1, 3)
    return geno, mo.pheno_arrays(long, panel), mo.covariate_arrays(covar, panel, ["pc1"]), mo.fold_arrays(folds, panel), sets


def by_key(df):
    return {(r["set_id"], r["trait"], r["cv"], r["fold"]): r for r in df.collect()}


def alike(got, want, loglik, rest):
    assert got.keys() == want.keys()
    for key, a in got.items():
        b = want[key]
        if b["status"].startswith("error"):
            assert a["status"] == b["status"]
            continue
        assert a["n_train"] == b["n_train"] and a["pred_i"] == b["pred_i"] and np.allclose(a["scales"], b["scales"])
        assert abs(a["loglik"] - b["loglik"]) < loglik, key
        total = sum(b["variances"])
        assert np.allclose(np.array(a["variances"]) / total, np.array(b["variances"]) / total, atol=rest), key
        size = np.abs(b["py"]).max()
        assert np.allclose(np.array(a["py"]) / size, np.array(b["py"]) / size, atol=5 * rest) and np.allclose(a["theta"], b["theta"], atol=10 * rest)
        assert np.allclose(a["pred"], b["pred"], atol=10 * rest * np.abs(b["theta"]).max()), key


def test_one_kernel_with_a_full_basis_of_probes(small):
    geno, traits, covar, folds, _ = small
    packed = ki.packed_kernels(ki.kinship(geno).withColumn("partition", F.lit(1)))
    want = by_key(mo.fit_variance(mo.model_grid(mo.model_kernels(packed), traits), covar, folds, cv_iterations=500))
    got = by_key(lr.fit_variance_large(geno, traits, covar, folds, probes=N))
    alike(got, want, 1e-6, 1e-4)
    assert all(r["loglik_se"] == 0 for r in got.values() if r["status"] == "ok")
    for key, r in got.items():
        if r["status"] == "ok" and want[key]["h2_sd"] > 0:
            assert abs(r["h2_sd"] / want[key]["h2_sd"] - 1) < 1e-2


def test_two_kernels_with_a_full_basis_of_probes(small):
    geno, traits, covar, _, sets = small
    sets, traits = sets.where("set_id = 't'"), traits.where("trait IN ('b', 'flat')")
    want = by_key(mo.fit_variance(mo.model_grid(ki.set_kernels(geno, sets), traits), covar))
    got = by_key(lr.fit_variance_large(geno, traits, covar, sets=sets, probes=N))
    alike(got, want, 1e-3, 2e-2)


def test_probes_within_their_stated_error(spark):
    """1,000 samples: likelihoods within four standard errors, heritability within half of its own deviation."""
    rng = np.random.default_rng(8)
    n, m = 1000, 2000
    x = panel_of(rng, n, m)
    z = x - x.mean(axis=1, keepdims=True)
    signal = z.T @ rng.normal(size=m)
    y = signal / signal.std() + rng.normal(size=n)
    geno = spark.createDataFrame([(f"S{j}", x[j].tolist()) for j in range(m)], "snp_id string, dosages array<tinyint>").repartition(8)
    traits = spark.createDataFrame([("a", y.tolist())], "trait string, y array<double>")
    k = z.T @ z
    k /= np.trace(k) / n
    want = reml.fit_one(y, reml.Basis(np.ones((n, 1)), [k]))
    got = lr.fit_variance_large(geno, traits, probes=48).first()
    assert got["status"] == "ok" and 0 < got["loglik_se"] < 5 and abs(got["loglik"] - want.loglik) < 4 * got["loglik_se"]
    assert abs(got["h2"] - want.variances[0] / want.variances.sum()) < got["h2_sd"] / 2


def test_no_pair_of_samples_in_the_plan(small):
    geno, *_ = small
    blocks = lr.snp_blocks(geno)
    a, _ = lr.products(blocks, np.eye(N)[:, :2], np.array([-1, -1]))
    long = {(r["i"], r["j"]): r["a"] for r in ki.gram(geno).collect()}
    assert np.allclose(a[:, 0], [long[0, j] for j in range(N)]) and blocks.passes == 1
    assert blocks.table.schema.names == ["rows", "x", "at", "number"] and blocks.table.count() >= 1


@pytest.mark.parametrize("n, left_out", [(40, 1), (60, 20), (200, 20)])
def test_folds_from_one_decomposition(n, left_out):
    rng = np.random.default_rng(n)
    z = rng.normal(size=(150, n))
    k = z.T @ z / 150
    w = np.column_stack([np.ones(n), rng.normal(size=n)])
    ys = [np.sqrt(h) * z.T @ rng.normal(size=150) / 12 + np.sqrt(1 - h) * rng.normal(size=n) for h in (0, 0.4, 0.99)]
    out = np.zeros(n, bool)
    out[rng.choice(n, left_out, replace=False)] = True
    basis = reml.Basis(w[~out], [k[np.ix_(~out, ~out)]])
    for got, y in zip(reml.FoldBasis(w, k).fit(ys, out), ys):
        want = reml.fit_one(y[~out], basis)
        assert got.converged and abs(got.loglik - want.loglik) < 1e-8 * abs(want.loglik)
        assert np.allclose(got.variances, want.variances, rtol=1e-5, atol=1e-6) and np.allclose(got.theta, want.theta, atol=1e-6)
        assert np.allclose(got.py, want.py, atol=1e-5 * np.abs(want.py).max()) and np.allclose(got.covariance, want.covariance, rtol=1e-4)


def test_folds_by_repeat(small):
    """A task a repeat gives the same fits, and the whole-sample fit once."""
    geno, traits, covar, folds, _ = small
    grid = mo.model_grid(mo.model_kernels(ki.packed_kernels(ki.kinship(geno).withColumn("partition", F.lit(1)))), traits)
    want, got = (by_key(mo.fit_variance(grid, covar, folds, by_repeat=b)) for b in (False, True))
    assert got.keys() == want.keys() and all(got[k]["loglik"] == want[k]["loglik"] for k in want)
