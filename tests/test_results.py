"""Edges of result tables, tests, labels; distribution functions against tables; IO round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import distributions as ds, labels as lb, stats as sx
from kinfold.operators import diagnostics as di, genotype as ge, phenotype as ph, quality as qu, results as re_, significance as si
from kinfold.session import scratch_path
from kinfold.sources import reports as rp, tables as tb


def one(spark, value, kind, col):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x"))).first()[0]


@pytest.mark.parametrize("t,df,p", [(0.0, 5, 0.5), (2.571, 5, 0.975), (2.262, 9, 0.975), (-1.833, 9, 0.05), (1.96, 10000, 0.975),
                                    (12.706, 1, 0.975), (4.303, 2, 0.975), (2.010, 49, 0.975), (2.042, 30, 0.975)])
def test_student_t(spark, t, df, p):
    got = spark.range(1).select(ds.student_t_cdf(F.lit(t), F.lit(df))).first()[0]
    assert abs(got - p) < 2e-4


def test_chi_square(spark):
    for x, d, p in [(3.841, "1", 0.95), (5.991, "2", 0.95), (0.0, "1", 0.0), (-1.0, "2", 0.0), (3.841, "1.5", 0.5 * 0.95 + 0.5 * (1 - math.exp(-3.841 / 2)))]:
        assert abs(one(spark, x, "double", lambda c: ds.chi2_cdf(c, d)) - p) < 2e-4
    assert one(spark, None, "double", lambda c: ds.chi2_cdf(c, "1")) is None
    p = np.array([0.05, 0.5, 0.95, 0.999])
    assert np.allclose(ds.chi2_quantile(p, 1), [0.00393214, 0.45493642, 3.84145882, 10.82756617], atol=1e-6)
    assert np.allclose(ds.chi2_quantile(p, 2), -2 * np.log(1 - p), atol=1e-8)
    grid = np.concatenate([10.0 ** -np.arange(1, 12), np.linspace(0.001, 0.999999, 500)])
    for df in (0.3, 1, 1.5, 3, 40):
        assert np.allclose(ds.gamma_p(df / 2, ds.chi2_quantile(grid, df) / 2), grid, rtol=1e-9, atol=1e-14)
    assert np.allclose(ds.gamma_p(0.75, ds.chi2_quantile(p, 1.5) / 2), p, atol=1e-10)


@pytest.mark.parametrize("size,label", [(0, "[0,10000]"), (1, "[0,10000]"), (10000, "[0,10000]"), (10001, "(10000,20000]"),
                                        (50000, "(40000,50000]"), (50001, None), (None, None)])
def test_size_bins(spark, size, label):
    assert one(spark, size, "bigint", lb.size_bin) == label


def test_scalars(spark):
    assert [one(spark, v, "double", lb.clamp) for v in (-0.5, 0.4, 1.7, None)] == [0.0, 0.4, 1.0, None]
    assert [one(spark, v, "double", lb.significant_digits) for v in (0.0, 123456.0, 0.00123456, -9.87654)] == [0.0, 123500.0, 0.001235, -9.877]


def test_labels(spark):
    fam = {t: one(spark, t, "string", lb.trait_family) for t in ("ile_AspFam", "asp", "his_GluFam", "ser_SerFam", "tyr_t", "total", "BCAA")}
    assert fam == {"ile_AspFam": "BCAA_pyruvate", "asp": "aspartate", "his_GluFam": "glutamate", "ser_SerFam": "serine",
                   "tyr_t": "aromatic", "total": "total", "BCAA": "BCAA_pyruvate"}
    kinds = {t: one(spark, t, "string", lb.trait_measure) for t in ("ala", "ala_t", "ala_PyrFam")}
    assert kinds == {"ala": "absolute", "ala_t": "relative", "ala_PyrFam": "family"}
    cats = {p: one(spark, p, "string", lb.pathway_category) for p in ("cys_protease", "flavonoids", "aa_transport", "glycolysis")}
    assert cats == {"cys_protease": "protein", "flavonoids": "specialized", "aa_transport": "amino acid", "glycolysis": "primary"}
    assert len(lb.TRAITS) == 65 and len(lb.PATHWAYS) == 32
    df = spark.createDataFrame([("aa_degradation",), ("aa_deg_bcat_haplo",), ("ser_protease",), (None,)], "pathway string")
    got = [r[0] for r in ph.recode_exclude(df, "pathway", lb.PATHWAY_RENAMES, lb.PATHWAY_EXCLUDE).collect()]
    assert got == ["aa_degradation", None]


def test_empirical_p_is_strict(spark):
    null = spark.createDataFrame([("t", "p", v, v) for v in (1.0, 2.0, 2.0, 3.0)] + [("t", "p", None, None)], "trait string, pathway string, share double, lr double")
    obs = spark.createDataFrame([("t", "p", 2.0, None), ("t", "q", 1.0, 1.0)], "trait string, pathway string, share double, lr double")
    got = {r["pathway"]: (r["share_pval"], r["lr_pval"]) for r in si.empirical_p(obs, null).collect()}
    assert got == {"p": (0.25, None), "q": (None, None)}


def test_bh_with_ties_and_null(spark):
    p = [0.01, 0.04, 0.04, 0.9, None]
    df = spark.createDataFrame([("t", f"p{i}", v) for i, v in enumerate(p)], "trait string, pathway string, p double")
    got = {r["pathway"]: r["q"] for r in si.bh_adjust(df, ["trait"], ["pathway"], {"p": "q"}).collect()}
    assert got["p4"] is None
    assert np.allclose([got[f"p{i}"] for i in range(4)], [0.05, 5 / 3 * 0.04, 5 / 3 * 0.04, 1.0])


def test_paired_t(spark):
    a, b = np.array([0.1, 0.4, 0.35, 0.2, 0.5]), np.array([0.15, 0.42, 0.3, 0.33, 0.52])
    df = spark.createDataFrame([("t", "p", float(x), float(y)) for x, y in zip(a, b)] + [("t", "same", 0.1, 0.2)] * 3, "trait string, pathway string, single_pa double, multi_pa double")
    got = {r["pathway"]: r for r in si.paired_t(df).collect()}
    d = a - b
    t = d.mean() / (d.std(ddof=1) / np.sqrt(5))
    assert np.isclose(got["p"]["t"], t) and got["p"]["df"] == 4 and got["p"]["pa_pval"] < 0.5
    same = got["same"]["t"]
    assert same is None or abs(same) > 1e6


def test_constant_predictions(spark):
    df = spark.createDataFrame([("t", 1.0, 2.0), ("t", 1.0, 3.0), ("t", 1.0, None)], "trait string, total double, phenotype double")
    h2 = spark.createDataFrame([("t", 0.0)], "trait string, h2 double")
    row = qu.fold_metrics(df, h2, ["trait"]).first()
    assert row["pa"] is None and row["bias_slope"] is None and row["reliability"] is None and row["mse"] == 2.5 and row["n"] == 2


def test_standard_error_divides_by_all_rows(spark):
    rows = [("ala", 0.1, 1.0, 1.0, 1.0), ("ala", 0.3, 1.0, 1.0, 1.0), ("ala", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "trait string, pa double, reliability double, bias_slope double, mse double")
    assert np.isclose(qu.trait_summary(df).first()["pa_se"], round(np.std([0.1, 0.3], ddof=1) / np.sqrt(3), 4))


def test_audit_with_nulls(spark):
    df = spark.createDataFrame([("t", -1.0, 2.0), ("t", 1.0, -2.0), ("t", 1.0, 2.0), ("t", None, 2.0)], "trait string, sd double, lr double")
    assert tuple(re_.null_audit(df).first()) == ("t", 1, 1, 1)


def test_qq_small_group_offsets(spark):
    df = spark.createDataFrame([("t", float(v)) for v in (3, 1, 1)], "trait string, lr double")
    got = sorted((r["i"], r["sample"], r["theoretical"]) for r in di.qq_points(df, ["trait"]).collect())
    want = [-2 * math.log(1 - (i - 0.375) / 3.25) for i in (1, 2, 3)]
    assert [g[1] for g in got] == [1.0, 1.0, 3.0] and np.allclose([g[2] for g in got], want)
    many = spark.range(25000).select(F.lit("t").alias("trait"), F.lit(1.0).alias("lr"))
    ranks = di.qq_points(many, ["trait"])
    assert ranks.count() == 25000 and ranks.select(F.count_distinct("i"), F.max("i")).first() == (25000, 25000)


def test_qq_chunks_are_dealt_to_many_tasks(spark):
    null = spark.range(200000).select(F.lit("t").alias("trait"), (F.col("id") % 3 + 0.5).alias("lr"))
    points = di.qq_points(null, ["trait"], df=1).where("i % 100 = 0").withColumn("task", F.spark_partition_id())
    tasks = points.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 2000 and len(tasks) > 4 and max(r["n"] for r in tasks) <= 800


def test_histogram_of_constant(spark):
    df = spark.createDataFrame([("t", 1.0)] * 3, "trait string, lr double")
    assert [tuple(r) for r in di.histogram(df, "lr", ["trait"], bins=50).collect()] == [("t", 0, 3)]
    assert [tuple(r) for r in di.histogram(df, "lr", bins=50).collect()] == [(0, 3)]


def test_corr_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(sx.safe_corr("a", "b")).first()[0] is None


def test_balanced_blue_is_the_mean(spark):
    rows = [("t", line, env, float(3 * i + j * j)) for i, line in enumerate("abc") for j, env in enumerate("xyz")]
    got = {r["line"]: r["blue"] for r in ph.blue(spark.createDataFrame(rows, "trait string, line string, population string, value double")).collect()}
    assert np.allclose([got[c] for c in "abc"], [5 / 3, 3 + 5 / 3, 6 + 5 / 3])


def test_blue_reads_the_long_table_once(spark):
    rows = spark.createDataFrame([("t", "a", "x", 1.0), ("t", "b", "y", 2.0), ("t", "a", "y", 4.0)], "trait string, line string, population string, value double")
    plan = ph.blue(rows)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_unbalanced_blue_removes_environment(spark):
    effect, env = {"a": 1.0, "b": 4.0, "c": 9.0}, {"x": 0.0, "y": 100.0}
    rows = [("t", ln, e, effect[ln] + env[e]) for ln, e in [("a", "x"), ("a", "y"), ("b", "x"), ("c", "y"), ("c", "y")]]
    got = {r["line"]: r["blue"] for r in ph.blue(spark.createDataFrame(rows, "trait string, line string, population string, value double")).collect()}
    assert np.isclose(got["b"] - got["a"], 3) and np.isclose(got["c"] - got["a"], 8)


def test_boxcox_lambda(spark):
    rng = np.random.default_rng(8)
    rows = [("log", float(np.exp(v))) for v in rng.normal(size=4000)] + [("sqrt", float((10 + v) ** 2)) for v in rng.normal(size=4000)] + [("log", 0.0)]
    df = spark.createDataFrame(rows, "trait string, value double")
    got = {r["trait"]: r["lambda"] for r in ph.boxcox_lambdas(df).collect()}
    assert abs(got["log"]) <= 0.1 and abs(got["sqrt"] - 0.5) <= 0.5
    assert ph.boxcox(df).where("value = 0 and transformed is null").count() == 1


def test_readers(spark):
    path = scratch_path(spark, "delim")
    spark.createDataFrame([("  1   S1  0 77",), ("2 S2 0 NA",), ("",)], "value string").write.text(path)
    df = tb.read_delim(spark, path, "c int, snp string, d double, p bigint", sep=None, null_values=["NA"])
    assert sorted(map(tuple, df.collect())) == [(1, "S1", 0.0, 77), (2, "S2", 0.0, None)]
    wide = scratch_path(spark, "calls")
    spark.createDataFrame([("banner,x",), ("Chromosome,Positions,X1,X2",), ("1,10,A,G",), ("Mt,5,C,T",)], "value string").coalesce(1).write.text(wide)
    got = sorted(map(tuple, tb.read_calls(spark, wide).collect()))
    assert got == [("1", 10, 0, "X1", "A"), ("1", 10, 1, "X2", "G"), ("Mt", 5, 0, "X1", "C"), ("Mt", 5, 1, "X2", "T")]


def test_call_dosages(spark):
    rows = [("1", 1, list("AAGN")), ("1", 2, list("CTTC")), ("Mt", 3, list("GGGG")), ("X", 4, list("N-??")), ("X", 5, list("TTTA") + ["C"])]
    got = {r["position"]: (r["major"], r["minor"], r["dosages"]) for r in ge.call_dosages(spark.createDataFrame(rows, "chromosome string, position long, calls array<string>")).collect()}
    assert got == {1: ("A", "G", [0, 0, 2, None]), 2: ("C", "T", [0, 2, 2, 0]), 3: ("G", None, [0, 0, 0, 0]),
                   4: (None, None, [None] * 4), 5: ("T", "A", [0, 0, 0, 2, None])}


def test_share_audit_keeps_null_pathways(spark):
    rows = [(None, "Share_K1", -1.0, 0.2), ("skip", "Share_K1", -1.0, 0.2), ("p", "Share_K1", 0.5, -0.1)]
    got = re_.share_audit(spark.createDataFrame(rows, "pathway string, component string, sd double, share double"), ["skip"]).collect()
    assert {r["pathway"]: (r["n_failed"], r["n_negative"]) for r in got} == {None: (1, 0), "p": (0, 1)}


def test_report_sections(spark):
    path = scratch_path(spark, "report")
    lines = [f"k{i} {i}" for i in range(1, 11)] + ["Alt_Likelihood -12.5", "a", "b", "Component Heritability Her_SD", "Her_ALL 0.5 0.1"]
    spark.createDataFrame([("\n".join(lines),)], "value string").write.text(path)
    rep = rp.read_reports(spark, path, "*.txt")
    loglik, comps = rp.parse_fit_reports(rep)
    assert loglik.first()["alt_likelihood"] == -12.5 and tuple(comps.first()[1:]) == ("Her_ALL", 0.5, 0.1)
    assert tuple(rp.report_line(rep, 11).first()[1:]) == ("Alt_Likelihood", -12.5)


def test_pending_and_bundle(spark):
    grid = spark.createDataFrame([(1, "a"), (2, "b")], "g int, t string")
    path = tb.save_bundle({"done": grid.where("g = 1")}, scratch_path(spark, "bundle"))
    done = tb.load_bundle(spark, path, ["done"])["done"]
    assert [tuple(r) for r in tb.pending(grid, done, ["g", "t"]).collect()] == [(2, "b")]
