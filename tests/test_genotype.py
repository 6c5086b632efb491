"""Quality control, kinship, structure against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import genotype as ge, intervals as iv, kinship as ki, linkage as ld, structure as st
from kinfold.plans.fixtures import Inputs
from kinfold.session import noted_paths

N, M = 30, 200


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = (rng.random((M, N)) < rng.random((M, 1)) * 0.6).astype(float) * 2
    x[rng.random((M, N)) < 0.05] = np.nan
    x[0] = 2.0  # monomorphic
    x[1] = np.nan  # never called
    rows = [(f"S{j}", 1 + j % 2, int(j * 37), [None if np.isnan(v) else int(v) for v in x[j]]) for j in range(M)]
    geno = spark.createDataFrame(rows, "snp_id string, chromosome int, position long, dosages array<tinyint>").repartition(5).persist()
    panel = spark.createDataFrame([(list(range(100, 100 + N)),)], "iids array<bigint>")
    return x, geno, panel


def centred(x):
    with np.errstate(all="ignore"):
        mean = np.nanmean(x, axis=1, keepdims=True)
    return np.nan_to_num(np.where(np.isnan(x), 0.0, x - mean))


def square(rows, n, col="a"):
    out = np.zeros((n, n))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r[col]
    return out


def test_long_and_back(data):
    x, geno, panel = data
    back = ge.to_arrays(ge.to_long(geno, panel), panel).join(geno.select("snp_id", F.col("dosages").alias("d")), "snp_id")
    assert back.where(~F.col("dosages").eqNullSafe(F.col("d"))).count() == 0


def test_qc_edges(spark):
    rows = [(f"S{j}", [2 if (i + j) % 3 == 0 else 0 for i in range(20)]) for j in range(10)]
    rows[0][1][:] = [0] * 18 + [2, 0]  # minor allele frequency exactly 0.05
    rows[1][1][:] = [0] * 20  # monomorphic
    rows[2][1][0:2] = [None, None]  # missing rate exactly 0.1
    rows[3][1][0:3] = [None] * 3  # above 0.1
    for r in rows:
        r[1].append(None)  # a sample with every call missing
    geno = spark.createDataFrame(rows, "snp_id string, dosages array<tinyint>")
    panel = spark.createDataFrame([(list(range(21)),)], "iids array<bigint>")
    # every sample but the last has at most 2 of 10 calls missing: allow 0.2
    kept, left = ge.qc_filter(geno, panel, mind=0.2)
    ids = {r["snp_id"] for r in kept.collect()}
    assert left.first()["iids"] == list(range(20))
    assert "S0" in ids and "S2" in ids and "S1" not in ids and "S3" not in ids


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quality_counts_without_a_row_or_expression_a_call(data):
    x, geno, panel = data
    assert "Generate" not in plan_of(ge.sample_stats(geno, panel).select("n_snps")).replace("Generate posexplode(iids", "")
    kept, _ = ge.qc_filter(geno, panel)
    for text in (plan_of(kept), plan_of(ge.to_minor_dosage(geno))):
        assert "arrays_zip" not in text and "transform" not in text


def test_sample_stats_of_rows_of_several_lengths(spark):
    geno = spark.createDataFrame([("a", [2, None, 0]), ("b", [2]), ("c", []), ("d", None), ("e", [0, 2, None])], "snp_id string, dosages array<tinyint>")
    panel = spark.createDataFrame([([7, 8, 9],)], "iids array<bigint>")
    got = {r["iid"]: (r["n_snps"], r["n_called"], r["freq"]) for r in ge.sample_stats(geno.coalesce(1), panel).collect()}
    assert got == {7: (3, 3, 4 / 6), 8: (2, 1, 1.0), 9: (2, 1, 0.0)}


def test_stored_dosages_come_back(data, spark):
    _, geno, _ = data
    rows = geno.unionByName(spark.createDataFrame([("none", 1, 5, None), ("empty", None, 6, []), ("gaps", 1, 7, [None, 2, None])], geno.schema))
    back = ge.stored(rows, "geno")
    assert back.schema == rows.schema and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert "unpack" not in plan_of(back.select("snp_id"))  # a step that wants the names does not read the calls


def test_panel_order(spark):
    rows = [(0, {5: 1.5, 3: None, 4: 2.5}), (1, {}), (2, None)]
    df = spark.createDataFrame(rows, "k int, m map<bigint,double>").coalesce(1)
    panel = spark.createDataFrame([([3, 4, 9, 5],)], "iids array<bigint>")
    out = ge.in_panel_order(df, panel, "m", "y")
    assert "transform" not in plan_of(out)
    assert {r["k"]: r["y"] for r in out.collect()} == {0: [None, 2.5, None, 1.5], 1: [None] * 4, 2: None}


def test_scale_without_pairs(data):
    x, geno, _ = data
    assert ki.mean_diagonal(geno).first()["c"] == pytest.approx((centred(x) ** 2).sum() / N)


def test_derived_genotypes(spark, tmp_path):
    part, supplier = [0, 3, 40, 119_999, None, 3], [0, 7, 59_999, 7]
    spark.createDataFrame([(p,) for p in part], "p_partkey bigint").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(s,) for s in supplier], "s_suppkey bigint").write.parquet(str(tmp_path / "supplier.parquet"))
    rows = Inputs(spark, str(tmp_path)).geno.collect()

    def dose(p, s):
        if p is None or (s * 13 + p * 17) % (p % 40 + 11) == 0:
            return None
        return 2 if (s * 7919 + p * 104729 + s * p * 31) % 101 < p % 50 else 0

    want = [(None if p is None else f"S{p}", [dose(p, s) for s in (0, 7, 59_999)]) for p in part]
    assert sorted(map(str, want)) == sorted(str((r["snp_id"], r["dosages"])) for r in rows)


def test_minor_dosage(data):
    x, geno, _ = data
    for r in ge.to_minor_dosage(geno).collect():
        row = x[int(r["snp_id"][1:])]
        want = 2 - row if np.nanmean(row) / 2 > 0.5 else row
        got = np.array([np.nan if v is None else v for v in r["dosages"]], float)
        assert np.array_equal(got, want, equal_nan=True)


def test_minor_dosage_of_bytes(data, monkeypatch):
    """The bytes of a stored table are recoded as arrays are, a few rows at a time; the query has no array of a text a call."""
    _, geno, _ = data
    want = {r["snp_id"]: (r["flipped"], r["dosages"]) for r in ge.to_minor_dosage(geno).collect()}
    raw = geno.select("snp_id", "dosages").rdd.map(
        lambda r: (r["snp_id"], bytearray(128 if d is None else d for d in r["dosages"]))).toDF("snp_id string, dosages binary")
    monkeypatch.setattr(ge, "CELLS", 3 * N)
    got = {r["snp_id"]: (r["flipped"], [None if b == 128 else b for b in r["dosages"]]) for r in ge.to_minor_dosage(raw).collect()}
    assert got == want and any(f for f, _ in want.values())
    texts = {r["snp_id"]: (r["flipped"], r["dosages"]) for r in ge.to_minor_dosage(raw, text=True).collect()}
    assert texts == {s: (f, "".join("." if d is None else str(d) for d in row)) for s, (f, row) in want.items()}


def test_minor_dosage_keeps_no_table(spark, tmp_path):
    import __spark_entry__ as entry

    with noted_paths() as paths:
        plan = entry.queries()["minor_dosage"](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert not paths and "transform" not in plan


def test_band_sums_form_a_few_numbers_at_a_time(data, monkeypatch):
    """Steps of a few SNPs and lines add up to the same sums; no product is larger than asked."""
    x, geno, _ = data
    monkeypatch.setattr(ki, "CELLS", 4 * N)
    rows = geno.coalesce(1).select(F.lit("all").alias("g"), F.lit(0).alias("band"), "dosages")
    kept = []
    monkeypatch.setattr(ki, "centred", lambda lists, width, plain=ki.centred: kept.append(len(lists)) or plain(lists, width))

    class Rows:
        def mapInArrow(self, fn, schema):
            return [b for b in fn(iter([self.batch]))]

    told = Rows()
    told.batch = rows.toArrow().combine_chunks().to_batches()[0]
    sums = np.concatenate([np.frombuffer(b["a"][0].as_buffer()) for b in ki._band_sums(told, N, ki._cuts(N, 1 << 20, 100))])
    assert np.allclose(sums, (centred(x).T @ centred(x))[np.triu_indices(N)]) and max(kept) == 4


def test_snp_map_numbers_in_order(spark):
    calls = spark.createDataFrame([(2, 5), (1, 9), (1, 3), (2, 1), (2, 1)], "chromosome int, position long")
    got = sorted((int(r["snp_id"][1:]), r["chromosome"], r["position"]) for r in ge.build_snp_map(calls).collect())
    assert got == [(1, 1, 3), (2, 1, 9), (3, 2, 1), (4, 2, 1), (5, 2, 5)]


def test_gram_plain_and_tiled(data):
    x, geno, _ = data
    z = centred(x)
    want = z.T @ z
    assert np.allclose(square(ki.gram(geno).collect(), N), want)
    assert np.allclose(square(ki.gram(geno, tile=7, samples=N).collect(), N), want)


def test_gram_above_a_tile_adds_up_arrays(data, monkeypatch):
    x, geno, _ = data
    z = centred(x)
    monkeypatch.setattr(ki, "TILE", 7)
    pairs = ki.gram(geno)
    assert "HashAggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(square(pairs.collect(), N), z.T @ z) and pairs.count() == N * (N + 1) // 2
    assert pairs.columns == ["set_id", "i", "j", "a"] and ki.gram(geno.where("false")).count() == 0


def test_partition_adds_up(spark, data):
    x, geno, _ = data
    z = centred(x)
    sets = spark.createDataFrame([("u", f"S{j}") for j in range(0, M, 3)] + [("v", "S5")], "set_id string, snp_id string")
    parts = ki.partition_kinship(geno, sets, chunk=10).collect()
    for name, cols in (("u", list(range(0, M, 3))), ("v", [5])):
        inside = square([r for r in parts if r["set_id"] == name and r["partition"] == 1], N)
        outside = square([r for r in parts if r["set_id"] == name and r["partition"] == 2], N)
        assert np.allclose(inside, z[cols].T @ z[cols]) and np.allclose(inside + outside, z.T @ z)
        k = square([r for r in parts if r["set_id"] == name and r["partition"] == 1], N, "k")
        assert np.isclose(np.diag(k).mean(), 1)


def test_packed_kernels(data):
    x, geno, _ = data
    row = ki.packed_kernels(ki.kinship(geno).withColumn("partition", F.lit(1))).first()
    z = centred(x)
    a = z.T @ z
    assert np.allclose(ki.unpack(row["kernel"], row["n"]), a / (np.trace(a) / N))


def test_set_kernels_equal_packed_partitions(spark, data):
    _, geno, _ = data
    sets = spark.createDataFrame([("u", f"S{j}") for j in range(0, M, 3)] + [("v", "S5")], "set_id string, snp_id string")
    want = {(r["set_id"], r["partition"]): r for r in ki.packed_kernels(ki.partition_kinship(geno, sets)).collect()}
    rows = ki.set_kernels(geno, sets, chunk=7).collect()
    assert {r["set_id"] for r in rows} == {"u", "v"}
    for r in rows:
        for p in (1, 2):
            w = want[r["set_id"], p]
            assert r["n"] == N and np.isclose(r["scales"][p - 1], w["c"]) and np.allclose(r["kernels"][p - 1], w["kernel"])


def test_matched_kernels_leave_the_scope_out(spark, data):
    x, geno, _ = data
    z = centred(x)
    sets = spark.createDataFrame([("p|1", f"S{j}") for j in range(0, M, 5)] + [("q|1", "S3")], "set_id string, snp_id string")
    scopes = spark.createDataFrame([("p|1", "p"), ("q|1", "q")], "set_id string, scope string")
    away = {"p": [1, 2, 7], "q": [0, 4]}
    outside = spark.createDataFrame([(s, f"S{j}") for s, js in away.items() for j in js], "scope string, snp_id string")
    packed = {(r["set_id"], r["partition"]): r for r in ki.packed_kernels(ki.partition_kinship(geno, sets, scopes=scopes, outside=outside)).collect()}
    for r in ki.set_kernels(geno, sets, chunk=7, scopes=scopes, outside=outside).collect():
        inside = list(range(0, M, 5)) if r["set_id"] == "p|1" else [3]
        rest = [j for j in range(M) if j not in inside and j not in away[r["set_id"][0]]]
        for at, part in enumerate((inside, rest)):
            a = z[part].T @ z[part]
            k = (a / (np.trace(a) / N))[np.triu_indices(N)]
            assert np.allclose(r["kernels"][at], k) and np.allclose(packed[r["set_id"], at + 1]["kernel"], k)


def test_kernel_pieces(spark, data):
    """bounded pieces of the triangles; of a set or scope with most SNPs the others are added up."""
    x, geno, _ = data
    z = centred(x)
    geno = geno.unionByName(geno.limit(1).withColumn("snp_id", F.lit(None).cast("string")))  # in no set, in all complements
    extra = centred(np.array([[np.nan if v is None else float(v) for v in geno.where("snp_id IS NULL").first()["dosages"]]]))
    z = np.vstack([z, extra])
    members = {"few": [3, 9, 50], "most": list(range(20, M)), "every": list(range(M)), "scoped": [4, 8, 12]}
    away = {"wide": [j for j in range(M) if j not in (4, 8, 12, 30, 31)], "narrow": [5, 6]}
    sets = spark.createDataFrame([(s, f"S{j}") for s, js in members.items() for j in js] + [("absent", "none"), (None, "S1")], "set_id string, snp_id string")
    outside = spark.createDataFrame([(s, f"S{j}") for s, js in away.items() for j in js], "scope string, snp_id string")
    scopes = spark.createDataFrame([("scoped", "wide"), ("few", "narrow")], "set_id string, scope string")
    rows = ki.kernel_pieces(geno, sets, chunk=17, scopes=scopes, outside=outside, band_bytes=8 * N * 7, piece=40).collect()
    assert {r["set_id"] for r in rows} == set(members) and max(len(r["a1"]) for r in rows) <= 8 * 40
    for name, js in members.items():
        own = sorted((r for r in rows if r["set_id"] == name), key=lambda r: r["low"])
        assert [r["low"] for r in own[1:]] + [N] == [r["high"] for r in own] and own[0]["n"] == N
        lacking = away[{"scoped": "wide", "few": "narrow"}[name]] if name in ("scoped", "few") else []
        rest = [j for j in range(M + 1) if j not in js and j not in lacking]
        for column, part in (("a1", js), ("a2", rest)):
            want = z[part].T @ z[part]
            assert np.allclose(np.concatenate([np.frombuffer(r[column]) for r in own]), want[np.triu_indices(N)], atol=1e-9)
            assert np.isclose(own[0]["scales"][int(column[1]) - 1], np.trace(want) / N, atol=1e-9)
    nothing = ki.partition_kinship(geno.where("false"), sets)
    assert nothing.count() == 0 and nothing.columns == ["set_id", "partition", "i", "j", "a", "c", "k"]


def test_pca_dense_and_iterated(data):
    x, geno, panel = data
    z = centred(x)
    values, vectors = np.linalg.eigh(z.T @ z)
    for method in ("dense", "subspace"):
        got = st.sample_pca(geno, panel, 3, method, sweeps=200, tol=1e-12).toPandas()
        assert got["converged"].all()
        for pc in (1, 2, 3):
            own = got[got["pc"] == pc].sort_values("iid")
            vec = vectors[:, -pc] * np.sqrt(values[-pc])
            score = own["score"].to_numpy()
            assert np.allclose(np.abs(score), np.abs(vec), atol=1e-3)
            assert score[np.abs(score).argmax()] > 0
            assert np.isclose(own["eigenvalue"].iloc[0], values[-pc] / (N - 1))
    shares = {r["pc"]: r["share"] for r in st.scree(st.sample_pca(geno, panel, N)).collect()}
    assert np.isclose(sum(shares.values()), 1) and shares[1] > shares[2] > shares[3]


def test_residuals(spark):
    rng = np.random.default_rng(4)
    cov = pd.DataFrame(rng.normal(size=(50, 6)), columns=[f"pc{i}" for i in range(6)]).assign(iid=range(50))
    y = pd.DataFrame({"iid": list(range(50)) * 2, "trait": ["a"] * 50 + ["b"] * 50, "value": rng.normal(size=100)})
    y.loc[3, "value"] = None
    cols = [f"pc{i}" for i in range(6)]
    df = spark.createDataFrame(y).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    got = st.residualize(df, spark.createDataFrame(cov), cols).toPandas().sort_values(["trait", "iid"])
    w = np.column_stack([np.ones(50), cov[cols]])
    for t, part in got.groupby("trait"):
        own = y[y["trait"] == t].set_index("iid")["value"]
        ok = own.notna().to_numpy()
        beta = np.linalg.lstsq(w[ok], own[ok].to_numpy(float), rcond=None)[0]
        assert np.allclose(part["residual"].to_numpy()[ok], own[ok].to_numpy(float) - w[ok] @ beta)
        assert part["residual"].isna().to_numpy().tolist() == (~ok).tolist()


def test_ld_and_prune(data):
    x, geno, _ = data
    kb = 0.3
    pairs = {(r["snp_a"], r["snp_b"]): r["r2"] for r in ld.ld_window(geno, kb).collect()}
    want = {}
    for a in range(M):
        for b in range(a + 1, M):
            if a % 2 == b % 2 and (b - a) * 37 <= 300:
                both = ~(np.isnan(x[a]) | np.isnan(x[b]))
                u, v = x[a][both], x[b][both]
                want[(f"S{a}", f"S{b}")] = None if len(u) == 0 or u.std() == 0 or v.std() == 0 else np.corrcoef(u, v)[0, 1] ** 2
    assert set(pairs) == set(want)
    for key, value in want.items():
        assert (value is None) == (pairs[key] is None) and (value is None or np.isclose(pairs[key], value))
    limit = 0.02
    gone = set()
    for b in sorted(range(M), key=lambda j: (j * 37, f"S{j}")):
        if any((f"S{a}", f"S{b}") in want and (want[f"S{a}", f"S{b}"] or 0) > limit and a not in gone for a in range(b)):
            gone.add(b)
    kept = {r["snp_id"] for r in ld.ld_prune(geno, ld.ld_window(geno, kb), kb, limit, block_windows=1).collect()}
    assert kept == {f"S{j}" for j in range(M) if j not in gone} and gone


def test_distinct_on_and_grid(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 5, "c")], "k string, o int, v string")
    assert sorted(map(tuple, iv.distinct_on(df, ["k"], ["o"]).collect())) == [("k", 1, "a"), ("m", 5, "c")]
    grid = iv.complete_grid(df.select("k", "v"), "k", ["v"])
    assert grid.count() == 6


def test_ld_in_a_dense_region(spark, monkeypatch):
    """Nine tenths of the SNPs within one window, several blocks a stretch, doubles and whole numbers, ties of positions."""
    monkeypatch.setattr(ld, "BLOCK_SNPS", 7)
    rng = np.random.default_rng(5)
    n, m = 20, 80
    x = rng.integers(0, 3, (m, n)).astype(float)
    x[::9] += 0.25
    x[rng.random((m, n)) < 0.1] = np.nan
    pos = np.where(np.arange(m) < 72, rng.integers(5000, 5900, m), rng.integers(0, 20000, m))
    rows = [(f"r{i}", 1, int(pos[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(m)]
    rows += [("nowhere", 1, None, rows[0][3]), ("nochr", None, 5, rows[0][3])]
    geno = spark.createDataFrame(rows, "snp_id string, chromosome int, position long, dosages array<double>")
    got = {(r["snp_a"], r["snp_b"]): r["r2"] for r in ld.ld_window(geno, 1.0).collect()}
    order = sorted(range(m), key=lambda i: (pos[i], f"r{i}"))
    want = {}
    for k, a in enumerate(order):
        for b in order[k + 1:]:
            if pos[b] - pos[a] <= 1000:
                both = ~(np.isnan(x[a]) | np.isnan(x[b]))
                want[f"r{a}", f"r{b}"] = np.corrcoef(x[a][both], x[b][both])[0, 1] ** 2
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    assert ld.ld_window(geno.limit(0), 1.0).count() == 0


def greedy(pairs, positions):
    partners = {}
    for a, b in pairs:
        partners.setdefault(b, []).append(a)
    gone = set()
    for s in sorted(positions, key=lambda s: (positions[s], s)):
        if any(a not in gone for a in partners.get(s, [])):
            gone.add(s)
    return gone


@pytest.mark.parametrize("chained", [False, True])
def test_prune_rounds_do_not_grow_with_the_chromosome(spark, chained):
    """Random links: as many rounds on a chromosome eight times as long. One unbroken chain: the logarithm of its blocks."""
    rounds = {}
    for m in (200, 1600):
        rng = np.random.default_rng(3)
        positions = {f"s{i}": i * 100 for i in range(m)}
        step = [1] if chained else range(1, 6)
        pairs = [(f"s{i}", f"s{i + d}") for i in range(m) for d in step if i + d < m and (chained or rng.random() < 0.3)]
        geno = spark.createDataFrame([(s, 1, p) for s, p in positions.items()], "snp_id string, chromosome int, position long")
        links = spark.createDataFrame([(1, a, b, positions[a], positions[b], 0.9) for a, b in pairs] + [(1, "s0", "s1", 0, 100, None)],
                                      "chromosome int, snp_a string, snp_b string, pos_a long, pos_b long, r2 double")
        with noted_paths() as paths:
            kept = {r["snp_id"] for r in ld.ld_prune(geno, links, 0.5, 0.5, block_windows=4).collect()}
        assert kept == positions.keys() - greedy(pairs, positions)
        rounds[m] = sum("ld-verdicts" in p for p in paths)
    blocks = 1600 * 100 // 2000
    assert rounds[1600] <= (1 + np.ceil(np.log2(blocks)) if chained else rounds[200] + 1), rounds
    print(rounds)
