"""Hand-made edges of the interval joins, sets and random groups."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import intervals as iv, sampling as sa

GENES = [(1, "G1", 10000, 12000), (1, "G2", 11000, 13000), (1, "G3", 30000, 31000), (2, "G4", 10000, 12000)]
SNPS = [("a", 1, 10000), ("b", 1, 12000), ("c", 1, 12001), ("d", 1, 11500), ("e", 1, 20000), ("f", 2, 9999),
        ("lo", 1, 7500), ("lo_out", 1, 7499), ("hi", 1, 33500), ("hi_out", 1, 33501)]


@pytest.fixture(scope="module")
def genes(spark):
    return spark.createDataFrame(GENES, "chromosome_name int, ensembl_gene_id string, start_position long, end_position long")


@pytest.fixture(scope="module")
def snps(spark):
    return spark.createDataFrame(SNPS, "snp_id string, chromosome int, position long")


def test_first_gene_and_null_gene(snps, genes):
    got = {r["snp_id"]: r["ensembl_gene_id"] for r in iv.snp_to_gene(snps, genes).collect()}
    assert got == {"a": "G1", "b": "G1", "c": "G2", "d": "G1", "e": None, "f": None, "lo": None, "lo_out": None, "hi": None, "hi_out": None}


@pytest.mark.parametrize("salt,width", [(1, 4096), (4, 100)])
def test_buffer_is_inclusive(snps, genes, salt, width):
    hits = {(r["snp_id"], r["hit_gene_id"]) for r in iv.buffered_hits(snps, genes, 2500, bin_width=width, salt=salt).collect()}
    want = {(s, g) for s, c, p in SNPS for gc, g, lo, hi in GENES if c == gc and lo - 2500 <= p <= hi + 2500}
    assert hits == want and ("lo", "G1") in hits and ("hi", "G3") in hits and ("hi_out", "G3") not in hits


def test_null_buffer_is_strict(spark, snps, genes):
    edge = spark.createDataFrame([("x", 1, 10000, "G1"), ("y", 1, 12500, None), ("z", 1, 12499, None)],
                                 "snp_id string, chromosome int, position long, ensembl_gene_id string")
    got = {r["snp_id"] for r in sa.gene_buffers(edge, sa.gene_spans(edge), 2500).collect()}
    assert got == {"x", "z"}


def test_range_join_is_brute_force(spark):
    rng = np.random.default_rng(3)
    points = [(f"p{i}", int(rng.integers(1, 4)), int(rng.integers(0, 50000))) for i in range(400)]
    spans = [(int(rng.integers(1, 4)), f"g{i}", (s := int(rng.integers(0, 50000))), s + int(rng.integers(0, 9000))) for i in range(80)]
    p = spark.createDataFrame(points, "snp_id string, chromosome int, position long")
    g = spark.createDataFrame(spans, "chromosome_name int, ensembl_gene_id string, start_position long, end_position long")
    for inclusive in (True, False):
        got = iv.range_join(p, g, "position", F.col("start_position"), F.col("end_position"), inclusive=inclusive, bin_width=512, salt=3)
        pairs = sorted((r["snp_id"], r["ensembl_gene_id"]) for r in got.collect())
        want = sorted((s, n) for s, c, x in points for gc, n, lo, hi in spans
                      if c == gc and (lo <= x <= hi if inclusive else lo < x < hi))
        assert pairs == want


def test_first_match_is_brute_force(spark):
    rng = np.random.default_rng(9)
    spans = [(1, f"g{i:03d}", (s := int(rng.integers(0, 3000))), s + int(rng.integers(0, 400)), f"p{i % 3}", "c", "n") for i in range(60)]
    spans += [(1, "h", 500, 700, "p0", "c", "n"), (1, "a", 500, 900, "p0", "c", "n")]  # equal starts
    g = spark.createDataFrame(spans, "chromosome_name int, ensembl_gene_id string, start_position long, end_position long, pathway string, bincode string, name string")
    p = spark.range(0, 3500, 7).select(F.concat(F.lit("s"), "id").alias("snp_id"), F.lit(1).alias("chromosome"), F.col("id").alias("position"))

    def first(x, rows, buffer):
        hits = sorted((lo, n) for _, n, lo, hi, *_ in rows if lo - buffer <= x <= hi + buffer)
        return hits[0][1] if hits else None

    genes = iv.snp_to_gene(p, g, bin_width=128).collect()
    assert len(genes) == 500 and all(r["ensembl_gene_id"] == first(r["position"], spans, 0) for r in genes)
    snps = p.withColumn("ensembl_gene_id", F.lit(None).cast("string"))
    got = {(r["pathway"], r["position"]): r["hit_gene_id"] for r in iv.pathway_snps(snps, g, 50, bin_width=128, salt=2).collect()}
    for path in ("p0", "p1", "p2"):
        own = [s for s in spans if s[4] == path]
        for x in range(0, 3500, 7):
            assert got.get((path, x)) == first(x, own, 50)


def test_intervals_that_hold_a_point(spark):
    rng = np.random.default_rng(4)
    points = [(int(rng.integers(1, 3)), int(p)) for p in rng.integers(-300, 2000, 60)] + [(1, 5), (1, 5), (None, 7), (1, None)]
    spans = [(int(rng.integers(1, 3)), f"g{i}", int(s := rng.integers(-400, 2100)), int(s + rng.integers(-3, 60))) for i in range(400)]
    spans += [(1, "point", 5, 5), (1, "same", 5, 5), (1, "same", 5, 5), (1, "no end", 5, None), (None, "no chr", 0, 99), (1, "wide", -9, 5000)]
    p = spark.createDataFrame(points, "chromosome int, position long")
    g = spark.createDataFrame(spans, "chromosome_name int, ensembl_gene_id string, start_position long, end_position long")
    hits = iv.gene_table(g, p)
    want = {s for s in spans if s[3] is not None and any(c is not None and x is not None and c == s[0] and s[2] <= x <= s[3] for c, x in points)}
    assert sorted(map(tuple, hits.collect())) == sorted((s[1], s[0], s[2], s[3]) for s in want) and 0 < len(want) < 400
    dense = spark.range(3000).select(F.lit(1).alias("chromosome"), F.col("id").alias("position"))
    many = spark.range(2000).select(F.lit(1).alias("chromosome_name"), F.concat(F.lit("g"), "id").alias("ensembl_gene_id"), F.col("id").alias("start_position"), (F.col("id") + 900).alias("end_position"))
    plan = iv.gene_table(many, dense)._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence" not in plan and iv.gene_table(many, dense).count() == 2000


def test_codes_are_unescaped_prefix_patterns(spark):
    codes = spark.createDataFrame([("29.5.1",), ("29.5.11",), ("29.5.11.2",), ("29.1",), ("29.10",), ("2935.1",), ("129.1",)], "bincode string")
    pats = {"one": "29.5.1$", "eleven": "29.5.11", "degr": "(?!29.5.11)29.5", "loose": "29.1", "skip": "0"}
    got = iv.match_pathways(codes, pats).groupBy("pathway").agg(F.sort_array(F.collect_list("bincode")).alias("c")).collect()
    assert {r["pathway"]: r["c"] for r in got} == {
        "one": ["29.5.1", "2935.1"], "eleven": ["29.5.11", "29.5.11.2"], "degr": ["29.5.1", "2935.1"], "loose": ["29.1", "29.10"],
    }


def test_partition_and_sizes(spark, snps):
    sets = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s1", "b"), ("s2", "c")], "set_id string, snp_id string")
    rows = iv.partition_snps(snps, sets).collect()
    assert len(rows) == 2 * len(SNPS) and len({(r["set_id"], r["snp_id"]) for r in rows}) == len(rows)
    assert {r["snp_id"] for r in rows if r["set_id"] == "s1" and r["partition"] == 1} == {"a", "b"}
    sized = spark.createDataFrame([("p", "a", None), ("p", "b", "G"), ("p", "b", "G")], "pathway string, snp_id string, ensembl_gene_id string")
    assert tuple(iv.pathway_sizes(sized).first()) == ("p", 2, 2)


def test_curated_sets_replace_patterns(spark):
    pattern = spark.createDataFrame([("x", "a"), ("y", "b")], "pathway string, snp_id string")
    curated = spark.createDataFrame([("y", "c")], "pathway string, snp_id string")
    assert sorted(map(tuple, iv.pathway_sets(pattern, curated).collect())) == [("x", "a"), ("y", "c")]


@pytest.fixture(scope="module")
def cover(spark):
    rng = np.random.default_rng(5)
    pos = np.sort(rng.integers(0, 200000, 600))
    gene = [f"g{p // 3000}" if p % 3000 < 2000 else None for p in pos]
    snps = spark.createDataFrame(pd.DataFrame({"snp_id": [f"s{i}" for i in range(600)], "chromosome": 1, "position": pos, "ensembl_gene_id": gene}))
    spans = sa.gene_spans(snps)
    return snps, spans, sa.gene_buffers(snps, spans)


def test_exact_draw(spark, cover):
    _, spans, buffers = cover
    table = sa.gene_cover(buffers, spans).withColumn("set_id", F.lit("all"))
    targets = spark.range(1, 41).select(F.lit("all").alias("set_id"), F.concat(F.lit("c_"), "id").alias("random_group"), (F.col("id") * 5).alias("size"))
    got = sa.draw_genes_exact(table, targets, "t").toPandas()
    again = sa.draw_genes_exact(table.repartition(5), targets.repartition(3), "t", blocks=3).toPandas()
    key = ["random_group", "draw_no"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    facts = {r["drawn_gene_id"]: (r["rows"], set(r["covers"])) for r in table.collect()}
    sizes = {r["random_group"]: r["size"] for r in targets.collect()}
    for group, rows in got.sort_values("draw_no").groupby("random_group"):
        seen, total = set(), 0
        for g in rows["drawn_gene_id"]:
            assert total < sizes[group] and g not in seen
            seen |= facts[g][1]
            total += facts[g][0]
        assert total >= sizes[group]


def test_covered_genes_travel_as_runs(spark, cover):
    _, spans, buffers = cover
    placed = sa.gene_tables(sa.gene_cover(buffers, spans).withColumn("set_id", F.lit("all"))).first()["genes"]
    assert len(placed) == spans.count() and all(len(g["runs"]) == 1 and g["runs"][0]["lo"] <= g["no"] <= g["runs"][0]["hi"] for g in placed)
    genes = [("s", "b", 2, 3, ["a", "b", "not drawn"]), ("s", "a", 1, 2, ["a"]), ("s", "é", 5, 1, ["é", "c"]), ("s", "c", 1, 4, ["b", "c"]),
             ("s", "c", 3, 4, ["b", "c"]), ("t", "b", 1, 1, [])]
    cover = spark.createDataFrame(genes, "set_id string, drawn_gene_id string, weight long, rows long, covers array<string>")
    tables = {r["set_id"]: [(g["drawn_gene_id"], [tuple(x) for x in g["runs"]]) for g in r["genes"]] for r in sa.gene_tables(cover).collect()}
    assert tables == {"s": [("a", [(0, 0)]), ("b", [(0, 1)]), ("c", [(1, 3)]), ("c", [(1, 3)]), ("é", [(2, 4)])], "t": [("b", [])]}
    targets = spark.range(60).select(F.explode(F.array(F.lit("s"), F.lit("t"))).alias("set_id"), F.concat(F.lit("c_"), "id").alias("random_group"), (F.col("id") % 9).alias("size"))
    got = sa.draw_genes_exact(cover, targets, "n", blocks=7).toPandas().sort_values("draw_no")
    drawn = {k: list(v["drawn_gene_id"]) for k, v in got.groupby(["set_id", "random_group"])}
    for s, group, size in targets.collect():
        def order(g):
            bits = int(hashlib.md5(f"n|{s}|{group}|{g[1]}".encode()).hexdigest()[:13], 16)
            return -np.log((bits + 0.5) / 2**52) / g[2], g[1]
        want, covered, total = [], set(), 0
        for g in sorted((g for g in genes if g[0] == s), key=order):
            if total < size and g[1] not in covered:
                want.append(g[1])
                covered.update(g[4])
                total += g[3]
        assert drawn.get((s, group), []) == want


def test_draw_without_rows_of_buffers(spark):
    """Two pools, two chromosomes, places shared by SNPs, a gene on both chromosomes, a target that comes twice."""
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"set_id": rng.choice(["a", "b"], 500), "snp_id": [f"s{i}" for i in range(500)], "chromosome": rng.integers(1, 3, 500), "position": rng.integers(0, 60000, 500)})
    frame["ensembl_gene_id"] = [None if p % 3000 > 2000 else "both" if p < 2000 else f"g{c}_{p // 3000}" for c, p in zip(frame["chromosome"], frame["position"])]
    snps = spark.createDataFrame(frame)
    odd = spark.createDataFrame([("a", "n1", None, 5, "n"), ("a", "n2", 1, None, None)], snps.schema)
    snps = snps.unionByName(odd)
    spans = sa.gene_spans(snps, ["set_id"])
    buffers = sa.gene_buffers(snps, spans, scope=["set_id"])
    want = {(r["set_id"], r["drawn_gene_id"]): r["count"] for r in buffers.groupBy("set_id", "drawn_gene_id").count().collect()}
    assert {(r["set_id"], r["drawn_gene_id"]): r["rows"] for r in sa.buffer_rows(snps, spans, scope=["set_id"]).collect()} == want
    targets = spark.range(1, 13).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("set_id"), F.concat(F.lit("c_"), "id").alias("random_group"), (F.col("id") * 30).alias("size"))
    targets = targets.unionByName(targets.where("random_group = 'c_4'"))
    places = sa.gene_places(snps, spans, scope=["set_id"])

    def rows(table, **how):
        return sorted(map(tuple, sa.draw_genes_exact(table, targets, "t", blocks=2, **how).collect()))

    first = rows(sa.gene_cover(buffers, spans, ["set_id"]))
    assert first and len({r[1] for r in first}) == 12 and rows(places) == first and rows(places, ahead=-1e9) == first
    assert sum(r[:2] == ("a", "c_4") for r in first) == 2 * len({r for r in first if r[:2] == ("a", "c_4")})
    near = sa.drawn_buffers(snps, spans, spark.createDataFrame([first[0]], "set_id string, random_group string, drawn_gene_id string, draw_no long"), scope=["set_id"])
    assert near.count() == want[first[0][0], first[0][2]]


def test_draw_prefers_heavy_genes(spark):
    genes = pd.DataFrame({"set_id": "all", "drawn_gene_id": ["heavy", "light"], "weight": [9, 1], "rows": [1, 1], "covers": [["heavy"], ["light"]]})
    targets = spark.range(2000).select(F.lit("all").alias("set_id"), F.col("id").cast("string").alias("random_group"), F.lit(1).alias("size"))
    first = sa.draw_genes_exact(spark.createDataFrame(genes), targets, "w").groupBy("drawn_gene_id").count().collect()
    share = {r["drawn_gene_id"]: r["count"] / 2000 for r in first}
    assert abs(share["heavy"] - 0.9) < 0.03


def test_fast_draw_stops_after_target(spark, cover):
    _, spans, buffers = cover
    targets = spark.createDataFrame([("c_1", 40), ("c_2", 1), ("c_3", 10**6)], "random_group string, size long")
    drawn = sa.draw_genes_fast(spans, buffers, targets, "f").toPandas()
    rows = buffers.groupBy("drawn_gene_id").count().toPandas().set_index("drawn_gene_id")["count"]
    for group, size in (("c_1", 40), ("c_2", 1)):
        got = drawn[drawn["random_group"] == group].sort_values("draw_key")["drawn_gene_id"]
        taken = rows[got].to_numpy()
        assert taken.sum() >= size > taken[:-1].sum()
    assert (drawn["random_group"] == "c_3").sum() == spans.count()


def test_null_sets_draw_all_groups(spark, monkeypatch):
    """5,000 generic groups with sizes of the whole range; the other queries keep the 25 of their SQL."""
    import __spark_entry__ as entry

    drawn = []

    class Drawn(Exception):
        pass

    def draw(genes, targets, *rest):
        drawn.append(targets.agg(F.count_distinct("random_group"), F.min("size"), F.max("size")).first())
        raise Drawn

    monkeypatch.setattr(sa, "draw_genes_exact", draw)
    for name in ("null_sets", "null_partitions"):
        with pytest.raises(Drawn):
            entry.queries()[name](spark, entry.SMOKE_DIR)
    (groups, low, high), (others, _, top) = drawn
    assert groups == 5000 and low < 100 and 49900 < high <= 50000
    assert others == 25 and top <= 300


def test_matched_queries_draw_all_groups(spark, monkeypatch):
    """1,000 groups a pathway; `matched_null_sets_exact` keeps the three of its SQL."""
    import __spark_entry__ as entry
    from kinfold.plans import queries_annotation as qa

    counts = []

    class Drawn(Exception):
        pass

    def draw(x, reps=qa.REPS):
        counts.append(reps)
        raise Drawn

    monkeypatch.setattr(qa, "matched_draw", draw)
    for name in ("matched_null_sets", "null_group_sizes", "matched_null_sets_exact"):
        with pytest.raises(Drawn):
            entry.queries()[name](spark, entry.SMOKE_DIR)
    assert counts == [1000, 1000, 3]
