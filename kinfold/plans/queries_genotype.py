"""Genotype preparation, structure, kinship."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import genotype as ge, kinship as ki, linkage as ld, rank_corr, structure as st
from kinfold.plans.fixtures import Inputs
from kinfold.plans.queries_annotation import MATCHED, all_sets, matched_kernels_of
from kinfold.plans.registry import query, r, rounded
from kinfold.session import staged

LD_KB = 5.0


def calls_long(x: Inputs):
    """Base letters per (SNP, sample): A for the counted allele, G for the other, N for a missing call."""
    base = F.when(F.col("dosage") == 2, "A").when(F.col("dosage") == 0, "G").otherwise("N")
    return x.geno_long.select("snp_id", "iid", base.alias("call"))


@query("G1", """SELECT chromosome, 'S'||row_number() OVER (ORDER BY chromosome, position) AS snp_id,
    CAST(0 AS DOUBLE) AS physical, position FROM fx_snps""")
def snp_map(x):
    return ge.build_snp_map(x.snps)


CALLS = "calls AS (SELECT *, CASE dosage WHEN 2 THEN 'A' WHEN 0 THEN 'G' ELSE 'N' END AS call FROM fx_geno)"


@query("G2", f"""WITH {CALLS} SELECT snp_id, CASE WHEN call IN ('A','C','G','T') THEN call||call END AS genotype, count(*) AS n
    FROM calls GROUP BY ALL""")
def diploidize(x):
    return calls_long(x).groupBy("snp_id", ge.diploidize(F.col("call")).alias("genotype")).agg(F.count(F.lit(1)).alias("n"))


@query("G3", f"""WITH {CALLS} SELECT 'family' AS family, CAST(iid AS VARCHAR) AS sample, 0 AS paternal, 0 AS maternal, -9 AS sex,
    -9 AS phenotype, CAST(idx//512 AS INTEGER) AS block,
    string_agg(coalesce(CASE WHEN call<>'N' THEN call||call END,'00'), ' ' ORDER BY idx) AS calls
    FROM (SELECT c.*, CAST(substr(snp_id,2) AS BIGINT) AS idx FROM calls c) GROUP BY ALL""")
def sample_major(x):
    calls = calls_long(x).select(
        F.substring("snp_id", 2, 20).cast("bigint").alias("idx"), F.concat(F.lit("X"), F.col("iid").cast("string")).alias("iid"),
        F.coalesce(ge.diploidize(F.col("call")), F.lit("00")).alias("call"),
    )
    return ge.to_sample_major(calls, block=512).withColumn("calls", F.concat_ws(" ", "calls"))


@query("G4", """SELECT iid, count(*) AS n_calls FROM fx_geno WHERE iid IN (SELECT iid FROM fx_pheno WHERE qty>25.5) GROUP BY iid""")
def keep_samples(x):
    return ge.keep_samples(x.geno_long, x.pheno.where("qty > 25.5")).groupBy("iid").agg(F.count(F.lit(1)).alias("n_calls"))


@query("G5", """SELECT snp_id, CAST(count(*) AS INTEGER) AS n, CAST(count(dosage) AS INTEGER) AS n_called,
    round((count(*)-count(dosage))/count(*),9) AS missing_rate, round(sum(dosage)/nullif(2.0::DOUBLE*count(dosage),0),9) AS freq
    FROM fx_geno GROUP BY snp_id""")
def snp_stats(x):
    return rounded(ge.snp_stats(x.geno), 9, "missing_rate", "freq")


@query("G5", """SELECT iid, count(*) AS n_snps, count(dosage) AS n_called, round((count(*)-count(dosage))/count(*),9) AS missing_rate,
    round(sum(dosage)/nullif(2.0::DOUBLE*count(dosage),0),9) AS freq FROM fx_geno GROUP BY iid""")
def sample_stats(x):
    return rounded(ge.sample_stats(x.geno, x.panel), 9, "missing_rate", "freq")


QC = """s1 AS (SELECT iid FROM fx_geno GROUP BY iid HAVING (count(*)-count(dosage))/count(*)<=0.1),
    g1 AS (SELECT g.* FROM fx_geno g SEMI JOIN s1 ON s1.iid=g.iid),
    st AS (SELECT snp_id, count(*) AS n, count(dosage) AS n_called, (count(*)-count(dosage))/count(*) AS miss,
        sum(dosage)/nullif(2.0::DOUBLE*count(dosage),0) AS freq FROM g1 GROUP BY snp_id),
    ok AS (SELECT * FROM st WHERE miss<=0.1 AND least(freq,1-freq)>=0.05::DOUBLE)"""


@query("G6", f"""WITH {QC} SELECT snp_id, CAST(n AS INTEGER) AS n, CAST(n_called AS INTEGER) AS n_called, round(miss,9) AS missing_rate,
    round(freq,9) AS freq FROM ok""")
def qc_filter(x):
    kept, _ = ge.qc_filter(x.geno, x.panel)
    return rounded(ge.snp_stats(kept), 9, "missing_rate", "freq")


@query("G7", """WITH f AS (SELECT snp_id, sum(dosage)/nullif(2.0::DOUBLE*count(dosage),0) AS freq FROM fx_geno GROUP BY 1)
    SELECT g.snp_id, coalesce(f.freq>0.5,false) AS flipped,
    string_agg(coalesce(CAST(CASE WHEN f.freq>0.5 THEN 2-dosage ELSE dosage END AS VARCHAR),'.'),'' ORDER BY iid) AS dosages
    FROM fx_geno g JOIN f ON f.snp_id=g.snp_id GROUP BY ALL""")
def minor_dosage(x):
    return ge.to_minor_dosage(x.geno_bytes, text=True).select("snp_id", "flipped", "dosages")


@query("G8")
def sample_pca(x):
    return st.sample_pca(x.geno, x.panel, 6)


@query("G9")
def scree(x):
    return st.scree(st.sample_pca(x.geno, x.panel, 6))


def all_components(x: Inputs):
    """Scores on as many components as there are samples: they hold the whole Gram matrix."""
    return staged(st.sample_pca(x.geno, x.panel, x.panel.select(F.size("iids")).first()[0]), "scores")


@query("G8", """SELECT d.i AS iid, round(d.a,5) AS own, round(f.a,5) AS with_first FROM gram_all d
    JOIN gram_all f ON f.j=d.i AND f.i=(SELECT min(i) FROM gram_all) WHERE d.i=d.j""")
def pca_products(x):
    scores = all_components(x)
    first = scores.where(F.col("iid") == scores.agg(F.min("iid")).scalar()).select("pc", F.col("score").alias("f"))
    sums = scores.join(first, "pc").groupBy("iid").agg(F.sum(F.col("score") * F.col("score")).alias("own"), F.sum(F.col("score") * F.col("f")).alias("with_first"))
    return sums.select("iid", r("own", 5).alias("own"), r("with_first", 5).alias("with_first"))


@query("G9", """WITH n AS (SELECT count(*)-1 AS n FROM gram_all WHERE i=j)
    SELECT count(*) FILTER (i=j) AS components, round(sum(CASE WHEN i=j THEN a END)/max(n),5) AS total,
    round(sum(CASE WHEN i=j THEN a*a ELSE 2*a*a END)/max(n)/max(n),4) AS squares, round(CAST(1 AS DOUBLE),6) AS shares FROM gram_all, n""")
def scree_moments(x):
    rows = st.scree(all_components(x))
    return rows.agg(F.count(F.lit(1)).alias("components"), r(F.sum("eigenvalue"), 5).alias("total"),
                    r(F.sum(F.col("eigenvalue") * F.col("eigenvalue")), 4).alias("squares"), r(F.sum("share"), 6).alias("shares"))


@query("G10", """WITH d AS (SELECT p.iid, p.trait, p.value, CAST(e.embedding[1] AS DOUBLE) AS pc1 FROM fx_pheno_long p
        LEFT JOIN embeddings e ON e.vec_id=p.iid),
    f AS (SELECT trait, regr_slope(value, pc1) AS b, regr_intercept(value, pc1) AS a FROM d GROUP BY trait)
    SELECT d.iid, d.trait, round(d.value-(f.a+f.b*d.pc1),5) AS residual FROM d JOIN f ON f.trait=d.trait""")
def residualize_one(x):
    out = st.residualize(x.pheno_long, x.covariates(1), ["pc1"])
    return out.select("iid", "trait", r("residual", 5).alias("residual"))


def projection_sql(k: int) -> str:
    """Residuals on k covariates: centre, then remove one orthogonalised covariate after the other."""
    names = ["y"] + [f"x{i}" for i in range(1, k + 1)]
    raw = ", ".join(f"CAST(e.embedding[{i}] AS DOUBLE) AS x{i}" for i in range(1, k + 1))
    steps = [f"""s0 AS (SELECT iid, trait, {', '.join(f'{c}-avg({c}) OVER (PARTITION BY trait) AS {c}' for c in names)} FROM (
        SELECT p.iid, p.trait, p.value AS y, {raw} FROM fx_pheno_long p JOIN embeddings e ON e.vec_id=p.iid))"""]
    for i in range(1, k + 1):
        left = ["y"] + [f"x{j}" for j in range(i + 1, k + 1)]
        cols = ", ".join(f"{c}-x{i}*sum({c}*x{i}) OVER (PARTITION BY trait)/sum(x{i}*x{i}) OVER (PARTITION BY trait) AS {c}" for c in left)
        steps.append(f"s{i} AS (SELECT iid, trait, {cols} FROM s{i - 1})")
    return f"WITH {', '.join(steps)} SELECT iid, trait, round(y,5) AS residual FROM s{k}"


@query("G10", projection_sql(6))
def residualize_six(x):
    cols = [f"pc{i}" for i in range(1, 7)]
    return st.residualize(x.pheno_long, x.covariates(6), cols).select("iid", "trait", r("residual", 5).alias("residual"))


LD = """snp AS (SELECT 'S'||p_partkey AS snp_id, CAST(p_partkey%5+1 AS INTEGER) AS chromosome, (p_partkey*618033)%1000003 AS position FROM part),
    near AS (SELECT a.chromosome, a.snp_id AS snp_a, b.snp_id AS snp_b, a.position AS pos_a, b.position AS pos_b FROM snp a JOIN snp b
        ON a.chromosome=b.chromosome AND b.position-a.position BETWEEN 0 AND 5000
        AND (a.position<b.position OR a.snp_id<b.snp_id)),
    sums AS (SELECT n.*, count(x.dosage*y.dosage) AS c, sum(CASE WHEN y.dosage IS NOT NULL THEN x.dosage END) AS sx,
        sum(CASE WHEN x.dosage IS NOT NULL THEN y.dosage END) AS sy, sum(x.dosage*y.dosage) AS sxy,
        sum(CASE WHEN y.dosage IS NOT NULL THEN x.dosage*x.dosage END) AS sxx,
        sum(CASE WHEN x.dosage IS NOT NULL THEN y.dosage*y.dosage END) AS syy FROM near n JOIN fx_geno x ON x.snp_id=n.snp_a
        JOIN fx_geno y ON y.snp_id=n.snp_b AND y.iid=x.iid GROUP BY ALL),
    ld AS (SELECT chromosome, snp_a, snp_b, pos_a, pos_b, round(CAST(c*sxy-sx*sy AS DOUBLE)*(c*sxy-sx*sy)
        /nullif(CAST(c*sxx-sx*sx AS DOUBLE)*(c*syy-sy*sy),0),9) AS r2 FROM sums)"""


@query("G11", f"WITH {LD} SELECT * FROM ld")
def ld_window(x):
    return rounded(ld.ld_window(x.geno, LD_KB), 9, "r2")


@query("G11", f"""WITH {LD} SELECT s.snp_id, round(1+coalesce(sum(e.r2),0),9) AS ld_score, count(e.r2) AS n_partners FROM snp s
    LEFT JOIN (SELECT snp_a AS snp_id, r2 FROM ld UNION ALL SELECT snp_b, r2 FROM ld) e ON e.snp_id=s.snp_id GROUP BY s.snp_id""")
def ld_score(x):
    return rounded(ld.ld_score(x.geno, rounded(ld.ld_window(x.geno, LD_KB), 9, "r2")), 9, "ld_score")


@query("G12", f"""WITH RECURSIVE {LD}, strong AS (SELECT snp_b, list(snp_a) AS partners FROM ld WHERE r2>0.02 GROUP BY snp_b),
    seq AS (SELECT s.*, coalesce(t.partners, CAST([] AS VARCHAR[])) AS partners, row_number() OVER (PARTITION BY chromosome ORDER BY position, snp_id) AS ord
        FROM snp s LEFT JOIN strong t ON t.snp_b=s.snp_id),
    walk AS (SELECT DISTINCT chromosome, CAST(0 AS BIGINT) AS ord, CAST([] AS VARCHAR[]) AS kept, false AS took, CAST(0 AS BIGINT) AS position, '' AS snp_id FROM seq
        UNION ALL SELECT w.chromosome, s.ord, CASE WHEN list_has_any(w.kept, s.partners) THEN w.kept ELSE list_append(w.kept, s.snp_id) END,
        NOT list_has_any(w.kept, s.partners), s.position, s.snp_id FROM walk w JOIN seq s ON s.chromosome=w.chromosome AND s.ord=w.ord+1)
    SELECT chromosome, position, snp_id FROM walk WHERE took""")
def ld_prune(x):
    return ld.ld_prune(x.geno, ld.ld_window(x.geno, LD_KB), LD_KB, 0.02)


def named_total(x: Inputs):
    return ki.gram(x.geno)


def set_kernels(x: Inputs):
    return ki.set_kernels(x.geno, staged(all_sets(x).withColumnRenamed("pathway", "set_id"), "sets"))


def set_pieces(x: Inputs):
    """As `set_kernels`, in pieces of the triangles."""
    return ki.kernel_pieces(x.geno, staged(all_sets(x).withColumnRenamed("pathway", "set_id"), "sets"))


@query("K1", """SELECT i, j, round(a/(SELECT sum(a)/count(*) FROM gram_all WHERE i=j),6) AS k FROM gram_all""")
def kinship(x):
    return ki.name_samples(ki.kernel_pairs(ki.packed_kinship(x.geno)), x.panel).select("i", "j", r("k").alias("k"))


@query("K1", """SELECT i, j, round(a/(SELECT sum(2*p*(1-p)) FROM (SELECT sum(dosage)/(2.0::DOUBLE*count(dosage)) AS p FROM fx_geno GROUP BY snp_id)),6) AS k
    FROM gram_all""")
def kinship_hwe(x):
    return ki.name_samples(ki.kinship(x.geno, "hwe"), x.panel).select("i", "j", r("k").alias("k"))


@query("K2", """SELECT set_id, partition, i, j, round(k,6) AS k FROM kin_parts""")
def partition_kinship(x):
    return ki.name_samples(ki.piece_pairs(set_pieces(x)), x.panel).select("set_id", "partition", "i", "j", r("k").alias("k"))


NULL_KIN = f"""{MATCHED}, m AS (SELECT DISTINCT pathway||'|'||random_group AS set_id, snp_id FROM null_rows WHERE pathway IN ('degradation_autophagy','degradation_ubiquitin')),
    gin AS (SELECT m.set_id, a.iid AS i, b.iid AS j, sum(a.z*b.z) AS a FROM m JOIN zgeno a ON a.snp_id=m.snp_id
        JOIN zgeno b ON b.snp_id=a.snp_id AND a.iid<=b.iid GROUP BY ALL),
    away AS (SELECT s.pathway, a.iid AS i, b.iid AS j, sum(a.z*b.z) AS a FROM (SELECT DISTINCT pathway, snp_id FROM all_sets) s JOIN zgeno a ON a.snp_id=s.snp_id
        JOIN zgeno b ON b.snp_id=a.snp_id AND a.iid<=b.iid GROUP BY ALL),
    gp AS (SELECT set_id, 1 AS partition, i, j, a FROM gin UNION ALL
        SELECT g.set_id, 2, g.i, g.j, t.a-w.a-g.a FROM gin g JOIN gram_all t ON t.i=g.i AND t.j=g.j
        JOIN away w ON w.pathway=split_part(g.set_id,'|',1) AND w.i=g.i AND w.j=g.j)"""


def null_kin(x: Inputs):
    sets, scopes, outside = matched_kernels_of(x)
    return ki.partition_kinship(x.geno, sets, scopes=scopes, outside=outside)


@query("K3", f"""WITH RECURSIVE {NULL_KIN.replace(" WHERE pathway IN ('degradation_autophagy','degradation_ubiquitin')", "")},
    c AS (SELECT set_id, partition, sum(a)/count(*) AS c FROM gp WHERE i=j GROUP BY ALL)
    SELECT gp.set_id, gp.partition, gp.i, gp.j, round(gp.a/nullif(c.c,0),6) AS k FROM gp JOIN c ON c.set_id=gp.set_id AND c.partition=gp.partition""")
def null_kinship(x):
    return ki.name_samples(null_kin(x), x.panel).select("set_id", "partition", "i", "j", r("k").alias("k"))


@query("K4", """WITH p AS (SELECT set_id, partition, i, j, round(k,8) AS k FROM kin_parts WHERE i<j),
    rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY set_id, partition, k)-1)/2.0::DOUBLE AS r FROM p
        WINDOW w AS (PARTITION BY set_id, partition ORDER BY k)),
    wd AS (SELECT set_id, i, j, max(k) FILTER (partition=1) AS k1, max(k) FILTER (partition=2) AS k2,
        max(r) FILTER (partition=1) AS r1, max(r) FILTER (partition=2) AS r2 FROM rk GROUP BY ALL)
    SELECT set_id, round(corr(k1,k2),6) AS cor_p, round(corr(r1,r2),6) AS cor_s FROM wd GROUP BY set_id""")
def kinship_corr(x):
    return rounded(rank_corr.piece_corr(set_pieces(x)), 6, "cor_p", "cor_s")
