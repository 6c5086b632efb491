"""Result tables, prediction quality, significance, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.distributions import gamma_cdf_column
from kinfold.operators import diagnostics as di, quality as qu, results as re_, significance as si
from kinfold.plans.fixtures import Inputs
from kinfold.plans.queries_annotation import pw_snps
from kinfold.plans.registry import query, r, rounded
from kinfold.session import staged

# ---- result extraction


def llik_report(x: Inputs):
    """Report rows (trait, pathway, random_group, key, x1), the number as text, now and then unusable."""
    li = x.null
    text = F.when(F.col("size") % 97 == 0, "NA").otherwise((F.col("lr") * 2).cast("decimal(18,4)").cast("string"))
    key = F.when(F.col("size") % 2 == 0, "Alt_Likelihood").otherwise("Null_Likelihood")
    return li.select("trait", "pathway", "random_group", "size", key.alias("key"), text.alias("x1"))


LLIK = """rep AS (SELECT trait, pathway, random_group, size, CASE WHEN size%2=0 THEN 'Alt_Likelihood' ELSE 'Null_Likelihood' END AS key,
    CASE WHEN size%97=0 THEN 'NA' ELSE CAST(CAST(lr*2 AS DECIMAL(18,4)) AS VARCHAR) END AS x1 FROM fx_null),
    ll AS (SELECT trait, pathway, random_group, size, TRY_CAST(x1 AS DOUBLE) AS null_llik FROM rep WHERE key='Alt_Likelihood'),
    base AS (SELECT trait, round(avg(lr),6) AS gblup_llik FROM fx_null GROUP BY trait)"""


def base_llik(x: Inputs):
    return x.null.groupBy("trait").agg(F.round(F.avg("lr"), 6).alias("gblup_llik"))


@query("R1", "SELECT trait, pathway, random_group, component, share, sd FROM fx_null WHERE component='Share_K1' AND sd IS NOT NULL")
def heritability_rows(x):
    rows = x.null.select("trait", "pathway", "random_group", "component", "share", "sd")
    twin = rows.withColumn("component", F.lit("Share_K2"))
    return re_.heritability(rows.unionByName(twin), ["Share_K1"])


@query("R2", f"WITH {LLIK} SELECT trait, pathway, random_group, size, null_llik FROM ll")
def loglik_rows(x):
    return re_.loglik(llik_report(x), "null_llik", ["trait", "pathway", "random_group", "size"])


PREDS = """ph AS (SELECT 'family' AS fid, iid, trait, value AS phenotype FROM fx_pheno_long),
    pr AS (SELECT 'family' AS fid, l_suppkey AS iid, 'qty' AS trait, 'cv'||(l_orderkey%2+1) AS cvnum, CAST(l_partkey%5+1 AS INTEGER) AS fold,
        round(avg(l_quantity),8) AS total FROM lineitem GROUP BY ALL),
    fo AS (SELECT 'family' AS fid, s_suppkey AS iid, 'cv'||c AS cvnum, CAST((s_suppkey*7+c)%5+1 AS INTEGER) AS fold FROM supplier, (VALUES (1),(2)) v(c))"""


@query("R3", f"""WITH {PREDS} SELECT ph.fid, ph.iid, ph.trait, ph.phenotype, pr.cvnum, pr.fold, pr.total FROM ph
    LEFT JOIN pr ON pr.fid=ph.fid AND pr.iid=ph.iid AND pr.trait=ph.trait
    JOIN fo ON fo.fid=ph.fid AND fo.iid=ph.iid AND fo.cvnum=pr.cvnum AND fo.fold=pr.fold""")
def test_predictions(x):
    fam = F.lit("family").alias("fid")
    pheno = x.pheno_long.select(fam, "iid", "trait", F.col("value").alias("phenotype"))
    preds = x.table("lineitem").groupBy(
        fam, F.col("l_suppkey").alias("iid"), F.lit("qty").alias("trait"),
        F.concat(F.lit("cv"), (F.col("l_orderkey") % 2 + 1).cast("string")).alias("cvnum"),
        (F.col("l_partkey") % 5 + 1).cast("int").alias("fold"),
    ).agg(F.round(F.avg("l_quantity"), 8).alias("total"))
    folds = x.table("supplier").withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        fam, F.col("s_suppkey").alias("iid"), F.concat(F.lit("cv"), F.col("c").cast("string")).alias("cvnum"),
        ((F.col("s_suppkey") * 7 + F.col("c")) % 5 + 1).cast("int").alias("fold"),
    )
    return re_.test_predictions(pheno, preds, folds)


@query("R4", f"""WITH {LLIK} SELECT ll.*, base.gblup_llik, round(2*(null_llik-gblup_llik),8) AS lr FROM ll LEFT JOIN base ON base.trait=ll.trait""")
def likelihood_ratio(x):
    ll = re_.loglik(llik_report(x), "null_llik", ["trait", "pathway", "random_group", "size"])
    return rounded(re_.likelihood_ratio(ll, base_llik(x)), 8, "lr")


SIZE_BIN = """CASE WHEN size BETWEEN 0 AND 50000 THEN (CASE WHEN greatest(ceil(size/10000),1)=1 THEN '[' ELSE '(' END)||
    CAST(CAST((greatest(ceil(size/10000),1)-1)*10000 AS BIGINT) AS VARCHAR)||','||CAST(CAST(greatest(ceil(size/10000),1)*10000 AS BIGINT) AS VARCHAR)||']' END"""


@query("R5", f"SELECT {SIZE_BIN} AS group_size, count(*) AS n, min(size) AS lo, max(size) AS hi FROM fx_null GROUP BY 1")
def size_bins(x):
    return re_.with_size_bin(x.null).groupBy("group_size").agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")
    )


@query("R6", """WITH u AS (SELECT DISTINCT trait, pathway, random_group, component, size, share, sd, lr FROM fx_null),
    lr AS (SELECT DISTINCT trait, pathway, random_group, lr FROM u), sh AS (SELECT DISTINCT trait, pathway, random_group, component, share, sd FROM u WHERE size%3<>0),
    sz AS (SELECT pathway, random_group, max(size) AS size FROM u WHERE size%5<>0 GROUP BY ALL)
    SELECT lr.*, sh.component, sh.share, sh.sd, sz.size FROM lr LEFT JOIN sh ON sh.trait=lr.trait AND sh.pathway=lr.pathway AND sh.random_group=lr.random_group
    LEFT JOIN sz ON sz.pathway=sh.pathway AND sz.random_group=sh.random_group""")
def null_results(x):
    lr = x.null.select("trait", "pathway", "random_group", "lr").distinct()
    shares = x.null.where("size % 3 <> 0").select("trait", "pathway", "random_group", "component", "share", "sd").distinct()
    sizes = x.null.where("size % 5 <> 0").groupBy("pathway", "random_group").agg(F.max("size").alias("size"))
    return re_.null_results(lr, shares, sizes, ["trait", "pathway", "random_group"], ["pathway", "random_group"])


@query("R7", """SELECT trait, CAST(sum(CASE WHEN sd<0 OR lr<0 THEN 0 ELSE 1 END) AS BIGINT) AS n_groups,
    CAST(sum(CASE WHEN sd<0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(sum(CASE WHEN lr<0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative_lr
    FROM fx_null GROUP BY trait""")
def null_audit(x):
    return re_.null_audit(x.null)


@query("R8", """SELECT pathway, count(*) FILTER (sd<0) AS n_failed, count(*) FILTER (share<0) AS n_negative FROM fx_null
    WHERE component='Share_K1' AND pathway NOT IN ('pw4') AND (sd<0 OR share<0) GROUP BY pathway""")
def share_audit(x):
    return re_.share_audit(x.null, ["pw4"])


@query("R9", "SELECT trait, pathway, random_group, size, greatest(0, least(1, share)) AS share FROM fx_null")
def clamp_shares(x):
    return re_.clamp_shares(x.null.select("trait", "pathway", "random_group", "size", "share"))


@query("R10", "SELECT * FROM fx_null WHERE sd>0 AND lr>=0 AND component='Share_K1'")
def usable_null(x):
    return re_.usable_null(x.null)


@query("R11", """WITH u AS (SELECT pathway, size AS n_snps, size%700 AS n_genes FROM fx_null) SELECT pathway, min(n_genes) AS n_genes_min,
    max(n_genes) AS n_genes_max, min(n_snps) AS n_snps_min, max(n_snps) AS n_snps_max FROM u GROUP BY pathway""")
def null_ranges(x):
    return re_.null_ranges(x.null.select("pathway", F.col("size").alias("n_snps"), (F.col("size") % 700).alias("n_genes")))


# ---- prediction quality

SINGLE = """single AS (SELECT p.trait, cvnum, fold, corr(phenotype,total_single) AS pa, regr_slope(phenotype,total_single) AS bias_slope,
    avg((phenotype-total_single)*(phenotype-total_single)) AS mse, count(*) AS n, max(h.h2) AS h2 FROM fx_pred p JOIN fx_h2 h ON h.trait=p.trait GROUP BY ALL)"""
MULTI = SINGLE.replace("single AS (SELECT p.trait, cvnum", "multi AS (SELECT p.trait, pathway, cvnum").replace("total_single", "total_multi")
METRIC_COLS = "round(pa,6) AS pa, round(pa*pa/nullif(h2,0),6) AS reliability, round(bias_slope,6) AS bias_slope, round(mse,4) AS mse, n, h2"


def single_metrics(x: Inputs):
    return qu.fold_metrics(x.pred, x.h2, ["trait", "cvnum", "fold"], "total_single")


def multi_metrics(x: Inputs):
    return qu.fold_metrics(x.pred, x.h2, ["trait", "pathway", "cvnum", "fold"], "total_multi")


def _metrics(df):
    return rounded(rounded(df, 6, "pa", "reliability", "bias_slope"), 4, "mse")


@query("V1", f"WITH {SINGLE} SELECT trait, cvnum, fold, {METRIC_COLS} FROM single")
def fold_metrics(x):
    return _metrics(single_metrics(x))


@query("V1", f"WITH {MULTI} SELECT trait, pathway, cvnum, fold, {METRIC_COLS} FROM multi")
def fold_metrics_by_pathway(x):
    return _metrics(multi_metrics(x))


FAMILY = """CASE WHEN regexp_matches(trait,'asp|thr|met|AspFam') AND NOT regexp_matches(trait,'ile') THEN 'aspartate'
    WHEN regexp_matches(trait,'arg|glu|gln|pro|his|GluFam') THEN 'glutamate' WHEN regexp_matches(trait,'gly|ser|SerFam') THEN 'serine'
    WHEN regexp_matches(trait,'phe|tyr|trp|ShikFam') THEN 'aromatic' WHEN regexp_matches(trait,'total') THEN 'total' ELSE 'BCAA_pyruvate' END"""
MEASURE = "CASE WHEN NOT contains(trait,'_') THEN 'absolute' WHEN contains(trait,'_t') THEN 'relative' ELSE 'family' END"


@query("V2", f"""WITH {SINGLE}, m AS (SELECT *, pa*pa/nullif(h2,0) AS reliability FROM single),
    s AS (SELECT trait, avg(pa) AS a, stddev_samp(pa)/sqrt(count(*)) AS b, avg(reliability) AS c, stddev_samp(reliability)/sqrt(count(*)) AS d,
        avg(bias_slope) AS e, avg(mse) AS f FROM m GROUP BY trait)
    SELECT {MEASURE} AS aa_cat, {FAMILY} AS family, trait, round_even(a,4) AS pa_mean, round_even(b,4) AS pa_se, round_even(c,4) AS reliability_mean,
    round_even(d,4) AS reliability_se, round_even(e,4) AS bias_slope_mean, round_even(f,4) AS mse_mean, round_even(sqrt(f),4) AS rmse FROM s""")
def trait_summary(x):
    return qu.trait_summary(single_metrics(x))


COMPARE = f"""{SINGLE}, {MULTI}, cmp AS (SELECT s.trait, m.pathway, s.cvnum, s.fold, m.pa-s.pa AS pa_diff,
    m.pa*m.pa/nullif(m.h2,0)-s.pa*s.pa/nullif(s.h2,0) AS reliability_diff, s.bias_slope AS single_bias_slope, m.bias_slope AS multi_bias_slope,
    abs(m.bias_slope-1)-abs(s.bias_slope-1) AS bias_slope_diff, s.mse AS single_mse, m.mse AS multi_mse, m.mse-s.mse AS mse_diff
    FROM single s LEFT JOIN multi m ON m.trait=s.trait AND m.cvnum=s.cvnum AND m.fold=s.fold WHERE m.pathway NOT IN ('pw5') OR m.pathway IS NULL)"""
CMP_NUM = ["pa_diff", "reliability_diff", "single_bias_slope", "multi_bias_slope", "bias_slope_diff", "single_mse", "multi_mse", "mse_diff"]


def compared(x: Inputs):
    return qu.compare_models(single_metrics(x), multi_metrics(x), ["pw5"])


@query("V3", f"WITH {COMPARE} SELECT trait, pathway, cvnum, fold, {', '.join(f'round({c},5) AS {c}' for c in CMP_NUM)} FROM cmp")
def compare_models(x):
    return rounded(compared(x), 5, *CMP_NUM)


MEANS = f"""{COMPARE}, mean_ AS (SELECT trait, pathway, {', '.join(f'avg({c}) AS {c}' for c in CMP_NUM)} FROM cmp GROUP BY ALL),
    means AS (SELECT *, sqrt(single_mse) AS single_rmse, sqrt(multi_mse) AS multi_rmse, sqrt(multi_mse)-sqrt(single_mse) AS rmse_diff FROM mean_)"""
MEAN_NUM = CMP_NUM + ["single_rmse", "multi_rmse", "rmse_diff"]


@query("V4", f"WITH {MEANS} SELECT trait, pathway, {', '.join(f'round({c},5) AS {c}' for c in MEAN_NUM)} FROM means")
def mean_differences(x):
    return rounded(qu.mean_differences(compared(x)), 5, *MEAN_NUM)


@query("V5", """SELECT cvnum, fold, round(regr_slope(phenotype,total_single),6) AS slope, round(regr_intercept(phenotype,total_single),5) AS intercept,
    CAST(regr_count(phenotype,total_single) AS BIGINT) AS n FROM fx_pred GROUP BY ALL""")
def calibration(x):
    return rounded(rounded(qu.calibration(x.pred, ["cvnum", "fold"], "total_single"), 6, "slope"), 5, "intercept")


@query("V6", f"""WITH {MULTI} SELECT trait, pathway, cvnum, fold, round(pa,6) AS pa FROM multi
    WHERE pathway IN (SELECT pathway FROM multi GROUP BY 1 HAVING avg(pa)>0.001)""")
def having_mean(x):
    out = qu.having_mean(multi_metrics(x), "pathway", "pa", 0.001)
    return out.select("trait", "pathway", "cvnum", "fold", r("pa").alias("pa"))


@query("V7", """WITH m AS (SELECT pathway, median(share) AS median FROM fx_null GROUP BY 1)
    SELECT pathway, round(median,8) AS median, CAST(dense_rank() OVER (ORDER BY median DESC) AS INTEGER) AS position FROM m""")
def order_by_stat(x):
    return rounded(qu.order_by_stat(x.null, "pathway", "share"), 8, "median")


@query("V8", f"""WITH {SINGLE}, w AS (SELECT trait, cvnum, fold, pa, pa*pa/nullif(h2,0) AS reliability, bias_slope, mse FROM single)
    SELECT trait, cvnum, fold, statistic, round(measurement,4) AS measurement FROM w UNPIVOT (measurement FOR statistic IN (pa, reliability, bias_slope, mse))""")
def melt_metrics(x):
    long = qu.melt_metrics(single_metrics(x), ["trait", "cvnum", "fold"], ["pa", "reliability", "bias_slope", "mse"])
    return long.select("trait", "cvnum", "fold", "statistic", r("measurement", 4).alias("measurement"))


# ---- significance

PVALS = """pv AS (SELECT o.trait, o.pathway, o.share AS multi_h2, o.lr AS multi_lr, count(*) FILTER (n.share>o.share)/count(n.share) AS h2_pval,
    count(*) FILTER (n.lr>o.lr)/count(n.lr) AS lr_pval FROM fx_obs o JOIN fx_null n ON n.trait=o.trait AND n.pathway=o.pathway GROUP BY ALL)"""


def pvalues(x: Inputs):
    out = si.empirical_p(x.obs, x.null)
    return out.select("trait", "pathway", F.col("share").alias("multi_h2"), F.col("lr").alias("multi_lr"),
                      F.col("share_pval").alias("h2_pval"), "lr_pval")


@query("S1", f"WITH {PVALS} SELECT * FROM pv")
def empirical_p(x):
    return pvalues(x)


TEN = [(2, 3), (8, 15), (48, 105)]
TTEST = f"""{SINGLE}, {MULTI}, d AS (SELECT m.trait, m.pathway, s.pa-m.pa AS d FROM multi m JOIN single s ON s.trait=m.trait AND s.cvnum=m.cvnum AND s.fold=m.fold),
    t0 AS (SELECT trait, pathway, count(d) AS n, avg(d) AS mean_diff, avg(d)/nullif(stddev_samp(d)/sqrt(count(d)),0) AS t, count(d)-1 AS df FROM d GROUP BY ALL),
    t1 AS (SELECT *, atan(t/sqrt(df)) AS th FROM t0),
    tt AS (SELECT trait, pathway, n, mean_diff, t, df, 0.5::DOUBLE+(2/pi()*(th+sin(th)*(cos(th)+{'+'.join(f'{a}.0::DOUBLE/{b}*pow(cos(th),{2 * k + 3})' for k, (a, b) in enumerate(TEN))})))/2 AS pa_pval FROM t1)"""


def paired_of(single, multi):
    s = single.select("trait", "cvnum", "fold", F.col("pa").alias("single_pa"))
    m = multi.select("trait", "pathway", "cvnum", "fold", F.col("pa").alias("multi_pa"))
    return si.paired_t(m.join(s, ["trait", "cvnum", "fold"]))


@query("S2", f"WITH {TTEST} SELECT trait, pathway, n, df, round(mean_diff,6) AS mean_diff, round(t,6) AS t, round(pa_pval,8) AS pa_pval FROM tt")
def paired_t(x):
    out = paired_of(single_metrics(x), multi_metrics(x)).select("trait", "pathway", "n", "df", r("mean_diff").alias("mean_diff"), r("t").alias("t"), r("pa_pval", 8).alias("pa_pval"))
    return out


def bh_sql(source: str, p: str, out: str) -> str:
    return f"""{out}_ AS (SELECT trait, pathway, least(1, min(raw) OVER (PARTITION BY trait ORDER BY {p} DESC ROWS UNBOUNDED PRECEDING)) AS {out}
        FROM (SELECT trait, pathway, {p}, (SELECT count(*) FROM {source} z WHERE z.trait=y.trait)/rank_max*{p} AS raw FROM (
        SELECT *, count(*) OVER (PARTITION BY trait ORDER BY {p} RANGE UNBOUNDED PRECEDING) AS rank_max FROM {source} WHERE {p} IS NOT NULL) y))"""


@query("S3", f"""WITH {PVALS}, pn AS (SELECT trait, pathway, CASE WHEN pathway='pw3' THEN NULL ELSE h2_pval END AS h2_pval, lr_pval FROM pv),
    {bh_sql('pn', 'h2_pval', 'h2_fdr')}, {bh_sql('pn', 'lr_pval', 'lr_fdr')}
    SELECT pn.*, round(h.h2_fdr,10) AS h2_fdr, round(l.lr_fdr,10) AS lr_fdr FROM pn LEFT JOIN h2_fdr_ h ON h.trait=pn.trait AND h.pathway=pn.pathway
    LEFT JOIN lr_fdr_ l ON l.trait=pn.trait AND l.pathway=pn.pathway""")
def bh_adjust(x):
    p = staged(pvalues(x), "pvalues").select("trait", "pathway", F.when(F.col("pathway") != "pw3", F.col("h2_pval")).alias("h2_pval"), "lr_pval")
    return rounded(si.bh_adjust(p, ["trait"], ["pathway"], {"h2_pval": "h2_fdr", "lr_pval": "lr_fdr"}), 10, "h2_fdr", "lr_fdr")


def sig4(c: str) -> str:
    return f"""CASE WHEN {c}=0 THEN 0 ELSE round_even({c}*pow(10.0::DOUBLE,3.0::DOUBLE-floor(log10(abs({c})))),0)/pow(10.0::DOUBLE,3.0::DOUBLE-floor(log10(abs({c})))) END"""


FULL_NUM = MEAN_NUM + ["multi_h2", "h2_pval", "multi_lr", "lr_pval", "pa_pval", "h2_fdr", "lr_fdr", "pa_fdr"]
FULL = f"""{MEANS}, {PVALS}, d AS ({TTEST.split(", d AS (", 1)[1]},
    jn AS (SELECT m.*, p.multi_h2, p.h2_pval, p.multi_lr, p.lr_pval, t.pa_pval FROM means m
        LEFT JOIN pv p ON p.trait=m.trait AND p.pathway=m.pathway LEFT JOIN tt t ON t.trait=m.trait AND t.pathway=m.pathway),
    {bh_sql('jn', 'h2_pval', 'h2_fdr')}, {bh_sql('jn', 'lr_pval', 'lr_fdr')}, {bh_sql('jn', 'pa_pval', 'pa_fdr')},
    fj AS (SELECT jn.*, h2_fdr, lr_fdr, pa_fdr FROM jn LEFT JOIN h2_fdr_ h ON h.trait=jn.trait AND h.pathway=jn.pathway
        LEFT JOIN lr_fdr_ l ON l.trait=jn.trait AND l.pathway=jn.pathway LEFT JOIN pa_fdr_ p ON p.trait=jn.trait AND p.pathway=jn.pathway),
    fr AS (SELECT trait, pathway, {', '.join(f'round({sig4(c)},12) AS {c}' for c in FULL_NUM)} FROM fj)"""


def full(x: Inputs):
    single, multi = staged(single_metrics(x), "single"), staged(multi_metrics(x), "multi")
    means = qu.mean_differences(qu.compare_models(single, multi, ["pw5"]))
    joined = staged(si.join_results(means, pvalues(x), paired_of(single, multi)), "joined")
    out = si.adjust_results(joined)
    return rounded(out.select("trait", "pathway", *FULL_NUM), 12, *FULL_NUM)


@query("S4", f"WITH {FULL} SELECT * FROM fr")
def full_results(x):
    return full(x)


CATEGORY = """CASE WHEN regexp_matches(pathway,'degradation_|protein_|protease') THEN 'protein'
    WHEN regexp_matches(pathway,'flavonoids|isoprenoids|N_containing|phenylpropanoids|S_containing') THEN 'specialized'
    WHEN regexp_matches(pathway,'aa_degradation|aa_synthesis|aa_transport') THEN 'amino acid' ELSE 'primary' END"""
ALPHA = 0.6


@query("S5", f"""WITH {FULL} SELECT DISTINCT {MEASURE} AS aa_cat, {CATEGORY} AS category, pathway, trait, multi_h2, h2_pval, h2_fdr, multi_lr, lr_pval,
    lr_fdr, pa_diff, pa_pval, pa_fdr, reliability_diff, bias_slope_diff, rmse_diff FROM fr WHERE h2_fdr<={ALPHA} AND lr_fdr<={ALPHA} AND pa_fdr<={ALPHA}""")
def significant(x):
    return si.significant(full(x), ALPHA)


@query("S6", f"""WITH {FULL}, g AS (SELECT h2_fdr<={ALPHA} AS h2_sig, lr_fdr<={ALPHA} AS lr_sig, pa_fdr<={ALPHA} AS pa_sig FROM fr)
    SELECT h2_sig, lr_sig, pa_sig, count(*) AS n, CAST(grouping(h2_sig, lr_sig, pa_sig) AS INTEGER) AS level FROM g GROUP BY CUBE (h2_sig, lr_sig, pa_sig)""")
def membership_counts(x):
    return si.membership_counts(full(x), ALPHA)


@query("S7", f"""WITH {FULL}, sz AS (SELECT pathway, count(DISTINCT random_group) AS size FROM fx_null GROUP BY 1),
    f AS (SELECT fr.*, size, h2_fdr<={ALPHA} AND lr_fdr<={ALPHA} AND pa_fdr<={ALPHA} AS ok FROM fr LEFT JOIN sz ON sz.pathway=fr.pathway)
    SELECT trait, pathway, multi_h2, pa_diff, size, CASE WHEN ok THEN 'Significant' ELSE 'Nonsignificant' END AS fdr_class,
    CASE WHEN ok THEN pathway ELSE '' END AS label FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FULL_NUM)}""")
def label_results(x):
    sizes = x.null.groupBy("pathway").agg(F.count_distinct("random_group").alias("size"))
    return si.label_results(full(x), sizes, ALPHA).select("trait", "pathway", "multi_h2", "pa_diff", "size", "fdr_class", "label")


# ---- diagnostics

F1 = """(CASE WHEN lr>0 THEN 1-((((1.061405429::DOUBLE*t-1.453152027::DOUBLE)*t+1.421413741::DOUBLE)*t-0.284496736::DOUBLE)*t+0.254829592::DOUBLE)*t*exp(-lr/2) ELSE 0 END)"""
F2 = "(CASE WHEN lr>0 THEN 1-exp(-lr/2) ELSE 0 END)"
CDFS = f"""tf AS (SELECT trait, lr, 1/(1+0.3275911::DOUBLE*sqrt(greatest(lr,0)/2)) AS t FROM fx_null),
    cd AS (SELECT trait, lr, {F1} AS f1, {F2} AS f2 FROM tf),
    ec AS (SELECT *, count(*) OVER (PARTITION BY trait) AS n, rank() OVER w - 1 AS below, count(*) OVER (PARTITION BY trait ORDER BY lr RANGE UNBOUNDED PRECEDING) AS upto
        FROM cd WINDOW w AS (PARTITION BY trait ORDER BY lr)),
    ks AS (SELECT trait, n, max(greatest(upto/n-f1, f1-below/n)) AS d1, max(greatest(upto/n-(0.5*f1+0.5*f2), 0.5*f1+0.5*f2-below/n)) AS d1_5,
        max(greatest(upto/n-f2, f2-below/n)) AS d2 FROM ec GROUP BY trait, n)"""


@query("D1", f"WITH {CDFS} SELECT trait, n, round(d1,8) AS d1, round(d1_5,8) AS d1_5, round(d2,8) AS d2 FROM ks")
def ks_distance(x):
    return rounded(di.ks_distance(x.null), 8, "d1", "d1_5", "d2")


@query("D2", f"""WITH {CDFS}, l AS (SELECT trait, '1' AS df, f1 AS f FROM cd UNION ALL SELECT trait, '1.5', 0.5::DOUBLE*f1+0.5::DOUBLE*f2 FROM cd UNION ALL SELECT trait, '2', f2 FROM cd),
    b AS (SELECT trait, df, least(floor(f*20),19) AS bin, count(*) AS o FROM l GROUP BY ALL)
    SELECT trait, df, CAST(sum(o) AS BIGINT) AS n, round(CAST(sum(o*o) AS DOUBLE)*20/sum(o)-sum(o),5) AS x2 FROM b GROUP BY ALL""")
def chisq_gof(x):
    return rounded(di.chisq_gof(x.null), 5, "x2")


@query("D3", f"""WITH {CDFS} SELECT trait, CASE WHEN d1<=d1_5 AND d1<=d2 THEN '1' WHEN d1_5<=d2 THEN '1.5' ELSE '2' END AS df, round(least(d1,d1_5,d2),8) AS d FROM ks""")
def best_fit(x):
    return rounded(di.best_fit(di.ks_distance(x.null)), 8, "d")


@query("D4", f"""WITH s AS (SELECT trait, {SIZE_BIN} AS group_size, lr FROM fx_null),
    o AS (SELECT *, row_number() OVER (PARTITION BY trait, group_size ORDER BY lr) AS i, count(*) OVER (PARTITION BY trait, group_size) AS n FROM s)
    SELECT trait, group_size, i, lr AS sample, round(-2*ln(1-CASE WHEN n>10 THEN (i-0.5::DOUBLE)/n ELSE (i-0.375::DOUBLE)/(n+0.25::DOUBLE) END),8) AS theoretical FROM o""")
def qq_points(x):
    return rounded(di.qq_points(re_.with_size_bin(x.null), ["trait", "group_size"], df=2), 8, "theoretical")


QQ_P = f"""WITH s AS (SELECT trait, {SIZE_BIN} AS group_size, lr FROM fx_null),
    o AS (SELECT *, row_number() OVER (PARTITION BY trait, group_size ORDER BY lr) AS i, count(*) OVER (PARTITION BY trait, group_size) AS n FROM s)
    SELECT trait, group_size, i, lr AS sample, round(CASE WHEN n>10 THEN (i-0.5::DOUBLE)/n ELSE (i-0.375::DOUBLE)/(n+0.25::DOUBLE) END,6) AS p FROM o"""


def qq_p(x, df: float):
    """Points whose theoretical quantile is put back into the distribution: the probability must be that of the rank."""
    points = di.qq_points(re_.with_size_bin(x.null), ["trait", "group_size"], df=df)
    return points.select("trait", "group_size", "i", "sample", r(gamma_cdf_column(F.col("theoretical"), df)).alias("p"))


@query("D4", QQ_P)
def qq_points_df1(x):
    return qq_p(x, 1)


@query("D4", QQ_P)
def qq_points_df1_5(x):
    return qq_p(x, 1.5)


CURVE = """bn AS (SELECT *, CAST(floor(size/1000) AS INTEGER) AS size_bin FROM fx_null),
    qt AS (SELECT trait, size_bin, count(lr) AS n, quantile_cont(lr, {tau}) AS q, quantile_cont(share, {tau}) AS qs FROM bn GROUP BY ALL),
    cv AS (SELECT trait, size_bin, n, q, max(q) OVER (PARTITION BY trait ORDER BY size_bin) AS threshold,
        qs, max(qs) OVER (PARTITION BY trait ORDER BY size_bin) AS threshold_s FROM qt)"""


@query("D5", f"WITH {CURVE.format(tau=0.95)} SELECT trait, size_bin, n, round(q,8) AS q, round(threshold,8) AS threshold FROM cv")
def quantile_curve(x):
    return rounded(di.quantile_curve(x.null, "lr", 0.95), 8, "q", "threshold")


@query("D5", f"WITH {CURVE.format(tau=0.977)} SELECT trait, size_bin, n, round(qs,8) AS q, round(threshold_s,8) AS threshold FROM cv")
def quantile_curve_share(x):
    return rounded(di.quantile_curve(x.null, "share", 0.977), 8, "q", "threshold")


@query("D6", f"""WITH {CURVE.format(tau=0.95)} SELECT b.trait, b.pathway, b.random_group, b.size, b.lr, round(c.threshold,8) AS threshold, b.lr>=round(c.threshold,8) AS exceeds
    FROM bn b LEFT JOIN cv c ON c.trait=b.trait AND c.size_bin=b.size_bin""")
def flag_exceed(x):
    curve = rounded(di.quantile_curve(x.null, "lr", 0.95), 8, "threshold")
    return di.flag_exceed(x.null, curve, "lr").select("trait", "pathway", "random_group", "size", "lr", "threshold", "exceeds")


@query("D7", "SELECT trait, random_group, size, size/CAST((SELECT count(*) FROM fx_snps) AS DOUBLE) AS expected_share FROM fx_null")
def infinitesimal(x):
    return di.infinitesimal(x.null.select("trait", "random_group", "size"), x.snps)


@query("D8", "SELECT CAST(floor(size/1000) AS BIGINT) AS bin, count(*) AS n FROM fx_null GROUP BY 1")
def histogram_width(x):
    return di.histogram(x.null, "size", width=1000)


@query("D8", """WITH e AS (SELECT trait, min(lr) AS lo, max(lr) AS hi FROM fx_null GROUP BY 1)
    SELECT n.trait, CAST(least(floor((lr-lo)/(hi-lo)*50),49) AS BIGINT) AS bin, count(*) AS n FROM fx_null n JOIN e ON e.trait=n.trait GROUP BY ALL""")
def histogram_bins(x):
    return di.histogram(x.null, "lr", ["trait"], bins=50)


@query("D9", """WITH q AS (SELECT trait, pathway, count(lr) AS n, quantile_cont(lr,0.25) AS q1, quantile_cont(lr,0.5) AS median, quantile_cont(lr,0.75) AS q3 FROM fx_null GROUP BY ALL)
    SELECT q.trait, q.pathway, q.n, round(q1,8) AS q1, round(median,8) AS median, round(q3,8) AS q3,
    min(lr) FILTER (lr BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1)) AS whisker_low, max(lr) FILTER (lr BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1)) AS whisker_high,
    count(*) FILTER (NOT lr BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1)) AS n_outliers FROM fx_null x JOIN q ON q.trait=x.trait AND q.pathway=x.pathway GROUP BY ALL""")
def box_stats(x):
    return rounded(di.box_stats(x.null, "lr", ["trait", "pathway"]), 8, "q1", "median", "q3")


@query("D10", f"""WITH len AS (SELECT chromosome, max(position) AS length FROM fx_snps GROUP BY 1),
    s AS (SELECT pathway, {CATEGORY} AS category, chromosome, snp_id, position FROM pw_snps),
    g AS (SELECT a.pathway, a.category, b.chromosome FROM (SELECT DISTINCT pathway, category FROM s) a, (SELECT DISTINCT chromosome FROM s) b)
    SELECT g.pathway, g.category, 'chr'||g.chromosome AS chromosome, s.snp_id, s.position/1e6::DOUBLE AS position_mb, len.length/1e6::DOUBLE AS length_mb
    FROM g LEFT JOIN s ON s.pathway=g.pathway AND s.chromosome=g.chromosome LEFT JOIN len ON len.chromosome=g.chromosome""")
def snp_locations(x):
    lengths = x.snps.groupBy("chromosome").agg(F.max("position").alias("length"))
    return di.snp_locations(pw_snps(x), lengths)
