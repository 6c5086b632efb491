"""Phenotypes and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.labels import (
    CATEGORY_ORDER, PATHWAY_EXCLUDE, PATHWAY_RENAMES, PATHWAYS, TRAITS, label_rank, pathway_category,
)
from kinfold.operators import phenotype as ph
from kinfold.plans.fixtures import TRAIT_COLS, Inputs
from kinfold.plans.registry import query, r


def raw_long(x: Inputs):
    return ph.melt_traits(x.raw, ["line", "population"])


@query("T1", "SELECT line, population, trait, value FROM fx_raw_long")
def melt_traits(x):
    return raw_long(x)


LAMBDAS = ",".join(f"({lam})" for lam in ph.LAMBDAS)
BOXCOX = f"""pos AS (SELECT trait, line, population, CASE WHEN value>0 THEN value END AS v FROM fx_raw_long),
    ll AS MATERIALIZED (SELECT trait, l, -count(v)/2.0::DOUBLE*ln(nullif(var_pop(CASE WHEN l=0 THEN ln(v) ELSE (pow(v,l)-1)/l END),0))
        +(l-1)*sum(ln(v)) AS loglik FROM pos, (SELECT CAST(c AS DOUBLE) AS l FROM (VALUES {LAMBDAS}) t(c)) GROUP BY trait, l),
    best AS MATERIALIZED (SELECT trait, l AS "lambda", loglik FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY loglik DESC, l) rn
        FROM ll WHERE loglik IS NOT NULL) WHERE rn=1)"""


@query("T2", f'WITH {BOXCOX} SELECT trait, round("lambda",3) AS "lambda", round(loglik,3) AS loglik FROM best')
def boxcox_lambda(x):
    return ph.boxcox_lambdas(raw_long(x)).select("trait", r("lambda", 3).alias("lambda"), r("loglik", 3).alias("loglik"))


@query("T2", f"""WITH {BOXCOX}, t AS (SELECT p.trait, p.line, CASE WHEN b."lambda"=0 THEN ln(v) ELSE (pow(v,b."lambda")-1)/b."lambda" END AS y
    FROM pos p JOIN best b ON b.trait=p.trait)
    SELECT trait, line, count(*) AS n, count(y) AS n_positive, round(sum(y),4) AS total, round(min(y),6) AS least, round(max(y),6) AS most FROM t GROUP BY trait, line""")
def boxcox(x):
    y = F.col("transformed")
    sums = ph.boxcox(raw_long(x)).groupBy("trait", "line").agg(
        F.count(F.lit(1)).alias("n"), F.count(y).alias("n_positive"), F.sum(y).alias("total"), F.min(y).alias("least"), F.max(y).alias("most"))
    return sums.select("trait", "line", "n", "n_positive", r("total", 4).alias("total"), r("least").alias("least"), r("most").alias("most"))


# Unbalanced lines and three environments: eliminate lines, fix the last environment at 0, solve 2 x 2, centre.
BLUES = """cell AS (SELECT trait, line, population AS e, CAST(count(*) AS DOUBLE) AS n, sum(value) AS s FROM fx_raw_long GROUP BY ALL),
    ln_ AS (SELECT trait, line, sum(n) AS ni, sum(s) AS si, coalesce(sum(n) FILTER (e='A'),0) AS na, coalesce(sum(n) FILTER (e='N'),0) AS nn,
        coalesce(sum(n) FILTER (e='R'),0) AS nr, coalesce(sum(s) FILTER (e='A'),0) AS sa, coalesce(sum(s) FILTER (e='N'),0) AS sn FROM cell GROUP BY ALL),
    ne AS (SELECT trait, sum(na-na*na/ni) AS caa, sum(nn-nn*nn/ni) AS cnn, sum(-na*nn/ni) AS can, sum(sa-na*si/ni) AS ra, sum(sn-nn*si/ni) AS rn
        FROM ln_ GROUP BY trait),
    ef AS (SELECT trait, (ra*cnn-rn*can)/(caa*cnn-can*can) AS ea, (rn*caa-ra*can)/(caa*cnn-can*can) AS en FROM ne),
    blues AS (SELECT l.trait, l.line, (si-na*(ea-(ea+en)/3)-nn*(en-(ea+en)/3)+nr*(ea+en)/3)/ni AS blue, CAST(ni AS BIGINT) AS n
        FROM ln_ l JOIN ef ON ef.trait=l.trait)"""


@query("T3", f"WITH {BLUES} SELECT trait, line, round(blue,5) AS blue, n FROM blues")
def line_estimates(x):
    return ph.blue(raw_long(x)).select("trait", "line", r("blue", 5).alias("blue"), "n")


@query("T3", """WITH c AS (SELECT trait, line, population, avg(value) AS v FROM fx_raw_long GROUP BY ALL)
    SELECT trait, line, round(avg(v),5) AS blue FROM c GROUP BY trait, line HAVING count(*)=3""")
def line_estimates_balanced(x):
    cells = raw_long(x).groupBy("trait", "line", "population").agg(F.avg("value").alias("value"))
    full = cells.groupBy("trait", "line").agg(F.count(F.lit(1)).alias("c")).where("c = 3")
    return ph.blue(cells.join(full, ["trait", "line"], "left_semi")).select("trait", "line", r("blue", 5).alias("blue"))


@query("T4", f"""WITH {BLUES} SELECT p.trait, round(corr(b.blue, p.value),5) AS pearson FROM fx_pheno_long p
    LEFT JOIN blues b ON b.line=p.iid AND b.trait=p.trait GROUP BY p.trait""")
def trait_agreement(x):
    blues = ph.blue(raw_long(x)).select(F.col("line").alias("iid"), "trait", "blue")
    return ph.trait_agreement(x.pheno_long, blues, "blue", "value").select("trait", r("pearson", 5).alias("pearson"))


@query("T4", f"""WITH {BLUES}, m AS (SELECT line AS iid, trait, min(value) AS lo FROM fx_raw_long GROUP BY ALL)
    SELECT m.trait, round(corr(b.blue, m.lo),5) AS pearson FROM m LEFT JOIN blues b ON b.line=m.iid AND b.trait=m.trait
    GROUP BY m.trait HAVING corr(b.blue, m.lo)<0.9""")
def trait_disagreement(x):
    blues = ph.blue(raw_long(x)).select(F.col("line").alias("iid"), "trait", "blue")
    lows = raw_long(x).groupBy(F.col("line").alias("iid"), "trait").agg(F.min("value").alias("lo"))
    return ph.trait_agreement(lows, blues, "blue", "lo", below=0.9).select("trait", r("pearson", 5).alias("pearson"))


@query("T5", """SELECT 'family' AS FID, p.iid AS IID, qty, price, disc, tax FROM fx_pheno p
    WHERE p.iid IN (SELECT s_suppkey FROM supplier WHERE s_nationkey%2=0)""")
def export_phenotypes(x):
    genotyped = x.table("supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("iid"))
    return ph.plink_pheno(x.pheno_long, genotyped, TRAIT_COLS)


def names_sql(names: list[str]) -> str:
    return "[" + ",".join(f"'{n}'" for n in names) + "]"


def pick(names: list[str], key: str):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(key) % len(names) + 1).cast("int"))


@query("T6", f"""WITH t AS (SELECT {names_sql(TRAITS)}[1+l_partkey%{len(TRAITS)}] AS trait FROM lineitem),
    c AS (SELECT trait, CASE WHEN regexp_matches(trait,'asp|thr|met|AspFam') AND NOT regexp_matches(trait,'ile') THEN 'aspartate'
        WHEN regexp_matches(trait,'arg|glu|gln|pro|his|GluFam') THEN 'glutamate' WHEN regexp_matches(trait,'gly|ser|SerFam') THEN 'serine'
        WHEN regexp_matches(trait,'phe|tyr|trp|ShikFam') THEN 'aromatic' WHEN regexp_matches(trait,'total') THEN 'total'
        ELSE 'BCAA_pyruvate' END AS family,
        CASE WHEN NOT contains(trait,'_') THEN 'absolute' WHEN contains(trait,'_t') THEN 'relative' ELSE 'family' END AS aa_cat FROM t)
    SELECT trait, family, aa_cat, count(*) AS n FROM c GROUP BY ALL""")
def classify_trait(x):
    rows = x.table("lineitem").select(pick(TRAITS, "l_partkey").alias("trait"))
    return ph.classify_trait(rows).groupBy("trait", "family", "aa_cat").agg(F.count(F.lit(1)).alias("n"))


@query("T7", f"""WITH t AS (SELECT {names_sql(list(PATHWAYS))}[1+l_partkey%{len(PATHWAYS)}] AS pathway FROM lineitem),
    c AS (SELECT pathway, CASE WHEN regexp_matches(pathway,'degradation_|protein_|protease') THEN 'protein'
        WHEN regexp_matches(pathway,'flavonoids|isoprenoids|N_containing|phenylpropanoids|S_containing') THEN 'specialized'
        WHEN regexp_matches(pathway,'aa_degradation|aa_synthesis|aa_transport') THEN 'amino acid' ELSE 'primary' END AS category FROM t)
    SELECT pathway, category, CAST(list_position(['amino acid','primary','specialized','protein'],category) AS INTEGER) AS category_rank,
    count(*) AS n FROM c GROUP BY ALL""")
def classify_pathway(x):
    rows = x.table("lineitem").select(pick(list(PATHWAYS), "l_partkey").alias("pathway"))
    out = rows.withColumn("category", pathway_category(F.col("pathway")))
    out = out.withColumn("category_rank", label_rank(F.col("category"), CATEGORY_ORDER))
    return out.groupBy("pathway", "category", "category_rank").agg(F.count(F.lit(1)).alias("n"))


@query("T8", f"""WITH t AS (SELECT {names_sql(list(PATHWAYS))}[1+l_partkey%{len(PATHWAYS)}] AS p, l_orderkey, l_linenumber FROM lineitem),
    c AS (SELECT CASE p {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PATHWAY_RENAMES.items())} ELSE p END AS pathway, l_orderkey, l_linenumber FROM t)
    SELECT * FROM c WHERE NOT list_contains({names_sql(PATHWAY_EXCLUDE)}, pathway)""")
def recode_exclude(x):
    rows = x.table("lineitem").select(pick(list(PATHWAYS), "l_partkey").alias("pathway"), "l_orderkey", "l_linenumber")
    return ph.recode_exclude(rows, "pathway", PATHWAY_RENAMES, PATHWAY_EXCLUDE)
