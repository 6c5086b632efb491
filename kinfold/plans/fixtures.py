"""Domain inputs derived from the given tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.functions.labels import PATHWAYS
from kinfold.operators import genotype

# Of the pathway dictionary, those whose category codes the derived table has, and a curated list.
PATTERNS = {name: PATHWAYS[name] for name in (
    "protein_synthesis", "protein_targeting", "protein_degradation", "degradation_autophagy", "degradation_ubiquitin", "protein_folding",
    "aa_syn_nobcat_haplo")}
TRAIT_COLS = ["qty", "price", "disc", "tax"]


KEYS, CELLS = 1024, 1 << 22  # SNPs of a block; dosages of a batch


def _key_blocks(batches):
    """Keys packed in arrays, so that the samples stand beside a block of SNPs and not beside each."""
    for batch in batches:
        for lo in range(0, batch.num_rows, KEYS):
            yield pa.RecordBatch.from_arrays([pa.array([batch["p_partkey"].slice(lo, KEYS).to_pylist()], pa.list_(pa.int64()))], names=["keys"])


def _remainder(x: np.ndarray, m: int) -> np.ndarray:
    """x % m as in SQL, with the sign of x."""
    return x - x // m * m if len(x) and x.min() >= 0 else np.fmod(x, m)


def _dosages(batches):
    """The dosages of every key and sample, formed a SNP at a time; a SNP without a key has none."""
    for batch in batches:
        for row in range(batch.num_rows):
            s = batch["iids"][row].values.to_numpy(zero_copy_only=False).astype(np.int64)
            keys, n, by_missing, by_two = batch["keys"][row].as_py(), len(s), s * 13, s * 7919
            step = max(1, CELLS // max(n, 1))
            for lo in range(0, len(keys), step):
                some = keys[lo : lo + step]
                dose = np.full((len(some), n), genotype.MISSING, np.int8)
                for at, p in enumerate(some):
                    if p is not None:
                        missing = _remainder(by_missing + p * 17, int(np.fmod(p, 40)) + 11) == 0
                        two = _remainder(by_two + p * 104729 + s * (p * 31), 101) < np.fmod(p, 50)
                        dose[at] = np.where(missing, genotype.MISSING, 2 * two.view(np.int8))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([row.tobytes() for row in dose], pa.binary())], names=["p_partkey", "dosages"])


class Inputs:
    """The derived tables of one data folder; each property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def wide(self, df: DataFrame, *keys: str) -> DataFrame:
        """Spread a small file that expands into heavy rows over all cores."""
        return df.repartition(self.spark.sparkContext.defaultParallelism, *keys)

    @property
    def snps(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            F.concat(F.lit("S"), key.cast("string")).alias("snp_id"), (key % 5 + 1).cast("int").alias("chromosome"),
            (key * 618033 % 1000003).alias("position"),
        )

    @property
    def genes(self) -> DataFrame:
        key = F.col("c_custkey")
        start = key * 414213 % 1000003
        return self.table("customer").select(
            self._gene_id().alias("ensembl_gene_id"), (key % 5 + 1).cast("int").alias("chromosome_name"),
            start.alias("start_position"), (start + 500 + key % 20 * 200).alias("end_position"),
        )

    @staticmethod
    def _gene_id():
        key = F.col("c_custkey")
        return F.concat(F.lit("AT"), (key % 5 + 1).cast("string"), F.lit("G"), F.lpad(key.cast("string"), 6, "0"))

    @property
    def cats(self) -> DataFrame:
        key, k = F.col("c_custkey"), F.col("k")
        base = self.table("customer").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        tail = F.when(key % 2 == 0, F.concat(F.lit("."), (F.expr("c_custkey div 2") % 11 + 1).cast("string"))).otherwise("")
        return base.select(
            F.lower(self._gene_id()).alias("identifier"),
            F.concat(((F.col("c_nationkey") + k) % 3 + 27).cast("string"), F.lit("."),
                     ((key + k) % 6 + 1).cast("string"), tail).alias("bincode"),
            F.lower("c_mktsegment").alias("name"),
        )

    @property
    def curated(self) -> DataFrame:
        return self.table("part").where(F.col("p_partkey") % 23 == 0).select(
            F.lit("aa_syn_nobcat_haplo").alias("pathway"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("snp_id")
        )

    @property
    def panel(self) -> DataFrame:
        return genotype.panel_of(self.table("supplier").select(F.col("s_suppkey").alias("iid")))

    @property
    def geno_bytes(self) -> DataFrame:
        """SNP-major dosages, one byte per supplier: formed where a step reads them, for steps that read them once."""
        keys = self.wide(self.table("part").select(F.col("p_partkey").cast("bigint").alias("p_partkey")), "p_partkey")
        blocks = keys.mapInArrow(_key_blocks, "keys array<bigint>").withColumn("iids", self.panel.scalar())
        p = F.col("p_partkey")
        return blocks.mapInArrow(_dosages, "p_partkey bigint, dosages binary").select(
            F.concat(F.lit("S"), p.cast("string")).alias("snp_id"), (p % 5 + 1).cast("int").alias("chromosome"),
            (p * 618033 % 1000003).alias("position"), "dosages",
        )

    @cached_property
    def geno(self) -> DataFrame:
        """SNP-major dosages, one array entry per supplier: a stored table, as genotypes are."""
        return genotype.stored(self.geno_bytes, "geno")

    @property
    def geno_long(self) -> DataFrame:
        return genotype.to_long(self.geno, self.panel)

    @property
    def raw(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("line"), F.col("l_returnflag").alias("population"), F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        )

    @property
    def pheno(self) -> DataFrame:
        return self.raw.groupBy(F.col("line").alias("iid")).agg(*[F.round(F.avg(c), 9).alias(c) for c in TRAIT_COLS])

    @property
    def pheno_long(self) -> DataFrame:
        return self.pheno.unpivot(["iid"], TRAIT_COLS, "trait", "value")

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("iid"), "embedding", "label")

    def covariates(self, k: int) -> DataFrame:
        return self.embeddings.select("iid", *[F.get("embedding", i).cast("double").alias(f"pc{i + 1}") for i in range(k)])

    @property
    def null(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat("l_returnflag", "l_linestatus").alias("trait"),
            F.concat(F.lit("pw"), (F.col("l_suppkey") % 6).cast("string")).alias("pathway"),
            F.concat(F.lit("c_"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                                              F.col("l_partkey").cast("string"))).alias("random_group"),
            F.lit("Share_K1").alias("component"), (F.col("l_partkey") * 2503 % 52000 + 1).alias("size"),
            (F.col("l_discount") * 9 + F.col("l_tax") - 0.03).alias("share"), (F.col("l_tax") - 0.005).alias("sd"),
            (F.col("l_quantity") * F.col("l_quantity") / 200.0 - 1).alias("lr"),
        )

    @property
    def obs(self) -> DataFrame:
        i = F.substring("pathway", 3, 1).cast("int")
        return self.null.groupBy("trait", "pathway").agg(
            F.avg("share").alias("s"), F.avg("lr").alias("l")
        ).select("trait", "pathway", F.round(F.col("s") + 0.09 * i, 8).alias("share"), F.round(F.col("l") + 1.5 * i, 8).alias("lr"))

    @property
    def pred(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat("l_returnflag", "l_linestatus").alias("trait"),
            F.concat(F.lit("pw"), (F.col("l_suppkey") % 6).cast("string")).alias("pathway"),
            F.concat(F.lit("cv"), (F.col("l_orderkey") % 2 + 1).cast("string")).alias("cvnum"),
            (F.col("l_partkey") % 5 + 1).cast("int").alias("fold"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("iid"),
            (F.col("l_extendedprice") / 1000).alias("phenotype"), F.col("l_quantity").alias("total_multi"),
            (F.col("l_quantity") * 0.7 + F.col("l_tax") * 200).alias("total_single"),
        )

    @property
    def h2(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("trait")).agg(
            F.round(F.avg("l_discount") * 10, 8).alias("h2")
        )


# The same tables as SQL; a name used in another text is added in front of it.
SQL = {
    "fx_snps": """SELECT 'S'||p_partkey AS snp_id, CAST(p_partkey%5+1 AS INTEGER) AS chromosome,
        (p_partkey*618033)%1000003 AS position FROM part""",
    "fx_genes": """SELECT 'AT'||(c_custkey%5+1)||'G'||lpad(CAST(c_custkey AS VARCHAR),6,'0') AS ensembl_gene_id,
        CAST(c_custkey%5+1 AS INTEGER) AS chromosome_name, (c_custkey*414213)%1000003 AS start_position,
        (c_custkey*414213)%1000003+500+(c_custkey%20)*200 AS end_position FROM customer""",
    "fx_cats": """SELECT lower('AT'||(c_custkey%5+1)||'G'||lpad(CAST(c_custkey AS VARCHAR),6,'0')) AS identifier,
        (27+(c_nationkey+k)%3)||'.'||(1+(c_custkey+k)%6)||
        CASE WHEN c_custkey%2=0 THEN '.'||(1+(c_custkey//2)%11) ELSE '' END AS bincode,
        lower(c_mktsegment) AS name FROM customer, (VALUES (0),(1)) v(k)""",
    "fx_curated": "SELECT 'aa_syn_nobcat_haplo' AS pathway, 'S'||p_partkey AS snp_id FROM part WHERE p_partkey%23=0",
    "fx_geno": """SELECT s_suppkey AS iid, 'S'||p_partkey AS snp_id,
        CASE WHEN (s_suppkey*13+p_partkey*17)%(11+p_partkey%40)=0 THEN NULL
             WHEN (s_suppkey*7919+p_partkey*104729+s_suppkey*p_partkey*31)%101 < p_partkey%50 THEN 2 ELSE 0 END AS dosage
        FROM supplier, part""",
    "fx_raw": """SELECT l_suppkey AS line, l_returnflag AS population, l_quantity AS qty, l_extendedprice AS price,
        l_discount AS disc, l_tax AS tax FROM lineitem""",
    "fx_pheno": """SELECT line AS iid, round(avg(qty),9) AS qty, round(avg(price),9) AS price, round(avg(disc),9) AS disc,
        round(avg(tax),9) AS tax FROM fx_raw GROUP BY line""",
    "fx_pheno_long": """SELECT iid, 'qty' AS trait, qty AS value FROM fx_pheno UNION ALL SELECT iid,'price',price FROM fx_pheno
        UNION ALL SELECT iid,'disc',disc FROM fx_pheno UNION ALL SELECT iid,'tax',tax FROM fx_pheno""",
    "fx_raw_long": """SELECT line, population, 'qty' AS trait, qty AS value FROM fx_raw
        UNION ALL SELECT line, population,'price',price FROM fx_raw UNION ALL SELECT line, population,'disc',disc FROM fx_raw
        UNION ALL SELECT line, population,'tax',tax FROM fx_raw""",
    "fx_null": """SELECT l_returnflag||l_linestatus AS trait, 'pw'||(l_suppkey%6) AS pathway,
        'c_'||l_orderkey||'_'||l_linenumber||'_'||l_partkey AS random_group, 'Share_K1' AS component,
        (l_partkey*2503)%52000+1 AS size, l_discount*9+l_tax-0.03::DOUBLE AS share, l_tax-0.005::DOUBLE AS sd,
        l_quantity*l_quantity/200.0::DOUBLE-1 AS lr FROM lineitem""",
    "fx_obs": """SELECT trait, pathway, round(s+0.09::DOUBLE*i,8) AS share, round(l+1.5::DOUBLE*i,8) AS lr FROM (
        SELECT trait, pathway, CAST(substr(pathway,3,1) AS INTEGER) AS i, avg(share) AS s, avg(lr) AS l FROM fx_null GROUP BY ALL)""",
    "fx_pred": """SELECT l_returnflag||l_linestatus AS trait, 'pw'||(l_suppkey%6) AS pathway, 'cv'||(l_orderkey%2+1) AS cvnum,
        CAST(l_partkey%5+1 AS INTEGER) AS fold, l_orderkey*10+l_linenumber AS iid, l_extendedprice/1000 AS phenotype,
        l_quantity AS total_multi, l_quantity*0.7::DOUBLE+l_tax*200 AS total_single FROM lineitem""",
    "fx_h2": "SELECT l_returnflag||l_linestatus AS trait, round(avg(l_discount)*10,8) AS h2 FROM lineitem GROUP BY 1",
    # annotation steps
    "snp_gene": """SELECT chromosome, position, ensembl_gene_id, snp_id FROM (
        SELECT s.*, g.ensembl_gene_id, row_number() OVER (PARTITION BY s.snp_id ORDER BY g.start_position, g.ensembl_gene_id) rn
        FROM fx_snps s LEFT JOIN fx_genes g ON g.chromosome_name=s.chromosome AND s.position BETWEEN g.start_position AND g.end_position)
        WHERE rn=1""",
    "gene_cats": """SELECT g.*, c.bincode, c.name FROM fx_genes g JOIN fx_cats c ON upper(c.identifier)=g.ensembl_gene_id""",
    "matched": """SELECT p.pathway, c.* FROM gene_cats c JOIN (VALUES ('protein_synthesis','^29.2',NULL),('protein_targeting','^29.3',NULL),
        ('protein_degradation','^29.5','^29.5.11'),('degradation_autophagy','^29.5.2$',NULL),('degradation_ubiquitin','^29.5.11',NULL),('protein_folding','^29.6',NULL)) p(pathway,a,b)
        ON regexp_matches(c.bincode,p.a) AND (p.b IS NULL OR NOT regexp_matches(c.bincode,p.b))""",
    "pw_genes": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pathway, ensembl_gene_id
        ORDER BY bincode, name) rn FROM matched) WHERE rn=1""",
    "pw_hits": """SELECT g.pathway, s.snp_id, s.chromosome, s.position, s.ensembl_gene_id, g.ensembl_gene_id AS hit_gene_id,
        g.start_position, g.bincode, g.name FROM snp_gene s JOIN pw_genes g ON g.chromosome_name=s.chromosome
        AND s.position BETWEEN g.start_position-2500 AND g.end_position+2500""",
    "pw_snps": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pathway, snp_id
        ORDER BY start_position, hit_gene_id) rn FROM pw_hits) WHERE rn=1""",
    "all_sets": """SELECT pathway, snp_id FROM pw_snps UNION ALL SELECT pathway, snp_id FROM fx_curated""",
    # kinship steps
    "zgeno": """SELECT iid, snp_id, coalesce(dosage-avg(dosage) OVER (PARTITION BY snp_id),0) AS z FROM fx_geno""",
    "gram_all": """SELECT a.iid AS i, b.iid AS j, sum(a.z*b.z) AS a FROM zgeno a JOIN zgeno b
        ON a.snp_id=b.snp_id AND a.iid<=b.iid GROUP BY ALL""",
    "gram_in": """SELECT m.pathway AS set_id, a.iid AS i, b.iid AS j, sum(a.z*b.z) AS a FROM all_sets m
        JOIN zgeno a ON a.snp_id=m.snp_id JOIN zgeno b ON b.snp_id=a.snp_id AND a.iid<=b.iid GROUP BY ALL""",
    "gram_parts": """SELECT set_id, 1 AS partition, i, j, a FROM gram_in UNION ALL
        SELECT g.set_id, 2, g.i, g.j, t.a-g.a FROM gram_in g JOIN gram_all t ON t.i=g.i AND t.j=g.j""",
    "kin_parts": """SELECT p.*, p.a/nullif(c.c,0) AS k FROM gram_parts p JOIN (SELECT set_id, partition, sum(a)/count(*) AS c
        FROM gram_parts WHERE i=j GROUP BY ALL) c ON c.set_id=p.set_id AND c.partition=p.partition""",
}


def _positive_zero(text: str) -> str:
    """Add 0 to every rounded value: -0.0 and 0.0 are one value, also to a comparison of texts."""
    out = []
    for m in re.finditer(r"\bround(_even)?\(", text):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out.append((m.start(), end))
    pieces = list(text)
    for start, end in out:
        pieces[start] = "(" + pieces[start]
        pieces[end - 1] = pieces[end - 1] + "+0)"
    return "".join(pieces)


def oracle(body: str) -> str:
    """Put the needed table definitions in front of a query."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return _positive_zero(body)
    prefix = ",\n".join(f"{n} AS ({SQL[n]})" for n in needed)
    body = body.strip()
    start = "WITH RECURSIVE" if body.startswith("WITH RECURSIVE ") else "WITH"
    joined = f",\n{body[len(start):]}" if body.startswith("WITH ") else f"\n{body}"
    return _positive_zero(f"{start} {prefix}{joined}")
