"""Sources and sinks: every query writes derived tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import genotype as ge, intervals as iv, kinship as ki
from kinfold.plans.fixtures import Inputs
from kinfold.plans.queries_annotation import all_sets
from kinfold.plans.registry import query
from kinfold.session import scratch_path, staged
from kinfold.sources import reports as rp, tables as tb


@query("IO1", """SELECT CAST(s.chromosome AS VARCHAR) AS chromosome, s.position, 'X'||g.iid AS iid, CASE g.dosage WHEN 2 THEN 'A' WHEN 0 THEN 'G' ELSE 'N' END AS call
    FROM fx_geno g JOIN fx_snps s ON s.snp_id=g.snp_id""")
def read_calls(x):
    return tb.read_calls(x.spark, call_file(x)).drop("idx")


def call_file(x: Inputs) -> str:
    """A call table with a banner and a header, written from the derived genotypes."""
    path = scratch_path(x.spark, "calls")
    names = x.panel.select(F.concat_ws(",", F.transform("iids", lambda i: F.concat(F.lit("X"), i.cast("string")))).alias("n"))
    letters = F.transform("dosages", lambda d: F.when(d == 2, "A").when(d == 0, "G").otherwise("N"))
    body = x.geno.select(F.concat_ws(",", F.col("chromosome").cast("string"), F.col("position").cast("string"), F.concat_ws(",", letters)).alias("value"))
    head = names.select(F.explode(F.array(F.lit("call table"), F.concat(F.lit("Chromosome,Positions,"), F.col("n")))).alias("value"))
    head.unionByName(body).write.text(path)
    return path


@query("G7", """WITH c AS (SELECT snp_id, count(*) FILTER (dosage=2) AS a, count(*) FILTER (dosage=0) AS g FROM fx_geno GROUP BY snp_id),
    m AS (SELECT snp_id, CASE WHEN a=0 AND g=0 THEN NULL WHEN a>=g THEN 'A' ELSE 'G' END AS major,
        CASE WHEN a=0 OR g=0 THEN NULL WHEN a>=g THEN 'G' ELSE 'A' END AS minor FROM c)
    SELECT CAST(s.chromosome AS VARCHAR) AS chromosome, s.position, 'X'||f.iid AS iid, m.major, m.minor,
    CASE WHEN f.dosage IS NULL THEN NULL WHEN (f.dosage=2)=(m.major='A') THEN 0 ELSE 2 END AS dosage
    FROM fx_geno f JOIN fx_snps s ON s.snp_id=f.snp_id JOIN m ON m.snp_id=f.snp_id""")
def call_dosages(x):
    geno = ge.call_dosages(tb.read_call_lines(x.spark, call_file(x)))
    pairs = F.arrays_zip(F.col("iids").alias("iid"), F.col("dosages").alias("dosage"))
    return geno.select("chromosome", "position", "major", "minor", F.explode(pairs).alias("_p")).select(
        "chromosome", "position", "_p.iid", "major", "minor", F.col("_p.dosage").cast("int").alias("dosage"))


@query("IO2", "SELECT chromosome, snp_id, CAST(0 AS DOUBLE) AS physical, position FROM fx_snps")
def read_delimited(x):
    path = scratch_path(x.spark, "map")
    tb.write_table(x.snps.select("chromosome", "snp_id", F.lit(0.0).alias("physical"), "position"), path, sep=" ", header=False)
    return tb.read_delim(x.spark, path, "chromosome int, snp_id string, physical double, position bigint")


@query("IO2", "SELECT line, population, qty, tax, count(*) AS n FROM fx_raw GROUP BY ALL")
def read_blank_separated(x):
    path = scratch_path(x.spark, "raw")
    cells = F.concat_ws("   ", *[F.col(c).cast("string") for c in ("line", "population", "qty", "tax")])
    x.raw.select(F.concat(F.lit(" "), cells).alias("value")).write.text(path)
    rows = tb.read_delim(x.spark, path, "line bigint, population string, qty double, tax double", sep=None)
    return rows.groupBy("line", "population", "qty", "tax").agg(F.count(F.lit(1)).alias("n"))


@query("IO3", """SELECT bincode, CASE WHEN length(name)%3<>0 THEN name END AS name,
    CASE WHEN identifier NOT LIKE '%7' THEN identifier END AS identifier FROM fx_cats""")
def read_null_markers(x):
    path = scratch_path(x.spark, "cats")
    marked = x.cats.select(
        "bincode", F.when(F.length("name") % 3 != 0, F.col("name")).otherwise("").alias("name"),
        F.when(~F.col("identifier").like("%7"), F.col("identifier")).otherwise("NA").alias("identifier"),
    )
    tb.write_table(marked, path)
    return tb.read_delim(x.spark, path, "bincode string, name string, identifier string", sep=",", header=True, null_values=["", "NA"])


@query("IO4", "SELECT trait, pathway, random_group, size, share, sd, lr FROM fx_null")
def scan_with_path_keys(x):
    path = scratch_path(x.spark, "null_files")
    tb.write_table(x.null.drop("component"), path, ["pathway", "trait"])
    return tb.scan_with_path_keys(
        x.spark, path, "random_group string, size bigint, share double, sd double, lr double",
        {"pathway": 1, "trait": 3}, split_on="[/=]", glob="*.csv", sep=",",
    )


def reports(x: Inputs):
    """One report file per (trait, pathway): key lines, the likelihood on line 11, components below line 14."""
    path = scratch_path(x.spark, "fits")
    num = lambda c: c.cast("decimal(18,6)").cast("string")
    stats = x.null.groupBy("trait", "pathway").agg(F.round(F.max("lr"), 4).alias("ll"), F.max("share").alias("h"), F.max("sd").alias("sd"))
    head = [F.lit(f"Line{i} 0") for i in range(1, 11)]
    lines = F.array(
        *head, F.concat(F.lit("Alt_Likelihood "), num(F.col("ll"))), F.lit("Line12 0"), F.lit("Line13 0"),
        F.lit("Component Heritability Her_SD"),
        F.concat(F.lit("Her_K1 "), num(F.col("h")), F.lit(" "), num(F.col("sd"))),
        F.concat(F.lit("Her_ALL "), num(F.col("h") * 2), F.lit(" NA")),
    )
    stats.select("trait", "pathway", F.concat_ws("\n", lines).alias("value")).write.partitionBy("trait", "pathway").text(path)
    return rp.read_reports(x.spark, path, "*.txt")


def with_keys(df):
    parts = F.split("path", "[/=]")
    return df.withColumn("trait", F.element_at(parts, -4)).withColumn("pathway", F.element_at(parts, -2)).drop("path")


@query("IO5", """WITH s AS (SELECT trait, pathway, round(max(lr),4) AS ll, max(share) AS h, max(sd) AS sd FROM fx_null GROUP BY ALL)
    SELECT trait, pathway, ll AS alt_likelihood, 'Her_K1' AS component, round(h,6) AS value, round(sd,6) AS sd FROM s
    UNION ALL SELECT trait, pathway, ll, 'Her_ALL', round(h*2,6), NULL FROM s""")
def parse_fit_reports(x):
    loglik, components = rp.parse_fit_reports(reports(x))
    return with_keys(components).join(with_keys(loglik), ["trait", "pathway"])


@query("IO5", """SELECT trait, pathway, 'Alt_Likelihood' AS key, round(max(lr),4) AS value FROM fx_null GROUP BY ALL""")
def report_line(x):
    return with_keys(rp.report_line(reports(x), 11))


@query("IO6", """SELECT row_i AS i, row_j AS j, round(a,3) AS k FROM (SELECT dense_rank() OVER (ORDER BY i) AS ri, * FROM gram_all)
    JOIN (SELECT s_suppkey AS a1, CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS row_i FROM supplier) p ON p.a1=i
    JOIN (SELECT s_suppkey AS b1, CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS row_j FROM supplier) q ON q.b1=j WHERE row_i<row_j""")
def matrix_to_pairs(x):
    path = scratch_path(x.spark, "matrix")
    half = staged(ki.gram(x.geno).select("i", "j", F.round("a", 3).alias("a")), "gram")
    full = half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    rows = full.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "a"))).alias("r"))
    text = rows.select("i", F.concat_ws(" ", F.transform("r", lambda c: c["a"].cast("string"))).alias("value"))
    text.repartitionByRange(1, "i").sortWithinPartitions("i").select("value").write.text(path)
    return rp.matrix_to_pairs(rp.read_reports(x.spark, path, "*.txt")).select("i", "j", "k")


@query("IO7", """SELECT pathway, snp_id FROM all_sets""")
def write_partitioned(x):
    path = scratch_path(x.spark, "lists")
    tb.write_table(all_sets(x), path, ["pathway"], header=False)
    return x.spark.read.schema("snp_id string, pathway string").csv(path)


@query("IO8", """SELECT n.trait, n.pathway, o.share AS observed, count(*) AS n_null FROM fx_null n JOIN fx_obs o
    ON o.trait=n.trait AND o.pathway=n.pathway GROUP BY ALL""")
def result_bundle(x):
    path = tb.save_bundle({"null_results": x.null, "observed": x.obs}, scratch_path(x.spark, "bundle"))
    got = tb.load_bundle(x.spark, path, ["null_results", "observed"])
    counts = got["null_results"].groupBy("trait", "pathway").agg(F.count(F.lit(1)).alias("n_null"))
    return counts.join(got["observed"], ["trait", "pathway"]).select("trait", "pathway", F.col("share").alias("observed"), "n_null")


@query("IO9", "SELECT DISTINCT trait, pathway, random_group FROM fx_null EXCEPT SELECT trait, pathway, random_group FROM fx_null WHERE size<=20000")
def pending(x):
    grid = x.null.select("trait", "pathway", "random_group").distinct()
    done = staged(x.null.where("size <= 20000"), "done")
    return tb.pending(grid, done, ["trait", "pathway", "random_group"])
