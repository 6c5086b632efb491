"""Annotation, SNP sets and random gene groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import intervals as iv, sampling as sa
from kinfold.plans.fixtures import PATTERNS, Inputs
from kinfold.plans.registry import query
from kinfold.session import staged

RANDOM_GROUPS = 1000  # matched random groups per pathway
REPS = 3  # in the queries whose SQL lists three groups
GENERIC_GROUPS = 5000  # random groups of `null_sets`, of 1 to 50,000 SNP rows


def snp_gene(x: Inputs):
    return iv.snp_to_gene(x.snps, x.genes)


def gene_cats(x: Inputs):
    return iv.gene_categories(x.genes, x.cats)


def pw_genes(x: Inputs):
    return iv.pathway_genes(gene_cats(x), PATTERNS)


def pw_snps(x: Inputs):
    return iv.pathway_snps(snp_gene(x), pw_genes(x))


def all_sets(x: Inputs):
    return iv.pathway_sets(pw_snps(x).select("pathway", "snp_id"), x.curated)


@query("A1", """SELECT DISTINCT g.* FROM fx_genes g JOIN fx_snps s ON g.chromosome_name=s.chromosome
    AND s.position BETWEEN g.start_position AND g.end_position""")
def gene_table(x):
    return iv.gene_table(x.genes, x.snps)


@query("A2", "SELECT * FROM snp_gene")
def snp_to_gene(x):
    return snp_gene(x)


@query("A3", """SELECT g.chromosome, g.position, g.ensembl_gene_id, s.snp_id, CAST(0 AS DOUBLE) AS physical
    FROM (SELECT chromosome, position, ensembl_gene_id FROM snp_gene) g JOIN fx_snps s
    ON s.chromosome=g.chromosome AND s.position=g.position""")
def attach_map(x):
    return iv.attach_map(snp_gene(x).drop("snp_id"), x.snps.withColumn("physical", F.lit(0.0)))


@query("A4", "SELECT * FROM gene_cats")
def gene_categories(x):
    return gene_cats(x)


@query("A5", "SELECT * FROM matched")
def match_pathways(x):
    return iv.match_pathways(gene_cats(x), PATTERNS)


@query("A6", "SELECT * FROM pw_genes")
def pathway_genes(x):
    return pw_genes(x)


@query("A7", "SELECT * FROM pw_hits")
def buffered_interval_join(x):
    return iv.buffered_hits(snp_gene(x), pw_genes(x)).select(
        "pathway", "snp_id", "chromosome", "position", "ensembl_gene_id", "hit_gene_id", "start_position", "bincode", "name"
    )


@query("A8", "SELECT * FROM pw_snps")
def pathway_snps(x):
    return pw_snps(x)


@query("A9", """SELECT pathway, 1 AS partition, snp_id FROM (SELECT DISTINCT pathway, snp_id FROM all_sets)
    UNION ALL SELECT p.pathway, 2, s.snp_id FROM (SELECT DISTINCT pathway FROM all_sets) p, fx_snps s
    WHERE NOT EXISTS (SELECT 1 FROM all_sets m WHERE m.pathway=p.pathway AND m.snp_id=s.snp_id)""")
def partition_snps(x):
    return iv.partition_snps(x.snps, all_sets(x), "pathway")


@query("A10", "SELECT pathway, snp_id FROM all_sets")
def curated_sets(x):
    return all_sets(x)


PATHWAY_SIZES_SQL = """SELECT pathway, count(DISTINCT ensembl_gene_id)+max(CASE WHEN ensembl_gene_id IS NULL THEN 1 ELSE 0 END) AS n_genes,
    count(DISTINCT snp_id) AS size FROM pw_snps GROUP BY pathway"""


@query("A11", PATHWAY_SIZES_SQL)
def pathway_sizes(x):
    return iv.pathway_sizes(pw_snps(x))


@query("A12", """WITH c AS (SELECT pathway, chromosome, count(*) AS n FROM pw_snps GROUP BY ALL)
    SELECT a.chromosome, b.pathway, c.n FROM (SELECT DISTINCT chromosome FROM c) a CROSS JOIN (SELECT DISTINCT pathway FROM c) b
    LEFT JOIN c ON c.pathway=b.pathway AND c.chromosome=a.chromosome""")
def complete_grid(x):
    counts = pw_snps(x).groupBy("pathway", "chromosome").agg(F.count(F.lit(1)).alias("n"))
    return iv.complete_grid(counts, "chromosome", ["pathway"]).select("chromosome", "pathway", "n")


# Random gene groups. A hash of (seed, keys) gives the same draw in every engine.
U = "((CAST('0x'||substr(md5({}),1,13) AS BIGINT)+0.5::DOUBLE)/4503599627370496::DOUBLE)"
SIZE_SQL = "CAST(round_even(1+" + U.format("'sizes|'||{key}") + "*{span},0) AS BIGINT)"


def generic_targets(x: Inputs, hi: int = 300):
    """One random group per nation key of a supplier region: sizes drawn from 1..hi."""
    groups = x.table("nation").select(F.concat(F.lit("c_"), F.col("n_nationkey").cast("string")).alias("random_group"))
    return sa.with_null_size(groups, "random_group", 1, hi)


@query("N1", f"SELECT l_orderkey||'_'||l_linenumber||'_'||l_partkey AS group_no, {SIZE_SQL.format(key='l_orderkey||' + chr(39) + '_' + chr(39) + '||l_linenumber||' + chr(39) + '_' + chr(39) + '||l_partkey', span='49999')} AS size FROM lineitem")
def null_sizes(x):
    ids = x.table("lineitem").select(
        F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("group_no")
    )
    return sa.with_null_size(ids, "group_no")


SPANS = """spans AS (SELECT ensembl_gene_id AS drawn_gene_id, chromosome, count(*) AS weight, min(position) AS mn, max(position) AS mx
        FROM snp_gene WHERE ensembl_gene_id IS NOT NULL GROUP BY ALL),
    buffers AS (SELECT p.drawn_gene_id, s.* FROM spans p JOIN snp_gene s ON s.chromosome=p.chromosome
        AND s.position>p.mn-2500 AND s.position<p.mx+2500),
    rows_of AS (SELECT drawn_gene_id, count(*) AS n FROM buffers GROUP BY ALL),
    targets AS ({targets}),
    keyed AS (SELECT t.random_group, t.size, p.drawn_gene_id, r.n,
        -ln({u})/p.weight AS k FROM targets t, spans p JOIN rows_of r ON r.drawn_gene_id=p.drawn_gene_id),
    drawn AS (SELECT random_group, drawn_gene_id FROM (SELECT *, sum(n) OVER (PARTITION BY random_group ORDER BY k, drawn_gene_id
        ROWS UNBOUNDED PRECEDING)-n AS below FROM keyed) WHERE below<size)""".format(
    targets=f"SELECT 'c_'||n_nationkey AS random_group, {SIZE_SQL.format(key="('c_'||n_nationkey)", span='299')} AS size FROM nation",
    u=U.format("'draw|'||t.random_group||'|'||p.drawn_gene_id"))


@query("N2", f"WITH {SPANS} SELECT random_group, drawn_gene_id FROM drawn")
def sample_gene_groups(x):
    snps = staged(snp_gene(x), "snp_gene")
    spans = staged(sa.gene_spans(snps), "spans")
    return sa.draw_genes_fast(spans, staged(sa.buffer_rows(snps, spans), "rows"), generic_targets(x), "draw").select("random_group", "drawn_gene_id")


def walk_ctes(group: str) -> str:
    """The sequential draw over `keyed`, as `draws`: take a gene unless an earlier buffer covers it, stop at the target."""
    on = " AND ".join(f"s.{c}=w.{c}" for c in group.split(", "))
    own = ", ".join(f"w.{c}" for c in group.split(", "))
    scope = "pathway, " if "pathway" in group else ""
    return f"""cover AS (SELECT {scope}drawn_gene_id, list(DISTINCT ensembl_gene_id) AS covers FROM buffers
        WHERE ensembl_gene_id IS NOT NULL GROUP BY ALL),
    seq AS (SELECT k.*, c.covers, row_number() OVER (PARTITION BY {group} ORDER BY k, k.drawn_gene_id) AS ord FROM keyed k
        JOIN cover c USING ({scope}drawn_gene_id)),
    walk AS (SELECT DISTINCT {group}, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS total, CAST([] AS VARCHAR[]) AS covered, false AS took, '' AS gene FROM seq
        UNION ALL SELECT {own}, s.ord, w.total+CASE WHEN list_contains(w.covered, s.drawn_gene_id) THEN 0 ELSE s.n END,
        CASE WHEN list_contains(w.covered, s.drawn_gene_id) THEN w.covered ELSE list_concat(w.covered, s.covers) END,
        NOT list_contains(w.covered, s.drawn_gene_id), s.drawn_gene_id FROM walk w JOIN seq s ON {on} AND s.ord=w.ord+1 WHERE w.total<s.size),
    draws AS (SELECT {group}, gene AS drawn_gene_id, row_number() OVER (PARTITION BY {group} ORDER BY ord) AS draw_no FROM walk WHERE took)"""


DRAWN = (SPANS[:SPANS.index(",\n    drawn AS")].replace("'draw|'||", "'draw|generic|'||") + ", " + walk_ctes("random_group"))


#: The same draw for all groups of the null distribution.
DRAWN_ALL = DRAWN.replace(
    f"{SIZE_SQL.format(key="('c_'||n_nationkey)", span='299')} AS size FROM nation",
    f"{SIZE_SQL.format(key="('c_'||n_nationkey)", span='49999')} AS size FROM (SELECT unnest(range(1,{GENERIC_GROUPS + 1})) AS n_nationkey)")


def all_targets(x: Inputs):
    """The random groups c_1, c_2, ... of the null distribution, sizes drawn from the whole range of `with_null_size`."""
    ids = x.spark.range(1, GENERIC_GROUPS + 1).select(F.concat(F.lit("c_"), F.col("id").cast("string")).alias("random_group"))
    return sa.with_null_size(ids, "random_group")


def generic_draw(x: Inputs, targets=None):
    """Genes of the generic groups by the sequential draw, and the buffered SNP rows of the genes that were drawn."""
    targets = generic_targets(x) if targets is None else targets
    snps = staged(snp_gene(x), "snp_gene")
    spans = staged(sa.gene_spans(snps), "spans")
    places = sa.gene_places(snps, spans).withColumn("set_id", F.lit("generic"))
    drawn = staged(sa.draw_genes_exact(places, targets.withColumn("set_id", F.lit("generic")), "draw"), "drawn")
    return drawn, sa.drawn_buffers(snps, spans, drawn)


@query("N2", f"WITH RECURSIVE {DRAWN} SELECT 'generic' AS set_id, random_group, drawn_gene_id, draw_no FROM draws")
def sample_gene_groups_exact(x):
    return generic_draw(x)[0]


@query("N3", f"""WITH RECURSIVE {DRAWN_ALL} SELECT d.random_group, b.drawn_gene_id, b.snp_id, b.ensembl_gene_id, b.chromosome, b.position
    FROM draws d JOIN buffers b ON b.drawn_gene_id=d.drawn_gene_id""")
def null_sets(x):
    drawn, buffers = generic_draw(x, all_targets(x))
    return sa.group_snps(drawn.select("random_group", "drawn_gene_id"), buffers).select(
        "random_group", "drawn_gene_id", "snp_id", "ensembl_gene_id", "chromosome", "position"
    )


MATCHED = """pool AS (SELECT p.pathway, s.* FROM (SELECT DISTINCT pathway FROM all_sets) p, snp_gene s
        WHERE NOT EXISTS (SELECT 1 FROM all_sets m WHERE m.pathway=p.pathway AND m.snp_id=s.snp_id)),
    spans AS (SELECT pathway, ensembl_gene_id AS drawn_gene_id, chromosome, count(*) AS weight, min(position) AS mn, max(position) AS mx
        FROM pool WHERE ensembl_gene_id IS NOT NULL GROUP BY ALL),
    buffers AS (SELECT p.drawn_gene_id, s.* FROM spans p JOIN pool s ON s.pathway=p.pathway AND s.chromosome=p.chromosome
        AND s.position>p.mn-2500 AND s.position<p.mx+2500),
    rows_of AS (SELECT pathway, drawn_gene_id, count(*) AS n FROM buffers GROUP BY ALL),
    targets AS (SELECT pathway, size, 'c_'||k AS random_group FROM (SELECT pathway, count(DISTINCT snp_id) AS size FROM all_sets GROUP BY 1),
        (VALUES (1),(2),(3)) v(k)),
    keyed AS (SELECT t.pathway, t.random_group, t.size, p.drawn_gene_id, r.n, -ln({u})/p.weight AS k
        FROM targets t JOIN spans p ON p.pathway=t.pathway JOIN rows_of r ON r.pathway=p.pathway AND r.drawn_gene_id=p.drawn_gene_id),
    {walk},
    null_rows AS (SELECT d.random_group, b.* FROM draws d JOIN buffers b ON b.pathway=d.pathway AND b.drawn_gene_id=d.drawn_gene_id)""".format(
    u=U.format("'match|'||t.pathway||'|'||t.random_group||'|'||p.drawn_gene_id"), walk=walk_ctes("pathway, random_group"))

#: The same with all groups of an analysis.
MATCHED_ALL = MATCHED.replace("(VALUES (1),(2),(3)) v(k)", f"(SELECT unnest(range(1,{RANDOM_GROUPS + 1})) AS k) v")


def matched_pool(x: Inputs):
    """Per pathway: its SNP set, the SNPs outside it and their gene spans."""
    snps = staged(snp_gene(x), "snp_gene")
    sets = staged(iv.pathway_sets(iv.pathway_snps(snps, pw_genes(x)).select("pathway", "snp_id"), x.curated), "sets")
    pool = staged(sa.scoped_snps(snps, sets, "pathway"), "pool")
    return sets, pool, staged(sa.gene_spans(pool, ["pathway"]), "spans")


def matched_draw(x: Inputs, reps: int = REPS):
    """(pathway, random_group, drawn_gene_id, draw_no) by the sequential draw from each pathway's pool, and the buffers of the drawn genes."""
    sets, pool, spans = matched_pool(x)
    places = sa.gene_places(pool, spans, scope=["pathway"])
    drawn = staged(sa.draw_genes_exact(places, sa.matched_targets(sets, reps, "pathway"), "match", "pathway"), "drawn")
    return drawn, sa.drawn_buffers(pool, spans, drawn, scope=["pathway"])


def matched_rows(x: Inputs, reps: int = REPS):
    """All SNP rows of the matched null groups."""
    drawn, buffers = matched_draw(x, reps)
    return sa.group_snps(drawn.drop("draw_no"), buffers, ["pathway"])


def matched_kernels_of(x: Inputs, reps: int = REPS):
    """Random SNP sets named pathway|group, the pathway of each, and the pathways' own SNPs, which neither kernel holds."""
    rows = matched_rows(x, reps).select(F.concat_ws("|", "pathway", "random_group").alias("set_id"), F.col("pathway").alias("scope"), "snp_id")
    rows = staged(rows.distinct(), "null_sets")
    outside = staged(all_sets(x).select(F.col("pathway").alias("scope"), "snp_id").distinct(), "outside")
    return rows.select("set_id", "snp_id"), rows.select("set_id", "scope").distinct(), outside


@query("N4", f"""WITH RECURSIVE {MATCHED_ALL} SELECT pathway, random_group, drawn_gene_id, snp_id, ensembl_gene_id FROM null_rows""")
def matched_null_sets(x):
    return matched_rows(x, RANDOM_GROUPS).select("pathway", "random_group", "drawn_gene_id", "snp_id", "ensembl_gene_id")


@query("N4", f"WITH RECURSIVE {MATCHED} SELECT pathway, random_group, drawn_gene_id, draw_no FROM draws")
def matched_null_sets_exact(x):
    return matched_draw(x)[0]


@query("N5", f"""WITH RECURSIVE {DRAWN}, m AS (SELECT DISTINCT d.random_group, b.snp_id FROM draws d JOIN buffers b ON b.drawn_gene_id=d.drawn_gene_id)
    SELECT random_group, 1 AS partition, snp_id FROM m UNION ALL
    SELECT g.random_group, 2, s.snp_id FROM (SELECT DISTINCT random_group FROM m) g, fx_snps s
    WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.random_group=g.random_group AND m.snp_id=s.snp_id)""")
def null_partitions(x):
    drawn, buffers = generic_draw(x)
    return iv.partition_snps(x.snps, staged(sa.group_snps(drawn, buffers).select("random_group", "snp_id"), "members"), "random_group")


@query("N5", f"""WITH RECURSIVE {DRAWN}, m AS (SELECT DISTINCT d.random_group, b.snp_id FROM draws d JOIN buffers b ON b.drawn_gene_id=d.drawn_gene_id)
    SELECT random_group, 1 AS partition, snp_id FROM m UNION ALL
    SELECT g.random_group, 2, s.snp_id FROM (SELECT DISTINCT random_group FROM m) g, fx_snps s""")
def null_partitions_as_written(x):
    drawn, buffers = generic_draw(x)
    members = staged(sa.group_snps(drawn, buffers).select("random_group", "snp_id"), "members")
    return iv.partition_snps(x.snps, members, "random_group", complement="as_written")


@query("N6", f"""WITH RECURSIVE {MATCHED_ALL} SELECT pathway, random_group,
    count(DISTINCT ensembl_gene_id)+max(CASE WHEN ensembl_gene_id IS NULL THEN 1 ELSE 0 END) AS n_genes,
    count(DISTINCT snp_id) AS n_snps FROM null_rows GROUP BY ALL""")
def null_group_sizes(x):
    return sa.group_sizes(matched_rows(x, RANDOM_GROUPS), ["pathway", "random_group"])
