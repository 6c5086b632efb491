"""Annotation joins and SNP sets.

Spark has no range join. Every interval is exploded over the fixed-width bins
it touches, a point falls into one bin, and the join is an equi join on
(chromosome, bin) with the exact bounds as residual predicate. A point has one
bin, so no pair is met twice. Spark broadcasts the interval side when its size
allows; beyond that the sort-merge join is split by the adaptive skew rule,
and `salt` spreads a bin that holds a large share of the points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinfold.session import staged

BIN = 4096


def _bin(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("bigint")


def range_join(
    points: DataFrame, intervals: DataFrame, pos: str, low: Column, high: Column,
    point_chr: str = "chromosome", interval_chr: str = "chromosome_name",
    inclusive: bool = True, how: str = "inner", bin_width: int = BIN, salt: int = 1, on=(),
) -> DataFrame:
    """Join points to the intervals [low, high] (or (low, high)) that hold them.

    `low` and `high` are expressions over `intervals`; `on` names further
    equi-join columns present on both sides. `how` is inner, left or left_semi.
    """
    spread = intervals.withColumn("_lo", low).withColumn("_hi", high)
    spread = spread.where(F.col("_lo") <= F.col("_hi")).withColumn(
        "_bin", F.explode(F.sequence(_bin(F.col("_lo"), bin_width), _bin(F.col("_hi"), bin_width)))
    )
    probe = points.withColumn("_pbin", _bin(F.col(pos), bin_width))
    salted = F.lit(True)
    if salt > 1:
        probe = probe.withColumn("_ps", F.pmod(F.xxhash64(*points.columns), F.lit(salt)))
        spread = spread.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")))
        salted = F.col("_ps") == F.col("_s")
    for c in on:
        spread = spread.withColumnRenamed(c, f"_on_{c}")
    inside = (
        (F.col(pos) >= F.col("_lo")) & (F.col(pos) <= F.col("_hi")) if inclusive
        else (F.col(pos) > F.col("_lo")) & (F.col(pos) < F.col("_hi"))
    )
    cond = (F.col(point_chr) == F.col(interval_chr)) & (F.col("_pbin") == F.col("_bin")) & salted & inside
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_on_{c}"))
    extra = ["_pbin", "_bin", "_lo", "_hi", "_ps", "_s"] + [f"_on_{c}" for c in on]
    return probe.join(spread, cond, how).drop(*extra)


def holds_a_point(points: DataFrame, intervals: DataFrame, pos: str, low: str, high: str,
                  point_chr: str = "chromosome", interval_chr: str = "chromosome_name") -> DataFrame:
    """The closed integer intervals that hold at least one point; no pair of a point and an interval is formed.

    Let k be the highest bit in which low and high differ. Cells of 2^k positions then cut the interval in two,
    [low, end of its cell] and [start of the next cell, high], so it holds a point exactly when the greatest point of the
    first cell reaches low or the least of the second does not pass high. Two rows an interval, a row a point and level.
    """
    at = F.col(pos).cast("bigint")
    low, high = F.col(low).cast("bigint"), F.col(high).cast("bigint")
    spans = intervals.where(low <= high).withColumn("_k", F.length(F.bin(low.bitwiseXOR(high))) - 1)
    spans = staged(spans.withColumn("_lo", low).withColumn("_hi", high), "spans")
    levels = spans.agg(F.collect_set("_k").alias("k"))
    cell = lambda v: F.expr(f"shiftright({v}, _k)")
    cells = (
        points.where(at.isNotNull()).select(F.col(point_chr).alias("_chr"), at.alias("_p")).distinct()
        .withColumn("_k", F.explode(levels.scalar())).groupBy("_chr", "_k", cell("_p").alias("_cell"))
        .agg(F.min("_p").alias("_min"), F.max("_p").alias("_max"))
    )
    halves = spans.withColumn("_half", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_own", F.when(F.col("_half"), cell("_lo")).otherwise(cell("_hi")))
    inside = F.when(F.col("_half"), F.col("_max") >= F.col("_lo")).otherwise(F.col("_min") <= F.col("_hi"))
    cells = cells.withColumnRenamed("_k", "_level")
    cond = (F.col(interval_chr) == F.col("_chr")) & (F.col("_k") == F.col("_level")) & (F.col("_own") == F.col("_cell")) & inside
    return halves.join(cells, cond, "left_semi").select(*intervals.columns).distinct()


def gene_table(annotations: DataFrame, snps: DataFrame) -> DataFrame:
    """Distinct annotation rows of the genes that hold at least one queried position."""
    genes = annotations.distinct()
    spans = genes.select("chromosome_name", "ensembl_gene_id", "start_position", "end_position").distinct()
    hit = holds_a_point(snps, spans, "position", "start_position", "end_position").select("ensembl_gene_id").distinct()
    return genes.join(hit, "ensembl_gene_id", "left_semi")


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the first row per key. An aggregate, not a window: a hot key is combined before the shuffle."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(first.alias("_f")).select(*keys, *[F.col("_f")[c].alias(c) for c in rest])


def first_match_intervals(intervals: DataFrame, low: Column, high: Column, by: list[str], order: list[str]) -> DataFrame:
    """Cut overlapping closed integer intervals into those a first match would return.

    With rows in ascending order of `low` (then `order`), an earlier interval
    starts no later than a later one, so it covers a point of the later one
    exactly when its end reaches that point. An interval therefore owns the
    part above the greatest end before it: one piece, `own_low`..`own_high`,
    disjoint from all others of the group. A point then meets at most one row,
    and a join needs no step that removes further matches.
    """
    earlier = W.partitionBy(*by).orderBy("own_low", *order).rowsBetween(W.unboundedPreceding, -1)
    pieces = intervals.withColumn("own_low", low).withColumn("own_high", high)
    pieces = pieces.withColumn("own_low", F.greatest(F.col("own_low"), F.max("own_high").over(earlier) + 1))
    return pieces.where(F.col("own_low") <= F.col("own_high"))


def snp_to_gene(snps: DataFrame, genes: DataFrame, bin_width: int = BIN, salt: int = 1) -> DataFrame:
    """First gene (by start, then id) whose closed range holds the SNP; NULL where none does.

    One row per SNP, and no shuffle of the SNPs while the gene side is broadcast.
    """
    spans = genes.select("chromosome_name", "ensembl_gene_id", "start_position", "end_position").distinct()
    owned = first_match_intervals(spans, F.col("start_position"), F.col("end_position"), ["chromosome_name"], ["ensembl_gene_id"])
    return range_join(snps, owned.select("chromosome_name", "ensembl_gene_id", "own_low", "own_high"), "position",
                      F.col("own_low"), F.col("own_high"), how="left", bin_width=bin_width, salt=salt).select(
        "chromosome", "position", "ensembl_gene_id", "snp_id"
    )


def attach_map(snp_gene: DataFrame, snp_map: DataFrame) -> DataFrame:
    """Map columns by (chromosome, position): inner, many to many."""
    return snp_gene.join(snp_map, ["chromosome", "position"], "inner")


def gene_categories(genes: DataFrame, cats: DataFrame) -> DataFrame:
    upper = cats.withColumn("ensembl_gene_id", F.upper("identifier")).drop("identifier")
    return genes.join(upper, "ensembl_gene_id", "inner")


def match_pathways(gene_cats: DataFrame, patterns: dict[str, str], code: str = "bincode") -> DataFrame:
    """Rows of `gene_cats` whose code starts with a pathway's pattern, for all pathways in one pass.

    The patterns are program constants, so each row tests them in place and is
    exploded over those that match: no theta join, no shuffle. Patterns are
    regular expressions with an unescaped dot. "0" marks a curated set.
    """
    tests = [
        F.when(F.col(code).rlike(f"^{p}"), F.lit(name)) for name, p in patterns.items() if p != "0"
    ]
    hits = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return gene_cats.withColumn("pathway", F.explode(hits))


def pathway_genes(gene_cats: DataFrame, patterns: dict[str, str]) -> DataFrame:
    return distinct_on(match_pathways(gene_cats, patterns), ["pathway", "ensembl_gene_id"], ["bincode", "name"])


def buffered_hits(snp_gene: DataFrame, genes: DataFrame, buffer: int = 2500, inclusive: bool = True,
                  bin_width: int = BIN, salt: int = 1) -> DataFrame:
    """SNPs within the buffered range of a gene; the gene found becomes `hit_gene_id`."""
    g = genes.withColumnRenamed("ensembl_gene_id", "hit_gene_id")
    return range_join(
        snp_gene, g, "position", F.col("start_position") - buffer, F.col("end_position") + buffer,
        inclusive=inclusive, bin_width=bin_width, salt=salt,
    )


def pathway_snps(snp_gene: DataFrame, genes: DataFrame, buffer: int = 2500, bin_width: int = BIN, salt: int = 1) -> DataFrame:
    """One row per (pathway, SNP): the first buffered gene by (start, id).

    The distinct-on is done on the gene side, by cutting the buffered ranges of
    a pathway into disjoint pieces; the SNPs are not shuffled for it.
    """
    owned = first_match_intervals(
        genes, F.col("start_position") - buffer, F.col("end_position") + buffer, ["pathway", "chromosome_name"], ["ensembl_gene_id"]
    ).withColumnRenamed("ensembl_gene_id", "hit_gene_id")
    hits = range_join(snp_gene, owned, "position", F.col("own_low"), F.col("own_high"), bin_width=bin_width, salt=salt)
    return hits.select("pathway", "snp_id", "chromosome", "position", "ensembl_gene_id", "hit_gene_id",
                       "start_position", "bincode", "name")


def pathway_sets(pattern_sets: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated sets replace the pattern sets of the same name."""
    names = curated.select("pathway").distinct()
    return pattern_sets.join(names, "pathway", "left_anti").unionByName(curated, allowMissingColumns=True)


def set_members(sets: DataFrame, key: str = "set_id") -> DataFrame:
    return sets.select(key, "snp_id").distinct()


def partition_snps(snps: DataFrame, sets: DataFrame, key: str = "set_id", complement: str = "exact") -> DataFrame:
    """List 1 = the members of a set, list 2 = all other SNPs, for every set.

    Memberships are gathered per SNP and the missing set names exploded, so the
    complement needs one shuffle on snp_id and no product of sets and SNPs.
    `complement='as_written'` lists every SNP as list 2.
    """
    members = set_members(sets, key)
    names = members.agg(F.sort_array(F.collect_set(key)).alias("names"))
    own = members.groupBy("snp_id").agg(F.collect_set(key).alias("_own"))
    all_names = names.scalar()
    others = all_names if complement == "as_written" else F.array_except(all_names, F.coalesce("_own", F.array()))
    rest = (
        snps.select("snp_id").distinct().join(own, "snp_id", "left")
        .select("snp_id", F.explode(others).alias(key))
    )
    return members.select(key, F.lit(1).alias("partition"), "snp_id").unionByName(
        rest.select(key, F.lit(2).alias("partition"), "snp_id")
    )


def pathway_sizes(sets: DataFrame, key: str = "pathway", gene: str = "ensembl_gene_id") -> DataFrame:
    """Distinct SNPs and genes per set; a missing gene counts as one gene."""
    return sets.groupBy(key).agg(
        (F.count_distinct(gene) + F.max(F.col(gene).isNull().cast("int"))).cast("bigint").alias("n_genes"),
        F.count_distinct("snp_id").alias("size"),
    )


def complete_grid(df: DataFrame, label: str, nested: list[str]) -> DataFrame:
    """Every value of `label` with every distinct combination of `nested`; other columns NULL where absent.

    `label` is a small set of names (chromosomes, pathways): one array,
    exploded per combination.
    """
    names = df.agg(F.sort_array(F.collect_set(label)).alias("names"))
    grid = df.select(*nested).distinct().withColumn(label, F.explode(names.scalar()))
    return grid.join(df, [label, *nested], "left")
