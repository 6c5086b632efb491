"""Mixing sources to target weights by equal blocks of words.

Sources, by code point with null last, weigh `weights`, repeated; their targets share `total_share` of all words.
A target stops at `most` times its source's size, and the excess is shared anew by weight until none is above.

Method: Sainte-Lague apportionment. The mix has round(all targets / block) blocks; the highest quotients
target / (2 seats + 1) give them to the sources, and a source's blocks go to its shards by their sizes in the same
way. A shard is a seeded share of its source's documents of bounded size, in seeded order; their words, laid end to
end, are cut in blocks. All blocks of a shard are taken as often as its quota allows in full, and a run of blocks
from a seeded place takes the rest, so that nearly every document is taken whole or not at all.

Everything is DataFrame expressions. The texts are read once, for their sizes; what is shuffled is one small row per
document. Sources and shards are counted, never listed in one task. Quotas are exact without a sort of all quotients:
two divisors bound each count from below and above, and only the seats between them, three a shard on average, are
ranked.

Defined cases: null text has size 0 and is not taken; a null source is a source of its own; null or repeated ids
do no harm (rows are dealt by a hash of id and text); equal rows may differ in what is taken of each, never in
sum; without words every target is 0; an empty table gives an empty table; other columns are kept by `mix` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.session import join_sized, staged

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST = 2
BLOCK = 16
SHARD_WORDS = 1 << 20
SHARD_ROWS = 1 << 16
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def apportion(cells: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Add `quota`: how many of its group's `seats` a cell gets by highest quotients votes / (2 q + 1); ties by `order`."""
    by = Window.partitionBy(*group)
    bounds = cells.withColumn("__all", F.sum(votes).over(by)).withColumn("__n", F.count(F.lit(1)).over(by))
    share = F.when(F.col("__all") > 0, F.col(votes) / F.col("__all")).otherwise(F.lit(0.0))
    low = F.floor(share * F.greatest(F.col(seats) - F.col("__n"), F.lit(0)) + 0.5).cast("long")
    high = F.floor(share * (F.col(seats) + F.col("__n")) + 0.5).cast("long")
    low = F.when(F.col(seats) > F.col("__n"), low).otherwise(F.lit(0).cast("long"))
    bounds = staged(bounds.withColumn("__low", low).withColumn("__high", F.greatest(low, high)).withColumn("__left", F.col(seats) - F.sum("__low").over(by)), "seats")
    between = bounds.where("__high > __low").withColumn("__q", F.explode(F.sequence("__low", F.col("__high") - 1)))
    rank = F.row_number().over(by.orderBy(F.desc(F.col(votes) / (2 * F.col("__q") + 1)), *order))
    won = between.withColumn("__rank", rank).where("__rank <= __left").groupBy(*group, *order).agg(F.count(F.lit(1)).alias("__won"))
    out = bounds.join(won, [*group, *order], "left").withColumn("quota", F.col("__low") + F.coalesce("__won", F.lit(0)))
    return out.drop("__all", "__n", "__low", "__high", "__left", "__won")


def source_targets(rows: DataFrame, weights: tuple[int, ...], total_share: float, most: int) -> DataFrame:
    """(key, source, source_size, source_rows, target) from rows with key, source and size."""
    sources = rows.groupBy("__key").agg(F.first("__source").alias("__source"), F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("__source").isNull(), "__source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = staged(sources.withColumn("weight", weight).withColumn("most", most * F.col("source_size")), "sources")
    rate, fixed = 0.0, -1
    while True:
        above = F.col("weight") * rate > F.col("most")
        sums = sources.agg(F.sum("source_size").alias("size"), F.sum(F.when(above, F.col("most"))).alias("given"),
                           F.sum(F.when(~above, F.col("weight"))).alias("weights"), F.count(F.when(above, 1)).alias("fixed")).first()
        if not sums["weights"] or sums["fixed"] == fixed:
            break
        fixed = sums["fixed"]
        rate = (total_share * sums["size"] - (sums["given"] or 0)) / sums["weights"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(rate), F.col("most").cast("double")))


def _before(words: Column, block: int) -> Column:
    """How many of the first `words` words of a shard its quota takes."""
    full = F.expr("quota div blocks")
    extra = F.col("quota") % F.col("blocks")
    ends = F.col("turn") + extra

    def taken(b: Column) -> Column:
        run = F.greatest(F.least(b, F.least(ends, F.col("blocks"))) - F.col("turn"), F.lit(0))
        around = F.least(b, F.greatest(ends - F.col("blocks"), F.lit(0)))
        return b * full + run + around

    b = F.floor(words / block).cast("long")
    return block * taken(b) + (words % block) * (taken(b + 1) - taken(b))


def dealt(docs: DataFrame, columns: list[str], weights: tuple[int, ...], total_share: float, most: int, block: int, seed: int) -> DataFrame:
    """The named columns with __size, source_size, target, and each document's place in its shard and the shard's quota."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    rows = staged(docs.select(
        *[F.col(f"`{c}`") for c in columns], source.alias("__source"), F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("__key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("__mark")), "sizes")
    small = rows.select("__key", "__source", "__size", "__mark")
    sources = source_targets(small, weights, total_share, most)
    blocks = sources.withColumn("__one", F.lit(1)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy("__one")) / block).cast("long"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("source_rows") / SHARD_ROWS)).cast("long")
    quotas = apportion(blocks, ["__one"], "target", "seats", ["__key"]).select("__key", "source_size", "target", F.col("quota").alias("seats"), shards.alias("__shards"))
    quotas = staged(quotas, "quotas")
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "__mark"), F.col("__shards")).alias("__shard")
    cells = join_sized(small.select("__key", "__size", "__mark"), quotas, ["__key"]).groupBy("__key", shard).agg(
        F.sum("__size").alias("__words"), F.first("seats").alias("seats"))
    cells = apportion(cells, ["__key"], "__words", "seats", ["__shard"])
    count = F.greatest(F.ceil(F.col("__words") / block), F.lit(1)).cast("long")
    cells = cells.select(
        "__key", "__shard", count.alias("blocks"), F.least(F.col("quota"), most * count).alias("quota"),
        F.pmod(F.xxhash64(F.lit(seed + 2), "__key", "__shard"), count).alias("turn"))
    placed = join_sized(rows, quotas.select("__key", "source_size", "target", "__shards"), ["__key"]).withColumn("__shard", shard)
    stream = Window.partitionBy("__key", "__shard").orderBy("__mark", "__size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__at", F.coalesce(F.sum("__size").over(stream), F.lit(0)))
    return join_sized(placed, cells, ["__key", "__shard"])


def taken_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, its size, its source's size and target, and how many of its words the mix takes, repeats counted."""
    rows = dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"), ["doc_id"], weights, total_share, most, block, seed)
    taken = _before(F.col("__at") + F.col("__size"), block) - _before(F.col("__at"), block)
    return rows.select("doc_id", F.col("__size").alias("size"), "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself: a row per time that a document is taken, with the words that are taken; n_chars, if there, is counted anew."""
    names = [f"__{i}" for i in range(len(docs.columns))]  # whatever the columns are called, they clash with nothing here
    held = docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns)])
    rows = dealt(held, ["text", *names], weights, total_share, most, block, seed)
    rows = rows.withColumn("__full", F.expr("quota div blocks")).withColumn("__extra", F.col("quota") % F.col("blocks"))
    part = _before(F.col("__at") + F.col("__size"), block) - _before(F.col("__at"), block) - F.col("__full") * F.col("__size")
    rows = rows.withColumn("__part", part)

    def in_run(i: Column) -> Column:
        b = F.floor((F.col("__at") + i) / block).cast("long")
        return F.pmod(b - F.col("turn"), F.col("blocks")) < F.col("__extra")

    text = F.col("text").cast("string")
    cut = F.array_join(F.filter(F.regexp_extract_all(text, F.lit(WORD_AND_GAP), F.lit(0)), lambda w, i: in_run(i)), "")
    partial = F.when(F.col("__part") == F.col("__size"), text).otherwise(cut)
    whole = F.when(F.col("__size") > 0, F.array_repeat(text, F.col("__full").cast("int"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    copies = F.concat(whole, F.when(F.col("__part") > 0, F.array(partial)).otherwise(F.expr("CAST(array() AS array<string>)")))
    out = rows.select(*names, F.explode(copies).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(n)).alias(c) for n, c in zip(names, docs.columns)])
