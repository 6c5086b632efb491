"""Linkage disequilibrium of neighbouring SNPs: pairwise r2 in a window, LD scores, greedy pruning.

SNPs are packed in blocks: a stretch of a chromosome at least one window wide, dealt out by a hash of the SNP where it
is dense. A pair of SNPs within the window then lies in one block, in two blocks of one stretch or in two of neighbouring
stretches. r2 of a block pair comes from matrix products over strips of neighbouring positions; rows of SNP pairs carry
ids, positions and r2, never dosages.

Defined cases: a SNP without chromosome, position or dosages has no pairs; a pair without variance over the samples
called in both has a NULL r2; SNPs at one position are ordered by id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.operators.intervals import _bin
from kinfold.session import join_sized, staged

BLOCK_SNPS = 256
BLOCK_BYTES = 16 << 20
STRIP = 64
MOST_EDGES = 1 << 20
PACKED = "chromosome {chromosome}, position long, snp_id string, calls binary"


def _pack(flat: np.ndarray, width: int) -> list[bytes]:
    """Dosages of SNPs as bytes: one signed byte a sample (-1 missing) where they are small whole numbers, else doubles."""
    x = flat.reshape(-1, width)
    missing = np.isnan(x)
    filled = np.where(missing, -1.0, x)
    whole = ((filled == np.rint(filled)) & (filled <= 127) & (missing | (filled >= 0))).all(axis=1)
    small = np.where(whole[:, None], filled, 0.0).astype(np.int8)
    return [small[i].tobytes() if whole[i] else x[i].tobytes() for i in range(len(x))]


def _calls(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(dosages with 0 for missing, 1 for a call and 0 for none) of packed SNPs; singles where their sums are exact."""
    if all(len(r) == width for r in rows):
        x = np.frombuffer(b"".join(rows), np.int8).reshape(-1, width)
        top = max(int(x.max(initial=0)), 1)
        kind = np.float32 if width * top * top < 1 << 24 else np.float64
        called = x >= 0
        return np.where(called, x, 0).astype(kind), called.astype(kind)
    x = np.stack([np.frombuffer(r, np.int8).astype(float) if len(r) == width else np.frombuffer(r) for r in rows])
    called = ~np.isnan(x)
    for i, r in enumerate(rows):
        if len(r) == width:
            called[i] = x[i] >= 0
    return np.where(called, x, 0.0), called.astype(float)


class _Block:
    """SNPs of a block in the order of (position, id)."""

    def __init__(self, snps: list[dict], width: int):
        snps = sorted(snps, key=lambda s: (s["position"], s["snp_id"]))
        self.pos = np.array([s["position"] for s in snps], np.int64)
        self.ids = np.array([s["snp_id"] for s in snps], object)
        self.x, self.m = _calls([s["calls"] for s in snps], width)
        self.xx = self.x * self.x
        self.whole = bool(self.m.all())


def _r2(a: _Block, i: slice, b: _Block, j: slice) -> np.ndarray:
    """Squared correlations over the samples called in both, NaN without variance: products of strips of two blocks."""
    x, y = a.x[i], b.x[j]
    sxy = (x @ y.T).astype(float)
    if a.whole and b.whole:
        n = float(x.shape[1])
        sx, sy = x.sum(axis=1, dtype=float)[:, None], y.sum(axis=1, dtype=float)[None, :]
        sxx, syy = a.xx[i].sum(axis=1, dtype=float)[:, None], b.xx[j].sum(axis=1, dtype=float)[None, :]
    else:
        n = (a.m[i] @ b.m[j].T).astype(float)
        sx, sy = (x @ b.m[j].T).astype(float), (a.m[i] @ y.T).astype(float)
        sxx, syy = (a.xx[i] @ b.m[j].T).astype(float), (a.m[i] @ b.xx[j].T).astype(float)
    cov, vx, vy = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
    ok = (vx > 0) & (vy > 0)
    return np.divide(cov * cov, vx * vy, out=np.full(cov.shape, np.nan), where=ok)


def _block_pairs(a: _Block, b: _Block | None, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first ids, second ids, first positions, second positions, r2) of pairs within the window; b None: inside a."""
    other = a if b is None else b
    for s in range(0, len(a.pos), STRIP):
        e = min(s + STRIP, len(a.pos))
        low = s if b is None else int(np.searchsorted(other.pos, a.pos[s] - window, "left"))
        high = int(np.searchsorted(other.pos, a.pos[e - 1] + window, "right"))
        for t in range(low, high, 4 * STRIP):
            j = slice(t, min(t + 4 * STRIP, high))
            gap = other.pos[j][None, :] - a.pos[s:e, None]
            near = np.abs(gap) <= window
            if b is None:
                near &= np.arange(j.start, j.stop)[None, :] > np.arange(s, e)[:, None]
            u, v = np.nonzero(near)
            if not len(u):
                continue
            value = _r2(a, slice(s, e), other, j)[u, v]
            ids, pos = (a.ids[s + u], other.ids[t + v]), (a.pos[s + u], other.pos[t + v])
            swap = (pos[1] < pos[0]) | ((pos[1] == pos[0]) & (ids[1] < ids[0]).astype(bool))
            keep = ~((pos[0] == pos[1]) & (ids[0] == ids[1]).astype(bool))
            first = np.where(swap, ids[1], ids[0]), np.where(swap, pos[1], pos[0])
            second = np.where(swap, ids[0], ids[1]), np.where(swap, pos[0], pos[1])
            yield first[0][keep], second[0][keep], first[1][keep], second[1][keep], value[keep]


def _blocks(geno: DataFrame, window: int, samples: int) -> DataFrame:
    """(chromosome, stretch, part, parts_next, snps): packed SNPs of a block and the parts of its own and the next stretch.

    A stretch is a whole number of windows that holds about a block of SNPs where SNPs stand at their mean
    density. Where it holds more, its SNPs are dealt to parts by a hash of their id, so a block stays bounded.
    """
    kind = dict(geno.dtypes)["chromosome"]

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                flat = batch["dosages"].flatten().to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [batch["chromosome"], batch["position"].cast(pa.int64()), batch["snp_id"],
                     pa.array(_pack(flat, samples), pa.binary())], ["chromosome", "position", "snp_id", "calls"])

    placed = geno.select("chromosome", "position", "snp_id", "dosages").where(
        F.col("chromosome").isNotNull() & F.col("position").isNotNull() & F.col("dosages").isNotNull())
    fit = max(1, min(BLOCK_SNPS, BLOCK_BYTES // max(samples, 1)))
    counts = staged(placed.groupBy("chromosome", _bin(F.col("position"), window).alias("_w")).agg(F.count(F.lit(1)).alias("_n")), "ld-counts")
    mean = counts.agg(F.avg("_n")).first()[0] or fit
    windows = max(1, int(fit / mean))
    sizes = counts.groupBy("chromosome", _bin(F.col("_w"), windows).alias("stretch")).agg(
        F.ceil(F.sum("_n") / F.lit(float(fit))).cast("int").alias("parts"))
    following = sizes.select("chromosome", (F.col("stretch") - 1).alias("stretch"), F.col("parts").alias("parts_next"))
    sizes = sizes.join(following, ["chromosome", "stretch"], "left").withColumn("parts_next", F.coalesce("parts_next", F.lit(0)))
    packed = placed.mapInArrow(pack, PACKED.format(chromosome=kind))
    dealt = join_sized(packed.withColumn("stretch", _bin(F.col("position"), window * windows)), sizes, ["chromosome", "stretch"])
    return dealt.groupBy("chromosome", "stretch", F.pmod(F.xxhash64("snp_id"), F.col("parts")).cast("int").alias("part")).agg(
        F.first("parts").alias("parts"), F.first("parts_next").alias("parts_next"),
        F.collect_list(F.struct("position", "snp_id", "calls")).alias("snps"))


def ld_window(geno: DataFrame, kb: float = 0.25) -> DataFrame:
    """r2 of every SNP pair of a chromosome at most `kb` apart: (chromosome, snp_a, snp_b, pos_a, pos_b, r2).

    `snp_a` is the earlier SNP by (position, id). A block meets the later parts of its stretch and all of the next.
    """
    window = max(int(kb * 1000), 1)
    reach = int(kb * 1000)
    some = geno.where(F.col("dosages").isNotNull()).select(F.size("dosages")).first()
    samples = some[0] if some else 1
    kinds = dict(geno.dtypes)
    blocks = staged(_blocks(geno, window, samples), "ld-blocks")
    later = F.sequence("part", F.col("parts") - 1)
    own = F.transform(later, lambda p: F.struct(F.col("stretch").alias("stretch"), p.alias("part")))
    nexts = F.when(F.col("parts_next") > 0, F.transform(
        F.sequence(F.lit(0), F.col("parts_next") - 1), lambda p: F.struct((F.col("stretch") + 1).alias("stretch"), p.alias("part"))))
    sides = blocks.select("chromosome", F.col("stretch").alias("_s"), F.col("part").alias("_p"), F.col("snps").alias("snps_a"),
                          F.explode(F.concat(own, F.coalesce(nexts, F.array().cast("array<struct<stretch:bigint,part:int>>")))).alias("_o"))
    sides = sides.select("chromosome", "snps_a", F.col("_o.stretch").alias("stretch"), F.col("_o.part").alias("part"),
                         ((F.col("_o.stretch") == F.col("_s")) & (F.col("_o.part") == F.col("_p"))).alias("inside"))
    met = sides.where("inside").select("chromosome", "snps_a", "inside", F.lit(None).cast(blocks.schema["snps"].dataType).alias("snps_b"))
    met = met.unionByName(sides.where("not inside").join(
        blocks.select("chromosome", "stretch", "part", F.col("snps").alias("snps_b")), ["chromosome", "stretch", "part"]
    ).select("chromosome", "snps_a", "inside", "snps_b"))

    def products(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a = _Block(batch["snps_a"][k].as_py(), samples)
                b = None if batch["inside"][k].as_py() else _Block(batch["snps_b"][k].as_py(), samples)
                for first, second, pos_a, pos_b, r2 in _block_pairs(a, b, reach):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch["chromosome"][k].as_py()] * len(r2), batch["chromosome"].type), pa.array(first, pa.string()),
                         pa.array(second, pa.string()), pa.array(pos_a), pa.array(pos_b), pa.array(r2, mask=np.isnan(r2))],
                        ["chromosome", "snp_a", "snp_b", "pos_a", "pos_b", "r2"])

    pairs = met.mapInArrow(products, f"chromosome {kinds['chromosome']}, snp_a string, snp_b string, pos_a long, pos_b long, r2 double")
    return pairs.select("chromosome", "snp_a", "snp_b", *[F.col(c).cast(kinds["position"]).alias(c) for c in ("pos_a", "pos_b")], "r2")


def ld_score(geno: DataFrame, pairs: DataFrame) -> DataFrame:
    """1 + the sum of r2 over the partners of a SNP."""
    ends = pairs.select(F.explode(F.array("snp_a", "snp_b")).alias("snp_id"), "r2")
    sums = ends.groupBy("snp_id").agg(F.sum("r2").alias("s"), F.count("r2").alias("n_partners"))
    return geno.select("snp_id").join(sums, "snp_id", "left").select(
        "snp_id", (F.lit(1.0) + F.coalesce("s", F.lit(0.0))).alias("ld_score"), F.coalesce("n_partners", F.lit(0)).cast("bigint").alias("n_partners")
    )


def ld_prune(geno: DataFrame, pairs: DataFrame, kb: float, r2: float = 0.5, block_windows: int = 64) -> DataFrame:
    """SNPs kept by the greedy rule along a chromosome: drop a SNP if an earlier kept one has r2 above the limit.

    A SNP is decided as soon as one earlier strong partner is known to be kept or all are known to be dropped. A
    block of `block_windows` windows decides all that does not hang on what an earlier block has not told yet. The
    messages of a round are the verdicts of its SNPs; only links of undecided SNPs, less those to dropped partners,
    go on to the next, in blocks twice as long while the largest holds at most `MOST_EDGES` links. At least the
    first block with undecided SNPs is settled in every round, so the result is the sequential one; while
    blocks double, the rounds are at most 1 + log2 of the blocks of a chromosome. The rule forgets its past within
    a few SNPs, so two or three rounds are usual, however long the chromosome. A round is one written table.
    """
    width = max(int(kb * 1000), 1) * block_windows
    edges = pairs.where(F.col("r2") > r2).select("chromosome", "snp_a", "snp_b", "pos_a", "pos_b", F.lit(None).cast("boolean").alias("known"))
    verdicts, gone = None, []
    while verdicts is None or not edges.isEmpty():
        if verdicts is not None:
            largest = edges.groupBy("chromosome", _bin(F.col("pos_b"), 2 * width)).count().agg(F.max("count")).first()[0]
            width *= 2 if largest <= MOST_EDGES else 1
        verdicts = staged(edges.groupBy("chromosome", _bin(F.col("pos_b"), width).alias("block")).applyInPandas(
            _settler(width, dict(pairs.dtypes)), _LINK.format(**{"chromosome": dict(pairs.dtypes)["chromosome"]})), "ld-verdicts")
        gone.append(verdicts.where("snp_a IS NULL AND kept = false").select(F.col("snp_b").alias("snp_id")))
        told = verdicts.where("snp_a IS NULL").select(F.col("snp_b").alias("snp_a"), F.col("kept").alias("known"), F.lit(True).alias("_told"))
        open_links = verdicts.where("snp_a IS NOT NULL").select("chromosome", "snp_a", "snp_b", "pos_a", "pos_b")
        # a partner without a verdict has no earlier strong partner: kept
        edges = open_links.join(told, "snp_a", "left").withColumn("known", F.when(F.col("_told").isNull(), F.lit(True)).otherwise(F.col("known"))).drop("_told")
    dropped = gone[0]
    for more in gone[1:]:
        dropped = dropped.unionByName(more)
    return geno.select("chromosome", "position", "snp_id").join(dropped, "snp_id", "left_anti").select("chromosome", "position", "snp_id")


_LINK = "chromosome {chromosome}, snp_a string, snp_b string, pos_a long, pos_b long, kept boolean"


def _settler(width: int, kinds: dict[str, str]):
    """What a block can decide: a row per SNP (snp_a NULL, kept NULL if undecided) and one per link of an undecided SNP."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos_b", "snp_b"], kind="stable").reset_index(drop=True)
        inside = (pdf["pos_a"] // width == pdf["pos_b"] // width).tolist()
        earlier, later = pdf["snp_a"].tolist(), pdf["snp_b"].tolist()
        known = [None if pd.isna(k) else bool(k) for k in pdf["known"]]
        verdict: dict[str, bool | None] = {}
        waiting: list[int] = []
        start = 0
        while start < len(later):
            end, kept, unsure = start, True, []
            while end < len(later) and later[end] == later[start]:
                # inside the block a SNP that is not yet judged has no earlier strong partner
                side = known[end] if known[end] is not None else (verdict.get(earlier[end], True) if inside[end] else None)
                if side:
                    kept = False
                elif side is None:
                    unsure.append(end)
                end += 1
            verdict[later[start]] = None if kept and unsure else kept
            if kept and unsure:
                waiting += unsure
            start = end
        links = pdf.iloc[waiting][["chromosome", "snp_a", "snp_b", "pos_a", "pos_b"]].assign(kept=None)
        out = pd.DataFrame({"chromosome": pdf["chromosome"].iloc[0], "snp_a": None, "snp_b": list(verdict), "pos_a": None, "pos_b": None,
                            "kept": list(verdict.values())}, dtype=object)
        return pd.concat([out, links.astype(object)], ignore_index=True)

    return settle
