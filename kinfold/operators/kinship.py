"""Kinship matrices by distributed block aggregation.

A kinship is K = A / c with A = sum over SNPs of z z' (z the centred dosage,
missing calls 0 after centring) and c = trace(A) / n, which makes the mean
diagonal 1. Each task streams its SNP rows and keeps one tile of A; the tiles
are emitted as (i, j, a), i <= j, and added up with map-side combine. The
number of emitted rows depends on samples and partitions, not on SNPs. Above
`tile` samples the matrix is cut in tiles, so that a task holds two blocks of
columns and never all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinfold.functions.ranking import with_ranges
from kinfold.functions.stats import safe_corr
from kinfold.operators.genotype import with_snp_stats
from kinfold.session import join_sized, staged

TILE = 2048
PACKED = 3 * TILE  # samples up to which the all-SNP triangle is added up as packed arrays
BATCH = 512
CHUNK = 4096
MERGE_WIDTH = 64
PAIR_ROWS = 1 << 18
PIECE = 1 << 17  # pairs of a piece of a triangle; a line is never cut
BAND_BYTES = 128 << 20  # of the lines of a matrix that a task of `kernel_pieces` adds up
CELLS = 1 << 22  # centred dosages, and sums of a product, that a task of `kernel_pieces` forms at a time
EMPTY = 1e-9


def centred(lists: pa.Array, width: int) -> np.ndarray:
    """SNP rows x samples: dosage minus the SNP mean over called samples; missing 0."""
    flat = lists.flatten()
    x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width)
    counts = width - missing.sum(axis=1)
    total = x.sum(axis=1)
    mean = np.divide(total, counts, out=np.zeros_like(total), where=counts > 0)
    x -= mean[:, None]
    x[missing] = 0.0
    return x


def with_centred(geno: DataFrame) -> DataFrame:
    """`z`: centred dosages as array<double>, for expressions over single SNPs."""
    called = F.size(F.filter("dosages", lambda d: d.isNotNull()))
    total = F.aggregate("dosages", F.lit(0), lambda acc, d: acc + F.coalesce(d.cast("int"), F.lit(0)))
    mean = total / F.nullif(called.cast("double"), F.lit(0.0))
    return geno.withColumn("_m", F.coalesce(mean, F.lit(0.0))).withColumn(
        "z", F.transform("dosages", lambda d: F.coalesce(d.cast("double") - F.col("_m"), F.lit(0.0)))
    ).drop("_m")


def gram(geno: DataFrame, key: str | None = None, salt: int | str = 8, tile: int | None = None, samples: int | None = None) -> DataFrame:
    """Sum of z z' per set: (set_id, i, j, a) with 0-based sample indexes i <= j.

    Without `key` the genotypes are not shuffled while the matrix fits one
    tile: every input partition yields one partial matrix. With `key` the
    rows of a set are spread over `salt` tasks. Above `tile` samples (their
    number is taken from a row unless given) tiles are cut; without `key`, up to
    `PACKED` samples, partial triangles are added as arrays instead, and a pair
    becomes a row only in the result.
    """
    n, packed = samples or panel_size(geno), key is None and tile is None
    tile = tile or TILE
    tiles = max(1, -(-n // tile))
    if packed and 1 < tiles and n <= PACKED:
        return _pair_sums(packed_total(geno))
    geno = geno if key or tiles > 1 else _tasks(geno)
    cols = ([F.col(key).cast("string").alias("set_id")] if key else [F.lit("all").alias("set_id")])
    cols.append((F.col(salt) if isinstance(salt, str) else F.lit(salt)).alias("_salts"))
    if tiles == 1:
        rows = geno.select(*cols, *(["snp_id"] if key else []), F.lit(0).alias("bi"), F.lit(0).alias("bj"),
                           F.col("dosages").alias("x"), F.lit(None).cast("array<tinyint>").alias("y"))
        width = None
    else:
        blocks = F.array(*[F.struct(F.lit(i).alias("bi"), F.lit(j).alias("bj")) for i in range(tiles) for j in range(i, tiles)])
        part = lambda b: F.slice("z", b * tile + 1, F.lit(tile))
        rows = (
            with_centred(geno).select(*cols, "snp_id", "z", F.explode(blocks).alias("_b"))
            .select("set_id", "_salts", "snp_id", F.col("_b.bi").alias("bi"), F.col("_b.bj").alias("bj"),
                    part(F.col("_b.bi")).alias("x"), part(F.col("_b.bj")).alias("y"))
        )
    if key or tiles > 1:
        spread = F.pmod(F.xxhash64("snp_id"), F.col("_salts"))  # not the dosages: linked SNPs have equal ones
        rows = (
            rows.withColumn("_salt", spread).repartition("set_id", "bi", "bj", "_salt")
            .sortWithinPartitions("set_id", "bi", "bj")
        )
    rows = rows.select("set_id", "bi", "bj", "x", "y")

    def partial(batches):
        held, acc = None, None

        def emit():
            set_id, bi, bj = held
            i, j = np.triu_indices(acc.shape[0]) if bi == bj else (ix.ravel() for ix in np.indices(acc.shape))
            return pa.RecordBatch.from_pydict({
                "set_id": pa.array([set_id] * len(i), pa.string()),
                "i": pa.array(i + bi * tile, pa.int32()), "j": pa.array(j + bj * tile, pa.int32()),
                "a": pa.array(acc[i, j], pa.float64()),
            })

        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = list(zip(batch["set_id"].to_pylist(), batch["bi"].to_pylist(), batch["bj"].to_pylist()))
            start = 0
            while start < len(keys):
                stop = start
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if held != keys[start]:
                    if held is not None:
                        yield emit()
                    held, acc = keys[start], None
                for lo in range(start, stop, BATCH):
                    n = min(BATCH, stop - lo)
                    x = batch["x"].slice(lo, n)
                    if tiles == 1:
                        zi = zj = centred(x, len(x[0]))
                    else:
                        y = batch["y"].slice(lo, n)
                        zi = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                        zj = y.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                    step = zi.T @ zj
                    acc = step if acc is None else acc + step
                start = stop
        if held is not None:
            yield emit()

    parts = rows.mapInArrow(partial, "set_id string, i int, j int, a double")
    return parts.groupBy("set_id", "i", "j").agg(F.sum("a").alias("a"))


def panel_size(geno: DataFrame) -> int:
    """Samples of a genotype table, from its first row; 0 without rows."""
    row = geno.select(F.size("dosages").alias("n")).first()
    return row["n"] if row else 0


def _parts(chunk: int) -> Column:
    """Tasks for a set: one per `chunk` SNPs."""
    return F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("_parts")


def scale_gram(numerators: DataFrame, by=("set_id",), least: Column | float = 0.0) -> DataFrame:
    """K = A / (trace(A) / n); the trace is a small aggregate joined back.

    A scale up to `least` is that of an empty part (what rounding leaves of a
    complement without SNPs) and gives a NULL kernel.
    """
    least = F.lit(least) if isinstance(least, float) else least
    trace = (
        numerators.where(F.col("i") == F.col("j")).groupBy(*by)
        .agg((F.sum("a") / F.count(F.lit(1))).alias("c"))
    )
    trace = trace.withColumn("c", F.when(F.col("c") > least, F.col("c")).otherwise(F.lit(0.0)))
    return join_sized(numerators, trace, list(by)).withColumn("k", F.col("a") / F.nullif("c", F.lit(0.0)))


def mean_diagonal(geno: DataFrame) -> DataFrame:
    """The empirical scale, trace(A) / n, in one row `c`: the squares of the centred dosages added up, without a pair of samples."""

    def add(batches):
        total, width = 0.0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                x = batch["dosages"].slice(lo, BATCH)
                width = len(x[0])
                flat = x.flatten()
                called = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).sum(axis=1)
                dose = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
                sums, squares = dose.sum(axis=1, dtype=float), np.einsum("ij,ij->i", dose, dose, dtype=float)
                total += float((squares - sums**2 / np.maximum(called, 1)).sum())
        if width:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([width], pa.int32())], names=["t", "n"])

    return geno.select("dosages").mapInArrow(add, "t double, n int").agg((F.sum("t") / F.max("n")).alias("c"))


def hwe_denominator(geno: DataFrame) -> DataFrame:
    """The textbook denominator: sum of 2p(1-p) over SNPs."""
    p = F.col("freq")
    return with_snp_stats(geno).agg(F.sum(2 * p * (1 - p)).alias("c"))


def kinship(geno: DataFrame, denominator: str = "empirical", samples: int | None = None) -> DataFrame:
    """All-SNP kinship: (i, j, a, c, k).

    The numerators are written once: their scale needs the diagonal, and a
    filter on it would be pushed below the sums and run every product again.
    """
    numerators = staged(gram(geno, samples=samples), "numerators")
    if denominator == "hwe":
        c = hwe_denominator(geno)
        return numerators.withColumn("c", c.scalar()).withColumn("k", F.col("a") / F.col("c"))
    return scale_gram(numerators)


def partition_kinship(geno: DataFrame, sets: DataFrame, key: str = "set_id", chunk: int = CHUNK,
                      scopes: DataFrame | None = None, outside: DataFrame | None = None) -> DataFrame:
    """In-set and out-of-set kinship of every set: (set_id, partition, i, j, a, c, k).

    A matched random set has a pool of SNPs of its own: `scopes` (set_id, scope) names it and `outside`
    (scope, snp_id) holds the SNPs that the pool lacks; neither partition has them. The rows of
    `kernel_pieces`: a pair of samples becomes a row only in the result.
    """
    return piece_pairs(kernel_pieces(geno, sets, key, chunk, scopes, outside))


def _cuts(n: int, band_bytes: int, piece: int) -> list[list[tuple[int, int]]]:
    """The lines of a triangle of `n` samples in bands of equal height, each as pieces [low, high) of about `piece` pairs."""
    bands = max(1, -(-8 * n * n // band_bytes))
    height = -(-n // bands)
    out = []
    for first in range(0, n, height):
        pieces, low, held = [], first, 0
        for i in range(first, min(first + height, n)):
            if held and held + n - i > piece:
                pieces.append((low, i))
                low, held = i, 0
            held += n - i
        out.append([*pieces, (low, min(first + height, n))])
    return out


def piece_places(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample indexes (i, j) of the pairs of a piece, in its order."""
    i = np.repeat(np.arange(low, high), n - np.arange(low, high))
    return i, np.concatenate([np.arange(k, n) for k in range(low, high)])


def piece_diagonal(n: int, low: int, high: int) -> np.ndarray:
    """Where the pairs i = j of a piece stand."""
    return np.cumsum(np.concatenate([[0], n - np.arange(low, high - 1)])).astype(int)


def kernel_pieces(geno: DataFrame, sets: DataFrame, key: str = "set_id", chunk: int = CHUNK, scopes: DataFrame | None = None,
                  outside: DataFrame | None = None, band_bytes: int = BAND_BYTES, piece: int = PIECE) -> DataFrame:
    """The sums of both parts of many sets in pieces of the triangle: (set_id, n, low, high, scales, a1, a2); `scopes`, `outside` as
    in `partition_kinship`.

    A piece holds lines low to high - 1 of the upper triangle, about `piece` pairs, as packed doubles; a kernel is the sums over
    their scale, and a part without SNPs has scale 0. A task adds up a band of lines for about `chunk` SNPs, so no task and no
    row holds a whole matrix. Of a set (or scope) with more than half of the SNPs the others are added up instead: the
    all-SNP sums are needed anyway, and the difference is the set.
    """
    n = max(panel_size(geno), 1)
    groups = sets.select(F.concat(F.lit("s"), F.col(key).cast("string")).alias("g"), "snp_id")
    if outside is not None:
        groups = groups.unionByName(outside.select(F.concat(F.lit("o"), F.col("scope").cast("string")).alias("g"), "snp_id"))
    groups = groups.distinct()
    whole = geno.agg(F.count(F.lit(1)).alias("whole"))
    held = F.count(F.lit(1))
    sizes = geno.select("snp_id").join(groups, "snp_id").groupBy("g").agg(held.alias("_n")).withColumn("_whole", whole.scalar())
    large = 2 * F.col("_n") > F.col("_whole")
    summed = F.when(large, F.col("_whole") - F.col("_n")).otherwise(F.col("_n"))
    sizes = staged(sizes.select("g", large.alias("large"), F.greatest(F.ceil(summed / F.lit(chunk)), F.lit(1)).cast("int").alias("_parts")), "set-sizes")
    named = groups.join(sizes.select("g", "large"), "g").groupBy("snp_id").agg(
        F.collect_list(F.when(~F.col("large"), F.col("g"))).alias("_small"), F.collect_list(F.when(F.col("large"), F.col("g"))).alias("_large"))
    every = sizes.agg(F.collect_list(F.when(F.col("large"), F.col("g"))).alias("every")).scalar()
    none = F.array().cast("array<string>")
    added = F.concat(F.array(F.lit("all")), F.coalesce("_small", none), F.array_except(every, F.coalesce("_large", none)))
    parts = sizes.select("g", "_parts").unionByName(whole.select(F.lit("all").alias("g"), F.greatest(F.ceil(F.col("whole") / F.lit(chunk)), F.lit(1)).cast("int").alias("_parts")))
    cuts = _cuts(n, band_bytes, piece)
    rows = geno.select("snp_id", "dosages").join(named, "snp_id", "left").select("snp_id", "dosages", F.explode(added).alias("g"))
    rows = join_sized(rows, parts, ["g"]).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("snp_id"), F.col("_parts"))).repartition("g", "band", "_salt").sortWithinPartitions("g", "band")
    sums = staged(_added_pieces(_band_sums(rows.select("g", "band", "dosages"), n, cuts), n), "piece-sums")

    traces = staged(sums.groupBy("g").agg(F.sum("trace").alias("t")), "traces")
    own = sizes.where("g LIKE 's%'").join(traces, "g", "left").select("g", F.expr("substring(g, 2)").alias("set_id"), "large", F.coalesce("t", F.lit(0.0)).alias("t"))
    if outside is not None:
        away = sizes.where("g LIKE 'o%'").join(traces, "g", "left").select(
            F.col("g").alias("away"), F.expr("substring(g, 2)").alias("scope"), F.col("large").alias("away_large"), F.coalesce("t", F.lit(0.0)).alias("away_t"))
        own = own.join(scopes.select(F.col(key).cast("string").alias("set_id"), F.col("scope").cast("string").alias("scope")).distinct(), "set_id", "left").join(away, "scope", "left").drop("scope")
    else:
        own = own.withColumns({"away": F.lit(None).cast("string"), "away_large": F.lit(None).cast("boolean"), "away_t": F.lit(None).cast("double")})
    total = F.col("all_t")
    inside = F.when(F.col("large"), total - F.col("t")).otherwise(F.col("t"))
    lacking = F.coalesce(F.when(F.col("away_large"), total - F.col("away_t")).otherwise(F.col("away_t")), F.lit(0.0))
    scale = lambda t: F.when(t > F.lit(EMPTY) * total, t / F.lit(float(n))).otherwise(F.lit(0.0))
    own = own.withColumn("all_t", traces.where("g = 'all'").select("t").scalar())
    own = staged(own.withColumn("scales", F.array(scale(inside), scale(total - lacking - inside))).drop("t", "away_t", "all_t"), "set-scales")

    # every set meets every piece of the all-SNP sums; a missing piece of a set or scope is one without SNPs
    places = sums.where("g = 'all'").select("low", "high")
    wide = own.crossJoin(F.broadcast(places)).join(sums.select("g", "low", F.col("a").alias("of_set")), ["g", "low"], "left")
    wide = wide.join(sums.select(F.col("g").alias("away"), "low", F.col("a").alias("of_scope")), ["away", "low"], "left")
    wide = wide.join(sums.where("g = 'all'").select("low", F.col("a").alias("of_all")), "low")
    schema = pa.schema([("set_id", pa.string()), ("n", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("scales", pa.list_(pa.float64())),
                        ("a1", pa.binary()), ("a2", pa.binary())])

    def sums_of(blob: pa.BinaryScalar, total: np.ndarray, whole_less: bool | None) -> np.ndarray:
        a = np.frombuffer(blob.as_buffer()) if blob.is_valid else np.zeros_like(total)
        return total - a if whole_less else a

    def finish(batches):
        for batch in batches:
            told = batch.select(["set_id", "low", "high", "large", "away_large", "scales"]).to_pylist()
            for r, of_set, of_scope, of_all in zip(told, batch["of_set"], batch["of_scope"], batch["of_all"]):
                total = np.frombuffer(of_all.as_buffer())
                first = sums_of(of_set, total, r["large"])
                second = total - sums_of(of_scope, total, r["away_large"]) - first
                yield pa.RecordBatch.from_pylist([{"set_id": r["set_id"], "n": n, "low": r["low"], "high": r["high"], "scales": r["scales"],
                                                   "a1": first.tobytes(), "a2": second.tobytes()}], schema)

    return wide.select("set_id", "low", "high", "large", "away_large", "scales", "of_set", "of_scope", "of_all").mapInArrow(
        finish, "set_id string, n int, low int, high int, scales array<double>, a1 binary, a2 binary")


def _band_sums(rows: DataFrame, n: int, cuts: list[list[tuple[int, int]]]) -> DataFrame:
    """Partial sums of z z' over runs of equal (g, band), as packed pieces: (g, low, high, a).

    Beside its band of sums a task holds the SNPs of one step and the product of some lines, CELLS numbers each at most (or a row).
    """
    schema = pa.schema([("g", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("a", pa.binary())])
    at_once = max(1, min(BATCH, CELLS // n))
    lines = max(1, CELLS // n)

    def partial(batches):
        held, acc = None, None

        def emit():
            first = cuts[held[1]][0][0]
            for low, high in cuts[held[1]]:
                a = np.concatenate([acc[i - first, i - first :] for i in range(low, high)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([held[0]], pa.string()), pa.array([low], pa.int32()), pa.array([high], pa.int32()), pa.array([a.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            keys = list(zip(batch["g"].to_pylist(), batch["band"].to_pylist()))
            start = 0
            while start < len(keys):
                stop = start
                while stop < len(keys) and keys[stop] == keys[start] and stop - start < at_once:
                    stop += 1
                if keys[start] != held:
                    if held is not None:
                        yield from emit()
                    held, acc = keys[start], None
                first, last = cuts[held[1]][0][0], cuts[held[1]][-1][1]
                acc = np.zeros((last - first, n - first)) if acc is None else acc
                z = centred(batch["dosages"].slice(start, stop - start), n)
                for lo in range(first, last, lines):
                    hi = min(lo + lines, last)
                    acc[lo - first : hi - first] += z[:, lo:hi].T @ z[:, first:]
                start = stop
        if held is not None:
            yield from emit()

    return rows.mapInArrow(partial, "g string, low int, high int, a binary")


def _added_pieces(parts: DataFrame, n: int) -> DataFrame:
    """The partial pieces of a group added up: (g, low, high, a, trace), trace of the pairs i = j of the piece."""
    schema = pa.schema([("g", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("a", pa.binary()), ("trace", pa.float64())])

    def add(batches):
        held, acc = None, None

        def told():
            g, low, high = held
            return pa.RecordBatch.from_arrays(
                [pa.array([g], pa.string()), pa.array([low], pa.int32()), pa.array([high], pa.int32()), pa.array([acc.tobytes()], pa.binary()),
                 pa.array([float(acc[piece_diagonal(n, low, high)].sum())])], schema=schema)

        for batch in batches:
            for r, (g, low, high) in enumerate(zip(*(batch[c].to_pylist() for c in ("g", "low", "high")))):
                a = np.frombuffer(batch["a"][r].as_buffer())
                if (g, low, high) == held:
                    acc += a
                    continue
                if held is not None:
                    yield told()
                held, acc = (g, low, high), a.copy()
        if held is not None:
            yield told()

    dealt = parts.repartition("g", "low").sortWithinPartitions("g", "low")
    return dealt.mapInArrow(add, "g string, low int, high int, a binary, trace double")


def piece_pairs(pieces: DataFrame) -> DataFrame:
    """The pieces of `kernel_pieces` as rows (set_id, partition, i, j, a, c, k), i <= j; k is NULL for a part without SNPs."""
    schema = pa.schema([("set_id", pa.string()), ("partition", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.float64()), ("c", pa.float64()), ("k", pa.float64())])

    def spread(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                i, j = (pa.array(v, pa.int32()) for v in piece_places(*(batch[c][r].as_py() for c in ("n", "low", "high"))))
                for part, scale in enumerate(batch["scales"][r].as_py(), 1):
                    a = np.frombuffer(batch[f"a{part}"][r].as_buffer())
                    k = pa.array(a / scale) if scale > 0 else pa.nulls(len(a), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(batch["set_id"][r], len(a)), pa.repeat(pa.scalar(part, pa.int32()), len(a)), i, j, pa.array(a), pa.repeat(pa.scalar(scale), len(a)), k], schema=schema)

    return pieces.select("set_id", "n", "low", "high", "scales", "a1", "a2").mapInArrow(
        spread, "set_id string, partition int, i int, j int, a double, c double, k double")


def name_samples(pairs: DataFrame, panel: DataFrame) -> DataFrame:
    """Replace the indexes i, j by sample ids."""
    iids = panel.scalar()
    return pairs.withColumn("i", F.element_at(iids, F.col("i") + 1)).withColumn("j", F.element_at(iids, F.col("j") + 1))


def packed_kernels(kinships: DataFrame, by=("set_id", "partition")) -> DataFrame:
    """Upper triangle of each kernel as array<double> in (i, j) order, for the dense fits.

    One kernel becomes one row: a caller whose panels do not fit in a task's
    memory uses `fit_he`, which works on the long form. Rows of the triangle
    are gathered first: the last step sorts n arrays, not n^2 values.
    """
    by = list(by)
    fits = F.coalesce("k", F.lit(0.0))
    lines = kinships.groupBy(*by, "i").agg(
        F.max("c").alias("c"), F.max("j").alias("j"),
        F.transform(F.sort_array(F.collect_list(F.struct("j", fits.cast("double").alias("k")))), lambda s: s["k"]).alias("line"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("i", "line")))
    return lines.groupBy(*by).agg(
        (F.max("j") + 1).alias("n"), F.max("c").alias("c"), F.flatten(F.transform(ordered, lambda s: s["line"])).alias("kernel")
    )


def set_kernels(geno: DataFrame, sets: DataFrame, key: str = "set_id", chunk: int = CHUNK,
                scopes: DataFrame | None = None, outside: DataFrame | None = None) -> DataFrame:
    """Both kernels of many sets, packed: (set_id, n, scales, kernels); `scopes`, `outside` as in `partition_kinship`.

    For grids of thousands of small sets. Partial matrices travel as packed
    triangles, one row each, and are added in a streaming pass sorted by set;
    the complement is the packed total minus the sum. Equal to
    `partition_kinship` followed by packing, without a row per sample pair.
    """
    members = sets.select(F.col(key).cast("string").alias("set_id"), "snp_id").distinct()
    sizes = members.groupBy("set_id").agg(_parts(chunk))
    rows = geno.select("snp_id", "dosages").join(members.join(sizes, "set_id"), "snp_id")
    rows = (
        rows.withColumn("_salt", F.pmod(F.xxhash64("snp_id"), F.col("_parts"))).repartition("set_id", "_salt")
        .sortWithinPartitions("set_id").select("set_id", "dosages")
    )
    sums = _packed_sums(rows).withColumn("t", packed_total(geno).select("a").scalar())
    if outside is not None:
        away = geno.select("snp_id", "dosages").join(outside.select(F.col("scope").alias("set_id"), "snp_id").distinct(), "snp_id")
        away = _packed_sums(away.repartition("set_id").sortWithinPartitions("set_id").select("set_id", "dosages"))
        away = _added(away.repartition("set_id").sortWithinPartitions("set_id")).select(F.col("set_id").alias("scope"), F.col("a").alias("away"))
        named = join_sized(sums, scopes.select(F.col(key).cast("string").alias("set_id"), "scope").distinct(), ["set_id"], "left")
        sums = named.join(away, "scope", "left").withColumn("t", F.when(F.col("away").isNull(), F.col("t")).otherwise(F.zip_with("t", "away", lambda t, a: t - a)))
    sums = sums.select("set_id", "a", "t").repartition("set_id").sortWithinPartitions("set_id")
    schema = "set_id string, n int, scales array<double>, kernels array<array<double>>"

    def finish(batches):
        for set_id, acc, total in _sum_runs(batches):
            n = int((np.sqrt(8 * len(acc) + 1) - 1) / 2)
            diagonal = np.cumsum(np.concatenate([[0], np.arange(n, 1, -1)]))
            parts = [acc, total - acc]
            least = EMPTY * total[diagonal].sum() / n
            scales = [c if c > least else 0.0 for c in (float(p[diagonal].sum() / n) for p in parts)]
            kernels = [p / c if c > 0 else np.zeros_like(p) for p, c in zip(parts, scales)]
            yield pa.RecordBatch.from_pydict({
                "set_id": pa.array([set_id], pa.string()), "n": pa.array([n], pa.int32()),
                "scales": pa.array([scales], pa.list_(pa.float64())), "kernels": pa.array([kernels], pa.list_(pa.list_(pa.float64()))),
            })

    return sums.mapInArrow(finish, schema)


def kernel_pairs(kernels: DataFrame, rows: int = PAIR_ROWS) -> DataFrame:
    """Packed kernels (set_id, n, scales, kernels) as rows (set_id, partition, i, j, k), i <= j; k is NULL for a part without SNPs."""
    schema = pa.schema([("set_id", pa.string()), ("partition", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("k", pa.float64())])

    def spread(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                i, j = (pa.array(x, pa.int32()) for x in np.triu_indices(batch["n"][r].as_py()))
                for part, (scale, k) in enumerate(zip(batch["scales"][r].as_py(), batch["kernels"][r].values), 1):
                    k = k.values if scale > 0 else pa.nulls(len(i), pa.float64())
                    for lo in range(0, len(i), rows):
                        m = min(rows, len(i) - lo)
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(batch["set_id"][r], m), pa.repeat(pa.scalar(part, pa.int32()), m), i.slice(lo, m), j.slice(lo, m), k.slice(lo, m)], schema=schema)

    return kernels.select("set_id", "n", "scales", "kernels").mapInArrow(spread, "set_id string, partition int, i int, j int, k double")


def packed_kinship(geno: DataFrame) -> DataFrame:
    """The all-SNP kinship of a panel whose triangle fits in a task, packed: (set_id, n, scales, kernels) with one kernel.

    Partial matrices are added as arrays: no row per sample pair before the result. `kinship` cuts tiles instead.
    """
    total = packed_total(geno).select("a").where("size(a) > 0")
    n = ((F.sqrt(8.0 * F.size("a") + 1) - 1) / 2).cast("int")
    at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("a", (i * F.col("n") - F.floor(i * (i - 1) / 2) + 1).cast("int")))
    scaled = total.withColumn("n", n).withColumn("c", F.aggregate(at, F.lit(0.0), lambda s, v: s + v) / F.col("n"))
    return scaled.select(F.lit("all").alias("set_id"), "n", F.array("c").alias("scales"), F.array(F.transform("a", lambda v: v / F.nullif("c", F.lit(0.0)))).alias("kernels"))


def packed_total(geno: DataFrame) -> DataFrame:
    """The all-SNP numerators as one packed row, added in two streaming levels."""
    one = _tasks(geno).select(F.lit("all").alias("set_id"), "dosages")
    first = _packed_sums(one).withColumn("_g", F.pmod(F.xxhash64("a"), F.lit(MERGE_WIDTH)))
    middle = _added(first.repartition(MERGE_WIDTH, "_g").select("set_id", "a"))
    return _added(middle.coalesce(1))


def _pair_sums(totals: DataFrame, rows: int = PAIR_ROWS) -> DataFrame:
    """Packed sums (set_id, a) as rows (set_id, i, j, a), i <= j."""
    schema = pa.schema([("set_id", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.float64())])

    def spread(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a = batch["a"][r].values
                i, j = (pa.array(x, pa.int32()) for x in np.triu_indices(int((np.sqrt(8 * len(a) + 1) - 1) / 2)))
                for lo in range(0, len(a), rows):
                    m = min(rows, len(a) - lo)
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch["set_id"][r], m), i.slice(lo, m), j.slice(lo, m), a.slice(lo, m)], schema=schema)

    return totals.mapInArrow(spread, "set_id string, i int, j int, a double")


def _tasks(geno: DataFrame) -> DataFrame:
    """Fewer and longer tasks: each streams its rows and emits one partial matrix."""
    return geno.coalesce(2 * geno.sparkSession.sparkContext.defaultParallelism)


def _added(rows: DataFrame) -> DataFrame:
    def add(batches):
        for set_id, acc, _ in _sum_runs(batches):
            yield pa.RecordBatch.from_pydict({"set_id": pa.array([set_id], pa.string()), "a": pa.array([acc], pa.list_(pa.float64()))})

    return rows.mapInArrow(add, "set_id string, a array<double>")


def _sum_runs(batches):
    """Add the arrays `a` of consecutive rows of a set: (set_id, sum, `t` of the set's first row)."""
    held, acc, total = None, None, None
    for b in batches:
        ids, values = b["set_id"].to_pylist(), b["a"]
        totals = b["t"] if "t" in b.schema.names else None
        for r, set_id in enumerate(ids):
            row = values[r].values.to_numpy(zero_copy_only=False)
            if set_id == held:
                acc += row
                continue
            if held is not None:
                yield held, acc, total
            held, acc = set_id, row.copy()
            total = None if totals is None else totals[r].values.to_numpy(zero_copy_only=False)
    if held is not None:
        yield held, acc, total


def _packed_sums(rows: DataFrame) -> DataFrame:
    """Partial sums of z z' over runs of equal set_id, as packed upper triangles: (set_id, a)."""

    def partial(batches):
        held, acc = None, None

        def emit():
            return pa.RecordBatch.from_pydict({
                "set_id": pa.array([held], pa.string()), "a": pa.array([acc[np.triu_indices(len(acc))]], pa.list_(pa.float64())),
            })

        for b in batches:
            ids = b["set_id"].to_pylist()
            start = 0
            while start < len(ids):
                stop = start
                while stop < len(ids) and ids[stop] == ids[start] and stop - start < BATCH:
                    stop += 1
                x = b["dosages"].slice(start, stop - start)
                width = len(x[0])
                z = centred(x, width)
                if ids[start] != held:
                    if held is not None:
                        yield emit()
                    held, acc = ids[start], z.T @ z
                else:
                    acc += z.T @ z
                start = stop
        if held is not None:
            yield emit()

    return rows.mapInArrow(partial, "set_id string, a array<double>")


def unpack(values, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    i, j = np.triu_indices(n)
    out[i, j] = out[j, i] = np.asarray(values, float)
    return out


def kinship_corr(pairs: DataFrame, by=("set_id",), digits: int = 8) -> DataFrame:
    """Pearson and Spearman correlation of in-set and out-of-set kinship over sample pairs i < j.

    Values are rounded to `digits` first, so that equal relationships tie. Rows
    are ranked within value ranges, with the pair as payload, and shifted by the
    sizes of the ranges below; a second shuffle brings the two parts together.
    """
    group = [*by, "partition"]
    off = pairs.where(F.col("i") < F.col("j")).select(*group, "i", "j", F.round("k", digits).alias("k")).where("k IS NOT NULL")
    placed = with_ranges(off, group, "k")
    below = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*group, "_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    local = W.partitionBy(*group, "_range")
    ranked = placed.withColumn("_r", F.rank().over(local.orderBy("k"))).withColumn("_ties", F.count(F.lit(1)).over(W.partitionBy(*group, "_range", "k")))
    ranked = join_sized(ranked, offsets, [*group, "_range"]).withColumn("r", F.col("_off") + F.col("_r") + (F.col("_ties") - 1) / F.lit(2.0))
    wide = ranked.groupBy(*by, "i", "j").agg(*[
        F.max(F.when(F.col("partition") == p, F.col(v))).alias(f"{v}{p}") for p in (1, 2) for v in ("k", "r")
    ])
    return wide.groupBy(*by).agg(safe_corr("k1", "k2").alias("cor_p"), safe_corr("r1", "r2").alias("cor_s"))
