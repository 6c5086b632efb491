"""Genotype preparation.

Long calls: one row per (snp_id, iid). SNP-major: one row per SNP with
`dosages`, an array with one entry (0, 1, 2 or NULL) per sample, in the order
of the panel. The panel is a one-row DataFrame with the sorted array `iids`;
it is never larger than the dosages of a single SNP.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kinfold.functions.ranking import cumulative
from kinfold.session import staged

PED_BLOCK = 65536
ROW_GROUP = 32 << 20  # bytes of a stored row group of dosages: a reader decodes no more rows than one has
MISSING = -128  # a missing call of a stored table
CELLS = 1 << 22  # dosages that a task gives back at a time


def panel_of(samples: DataFrame, iid: str = "iid") -> DataFrame:
    return samples.agg(F.sort_array(F.collect_set(iid)).alias("iids"))


def build_snp_map(calls: DataFrame) -> DataFrame:
    """Number the SNPs S1, S2, ... along (chromosome, position); genetic distance 0.

    Ranks are taken per chromosome and shifted by the sizes of the chromosomes
    before, so that no task orders the whole genome.
    """
    ranked = cumulative(calls, ["chromosome"], ["position"])
    before = (
        cumulative(calls, [], ["chromosome"])
        .select("chromosome", F.col("below").alias("_before"))
    )
    return (
        ranked.join(before, "chromosome")
        .withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
        .select(
            "chromosome",
            F.concat(F.lit("S"), (F.col("_before") + F.col("below") + F.col("_k")).cast("string")).alias("snp_id"),
            F.lit(0.0).alias("physical"),
            "position",
        )
    )


def diploidize(call: Column) -> Column:
    """A single base becomes a homozygous pair; anything else is missing."""
    return F.when(call.isin("A", "C", "G", "T"), F.concat(call, call))


def call_dosages(lines: DataFrame, calls: str = "calls") -> DataFrame:
    """Count alleles: add `major`, `minor` and `dosages` (2 for a call of the minor base, 0 for the major one).

    The major base is the most frequent of A, C, G, T, the minor one the next;
    of equally frequent bases the first in the alphabet is the major one. Any
    other call, a third base included, is missing. A SNP with one base has no
    minor one. A line stays a row, nothing is shuffled.
    """

    def count(base: str) -> Column:
        return F.struct((-F.size(F.filter(calls, lambda c: c == base))).alias("n"), F.lit(base).alias("base"))

    bases = F.array(*map(count, "ACGT"))
    seen = F.filter(F.sort_array(bases), lambda b: b["n"] < 0)
    named = lines.withColumn("_b", seen).withColumn("major", F.get("_b", F.lit(0))["base"]).withColumn("minor", F.get("_b", F.lit(1))["base"]).drop("_b")
    return named.withColumn("dosages", F.transform(calls, lambda c: F.when(c == F.col("minor"), 2).when(c == F.col("major"), 0).cast("tinyint")))


def to_sample_major(calls: DataFrame, family: str = "family", block: int = PED_BLOCK) -> DataFrame:
    """One row per sample and block of SNPs, with the fixed pedigree columns.

    Input: (idx, iid, call), idx = 0-based SNP order. A leading X on a sample
    name is removed. Blocks bound the length of a row.
    """
    return (
        calls.groupBy(
            F.regexp_replace("iid", "X", "").alias("sample"),
            F.floor(F.col("idx") / F.lit(block)).cast("int").alias("block"),
        )
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "call"))), lambda c: c["call"]).alias("calls"))
        .select(
            F.lit(family).alias("family"), "sample", F.lit(0).alias("paternal"), F.lit(0).alias("maternal"),
            F.lit(-9).alias("sex"), F.lit(-9).alias("phenotype"), "block", "calls",
        )
    )


def keep_samples(df: DataFrame, phenotyped: DataFrame, on: str = "iid") -> DataFrame:
    return df.join(phenotyped.select(on), on, "left_semi")


def in_panel_order(df: DataFrame, panel: DataFrame, values: str, out: str) -> DataFrame:
    """The map `values` (keyed by sample) as an array in panel order; NULL where a sample is absent."""
    one = F.broadcast(panel.select(F.col(panel.columns[0]).alias("_panel")))  # beside the rows: a subquery may not stand in a Python call
    return df.crossJoin(one).withColumn(out, _aligned(df.schema[values].dataType.valueType)(values, "_panel")).drop("_panel")


def _aligned(kind: T.DataType):
    """The values of a map in the order of an array of keys; a lookup per key would read the whole map each time."""

    @F.arrow_udf(T.ArrayType(kind))
    def aligned(maps: pa.Array, keys: pa.Array) -> pa.Array:
        none = maps.is_null().to_pylist()
        rows = []
        for row, entries in enumerate(maps):
            if not none[row]:
                wanted = keys[row].values
                held = entries.values
                rows.append(held.field(1).take(pc.index_in(wanted, value_set=held.field(0).cast(wanted.type))))
            else:
                rows.append(pa.nulls(0, maps.type.item_type))
        flat = pa.concat_arrays(rows) if rows else pa.nulls(0, maps.type.item_type)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
        return pa.ListArray.from_arrays(ends, flat, mask=maps.is_null() if maps.null_count else None)

    return aligned


def to_arrays(long: DataFrame, panel: DataFrame, snp_cols=("snp_id",)) -> DataFrame:
    """Long calls to SNP-major arrays; a sample without a row is a missing call."""
    by_snp = long.groupBy(*snp_cols).agg(
        F.map_from_entries(F.collect_list(F.struct("iid", F.col("dosage").cast("tinyint")))).alias("_m")
    )
    return in_panel_order(by_snp, panel, "_m", "dosages").drop("_m")


def to_long(geno: DataFrame, panel: DataFrame, snp_cols=("snp_id",)) -> DataFrame:
    pairs = F.arrays_zip(panel.scalar().alias("iid"), F.col("dosages").alias("dosage"))
    return geno.select(*snp_cols, F.explode(pairs).alias("_p")).select(
        *snp_cols, F.col("_p")["iid"].alias("iid"), F.col("_p")["dosage"].alias("dosage")
    )


def dosage_lists(dose: np.ndarray, missing: np.ndarray) -> pa.ListArray:
    """SNPs x samples as a list array of bytes."""
    rows, width = dose.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()),
                                    pa.array(dose.ravel(), pa.int8(), mask=missing.ravel()))


def stored(geno: DataFrame, label: str) -> DataFrame:
    """`staged` for a table with `dosages`, which are stored as a byte a sample: a list of numbers in a file costs ten times
    the time to write and to read. They are arrays again in the table that is returned, where they are asked for; `geno` may
    have them as such bytes already."""
    schema = T.StructType([T.StructField("dosages", T.BinaryType()) if f.name == "dosages" else f for f in geno.schema.fields])

    def pack(batches):
        for batch in batches:
            lists = batch["dosages"]
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
            flat = lists.flatten().cast(pa.int8()).fill_null(MISSING).to_numpy(zero_copy_only=False)
            blobs = [flat[lo:hi].tobytes() if given else None for lo, hi, given in zip(ends, ends[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.binary()) if f.name == "dosages" else batch[f.name] for f in schema.fields], names=schema.names)

    packed = geno if geno.schema == schema else geno.mapInArrow(pack, schema)
    return staged(packed, label, ROW_GROUP).withColumn("dosages", _unpacked("dosages"))


def _unpacked(blobs: str) -> Column:
    @F.arrow_udf("array<tinyint>")
    def unpack(column: pa.Array) -> pa.Array:
        column = column.cast(pa.binary())
        if not len(column):
            return pa.array([], pa.list_(pa.int8()))
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.int8)[ends[0] : ends[-1]]
        return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(data, mask=data == MISSING),
                                        mask=column.is_null() if column.null_count else None)

    return unpack(blobs)


def _row_counts(lists: pa.ListArray) -> list[np.ndarray]:
    """(n, n_called, dose) of every row."""
    width = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(width)])
    values = (flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy(zero_copy_only=False))
    if len(width) and width.min() == width.max():
        sums = [v.reshape(len(width), -1).sum(axis=1, dtype=np.int64) for v in values]
    else:
        sums = [np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[ends]) for v in values]
    return [width.astype(np.int64), *sums]


COUNTS = ["n", "n_called", "dose"]


def _told_counts(counted: DataFrame, columns: list[str]) -> DataFrame:
    n, called = F.col("n").cast("double"), F.col("n_called").cast("double")
    return counted.select(
        *columns, F.col("n").cast("int").alias("n"), F.col("n_called").cast("int").alias("n_called"),
        ((n - called) / F.nullif(n, F.lit(0.0))).alias("missing_rate"),
        (F.col("dose") / F.nullif(2 * called, F.lit(0.0))).alias("freq"),
    )


def with_snp_stats(geno: DataFrame) -> DataFrame:
    """Add n, n_called, missing_rate and freq (of the counted allele); no shuffle.

    The counts are taken once per row over Arrow arrays. As array expressions
    they would run element by element outside generated code, and a filter on
    a statistic would evaluate them again for every mention.
    """
    schema = T.StructType(geno.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS])

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int64()) for c in _row_counts(batch["dosages"]))], names=[*batch.schema.names, *COUNTS]
            )

    return _told_counts(geno.mapInArrow(count, schema), geno.columns)


def snp_stats(geno: DataFrame) -> DataFrame:
    """Counts per SNP; the dosages do not come back from the count."""
    columns = [c for c in geno.columns if c != "dosages"]
    schema = T.StructType([geno.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in columns), *(pa.array(c, pa.int64()) for c in _row_counts(batch["dosages"]))], names=[*columns, *COUNTS]
            )

    return _told_counts(geno.mapInArrow(count, schema), columns).select("snp_id", "n", "n_called", "missing_rate", "freq")


def sample_stats(geno: DataFrame, panel: DataFrame) -> DataFrame:
    """Call rate per sample: a task adds up its SNPs over Arrow arrays and tells one row a sample."""
    schema = pa.schema([("_i", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])

    def add(batches):
        acc = np.zeros((3, 0), np.int64)
        for batch in batches:
            lists = batch["dosages"]
            width = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(width) or not width.max():
                continue
            if acc.shape[1] < width.max():
                acc = np.pad(acc, ((0, 0), (0, width.max() - acc.shape[1])))
            flat = lists.flatten()
            called, dose = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy(zero_copy_only=False)
            if width.min() == width.max():
                acc[:, : width.max()] += [np.full(width.max(), len(width)), *(v.reshape(len(width), -1).sum(axis=0, dtype=np.int64) for v in (called, dose))]
            else:
                at = np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)
                for row, values in zip(acc, (np.ones(len(flat), np.int64), called, dose)):
                    np.add.at(row, at, values)
        if acc.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(acc.shape[1]), pa.int32()), *map(pa.array, acc)], schema=schema)

    parts = geno.select("dosages").mapInArrow(add, "_i int, n long, n_called long, dose long").where("n > 0")
    stats = parts.groupBy("_i").agg(F.sum("n").alias("n_snps"), F.sum("n_called").alias("n_called"), F.sum("dose").alias("dose"))
    index = panel.select(F.posexplode("iids").alias("_i", "iid"))
    return stats.join(index, "_i").select(
        "iid", "n_snps", "n_called",
        ((F.col("n_snps") - F.col("n_called")) / F.col("n_snps").cast("double")).alias("missing_rate"),
        (F.col("dose") / F.nullif(F.lit(2.0) * F.col("n_called"), F.lit(0.0))).alias("freq"),
    )


def qc_filter(geno: DataFrame, panel: DataFrame, mind: float = 0.1, geno_max: float = 0.1, maf: float = 0.05):
    """Drop samples, then SNPs by missing rate, then SNPs by minor allele frequency.

    Each step counts on the survivors of the one before. Returns (geno, panel).
    """
    kept = staged(panel_of(sample_stats(geno, panel).where(F.col("missing_rate") <= mind)), "kept")
    mask = panel.withColumn("_kept", kept.scalar()).mapInArrow(_kept_mask, "keep binary")
    names = geno.columns
    schema = T.StructType(geno.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS])

    def slim(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.flatnonzero(np.frombuffer(batch["_keep"][0].as_buffer(), bool))
            columns = {c: batch[c] for c in names}
            columns["dosages"] = _taken(batch["dosages"], at)
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), *(pa.array(c, pa.int64()) for c in _row_counts(columns["dosages"]))], names=[*columns, *COUNTS])

    stats = _told_counts(geno.withColumn("_keep", mask.scalar()).mapInArrow(slim, schema), names)
    ok = stats.where((F.col("missing_rate") <= geno_max) & (F.least("freq", 1 - F.col("freq")) >= maf))
    return ok.drop("n", "n_called", "missing_rate", "freq"), kept


def _kept_mask(batches):
    for batch in batches:
        masks = [pc.is_in(iids.values, value_set=kept.values).to_numpy(zero_copy_only=False).tobytes() for iids, kept in zip(batch["iids"], batch["_kept"])]
        yield pa.RecordBatch.from_arrays([pa.array(masks, pa.binary())], names=["keep"])


def _taken(lists: pa.ListArray, at: np.ndarray) -> pa.ListArray:
    """Some samples of every row; one beyond the end of its row is missing."""
    width = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    valid, dose = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy(zero_copy_only=False)
    if width.min() == width.max() and (not len(at) or at[-1] < width[0]):
        return dosage_lists(dose.reshape(len(width), -1)[:, at], ~valid.reshape(len(width), -1)[:, at])
    places = (np.cumsum(width) - width)[:, None] + at
    beyond = at >= width[:, None]
    places[beyond] = 0
    if not len(flat):
        return dosage_lists(np.zeros(places.shape, np.int8), np.ones(places.shape, bool))
    return dosage_lists(dose[places], beyond | ~valid[places])


def to_minor_dosage(geno: DataFrame, text: bool = False) -> DataFrame:
    """Count the minor allele; a tie at one half keeps the coding. No join: the row holds its statistics.

    Dosages may be arrays, or bytes as `stored` keeps them, and come back as they were; of bytes, `text` makes one text a SNP
    instead, a missing call as a dot.
    """
    if isinstance(geno.schema["dosages"].dataType, T.BinaryType):
        return _minor_bytes(geno, text)
    columns = geno.columns
    schema = T.StructType(geno.schema.fields + [T.StructField("flipped", T.BooleanType())])

    def flip(batches):
        for batch in batches:
            lists = batch["dosages"]
            width, called, dose = _row_counts(lists)
            flipped = dose > called  # freq above one half
            flat = lists.flatten()
            values = flat.fill_null(0).to_numpy(zero_copy_only=False)
            values = np.where(np.repeat(flipped, width), 2 - values, values).astype(np.int8)
            recoded = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()),
                                               pa.array(values, pa.int8(), mask=~flat.is_valid().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*(recoded if c == "dosages" else batch[c] for c in columns), pa.array(flipped)], names=[*columns, "flipped"])

    return geno.mapInArrow(flip, schema)


def _minor_bytes(geno: DataFrame, text: bool) -> DataFrame:
    """`to_minor_dosage` of dosages as bytes: a row is recoded by itself and a few MB are given back at a time."""
    columns = geno.columns
    kind, arrow = (T.StringType(), pa.string()) if text else (T.BinaryType(), pa.binary())
    schema = T.StructType([T.StructField(f.name, kind) if f.name == "dosages" else f for f in geno.schema.fields] + [T.StructField("flipped", T.BooleanType())])

    def flip(batches):
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                out, flipped, held = [], [], 0
                while start + len(out) < batch.num_rows and held < CELLS:
                    blob = batch["dosages"][start + len(out)]
                    x = np.frombuffer(blob.as_buffer() if blob.is_valid else b"", np.int8)
                    called = x != MISSING
                    minor = int(x.sum(where=called, dtype=np.int64)) > int(called.sum())  # freq above one half
                    x = np.where(called, 2 - x, x) if minor else x
                    out.append(_dosage_text(x) if text else x.tobytes() if blob.is_valid else None)
                    flipped.append(minor)
                    held += len(x)
                piece = batch.slice(start, len(out))
                yield pa.RecordBatch.from_arrays([*(pa.array(out, arrow) if c == "dosages" else piece[c] for c in columns), pa.array(flipped)], names=[*columns, "flipped"])
                start += len(out)

    return geno.mapInArrow(flip, schema)


def _dosage_text(x: np.ndarray) -> str:
    missing = x == MISSING
    if ((x >= 0) & (x <= 9) | missing).all():
        return np.where(missing, ord("."), x + ord("0")).astype(np.uint8).tobytes().decode("ascii")
    return "".join("." if v == MISSING else str(v) for v in x.tolist())
