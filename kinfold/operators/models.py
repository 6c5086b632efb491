"""Variance models over a grid of (kernel set, trait, repeat, fold), and prediction."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.functions.hashing import hash_bits, hash_key
from kinfold.functions.ranking import cumulative
from kinfold.operators import effects as ef
from kinfold.operators.effects import alpha_table  # noqa: F401  (part of this module's interface)
from kinfold.operators.genotype import in_panel_order
from kinfold.operators.kinship import centred, piece_diagonal, piece_places, unpack
from kinfold.operators.reml import Basis, Fit, FoldBasis, fit_many, fit_one, ratio_sd
from kinfold.session import join_sized, staged



def cv_folds(samples: DataFrame, repeats: int = 5, k: int = 10, seed: str = "cv", iid: str = "iid") -> DataFrame:
    """`repeats` random splits in k folds whose sizes differ by at most one: (iid, cv, fold)."""
    grid = samples.select(F.col(iid).alias("iid")).withColumn("cv", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    keyed = grid.withColumn("bits", hash_bits(seed, "cv", "iid")).withColumn("h", hash_key(seed, "cv", "iid"))
    ranked = cumulative(keyed, ["cv"], ["h", "iid"], key="bits")
    long_size = F.floor((F.col("total") + k - 1) / F.lit(k))
    short_size = F.floor(F.col("total") / F.lit(k))
    n_long = F.pmod(F.col("total"), F.lit(k))
    first = n_long * long_size
    fold = F.when(F.col("below") < first, F.floor(F.col("below") / F.greatest(long_size, F.lit(1)))).otherwise(
        n_long + F.floor((F.col("below") - first) / F.greatest(short_size, F.lit(1)))
    )
    return ranked.select("iid", "cv", (fold + 1).cast("int").alias("fold"))


def pheno_arrays(long: DataFrame, panel: DataFrame, value: str = "value") -> DataFrame:
    """One row per trait with the values in panel order."""
    by_trait = long.groupBy("trait").agg(F.map_from_entries(F.collect_list(F.struct("iid", value))).alias("_m"))
    return in_panel_order(by_trait, panel, "_m", "y").drop("_m")


def covariate_arrays(covar: DataFrame, panel: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the covariates, each as an array in panel order."""
    maps = covar.agg(*[F.map_from_entries(F.collect_list(F.struct("iid", c))).alias(c) for c in cols])
    for c in cols:
        maps = in_panel_order(maps, panel, c, c)
    return maps.select(F.array(*cols).alias("w"))


def fold_arrays(folds: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: per repeat, the fold of every sample in panel order."""
    by_cv = folds.groupBy("cv").agg(F.map_from_entries(F.collect_list(F.struct("iid", "fold"))).alias("_m"))
    rows = in_panel_order(by_cv, panel, "_m", "fold")
    return rows.agg(F.sort_array(F.collect_list(F.struct("cv", "fold"))).alias("folds"))


def model_kernels(packed: DataFrame) -> DataFrame:
    """One row per set with its kernels in partition order and their scales."""
    ordered = F.sort_array(F.collect_list(F.struct("partition", "c", "kernel")))
    return packed.groupBy("set_id").agg(
        F.max("n").alias("n"), F.transform(ordered, lambda s: s["c"]).alias("scales"),
        F.transform(ordered, lambda s: s["kernel"]).alias("kernels"),
    )


def model_grid(kernels: DataFrame, traits: DataFrame, blocks: int = 1) -> DataFrame:
    """Work items: a set's kernels with a block of traits.

    Kernels are loaded once per block, so few blocks suit many sets and many
    blocks suit few sets.
    """
    blocked = (
        traits.withColumn("block", F.pmod(F.xxhash64("trait"), F.lit(blocks)).cast("int"))
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("trait", "y"))).alias("traits"))
    )
    items = kernels.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return items.join(blocked, "block").repartition("set_id", "block")


FIT_SCHEMA = (
    "set_id string, trait string, cv int, fold int, n_kernels int, n_train int, loglik double, h2 double, h2_sd double, "
    "shares array<double>, share_sds array<double>, variances array<double>, scales array<double>, theta array<double>, "
    "py array<double>, pred_i array<int>, pred array<double>, converged boolean, iterations int, status string"
)

FIT_COLUMNS = [c.split()[0] for c in FIT_SCHEMA.split(", ")]


def _fit_rows(set_id, traits, w, kernels, scales, splits, iterations, cv_iterations, constrain):
    """All fits of a work item. Traits called in the same samples share the decomposition of a split, and the folds of one
    kernel that of all samples, where that is less work (`_cheaper`); the fits are the same."""
    covered = ~np.isnan(w).any(axis=1)
    used = [i for i, c in enumerate(scales) if c > 0]  # a part without SNPs has scale 0 and no variance
    kernels, n_kernels = [kernels[i] for i in used], len(kernels)
    called = {trait: ~np.isnan(y) & covered for trait, y in traits}
    wholes: dict[bytes, FoldBasis] = {}
    for cv, fold, test in splits:
        steps = iterations if cv is None else cv_iterations
        bases: dict[bytes, Basis] = {}
        ready: dict[str, Fit] = {}
        if len(kernels) == 1 and constrain and cv is not None:
            together: dict[bytes, list] = {}
            for trait, y in traits:
                train = called[trait] & ~test
                if train.sum() > w.shape[1] + 2 and np.var(y[train]) > 0:
                    together.setdefault(called[trait].tobytes(), []).append((trait, y))
            for mask, rows in together.items():
                have = np.frombuffer(mask, bool)
                if not _cheaper(int(have.sum()), int((have & test).sum()), len(rows)):
                    continue
                try:
                    if mask not in wholes:
                        wholes[mask] = FoldBasis(w[have], kernels[0][np.ix_(have, have)])
                    ready |= zip([t for t, _ in rows], wholes[mask].fit([y[have] for _, y in rows], test[have], steps))
                except np.linalg.LinAlgError:  # these folds are fitted one by one below
                    continue
        for trait, y in traits:
            train = called[trait] & ~test
            row = dict.fromkeys(FIT_COLUMNS)
            row.update(set_id=set_id, trait=trait, cv=cv, fold=fold, n_kernels=n_kernels, n_train=int(train.sum()),
                       scales=list(scales), converged=False, iterations=0)
            try:
                if not kernels:
                    raise ValueError("no kernel with SNPs")
                if train.sum() <= w.shape[1] + 2 or np.var(y[train]) == 0:
                    raise ValueError("too few samples or constant values")
                fit = ready.get(trait)
                if fit is None:
                    basis = bases.get(train.tobytes())
                    if basis is None:
                        ix = np.ix_(train, train)
                        bases = {train.tobytes(): (basis := Basis(w[train], [k[ix] for k in kernels]))}
                    fit = (fit_one if len(kernels) == 1 else fit_many)(y[train], basis, constrain, steps)
                _fill(row, fit, w, kernels, used, train, test & covered)
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as error:  # one failed fit must not end the grid
                row["status"] = f"error: {error}"
            yield row


def _cheaper(n: int, left_out: int, traits: int) -> bool:
    """Whether the products of the left-out rows, for about ten values of h a trait besides the grid, cost less than a
    decomposition of the training kernel (about 11 n^3)."""
    return (41 + 10 * traits) * 2 * left_out**2 * n < 11 * (n - left_out) ** 3


def _fill(row, fit: Fit, w, kernels, used, train, targets) -> None:
    """What a row says of its fit: variances and their ratios, weights, and predictions of the `targets`."""
    s, n_kernels = fit.variances, row["n_kernels"]
    genetic = np.append(np.ones(len(kernels)), 0.0)
    unit = np.eye(len(kernels) + 1)
    total_g = genetic @ s
    py = np.zeros(len(w))
    py[train] = fit.py
    value = w[targets] @ fit.theta + sum(x * (k[targets] @ py) for x, k in zip(s, kernels))
    variances, shares, sds = np.zeros(n_kernels + 1), [0.0] * n_kernels, [-1.0] * n_kernels
    variances[[*used, n_kernels]] = s
    for at, i in enumerate(used):
        shares[i] = float(s[at] / total_g) if total_g > 0 else None
        sds[i] = ratio_sd(fit, unit[at], genetic)
    row.update(
        loglik=fit.loglik, h2=total_g / s.sum(), h2_sd=ratio_sd(fit, genetic, np.ones(len(s))),
        shares=shares, share_sds=sds, variances=variances.tolist(), theta=fit.theta.tolist(), py=py.tolist(),
        pred_i=np.flatnonzero(targets).tolist(), pred=value.tolist(),
        converged=bool(fit.converged), iterations=int(fit.iterations),
        status="ok" if fit.converged else "not converged",
    )


def fit_variance(grid: DataFrame, covar: DataFrame | None = None, folds: DataFrame | None = None, full: bool = True,
                 iterations: int = 500, cv_iterations: int = 100, constrain: bool = True, by_repeat: bool = False) -> DataFrame:
    """Fit every work item on all samples (`full`) and on the training part of every fold.

    `by_repeat` makes a task of every repeat of a work item: for few sets with many folds, so that traits stay together
    and share decompositions.

    One row per fit, also for a failed one (`status`). `py` is V^-1 of the
    residual, zero outside the training samples; `pred` the total prediction
    of the test samples. An SD of -1 marks a fit without usable information.
    """
    items = grid.withColumn("w", covar.scalar() if covar is not None else F.lit(None).cast("array<array<double>>"))
    items = items.withColumn(
        "folds", folds.scalar() if folds is not None else F.lit(None).cast("array<struct<cv:int,fold:array<int>>>")
    )

    items = items.withColumn("full", F.lit(full))
    if by_repeat:
        items = items.select("*", F.posexplode_outer("folds").alias("_at", "_rep")).withColumns({
            "folds": F.when(F.col("_rep").isNotNull(), F.array("_rep")), "full": F.col("full") & (F.coalesce("_at", F.lit(0)) == 0)})
        items = items.repartition(8 * int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")), "set_id", "block", "_at")

    def run(batches):
        for pdf in batches:
            for item in pdf.itertuples(index=False):
                n = int(item.n)
                kernels = [unpack(k, n) for k in item.kernels]
                w = np.ones((n, 1))
                if item.w is not None:
                    w = np.column_stack([w] + [np.array(c, float) for c in item.w])
                splits = [(None, None, np.zeros(n, bool))] if item.full else []
                for rep in (item.folds if item.folds is not None else []):
                    assigned = np.array([-1 if f is None else f for f in rep["fold"]], float)
                    assigned = np.where(np.isnan(assigned), -1, assigned).astype(int)
                    splits += [(int(rep["cv"]), int(f), assigned == f) for f in np.unique(assigned[assigned > 0])]
                traits = [(t["trait"], np.array([np.nan if v is None else v for v in t["y"]], float)) for t in item.traits]
                rows = list(_fit_rows(item.set_id, traits, w, kernels, np.array(item.scales, float),
                                      splits, iterations, cv_iterations, constrain))
                yield pd.DataFrame(rows, columns=FIT_COLUMNS).astype(
                    {"cv": "Int32", "fold": "Int32"}
                )

    return items.select("set_id", "n", "scales", "kernels", "traits", "w", "folds", "full").mapInPandas(run, FIT_SCHEMA)


def component_table(fits: DataFrame) -> DataFrame:
    """Heritability and share rows: (set_id, trait, cv, fold, component, value, sd)."""
    her = F.array(F.struct(F.lit("Her_ALL").alias("component"), F.col("h2").alias("value"), F.col("h2_sd").alias("sd")))
    shares = F.transform(
        F.arrays_zip("shares", "share_sds"),
        lambda s, k: F.struct(F.concat(F.lit("Share_K"), (k + 1).cast("string")).alias("component"),
                              s["shares"].alias("value"), s["share_sds"].alias("sd")),
    )
    rows = F.concat(her, F.coalesce(shares, F.array().cast("array<struct<component:string,value:double,sd:double>>")))
    return fits.select("set_id", "trait", "cv", "fold", F.inline(rows))


def prediction_table(fits: DataFrame, panel: DataFrame) -> DataFrame:
    """Total prediction of the test samples: (set_id, trait, cv, fold, iid, total)."""
    return fits.where(F.col("cv").isNotNull() & F.col("pred_i").isNotNull()).select(
        "set_id", "trait", "cv", "fold", F.explode(F.arrays_zip("pred_i", "pred")).alias("_p")
    ).select("set_id", "trait", "cv", "fold", F.element_at(panel.scalar(), F.col("_p.pred_i") + 1).alias("iid"),
             F.col("_p.pred").alias("total"))


def snp_effects(geno: DataFrame, alphas: DataFrame) -> DataFrame:
    """u_j = z_j . alpha for every fit and part: (fit_id, partition, snp_id, effect)."""
    weights = ef.weight_blocks(alphas.select("fit_id", "partition", "alpha"))
    return ef.effect_rows(ef.genotype_blocks(geno), weights).select("fit_id", "partition", "snp_id", "effect")


def keep_partition(effects: DataFrame, fits: DataFrame, members: DataFrame) -> DataFrame:
    """Of a two-kernel model keep partition 1 for the SNPs of its set and partition 2 for the others."""
    keyed = effects.join(fits.select("fit_id", "set_id").distinct(), "fit_id")
    inside = members.select("set_id", "snp_id").distinct().withColumn("_in", F.lit(1))
    return keyed.join(inside, ["set_id", "snp_id"], "left").where(
        F.col("partition") == F.when(F.col("_in").isNotNull(), 1).otherwise(2)
    ).drop("_in")


def score(geno: DataFrame, effects: DataFrame, panel: DataFrame, width: int = 256) -> DataFrame:
    """Sum over SNPs of centred dosage x effect: (fit_id, iid, score).

    For effects that are given; scores of fits need no table of effects (`effects.fold_scores`). Fits are dealt to
    blocks of about `width`, effects are gathered per SNP and block, and a task adds its SNPs to one score vector
    per fit of the block before anything is shuffled.
    """
    blocks = 1 + effects.select("fit_id").distinct().count() // width
    effects = effects.withColumn("_fits", F.pmod(F.xxhash64("fit_id"), F.lit(blocks)))
    per_snp = effects.groupBy("_fits", "snp_id").agg(F.collect_list(F.struct("fit_id", "effect")).alias("e"))
    rows = geno.select("snp_id", "dosages").join(per_snp, "snp_id").select("_fits", "dosages", "e")
    if blocks > 1:
        rows = rows.sortWithinPartitions("_fits")

    def partial(batches):
        acc: dict[str, np.ndarray] = {}
        for batch in by_block(batches):
            if not batch.num_rows:
                yield from told(acc)
                acc = {}
                continue
            z = centred(batch["dosages"], len(batch["dosages"][0]))
            col = batch["e"]
            flat = col.flatten()
            owner = np.repeat(np.arange(batch.num_rows), col.value_lengths().to_numpy(zero_copy_only=False))
            codes = flat.field("fit_id").dictionary_encode()
            index, values = codes.indices.to_numpy(), flat.field("effect").to_numpy(zero_copy_only=False)
            u = np.zeros((batch.num_rows, len(codes.dictionary)))
            np.add.at(u, (owner, index), values)
            for f, column in zip(codes.dictionary.to_pylist(), (z.T @ u).T):
                acc[f] = acc[f] + column if f in acc else column
        yield from told(acc)

    def by_block(batches):
        """The batches, cut where the next block of fits begins; an empty one stands between two blocks."""
        held = None
        for batch in batches:
            numbers = batch["_fits"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):
                if held not in (None, numbers[lo]):
                    yield batch.slice(0, 0)
                held = numbers[lo]
                yield batch.slice(lo, hi - lo)

    def told(acc):
        for f, v in acc.items():
            yield pa.RecordBatch.from_pydict({
                "fit_id": pa.array([f] * len(v), pa.string()), "i": pa.array(np.arange(len(v)), pa.int32()),
                "v": pa.array(v, pa.float64()),
            })

    sums = rows.mapInArrow(partial, "fit_id string, i int, v double").groupBy("fit_id", "i").agg(F.sum("v").alias("score"))
    return sums.select("fit_id", F.element_at(panel.scalar(), F.col("i") + 1).alias("iid"), "score")


def fit_he_packed(kernels: DataFrame, traits: DataFrame) -> DataFrame:
    """`fit_he` on packed kernels (set_id, n, scales, kernels) and phenotype arrays (trait, y), without pair rows: a task forms
    the sums of its kernels, a line of the triangle at a time and all traits together."""
    schema = pa.schema([("set_id", pa.string()), ("trait", pa.string()), *[(c, pa.float64()) for c in HE_SUMS]])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch["n"][row].as_py()
                given = batch["ys"][row].as_py()
                called, y = _centred_traits(given)
                k = [v.values.to_numpy(zero_copy_only=False) for v in batch["kernels"][row].values]
                k = k if len(k) == 2 else [k[0], np.zeros_like(k[0])]
                sums, lo = np.zeros((9, len(y))), 0
                for i in range(n):
                    a, b = k[0][lo + 1 : lo + n - i], k[1][lo + 1 : lo + n - i]
                    lo += n - i
                    both, yy = called[:, i, None] & called[:, i + 1 :], y[:, i, None] * y[:, i + 1 :]
                    sums += [both.sum(axis=1), both @ a, both @ b, yy.sum(axis=1), both @ (a * a), both @ (b * b), both @ (a * b), yy @ a, yy @ b]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch["set_id"][row], len(y)), pa.array([t["trait"] for t in given], pa.string()), *map(pa.array, sums)], schema=schema)

    rows = kernels.select("set_id", "n", "scales", "kernels").withColumn("ys", _trait_list(traits).scalar())
    return _he_estimates(rows.mapInArrow(run, HE_SCHEMA))


HE_SUMS = ["n_pairs", "s1", "s2", "sy", "s11", "s22", "s12", "s1y", "s2y"]
HE_SCHEMA = ", ".join(["set_id string", "trait string", *[f"{c} double" for c in HE_SUMS]])


def _trait_list(traits: DataFrame) -> DataFrame:
    return traits.agg(F.sort_array(F.collect_list(F.struct("trait", "y"))).alias("ys"))


def _centred_traits(given: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(called, centred value with 0 for none) of every trait and sample."""
    y = np.array([[np.nan if v is None else v for v in t["y"]] for t in given], float)
    called = ~np.isnan(y)
    return called, np.where(called, y - np.nanmean(np.where(called.any(axis=1)[:, None], y, 0.0), axis=1, keepdims=True), 0.0)


def fit_he_pieces(pieces: DataFrame, traits: DataFrame) -> DataFrame:
    """`fit_he_packed` on the pieces of `kinship.kernel_pieces`: a task forms the sums of one piece of a set's kernels, and
    the sums of the pieces are added."""
    schema = pa.schema([("set_id", pa.string()), ("trait", pa.string()), *[(c, pa.float64()) for c in HE_SUMS]])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                n, low, high, scales = (batch[c][row].as_py() for c in ("n", "low", "high", "scales"))
                given = batch["ys"][row].as_py()
                called, y = _centred_traits(given)
                off = np.ones(len(batch["a1"][row].as_buffer()) // 8, bool)
                off[piece_diagonal(n, low, high)] = False
                i, j = (v[off] for v in piece_places(n, low, high))
                a, b = (np.frombuffer(batch[c][row].as_buffer())[off] for c in ("a1", "a2"))
                a, b = (v / c if c > 0 else np.zeros_like(v) for v, c in zip((a, b), scales))
                sums = []
                for own, value in zip(called, y):
                    both, yy = own[i] & own[j], value[i] * value[j]
                    p, q = np.where(both, a, 0.0), np.where(both, b, 0.0)
                    sums.append([both.sum(), p.sum(), q.sum(), yy.sum(), p @ a, q @ b, p @ b, yy @ a, yy @ b])
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch["set_id"][row], len(y)), pa.array([t["trait"] for t in given], pa.string()), *(pa.array(c, pa.float64()) for c in zip(*sums))], schema=schema)

    rows = pieces.select("set_id", "n", "low", "high", "scales", "a1", "a2").withColumn("ys", _trait_list(traits).scalar())
    return _he_estimates(rows.mapInArrow(run, HE_SCHEMA).groupBy("set_id", "trait").agg(*[F.sum(c).alias(c) for c in HE_SUMS]))


def _he_estimates(sums: DataFrame) -> DataFrame:
    m = sums.where("n_pairs > 0")

    def cov(xy, x, y):
        return F.col(xy) / F.col("n_pairs") - F.col(x) * F.col(y) / F.col("n_pairs") ** 2

    c11, c22, c12, c1y, c2y = cov("s11", "s1", "s1"), cov("s22", "s2", "s2"), cov("s12", "s1", "s2"), cov("s1y", "s1", "sy"), cov("s2y", "s2", "sy")
    det = F.nullif(c11 * c22 - c12 * c12, F.lit(0.0))
    return m.select("set_id", "trait", F.col("n_pairs").cast("long").alias("n_pairs"), (c1y / F.nullif(c11, F.lit(0.0))).alias("var_single"),
                    ((c1y * c22 - c2y * c12) / det).alias("var_in"), ((c2y * c11 - c1y * c12) / det).alias("var_out"))


def fit_he(pairs: DataFrame, pheno: DataFrame, value: str = "value", by=("set_id",)) -> DataFrame:
    """Moment estimate for panels too large for a dense fit: y_i y_j on K_ij over pairs i < j.

    `pairs`: (*by, partition, i, j, k) with sample ids; `pheno`: (iid, trait, value),
    centred here. One kernel: the slope; two kernels: a closed-form 2 x 2 solve.
    """
    by = list(by)
    means = pheno.groupBy("trait").agg(F.avg(value).alias("_mean"))
    y = join_sized(pheno, means, ["trait"]).select("iid", F.struct("trait", (F.col(value) - F.col("_mean")).alias("y")).alias("_e"))
    # one row per sample: a pair meets each of its samples once, and is spread over traits after the joins
    ys = staged(y.groupBy("iid").agg(F.map_from_entries(F.collect_list("_e")).alias("ys")), "centred")
    off = pairs.where(F.col("i") < F.col("j"))
    wide = off.groupBy(*by, "i", "j").agg(
        F.max(F.when(F.col("partition") == 1, F.col("k"))).alias("k1"),
        F.max(F.when(F.col("partition") == 2, F.col("k"))).alias("k2"),
    )
    both = wide.join(ys.select(F.col("iid").alias("i"), F.col("ys").alias("_yi")), "i").join(
        ys.select(F.col("iid").alias("j"), F.col("ys").alias("_yj")), "j"
    )
    prod = both.select(*by, "k1", "k2", "_yj", F.explode("_yi").alias("trait", "_y")).select(
        *by, "k1", "k2", "trait", (F.col("_y") * F.try_element_at("_yj", F.col("trait"))).alias("yy")
    ).where(F.col("yy").isNotNull())
    m = prod.groupBy(*by, "trait").agg(
        F.count("yy").alias("n_pairs"), F.regr_slope("yy", "k1").alias("slope1"),
        F.covar_pop("k1", "k1").alias("c11"), F.covar_pop("k2", "k2").alias("c22"), F.covar_pop("k1", "k2").alias("c12"),
        F.covar_pop("k1", "yy").alias("c1y"), F.covar_pop("k2", "yy").alias("c2y"),
    )
    det = F.nullif(F.col("c11") * F.col("c22") - F.col("c12") * F.col("c12"), F.lit(0.0))
    return m.select(
        *by, "trait", "n_pairs", F.col("slope1").alias("var_single"),
        ((F.col("c1y") * F.col("c22") - F.col("c2y") * F.col("c12")) / det).alias("var_in"),
        ((F.col("c2y") * F.col("c11") - F.col("c1y") * F.col("c12")) / det).alias("var_out"),
    )
