"""Restricted likelihood for panels whose kernels fit in no task: no samples x samples value is ever built.

A kernel acts on vectors as K x = Z'(Z x) / c, one pass over the SNPs for all vectors at hand: those of every trait, set, fold and
probe. SNPs are a written table of blocks (one row: some SNPs' dosages as bytes, and which sets they are in); a task adds up
its blocks' products, which are summed by slices of samples.

- One kernel. V = h K + (1 - h) I has the Krylov spaces of K for every h, so one Lanczos run of K from the data and the
  probes serves the whole search: quadratic forms and log|V| are sums over Ritz values (stochastic Lanczos quadrature).
- Several kernels. Average-information steps. V x = b is solved by conjugate gradients for the data and the probes
  together; their coefficients are the Lanczos matrices that give log|V|; the traces tr(V^-1 K) come from the same probes.

Probes are fixed (seeded) random signs, projected as the data are, so likelihoods differ between steps and models by less
than their own error: `loglik_se` states the error of one fit's likelihood, and the ratio of two fits on the same samples shares
most of it. With at least as many probes as dimensions an orthonormal basis is taken and nothing is random.

The driver holds the vectors: samples x columns of one group of fits, COLUMN_BYTES at most (fits are worked off in groups), and ships
them to the tasks once a pass. It never holds genotypes or kernels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.operators.reml import Fit, _grid, _inverse, _search, ratio_sd
from kinfold.session import staged

BLOCK = 256
SLICE = 4096
PROBES = 32
COLUMN_BYTES = 128 << 20
KRYLOV = 200
TOLERANCE = 1e-6  # of a residual to its right-hand side; traces and quadratic forms err by less


@dataclass
class Blocks:
    """SNP blocks and the scales of the kernels that can be made of them."""

    table: DataFrame
    n: int
    sets: list[str]
    total: float = 0.0
    inside: dict[str, float] = field(default_factory=dict)
    passes: int = 0

    def scale(self, kernel: tuple[str, str | None]) -> float:
        kind, set_id = kernel
        c = {"all": self.total, "in": self.inside.get(set_id, 0.0), "out": self.total - self.inside.get(set_id, 0.0)}[kind]
        return c if c > 1e-9 * self.total else 0.0


def _dosages(x: bytes, rows: int) -> np.ndarray:
    """SNP rows x samples, centred, missing 0."""
    raw = np.frombuffer(x, np.int8).reshape(rows, -1)
    called = raw >= 0
    z = np.where(called, raw, 0).astype(float)
    mean = z.sum(axis=1) / np.maximum(called.sum(axis=1), 1)
    return np.where(called, z - mean[:, None], 0.0)


def snp_blocks(geno: DataFrame, sets: DataFrame | None = None, block: int = BLOCK) -> Blocks:
    """Pack `geno` (snp_id, dosages) once; `sets` (set_id, snp_id) names the in-set kernels that fits may ask for."""
    spark = geno.sparkSession
    rows = geno.select("snp_id", "dosages")
    ids: list[str] = []
    if sets is not None:
        members = staged(sets.select(F.col("set_id").cast("string").alias("set_id"), "snp_id").distinct(), "members")
        ids = sorted(r["set_id"] for r in members.select("set_id").distinct().collect())
        numbers = spark.createDataFrame([(s, i) for i, s in enumerate(ids)], "set_id string, number int")
        lists = members.join(numbers, "set_id").groupBy("snp_id").agg(F.collect_set("number").alias("numbers"))
        rows = rows.join(lists, "snp_id", "left")
    else:
        rows = rows.withColumn("numbers", F.lit(None).cast("array<int>"))
    schema = pa.schema([("rows", pa.int32()), ("x", pa.binary()), ("at", pa.list_(pa.int32())), ("number", pa.list_(pa.int32()))])

    def pack(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                piece = batch.slice(lo, block)
                m = piece.num_rows
                flat = piece["dosages"].flatten().cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)
                pairs = [(i, s) for i, numbers in enumerate(piece["numbers"].to_pylist()) for s in numbers or ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m], pa.int32()), pa.array([np.ascontiguousarray(flat).tobytes()], pa.binary()), pa.array([[i for i, _ in pairs]], pa.list_(pa.int32())),
                     pa.array([[s for _, s in pairs]], pa.list_(pa.int32()))], schema=schema)

    table = staged(rows.select("dosages", "numbers").mapInArrow(pack, "rows int, x binary, at array<int>, number array<int>"), "snp-blocks")

    def traces(batches):
        total, parts, n = 0.0, np.zeros(len(ids)), 0
        for batch in batches:
            for m, x, at, number in zip(*(batch[c].to_pylist() for c in ("rows", "x", "at", "number"))):
                z = _dosages(x, m)
                square, n = (z * z).sum(axis=1), z.shape[1]
                total += square.sum()
                np.add.at(parts, number, square[at])
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), "set": pa.array([-1], pa.int32()), "v": pa.array([total], pa.float64())})
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] * len(ids), pa.int32()), "set": pa.array(range(len(ids)), pa.int32()), "v": pa.array(parts, pa.float64())})

    sums = table.mapInArrow(traces, "n int, set int, v double").groupBy("set").agg(F.max("n").alias("n"), F.sum("v").alias("v")).collect()
    n = max((r["n"] for r in sums), default=0)
    out = Blocks(table, n, ids)
    for r in sums:
        if r["set"] < 0:
            out.total = r["v"] / n
        else:
            out.inside[ids[r["set"]]] = r["v"] / n
    return out


def products(blocks: Blocks, x: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z x over all SNPs, and over those of each column's set (number, -1 for none): samples x columns both."""
    blocks.passes += 1
    spark, (n, width) = blocks.table.sparkSession, x.shape
    columns = {int(s): np.flatnonzero(sets == s) for s in np.unique(sets) if s >= 0}
    shared = spark.sparkContext.broadcast((x, columns))
    schema = pa.schema([("slice", pa.int32()), ("v", pa.binary())])

    def partial(batches):
        x, columns = shared.value
        every, some, seen = np.zeros((n, width)), np.zeros((n, width)) if columns else None, False
        for batch in batches:
            for m, raw, at, number in zip(*(batch[c].to_pylist() for c in ("rows", "x", "at", "number"))):
                z = _dosages(raw, m)
                u = z @ x
                every += z.T @ u
                seen = True
                at, number = np.array(at, np.int64), np.array(number, np.int64)
                for s, cols in columns.items():
                    own = at[number == s]
                    if len(own):
                        some[:, cols] += z[own].T @ u[np.ix_(own, cols)]
        if seen:
            for i, lo in enumerate(range(0, n, SLICE)):
                parts = [every[lo : lo + SLICE]] + ([some[lo : lo + SLICE]] if columns else [])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.concatenate(parts, axis=1).tobytes()], pa.binary())], schema=schema)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch["slice"].to_pylist(), batch["v"].to_pylist()):
                v = np.frombuffer(v)
                sums[i] = sums[i] + v if i in sums else v
        for i, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.tobytes()], pa.binary())], schema=schema)

    parts = blocks.table.mapInArrow(partial, "slice int, v binary").mapInArrow(add, "slice int, v binary")
    out = np.zeros((n, width * (2 if columns else 1)))
    for r in parts.repartition("slice").mapInArrow(add, "slice int, v binary").collect():  # as large as x
        lo = r["slice"] * SLICE
        out[lo : lo + SLICE] = np.frombuffer(r["v"]).reshape(-1, out.shape[1])
    shared.destroy()
    return out[:, :width], out[:, width:] if columns else np.zeros((n, width))


@dataclass
class Problem:
    """One fit: data on the samples in `train`, with what the fixed effects explain projected out."""

    key: tuple
    kernels: list[tuple[str, str | None]]
    y: np.ndarray
    w: np.ndarray
    train: np.ndarray
    probes: int
    seed: int
    fit: Fit = field(default_factory=Fit)
    loglik_se: float = 0.0

    def __post_init__(self):
        self.basis, _ = np.linalg.qr(np.where(self.train[:, None], self.w, 0.0))
        self.logdet_w = float(np.linalg.slogdet(self.w[self.train].T @ self.w[self.train])[1])
        self.m = int(self.train.sum()) - self.w.shape[1]
        self.z = self.projected(np.where(self.train, self.y, 0.0)[:, None])
        if self.probes >= self.m:
            q, _ = np.linalg.qr(np.column_stack([self.basis[self.train], np.eye(int(self.train.sum()))]))
            self.r = np.zeros((len(self.y), self.m))
            self.r[self.train] = q[:, self.w.shape[1] : self.w.shape[1] + self.m]
            self.weights = np.ones(self.m)
        else:
            signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], (len(self.y), self.probes))
            self.r = self.projected(signs)
            self.weights = np.full(self.probes, 1 / self.probes)

    def projected(self, x: np.ndarray) -> np.ndarray:
        x = np.where(self.train[:, None], x, 0.0)
        return x - self.basis @ (self.basis.T @ x)

    def error(self, terms: np.ndarray) -> float:
        """Standard error of a trace that is the weighted sum of the probes' terms."""
        return 0.0 if self.weights[0] == 1.0 else float(np.std(terms, ddof=1) / np.sqrt(len(terms)))


class Group:
    """Problems that share the passes; their columns stand side by side."""

    def __init__(self, blocks: Blocks, problems: list[Problem]):
        self.blocks, self.problems = blocks, problems

    def kernels_of(self, owners: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """For the i-th kernel of each column's problem: its product with the column, projected."""
        sets = np.array([next((self.blocks.sets.index(s) for _, s in self.problems[p].kernels if s is not None), -1) for p in owners])
        every, inside = products(self.blocks, x, sets)
        out = [np.zeros_like(x) for _ in range(max(len(self.problems[p].kernels) for p in owners))]
        for p in np.unique(owners):
            cols, problem = np.flatnonzero(owners == p), self.problems[p]
            for k, kernel in enumerate(problem.kernels):
                raw = {"all": every, "in": inside}.get(kernel[0])
                raw = every[:, cols] - inside[:, cols] if raw is None else raw[:, cols]
                out[k][:, cols] = problem.projected(raw) / self.blocks.scale(kernel)
        return out

    def applied(self, variances: dict[int, np.ndarray], owners: np.ndarray, x: np.ndarray) -> np.ndarray:
        """V x, column by column with the variances of its problem."""
        parts = self.kernels_of(owners, x)
        out = x * np.array([variances[p][-1] for p in owners])
        for k, part in enumerate(parts):
            out += part * np.array([variances[p][k] if k < len(variances[p]) - 1 else 0.0 for p in owners])
        return out

    def solved(self, variances: dict[int, np.ndarray], owners: np.ndarray, b: np.ndarray):
        """(V^-1 b, Lanczos matrices of the columns) by conjugate gradients; finished columns leave the passes."""
        x, r, norms = np.zeros_like(b), b.copy(), np.maximum(np.linalg.norm(b, axis=0), 1e-300)
        d, rs = r.copy(), (r * r).sum(axis=0)
        alphas, betas = [[] for _ in owners], [[] for _ in owners]
        live = np.flatnonzero(np.sqrt(rs) > TOLERANCE * norms)
        for _ in range(KRYLOV):
            if not len(live):
                break
            vd = self.applied(variances, owners[live], d[:, live])
            alpha = rs[live] / (d[:, live] * vd).sum(axis=0)
            x[:, live] += alpha * d[:, live]
            r[:, live] -= alpha * vd
            new = (r[:, live] ** 2).sum(axis=0)
            beta = new / rs[live]
            d[:, live] = r[:, live] + beta * d[:, live]
            rs[live] = new
            for j, a, c in zip(live.tolist(), alpha.tolist(), beta.tolist()):
                alphas[j].append(a)
                betas[j].append(c)
            live = live[np.sqrt(new) > TOLERANCE * norms[live]]
        return x, [_from_coefficients(a, c) for a, c in zip(alphas, betas)]


def _from_coefficients(alphas: list[float], betas: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and squared first components of the Lanczos matrix behind a run of conjugate gradients."""
    if not alphas:
        return np.ones(1), np.zeros(1)
    a, c = np.array(alphas), np.array(betas)
    diagonal = 1 / a
    diagonal[1:] += c[:-1] / a[:-1]
    return _ritz(diagonal, np.sqrt(c[:-1]) / a[:-1])


def _ritz(diagonal: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    return values, vectors[0] ** 2


def fit_one_kernel(blocks: Blocks, problems: list[Problem], iterations: int = 500) -> None:
    """Lanczos of K from the data and the probes of all problems, until the greatest likelihoods stand still."""
    group = Group(blocks, problems)
    owners = np.concatenate([np.full(1 + p.r.shape[1], i) for i, p in enumerate(problems)])
    start = np.concatenate([np.column_stack([p.z, p.r]) for p in problems], axis=1)
    data = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
    norms = np.linalg.norm(start, axis=0)
    q, before = start / np.maximum(norms, 1e-300), np.zeros_like(start)
    beta, done = np.zeros(len(owners)), np.zeros(len(owners), int)  # steps of a column whose space is used up
    diagonals, offs, kept = [], [], []
    best: list[tuple] = [(np.nan, np.nan)] * len(problems)
    for step in range(1, KRYLOV + 1):
        kept.append(q[:, data])
        w = group.kernels_of(owners, q)[0] - beta * before
        alpha = (q * w).sum(axis=0)
        w -= alpha * q
        w -= (q * w).sum(axis=0) * q
        beta = np.linalg.norm(w, axis=0)
        diagonals.append(alpha)
        offs.append(beta)
        spent = (beta < 1e-10) & (done == 0)
        done[spent] = step
        before, q = q, np.where(beta < 1e-10, 0.0, w / np.maximum(beta, 1e-300))
        if step % 8 and not (done > 0).all() and step < KRYLOV:
            continue
        d, o = np.array(diagonals), np.array(offs)
        ritz = [_ritz(d[: s, j], o[: s - 1, j]) for j, s in enumerate(np.where(done > 0, done, step).tolist())]
        new = []
        for i, p in enumerate(problems):
            cols = np.flatnonzero(owners == i)
            new.append(_search_h(p, ritz[cols[0]], [ritz[j] for j in cols[1:]], norms[cols], iterations))
        still = all(abs(a[0] - b[0]) < 1e-7 and abs(a[1] - b[1]) < 1e-7 for a, b in zip(new, best))
        best = new
        if still or (done > 0).all():
            break
    converged = step < KRYLOV or still
    d, o = np.array(diagonals), np.array(offs)
    for i, p in enumerate(problems):
        loglik, h, steps, p.loglik_se = best[i]
        j, size = data[i], done[data[i]] or step
        t = np.diag(d[:size, j]) + np.diag(o[: size - 1, j], 1) + np.diag(o[: size - 1, j], -1)
        small = np.linalg.solve(h * t + (1 - h) * np.eye(size), np.eye(size)[:, 0]) * norms[j]
        theta, weight = _ritz(d[:size, j], o[: size - 1, j])
        v = h * theta + (1 - h)
        scale = norms[j] ** 2 * (weight / v).sum() / p.m
        moments = [norms[j] ** 2 * (weight * theta**e / v**3).sum() / scale**3 for e in (2, 1, 0)]
        info = 0.5 * np.array([[moments[0], moments[1]], [moments[1], moments[2]]])
        p.fit = Fit(loglik, np.array([h * scale, (1 - h) * scale]), _inverse(info), converged, steps)
        p.fit.py = np.stack([k[:, i] for k in kept[:size]], axis=1) @ small / scale


def _search_h(p: Problem, data, probes, norms, iterations) -> tuple[float, float, int, float]:
    theta, weight = data
    size = max(len(t) for t, _ in probes)
    values, shares = np.ones((len(probes), size)), np.zeros((len(probes), size))
    for j, (t, s) in enumerate(probes):
        values[j, : len(t)], shares[j, : len(t)] = t, s * norms[1 + j] ** 2

    def parts(h):
        v = h * theta + (1 - h)
        scale = norms[0] ** 2 * (weight / v).sum() / p.m
        return scale, (shares * np.log(np.maximum(h * values + (1 - h), 1e-300))).sum(axis=1)

    def loglik(h):
        scale, terms = parts(h)
        return -0.5 * (p.m * np.log(2 * np.pi * scale) + p.weights @ terms + p.m + p.logdet_w)

    top = 1 - 1e-6
    h, steps, _ = _search(loglik, np.array([loglik(g) for g in _grid(0.0, top)]), 0.0, top, iterations)
    return float(loglik(h)), h, steps, 0.5 * p.error(parts(h)[1])


def fit_kernels(blocks: Blocks, problems: list[Problem], iterations: int = 100, constrain: bool = True) -> None:
    """Average-information steps of all problems side by side, halved until the likelihood rises."""
    group = Group(blocks, problems)
    variance = [float((p.z**2).sum()) / p.m for p in problems]
    floor = [1e-6 * v for v in variance]
    probe_owners = np.concatenate([np.full(p.r.shape[1], i) for i, p in enumerate(problems)])
    probes = np.concatenate([p.r for p in problems], axis=1)
    moved = group.kernels_of(probe_owners, probes)  # K r, once

    def evaluate(trial: dict[int, np.ndarray]) -> dict[int, tuple]:
        """(likelihood, V^-1 z, traces of V^-1 K and V^-1, error) at the given variances."""
        chosen = sorted(i for i, s in trial.items() if s[-1] > 0)
        if not chosen:
            return {}
        owners = np.concatenate([np.full(1 + problems[i].r.shape[1], i) for i in chosen])
        b = np.concatenate([np.column_stack([problems[i].z, problems[i].r]) for i in chosen], axis=1)
        x, ritz = group.solved(trial, owners, b)
        found = {}
        for i in chosen:
            p, cols = problems[i], np.flatnonzero(owners == i)
            own, a = np.flatnonzero(probe_owners == i), x[:, cols[0]]
            solved = x[:, cols[1:]]
            if any((t <= 0).any() for t, _ in (ritz[j] for j in cols)):
                continue  # not positive definite
            terms = np.array([(b[:, j] ** 2).sum() * (s @ np.log(t)) for j in cols[1:] for t, s in [ritz[j]]])
            traces = [p.weights @ (solved * moved[k][:, own]).sum(axis=0) for k in range(len(p.kernels))] + [p.weights @ (solved * p.r).sum(axis=0)]
            ll = -0.5 * (p.weights @ terms + p.z[:, 0] @ a + p.m * np.log(2 * np.pi) + p.logdet_w)
            found[i] = float(ll), a, np.array(traces), 0.5 * p.error(terms)
        return found

    def informed(state: dict[int, tuple], s: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Gradient and average information."""
        chosen = sorted(state)
        a = np.stack([state[i][1] for i in chosen], axis=1)
        parts = group.kernels_of(np.array(chosen), a)
        cols = {i: np.stack([*(parts[k][:, at] for k in range(len(problems[i].kernels))), a[:, at]], axis=1) for at, i in enumerate(chosen)}
        owners = np.concatenate([np.full(cols[i].shape[1], i) for i in chosen])
        x, _ = group.solved(s, owners, np.concatenate([cols[i] for i in chosen], axis=1))
        return {i: (-0.5 * (state[i][2] - cols[i].T @ state[i][1]), 0.5 * cols[i].T @ x[:, owners == i]) for i in chosen}

    s = {i: np.full(len(p.kernels) + 1, variance[i] / (len(p.kernels) + 1)) for i, p in enumerate(problems)}
    state = evaluate(s)
    info = informed(state, s)
    deltas: dict[int, np.ndarray] = {}
    factor = dict.fromkeys(s, 1.0)
    active, steps = set(state), dict.fromkeys(s, 0)
    while active:
        for i in sorted(active):
            if factor[i] < 1.0:
                continue  # the step is being halved
            gradient, matrix = info[i]
            steps[i] += 1
            free = np.ones(len(s[i]), bool) if not constrain else ~((s[i] <= floor[i] * 1.001) & (gradient < 0))
            if not free.any() or steps[i] > iterations:
                problems[i].fit.converged = not free.any()
                active.discard(i)
                continue
            deltas[i] = np.zeros(len(s[i]))
            try:
                deltas[i][free] = np.linalg.solve(matrix[np.ix_(free, free)], gradient[free])
            except np.linalg.LinAlgError:
                deltas[i] = np.where(free, s[i] * s[i] / problems[i].m * 2 * gradient, 0.0)
        trial = {i: np.maximum(s[i] + factor[i] * deltas[i], floor[i] if constrain else -np.inf) for i in active}
        found = evaluate(trial)
        taken = {}
        for i in sorted(active):
            gain = found[i][0] - state[i][0] if i in found else -np.inf
            if gain < -1e-9:
                factor[i] /= 2
                if factor[i] < 1e-3:  # no better place along this step
                    gradient, free = info[i][0], s[i] > floor[i] * 1.001
                    problems[i].fit.converged = bool(abs(gradient[free] * s[i][free]).max(initial=0) < 1e-3)
                    active.discard(i)
                continue
            state[i], s[i], factor[i], taken[i] = found[i], trial[i], 1.0, found[i]
            if gain < 1e-6:
                problems[i].fit.converged = True
                active.discard(i)
        if taken:
            info |= informed(taken, s)
    for i in state:
        p = problems[i]
        p.fit.loglik, p.fit.py, p.loglik_se = state[i][0], state[i][1], state[i][3]
        p.fit.variances, p.fit.covariance, p.fit.iterations = s[i], _inverse(info[i][1]), steps[i]


def fit_large(blocks: Blocks, problems: list[Problem], iterations: int = 500) -> int:
    """Fit all problems in groups of bounded columns; the passes over the SNPs that it took. Fixed effects come last."""
    before = blocks.passes
    for many in (False, True):
        todo = [p for p in problems if (len(p.kernels) > 1) == many]
        while todo:
            group, columns = [], 0
            while todo and (not group or (columns + 2 * todo[0].r.shape[1]) * blocks.n * 8 <= COLUMN_BYTES):
                columns += 2 * todo[0].r.shape[1] + 4
                group.append(todo.pop(0))
            if many:
                fit_kernels(blocks, group, iterations)
            else:
                fit_one_kernel(blocks, group, iterations)
    return blocks.passes - before


LARGE_SCHEMA = (
    "set_id string, trait string, cv int, fold int, n_kernels int, n_train int, loglik double, loglik_se double, h2 double, h2_sd double, "
    "shares array<double>, share_sds array<double>, variances array<double>, scales array<double>, theta array<double>, "
    "py array<double>, pred_i array<int>, pred array<double>, converged boolean, iterations int, passes int, status string"
)
LARGE_COLUMNS = [c.split()[0] for c in LARGE_SCHEMA.split(", ")]


def _vectors(traits: DataFrame, covar: DataFrame | None, folds: DataFrame | None, n: int):
    """Phenotypes by trait, covariates with the intercept, and the splits as masks of test samples: what the driver holds."""
    ys = {r["trait"]: np.array([np.nan if v is None else v for v in r["y"]], float) for r in traits.select("trait", "y").collect()}
    w = np.ones((n, 1))
    if covar is not None:
        w = np.column_stack([w] + [np.array([np.nan if v is None else v for v in c], float) for c in covar.first()[0]])
    splits = []
    for rep in folds.first()["folds"] if folds is not None else []:
        fold = np.array([-1 if f is None else f for f in rep["fold"]])
        splits += [(int(rep["cv"]), int(f), fold == f) for f in np.unique(fold[fold > 0])]
    return ys, w, splits


def fit_variance_large(geno: DataFrame, traits: DataFrame, covar: DataFrame | None = None, folds: DataFrame | None = None,
                       sets: DataFrame | None = None, full: bool = True, probes: int = PROBES, seed: int = 1, iterations: int = 500) -> DataFrame:
    """`models.fit_variance` without kernels: one row per fit, with the standard error of its likelihood and the passes of all.

    Without `sets` the model has the all-SNP kernel (set_id 'all'), with `sets` (set_id, snp_id) the in-set and the out-of-set
    one. Genotypes are read in one pass a step whatever the number of fits. Rows come from the driver, which holds the
    vectors of samples (module docstring).
    """
    blocks = snp_blocks(geno, sets)
    ys, w, splits = _vectors(traits, covar, folds, blocks.n)
    covered = ~np.isnan(w).any(axis=1)
    filled = np.where(covered[:, None], w, 0.0)
    rows, problems = {}, []
    for set_id in blocks.sets if sets is not None else ["all"]:
        kernels = [("in", set_id), ("out", set_id)] if sets is not None else [("all", None)]
        used = [k for k in kernels if blocks.scale(k) > 0]
        for cv, fold, test in ([(None, None, np.zeros(blocks.n, bool))] if full else []) + splits:
            for trait, y in ys.items():
                train = ~np.isnan(y) & covered & ~test
                row = dict.fromkeys(LARGE_COLUMNS)
                row.update(set_id=set_id, trait=trait, cv=cv, fold=fold, n_kernels=len(kernels), n_train=int(train.sum()),
                           scales=[float(blocks.scale(k)) for k in kernels], converged=False, iterations=0)
                rows[set_id, trait, cv, fold] = row, kernels, used, test & covered
                if not used:
                    row["status"] = "error: no kernel with SNPs"
                elif train.sum() <= w.shape[1] + 2 or np.var(y[train]) == 0:
                    row["status"] = "error: too few samples or constant values"
                else:
                    problems.append(Problem((set_id, trait, cv, fold), used, np.nan_to_num(y), filled, train, probes, seed))
    passes = fit_large(blocks, problems, iterations) if problems else 0
    for lo in range(0, len(problems), 64):
        _told(blocks, problems[lo : lo + 64], rows, passes)
    ordered = [tuple(row[c] for c in LARGE_COLUMNS) for row, *_ in rows.values()]
    return geno.sparkSession.createDataFrame(ordered, LARGE_SCHEMA)


def _told(blocks: Blocks, problems: list[Problem], rows: dict, passes: int) -> None:
    """Ratios, fixed effects and predictions of some fits, by one more pass."""
    sets = np.array([next((blocks.sets.index(s) for _, s in p.kernels if s is not None), -1) for p in problems])
    py = np.stack([np.zeros(blocks.n) if p.fit.py is None else p.fit.py for p in problems], axis=1)
    every, inside = products(blocks, py, sets)
    for j, p in enumerate(problems):
        row, kernels, used, targets = rows[p.key]
        fit, s = p.fit, p.fit.variances
        if fit.py is None:
            row["status"] = "error: not positive definite"
            continue
        raw = {"all": every[:, j], "in": inside[:, j], "out": every[:, j] - inside[:, j]}
        genetic_value = sum(v * raw[kind] / blocks.scale((kind, sid)) for v, (kind, sid) in zip(s, p.kernels))
        fixed = (p.y - genetic_value - s[-1] * fit.py)[p.train]
        theta = np.linalg.lstsq(p.w[p.train], fixed, rcond=None)[0]
        genetic, unit = np.append(np.ones(len(used)), 0.0), np.eye(len(used) + 1)
        total = float(genetic @ s)
        shares, sds, variances = [0.0] * len(kernels), [-1.0] * len(kernels), np.zeros(len(kernels) + 1)
        for at, k in enumerate(used):
            i = kernels.index(k)
            variances[i] = s[at]
            shares[i] = float(s[at] / total) if total > 0 else None
            sds[i] = ratio_sd(fit, unit[at], genetic)
        variances[-1] = s[-1]
        row.update(
            loglik=float(fit.loglik), loglik_se=p.loglik_se, h2=total / float(s.sum()), h2_sd=ratio_sd(fit, genetic, np.ones(len(s))), shares=shares,
            share_sds=sds, variances=variances.tolist(), theta=theta.tolist(), py=fit.py.tolist(), pred_i=np.flatnonzero(targets).tolist(),
            pred=(p.w @ theta + genetic_value)[targets].tolist(), converged=bool(fit.converged), iterations=int(fit.iterations), passes=passes,
            status="ok" if fit.converged else "not converged")
