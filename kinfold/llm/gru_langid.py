"""Language of documents by a bidirectional gated recurrent network over bytes.

Training, on the driver, in numpy, by backpropagation through time: windows of `WINDOW` bytes from a bounded sample
of labelled documents, `SAMPLE` of them in all, shared equally by the languages (`sample`, a parameter) and drawn
by a hash of the text. Documents whose crc32(doc_id as text) modulo `modulus` is `held` are never learned from.

Prediction, in the tasks: a document's bytes are cut in windows, two recurrent passes (forwards and backwards) run
over each, every byte gets probabilities of all languages, and their mean over the document decides. Whole texts
are read; windows of all documents of a batch go through the network together. Only the text enters; the labels,
the source and the id do not.

Defined cases: a text that is null or has no letter is `und` with score 0, also if no language was learned; ties go
to the language that comes first by code point; equal texts get equal answers; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm import chunks as ch

MODULUS, HELD = 4, 2
UNDETERMINED = "und"
WINDOW = 64
WIDTH = 8
SAMPLE = 4000
PER_DOCUMENT = 3
BATCH = 256
STEPS = 240
RATE = 0.02
PAD = 0x20
WINDOWS_AT_ONCE = 2048
LEAST_SCORE = 0.4
PIECE_BYTES = 2 << 20

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by window, padded with spaces; true bytes of each window; first window of each text). Every text has one at least."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(1, -(-sizes // WINDOW))
    firsts = np.cumsum(counts) - counts
    flat = np.full(int(counts.sum()) * WINDOW, PAD, np.uint8)
    for text, first in zip(texts, firsts.tolist()):
        flat[first * WINDOW : first * WINDOW + len(text)] = np.frombuffer(text, np.uint8)
    filled = np.full(len(flat) // WINDOW, WINDOW, np.int64)
    filled[firsts + counts - 1] = sizes - (counts - 1) * WINDOW
    return flat.reshape(-1, WINDOW), filled, firsts


def _squash(x: np.ndarray, room: np.ndarray) -> None:
    """x becomes x / (1 + |x|), which takes a tenth of the time of tanh."""
    np.abs(x, out=room)
    room += 1
    x /= room


def _gate_slope(gate: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


class Network:
    """Two gated recurrent layers, one for each direction, and a softmax over their joined states.

    A direction has, for input byte x and state h and with s(x) = x / (1 + |x|): gates r, z = (1 + s(W_x + U h)) / 2,
    c = s(W_x + r * (U h + b)), next h = (1 - z) * c + z * h. Arrays hold units by windows.
    """

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.3, (3 * WIDTH, 256)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(WIDTH), (3 * WIDTH, WIDTH)).astype(np.float32)
            self.p["c" + d] = np.zeros((WIDTH, 1), np.float32)
        self.p["o"] = rng.normal(0, 0.3, (len(languages), 2 * WIDTH)).astype(np.float32)
        self.p["a"] = np.zeros((len(languages), 1), np.float32)

    def states(self, data: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """State after each byte, (window length, units, windows); `keep` gets what a backward pass needs."""
        w, u, c = self.p["w" + d], self.p["u" + d], self.p["c" + d]
        n, columns = len(data), np.ascontiguousarray(data.T).astype(np.intp)
        out = np.empty((WINDOW, WIDTH, n), np.float32)
        given, own, room = (np.empty((3 * WIDTH, n), np.float32) for _ in range(3))
        h = np.zeros((WIDTH, n), np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            w.take(columns[t], axis=1, out=given, mode="clip")
            np.matmul(u, h, out=own)
            gates, new, inner = given[: 2 * WIDTH], given[2 * WIDTH :], own[2 * WIDTH :]
            gates += own[: 2 * WIDTH]
            _squash(gates, room[: 2 * WIDTH])
            gates *= 0.5
            gates += 0.5
            r, z = gates[:WIDTH], gates[WIDTH:]
            inner += c
            np.multiply(r, inner, out=room[:WIDTH])
            new += room[:WIDTH]
            _squash(new, room[:WIDTH])
            if keep is not None:
                keep.append((t, h, r.copy(), z.copy(), inner.copy(), new.copy()))
            np.subtract(h, new, out=out[t])
            out[t] *= z
            out[t] += new
            h = out[t]
        return out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(windows, window length, languages)"""
        f, b = self.states(data, "f"), self.states(data, "b")
        return self._softmax(f, b).transpose(2, 0, 1)

    def _softmax(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        score = self.p["o"][:, :WIDTH] @ f
        score += self.p["o"][:, WIDTH:] @ b
        score += self.p["a"]
        score -= score.max(axis=1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=1, keepdims=True)
        return score

    def gradients(self, data: np.ndarray, filled: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self.states(data, d, kept[d]) for d in "fb"}
        prob = self._softmax(states["f"], states["b"])
        real = (np.arange(WINDOW)[:, None] < filled).astype(np.float32)
        share = real / max(real.sum(), 1)
        n = np.arange(len(data))
        loss = float(-(np.log(prob[:, labels, n] + 1e-9) * share).sum())
        prob[:, labels, n] -= 1
        prob *= share[:, None, :]
        g = {"o": np.concatenate([np.einsum("tln,thn->lh", prob, states[d], optimize=True) for d in "fb"], axis=1), "a": prob.sum(axis=(0, 2))[:, None]}
        for i, d in enumerate("fb"):
            above = self.p["o"][:, i * WIDTH : (i + 1) * WIDTH].T @ prob
            u = self.p["u" + d]
            gw, gu, gc = np.zeros_like(self.p["w" + d]), np.zeros_like(u), np.zeros_like(self.p["c" + d])
            gh = np.zeros((WIDTH, len(data)), np.float32)
            for t, h, r, z, inner, new in reversed(kept[d]):
                gh = gh + above[t]
                gnew = gh * (1 - z) * (1 - np.abs(new)) ** 2
                gz = gh * (h - new) * _gate_slope(z)
                gr = gnew * inner * _gate_slope(r)
                gown = np.concatenate([gr, gz, gnew * r])
                gu += gown @ h.T
                gc += (gnew * r).sum(axis=1, keepdims=True)
                ggiven = np.concatenate([gr, gz, gnew])
                np.add.at(gw.T, data[:, t], ggiven.T)
                gh = gh * z + u.T @ gown
            g |= {"w" + d: gw, "u" + d: gu, "c" + d: gc}
        return g, loss


def train(examples: list[tuple[str, bytes]], steps: int = STEPS, rate: float = RATE, seed: int = 5) -> Network:
    """A network from (language, window) pairs."""
    languages = sorted({lang for lang, _ in examples})
    net = Network(languages, seed)
    data, filled, _ = windows([w for _, w in examples])
    labels = np.array([languages.index(lang) for lang, _ in examples])
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(labels), min(BATCH, len(labels)))
        g, _ = net.gradients(data[pick], filled[pick], labels[pick])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        pace = rate * (1 - 0.9 * step / steps) * min(1.0, 5 / max(norm, 1e-9))
        for k, x in g.items():
            first[k] = 0.9 * first[k] + 0.1 * x
            second[k] = 0.99 * second[k] + 0.01 * x * x
            net.p[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def training_windows(docs: DataFrame, sample: int, modulus: int, held: int) -> list[tuple[str, bytes]]:
    """At most about `sample` documents, as many of each language, and PER_DOCUMENT windows of each."""
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~ch.train_mark(F.col("doc_id").cast("long"), modulus, held)).select("lang", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return []
    each = max(1, sample // len(counts))
    spread = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 20))
    rate = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))) for lang, n in counts.items()], F.lit(0.0))
    picked = labelled.withColumn("spread", spread).where(F.col("spread") < rate * (1 << 20)).orderBy("spread", "lang", "text").limit(2 * sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text, spread in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "spread"))):
                data = text.encode("utf-8", "surrogatepass")
                last = max(1, len(data) - WINDOW + 1)
                rows += [(lang, data[s : s + WINDOW]) for s in {(spread + i * 7919 * WINDOW) % last for i in range(PER_DOCUMENT)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "piece"])

    return sorted((r["lang"], bytes(r["piece"])) for r in picked.mapInArrow(cut, "lang string, piece binary").collect())


def fitted(docs: DataFrame, sample: int = SAMPLE, modulus: int = MODULUS, held: int = HELD) -> Network | None:
    examples = training_windows(docs, sample, modulus, held)
    return train(examples) if examples else None


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its mean probability over the bytes of each text."""
    has_letter = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    if net is None or not len(texts):
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    data, filled, firsts = windows([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    sums = np.empty((len(data), len(net.languages)))
    for start in range(0, len(data), WINDOWS_AT_ONCE):
        part = slice(start, start + WINDOWS_AT_ONCE)
        f, b = net.states(data[part], "f"), net.states(data[part], "b")
        real = (np.arange(WINDOW)[:, None] < filled[part]).astype(np.float32)
        sums[part] = np.einsum("tln,tn->nl", net._softmax(f, b), real, optimize=True)
    sizes = np.maximum(np.add.reduceat(filled, firsts), 1)
    mean = np.add.reduceat(sums, firsts, axis=0) / sizes[:, None]
    best = mean.argmax(axis=1)
    langs = [net.languages[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), has_letter)]
    return langs, np.where(has_letter, mean[np.arange(len(best)), best].clip(0, 1), 0.0).tolist()


def with_language(docs: DataFrame, net: Network | None, held_modulus: int = MODULUS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = ch.shipped(docs.sparkSession, net)
    columns = ch.id_and_text(docs, {"held_out": ch.train_mark("doc_id", held_modulus, held)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared()
        for _, batch in ch.in_chunks(batches, PIECE_BYTES):
            langs, scores = predict(net, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=ARROW)

    return columns.mapInArrow(run, SCHEMA)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return with_language(docs, fitted(docs, sample))


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language is determined with at least the score `least`; their columns stay as they are."""
    shared = ch.shipped(docs.sparkSession, fitted(docs, sample))
    rows, schema = ch.every_column(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared()
        for _, batch in ch.in_chunks(batches, PIECE_BYTES):
            langs, scores = predict(net, batch.column("text").to_pylist())
            keep = [lang != UNDETERMINED and score >= least for lang, score in zip(langs, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ch.renamed_back(rows.mapInArrow(run, schema), docs)
