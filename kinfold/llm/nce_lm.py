"""Scores of texts under a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are a text's words (A-Z lowered, cut at 0x20 and 0x09-0x0D) and one end. Training documents are those
whose crc32(doc_id as text) modulo `modulus` is not `held`.

- Counts of every training token, over the whole corpus: each chunk sends its distinct words with their counts, a
  bucket task adds them up, and each chunk gets the counts of its words back.
- The model predicts one of the `shortlist` most frequent words, "rare" or the end from the token before: a word of
  the shortlist, the ending of a rare word (its last two bytes, in `endings` classes) or the start of the text.
  Pairs (token before, token) are counted over all training documents; their table is bounded by the parameters.
- Log-bilinear: score = (vector before x transform) . vector + bias. Noise-contrastive estimation in numpy on the
  pair counts, with the unigram as noise, in expectation over the noise instead of by draws, so that training is
  the same on every run. Each context gets `PRIOR` tokens of the unigram on top, which holds rare contexts back.
- Batched matrix products give the scores of every pair, normalised by row into log10 probabilities. A rare word
  takes its share of "rare" by its own smoothed count, (c + 1) / (N_rare + V_rare + 1), so that probabilities over
  known words, one unknown word and the end add up to one.

Defined cases: null text is empty (its only token is the end); a null doc_id trains; with no training document
every count is 0 and the model falls back on its smoothing; equal rows get equal scores; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm import chunks as ch
from kinfold.session import staged

MODULUS, HELD = 7, 2
SHORTLIST = 1000
ENDINGS = 64
WIDTH = 16
NOISE = 8
STEPS = 250
RATE = 0.05
PRIOR = 20.0
END = b"\n"

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _words(text: str) -> list[bytes]:
    return ch.letters_lowered(text).split()


def packed_words(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """(chunk, words, places): distinct words with their counts in training documents, and the documents as places in that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in ch.in_chunks(batches, ch.CHUNK_BYTES):
            words, flat, sizes = ch.placed(ch.texts_of(batch), _words)
            out = np.array(batch.column("held_out").to_pylist(), bool)
            counts = np.bincount(flat[np.repeat(~out, sizes)], minlength=len(words))
            packed = ch.dump_words([*words, END], np.append(counts, int((~out).sum())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([packed], pa.binary()), pa.array([ch.dump_places(batch, flat, sizes, out)], pa.binary())],
                ["chunk", "words", "places"])

    rows = ch.id_and_text(docs, {"held_out": ch.train_mark("doc_id", modulus, held)})
    return ch.kept_by_chunk(rows.mapInArrow(run, "chunk long, words binary, places binary"), "lm")


def word_counts(chunks: DataFrame, buckets: int, shortlist: int) -> DataFrame:
    """(chunk, bucket, counts) of each chunk's words over all training documents, and per bucket, with chunk -1, its
    totals and most frequent words."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, blob in zip(frame["chunk"], frame["words"]):
                yield pd.DataFrame(list(ch.word_rows(chunk, *ch.load_words(blob), buckets)), columns=["chunk", "bucket", "words"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        words, indexes, values = ch.gathered(list(frame["words"]))
        total = np.zeros(len(words), np.int64)
        for index, value in zip(indexes, values):
            total[index] += value
        rows = [(chunk, bucket, ch.dump_arrays(total[index]), None, None, None) for chunk, bucket, index in zip(frame["chunk"], frame["bucket"], indexes)]
        known = [(w, int(c)) for w, c in zip(words, total.tolist()) if c and w != END]
        top = sorted(known, key=lambda x: (-x[1], x[0]))[:shortlist]
        rows.append((-1, int(frame["bucket"].iloc[0]), None, int(total.sum()), int((total > 0).sum()), [{"word": w, "n": c} for w, c in top]))
        out = pd.DataFrame(rows, columns=["chunk", "bucket", "counts", "tokens", "types", "top"])
        return out.assign(tokens=out["tokens"].astype("Int64"), types=out["types"].astype("Int64"))

    schema = "chunk long, bucket int, counts binary, tokens long, types long, top array<struct<word: binary, n: long>>"
    sent = chunks.select("chunk", "words").mapInPandas(send, "chunk long, bucket int, words binary")
    return staged(sent.groupBy("bucket").applyInPandas(add, schema), "lm-counts")


class Classes:
    """What the model tells apart: outputs are the shortlist, rare, end; contexts the shortlist, endings, start."""

    def __init__(self, shortlist: list[bytes], endings: int):
        self.place = {w: i for i, w in enumerate(shortlist)}
        self.size, self.endings = len(shortlist), endings
        self.rare, self.end, self.start = self.size, self.size + 1, self.size + endings
        self.outputs, self.contexts = self.size + 2, self.size + endings + 1

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(output, context) class of each word"""
        out = np.fromiter((self.place.get(w, self.rare) for w in words), np.int64, len(words))
        before = np.fromiter(
            (o if o != self.rare else self.size + zlib.crc32(w[-2:]) % self.endings for w, o in zip(words, out.tolist())), np.int64, len(words))
        return out, before

    def pairs(self, flat: np.ndarray, sizes: np.ndarray, out: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, output) of every token of the documents, ends included, and where each document starts among them."""
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        n = int((sizes + 1).sum())
        is_end = np.zeros(n, bool)
        is_end[starts + sizes] = True
        o, c = np.full(n, self.end, np.int64), np.full(n, self.start, np.int64)
        o[~is_end] = out[flat]
        c[1:][~is_end[:-1]] = before[flat]
        return c, o, starts


def pair_counts(chunks: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of (context, output) over all training documents: a table whose size the parameters bound."""
    shared = ch.shipped(chunks.sparkSession, classes)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = shared()
        total = np.zeros(k.contexts * k.outputs, np.int64)
        for frame in frames:
            for words, places in zip(frame["words"], frame["places"]):
                _, sizes, flat, held = ch.load_places(places, bool)
                if not len(sizes):
                    continue
                c, o, _ = k.pairs(flat, sizes, *k.of(ch.load_words(words)[0]))
                train = np.repeat(~held, sizes + 1)
                total += np.bincount((c * k.outputs + o)[train], minlength=len(total))
        table = total.reshape(k.contexts, k.outputs)
        rows = [(i, ch.dump_arrays(np.flatnonzero(table[i]), table[i][table[i] > 0])) for i in np.flatnonzero(table.any(axis=1)).tolist()]
        yield pd.DataFrame(rows, columns=["context", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(shared().outputs, np.int64)
        for blob in frame["counts"]:
            index, n = ch.load_arrays(blob, np.int64, np.int64)
            row[index] += n
        return pd.DataFrame({"context": frame["context"].iloc[:1], "counts": [ch.dump_arrays(row)]})

    counted = chunks.mapInPandas(count, "context int, counts binary").groupBy("context").applyInPandas(add, "context int, counts binary")
    out = np.zeros((classes.contexts, classes.outputs))
    for row in counted.toLocalIterator():
        out[row["context"]] = ch.load_arrays(bytes(row["counts"]), np.int64)[0]
    return out


def train(counts: np.ndarray, width: int = WIDTH, noise: int = NOISE, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> np.ndarray:
    """log10 P(output | context) of the trained model, rows normalised."""
    contexts, outputs = counts.shape
    rng = np.random.default_rng(seed)
    unigram = (counts.sum(axis=0) + 1) / (counts.sum() + outputs)
    counts = counts + PRIOR * unigram
    total = counts.sum()
    joint = (counts / total).astype(np.float32)
    noisy = (noise * joint.sum(axis=1, keepdims=True) * unigram[None, :]).astype(np.float32)
    # rows of rare contexts count for little in the sum; scaled up by their root they are learned as well
    weight = 1 / np.sqrt(np.maximum(joint.sum(axis=1, keepdims=True), 1e-9))
    weight = (weight / weight.min()).clip(max=100).astype(np.float32)
    shift = np.log(noise * unigram).astype(np.float32)
    p = [rng.normal(0, 0.1, (contexts, width)), np.eye(width), rng.normal(0, 0.1, (outputs, width)), np.log(unigram)]
    p = [x.astype(np.float32) for x in p]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        before, transform, vectors, bias = p
        aimed = before @ transform
        score = aimed @ vectors.T + bias
        real = 1 / (1 + np.exp(np.clip(shift - score, -30, 30)))  # that a pair is data and not noise
        slope = weight * (joint * (1 - real) - noisy * real)
        gradients = [slope @ vectors @ transform.T, before.T @ (slope @ vectors), slope.T @ aimed, slope.sum(axis=0)]
        pace = rate * (1 - 0.9 * step / steps)
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            p[i] = p[i] + pace * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    before, transform, vectors, bias = (x.astype(np.float64) for x in p)
    score = before @ transform @ vectors.T + bias
    score -= score.max(axis=1, keepdims=True)
    return (score - np.log(np.exp(score).sum(axis=1, keepdims=True))) / np.log(10)


def score_texts(docs: DataFrame, modulus: int = MODULUS, held: int = HELD, shortlist: int = SHORTLIST, endings: int = ENDINGS) -> DataFrame:
    """One row per document: token counts, smoothed unigram score, and the model's log10 probability."""
    chunks = packed_words(docs, modulus, held)
    buckets = ch.bucket_count(chunks)
    counted = word_counts(chunks, buckets, shortlist)
    sums = counted.where("chunk = -1").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    tokens, types = sums["n"] or 0, sums["v"] or 0
    top = counted.where("chunk = -1").select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "word").limit(shortlist).collect()
    classes = Classes([bytes(r["word"]) for r in top], endings)
    pairs = pair_counts(chunks, classes)
    short = sum(r["n"] for r in top)
    ends = int(pairs[:, classes.end].sum())
    rare_space = tokens - short - ends + types - len(top) - (ends > 0) + 1
    sc = docs.sparkSession.sparkContext
    model, shared = sc.broadcast(train(pairs)), ch.shipped(docs.sparkSession, classes)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        k, table = shared(), model.value
        parts = dict(zip(right["bucket"], right["counts"]))
        rows = []
        for blob, places in zip(left["words"], left["places"]):
            words = ch.load_words(blob)[0]
            c = np.zeros(len(words), np.int64)
            for bucket, index in ch.by_bucket(words, buckets):
                c[index] = ch.load_arrays(parts[bucket], np.int64)[0]
            ids, sizes, flat, out = ch.load_places(places, bool)
            if not len(ids):
                continue
            output, before = k.of(words)
            context, target, starts = k.pairs(flat, sizes, output, before)
            word = np.full(len(target), len(words) - 1, np.int64)  # the end is the last of the words
            is_end = np.zeros(len(target), bool)
            is_end[starts + sizes] = True
            word[~is_end] = flat
            base = np.log10((c + 1) / (tokens + types + 1))
            inner = np.where(output == k.rare, np.log10((c + 1) / rare_space), 0.0)
            inner[-1] = 0.0
            sums = [np.add.reduceat(x, starts) for x in (base[word], table[context, target] + inner[word], (c > 0)[word].astype(np.int64))]
            rows.append(pd.DataFrame({
                "doc_id": pd.array(ids, "Int64"), "held_out": out, "n_tokens": sizes + 1, "n_known": sums[2],
                "train_tokens": tokens, "base_score": sums[0], "score": sums[1]}))
        return pd.concat(rows) if rows else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = counted.where("chunk >= 0").select("chunk", "bucket", "counts")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, SCHEMA)
