"""Fill-in-the-middle transformation of documents, cut between units that are counted chunk by chunk.

A text of n units gets two cuts; prefix, middle and suffix are put in one of two orders behind marks. Units are lines
(`[^\\n]*\\n|[^\\n]+`), cuts are drawn from a digest of the document's id, so every run draws the same ones.

Method: content-defined chunk memoization. A rolling hash over 16 bytes ends a chunk wherever its low bits are zero, so
that a passage which documents share is cut alike wherever it stands. What a chunk contributes - its line ends and its
code points - is looked up in a cache by the chunk's whole content (a meeting of hashes decides nothing) and found only
where the content is new. Running sums of the chunks' counts tell the chunk in which a cut lies; only that chunk is
searched. A task's cache holds CACHE_BYTES of chunks at most and is emptied beyond that, which costs time, not results.
Nothing is shuffled or collected.

Defined cases: null and empty texts are plain, with n 0; a null doc_id draws from the digest of the seed alone; equal rows
give equal rows; a text may be one line or one chunk of any length; texts that contain a mark are plain; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm import chunks as ch

SEED = 7
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_SHARE = 100, 50  # percent
WINDOW_DOUBLINGS = 4  # the hash runs over 2 ** 4 bytes
MASK = 0xFF  # a chunk ends at one place in 256
LONGEST_CACHED = 4096
CACHE_BYTES = 32 << 20
PIECE_BYTES = 2 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                   ("middle_chars", pa.int64()), ("output", pa.string())])


def chunk_ends(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents that lie one after another in `data`; every document ends a chunk.

    A chunk ends only where the whole window lies in the document, so its ends depend on the document's bytes alone.
    """
    mixed = ch.mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
    hashes = mixed[data]
    for step in range(WINDOW_DOUBLINGS):
        back = 1 << step
        older = hashes[:-back] << np.uint32(back) if back < len(hashes) else hashes[:0]
        hashes = np.concatenate([hashes[:back], hashes[back:] + older])
    hit = (hashes >> np.uint32(1 << WINDOW_DOUBLINGS)) & np.uint32(MASK) == 0
    bounds = np.append(starts, len(data))
    early = np.minimum(np.repeat(starts, (1 << WINDOW_DOUBLINGS) - 1) + np.tile(np.arange((1 << WINDOW_DOUBLINGS) - 1), len(starts)),
                       np.repeat(bounds[1:], (1 << WINDOW_DOUBLINGS) - 1) - 1)
    hit[early[early >= 0]] = False
    hit[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    return np.flatnonzero(hit) + 1


def summary(chunk: bytes) -> tuple[int, int]:
    """(line ends, code points that begin) of a chunk; chunks may end inside a code point."""
    return chunk.count(b"\n"), int(np.count_nonzero(np.frombuffer(chunk, np.int8) >= -64))


class Cache:
    """Summaries by content, shared by the documents of a task."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.known: dict[bytes, tuple[int, int]] = {}
        self.held, self.limit, self.misses = 0, limit, 0

    def summary(self, chunk: bytes) -> tuple[int, int]:
        found = self.known.get(chunk)
        if found is None:
            found = summary(chunk)
            self.misses += 1
            if len(chunk) <= LONGEST_CACHED:
                if self.held + len(chunk) > self.limit:
                    self.known.clear()
                    self.held = 0
                self.known[chunk] = found
                self.held += len(chunk) + 200
        return found


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def located(chunk: bytes, ends: int) -> int:
    """Bytes of the chunk up to its `ends`-th line end."""
    at = 0
    for _ in range(ends):
        at = chunk.index(b"\n", at) + 1
    return at


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """One row per document: units, form (plain, psm, spm), lengths of prefix and middle, and the transformed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache()
        for _, batch in ch.in_chunks(batches, PIECE_BYTES):
            rows = [one for one in rearranged(batch.column("doc_id").to_pylist(), ch.texts_of(batch), cache, seed, rate, spm_share)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)

    return ch.id_and_text(docs).mapInArrow(run, SCHEMA)


def rearranged(ids: list, texts: list[str], cache: Cache, seed: int, rate: int, spm_share: int) -> Iterator[tuple]:
    """The rows of some documents; the chunks of all of them are found and counted together."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"".join(raw)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(sizes) - sizes
    cuts = chunk_ends(np.frombuffer(joined, np.uint8), starts) if joined else np.zeros(0, np.int64)
    begins = np.append(0, cuts[:-1]).astype(np.int64) if len(cuts) else cuts
    counts = np.array([cache.summary(joined[a:b]) for a, b in zip(begins.tolist(), cuts.tolist())], np.int64).reshape(-1, 2)
    sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(counts, axis=0)])
    first = np.searchsorted(begins, starts)  # a document's first chunk; its last is before the next one's first
    last = np.searchsorted(begins, starts + sizes)

    def cut(d: int, units: int, n: int) -> tuple[int, int]:
        """(bytes, code points) of the document before the end of its unit number `units`."""
        lo, hi = int(first[d]), int(last[d])
        if units == n:
            return int(sizes[d]), int(sums[hi, 1] - sums[lo, 1])
        if not units:
            return 0, 0
        want = sums[lo, 0] + units
        chunk = lo + int(np.searchsorted(sums[lo + 1 : hi + 1, 0], want))
        inside = joined[int(begins[chunk]) : int(cuts[chunk])]
        inside = inside[: located(inside, int(want - sums[chunk, 0]))]
        return int(begins[chunk] - starts[d]) + len(inside), int(sums[chunk, 1] - sums[lo, 1]) + summary(inside)[1]

    for d, (doc_id, text, data) in enumerate(zip(ids, texts, raw)):
        n = int(sums[last[d], 0] - sums[first[d], 0]) + (bool(data) and not data.endswith(b"\n"))
        h1, h2, h3, h4 = draws(doc_id, seed)
        if not data or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            yield doc_id, n, "plain", None, None, text
            continue
        (byte_a, char_a), (byte_b, char_b) = (cut(d, units, n) for units in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = (data[a:b].decode("utf-8", "surrogatepass") for a, b in ((0, byte_a), (byte_a, byte_b), (byte_b, len(data))))
        if h4 % 100 < spm_share:
            yield doc_id, n, "spm", char_a, char_b - char_a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
        else:
            yield doc_id, n, "psm", char_a, char_b - char_a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def with_restored(df: DataFrame) -> DataFrame:
    """Adds `restored`, the text before the transformation, from `form` and `output` alone.

    A mark neither stands in a transformed text nor comes about where a part meets a mark (each has `<` at its front
    only), so the first of each kind is the one that was put there.
    """
    out, marks = F.col("output"), {m: F.locate(m, "output") for m in (PREFIX, SUFFIX, MIDDLE)}

    def between(mark: str, after: str):
        return F.substring(out, marks[mark] + len(mark), marks[after] - marks[mark] - len(mark))

    middle = F.substring(out, marks[MIDDLE] + len(MIDDLE), F.char_length(out))
    restored = (
        F.when(F.col("form") == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(F.col("form") == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(out))
    return df.withColumn("restored", restored)


def digests(docs: DataFrame) -> DataFrame:
    """The transformation with digests in place of texts."""
    df = with_restored(transform(docs))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                     F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
