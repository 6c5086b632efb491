"""Removal of byte strings that occurred before, over sorted suffix runs merged without comparing a byte twice.

A byte goes if a string of `length` bytes that covers it also starts earlier (a smaller doc_id, or the same
document at an earlier place). Strings are judged on the input and never cross documents.

Method: common-prefix-aware distributed merge sort.
- Sparse suffixes. Every `length`-byte string has an anchor, its `gram`-byte piece of least hash (the leftmost
  one), which depends on its bytes alone: equal strings have equal anchors. Neighbouring strings with one anchor
  form a context, and one suffix per context (from the anchor on, then the bytes before it, backwards) stands for
  them all. Contexts whose anchor piece occurs once in the corpus hold no repeated string and are left out: a
  necessary condition, so nothing is lost.
- Runs. Each chunk sorts its suffixes and sends them to the bucket of their anchor hash, front-coded: the length
  of the prefix shared with the previous suffix, and the rest.
- Merge. A bucket merges its runs with a loser tree whose nodes know how much of the last winner each loser
  shares. Bytes are compared only from the known prefix on, and the merged list carries the prefix lengths.
- Decision. Suffixes that share `gram` bytes form a group; within it equal contexts are neighbours. All but the
  first place of a context are repeated in full. Where a group holds different contexts, their strings are looked
  up in the order of their first places.
- Hot anchors. Where chunks hold `hot` different contexts of one anchor piece beyond their first, all in all, its
  contexts are no group: each chunk sends every distinct string of them once, with its first place there, to the
  bucket of a hash of the whole string, where the strings are sorted. A group so has at most `hot` + chunks contexts.

Results are exact: hashes only choose anchors and buckets, decisions compare bytes.

Defined cases: null text is empty; documents shorter than `length` keep every byte; a null doc_id comes before
all others; rows that share a doc_id are taken in the order in which the table stores them, so that of two equal
rows one stays; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.llm import chunks as ch

LENGTH = 100
GRAM = 50
CHUNK_BYTES = 2 << 20
PLACE_BITS = 31
HOT = 1 << 13
MOST_CHUNKS_BITS = 18  # a count of chunks below, one of contexts above

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
BYTE_CODES = ch.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LEAST_ID = -(2**63)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on, put together from hashes of 1, 2, 4, ... bytes."""
    power, size, out, done = BYTE_CODES[data], 1, None, 0
    while True:
        if gram & size:
            if out is None:
                out, done = power, size
            else:
                out, done = _joined(out, power, done), done + size
        if size * 2 > gram:
            return ch.mixed(out)
        power, size = _joined(power, power, size), size * 2


def _joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    n = len(right) - width
    out = left[:n] * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out += right[width : width + n]
    return out


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Contexts:
    """A chunk's bytes and contexts: anchors, first and last string of each, hash of the anchor piece."""

    def __init__(self, batch: pa.Table, length: int, gram: int):
        texts = [t.encode("utf-8", "surrogatepass") for t in ch.texts_of(batch)]
        self.ids = batch.column("doc_id").to_pylist()
        self.bytes = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        none = np.zeros(0, np.int64)
        self.anchor, self.first, self.last, self.hash = none, none, none, np.zeros(0, np.uint64)
        if not (sizes >= length).any():
            return
        hashes = gram_hashes(np.frombuffer(self.bytes, np.uint8), gram)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = window_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        inside = np.zeros(len(self.bytes) + 1, np.int8)
        long_ones = sizes >= length
        np.add.at(inside, self.starts[long_ones], 1)
        np.add.at(inside, self.ends[long_ones] - length + 1, -1)
        places = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
        anchors = (least[places] & low).astype(np.int64)
        new = np.flatnonzero(np.diff(anchors, prepend=-1))
        self.anchor, self.first = anchors[new], places[new]
        self.last = places[np.append(new[1:], len(places)) - 1]
        self.hash = hashes[self.anchor]


def contexts_beyond_first(c: Contexts, inverse: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """For each distinct anchor hash of a chunk, how many different contexts it has there, less one. It only decides the
    way that an anchor takes, so contexts are told apart by hashes of their first and last strings."""
    out = np.zeros(len(counts), np.int64)
    index = np.flatnonzero(counts[inverse] > 1) if len(counts) else out
    if len(index):
        strings = gram_hashes(np.frombuffer(c.bytes, np.uint8), length)
        marks = ch.mixed(strings[c.first[index]]) + strings[c.last[index]]
        pairs = np.unique(np.column_stack([inverse[index].astype(np.uint64), marks]), axis=0)
        np.add.at(out, pairs[:, 0].astype(np.int64), 1)
        out[counts > 1] -= 1
    return out


def hot_strings(c: Contexts, index: np.ndarray, length: int, buckets: int) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """The distinct strings of some contexts with their first places as (bucket, blob), and the sorted other places."""
    sizes = c.last[index] - c.first[index] + 1
    ends = np.cumsum(sizes)
    places = np.repeat(c.first[index] - (ends - sizes), sizes) + np.arange(ends[-1])
    doc = np.searchsorted(c.ends, places, side="right")
    ids = np.array([LEAST_ID if i is None else i for i in c.ids], np.int64)[doc]
    order = np.lexsort((places, ids))
    places, ids = places[order], ids[order]
    rows, again = [], []
    for bucket, part in ch.key_buckets(gram_hashes(np.frombuffer(c.bytes, np.uint8), length)[places], buckets):
        seen: dict[bytes, int] = {}
        for k in part.tolist():
            p = int(places[k])
            if seen.setdefault(c.bytes[p : p + length], k) != k:
                again.append(p)
        kept = np.fromiter(seen.values(), np.int64, len(seen))
        rows.append((bucket, ch.dump_arrays(ids[kept], places[kept], b"".join(seen))))
    return rows, np.sort(np.array(again, np.int64))


def decide_strings(numbers: list[int], blobs: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, places) of the strings of a bucket that occur earlier in another chunk."""
    parts = [ch.load_arrays(b, np.int64, np.int64, bytes) for b in blobs]
    ids, places = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    chunks = np.repeat(np.array(numbers, np.int64), [len(p[0]) for p in parts])
    strings = np.frombuffer(b"".join(p[2] for p in parts), np.uint8).reshape(-1, length)
    del parts
    order = np.lexsort((places, chunks, ids))
    strings = np.ascontiguousarray(strings[order])
    by_string = np.argsort(strings.view(f"V{length}").ravel(), kind="stable")
    again = np.zeros(len(order), bool)
    for start in range(1, len(order), 1 << 16):
        part = by_string[start - 1 : start + (1 << 16)]
        again[start : start + len(part) - 1] = (strings[part[1:]] == strings[part[:-1]]).all(axis=1)
    gone = order[by_string[again]]
    for chunk in np.unique(chunks[gone]).tolist():
        yield chunk, np.sort(places[gone[chunks[gone] == chunk]])


def in_runs(places: np.ndarray) -> bytes:
    """Sorted places as the first of each run and its length."""
    new = np.flatnonzero(np.append(True, np.diff(places) != 1)) if len(places) else np.zeros(0, np.int64)
    return ch.dump_arrays(places[new], np.diff(np.append(new, len(places))).astype(np.int64))


def _shared(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings that agree up to `start`."""
    n = min(len(a), len(b))
    rest = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (rest.bit_length() + 7) // 8


def front_coded(items: list[tuple[bytes, int, list[tuple[int, int]]]]) -> bytes:
    """Sorted (suffix, bytes from the anchor on, [(doc_id, place)]) as one run."""
    shared, rests, before = [], [], b""
    for key, _, _ in items:
        n = _shared(before, key, 0)
        shared.append(n)
        rests.append(key[n:])
        before = key
    places = [p for item in items for p in item[2]]
    return ch.dump_arrays(
        np.array(shared, np.uint32), np.array([len(r) for r in rests], np.uint32), np.array([i[1] for i in items], np.uint32),
        np.array([len(i[2]) for i in items], np.uint32), np.array([p[0] for p in places], np.int64),
        np.array([p[1] for p in places], np.int64), b"".join(rests))


def read_run(blob: bytes) -> Iterator[tuple[bytes, int, int, list[int], list[int]]]:
    """(suffix, prefix shared with the one before, bytes from the anchor on, doc_ids, places)"""
    shared, sizes, tails, counts, ids, places, rest = ch.load_arrays(blob, np.uint32, np.uint32, np.uint32, np.uint32, np.int64, np.int64, bytes)
    ids, places, at, p, key = ids.tolist(), places.tolist(), 0, 0, b""
    for n, size, tail, count in zip(shared.tolist(), sizes.tolist(), tails.tolist(), counts.tolist()):
        key = key[:n] + rest[at : at + size]
        yield key, n, tail, ids[p : p + count], places[p : p + count]
        at, p = at + size, p + count


def merge_runs(runs: list[Iterator]) -> Iterator[tuple[int, int, tuple]]:
    """(run, prefix shared with the output before, item) in the order of the suffixes, from a loser tree.

    `known[r]` is the prefix that the head of run r shares with the last winner that it was compared with. Of two
    heads compared with one winner, the one that shares more is the smaller; only a draw looks at bytes, from the
    shared prefix on.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (leaves - len(runs))
    keys = [h[0] if h else b"" for h in heads]
    known = [0 if h else -1 for h in heads]  # -1: the run is at its end and loses to all
    losers = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = keys[a], keys[b]
        n = _shared(x, y, known[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = list(range(leaves))
    while len(winners) > 1:
        level = len(winners) // 2
        for i in range(level):
            winners[i], losers[level + i] = play(winners[2 * i], winners[2 * i + 1])
        del winners[level:]
    top = winners[0]
    while known[top] >= 0:
        yield top, known[top], heads[top]
        head = next(runs[top], None)
        heads[top] = head
        if head is None:
            keys[top], known[top] = b"", -1
        else:
            keys[top], known[top] = head[0], head[1]
        node = (top + leaves) // 2
        while node:
            other = losers[node]
            k, o = known[top], known[other]
            if k < o:
                top, losers[node] = other, top
            elif k == o and k >= 0:
                x, y = keys[top], keys[other]
                n = _shared(x, y, k)
                if n == len(x) or (n < len(y) and x[n] < y[n]):
                    known[other] = n
                else:
                    known[top] = n
                    top, losers[node] = other, top
            node //= 2


def decide(group: dict[tuple[int, bytes], list[tuple[int, int, int]]], length: int) -> Iterator[tuple[int, int, int]]:
    """Repeated strings of a group of contexts with one anchor piece, as (chunk, first place, how many places)."""
    firsts = []
    for (tail, key), places in group.items():
        if len(places) > 1:
            places.sort()
            n = len(key) - length + 1
            for _, chunk, place in places[1:]:
                yield chunk, place, n
        firsts.append((places[0], tail, key))
    if len(firsts) < 2:
        return
    firsts.sort()
    seen: set[bytes] = set()
    for (_, chunk, place), tail, key in firsts:
        text = key[tail:][::-1] + key[:tail]
        start = None
        for i in range(len(text) - length + 1):
            piece = text[i : i + length]
            if piece in seen:
                if start is None:
                    start = i
            else:
                seen.add(piece)
                if start is not None:
                    yield chunk, place + start, i - start
                    start = None
        if start is not None:
            yield chunk, place + start, len(text) - length + 1 - start


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: bytes, removed bytes and spans, digest of the kept bytes; `kept` (binary) on request."""
    chunks = ch.pack(docs, "suffixes", CHUNK_BYTES)
    buckets = ch.bucket_count(chunks)

    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, blob in zip(frame["chunk"], frame["batch"]):
                c = Contexts(ch.from_blob(blob), length, gram)
                keys, inverse, counts = np.unique(c.hash, return_inverse=True, return_counts=True)
                more = np.minimum(contexts_beyond_first(c, inverse, counts, length), hot)
                rows = [(chunk, b, ch.dump_keys(keys[i]), ch.dump_arrays((1 + (more[i] << MOST_CHUNKS_BITS)).astype(np.uint32)) if more[i].any() else None)
                        for b, i in ch.key_buckets(keys, buckets)]
                yield pd.DataFrame(rows, columns=["chunk", "bucket", "keys", "counts"])

    flags = ch.key_counts(chunks.mapInPandas(anchors, "chunk long, bucket int, keys binary, counts binary"), 2, hot << MOST_CHUNKS_BITS)

    def runs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for chunk, blob in zip(left["chunk"], left["batch"]):
            c = Contexts(ch.from_blob(blob), length, gram)
            keys, inverse, counts = np.unique(c.hash, return_inverse=True, return_counts=True)
            split = ch.flags_in_order(keys, buckets, right, 1, 2)
            again = (ch.flags_in_order(keys, buckets, right, 0, 2) | (counts > 1)) & ~split
            index = np.flatnonzero(again[inverse]) if len(keys) else np.zeros(0, np.int64)
            if split.any():  # buckets from `buckets` on decide strings, those from twice as many on pass places through
                strings, settled = hot_strings(c, np.flatnonzero(split[inverse]), length, buckets)
                rows += [(buckets + b, chunk, string_blob) for b, string_blob in strings]
                rows.append((2 * buckets + chunk % buckets, chunk, in_runs(settled)))
            doc = np.searchsorted(c.ends, c.first[index], side="right")
            bucket_of = (c.hash[index] % np.uint64(buckets)).astype(np.int64)
            parts: dict[int, dict[tuple[bytes, int], list]] = {}
            for a, p, q, d, b in zip(c.anchor[index].tolist(), c.first[index].tolist(), c.last[index].tolist(), doc.tolist(), bucket_of.tolist()):
                end = q + length
                key = c.bytes[a:end] + c.bytes[p:a][::-1]
                doc_id = c.ids[d]
                parts.setdefault(b, {}).setdefault((key, end - a), []).append((LEAST_ID if doc_id is None else doc_id, p))
            for b, items in parts.items():
                rows.append((b, chunk, front_coded([(k, tail, items[k, tail]) for k, tail in sorted(items)])))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "run"])

    sent = chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(runs, "bucket int, chunk long, run binary")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        numbers, kind = frame["chunk"].tolist(), int(frame["bucket"].iloc[0]) // buckets
        if kind == 2:
            return frame[["chunk", "run"]].rename(columns={"run": "found"})
        if kind == 1:
            return pd.DataFrame([(n, in_runs(places)) for n, places in decide_strings(numbers, list(frame["run"]), length)], columns=["chunk", "found"])
        found: dict[int, tuple[list[int], list[int]]] = {}
        group: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}

        def close() -> None:
            for chunk, place, n in decide(group, length):
                places, counts = found.setdefault(chunk, ([], []))
                places.append(place)
                counts.append(n)
            group.clear()

        for run, shared, (key, _, tail, ids, places) in merge_runs([read_run(b) for b in frame["run"]]):
            if shared < gram and group:
                close()
            chunk = numbers[run]
            group.setdefault((tail, key), []).extend([(i, chunk, p) for i, p in zip(ids, places)])
        close()
        rows = [(chunk, ch.dump_arrays(np.array(places, np.int64), np.array(counts, np.int64))) for chunk, (places, counts) in found.items()]
        return pd.DataFrame(rows, columns=["chunk", "found"])

    found = sent.groupBy("bucket").applyInPandas(merge, "chunk long, found binary")

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for blob in left["batch"]:
            batch = ch.from_blob(blob)
            texts = [t.encode("utf-8", "surrogatepass") for t in ch.texts_of(batch)]
            size = sum(map(len, texts))
            data = np.frombuffer(b"".join(texts), np.uint8)
            depth = np.zeros(size + 1, np.int32)
            for part in right["found"]:
                places, counts = ch.load_arrays(part, np.int64, np.int64)
                np.add.at(depth, places, 1)
                np.add.at(depth, places + counts + length - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            at = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                mask = gone[at : at + len(text)]
                removed = int(mask.sum())
                kept = data[at : at + len(text)][~mask].tobytes() if removed else text
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
                rows.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_kept else ()))
                at += len(text)
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept)
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    schema = SCHEMA + (", kept binary" if with_kept else "")
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(cut, schema)
