"""Benchmark passages in documents, found through a positional index of all document words.

Words are runs of bytes 0-9, a-z and of multi-byte code points, A-Z lowered (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`). An item's
windows are its runs of `window` words; an item with fewer words, but not none, is one window.

Method: a distributed positional inverted index. `build` deals documents to shards of some MB and writes each shard's
postings, one row per (shard, term) with all places of the term, and one row per document. A shard holds whole
documents, so the places of a term that stands everywhere are spread over all shards, and the table grows with the words.
`search` reads the postings of the items' words only, adds up how often each word occurs in the corpus, and evaluates
every window in every shard from its rarest word on: the places of each next word, moved back by its offset in the
window, are intersected with what is left, and a window ends as soon as nothing is. Two results:

- phrase matches: all words of the window, one after another, in one document;
- proximity matches: some occurrence of the window's rarest word (ties: the lesser word) with every other word of the
  window within `reach` words before or after it, in one document. Every phrase is one, where reach >= window - 1.

The items are the query set: they are taken in blocks of at most BLOCK_BYTES of text, each broadcast as plain lists, so the
driver never holds more than a block. No cap on matches; no pair of documents is ever formed.

Defined cases: null and empty texts have no words and no hits; a null doc_id stays a row; rows that repeat are
rows of their own; an item without words has no window; a null item_id is an item like others, but left out of the lists of
ids; items with equal texts are all reported, equal item_ids once; a word may have any length; a document must fit in a
task; without items no document is hit; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinfold.llm import chunks as ch
from kinfold.session import join_sized, scratch_path, staged

WINDOW = 10
REACH = 16
GAP = 1024  # between the words of two documents of a shard; a window or a reach is shorter
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
KEPT_WORDS = 4
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SQL_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

INDEX = "kind string, shard long, doc_no int, doc_id long, n_words long, term string, n long, places binary"
ARROW = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("doc_no", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                   ("term", pa.string()), ("n", pa.int64()), ("places", pa.binary())])
MATCHES = "shard long, doc_no int, spans array<struct<start:long,stop:long>>, items array<string>, near_items array<string>"


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(ch.letters_lowered(text))


def packed(steps: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers >= 0, seven bits a byte, the high bit set where another byte follows; and the bytes that each one takes."""
    sizes = np.ones(len(steps), np.int64)
    for bits in range(7, 63, 7):
        more = steps >= np.int64(1) << np.int64(bits)
        if not more.any():
            break
        sizes += more
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > k)
        out[starts[rows] + k] = ((steps[rows] >> np.int64(7 * k)) & 127) | np.where(sizes[rows] > k + 1, 128, 0)
    return out.tobytes(), sizes


def steps_of(blob: bytes) -> np.ndarray:
    """The numbers that `packed` was given."""
    data = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(data < 128) + 1
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    steps = np.zeros(len(ends), np.int64)
    for k in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > k)
        steps[rows] |= (data[starts[rows] + k] & 127).astype(np.int64) << np.int64(7 * k)
    return steps


def places_of(blob: bytes) -> np.ndarray:
    """The places of one term."""
    return np.cumsum(steps_of(blob))


def all_places(blobs: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """The places of each of several terms."""
    sums, ends = np.cumsum(steps_of(b"".join(blobs))), np.cumsum(counts).tolist()
    return [sums[end - n : end] - (sums[end - n - 1] if end > n else 0) for n, end in zip(counts, ends)]


def shard_rows(number: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A shard's documents and its postings."""
    place: defaultdict[bytes, int] = defaultdict()
    place.default_factory = place.__len__  # a new word takes the next number
    found = [words_of(t) for t in ch.texts_of(batch)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
    terms, docs = list(place), batch.num_rows

    def column(values, kind, length):
        return pa.nulls(length, kind) if values is None else pa.array(values, kind)

    yield pa.RecordBatch.from_arrays(
        [pa.array(["doc"] * docs), pa.array(np.full(docs, number)), pa.array(np.arange(docs, dtype=np.int32)), batch.column("doc_id"),
         pa.array(sizes), *[column(None, t, docs) for t in ARROW.types[5:]]], schema=ARROW)
    if not len(flat):
        return
    places = np.arange(len(flat)) + np.repeat(np.arange(docs) * GAP, sizes)
    by_term = np.argsort(flat, kind="stable")
    counts = np.bincount(flat, minlength=len(terms))
    firsts = np.cumsum(counts) - counts
    steps = np.diff(places[by_term], prepend=0)
    steps[firsts] = places[by_term][firsts]
    blob, widths = packed(steps)
    bounds = np.append(0, np.cumsum(np.add.reduceat(widths, firsts)))
    for at in range(0, len(terms), 20_000):
        some, edges = terms[at : at + 20_000], bounds[at : at + 20_001]
        lists = pa.Array.from_buffers(pa.binary(), len(some), [
            None, pa.py_buffer((edges - edges[0]).astype(np.int32).tobytes()), pa.py_buffer(blob[edges[0] : edges[-1]])])
        yield pa.RecordBatch.from_arrays(
            [pa.array(["term"] * len(some)), pa.array(np.full(len(some), number)), *[column(None, t, len(some)) for t in ARROW.types[2:5]],
             pa.array(some, pa.binary()).cast(pa.string()), pa.array(counts[at : at + 20_000]), lists], schema=ARROW)


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index: rows of kind 'doc' (shard, doc_no, doc_id, n_words) and of kind 'term' (shard, term, n, places).

    Written in the shared folder, by kind. Shard numbers hold for this written table only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in ch.in_chunks(batches, shard_bytes):
            yield from shard_rows(number, batch)

    path = scratch_path(docs.sparkSession, "index")
    ch.id_and_text(docs).mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id string, words array) of the items that have a word."""
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    return items.select(F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(lowered, F.lit(SQL_WORDS), 0).alias("words")).where(F.size("words") > 0)


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The items, some MB of text at a time."""
    length = items.select(F.octet_length(F.concat_ws(" ", "words")).alias("b")).agg(F.sum("b").alias("b")).first()["b"] or 0
    blocks = 1 + length // block_bytes
    for block in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["words"]) for r in some.toLocalIterator()]
        if rows:
            yield rows


def windows_of(rows: list[tuple[str, list[str]]], window: int) -> tuple[list[tuple[str, ...]], list[list[int]], list[str | None]]:
    """Distinct windows; for each the numbers of the items that have it; the item ids by number."""
    owners: dict[tuple[str, ...], list[int]] = {}
    for number, (_, words) in enumerate(rows):
        for at in range(max(1, len(words) - window + 1)):
            have = owners.setdefault(tuple(words[at : at + window]), [])
            if not have or have[-1] != number:
                have.append(number)
    return list(owners), list(owners.values()), [item_id for item_id, _ in rows]


def kept_in(base: np.ndarray, places: np.ndarray, offset: int) -> np.ndarray:
    """Those of `base` that a place follows at the given offset."""
    if not len(places):
        return base[:0]
    wanted = base + offset
    at = np.searchsorted(places, wanted)
    at[at == len(places)] = 0
    return base[places[at] == wanted]


def near_to(base: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """Those of `base` that have a place at most `reach` away."""
    at = np.searchsorted(places, base - reach)
    found = at < len(places)
    return base[found][places[at[found]] <= base[found] + reach]


def search_shard(postings: dict[str, np.ndarray], plans: list, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window (its words with their offsets, rarest first; None: not in the corpus) that matches: its number, the
    starts of its phrases, and the places of its rarest word that have the others near.

    Windows of an item overlap and so have their rarest words in common: what is left of the places after the first
    words is kept. A phrase lies within `reach` unless that is shorter, so it is looked for where the words are near.
    """
    nothing = np.zeros(0, np.int64)
    left_by: dict[tuple[str, ...], np.ndarray] = {}
    for number, words in enumerate(plans):
        if words is None:
            continue
        order = tuple(dict.fromkeys(w for w, _ in words))
        near = left_by.get(order[:1])
        if near is None:
            near = left_by[order[:1]] = postings.get(order[0], nothing)
        if not len(near):
            continue
        for depth in range(1, len(order)):
            kept = left_by.get(order[: depth + 1]) if depth < KEPT_WORDS else None
            if kept is None:
                kept = near_to(near, postings.get(order[depth], nothing), reach)
                if depth < KEPT_WORDS:
                    left_by[order[: depth + 1]] = kept
            near = kept
            if not len(near):
                break
        exact = nothing
        if len(near) or reach < len(words) - 1:
            (rarest, first), *others = words
            exact = postings.get(rarest, nothing) - first
            for word, offset in others:
                if not len(exact):
                    break
                exact = kept_in(exact, postings.get(word, nothing), offset)
        if len(near) or len(exact):
            yield number, exact, near


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that overlap or touch become one; starts are in order."""
    reached = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reached[:-1])
    return starts[new], reached[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, reach: int = REACH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(shard, doc_no, spans, items, near_items) of the documents that a match hits.

    `spans` are (start, stop) of hit words, counted from 0 in the document, in order and apart; `items` are the ids with a
    phrase match there, `near_items` those with a proximity match, both sorted as strings.
    """
    import pandas as pd

    if not 0 < window < GAP or not 0 <= reach < GAP:
        raise ValueError(f"window and reach must be below {GAP}")
    spark = index.sparkSession
    items = staged(item_words(items), "items")
    terms = items.select(F.explode(F.array_distinct("words")).alias("term")).distinct()
    postings = staged(join_sized(index.where("kind = 'term'").select("shard", "term", "n", "places"), terms, ["term"], "left_semi"), "postings")
    docs = index.where("kind = 'doc'").select("shard", "doc_no", "n_words")
    found = []
    for rows in item_blocks(items, block_bytes):
        windows, owners, ids = windows_of(rows, window)
        wanted = spark.createDataFrame([(w,) for w in {w for words in windows for w in words}], "term string")
        mine = join_sized(postings, wanted, ["term"], "left_semi")
        counts = {r["term"]: r["n"] for r in mine.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
        plans = [sorted(((w, at) for at, w in enumerate(words)), key=lambda p: (counts[p[0]], p)) if all(w in counts for w in words) else None for words in windows]
        shared = spark.sparkContext.broadcast((plans, owners, ids))

        def run(key, frame: pd.DataFrame) -> pd.DataFrame:
            plans, owners, ids = shared.value
            here = frame[frame["term"].notna()]
            lists = dict(zip(here["term"], all_places(here["places"].tolist(), here["n"].astype(int).tolist()))) if len(here) else {}
            sizes = frame[frame["term"].isna()].sort_values("doc_no")["n_words"].to_numpy(np.int64)
            bases = np.cumsum(sizes) - sizes + np.arange(len(sizes)) * GAP
            spans: dict[int, list[tuple[int, int]]] = {}
            exact_ids: dict[int, set[int]] = {}
            near_ids: dict[int, set[int]] = {}
            for number, exact, near in search_shard(lists, plans, reach):
                length = len(plans[number])
                for places, hit in ((exact, exact_ids), (near, near_ids)):
                    for doc in np.unique(np.searchsorted(bases, places, side="right") - 1).tolist():
                        hit.setdefault(doc, set()).update(owners[number])
                for doc, place in zip((np.searchsorted(bases, exact, side="right") - 1).tolist(), exact.tolist()):
                    spans.setdefault(doc, []).append((place - int(bases[doc]), place - int(bases[doc]) + length))
            out = []
            for doc in sorted(exact_ids.keys() | near_ids.keys()):
                runs = np.array(sorted(spans.get(doc, [])), np.int64).reshape(-1, 2)
                if len(runs):
                    runs = np.stack(merged(runs[:, 0], runs[:, 1]), axis=1)
                names = [sorted({ids[i] for i in hit.get(doc, ()) if ids[i] is not None}) for hit in (exact_ids, near_ids)]
                out.append((key[0], doc, [{"start": a, "stop": b} for a, b in runs.tolist()], *names))
            return pd.DataFrame(out, columns=["shard", "doc_no", "spans", "items", "near_items"])

        grouped = mine.unionByName(docs, allowMissingColumns=True).groupBy("shard")
        found.append(grouped.applyInPandas(run, MATCHES))
    out = spark.createDataFrame([], MATCHES)
    for part in found:
        out = out.unionByName(part)
    if len(found) < 2:
        return out
    parts = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("spans", "items", "near_items")]
    return out.groupBy("shard", "doc_no").agg(*parts).withColumn("spans", joined_spans("spans"))


def joined_spans(spans: str) -> Column:
    """Sorted spans of several blocks of items as spans that lie apart."""
    def add(done, one):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], one["stop"]).alias("stop"))
        return (F.when(F.size(done) == 0, F.array(one))
                .when(one["start"] <= last["stop"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))
                .otherwise(F.concat(done, F.array(one))))

    return F.aggregate(spans, F.array().cast("array<struct<start:long,stop:long>>"), add)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, reach: int = REACH, shard_bytes: int = SHARD_BYTES,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with doc_id, n_words, spans, items and near_items (empty where nothing is hit)."""
    index = build(docs, shard_bytes)
    found = search(index, items, window, reach, block_bytes)
    every = index.where("kind = 'doc'").select("shard", "doc_no", "doc_id", "n_words")
    out = join_sized(every, found, ["shard", "doc_no"], "left")
    return out.select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "items", "near_items")])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts and digests of the matches of every document."""
    df = matches(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return df.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                     F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                     F.size("near_items").cast("long").alias("n_near_items"))
