"""Context-triggered piecewise hashes of documents, and how alike two of them are.

A hash of the last seven bytes runs over the text; where it hits the last residue of the block size, a piece ends.
Each piece gives one of 64 letters. The block size is 3 * 2^i, the least that can give at most 64 pieces, halved
while there are fewer than 32; the fingerprint is "block:pieces:pieces at twice the block". Fingerprints with equal
block sizes, or one twice the other, are compared on the pieces of the block size that both have, by edit distance.

The next document of each one (ascending doc_id; the first follows the last) is found in blocks of ids: block
bounds are ids of the table, a block's first document also goes to the block before, and a task walks through its
blocks in order. Texts move once.

Defined cases: null text is empty; a null doc_id comes before all others; rows with equal doc_id follow each other
by text; a single document follows itself; empty texts have the fingerprint "3::"; likeness of equal fingerprints
is 1, with an empty list of pieces on one side only it is 0; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm import chunks as ch

WINDOW = 7
LEAST_BLOCK = 3
MOST_PIECES = 64
FEWEST_PIECES = 32
COMMON = 4
BLOCKS_PER_PARTITION = 4
ACCURACY = 100_000
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LEAST_ID = -(2**63)

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                   ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def rolled(data: np.ndarray) -> np.ndarray:
    """Hash of the seven bytes up to each place; zeros stand before the text."""
    padded = np.zeros(len(data) + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 :] = data
    padded += np.uint32(1)
    out = np.zeros(len(data), np.uint32)
    for i in range(WINDOW):
        out *= np.uint32(0x01000193)
        out += padded[i : i + len(data)]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def _pieces(hashes: np.ndarray, sums: np.ndarray, ends: np.ndarray, most: int) -> str:
    """Letters of the pieces that end after `ends`; the last piece takes what is left."""
    ends = ends[ends < len(hashes) - 1][: most - 1]
    totals = np.append(sums[ends], sums[-1])
    value = np.diff(totals, prepend=np.uint32(0))
    value ^= value >> np.uint32(16)
    value *= np.uint32(0x7FEB352D)
    value ^= value >> np.uint32(15)
    return LETTERS[value >> np.uint32(26)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return f"{LEAST_BLOCK}::"
    hashes = rolled(data)
    block = LEAST_BLOCK
    while block * MOST_PIECES < len(data):
        block *= 2
    while True:
        ends = np.flatnonzero(hashes % np.uint32(block) == block - 1)
        if block == LEAST_BLOCK or len(ends) + 1 >= FEWEST_PIECES:
            break
        block //= 2
    coarse = ends[hashes[ends] % np.uint32(2 * block) == 2 * block - 1]
    sums = np.cumsum(hashes * np.uint32(0x85EBCA6B) ^ (hashes >> np.uint32(7)), dtype=np.uint32)
    return f"{block}:{_pieces(hashes, sums, ends, MOST_PIECES)}:{_pieces(hashes, sums, coarse, MOST_PIECES)}"


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements; a column of the table is kept as the bits of two integers."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    all_bits, last, up, down, score = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for c in b:
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(diagonal | up), up & diagonal
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(diagonal | rise)) & all_bits, rise & diagonal & all_bits
    return score


def pieces_alike(a: str, b: str) -> float:
    """1 - distance / longer length; 0 without a common run of pieces, which unrelated texts hardly have."""
    if a == b:
        return 1.0
    run = min(COMMON, (min(len(a), len(b)) + 1) // 2)
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (size_a, fine_a, coarse_a), (size_b, fine_b, coarse_b) = a.split(":"), b.split(":")
    size_a, size_b = int(size_a), int(size_b)
    if size_a == size_b:
        return max(pieces_alike(fine_a, fine_b), pieces_alike(coarse_a, coarse_b))
    if size_a == 2 * size_b:
        return pieces_alike(fine_a, coarse_b)
    if size_b == 2 * size_a:
        return pieces_alike(coarse_a, fine_b)
    return 0.0


def edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def in_order(docs: DataFrame) -> DataFrame | None:
    """(block, turn, place, doc_id, text) in partitions sorted by the first three; turn 1 is the next block's first document."""
    spark = docs.sparkSession
    docs = ch.id_and_text(docs)
    blocks = BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce("doc_id", F.lit(LEAST_ID))
    shares = [i / blocks for i in range(1, blocks)]
    found = docs.agg(F.min(place).alias("least"), F.percentile_approx(place, shares, ACCURACY).alias("bounds")).first()
    if found["least"] is None:
        return None
    bounds = np.unique(np.array([found["least"], *found["bounds"]], np.int64))  # each is the place of a document

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("doc_id").fill_null(LEAST_ID).to_numpy()
            block = np.searchsorted(bounds, places, side="right") - 1
            first = np.flatnonzero(bounds[block] == places)
            for rows, turn, at in ((batch, 0, block), (batch.take(pa.array(first)), 1, (block[first] - 1) % len(bounds))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array(np.full(rows.num_rows, turn), pa.int32()),
                     pa.array(rows.column("doc_id").fill_null(LEAST_ID)), rows.column("doc_id"), rows.column("text")],
                    ["block", "turn", "place", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "block int, turn int, place long, doc_id long, text string")
    return dealt.repartition("block").sortWithinPartitions("block", "turn", "place", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and likeness to that and to the next document's."""
    ordered = in_order(docs)
    if ordered is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for block, turn, doc_id, text in items:
            text = text or ""
            mark = fingerprint(text)
            if held is not None and held[0] == block:
                _, held_id, held_text, held_mark = held
                changed = edited(held_text, text)
                changed_mark = fingerprint(changed)
                yield (held_id, len(held_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held_mark, changed_mark,
                       alike(held_mark, changed_mark), alike(held_mark, mark))
            held = None if turn else (block, doc_id, text, mark)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("block", "turn", "doc_id", "text")))

        out = []
        for row in rows(items()):
            out.append(row)
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ARROW.types)], schema=ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ARROW.types)], schema=ARROW)

    return ordered.mapInArrow(walk, SCHEMA)
