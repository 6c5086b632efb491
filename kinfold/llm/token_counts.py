"""Token counts of texts by greedy longest match, in one pass over each word's bytes.

Words are cut at 0x20 and 0x09-0x0D; a word is a space and its bytes, so that pieces with a leading space only begin
words. Pieces are those of the given vocabulary and, for bytes that it lacks, the single byte. From the left, the
longest piece that fits is taken each time.

Method: a linear longest-match automaton. The trie of the vocabulary gets failure links: where no edge goes on, the
link leads to the node of what is left after the longest pieces at the front have been taken, and carries how many
those are. A word's count is the sum over the links that it follows; no piece is ever built. A chunk of documents
counts each of its distinct words once, all of them in step, a byte at a time.

The automaton is bounded by the vocabulary; it is built on the driver and shipped. Nothing is shuffled.

Defined cases: null and blank texts have 0 words and 0 tokens; words of any length are whole; equal rows get equal
counts; a null doc_id stays; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.llm import chunks as ch

PIECE_BYTES = 2 << 20
LONG_WORD = 64

SCHEMA = "doc_id long, n_words long, n_tokens long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


class Automaton:
    """Edges as sorted keys node * 256 + byte; for each node its failure link and how many pieces that link takes."""

    def __init__(self, pieces: Iterable[bytes]):
        edges: dict[int, int] = {}
        ends: set[int] = set()
        order: list[tuple[int, int, int]] = []  # (parent, byte, node)
        for piece in sorted({*pieces, *(bytes([b]) for b in range(256))} - {b""}, key=lambda p: (len(p), p)):
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(edges) + 1
                    order.append((node, byte, edges[key]))
                node = edges[key]
            ends.add(node)
        size = len(edges) + 1
        link, taken, depth = [0] * size, [0] * size, [0] * size
        for parent, _, node in order:
            depth[node] = depth[parent] + 1
        for parent, byte, node in sorted(order, key=lambda e: depth[e[2]]):
            if node in ends:
                link[node], taken[node] = 0, 1
                continue
            at, count = link[parent], taken[parent]
            while at << 8 | byte not in edges:  # ends at the root, which has an edge for every byte
                at, count = link[at], count + taken[at]
            link[node], taken[node] = edges[at << 8 | byte], count
        self.edges, self.link_list, self.taken_list = edges, link, taken
        self.keys = np.fromiter(sorted(edges), np.int64, len(edges))
        self.nodes = np.fromiter((edges[k] for k in self.keys.tolist()), np.int64, len(edges))
        self.link, self.taken = np.array(link, np.int64), np.array(taken, np.int64)

    def count(self, word: bytes) -> int:
        node = total = 0
        for byte in b" " + word:
            while node << 8 | byte not in self.edges:
                total += self.taken_list[node]
                node = self.link_list[node]
            node = self.edges[node << 8 | byte]
        while node:
            total += self.taken_list[node]
            node = self.link_list[node]
        return total

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of every word; words walk side by side, the very long ones alone."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[i] = self.count(words[i])
        short = np.flatnonzero(sizes <= LONG_WORD)
        short = short[np.argsort(-sizes[short], kind="stable")]
        data = np.frombuffer(b"".join([b" " + words[i] for i in short.tolist()]), np.uint8).astype(np.int64)
        length = sizes[short] + 1
        starts = np.cumsum(length) - length
        node, total = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
        for step in range(int(length[0]) if len(length) else 0):
            rows = np.arange(np.searchsorted(-length, -step, side="left"))  # the words that are longer than this
            byte = data[starts[rows] + step]
            while len(rows):
                key = node[rows] << 8 | byte
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                node[rows[hit]] = self.nodes[at[hit]]
                rows, byte = rows[~hit], byte[~hit]
                total[rows] += self.taken[node[rows]]
                node[rows] = self.link[node[rows]]
        while node.any():
            total += self.taken[node]
            node = self.link[node]
        out[short] = total
        return out


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def count_tokens(docs: DataFrame, pieces: Iterable[bytes]) -> DataFrame:
    """doc_id, number of words and of greedy longest-match tokens of every document."""
    shared = ch.shipped(docs.sparkSession, Automaton(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared()
        for _, batch in ch.in_chunks(batches, PIECE_BYTES):
            words, flat, sizes = ch.placed(ch.texts_of(batch), words_of)
            sums = np.concatenate([[0], np.cumsum(automaton.counts(words)[flat])]).astype(np.int64)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])], schema=ARROW)

    return ch.id_and_text(docs).mapInArrow(run, SCHEMA)
