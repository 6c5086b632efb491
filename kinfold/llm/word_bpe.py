"""Byte-level BPE over the distinct words of the corpus.

Method: global distinct-word shuffle. Every text is cut in pre-tokens by the tokenizer's pattern; a chunk of
documents keeps their positions and sends each of its distinct pre-tokens once; a bucket task encodes every
distinct pre-token of the corpus once; the ids go back to the chunks, are put in place by position, and are
decoded through the token-byte table.

The vocabulary (a .tiktoken rank file) is a bounded table of some 50,000 tokens; it is read on the driver and
shipped to the tasks. Null text counts as empty: no token, the digest of the empty string. Texts of any length
stay whole; equal rows give equal rows; an empty table gives an empty table; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.llm import chunks as ch

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def packed_pieces(docs: DataFrame, pattern: str, chunk_bytes: int = ch.CHUNK_BYTES) -> DataFrame:
    """(chunk, words, places): a chunk's distinct pre-tokens, and its documents as places in that list, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        findall = regex.compile(pattern).findall
        for number, batch in ch.in_chunks(batches, chunk_bytes):
            words, flat, sizes = ch.placed(ch.texts_of(batch), findall)
            places = ch.dump_places(batch, flat, sizes)
            words = [w.encode("utf-8", "surrogatepass") for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ch.dump_words(words)], pa.binary()), pa.array([places], pa.binary())],
                ["chunk", "words", "places"])

    return ch.kept_by_chunk(ch.id_and_text(docs).mapInArrow(run, "chunk long, words binary, places binary"), "bpe")


def word_ids(chunks: DataFrame, ranks: dict[bytes, int], pattern: str) -> tuple[DataFrame, int]:
    """(chunk, bucket, ids): ids of each chunk's distinct pre-tokens, in their order in the chunk; and the bucket count."""
    buckets = ch.bucket_count(chunks)
    table = chunks.sparkSession.sparkContext.broadcast(ranks)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, blob in zip(frame["chunk"], frame["words"]):
                yield pd.DataFrame(list(ch.word_rows(chunk, ch.load_words(blob)[0], None, buckets)), columns=["chunk", "bucket", "words"])

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        import tiktoken

        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table.value, special_tokens={})
        distinct, indexes, _ = ch.gathered(list(frame["words"]))
        ids = [np.array(encoding._core_bpe.encode_single_piece(word), np.int32) for word in distinct]
        blobs = [ch.dump_ragged([ids[i] for i in index]) for index in indexes]
        return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "ids": blobs})

    sent = chunks.select("chunk", "words").mapInPandas(send, "chunk long, bucket int, words binary")
    return sent.groupBy("bucket").applyInPandas(encode, "chunk long, bucket int, ids binary"), buckets


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: count and digest of its ids, digest of the decoded bytes; `ids` (array<int>) on request."""
    chunks = packed_pieces(docs, pattern)
    answers, buckets = word_ids(chunks, ranks, pattern)
    token_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        token_bytes[rank] = token
    table = docs.sparkSession.sparkContext.broadcast(token_bytes)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = dict(zip(right["bucket"], right["ids"]))
        rows = []
        for blob, places in zip(left["words"], left["places"]):
            words = ch.load_words(blob)[0]
            counts, shown, decoded = np.zeros(len(words), np.int64), [""] * len(words), [b""] * len(words)
            first, pool, held = np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], 0
            for bucket, index in ch.by_bucket(words, buckets):
                lengths, flat = ch.load_ragged(parts[bucket])
                counts[index], start, ids = lengths, 0, flat.tolist()
                first[index] = held + np.cumsum(lengths) - lengths
                pool.append(flat)
                held += len(flat)
                for i, n in zip(index.tolist(), lengths.tolist()):
                    own = ids[start : start + n]
                    start += n
                    shown[i] = ",".join(map(str, own))
                    decoded[i] = b"".join([table.value[k] for k in own])
            pool = np.concatenate(pool)
            ids, sizes, order = ch.load_places(places)
            at = 0
            for doc_id, size in zip(ids, sizes.tolist()):
                own = order[at : at + size]
                at += size
                index = own.tolist()
                digits = ",".join(map(shown.__getitem__, index))
                row = (doc_id, int(counts[own].sum()), hashlib.sha256(digits.encode()).hexdigest(),
                       hashlib.sha256(b"".join(map(decoded.__getitem__, index))).hexdigest())
                if with_ids:
                    n = counts[own]
                    row += (pool[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())],)
                rows.append(row)
        out = pd.DataFrame(rows, columns=names)
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(place, schema)
