"""Packed chunks of documents, and the exchange of what a chunk and the corpus tell each other.

A chunk is a few MB of whole documents in one row, as a compressed Arrow stream. Operators that need
corpus-wide facts about words, hashes or strings send each chunk's distinct items, sorted and cut in
buckets, to one task per bucket, and get the answers back per chunk: an item travels once per chunk, not
once per occurrence, and no group is larger than the number of chunks. Bucket tasks hold
total / buckets items; the number of buckets grows with the number of chunks.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kinfold.session import scratch_path

CHUNK_BYTES = 4 << 20
CHUNKS_PER_BUCKET = 4
LEAST_BUCKETS = 32
FILES_PER_PARTITION = 3
MOST_FILES = 100_000

IDS_TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def letters_lowered(text: str) -> bytes:
    """UTF-8 bytes with A-Z lowered and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


def train_mark(doc_id: Column | str, modulus: int, held: int) -> Column:
    """True for held-out documents: crc32 of the id as text modulo `modulus` is `held`. A null id is not held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == held, F.lit(False))


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts a value; called in a task, the result gives it back.

    Classes of this package travel with it, so that it need not be installed on the executors: a plain broadcast would
    name them only.
    """
    blob = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(blob.value)


def as_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def texts_of(table: pa.Table) -> list[str]:
    """Texts, null as empty."""
    return ["" if t is None else t for t in table.column("text").to_pylist()]


def kept_by_chunk(df: DataFrame, label: str) -> DataFrame:
    """Write rows that have a chunk number to the shared folder, bucketed by it, and read them back.

    What other tasks answer to a chunk is joined to it without moving the chunk itself again. Chunk numbers hold
    for this written table only, which later steps read again after a lost executor, so they never change.
    """
    return _bucketed(df, label, "chunk", FILES_PER_PARTITION)


def kept_by_key(df: DataFrame, label: str, key: str) -> DataFrame:
    """The same for many small rows: they are dealt out by the key first, so that a bucket is one file."""
    files = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _bucketed(df.repartition(min(MOST_FILES, files), key), label, key, 1)


def _bucketed(df: DataFrame, label: str, key: str, per_partition: int) -> DataFrame:
    spark = df.sparkSession
    files = min(MOST_FILES, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"kinfold_{uuid.uuid4().hex}"
    df.write.bucketBy(files, key).option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def forget(table: DataFrame) -> None:
    """Delete the files of a written table that only later written tables, complete by now, were made from."""
    spark = table.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for file in table.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(conf).delete(path, False)


def in_chunks(batches: Iterable[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk number, some MB of whole documents) of the batches of a task."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes + 256) // chunk_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if stop > start:
                yield number, batch.slice(start, stop - start)
                number += 1


def id_and_text(docs: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[c.alias(name) for name, c in (extra or {}).items()])


def every_column(docs: DataFrame) -> tuple[DataFrame, T.StructType]:
    """doc_id, text, and the other columns under names that clash with nothing; and the schema of that."""
    others = {f"__{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = id_and_text(docs, others)
    return rows, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])


def renamed_back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `every_column(docs)` as they are in `docs`."""
    return rows.select(*[
        F.col(c if c in ("doc_id", "text") else f"__{i}").cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(docs.columns)])


def pack(docs: DataFrame, label: str, chunk_bytes: int = CHUNK_BYTES, whole: bool = False) -> DataFrame:
    """Documents as chunks in the shared folder: (chunk long, batch binary). Only doc_id and text are read, or every column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in in_chunks(batches, chunk_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([as_blob(batch)], pa.binary())], ["chunk", "batch"])

    rows = every_column(docs)[0] if whole else id_and_text(docs)
    return kept_by_chunk(rows.mapInArrow(run, "chunk long, batch binary"), label)


def bucket_count(chunks: DataFrame) -> int:
    return max(LEAST_BUCKETS, chunks.count() // CHUNKS_PER_BUCKET)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(data)


def unsqueeze(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def dump_words(words: list[bytes], values: np.ndarray | None = None) -> bytes:
    """Words (any bytes) with one int64 each, compressed."""
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    values = np.zeros(0, np.int64) if values is None else np.ascontiguousarray(values, np.int64)
    head = np.array([len(words), len(values)], np.int64)
    return squeeze(head.tobytes() + lengths.tobytes() + values.tobytes() + b"".join(words))


def load_words(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    data = unsqueeze(blob)
    n, m = np.frombuffer(data, np.int64, 2)
    lengths = np.frombuffer(data, np.uint32, n, 16)
    values = np.frombuffer(data, np.int64, m, 16 + 4 * n)
    start = int(16 + 4 * n + 8 * m)
    ends = (start + np.cumsum(lengths, dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([start, *ends[:-1]], ends)], values


def dump_ragged(rows: list[np.ndarray]) -> bytes:
    lengths = np.fromiter(map(len, rows), np.int32, len(rows))
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return squeeze(np.array([len(rows)], np.int64).tobytes() + lengths.tobytes() + flat.tobytes())


def load_ragged(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, flat values)"""
    data = unsqueeze(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.int32, n, 8), np.frombuffer(data, np.int32, -1, 8 + 4 * n)


def by_bucket(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes into `words`), the same for the sending and for the receiving side."""
    b = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(b[part[0]]), part


def word_rows(chunk: int, words: list[bytes], values: np.ndarray | None, buckets: int) -> Iterable[tuple[int, int, bytes]]:
    """Rows (chunk, bucket, blob) of a chunk's distinct words."""
    for bucket, index in by_bucket(words, buckets):
        yield chunk, bucket, dump_words([words[i] for i in index], None if values is None else values[index])


def gathered(blobs: list[bytes]) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """Distinct words of several blobs, each blob's indexes into them, each blob's values."""
    place: dict[bytes, int] = {}
    indexes, values = [], []
    for blob in blobs:
        words, value = load_words(blob)
        indexes.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words)))
        values.append(value)
    return list(place), indexes, values


def dump_arrays(*parts: np.ndarray | bytes) -> bytes:
    """Arrays (their dtypes are the reader's to know) and byte strings in one compressed blob."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    return squeeze(np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw))


def load_arrays(blob: bytes, *dtypes) -> list:
    data = unsqueeze(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8).tolist()
    out, at = [], 8 + 8 * n
    for size, dtype in zip(sizes, dtypes):
        out.append(data[at : at + size] if dtype is bytes else np.frombuffer(data[at : at + size], dtype))
        at += size
    return out


def dump_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys: differences, byte by byte, so that their leading zeros vanish."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def load_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of uint64 values spread over all places."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def short_keys(keys: np.ndarray, bits: int = 48) -> np.ndarray:
    """The leading bits of uint64 keys: fewer bytes to send where a chance meeting only costs a later look."""
    return keys >> np.uint64(64 - bits)


def key_rows(chunk: int, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows (chunk, bucket, blob) of a chunk's sorted distinct keys."""
    for bucket, index in key_buckets(keys, buckets):
        yield chunk, bucket, dump_keys(keys[index])


def key_buckets(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    b = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
        if len(part):
            yield int(b[part[0]]), part


def key_counts(sent: DataFrame, *least: int) -> DataFrame:
    """(chunk, bucket, keys, counts) -> (chunk, bucket, flags): for each of `least`, a bit per key, set where the
    counts of all chunks add up to that many. Counts are uint32 in a blob; none stands for ones."""
    import pandas as pd

    def flag(frame: pd.DataFrame) -> pd.DataFrame:
        runs = [load_keys(b) for b in frame["keys"]]
        counts = [np.ones(len(r), np.int64) if c is None else load_arrays(c, np.uint32)[0].astype(np.int64) for r, c in zip(runs, frame["counts"])]
        order = np.argsort(every := np.concatenate(runs), kind="stable")
        every = every[order]
        new = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        sums = np.add.reduceat(np.concatenate(counts)[order], new) if len(new) else np.zeros(0, np.int64)
        total = np.empty(len(every), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(new, len(every))))
        ends = np.cumsum([len(r) for r in runs])
        flags = [b"".join(np.packbits(total[e - len(r) : e] >= n).tobytes() for n in least) for r, e in zip(runs, ends.tolist())]
        return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "flags": flags})

    return sent.groupBy("bucket").applyInPandas(flag, "chunk long, bucket int, flags binary")


def repeated_keys(sent: DataFrame) -> DataFrame:
    """(chunk, bucket, keys) -> (chunk, bucket, flags): a bit per key, set where another chunk sent the key as well."""
    return key_counts(sent.withColumn("counts", F.lit(None).cast("binary")), 2)


def flags_in_order(keys: np.ndarray, buckets: int, frame, which: int = 0, of: int = 1) -> np.ndarray:
    """A chunk's flags (the one numbered `which` of `of`) in the order of its sorted distinct keys."""
    parts = dict(zip(frame["bucket"], frame["flags"]))
    out = np.zeros(len(keys), bool)
    for bucket, index in key_buckets(keys, buckets):
        bits = np.frombuffer(parts[bucket], np.uint8).reshape(of, -1)[which]
        out[index] = np.unpackbits(bits, count=len(index)).astype(bool)
    return out



def placed(texts: list[str], cut) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct items that `cut` finds in some texts, most frequent first; the texts as places in that list; items per text."""
    place: dict = {}
    rows = [np.fromiter((place.setdefault(p, len(place)) for p in cut(t)), np.uint32) for t in texts]
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    order = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")
    rank = np.empty(len(place), np.uint32)
    rank[order] = np.arange(len(place), dtype=np.uint32)
    items = list(place)
    return [items[i] for i in order], rank[flat], np.array([len(r) for r in rows], np.int64)


def dump_places(batch: pa.RecordBatch, flat: np.ndarray, sizes: np.ndarray, *more: np.ndarray) -> bytes:
    """Ids and sizes of the documents and their places, byte by byte: the high bytes of frequent items are zeros."""
    ids = batch.column("doc_id")
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T)
    return dump_arrays(ids.fill_null(0).to_numpy(), np.array(ids.is_null().to_pylist(), bool), sizes, planes, *more)


def load_places(blob: bytes, *more) -> list:
    """[doc_ids (None for null), sizes, places, ...]"""
    ids, null, sizes, planes, *rest = load_arrays(blob, np.int64, bool, np.int64, np.uint8, *more)
    flat = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    return [[None if n else i for i, n in zip(ids.tolist(), null.tolist())], sizes, flat, *rest]
