"""Exact join of documents by the Jaccard similarity of their word shingles, through PartEnum signatures.

A document's set holds its distinct shingles of `words` words (a shorter text is one shingle, a text without
words is empty and linked with nothing). Two documents link when 4 * |intersection| >= 3 * |union|; the result
gives each document the smallest doc_id that links reach.

Method: PartEnum.
- Size bands [b, 4b/3]: linked sets lie in one band or in neighbours, so an instance covers two neighbouring
  bands and a set takes part in two instances. Linked sets of x and at most 4x/3 shingles differ in at most
  (x + 4x/3) / 7 of them.
- An instance cuts the shingle domain in `groups` groups of three parts. Every two of a group's three parts give
  one signature, the hash of what the set has in them. Where a group has at most one differing shingle, two of
  its parts agree. A set has more groups with shingles in two parts than groups that two differences can spoil,
  so it shares a signature that is not empty with every set that it links with.
- Shingles that many sets have (`HOT_SETS`, a common passage) would bring unrelated sets together. What they differ
  in without them is no more than with them, so the rest of a set gives its signatures if the count above holds for
  the rest. Only sets for which it fails add signatures over all their shingles, and, if it fails there too (mostly
  very small sets), one for each shingle of their prefix in hash order, which any two linked sets share: nothing is
  lost.

Before that, sets that cannot link are put aside by two exact counts: of a set's first shingles in hash order a
known number must occur in another set, and then three quarters of all. Equal sets are one set from there on.

Candidates are checked on whole sets. All pairs of a signature group of a few members are checked; of a larger one
only pairs with a few members (hubs), which joins nearly all that belongs together. What is left, members of different
components, is compared in blocks that return only pairs which may link by a bound from above, so every link that could
join components is looked at and no large group is spelled out pair by pair. Components come from repeated joins; links and labels stay distributed.

Words, then shingles, are compared as 64-bit hashes, sets as 128-bit digests: two given shingles that differ are taken for
one with a chance of about 2^-63, and a link depends only on the shingles of its two documents.

Defined cases: null text is empty; a null doc_id never names a component unless no other id is reached (then
null); rows with equal ids are separate documents; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kinfold.llm import chunks as ch
from kinfold.session import join_sized, staged

WORDS = 5
GROUPS_PER_SIZE = 0.2
HOT_SETS = 16
SMALL_GROUP = 16
FIRST_HUBS = 1
BLOCK_SETS = 256
BINS = 1 << 14
SETS_PER_BUCKET = 512
SETS_AT_ONCE = 1000
BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
WORD_KEY = b"words of shingles"
UNIT_BYTES = 4 << 20
PAIRS = ((0, 1), (0, 2), (1, 2))

SCHEMA = "doc_id long, n_shingles long, component_id long"


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where each word starts, its 64-bit hash) of lower-cased bytes; words end at 0x20 and 0x09-0x0D.

    The hash is a keyed BLAKE2b of the word, taken once a distinct word: no length or pattern of letters makes words collide.
    """
    blank = BLANKS[np.frombuffer(data, np.uint8)]
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1])) if len(blank) else np.zeros(0, np.int64)
    words = data.split()
    known = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8, key=WORD_KEY).digest(), "little") for w in set(words)}
    return starts, np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def text_shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    parts = [ch.letters_lowered(t or "") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts, h = word_hashes(b" ".join(parts) + b" ")
    bounds = np.searchsorted(starts, np.append(0, np.cumsum(sizes))).tolist()
    n = max(len(h) - words + 1, 0)
    rolled = np.full(n, words, np.uint64)
    for i in range(words):
        rolled = (rolled ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
    rolled = ch.mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                one = (one ^ h[i : i + 1]) * np.uint64(0x9E3779B97F4A7C15)
                one ^= one >> np.uint64(29)
            out.append(ch.mixed(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_shared(n: int) -> int:
    """Shingles that a set of n shares with any set that it links with."""
    return -(-3 * n // 4)


def reach(n: int) -> int:
    """How many shared shingles the prefix of a set of n is sure to hold."""
    return max(1, n // 6)


def prefix(keys: np.ndarray) -> np.ndarray:
    n = len(keys)
    return keys[: n - least_shared(n) + reach(n)]


def _digest(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted short keys of distinct sets, and how many of the sets have each."""
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.sort(ch.short_keys(np.concatenate(sets)))  # two of one set may fall together: one more to look at
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.diff(np.append(new, len(keys)))


def _among(part: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys of `part` are among the sorted short keys `some`."""
    if not len(some):
        return np.zeros(len(part), bool)
    short = ch.short_keys(part)
    return some[np.minimum(np.searchsorted(some, short), len(some) - 1)] == short


def _text_sets(blob: bytes) -> tuple[list, list[np.ndarray], list[bytes | None], dict[bytes, np.ndarray]]:
    """(ids, sets, digests) of a chunk's documents, and its distinct sets by digest; an empty set has no digest."""
    batch = ch.from_blob(blob)
    sets = text_shingles(batch.column("text").to_pylist())
    digests = [_digest(s) if len(s) else None for s in sets]
    return batch.column("doc_id").to_pylist(), sets, digests, {d: s for d, s in zip(digests, sets) if d is not None}


def _band_tops(largest: int) -> list[int]:
    tops, low = [], 1
    while not tops or tops[-1] < largest:
        tops.append(4 * low // 3)
        low = tops[-1] + 1
    return tops


def _instance_signatures(keys: np.ndarray, instance: int, groups: int, domain: int) -> tuple[np.ndarray, int]:
    """Signatures that are not empty, and the number of groups with keys in two parts."""
    seed = np.uint64(((2 * instance + domain + 4) * 0x632BE59BD9B4E019) % 2**64)
    spread = ch.mixed(keys ^ seed)
    part = (spread % np.uint64(3 * groups)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    heads = np.flatnonzero(np.diff(part[order], prepend=-1))
    sums, filled = np.zeros(3 * groups, np.uint64), np.zeros(3 * groups, bool)
    if len(keys):
        sums[part[order][heads]] = np.add.reduceat(ch.mixed(spread)[order], heads)
        filled[part[order][heads]] = True
    sums, filled = sums.reshape(-1, 3), filled.reshape(-1, 3)
    place, out = np.arange(groups, dtype=np.uint64) * np.uint64(3), []
    for number, (a, b) in enumerate(PAIRS):
        sign = ch.mixed(sums[:, a] * np.uint64(0xA0761D6478BD642F) + ch.mixed(sums[:, b] + np.uint64(number)) + (place + np.uint64(number)) * np.uint64(0xE7037ED1A0B428DB) + seed)
        out.append(sign[filled[:, a] | filled[:, b]])
    return np.concatenate(out), int((filled.sum(axis=1) >= 2).sum())


def signatures(keys: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a set; any two sets that link share one. `hot` marks the shingles that many sets have."""
    n = len(keys)
    tops = _band_tops(n)
    band = len(tops) - 1
    tops.append(4 * (tops[-1] + 1) // 3)
    spoiled = (n + 4 * n // 3) // 7 // 2
    out: list[np.ndarray] = []

    def add(some: np.ndarray, domain: int) -> bool:
        """Whether two linked sets may share none of these."""
        few = False
        for instance in (band - 1, band):
            signs, sound = _instance_signatures(some, instance, max(1, int(np.ceil(GROUPS_PER_SIZE * tops[instance + 1]))), domain)
            out.append(signs)
            few |= sound <= spoiled
        return few

    if add(keys if hot is None else keys[~hot], 0) and add(keys, 1):
        out.append(ch.mixed(keys[: n - least_shared(n) + 1] ^ np.uint64(0x8EBC6AF09C88C6E3)))
    return np.unique(np.concatenate(out))


def marked_documents(chunks: DataFrame) -> DataFrame:
    """(chunk, row, doc_id, n_shingles, digest, keys) of all documents: no digest where no link is possible, and the
    keys of a set once a chunk. The chunks are not needed any more once it is written."""
    buckets = ch.bucket_count(chunks)

    def first_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, blob in zip(frame["chunk"], frame["batch"]):
                distinct = _text_sets(blob)[3]
                keys, _ = _counted([prefix(s) for s in distinct.values()])
                yield pd.DataFrame(list(ch.key_rows(chunk, keys, buckets)), columns=["chunk", "bucket", "keys"])

    def first_cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for chunk, blob in zip(left["chunk"], left["batch"]):
            ids, sets, digests, distinct = _text_sets(blob)
            keys, counts = _counted([prefix(s) for s in distinct.values()])
            shared = keys[(counts > 1) | ch.flags_in_order(keys, buckets, right)]
            copies = Counter(digests)
            stay = {d for d, s in distinct.items() if copies[d] > 1 or _among(prefix(s), shared).sum() >= reach(least_shared(len(s)))}
            sent: set[bytes] = set()
            for row, (doc_id, s, d) in enumerate(zip(ids, sets, digests)):
                rows.append((chunk, row, doc_id, len(s), d if d in stay else None, s.tobytes() if d in stay and d not in sent else None))
                sent.add(d)
        out = pd.DataFrame(rows, columns=["chunk", "row", "doc_id", "n_shingles", "digest", "keys"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    flags = ch.repeated_keys(chunks.select("chunk", "batch").mapInPandas(first_keys, "chunk long, bucket int, keys binary"))
    return staged(
        chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(first_cut, "chunk long, row int, doc_id long, n_shingles long, digest binary, keys binary"), "marked")


def distinct_sets(marked: DataFrame) -> DataFrame:
    """(set_id, lead, digest, size, keys) of the distinct sets, bucketed by set_id; no keys where only copies link."""
    sets = marked.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("lead"), F.max("keys").alias("keys"))

    def unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        number, first = task << 32, task << 40
        for frame in frames:
            part = frame["keys"].map(len).cumsum() // UNIT_BYTES
            for _, some in frame.groupby(part):
                leads = some["lead"].astype("Int64")
                blob = ch.dump_arrays(
                    leads.fillna(0).to_numpy(np.int64), leads.isna().to_numpy(bool), b"".join(some["digest"]),
                    np.array([len(k) // 8 for k in some["keys"]], np.int64), b"".join(some["keys"]))
                yield pd.DataFrame({"chunk": [number], "first": [first], "sets": [blob]})
                number, first = number + 1, first + len(some)

    def read(blob: bytes) -> tuple[list, list[bytes], list[np.ndarray]]:
        leads, null, digests, sizes, keys = ch.load_arrays(blob, np.int64, bool, bytes, np.int64, np.uint64)
        sets = np.split(keys, np.cumsum(sizes)[:-1])
        return [None if n else i for i, n in zip(leads.tolist(), null.tolist())], [digests[i : i + 16] for i in range(0, len(digests), 16)], sets

    units = ch.kept_by_chunk(sets.mapInPandas(unit, "chunk long, first long, sets binary"), "units")
    buckets = ch.bucket_count(units)

    def all_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, blob in zip(frame["chunk"], frame["sets"]):
                keys, counts = _counted(read(blob)[2])
                yield pd.DataFrame(
                    [(chunk, b, ch.dump_keys(keys[i]), ch.dump_arrays(counts[i].astype(np.uint32))) for b, i in ch.key_buckets(keys, buckets)],
                    columns=["chunk", "bucket", "keys", "counts"])

    def second_cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for first, blob in zip(left["first"], left["sets"]):
            leads, digests, sets = read(blob)
            keys, _ = _counted(sets)
            shared, hot = (keys[ch.flags_in_order(keys, buckets, right, i, 2)] for i in (0, 1))
            for i, (lead, digest, s) in enumerate(zip(leads, digests, sets)):
                row = (first + i, lead, digest, len(s))
                if _among(s, shared).sum() < least_shared(len(s)):
                    rows.append((*row, None, None, None))
                else:
                    rows.append((*row, (s >> np.uint64(48)).astype(np.uint16).tobytes(), np.packbits(_among(s, hot)).tobytes(), s.tobytes()))
        out = pd.DataFrame(rows, columns=["set_id", "lead", "digest", "size", "brief", "hot", "keys"])
        return out.assign(lead=out["lead"].astype("Int64"))

    flags = ch.key_counts(units.select("chunk", "sets").mapInPandas(all_keys, "chunk long, bucket int, keys binary, counts binary"), 2, HOT_SETS)
    cut = units.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(second_cut, "set_id long, lead long, digest binary, size long, brief binary, hot binary, keys binary")
    out = ch.kept_by_key(cut, "distinct-sets", "set_id")
    ch.forget(units)
    return out


def _all_close(ids: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs (a, b) of places in the rows of `ids`, as ordered pairs of ids whose sizes allow a link."""
    x, y, m, n = ids[:, a].ravel(), ids[:, b].ravel(), sizes[:, a].ravel(), sizes[:, b].ravel()
    keep = (4 * np.minimum(m, n) >= 3 * np.maximum(m, n)) & (x != y)
    return np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]], axis=1)


def _firsts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A place of each distinct (x, y)."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    return order[np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))] if len(order) else order


def candidates(sets: DataFrame, buckets: int) -> DataFrame:
    """(a, b) pairs of set ids to check, and (a, size, g, h) members of large groups, where b is null.

    All pairs of a group of up to SMALL_GROUP members are given, and a larger group's members with its first hubs.
    Groups of equal members, told by two hashes of the member list, are taken once a bucket.
    """

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), SETS_AT_ONCE):
                some = frame.iloc[start : start + SETS_AT_ONCE]
                signs = [signatures(np.frombuffer(k, np.uint64), np.unpackbits(np.frombuffer(h, np.uint8), count=len(k) // 8).astype(bool)) for k, h in zip(some["keys"], some["hot"])]
                n = list(map(len, signs))
                sign, ids, sizes = np.concatenate(signs), np.repeat(some["set_id"].to_numpy(), n), np.repeat(some["size"].to_numpy(), n)
                yield pd.DataFrame(
                    [(b, ch.dump_arrays(sign[i], ids[i], sizes[i])) for b, i in ch.key_buckets(sign, buckets)], columns=["bucket", "rows"])

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [ch.load_arrays(b, np.uint64, np.int64, np.int64) for b in frame["rows"]]
        sign, ids, sizes = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(sign, kind="stable")
        sign, ids, sizes = sign[order], ids[order], sizes[order]
        starts = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
        counts = np.diff(np.append(starts, len(sign)))
        spread = ch.mixed(ids.view(np.uint64) + np.uint64(1))
        g, h = np.bitwise_xor.reduceat(spread, starts), np.add.reduceat(ch.mixed(spread ^ np.uint64(0x5BD1E995)), starts)
        several = np.flatnonzero(counts > 1)
        groups = several[_firsts(g[several], h[several])]
        pairs, members = [], []
        for n in range(2, SMALL_GROUP + 1):
            at = starts[groups[counts[groups] == n]][:, None] + np.arange(n)
            pairs.append(_all_close(ids[at], sizes[at], *np.triu_indices(n, 1)))
        for k in groups[counts[groups] > SMALL_GROUP].tolist():
            rows = slice(starts[k], starts[k] + counts[k])
            own, size = ids[rows], sizes[rows]
            for number in range(FIRST_HUBS):
                hub = np.full(len(own), np.argmin(ch.mixed(own.view(np.uint64) + np.uint64(number << 48))))
                pairs.append(_all_close(own[None], size[None], hub, np.arange(len(own))))
            members.append(pd.DataFrame({"a": own, "size": size, "g": g[k : k + 1].view(np.int64)[0], "h": h[k : k + 1].view(np.int64)[0]}))
        both = np.concatenate(pairs)
        both = both[_firsts(both[:, 0], both[:, 1])]
        out = pd.concat([pd.DataFrame({"a": both[:, 0], "b": both[:, 1]}), *members])
        return out.reindex(columns=["a", "b", "size", "g", "h"]).astype("Int64")

    sent = sets.select("set_id", "size", "hot", "keys").mapInPandas(send, "bucket int, rows binary")
    return staged(sent.groupBy("bucket").applyInPandas(pair, "a long, b long, size long, g long, h long"), "candidates")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of set ids that link.

    Two bytes of each hash, a quarter of the bytes to move, bound what two sets share from above; only pairs that
    could link by that bound are looked at in full.
    """

    def checked(pairs: DataFrame, column: str, kind) -> DataFrame:
        def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                keep = []
                for x, y, m, n in zip(frame["x"], frame["y"], frame["m"], frame["n"]):
                    x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    keep.append(100 * both >= 75 * (m + n - both))
                yield frame.loc[keep, ["a", "b"]]

        a = sets.select(F.col("set_id").alias("a"), F.col("size").alias("m"), F.col(column).alias("x"))
        b = sets.select(F.col("set_id").alias("b"), F.col("size").alias("n"), F.col(column).alias("y"))
        return pairs.join(b, "b").join(a, "a").mapInPandas(check, "a long, b long")

    return checked(staged(checked(pairs, "brief", np.uint16), "likely"), "keys", np.uint64)


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, label): one label for all sets that links reach, from earlier labels (set_id, label) of the same kind.

    In each round every node goes over to the first of itself and its neighbours in a hash order of the round, and
    links are drawn anew between those; links shrink from round to round until none is left.
    """
    by = labels.select("set_id", "label")
    edges = links.join(by.select(F.col("set_id").alias("a"), F.col("label").alias("x")), "a").join(
        by.select(F.col("set_id").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
    edges = staged(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    round_ = 0
    while not edges.isEmpty():
        def order(node: str) -> Column:
            return F.struct(F.xxhash64(F.lit(round_), F.col(node)).alias("order"), F.col(node).alias("node"))

        ends = edges.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("near")), F.struct(F.col("y").alias("node"), F.col("x").alias("near")))).alias("e")).select("e.*")
        goes = ends.groupBy("node").agg(F.min(order("near")).alias("o")).select("node", F.least("o", order("node"))["node"].alias("to"))
        goes = staged(goes, "goes")
        labels = staged(labels.join(goes.withColumnRenamed("node", "label"), "label", "left").select("set_id", F.coalesce("to", "label").alias("label")), "labels")
        drawn = edges.join(goes.select(F.col("node").alias("x"), F.col("to").alias("v")), "x").join(goes.select(F.col("node").alias("y"), F.col("to").alias("w")), "y").where("v <> w")
        edges = staged(drawn.select(F.least("v", "w").alias("x"), F.greatest("v", "w").alias("y")).distinct(), "edges")
        round_ += 1
    return labels


def open_sets(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, label, size, brief, cluster) of the members of groups that hold several components; sets that such groups
    chain together are a cluster."""
    named = members.join(labels, "set_id")
    several = named.groupBy("g", "h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("set_id").alias("hub")).where("low < high")
    chained = staged(members.join(several.select("g", "h", "hub"), ["g", "h"]).select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct(), "open")
    every = chained.select(F.col("b").alias("set_id")).distinct()
    clusters = components(staged(every.withColumn("label", F.col("set_id")), "labels"), chained.where("a <> b"))
    return staged(sets.select("set_id", "size", "brief").join(clusters.select("set_id", F.col("label").alias("cluster")), "set_id").join(labels, "set_id"), "open-sets")


def across(sets: DataFrame) -> DataFrame:
    """(a, b) sets of different components in one cluster that may link, by a bound from above.

    A cluster's sets are dealt to blocks of BLOCK_SETS by size band and hash; a task compares a block with another of
    its band or the next, all pairs at once, by one product of their bin counts, and returns only pairs that pass. So a
    set travels once a block, not once a pair, and no group is spelled out.
    """
    band = F.floor(F.log(F.col("size") + 0.5) / F.log(F.lit(4 / 3))).cast("int")  # linked sets lie in one band or in neighbours
    placed = sets.withColumn("band", band)
    counts = staged(placed.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks")), "blocks")
    placed = join_sized(placed, counts, ["cluster", "band"])
    for name, step in (("before", 1), ("after", -1)):
        other = counts.select("cluster", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))
        placed = join_sized(placed, other, ["cluster", "band"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")

    def meeting(low: Column, x: Column, y: Column, side: Column, same: bool) -> Column:
        return F.struct(low.alias("low"), F.lit(same).alias("same"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.alias("side"))

    def numbers(n: Column) -> Column:
        return F.slice(F.sequence(F.lit(0), n), F.lit(1), n)

    places = F.concat(
        F.transform(numbers(F.col("blocks")), lambda k: meeting(F.col("band"), F.least(k, own), F.greatest(k, own), (own <= k), True)),
        F.transform(numbers(F.col("after")), lambda k: meeting(F.col("band"), own, k, F.lit(True), False)),
        F.transform(numbers(F.col("before")), lambda k: meeting(F.col("band") - 1, k, own, F.lit(False), False)))
    dealt = placed.select("cluster", "set_id", "label", "size", "brief", F.explode(places).alias("m")).select("cluster", "m.*", "set_id", "label", "size", "brief")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        def bins(part: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(part), BINS), np.float32)
            for row, brief in enumerate(part["brief"]):
                np.add.at(out[row], np.frombuffer(brief, np.uint16).astype(np.int64) * BINS >> 16, 1)
            return out

        left = frame[frame["side"]]
        alone = bool(frame["same"].iloc[0] and frame["x"].iloc[0] == frame["y"].iloc[0])
        right = left if alone else frame[~frame["side"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        most = bins(left) @ (bins(right) > 0).astype(np.float32).T
        total = left["size"].to_numpy()[:, None] + right["size"].to_numpy()[None, :]
        ids, others = left["set_id"].to_numpy(), right["set_id"].to_numpy()
        may = (100 * most >= 75 * (total - most)) & (left["label"].to_numpy()[:, None] != right["label"].to_numpy()[None, :])
        if alone:
            may &= ids[:, None] < others[None, :]
        i, j = np.nonzero(may)
        return pd.DataFrame({"a": np.minimum(ids[i], others[j]), "b": np.maximum(ids[i], others[j])})

    return dealt.groupBy("cluster", "low", "same", "x", "y").applyInPandas(compare, "a long, b long")


def set_labels(sets: DataFrame) -> DataFrame:
    """(set_id, label): components of the sets under their links."""
    labels = staged(sets.select("set_id", F.col("set_id").alias("label")), "labels")
    found = candidates(sets, max(ch.LEAST_BUCKETS, labels.count() // SETS_PER_BUCKET))
    labels = components(labels, staged(similar(found.where("b IS NOT NULL").select("a", "b").distinct(), sets), "links"))
    members = found.where("b IS NULL").select("g", "h", F.col("a").alias("set_id")).distinct()
    rest = open_sets(members, labels, sets)
    return components(labels, staged(similar(across(rest), sets), "links"))


def copy_labels(marked: DataFrame) -> DataFrame:
    """(digest, lead, label): for each distinct set that may link its component."""
    every = distinct_sets(marked)
    labels = set_labels(every.where("keys IS NOT NULL").select("set_id", "size", "brief", "hot", "keys"))
    return every.select("set_id", "digest", "lead").join(labels, "set_id", "left").select("digest", "lead", F.coalesce("label", "set_id").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    chunks = ch.pack(docs, "shingles")
    marked = marked_documents(chunks)
    ch.forget(chunks)
    leads = copy_labels(marked)
    names = leads.groupBy("label").agg(F.min("lead").alias("component_id"))
    known = leads.join(names, "label").select("digest", "component_id")
    alone = marked.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return alone.union(marked.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest").join(known, "digest").select("doc_id", "n_shingles", "component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the one with the least doc_id stays (null last; of equal ids, one row).

    Documents wait in their chunks; only the places of those that go are sent to them.
    """
    chunks = ch.pack(docs, "shingles", whole=True)
    marked = marked_documents(chunks)
    linked = marked.where("digest IS NOT NULL").select("chunk", "row", "doc_id", "digest").join(copy_labels(marked), "digest")
    linked = staged(linked.select("chunk", "row", "doc_id", "label"), "linked")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "chunk", "row")
    stay = linked.groupBy("label").agg(F.min(order).alias("s")).select("s.chunk", "s.row")
    gone = linked.select("chunk", "row").join(stay, ["chunk", "row"], "left_anti")

    def rest(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = []
        out = np.array(right.column("row").to_pylist(), np.int64)
        for blob in left.column("batch").to_pylist():
            batch = ch.from_blob(blob)
            mask = np.ones(batch.num_rows, bool)
            mask[out] = False
            keep.append(batch.filter(pa.array(mask)))
        return pa.concat_tables(keep) if keep else empty

    schema = ch.every_column(docs)[1]
    empty = to_arrow_schema(schema).empty_table()
    kept = chunks.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(rest, schema)
    return ch.renamed_back(kept, docs)
