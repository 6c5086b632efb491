"""Benchmark passages beside a scan of every document, and the index beside its documents."""

import re
from collections import Counter

import numpy as np
import plain
import pytest
from conftest import rows_of
from kinfold.llm import positional_index as pi

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"]
ITEMS = "item_id long, text string, lang string, spans int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.lowered(text or ""))


def plain_matches(rows, items, window=10, reach=16):
    """(doc_id, n_words, hit places, items, near items) of every row."""
    texts = [words(t) for _, t in rows]
    counts = Counter(w for t in texts for w in t)
    owners = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[i : i + window]), set()).add(item_id)
    out = []
    for (doc_id, _), t in zip(rows, texts):
        hit, ids, near, at = set(), set(), set(), {}
        for i, w in enumerate(t):
            at.setdefault(w, []).append(i)
        for k in {len(win) for win in owners}:
            for i in range(len(t) - k + 1):
                if who := owners.get(tuple(t[i : i + k])):
                    hit.update(range(i, i + k))
                    ids |= who
        for win, who in owners.items():
            if set(win) <= at.keys():
                rarest = min(win, key=lambda w: (counts[w], w))
                if any(set(win) <= set(t[max(0, i - reach) : i + reach + 1]) for i in at[rarest]):
                    near |= who
        out.append((doc_id, len(t), hit, *(sorted(str(i) for i in s - {None}) for s in (ids, near))))
    return out


def same(df, want):
    want = [(d, n, len(h), len(i), plain.sha(",".join(i)), bool(h), len(m)) for d, n, h, i, m in want]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr) == sorted(want, key=repr)


def awkward_items(spark):
    rows = [(1, plain.PROSE), (2, "the quick brown fox!"), (3, None), (4, " .,- "), (5, plain.GERMAN.upper()), (5, plain.GERMAN), (None, "old man reads his"),
            (10, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (11, "never_seen words"), (12, "é\U0001F600ß"), (13, "fox the lazy over jumps dog")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], ITEMS).repartition(2)


def test_awkward(spark, awkward):
    items = awkward_items(spark)
    want = plain_matches(rows_of(awkward), [(r["item_id"], r["text"]) for r in items.collect()])
    assert sum(bool(w[2]) for w in want) > 5 and any(len(w[4]) > len(w[3]) for w in want)
    same(pi.contamination(awkward, items), want)


@pytest.mark.parametrize("shard_bytes, block_bytes", [(600, 200), (1 << 20, 100), (1, 1 << 20)])
def test_shards_and_blocks(spark, awkward, shard_bytes, block_bytes):
    """Spans, item ids and proximity do not depend on how documents and items are dealt out."""
    items = awkward_items(spark)
    for window, reach in ((3, 5), (10, 16)):
        want = plain_matches(rows_of(awkward), [(r["item_id"], r["text"]) for r in items.collect()], window, reach)
        got = pi.matches(awkward, items, window, reach, shard_bytes, block_bytes).collect()
        got = [(r["doc_id"], r["n_words"], {i for s in r["spans"] for i in range(s["start"], s["stop"])}, list(r["items"]), list(r["near_items"])) for r in got]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_documents(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain_matches(rows_of(documents), [(r["item_id"], r["text"]) for r in items.collect()])
    same(pi.contamination(documents, items), want)


def test_without_rows(spark, awkward, empty):
    items = awkward_items(spark)
    assert pi.contamination(empty, items).count() == 0
    none = pi.contamination(awkward, items.where("item_id = 3"))
    assert none.count() == awkward.count() and not none.where("contaminated OR n_near_items > 0").count()


def test_index_holds_every_word(awkward):
    index = pi.build(awkward, 2000)
    docs = {(r["shard"], r["doc_no"]): r for r in index.where("kind = 'doc'").collect()}
    found = Counter()
    for r in index.where("kind = 'term'").collect():
        places = pi.places_of(r["places"])
        assert len(places) == r["n"] and (np.diff(places) > 0).all()
        found[r["term"]] += len(places)
    assert found == Counter(w for _, t in rows_of(awkward) for w in words(t)) and len(docs) == awkward.count()


def test_packed_steps():
    steps = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**40, 5])
    assert (pi.places_of(pi.packed(steps)[0]) == np.cumsum(steps)).all()
