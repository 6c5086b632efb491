"""Fill-in-the-middle beside plain slicing, chunk ends, and the cache."""

import hashlib
import random
import re

import numpy as np
import plain
import pytest
from conftest import rows_of
from kinfold.llm import fill_middle as fm

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def plain_rows(rows):
    out = []
    for doc_id, text in rows:
        text = text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, _, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        if not text or "<P>" in text or "<S>" in text or "<M>" in text:
            out.append((doc_id, len(units), "plain", None, None, plain.sha(text), plain.sha(text)))
        elif h4 % 100 < 50:
            out.append((doc_id, len(units), "spm", len(pre), len(mid), plain.sha(f"<S>{suf}<P>{pre}<M>{mid}"), plain.sha(text)))
        else:
            out.append((doc_id, len(units), "psm", len(pre), len(mid), plain.sha(f"<P>{pre}<S>{suf}<M>{mid}"), plain.sha(text)))
    return out


def same(df, rows):
    got = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(plain_rows(rows), key=repr)


@pytest.fixture(params=["awkward", "documents", "empty"])
def table(request):
    return request.getfixturevalue(request.param)


def test_table(table):
    same(fm.digests(table), rows_of(table))


def test_lines_and_marks(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["\n", "\n\n", "a", "<", "<S", "P>", "M>", ">", "é\U0001F600", "line of text ", "\r\n"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(1000, "\n" * 5000), (1001, "x" * 100_000), (1002, "same line\n" * 30_000), (1003, "<P>"), (1004, None), (None, "a\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["form"] for r in fm.transform(df).collect()} == {"plain", "psm", "spm"}
    same(fm.digests(df), rows)


def test_rates(spark):
    df = spark.createDataFrame([(i, f"one\ntwo {i}\nthree") for i in range(200)], "doc_id long, text string")
    forms = [r["form"] for r in fm.transform(df, seed=8, rate=50, spm_share=100).collect()]
    assert set(forms) == {"plain", "spm"} and 60 < forms.count("plain") < 140


def test_shared_passages_are_cut_alike():
    rng = random.Random(2)
    passage = bytes(rng.randrange(97, 123) for _ in range(5000))
    ends = []
    for front in (b"", b"some words before ", bytes(rng.randrange(97, 123) for _ in range(700))):
        data = np.frombuffer(front + passage, np.uint8)
        ends.append({e - len(front) for e in fm.chunk_ends(data, np.zeros(1, np.int64)).tolist()} - set(range(17)))
    assert ends[0] == {e for e in ends[1] if e > 0} == {e for e in ends[2] if e > 0} and len(ends[0]) > 8


def test_cache_by_content():
    cache = fm.Cache(limit=2000)
    rng = random.Random(9)
    prose = "".join(rng.choice("abcde \n") for _ in range(6000))
    texts = [prose, "new " * 500, prose]
    first = list(fm.rearranged([1, 2, 3], texts, fm.Cache(), 7, 100, 50))
    assert first == list(fm.rearranged([1, 2, 3], texts, cache, 7, 100, 50)) and cache.held <= 2200
    large = fm.Cache()
    list(fm.rearranged([1], texts[:1], large, 7, 100, 50))
    before = large.misses
    list(fm.rearranged([3], texts[2:], large, 7, 100, 50))
    assert large.misses == before  # the same text again is looked up
