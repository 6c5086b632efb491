"""The corpus pipeline, stage by stage, against plain Python on what each stage was given."""

import corpus_pipeline
import plain
import public_tokenizers
import tiktoken
from kinfold.llm import mixing, secret_links, word_bpe
from kinfold.session import staged


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, given, out = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        docs = out[name] = staged(stage(spark, docs, sf), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    def ids(df):
        return sorted(r["doc_id"] for r in df.select("doc_id").collect())

    start = given["language"].collect()
    assert set(ids(out["language"])) <= set(ids(given["language"])) and out["language"].count() >= 0.98 * len(start)
    rows = [(r["doc_id"], r["text"]) for r in given["near_copies"].collect()]
    assert ids(out["near_copies"]) == sorted({c for _, _, c in plain.components(rows)})
    secret = {r["doc_id"]: r["text"] for r in out["secrets"].collect()}
    for r in given["secrets"].collect():
        spans = plain.strong_spans(r["text"])
        assert not plain.strong_spans(secret[r["doc_id"]]) and (spans or secret[r["doc_id"]] == r["text"] or "://" in r["text"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(given["mixture"]).collect()}
    words = dict.fromkeys(taken, 0)
    for r in out["mixture"].collect():
        words[r["doc_id"]] += len(plain.words(r["text"]))
    assert words == taken
    ranks = word_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"], tuple(encoding.encode_ordinary(r["text"]))) for r in given["tokens"].collect())
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in out["tokens"].collect()) == want


def test_empty_and_awkward(spark, awkward, empty):
    for docs in (awkward, empty):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = staged(stage(spark, rows, ""), f"test-{name}")
        assert rows.count() > 0 or not docs.count()


def test_mark_is_no_secret():
    assert not plain.strong_spans(secret_links.MARK)


def test_stages_compose_lazily(spark, awkward):
    """No stage removes what the lazy result of its predecessor has yet to read."""
    written = lazy = awkward
    for name, stage in corpus_pipeline.STAGES:
        written = staged(stage(spark, written, ""), f"test-{name}")
    for _, stage in corpus_pipeline.STAGES:
        lazy = stage(spark, lazy, "")

    def rows(df):
        return sorted(map(str, df.select(*sorted(df.columns)).collect()))

    assert rows(lazy) == rows(written)
