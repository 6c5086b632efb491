"""A corpus in five stages: documents in, token ids of the mixed and cleaned corpus out.

Every stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns
of `documents`. Documents whose language is undetermined go; one document of each group of near copies stays;
secrets are cut out of the texts; sources are mixed to their weights (a document that the mix takes twice is there
twice, words that it leaves are gone); texts become token ids, with the digest of what the ids decode to.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import gru_langid, mixing, partenum, secret_links, word_bpe
from kinfold.session import noted_paths, remove_paths, staged

_left: dict[str, list[str]] = {}  # by application: what earlier stages have staged and may still be read


def _reads(docs: DataFrame, paths: list[str]) -> bool:
    """Whether a stage's input still reads what an earlier stage staged: so it does until it is written and reread."""
    names = {os.path.basename(p) for p in paths}
    return any(not names.isdisjoint(file.split("/")) for file in docs.inputFiles())


def _stage(stage):
    """Stages can be composed lazily. What earlier ones staged goes when a stage's input no longer reads any of it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _left.pop(spark.sparkContext.applicationId, [])
        if stage.__name__ == STAGES[0][0]:  # what another run has staged may still be read
            before = []
        if before and not _reads(docs, before):
            remove_paths(spark, before)
            before = []
        with noted_paths() as paths:
            out = stage(spark, docs, sf_dir)
        _left[spark.sparkContext.applicationId] = before + paths
        return out

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return gru_langid.keep_identified(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.one_of_each(docs)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_links.redact(docs)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = word_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return word_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language", language), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]
ORACLE_SQL = None  # a trained network and a tokenizer are beyond SQL; the tests hold each stage against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
