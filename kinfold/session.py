"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from spark.checkpoint.dir.

    Only a local master may run without that setting; it then gets a
    temporary folder, which is also its checkpoint folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="kinfold-")
    spark.conf.set("spark.checkpoint.dir", local)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(local)
    return local


_noted: list[list[str]] = []


@contextmanager
def noted_paths() -> Iterator[list[str]]:
    """The paths that are given out meanwhile: who knows when their tables are no longer read can remove them."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted[:] = [p for p in _noted if p is not paths]


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables, on whatever file system the shared folder is."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")
    for paths in _noted:
        paths.append(path)
    return path


def staged(df: DataFrame, label: str, row_group: int | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage of a table that several later steps use: they read
    columns of a Parquet file with known size instead of computing it again,
    and a lost executor costs only its own tasks. `row_group` (bytes) bounds
    what a reader of long arrays decodes at a time.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.option("parquet.block.size", row_group) if row_group else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_sized(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a large table with a derived one that is expected to be small.

    The planner cannot know the size of an aggregate, so it would shuffle the
    large side by the key (a few traits, one of them hot) before it learns
    better. Written first, the aggregate has a known size: below the broadcast
    threshold the large side is not shuffled at all, above it the join is a
    sort-merge join under the adaptive skew rule.
    """
    return big.join(staged(small, "sized"), on, how)
