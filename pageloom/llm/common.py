"""Helpers that the operators share: shared folder, Arrow batch bounds, streaming groups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a Python worker's memory does not follow the length of texts.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where it is unset, a local master (tests) gets a folder of its own;
    a cluster can't share one, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give back what Arrow's pool of a Python worker holds but no longer uses: workers stay between stages, and an executor's
    memory counts all of them."""
    pa.default_memory_pool().release_unused()


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow or mapInPandas that releases memory once its batches are done."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write a table into the shared folder and read it again."""
    path = table_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A small table, computed once, for the small side of a join: broadcast if it has at most so many rows; a larger one is
    left to a shuffle."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= rows else held


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until it is none of df's columns (which ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def content_key(*columns: str | Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns' values, nulls told apart."""
    parts = [x for c in columns for x in (F.isnull(c), F.col(c) if isinstance(c, str) else c)]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def by_key(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows with equal keys out of batches that are sorted by them; one group is held at a time."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = [0, *(new.nonzero()[0] + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            part = batch.iloc[a:b]
            key = tuple(part[k].iat[0] for k in keys)
            if key != last and held:
                yield last, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            last = key
            held.append(part)
    if held:
        yield last, pd.concat(held) if len(held) > 1 else held[0]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root the smallest node of its component.

    Alternating large-star and small-star steps: each is a grouped minimum (combined before the shuffle) joined back
    on the node, so a hub costs a skewed join that Spark splits, and never a collected neighbour list. Nodes without
    an edge to another node have no row. Every round is checkpointed.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
