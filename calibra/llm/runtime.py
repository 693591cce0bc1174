"""What the operators share: cutting lineage, reading tables, groups of linked items."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key column that may be broadcast (8 bytes each); beyond it, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder that spark.checkpoint.dir names.

    A lost executor costs a reread of the files only. Where the setting is absent and all runs on this
    machine, as in tests, a temporary folder serves.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return folder.get()


#: Bytes of an Arrow batch on its way to Python, about; Spark's own 64 MB are held by the executor and the
#: worker of every task.
BATCH_BYTES = 2 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed meanwhile (not what is only planned) goes to Python in batches of BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(column: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def semi(df: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows of df whose `on` is in keys (left_anti: isn't): by broadcast if keys are few enough, else
    by a shuffled join."""
    return df.join(small(keys), on, how)


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Edges that one task contracts, about.
CONTRACTED = 500_000


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges (u, v) as stars: each node with the least node that it reaches here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 1 << 16):
        some = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, root), root being the least node
    reachable.

    Each part of the edges is contracted to stars by itself. While there are several parts,
    large-star and small-star steps, each a grouped minimum and a join, follow until the edges of all
    are stars; the number of rounds grows with the logarithm of the longest path. Nothing is
    collected; loops and repeated edges are allowed.
    """

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v")
    parts = -(-now.count() // CONTRACTED)
    now = cut((now.coalesce(1) if parts <= 1 else now.repartition(parts)).mapInArrow(contracted, "u long, v long"))
    state = digest(now) if parts > 1 else None
    while parts > 1:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = cut(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        if (after := digest(now)) == state:
            break
        state = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
