"""Ranks and running totals of scores in [0, 1] without one sorted partition for a whole group.

Scores are cut into buckets. What lies before a bucket is a sum over at most BUCKETS rows for each
group; inside, a window orders one bucket only. So a group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def _bucket(score: Column, descending: bool) -> Column:
    b = F.least(F.floor(score * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    return (F.lit(BUCKETS - 1) - b) if descending else b


def ranked(df: DataFrame, by: list[str], score: str, ties: list[str], name: str = "r") -> DataFrame:
    """df with the 0-based rank of each row in its group by (score, ties), and the group's size n."""
    cut = df.withColumn("_b", _bucket(F.col(score), False))
    sizes = cut.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy(*by)))
    inside = Window.partitionBy(*by, "_b").orderBy(score, *ties)
    return cut.withColumn("_i", F.row_number().over(inside) - 1).join(sizes.drop("_n"), [*by, "_b"]).withColumn(name, F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")


def running(df: DataFrame, by: list[str], score: str, values: list[str], descending: bool = True) -> DataFrame:
    """One row for each group and distinct score: the values' totals over all scores up to and
    including it (c_<value>), and over the whole group (t_<value>)."""
    blocks = df.groupBy(*by, score).agg(*[F.sum(v).alias(v) for v in values]).withColumn("_b", _bucket(F.col(score), descending))
    sums = blocks.groupBy(*by, "_b").agg(*[F.sum(v).alias(v) for v in values])
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_b", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o_{v}") for v in values], *[F.sum(v).over(whole).alias(f"t_{v}") for v in values])
    order = F.desc(score) if descending else F.asc(score)
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.select(*by, "_b", score, *values, *[F.sum(v).over(inside).alias(f"_i_{v}") for v in values]).join(offsets, [*by, "_b"])
    return out.select(*by, score, *values, *[(F.col(f"_i_{v}") + F.col(f"_o_{v}")).alias(f"c_{v}") for v in values], *[f"t_{v}" for v in values])


def numbered(df: DataFrame, key: str, name: str = "r") -> DataFrame:
    """df with consecutive numbers from 1 by a numeric key without nulls; equal keys are numbered in any order."""
    ends = df.agg(F.min(key).cast("double").alias("low"), F.max(key).cast("double").alias("high")).first()
    width = ((ends["high"] - ends["low"]) if ends["low"] is not None else 0.0) or 1.0
    scaled = df.withColumn("_s", (F.col(key).cast("double") - F.lit(ends["low"] or 0.0)) / width)
    return ranked(scaled, [], "_s", [key], name).withColumn(name, F.col(name) + 1).drop("_s", "n")
