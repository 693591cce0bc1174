"""Exact quantiles of groups of any size, by selection instead of a sort.

A group of up to LIMIT rows is small enough for one task. Of a larger one, counts in equal intervals
between its extremes tell which interval holds a rank; only that interval is counted again, until it has
LIMIT rows or one value. Each pass is a scan with partial sums; what reaches the driver are BUCKETS counts
for each rank in search, and there are at most rows / LIMIT large groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, BUCKETS = 1_000_000, 1024


@dataclass
class Search:
    """A rank in a group, and the interval that holds it: its extremes, its rows, and those below it."""

    group: int
    rank: int
    low: float
    high: float
    n: int
    below: int = 0

    @property
    def open(self) -> bool:
        return self.n > LIMIT and self.low < self.high


def same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    """Equal keys, null being equal to null."""
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in by])


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Rows (by, names of shares): quantiles with linear interpolation of each group's finite values;
    groups without one are left out, a null key is a group like others."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    exact = [F.percentile("_v", F.array(*map(F.lit, shares.values())))[i].alias(name) for i, name in enumerate(shares)]
    large = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where(F.col("_n") > LIMIT).collect()
    if not large:
        return rows.groupBy(*by).agg(*exact)
    spark, kinds = df.sparkSession, dict(df.dtypes)
    names = "_i int, " + ", ".join(f"`{c}` {kinds[c]}" for c in by)
    keys = F.broadcast(spark.createDataFrame([(i, *[r[c] for c in by]) for i, r in enumerate(large)], names))
    small = rows.join(keys, same(rows, keys, by), "left_anti").groupBy(*by).agg(*exact)
    own = rows.join(keys, same(rows, keys, by)).select("_i", "_v")
    places = {(i, name): share * (r["_n"] - 1) for i, r in enumerate(large) for name, share in shares.items()}
    found = selected(own, [Search(i, rank, large[i]["_low"], large[i]["_high"], large[i]["_n"]) for i, rank in sorted({(i, f(x)) for (i, _), x in places.items() for f in (math.floor, math.ceil)})])

    def between(i: int, x: float) -> float:
        low, high = found[i, math.floor(x)], found[i, math.ceil(x)]
        return low + (high - low) * (x - math.floor(x))

    told = [(*[r[c] for c in by], *[between(i, places[i, name]) for name in shares]) for i, r in enumerate(large)]
    kind = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], *[f"`{name}` double" for name in shares]])
    return small.unionByName(spark.createDataFrame(told, kind))


def selected(rows: DataFrame, searches: list[Search]) -> dict[tuple[int, int], float]:
    """The value at each rank. rows: _i, _v."""
    spark = rows.sparkSession

    def within(some: list[Search]) -> DataFrame:
        at = spark.createDataFrame([(s.group, s.rank, s.low, s.high, s.below) for s in some], "_i int, _rank long, _low double, _high double, _below long")
        return rows.join(F.broadcast(at), "_i").where("_v between _low and _high")

    while left := [s for s in searches if s.open]:
        # Halves, so that the width of the widest interval is a number.
        part = F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * BUCKETS)
        counts = within(left).groupBy("_i", "_rank", F.least(part, F.lit(BUCKETS - 1)).alias("_b")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        listed: dict[tuple[int, int], list] = {}
        for r in counts.collect():
            listed.setdefault((r["_i"], r["_rank"]), []).append((r["_b"], r["n"], r["low"], r["high"]))
        for s in left:
            below = s.below
            for _, n, low, high in sorted(listed[s.group, s.rank]):
                if s.rank < below + n:
                    s.low, s.high, s.n, s.below = low, high, n, below
                    break
                below += n
    out = {(s.group, s.rank): s.low for s in searches if s.low == s.high}
    if rest := [s for s in searches if s.low < s.high]:
        values = F.sort_array(F.collect_list("_v"))
        for r in within(rest).groupBy("_i", "_rank", "_below").agg(values.alias("v")).select("_i", "_rank", F.get("v", (F.col("_rank") - F.col("_below")).cast("int")).alias("x")).collect():
            out[r["_i"], r["_rank"]] = r["x"]
    return out
