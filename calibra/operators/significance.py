"""Resampling, exact tests and family-wise correction."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dealing import kept
from ..functions.hashing import draw, draws

FOLDS = 5


def folds(df: DataFrame, group: str, seed: str, k: int = FOLDS, name: str = "fold") -> DataFrame:
    """df with one of k folds for each group, by a drawn order of groups; sizes differ by one at most.

    Distinct groups are dealt to 256 parts by their draw, so no window holds all of them.
    """
    groups = df.select(group).distinct().withColumn("_d", draw(seed, F.col(group))).withColumn("_b", (F.col("_d") / F.lit(1 << 24)).cast("int"))
    sizes = groups.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_d", group)) - 1
    dealt = groups.withColumn("_i", place).join(F.broadcast(sizes), "_b").select(group, ((F.col("_i") + F.col("_o")) % k).cast("int").alias(name))
    return df.join(dealt, group)


def balanced_folds(sizes: list[tuple[str, int]], k: int = FOLDS) -> dict[str, int]:
    """Greedy: the largest group first, to the lightest fold, the first if tied."""
    load, out = [0] * k, {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        i = min(range(k), key=lambda j: (load[j], j))
        out[name], load[i] = i, load[i] + n
    return out


def with_balanced_folds(df: DataFrame, group: str, k: int = FOLDS, name: str = "fold", most: int = 1_000_000) -> DataFrame:
    """df with a fold of about equal rows for each group. The greedy order depends on all sizes, so they
    are read by the driver: more than `most` groups are refused (`folds` deals any number by a draw)."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    found = sizes.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} groups")
    kind = dict(df.dtypes)[group]
    dealt = df.sparkSession.createDataFrame(list(balanced_folds([(r[0], r[1]) for r in found if r[0] is not None], k).items()), f"`{group}` {kind}, `{name}` int")
    return df.join(dealt, group, "left")


#: Parts that a group's clusters are numbered in, draws that a task counts at a time, clusters of a piece of a
#: group, pieces that meet in one task, and the most replicates that share a task's pieces.
PARTS, DRAWS, RANGE, TOGETHER, SORTED = 256, 1 << 22, 1 << 14, 512, 1 << 7


def cluster_sums(df: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    """One row for each cluster: its sum, its count, and its number k within the group, in a drawn order
    of clusters. Clusters are dealt to PARTS by their draw, so no window holds all of a group's."""
    sums = df.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("m"))
    sums = sums.withColumn("_d", draw("order", F.col(cluster))).withColumn("_b", (F.col("_d") / F.lit((1 << 32) // PARTS)).cast("int"))
    sizes = sums.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows
    sizes = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_d", cluster)) - 1
    return sums.withColumn("k", place).join(sizes, [*by, "_b"]).withColumn("k", F.col("k") + F.col("_o")).drop("_d", "_b", "_o")


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """A piece's sums and counts in the order of its clusters."""
    frame = frame.sort_values("_place")
    return frame[["_at", "_of", "_g", "_part"]].head(1).assign(s=[frame["s"].to_numpy("<f8").tobytes()], m=[frame["m"].to_numpy("<i8").tobytes()])


def _resampled(frame: pd.DataFrame, seed: str, replicates: range) -> pd.DataFrame:
    """Sums (of, g, b, s, m) of what the replicates draw of a task's pieces. Groups of as many clusters draw the
    same numbers, and smaller ones the first of them."""
    kinds = []
    for of, rows in frame.groupby("_of"):
        groups, g = np.unique(rows["_g"], return_inverse=True)
        low = int(rows["_part"].min()) * RANGE
        held = np.zeros((min(int(of), (int(rows["_part"].max()) + 1) * RANGE) - low, 2 * len(groups)))
        for i, part, s, m in zip(g, rows["_part"], rows["s"], rows["m"], strict=True):
            at = slice(part * RANGE - low, part * RANGE - low + len(s) // 8)
            held[at, i], held[at, len(groups) + i] = np.frombuffer(s, "<f8"), np.frombuffer(m, "<i8")
        kinds.append((int(of), groups, low, held))
    most, out = max(of for of, *_ in kinds), []
    step = max(1, DRAWS // most)
    for first in range(replicates.start, replicates.stop, step):
        bs = range(first, min(replicates.stop, first + step))
        times: dict[int, np.ndarray | int] = {}
        for j in range(0, most, DRAWS):
            d = draws(seed, bs, range(j, min(most, j + DRAWS)))
            for of, groups, low, held in kinds:
                if of <= j:
                    continue
                k, n = d[:, : of - j] % np.uint32(of), len(held)
                places = k + n * np.arange(len(bs), dtype=np.int64)[:, None] if len(bs) > 1 else k
                if n < of:
                    places = places[(k >= low) & (k < low + n)] - low
                times[of] = times.get(of, 0) + np.bincount(places.ravel(), minlength=n * len(bs))
                if of <= j + DRAWS:
                    sums = times.pop(of).reshape(len(bs), n).astype(float) @ held
                    s, m = sums[:, : len(groups)], sums[:, len(groups) :]
                    out.append((np.full(s.size, of), np.tile(groups, len(bs)), np.repeat(np.arange(bs.start, bs.stop, dtype=np.int32), len(groups)), s.ravel(), np.rint(m).astype(np.int64).ravel()))
    return pd.DataFrame(dict(zip(["_of", "_g", "b", "s", "m"], map(np.concatenate, zip(*out, strict=True)), strict=True)))


def bootstrap_ratio(df: DataFrame, by: list[str], cluster: str, value: str, replicates: int, seed: str) -> DataFrame:
    """Replicates of a mean with clusters drawn with replacement: rows (by, b, stat).

    Clusters are summed before they are drawn, so decisions never meet draws. The draws are those any
    SQL engine makes (`resampling.drawn` deals them down a tree instead). A draw takes one number, so none is
    ever a row: a task makes the numbers of some replicates and counts them at the clusters of TOGETHER pieces.
    All groups' pieces stand in one line, by size and place, and tasks cut it, so that what a task holds is
    bounded; where it takes several tasks, each makes the numbers again.
    """
    clusters = kept(cluster_sums(df, by, cluster, value))
    sizes = clusters.groupBy(*by).agg(F.count("*").alias("_of"))
    sizes = sizes.withColumn("_g", F.row_number().over(Window.partitionBy("_of").orderBy(*by)).cast("long") - 1)
    # n clusters have at most sqrt(2 n) different sizes of groups.
    kinds = sizes.groupBy("_of").agg(F.count("*").alias("_groups"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("_before", F.coalesce(F.sum(F.col("_groups") * F.ceil(F.col("_of") / RANGE)).over(before), F.lit(0)))
    sizes = kept(sizes.join(kinds, "_of"))
    part = F.floor(F.col("k") / RANGE)
    asked = clusters.join(sizes, by).select(
        (F.col("_before") + part * F.col("_groups") + F.col("_g")).alias("_at"), "_of", "_g", part.alias("_part"), (F.col("k") % RANGE).alias("_place"), F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("s"), "m")
    pieces = asked.groupBy("_at", "_of", "_g", "_part").applyInPandas(_packed, "_at long, _of long, _g long, _part long, s binary, m binary")
    # So many replicates share pieces that these are sent less often than they are drawn from.
    share = min(SORTED, max(16, -(-replicates // SORTED)))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // share) - 1)))
    met = pieces.withColumn("_slot", F.floor(F.col("_at") / TOGETHER)).withColumn("_block", blocks).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_slot", "_block")

    def resampled(frame: pd.DataFrame) -> pd.DataFrame:
        first = int(frame["_block"].iloc[0]) * share
        return _resampled(frame, seed, range(first, min(replicates, first + share)))

    sums = met.groupBy("_slot", "_block").applyInPandas(resampled, "_of long, _g long, b int, s double, m long")
    return sums.groupBy("_of", "_g", "b").agg((F.sum("s") / F.sum("m")).alias("stat")).join(sizes.select(*by, "_of", "_g"), ["_of", "_g"]).select(*by, "b", "stat")


def bootstrap_any(df: DataFrame, by: list[str], cluster: str, statistic: Callable[[pd.DataFrame], float], replicates: int, seed: int, blocks: int = 16) -> DataFrame:
    """Replicates of any statistic of a resampled frame: rows (b, stat) for each group.

    Each group's rows are sent to `blocks` tasks, each of which draws its share of replicates; use it
    for statistics that need all rows, and bootstrap_ratio for means.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["_block"].iloc[0])
        parts = [g for _, g in frame.groupby(cluster, sort=True)]
        out = []
        for b in range(block, replicates, blocks):
            rng = np.random.default_rng([seed, b])
            out.append((b, float(statistic(pd.concat([parts[i] for i in rng.integers(0, len(parts), len(parts))])))))
        found = pd.DataFrame(out, columns=["b", "stat"])
        for c in by:
            found[c] = frame[c].iloc[0]
        return found[[*by, "b", "stat"]]

    kinds = dict(df.dtypes)
    spread = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(min(blocks, replicates) - 1))))
    return spread.groupBy(*by, "_block").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", b int, stat double")


def interval(replicates: DataFrame, by: list[str], value: str = "stat", level: float = 0.95) -> DataFrame:
    """Percentile interval with linear interpolation; nulls and NaN are left out."""
    clean = replicates.where(F.col(value).isNotNull() & ~F.isnan(value))
    half = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(half), F.lit(1 - half)))
    return clean.groupBy(*by).agg(q[0].alias("low"), q[1].alias("high"), F.count("*").alias("replicates"))


def p_two_sided(replicates: DataFrame, by: list[str], value: str = "stat") -> DataFrame:
    """min(1, 2 min((1 + #<=0), (1 + #>=0)) / (B + 1)); the one-sided and the older form beside it."""
    low, high, n = F.count_if(F.col(value) <= 0), F.count_if(F.col(value) >= 0), F.count(value)
    return replicates.groupBy(*by).agg(
        F.least(F.lit(1.0), 2.0 * (1 + F.least(low, high)) / (n + 1)).alias("p"),
        ((1 + low) / (n + 1)).alias("p_one_sided"),
        F.greatest(2.0 * F.least(low / n, high / n), 1.0 / n).alias("p_older"))


def binomial_cdf(k: Column, n: Column, prob: Column) -> Column:
    """P(Bin(n, prob) <= k): a short sum, or the incomplete beta function, so the cost doesn't grow with k."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else 0.0 if a < 0 else 1.0 if a >= b else binomial_tail(int(a), int(b), c) for a, b, c in zip(k, n, p, strict=True)], dtype=float)

    return tail(k.cast("double"), n.cast("double"), prob.cast("double"))


def mcnemar(n01: Column, n10: Column) -> Column:
    """Exact two-sided test of discordant counts; 1 if there are none."""
    n = n01 + n10
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_cdf(F.least(n01, n10), n, F.lit(0.5))))


#: Up to so many terms are summed; beyond it the incomplete beta function takes their place.
TERMS = 200


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized, by its continued fraction (modified Lentz), whose length grows with sqrt(a + b)."""
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1.0 / ((1.0 - (a + b) * x / (a + 1)) or tiny)
    f, m = d, 0
    while True:
        m += 1
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / ((1.0 + top * d) or tiny), (1.0 + top / c) or tiny
            f *= d * c
        if abs(d * c - 1.0) < 1e-15 or m > 100 * (10 + math.sqrt(a + b)):
            return front * f


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    if TERMS < k < n:
        return min(1.0, incomplete_beta(n - k, k + 1, 1.0 - p))
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


def upper_bound(k: int, n: int, alpha: float) -> float | None:
    """One-sided Clopper-Pearson: the p at which k or fewer have probability alpha."""
    if n == 0:
        return None
    if k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > alpha else (low, mid)
    return (low + high) / 2


def clopper_pearson(alpha: float = 0.05):
    """A pandas UDF (k, n) -> struct(low, high, upper): two-sided limits and the one-sided upper one."""

    @F.pandas_udf("low double, high double, upper double")
    def limits(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        known: dict[tuple[int, int], tuple] = {}
        for pair in set(zip(k, n, strict=True)):
            a, b = map(int, pair)
            below = upper_bound(b - a, b, alpha / 2)
            known[pair] = (None if below is None else 1 - below, upper_bound(a, b, alpha / 2), upper_bound(a, b, alpha))
        return pd.DataFrame([known[x] for x in zip(k, n, strict=True)], columns=["low", "high", "upper"]).astype(float)

    return limits


def holm(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Step-down adjusted p within each family of comparisons."""
    order = Window.partitionBy(*family).orderBy(p, tie)
    ranked = df.withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count("*").over(Window.partitionBy(*family)))
    steps = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))
    return ranked.withColumn("holm", F.max(steps).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_m")


def paired(a: DataFrame, b: DataFrame, on: list[str], by: list[str], least: int = 30) -> DataFrame:
    """Two models on the decisions both answered: accuracies, difference, discordant counts, McNemar;
    the test is null below `least` pairs. n01: a right and b wrong."""
    both = a.select(*on, *by, F.col("correct").alias("ca")).join(b.select(*on, F.col("correct").alias("cb")), on)
    found = both.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("ca").alias("acc_a"), F.avg("cb").alias("acc_b"), F.avg(F.col("ca") - F.col("cb")).alias("diff"),
        F.count_if((F.col("ca") == 1) & (F.col("cb") == 0)).alias("n01"), F.count_if((F.col("ca") == 0) & (F.col("cb") == 1)).alias("n10"))
    return found.withColumn("mcnemar_p", F.when(F.col("n") >= least, mcnemar(F.col("n01"), F.col("n10"))))
