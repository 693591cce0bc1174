"""Risk-coverage curves, their summaries, and threshold searches. Ties in confidence move together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import running
from .metrics import scored


def risk_coverage(dec: DataFrame, by: list[str]) -> DataFrame:
    """For each distinct confidence, taken from the top: coverage, risk, and the threshold."""
    rows = scored(dec).select(*by, "conf", F.lit(1).alias("m"), (1 - F.col("correct")).alias("errors"))
    at = running(rows, by, "conf", ["m", "errors"])
    return at.select(*by, F.col("conf").alias("threshold"), "m", F.col("c_m").alias("accepted"), F.col("c_errors").alias("errors"), (F.col("c_m") / F.col("t_m")).alias("coverage"), (F.col("c_errors") / F.col("c_m")).alias("risk"), F.col("t_m").alias("n"))


def aurc(curve: DataFrame, by: list[str]) -> DataFrame:
    """Step integral of the curve."""
    return curve.groupBy(*by).agg(F.sum(F.col("m") / F.col("n") * F.col("risk")).alias("aurc"))


def coverage_at_risk(curve: DataFrame, by: list[str], target: float) -> DataFrame:
    """The largest coverage with risk at most the target; coverage 0 and no threshold if there is none."""
    fits = F.col("risk") <= target
    best = F.max_by(F.struct("coverage", "threshold", "accepted", "errors"), F.when(fits, F.col("coverage")))
    out = curve.groupBy(*by).agg(best.alias("b"))
    return out.select(*by, F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), F.col("b.threshold").alias("threshold"), F.coalesce("b.accepted", F.lit(0)).alias("accepted"), F.coalesce("b.errors", F.lit(0)).alias("errors"))


def cascade_curve(pairs: DataFrame, by: list[str]) -> DataFrame:
    """For each threshold tau of first-stage confidence (and 0): accuracy and escalated share when
    decisions with conf < tau go to the second stage. pairs: conf, c1, c2."""
    rows = pairs.select(*by, "conf", F.lit(1).alias("m"), F.col("c1").cast("long").alias("c1"), F.col("c2").cast("long").alias("c2"))
    at = running(rows, by, "conf", ["m", "c1", "c2"], descending=False)
    point = at.select(*by, F.col("conf").alias("tau"), (F.col("c_m") - F.col("m")).alias("escalated"), (F.col("t_c1") - F.col("c_c1") + F.col("c1") + F.col("c_c2") - F.col("c2")).alias("right"), F.col("t_m").alias("n"))
    ends = rows.groupBy(*by).agg(F.sum("m").alias("n"), F.sum("c1").alias("k1"), F.sum("c2").alias("k2"))
    none = ends.select(*by, F.lit(0.0).alias("tau"), F.lit(0).cast("long").alias("escalated"), F.col("k1").alias("right"), "n")
    all_ = ends.select(*by, F.lit(1 + 1e-9).alias("tau"), F.col("n").alias("escalated"), F.col("k2").alias("right"), "n")
    return point.where("tau > 0").unionByName(none).unionByName(all_)


def best_threshold(curve: DataFrame, by: list[str]) -> DataFrame:
    """The most right decisions, by the least tau."""
    return curve.groupBy(*by).agg(F.min(F.struct((-F.col("right")).alias("k"), "tau", "escalated", "n")).alias("b")).select(*by, "b.tau", (-F.col("b.k")).alias("right"), "b.escalated", "b.n")


def cascade_summary(curve: DataFrame, by: list[str], second: DataFrame) -> DataFrame:
    """best; match: the least escalation that reaches the second stage; retain95: that keeps 95 % of it."""
    c = curve.join(second.select(*by, "k2"), by)
    pick = lambda share: F.min(F.when(F.col("right") >= share * F.col("k2"), F.col("escalated") / F.col("n")))
    return c.groupBy(*by).agg((F.max("right") / F.max("n")).alias("best_accuracy"), pick(1.0).alias("match"), pick(0.95).alias("retain95"), pick(0.99).alias("retain99"))
