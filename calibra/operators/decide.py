"""Cascades, gates and risk-controlled thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import running
from .curves import coverage_at_risk, risk_coverage
from .metrics import scored
from .significance import binomial_cdf, clopper_pearson


def merged(pairs: DataFrame, tau: float) -> DataFrame:
    """First-stage decisions with conf < tau take the second stage's."""
    escalate = F.col("conf") < tau
    return pairs.withColumn("escalated", escalate.cast("int")).withColumn("correct", F.when(escalate, F.col("c2")).otherwise(F.col("c1"))).withColumn("latency", F.col("l1") + F.when(escalate, F.col("l2")).otherwise(F.lit(0.0)))


def request_gate(pairs: DataFrame, request: str, tau: float) -> DataFrame:
    """Escalation by request: its least confidence decides. Rows get gate, replace_all (all its
    decisions take the second stage) and replace_low (just those below tau)."""
    gates = pairs.groupBy(request).agg(F.min("conf").alias("gate"))
    out = pairs.join(gates, request)
    go = F.col("gate") < tau
    return out.withColumn("replace_all", F.when(go, F.col("c2")).otherwise(F.col("c1"))).withColumn("replace_low", F.when(go & (F.col("conf") < tau), F.col("c2")).otherwise(F.col("c1"))).withColumn("sent", go.cast("int"))


def realized(dec: DataFrame, by: list[str], thresholds: DataFrame) -> DataFrame:
    """Coverage, errors and risk when decisions with conf >= threshold are accepted; a null threshold
    accepts none."""
    rows = scored(dec).join(F.broadcast(thresholds), by)
    take = F.col("conf") >= F.col("threshold")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(take).alias("accepted"), F.count_if(take & (F.col("correct") == 0)).alias("errors"))
    return out.withColumn("coverage", F.col("accepted") / F.col("n")).withColumn("risk", F.when(F.col("accepted") > 0, F.col("errors") / F.col("accepted")))


def cross_fitted(dec: DataFrame, by: list[str], fold: str, folds: int, target: float) -> DataFrame:
    """Coverage, errors and risk with its one-sided 95 % upper bound, when each fold is accepted by the
    threshold that keeps the others' risk at most the target; a fold without one accepts none."""
    rows = scored(dec)
    others = F.filter(F.array(*map(F.lit, range(folds))), lambda k: k != F.col(fold))
    train = rows.withColumn("_held", F.explode(others))
    found = coverage_at_risk(risk_coverage(train, [*by, "_held"]), [*by, "_held"], target).select(*by, F.col("_held").alias(fold), F.col("threshold").alias("_t"))
    take = F.coalesce(F.col("conf") >= F.col("_t"), F.lit(False))  # a threshold for each group and fold: few rows
    out = rows.join(F.broadcast(found), [*by, fold], "left").groupBy(*by).agg(F.count("*").alias("n"), F.count_if(take).alias("accepted"), F.count_if(take & (F.col("correct") == 0)).alias("errors"))
    upper = clopper_pearson()(F.col("errors"), F.col("accepted"))["upper"]
    return out.select("*", (F.col("accepted") / F.col("n")).alias("coverage"), F.when(F.col("accepted") > 0, F.col("errors") / F.col("accepted")).alias("risk"), upper.alias("risk_upper"))


def intent_gate(dec: DataFrame, by: list[str], thresholds: DataFrame) -> DataFrame:
    """What a threshold accepts in scope, and falsely out of scope."""
    rows = dec.where(F.col("p").isNotNull()).join(F.broadcast(thresholds), by)
    take, inside = F.col("conf") >= F.col("threshold"), F.col("in_scope")
    wrong = ~inside | (F.col("correct") == 0)
    return rows.groupBy(*by).agg(
        F.count_if(take).alias("accepted"), F.count_if(take & wrong).alias("errors"), F.avg(F.when(inside, take.cast("int"))).alias("coverage_in"), F.avg(F.when(~inside, take.cast("int"))).alias("false_acceptance"))


def option_gate(dec: DataFrame, oos_option: int) -> DataFrame:
    """Decisions that chose the out-of-scope option are never routed: conf becomes -1."""
    return dec.withColumn("conf_route", F.when(F.col("pred") == oos_option, F.lit(-1.0)).otherwise(F.col("conf")))


#: 25 linear steps from 0.50 to 0.98 and 25 logarithmic ones from 1 - 1e-2 to 1 - 1e-8.
GRID = [round(0.5 + 0.02 * i, 4) for i in range(25)] + [1.0 - 10.0 ** -(2.0 + 0.25 * i) for i in range(25)]


def learn_then_test(dec: DataFrame, by: list[str], alpha: float, delta: float, grid: list[float] | None = None) -> DataFrame:
    """The least threshold of a fixed grid whose error rate is proven below alpha, with Bonferroni's
    share of delta for each point; with what it accepts. Null, 0 and 0 if none is."""
    points = sorted(set(GRID if grid is None else grid))
    place = sum((F.when(F.col("conf") >= t, 1).otherwise(0) for t in points), F.lit(0))
    rows = scored(dec).select(*by, place.alias("_g"), (1 - F.col("correct")).alias("_e"))
    sums = rows.groupBy(*by, "_g").agg(F.count("*").alias("_m"), F.sum("_e").alias("_e"))
    table = dec.sparkSession.createDataFrame(list(enumerate(points, 1)), "_i int, _t double")
    at = sums.join(F.broadcast(table), F.col("_g") >= F.col("_i")).groupBy(*by, "_i", "_t").agg(F.sum("_m").alias("accepted"), F.sum("_e").alias("errors"))
    proven = binomial_cdf(F.col("errors"), F.col("accepted"), F.lit(alpha)) <= delta / len(points)
    tested = at.withColumn("_ok", proven)
    best = tested.where("_ok").groupBy(*by).agg(F.min(F.struct("_t", "accepted", "errors")).alias("_b"))
    whole = sums.groupBy(*by).agg(F.sum("_m").alias("n"))
    found = whole.join(best, by, "left") if by else whole.crossJoin(F.broadcast(best))
    accepted, errors = F.coalesce("_b.accepted", F.lit(0)), F.coalesce("_b.errors", F.lit(0))
    return found.select(*by, "n", F.col("_b._t").alias("threshold"), accepted.alias("accepted"), errors.alias("errors"), (accepted / F.col("n")).alias("coverage"), F.when(accepted > 0, errors / accepted).alias("risk"))


def accepted_curve(dec: DataFrame, by: list[str]) -> DataFrame:
    rows = scored(dec).select(*by, "conf", F.lit(1).alias("m"), (1 - F.col("correct")).alias("e"))
    return running(rows, by, "conf", ["m", "e"])


def dominated(points: DataFrame, key: str, high: list[str], low: list[str]) -> DataFrame:
    """Points with whether another is at least as good everywhere and better somewhere. The set of
    points is a summary table (models, not decisions); it is broadcast."""
    other = F.broadcast(points.select(*[F.col(c).alias("_" + c) for c in [key, *high, *low]]))
    good = F.lit(True)
    strict = F.lit(False)
    for c in high:
        good, strict = good & (F.col("_" + c) >= F.col(c)), strict | (F.col("_" + c) > F.col(c))
    for c in low:
        good, strict = good & (F.col("_" + c) <= F.col(c)), strict | (F.col("_" + c) < F.col(c))
    beaten = points.join(other, good & strict & (F.col(key) != F.col("_" + key)), "left_semi").select(key).withColumn("dominated", F.lit(True))
    return points.join(beaten, key, "left").withColumn("dominated", F.coalesce("dominated", F.lit(False)))
