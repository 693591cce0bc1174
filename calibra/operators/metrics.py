"""Accuracy, proper scores and calibration of decisions, by any grouping.

Inputs are judged decisions: p array<double>, y int, pred, conf, correct, and an order `ord` for ties.
Rows without an answer or a label are left out; they are not errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.ranking import ranked

BINS = 10


def scored(dec: DataFrame) -> DataFrame:
    return dec.where(F.col("y").isNotNull() & F.col("p").isNotNull())


def nll(p: Column, y: Column) -> Column:
    return -F.ln(F.greatest(V.at(p, y), F.lit(V.FLOOR)))


def point_scores(dec: DataFrame, by: list[str]) -> DataFrame:
    """n, accuracy, nll, nll_norm, brier, mean_conf, share_high, acc_high, distinct_conf in one pass."""
    high = F.col("conf") >= 0.9
    return scored(dec).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("correct").alias("accuracy"),
        F.avg(nll(F.col("p"), F.col("y"))).alias("nll"),
        F.avg(nll(V.normalized(F.col("p")), F.col("y"))).alias("nll_norm"),
        F.avg(V.squared_error(F.col("p"), F.col("y"))).alias("brier"),
        F.avg("conf").alias("mean_conf"),
        F.avg(high.cast("int")).alias("share_high"),
        F.avg(F.when(high, F.col("correct"))).alias("acc_high"),
        # Rounded as engines round doubles, by the product: ties of the printed decimal fall otherwise.
        F.count_distinct(F.round(F.col("conf") * 1e6)).alias("distinct_conf"),
    )


def coverage(dec: DataFrame, by: list[str]) -> DataFrame:
    return dec.groupBy(*by).agg(F.count("p").alias("answered"), F.count("*").alias("total"))


def macro_f1(dec: DataFrame, by: list[str], classes: int | None = None) -> DataFrame:
    """Mean F1 over classes that occur; with `classes`, over that many, absent ones as 0."""
    both = F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("gold")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("gold"))))
    cells = scored(dec).select(*by, "correct", both.alias("x")).groupBy(*by, F.col("x.c").alias("c")).agg(
        F.sum(F.when(F.col("x.gold") == 1, F.col("correct")).otherwise(0)).alias("tp"), F.count("*").alias("marks"))
    f1 = 2.0 * F.col("tp") / F.col("marks")
    return cells.groupBy(*by).agg((F.sum(f1) / (F.lit(classes) if classes else F.count("*"))).alias("macro_f1"))


def binned(dec: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """Decisions with their equal-mass bin: ranks by (conf, ord), edges i n / bins rounded half to even."""
    rows = ranked(scored(dec), by, "conf", ["ord"])
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda b: F.bround(b * F.col("n") / F.lit(float(bins))).cast("long"))
    return rows.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col("r"))))


def reliability(dec: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    return binned(dec, by, bins).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("correct").alias("acc"))


def ece(dec: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """Expected calibration error over equal-mass bins."""
    return reliability(dec, by, bins).groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def murphy(dec: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """Reliability, resolution, uncertainty and the within-bin residual of the top-label Brier score."""
    cells = binned(dec, by, bins).groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("correct").alias("a"), F.sum("correct").alias("s"), F.sum(F.pow(F.col("conf") - F.col("correct"), 2.0)).alias("brier"))
    whole = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("base"), (F.sum("brier") / F.sum("n")).alias("brier_top"),
        (F.sum(F.col("n") * F.pow(F.col("c") - F.col("a"), 2.0)) / F.sum("n")).alias("reliability"),
        (F.sum(F.col("n") * F.pow("a", 2.0)) / F.sum("n")).alias("square"))
    out = whole.withColumn("resolution", F.col("square") - F.pow("base", 2.0)).withColumn("uncertainty", F.col("base") * (1 - F.col("base")))
    return out.select(*by, "n", "reliability", "resolution", "uncertainty", (F.col("brier_top") - F.col("reliability") + F.col("resolution") - F.col("uncertainty")).alias("residual"), "brier_top")


def auroc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Mann-Whitney with half ties; null if a class is empty. Counts by distinct score, then running
    totals: no sorted partition of a whole group."""
    from ..functions.ranking import running

    rows = df.select(*by, score, F.when(F.col(positive), 1).otherwise(0).cast("long").alias("pos"), F.when(F.col(positive), 0).otherwise(1).cast("long").alias("neg"))
    at = running(rows, by, score, ["pos", "neg"], descending=False)
    wins = F.sum(F.col("pos") * (F.col("c_neg") - F.col("neg") + F.col("neg") / 2.0))
    found = at.groupBy(*by).agg(wins.alias("wins"), F.max("t_pos").alias("p"), F.max("t_neg").alias("n"))
    return found.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p") * F.col("n"))).alias("auroc"))


def soft_scores(dec: DataFrame, by: list[str], soft: str = "soft") -> DataFrame:
    """The teacher's mass at the prediction, and the squared distance to the teacher."""
    return dec.where(F.col(soft).isNotNull()).groupBy(*by).agg(F.avg(V.at(F.col(soft), F.col("pred"))).alias("soft_accuracy"), F.avg(V.squared_distance(F.col("p"), F.col(soft))).alias("soft_brier"))


def scope_summary(dec: DataFrame, by: list[str]) -> DataFrame:
    """Confidence in and out of scope, and how well it tells them apart."""
    s = dec.where(F.col("p").isNotNull())
    means = s.groupBy(*by).agg(
        F.avg(F.when(F.col("in_scope"), F.col("conf"))).alias("mean_conf_in"), F.avg(F.when(~F.col("in_scope"), F.col("conf"))).alias("mean_conf_out"),
        F.avg(F.when(~F.col("in_scope"), (F.col("conf") >= 0.9).cast("int"))).alias("share_out_high"))
    return means.join(auroc(s, by, "conf", "in_scope"), by)


def position_shares(dec: DataFrame, by: list[str], options: int) -> DataFrame:
    """Where predictions and labels fall among the options, and accuracy by the label's fifth."""
    s = scored(dec)
    fifth = F.floor(5 * F.col("y") / options).cast("int")
    return s.groupBy(*by, fifth.alias("gold_fifth")).agg(
        F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg((F.col("pred") == 0).cast("int")).alias("first_share"), F.avg((F.col("pred") == options - 1).cast("int")).alias("last_share"))


def position_fifths(dec: DataFrame, by: list[str], options: Column) -> DataFrame:
    """Shares of predictions and of labels in each fifth of the options' order: rows for all five."""
    s = scored(dec)
    fifth = lambda c: F.floor(5 * F.col(c) / options).cast("int")
    counts = s.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(fifth(c) == i).alias(f"{c}{i}") for c in ("pred", "y") for i in range(5)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("fifth"), (F.col(f"pred{i}") / F.col("n")).alias("predicted_share"), (F.col(f"y{i}") / F.col("n")).alias("gold_share")) for i in range(5)]))
    return counts.select(*by, "n", each.alias("_x")).select(*by, "n", "_x.*")
