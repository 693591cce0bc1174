"""Resampling by weights against replicates whose rows are really copied."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from support import SF

from calibra import catalog
from calibra.operators import calibration, comparison, resampling, significance
from calibra.plans.derived import decisions, judged
from calibra.plans.evaluation import _cascade
from pyspark.sql import functions as F

B = 6


@pytest.fixture(scope="module", autouse=True)
def small_buckets():
    """So that the small table has many."""
    whole, resampling.BUCKET_ROWS = resampling.BUCKET_ROWS, 150
    yield
    resampling.BUCKET_ROWS = whole


@pytest.fixture(scope="module")
def frame(spark):
    return judged(decisions(spark, SF)).where("model <> 'gamma'").select("model", "item", "type", "grp", "p", "y", "conf", "correct", "in_scope").toPandas()


@pytest.fixture(scope="module")
def dec(spark, frame):
    return spark.createDataFrame(frame.assign(p=frame["p"].map(list))).repartition(3, "item")


def told(df, by, cluster, replicates, seed):
    """(key, cluster) -> (times, fold), of one byte for each replicate."""
    return {(tuple(r[c] for c in by), r[cluster]): (np.frombuffer(r["times"], "u1"), np.frombuffer(r["fold"], "u1")) for r in resampling.drawn(df, by, cluster, replicates, seed).collect()}


def ece(conf, correct, order):
    at = np.lexsort((order, conf))
    conf, correct = np.asarray(conf, float)[at], np.asarray(correct, float)[at]
    edges = np.round(np.arange(11) * len(conf) / 10).astype(int)
    return sum((b - a) * abs(conf[a:b].mean() - correct[a:b].mean()) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a) / len(conf)


def copied(part, key, draws, b):
    """The rows of a replicate, as many copies of each as it draws."""
    times = np.array([draws[key, g][0][b] for g in part["grp"]])
    out = part.iloc[np.repeat(np.arange(len(part)), times)].copy()
    out["fold"] = [draws[key, g][1][b] for g in out["grp"]]
    return out


def test_draws_are_whole_alike_in_any_partitioning_and_dealt_evenly(spark):
    df = spark.createDataFrame([(g, f"c{i}") for g, n in (("a", 5000), ("b", 3), ("d", 1)) for i in range(n)] + [("b", None)], "g string, c string")
    got = told(df, ["g"], "c", 40, "s")
    assert got.keys() == told(df.repartition(7, "c"), ["g"], "c", 40, "s").keys()
    again = told(df.repartition(7, "c"), ["g"], "c", 40, "s")
    assert all((got[k][0] == again[k][0]).all() and (got[k][1] == again[k][1]).all() for k in got)
    for g, n in (("a", 5000), ("b", 3), ("d", 1)):
        times, fold = (np.stack([v[i] for k, v in got.items() if k[0] == (g,)]) for i in (0, 1))
        assert times.shape == (n, 40) and (times.sum(0) == n).all()
        assert ((fold == resampling.UNDRAWN) == (times == 0)).all()
        for b in range(40):
            sizes = np.bincount(fold[times[:, b] > 0, b], minlength=5)
            assert sizes.max() - sizes.min() <= 1
    big = np.stack([v[0] for k, v in got.items() if k[0] == ("a",)])
    # Multinomial: a cluster's draws have a variance of about 1, and the drawn share is 1 - 1 / e.
    assert abs(big.var() - 1) < 0.03 and abs((big > 0).mean() - (1 - np.exp(-1))) < 0.01
    assert abs(np.corrcoef(big[:, 0], big[:, 1])[0, 1]) < 0.06


def test_splits_go_down_the_tree():
    counts = np.array([3, 0, 10, 7])
    k = resampling.split_draws(counts, 500, 1)
    assert (k.sum(0) == 20).all() and (k[1] == 0).all()
    assert np.allclose(k.mean(1), counts, atol=0.5)
    assert np.allclose(k.var(1), counts * (1 - counts / 20), atol=1.0)


def test_weighted_statistics_equal_copied_rows(spark, dec, frame):
    rows = dec.withColumn("conf", F.floor(F.col("conf") * 10) / 10).join(resampling.drawn(dec, ["model"], "grp", B, "w"), ["model", "grp"])
    draws = told(dec, ["model"], "grp", B, "w")
    stats = {(r["model"], r["b"]): r["stat"] for r in resampling.weighted_ece(rows, ["model"], "conf", "correct", ["item"], B).collect()}
    areas = {(r["model"], r["b"]): r["stat"] for r in resampling.weighted_area(rows, ["model"], "conf", "in_scope", B).collect()}
    means = {(r["model"], r["b"]): r["stat"] for r in resampling.weighted_mean(dec, ["model"], "correct", "grp", resampling.drawn(dec, ["model"], "grp", B, "w"), B).collect()}
    assert len(stats) == len(areas) == 2 * B
    for model, part in frame.assign(conf=np.floor(frame["conf"] * 10) / 10).groupby("model"):
        for b in range(B):
            drawn = copied(part, (model,), draws, b)
            assert stats[model, b] == pytest.approx(ece(drawn["conf"], drawn["correct"], drawn["item"]))
            assert means[model, b] == pytest.approx(drawn["correct"].mean())
            pos, neg = drawn["conf"][drawn["in_scope"]].to_numpy()[:, None], drawn["conf"][~drawn["in_scope"]].to_numpy()
            assert areas[model, b] == pytest.approx(((pos > neg) + (pos == neg) / 2).mean())


def test_refitted_calibration_error(spark, dec, frame):
    got = {(r["model"], r["what"], r["b"]): r["stat"] for r in resampling.refit_ece(dec, ["model"], "grp", ["item"], B, "e").collect()}
    draws, grid = told(dec, ["model"], "grp", B, "e"), np.array(calibration.grid(*calibration.WIDE))
    assert len(got) == 4 * B
    for model, part in frame.groupby("model"):
        for b in range(B):
            drawn = copied(part, (model,), draws, b)
            logs = np.log(np.maximum(np.stack(drawn["p"].to_numpy()), 1e-6))
            nll = np.empty((len(drawn), len(grid)))
            for g, t in enumerate(grid):
                e = np.exp(logs / t)
                nll[:, g] = -np.log(np.maximum(e[np.arange(len(drawn)), drawn["y"]] / e.sum(1), 1e-6))
            conf = np.empty(len(drawn))
            for k in range(5):
                t = grid[np.round(nll[drawn["fold"] != k].sum(0), 6).argmin()]
                e = np.exp(logs / t)
                conf[drawn["fold"] == k] = (e.max(1) / e.sum(1))[drawn["fold"] == k]
            assert got[model, "shipped", b] == pytest.approx(ece(drawn["conf"], drawn["correct"], drawn["item"]))
            assert got[model, "scaled", b] == pytest.approx(ece(conf, drawn["correct"], drawn["item"]), abs=1e-9)


def test_refitted_cascade(spark):
    pairs = _cascade(spark, SF).withColumn("conf", F.round("conf", 2))
    got = {(r["type"], r["b"]): r for r in resampling.refit_cascade(pairs, ["type"], "grp", B, "c", "l1", "l2").collect()}
    draws = told(pairs, ["type"], "grp", B, "c")
    for kind, part in pairs.toPandas().groupby("type"):
        for b in range(B):
            d = copied(part, (kind,), draws, b)
            up = np.zeros(len(d), bool)
            for k in range(5):
                train, held = d[d["fold"] != k], (d["fold"] == k).to_numpy()
                taus = sorted({0.0, resampling.TOP, *train["conf"]})
                right = [np.where(train["conf"] < t, train["c2"], train["c1"]).sum() for t in taus]
                up[held] = (d["conf"] < taus[int(np.argmax(right))])[held]
            r, correct = got[kind, b], np.where(up, d["c2"], d["c1"])
            assert r["accuracy"] == pytest.approx(correct.mean())
            assert r["gain"] == pytest.approx(correct.mean() - max(d["c1"].mean(), d["c2"].mean()))
            assert r["escalated"] == pytest.approx(up.mean())
            assert r["cost_fraction"] == pytest.approx((d["l1"].sum() + d["l2"][up].sum()) / d["l2"].sum())


def test_paired_metrics(spark, frame):
    """Both sides share the draws; Holm's family is the members within type and metric."""
    frame = frame.assign(flip=frame["item"] % 3 % 2)
    names = ["conf", "correct", "flip"]
    base = frame[frame["model"] == "beta"][["item", *names]].rename(columns={c: f"{c}_b" for c in names})
    both = frame[frame["type"].isin(["1", "2"])].merge(base, on="item").drop(columns=["p", "y"])
    both["conf_b"] = both["conf_b"].round(2)
    pairs = spark.createDataFrame(both)
    got = {(r["type"], r["model"], r["metric"]): r for r in comparison.paired_metrics(pairs, ["type"], "model", "grp", "item", 9, "p").collect()}
    assert len(got) == 2 * 2 * 4
    draws = told(pairs, ["type", "model"], "grp", 9, "p")
    for (kind, model), part in both.groupby(["type", "model"]):

        def area(d, c):
            pos, neg = d[c][d["in_scope"]].to_numpy()[:, None], d[c][~d["in_scope"]].to_numpy()
            return ((pos > neg) + (pos == neg) / 2).mean()

        def stats(d):
            return {"accuracy": 100 * (d["correct"].mean() - d["correct_b"].mean()), "ece": 100 * (ece(d["conf"], d["correct"], d["item"]) - ece(d["conf_b"], d["correct_b"], d["item"])), "auroc": area(d, "conf") - area(d, "conf_b"), "flips": 100 * (d["flip"].mean() - d["flip_b"].mean())}

        whole, again = stats(part), pd.DataFrame([stats(copied(part, (kind, model), draws, b)) for b in range(9)])
        for metric, diff in whole.items():
            r, v = got[kind, model, metric], again[metric]
            assert r["n"] == len(part) and r["clusters"] == part["grp"].nunique()
            assert r["diff"] == pytest.approx(diff, abs=1e-9)
            assert (r["low"], r["high"]) == pytest.approx(tuple(np.percentile(v, [2.5, 97.5])), abs=1e-9)
            near = v.abs() < 1e-12
            if not near.any():
                assert r["p"] == pytest.approx(min(1, 2 * (1 + min((v <= 0).sum(), (v >= 0).sum())) / 10))
            assert r["holm"] >= r["p"]


def test_registered_refits_hold_their_statistics(spark):
    for name in ("r05_refit_calibration_error", "r05_refit_cascade", "r01_r04_q06_weighted_ece"):
        rows = catalog.queries()[name](spark, SF).collect()
        assert rows and all(r["low"] <= r["high"] and r["replicates"] == 20 for r in rows)
    assert significance.FOLDS == 5
