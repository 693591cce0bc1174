"""Services, runs under a limit, answer files, entailment and regressions against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import decide, design, regression, runner, significance


def counted():
    class Counted:  # made here, so that it travels to workers, which can't import tests
        def answer(self, record):
            if record["key"] == 3:
                raise RuntimeError("no")
            return {"model_returned": "counted", "usage_in": 1_000_000, "answers": {"q": {"a": 1.0}}}

    return Counted


def test_run_stops_beyond_the_limit_and_goes_on(spark, tmp_path):
    runner.register("counted", counted())
    requests = spark.range(40).withColumnRenamed("id", "key").where("key <> 3")
    path = str(tmp_path / "log")
    chunks, spent = runner.run_within(spark, requests, path, "counted", ["key"], limit=0.1, chunk=10, price=0.01)
    assert 0 < chunks < 4 and spent > 0.1
    # Money of earlier lines counts, so the next run stops after one chunk.
    assert runner.run_within(spark, requests, path, "counted", ["key"], limit=0.1, chunk=10, price=0.01)[0] == 1
    runner.run_within(spark, requests, path, "counted", ["key"], limit=100.0, chunk=10, price=0.01)
    log = spark.read.parquet(path)
    assert log.count() == log.select("key").distinct().count() == 39
    with pytest.raises(KeyError):
        runner.scorer("nobody", ["key"])


def test_failing_service_leaves_error_lines(spark, tmp_path):
    runner.register("counted", counted())
    requests = spark.range(2, 5).withColumnRenamed("id", "key").repartition(3)
    path = str(tmp_path / "log")
    runner.run_within(spark, requests, path, "counted", ["key"], limit=1e9, chunk=1)
    assert any(r.key == 3 and r.error for r in spark.read.parquet(path).collect())


def test_lines_without_temperature_and_broken_lines(spark):
    dec = spark.createDataFrame([("r", "q2", [0.25, 0.75], None), ("r", "q1", [0.5, 0.5], 2.0)], "r string, q string, p array<double>, t double")
    lines = runner.baseline_lines(dec, "r", "q", F.array(F.lit("a"), F.lit("b")), F.col("t"))
    read = {x.question: x for x in runner.read_lines(lines.union(spark.createDataFrame([("z", "no json")], "r string, line string"))).collect()}
    assert set(read) == {"q1", "q2"} and read["q2"].probs == {"a": 0.25, "b": 0.75}
    assert read["q2"].fitted_temperature is None and read["q2"].probs_scaled is None and read["q1"].fitted_temperature == 2.0
    gold = spark.createDataFrame([("q1", "k"), ("q2", "other")], "question string, type string")
    assert [tuple(x) for x in runner.fitted_temperatures(runner.read_lines(lines), gold).collect()] == [("k", 2.0)]


def test_entailment_scores_each_pair_once(spark):
    seen = spark.sparkContext.accumulator(0)
    pairs = spark.createDataFrame([(k, o, "same", h) for k in range(50) for o, h in enumerate("xy")] + [(99, 0, None, "x"), (99, 1, "same", "y")], "key int, option int, premise string, hypothesis string")

    def score(d):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b[["_k"]].assign(logit=np.where(b["hypothesis"] == "x", 1.0, 0.0))

        return d.mapInPandas(run, "_k string, logit double")

    found = runner.entailed(pairs, ["key"], score).collect()
    assert seen.value == 2 and {r.key for r in found} == set(range(50))
    assert all(r.p == pytest.approx([math.e / (math.e + 1), 1 / (math.e + 1)]) for r in found)


def test_rule_skips_rows_and_keeps_missing_soft_labels(spark):
    rows = spark.createDataFrame([(1, True, 0.7), (2, None, 0.1), (3, False, None)], "item long, yes boolean, s double")
    out = design.recast(rows, "item", lambda d: F.when(d["yes"].isNotNull(), F.struct(d["yes"].alias("positive"), d["s"].alias("soft"))), "x").collect()
    assert len(out) == 8 and {r.item for r in out} == {1, 3}
    assert all(r.soft is None for r in out if r.item == 3) and all(r.label == r.positive_name for r in out if r.item == 1)


def examples(seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    z = np.exp(x @ rng.normal(size=(2, 3)) + rng.normal(size=(n, 3)) * 0.3)
    return x, z / z.sum(1, keepdims=True), rng.integers(0, 4, n)


def rows_of(spark, x, y, fold, group="g"):
    return spark.createDataFrame([(i, group, int(f), a.tolist(), b.tolist()) for i, (a, b, f) in enumerate(zip(x, y, fold))], "id long, g string, fold int, x array<double>, y array<double>").repartition(3)


def descent(x, y, c, rounds=4000):
    """Plain gradient descent on the same objective."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros((y.shape[1], a.shape[1])), np.array([1.0] * x.shape[1] + [0.0])
    rate = 1.0 / (c * np.linalg.norm(a, 2) ** 2 / 2 + 1)
    for _ in range(rounds):
        e = np.exp(a @ w.T)
        w = w - rate * (c * (e / e.sum(1, keepdims=True) - y).T @ a + ridge * w)
    return w


def chances(x, w):
    e = np.exp(np.hstack([x, np.ones((len(x), 1))]) @ w.T)
    return e / e.sum(1, keepdims=True)


def test_strength_by_folds_against_descent(spark):
    x, y, fold = examples()
    got = regression.select_strength(rows_of(spark, x, y, fold), "g", "fold", "x", "y", [0.001, 0.1]).collect()[0]
    loss = {c: np.mean([-(y[fold == k] * np.log(chances(x[fold == k], descent(x[fold != k], y[fold != k], c)))).sum(1).mean() for k in range(4)]) for c in (0.001, 0.1)}
    best = min(loss, key=loss.get)
    assert got.strength == best and got.cv_loss == pytest.approx(loss[best], abs=1e-5) and got.n == 400
    assert chances(x, np.array(got.weights)) == pytest.approx(chances(x, descent(x, y, best)), abs=1e-4)


def test_validated_strength_and_out_of_fold_logit(spark):
    x, y, fold = examples(1)
    hot = np.eye(3)[y.argmax(1)]
    valid = (fold == 0).astype(int)
    got = regression.validated_strength(rows_of(spark, x, hot, valid), "g", "fold", "x", "y", [0.001, 0.05]).collect()[0]
    scores = {}
    for c in (0.001, 0.05):
        p = chances(x[valid == 1], descent(x[valid == 0], hot[valid == 0], c))
        scores[c] = ((p.argmax(1) == hot[valid == 1].argmax(1)).mean(), (np.log(p) * hot[valid == 1]).sum(1).mean())
    best = max(scores, key=scores.get)
    assert (got.strength, got.accuracy) == (best, pytest.approx(scores[best][0])) and got.nll == pytest.approx(-scores[best][1], abs=1e-5)

    found = {r.id: r.p for r in regression.out_of_fold(rows_of(spark, x, hot, fold), "g", "fold", "x", "y", "id", strength=0.05).collect()}
    rest = fold != 2
    mean, scale = x[rest].mean(0), x[rest].std(0)
    want = chances((x[~rest] - mean) / scale, descent((x[rest] - mean) / scale, hot[rest], 0.05))
    assert np.array([found[i] for i in np.flatnonzero(~rest)]) == pytest.approx(want, abs=1e-4) and len(found) == 400


def test_regression_edge_cases(spark):
    rows = spark.createDataFrame(
        [(1, "one", 0, [0.0], [1.0, 0.0]), (2, "one", 1, [1.0], [1.0, 0.0]), (3, None, 0, [0.0], [1.0, 0.0]), (4, "one", 0, None, [1.0, 0.0]), (5, "one", 0, [0.0], [0.0, 0.0]), (6, "one", 0, [float("nan")], [1.0, 0.0]), (7, "alone", 0, [1.0], [0.0, 1.0])],
        "id long, g string, fold int, x array<double>, y array<double>")
    found = {r.id: r.p for r in regression.out_of_fold(rows.where("id < 6"), "g", "fold", "x", "y", "id").collect()}
    assert found[1] == [1.0, 0.0] == found[2] and 3 not in found and 4 not in found
    got = {r.g: r for r in regression.select_strength(rows, "g", "fold", "x", "y", [1.0, 2.0]).collect()}
    assert got["one"].n == 2 and got["alone"].cv_loss is None and got["alone"].strength == 1.0
    assert regression.select_strength(rows.where("false"), "g", "fold", "x", "y", [1.0]).count() == 0
    with pytest.raises(ValueError):
        regression.select_strength(rows, "g", "fold", "x", "y", [1.0] * regression.MODELS)


def test_held_out_risk_without_a_threshold(spark):
    rows = [(f, 0.5, 0) for f in range(5)]
    dec = spark.createDataFrame(rows, "fold int, conf double, correct int").withColumn("one", F.lit(1)).withColumn("p", F.array(F.lit(0.5), F.lit(0.5))).withColumn("y", F.lit(0))
    got = decide.cross_fitted(dec, ["one"], "fold", 5, 0.1).first()
    assert (got.n, got.accepted, got.coverage, got.risk, got.risk_upper) == (5, 0, 0.0, None, None)


def test_balanced_folds_keep_groups_and_refuse_too_many(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2 + [(None,)], "g string")
    out = {r.g: r.fold for r in significance.with_balanced_folds(df, "g", 2).distinct().collect()}
    assert out == {"a": 0, "b": 1, "c": 1, None: None}
    with pytest.raises(ValueError):
        significance.with_balanced_folds(df, "g", 2, most=2)


def test_each_request_fails_for_itself_and_what_may_pass_is_tried_again():
    import threading
    from collections import Counter

    import pandas as pd

    tries, waits, at_once, most, lock = Counter(), [], [0], [0], threading.Lock()

    def answer(request):
        with lock:
            at_once[0] += 1
            most[0] = max(most[0], at_once[0])
        try:
            tries[request["key"]] += 1
            if request["key"] == 1:
                raise ValueError("no such thing " + "x" * 600)
            if request["key"] == 2 and tries[2] < 4:
                raise RuntimeError("HTTP 503")
            if request["key"] == 3:
                raise TimeoutError("Timeout")
            return {"value": request["key"] * 2}
        finally:
            with lock:
                at_once[0] -= 1

    out = runner.patient(answer, concurrency=3, wait=waits.append)(pd.DataFrame({"key": range(6)})).set_index("key")
    assert tries == {0: 1, 1: 1, 2: 4, 3: 7, 4: 1, 5: 1} and most[0] <= 3
    assert sorted(waits) == sorted([1.0, 2.0, 4.0] + [1.0, 2.0, 4.0, 8.0, 16.0, 30.0])
    assert out["value"].dropna().to_dict() == {0: 0, 2: 4, 4: 8, 5: 10}
    assert len(out["error"][1]) == 500 and "Timeout" in out["error"][3] and out["error"].isna().sum() == 4


def test_requests_run_in_tasks(spark):
    def answer(request):
        if request["key"] % 3 == 0:
            raise ValueError("by three")
        return {"value": float(request["key"])}

    rows = runner.run_requests(spark.range(20).select(F.col("id").alias("key")).repartition(3), answer, "key long, value double, error string", concurrency=4).collect()
    assert {r["key"]: r["value"] for r in rows} == {k: None if k % 3 == 0 else float(k) for k in range(20)}
    assert sum(r["error"] is not None for r in rows) == 7
