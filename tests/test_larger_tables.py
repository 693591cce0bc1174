"""What first shows on larger tables: ties of rounding, broadcast draws and keys, rounds that don't end."""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import calibration, comparison, evidence, ledger, metrics, overlap, regression, rendering, resampling, significance
from calibra.plans.derived import judged


def broadcast_rows(node) -> list[int]:
    """Rows of each broadcast of a plan that has run."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcast_rows(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return broadcast_rows(node.plan())
    own = [node.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchangeExec" else []
    below = node.children()
    return own + [n for i in range(below.size()) for n in broadcast_rows(below.apply(i))]


def test_distinct_confidences_are_rounded_by_the_product(spark):
    """0.5040625 * 1e6 is 504062.49999999994, so SQL rounds it down, its printed decimal up."""
    rows = [("a", i, [top, 1 - top], 0) for i, top in enumerate((1613 / 3200, 0.504062, 0.504064))]
    dec = judged(spark.createDataFrame(rows, "g string, ord long, p array<double>, y int"))
    assert metrics.point_scores(dec, ["g"]).first()["distinct_conf"] == 2


def _of_ranges(values, seed, replicates):
    """Replicates of one group's mean; cluster i has the one value values[i]."""
    draw = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    order = sorted(range(len(values)), key=lambda i: (draw("order", i), i))
    return [np.mean([values[order[draw(seed, b, j) % len(values)]] for j in range(len(values))]) for b in range(replicates)]


def test_draws_meet_ranges_of_clusters(spark, monkeypatch):
    """Groups of one size share draws; ranges, blocks and tasks are many."""
    for name, value in (("RANGE", 16), ("DRAWS", 32), ("TOGETHER", 1), ("SORTED", 64)):
        monkeypatch.setattr(significance, name, value)
    sizes = {"a": 100, "b": 100, "c": 37, "d": 1}
    rows = [(g, i, float((i * 7 + ord(g)) % 11)) for g, n in sizes.items() for i in range(n)]
    got = significance.bootstrap_ratio(spark.createDataFrame(rows, "g string, cl long, v double"), ["g"], "cl", "v", 3, "s").collect()
    want = {(g, b): v for g in sizes for b, v in enumerate(_of_ranges([x[2] for x in rows if x[0] == g], "s", 3))}
    assert {(r["g"], r["b"]): r["stat"] for r in got} == pytest.approx(want)


def test_draws_are_not_broadcast(spark):
    rows = spark.range(8000).select(F.lit("a").alias("g"), "id", (F.col("id") % 2).alias("v"))
    found = significance.bootstrap_ratio(rows, ["g"], "id", "v", 60, "s")
    stats = [r["stat"] for r in found.collect()]
    assert len(stats) == 60 and np.mean(stats) == pytest.approx(0.5, abs=0.01)
    assert max(broadcast_rows(found._jdf.queryExecution().executedPlan()), default=0) <= 1000


def test_keys_are_not_broadcast(spark):
    items = spark.range(5000).withColumnRenamed("id", "item")
    keys = items.select("item", F.explode(F.array(*map(F.lit, "abc"))).alias("opt")).withColumn("tokens", F.array("opt"))
    nodes = items.select("item", F.array().cast("array<string>").alias("path"), F.explode(F.array(*map(F.lit, "abc"))).alias("token"), F.lit(-1.0).alias("lp"))
    found = rendering.key_likelihood(keys, nodes)
    assert [(r["missing"], r["p"]) for r in found.collect()] == [(0, pytest.approx(1 / 3))] * 15000
    assert not broadcast_rows(found._jdf.queryExecution().executedPlan())


def test_rounds_end_where_the_penalty_is_small(spark, monkeypatch):
    """Probabilities sum to 1, so with intercepts some directions are bent by the penalty alone."""
    calls, sums = [], regression._newton_sums
    monkeypatch.setattr(regression, "_newton_sums", lambda *x: calls.append(1) or sums(*x))
    rng = np.random.default_rng(3)
    x, y = rng.dirichlet([1.0, 1.0, 1.0], 300), np.eye(3)[rng.integers(0, 3, 300)]
    rows = spark.createDataFrame([("a", int(i % 2), a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "g string, fold int, x array<double>, y array<double>")
    regression.validated_strength(rows, "g", "fold", "x", "y", [1e8], rounds=40)
    assert len(calls) <= 15


def test_lines_without_a_match_cost_little(spark):
    texts = [(0, None), (1, ""), (2, "no word"), (3, "a  License b\r\nc\nlicence\tlicense d\n"), (4, "x" * 200 + "licence" + "y" * 300)]
    found = spark.createDataFrame(texts, "i int, t string").select("i", ledger.lines_with(F.col("t"), "(?i:licen[sc]e)").alias("x"))
    assert {r["i"]: r["x"] for r in found.collect()} == {0: None, 1: [], 2: [], 3: ["a License b", "licence license d"], 4: ["x" * 120 + "licence" + "y" * 240]}
    long = spark.range(4).select(F.concat(F.repeat(F.concat(F.lit("words and words "), F.col("id").cast("string"), F.lit(" on a line that has none of it\n")), F.lit(900_000)), F.lit("a license")).alias("t"))
    began = time.monotonic()
    assert [r["n"] for r in long.select(F.size(ledger.lines_with(F.col("t"), "(?i:licen[sc]e)")).alias("n")).collect()] == [1] * 4
    assert time.monotonic() - began < 15


def test_temperature_sums_are_made_once(spark):
    rows = [("a", i % 3, i % 2, [0.2 + 0.1 * (i % 5), 0.8 - 0.1 * (i % 5)] if i % 4 else [0.5, 0.0, 0.5]) for i in range(40)]
    dec = spark.createDataFrame(rows, "g string, fold int, y int, p array<double>")
    for found in (calibration.fit(dec, ["g"]), calibration.cross_fit(dec, ["g"])):
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    temperatures = calibration.grid(*calibration.WIDE)
    sums = {(r["g"], r["gi"]): r["nll"] for r in calibration.grid_nll(dec, ["g"]).collect()}
    for gi in (0, 50, 119):
        shares = [(max(p[y], 1e-6) ** (1 / temperatures[gi])) / sum(max(x, 1e-6) ** (1 / temperatures[gi]) for x in p) for _, _, y, p in rows]
        assert sums["a", gi] == pytest.approx(sum(-np.log(max(s, 1e-6)) for s in shares))


def test_best_match_is_counted_in_small_steps(spark, monkeypatch):
    """A batch of texts that all share their grams with all queries isn't counted at once; many queries
    meet the pool in blocks, not by a join of grams."""
    q = spark.createDataFrame([(i, f"alpha beta gamma{i % 7} delta{i}") for i in range(30)], "qid long, text string")
    p = spark.createDataFrame([(500 - i, f"alpha beta gamma{i % 5} delta{i % 40}") for i in range(300)] + [(999, None), (998, "")], "pid long, text string")
    grams = lambda t: overlap.token_set(overlap.norm(t))
    told = lambda df: {(r["qid"], r["pid"], round(r["jaccard"], 9)) for r in df.collect()}
    want = told(overlap.joined_match(q, p, "qid", "pid", grams))
    monkeypatch.setattr(overlap, "HITS", 50)
    monkeypatch.setattr(overlap, "CELLS", 64)
    assert told(overlap.best_match(q, p, "qid", "pid", grams)) == want and len(want) == 30
    monkeypatch.setattr(overlap, "QUERY_GRAMS", 40)
    monkeypatch.setattr(overlap, "POOL_ROWS", 70)
    found = overlap.best_match(q, p, "qid", "pid", grams)
    assert told(found) == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_are_normalized_once_before_their_grams(spark):
    """Inside a lambda an expression is evaluated for every gram."""
    from calibra.plans import records

    plan = records.t04_t06_j10_o04_char_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    grams = [line for line in plan.splitlines() if "lambdafunction" in line]
    assert grams and not any("regexp_replace" in line for line in grams)


def test_grades_are_grouped_by_numbers_in_tasks_of_bounded_size(spark, monkeypatch):
    """One grouping of lines, none by sorting texts, in as many tasks as the lines need."""
    from calibra.functions import dealing
    from calibra.plans import ledger as plans

    told = lambda df: sorted(map(tuple, df.collect()))
    want = told(plans.n02_grade_problems(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(dealing, "TASK_ROWS", 300)
    found = plans.n02_grade_problems(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert told(found) == want
    assert "SortAggregate" not in plan and plan.count("lineitem.parquet") == 1
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_linenumber <= 5").count()
    assert "hashpartitioning(study#" in plan and f", {-(-lines // 300)})" in plan


def test_problems_of_grades(spark):
    """Each row's own problems, and once for each study that it is repeated or unknown; null is in no ledger."""
    rows = [(1, *["low"] * 5, "low"), (1, *["low"] * 5, "high"), (1, "x", *["low"] * 4, "low"), (2, None, *["low"] * 4, None), (None, *["high"] * 5, "high")]
    rob = spark.createDataFrame(rows, "study int, d1 string, d2 string, d3 string, d4 string, d5 string, overall string")
    found = ledger.grade_problems(rob, spark.createDataFrame([(1,), (1,), (None,)], "study int")).collect()
    want = [(1, "rule"), (1, "rating"), (1, "rule"), (1, "repeated"), (2, "rating"), (2, "rule"), (2, "orphan"), (None, "orphan")]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_selection_meets_its_book_by_merges(spark, monkeypatch):
    from calibra.functions import dealing
    from calibra.plans import ledger as plans

    want = plans.n12_selection_read(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(dealing, "TASK_ROWS", 20)
    found = plans.n12_selection_read(spark, "/root/testdata/sf0.001")
    assert sorted(found.collect()) == sorted(want)
    assert not broadcast_rows(found._jdf.queryExecution().executedPlan())


def _counted(df, seen):
    """df, which tells how many of its rows have been made."""

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(run, df.schema)


def test_backbone_metrics_read_their_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [("m", i, i // 2, i % 3 == 0, *(((i * k) % 97) / 97 if c == "d" else (i * k) % 2 for k, c in ((3, "d"), (1, "i"), (5, "i"), (7, "d"), (11, "i"), (13, "i")))) for i in range(120)]
    pairs = spark.createDataFrame(rows, "model string, item int, grp int, in_scope boolean, conf double, correct int, flip int, conf_b double, correct_b int, flip_b int").withColumn("type", F.lit("t"))
    found = comparison.paired_metrics(_counted(pairs, seen), ["type"], "model", "grp", "item", 5, "s").collect()
    assert {r["metric"] for r in found} == {"accuracy", "ece", "auroc", "flips"} and seen.value == 120


def test_refits_read_their_rows_twice_at_most(spark):
    rows = [("a", i, i // 2, i % 2, [0.2 + 0.1 * (i % 5), 0.8 - 0.1 * (i % 5)], i % 2) for i in range(80)]
    dec = spark.createDataFrame(rows, "model string, item int, grp int, y int, p array<double>, correct int")
    for refit in (lambda d: resampling.refit_temperatures(d, ["model"], "grp", 4, "s"), lambda d: resampling.refit_ece(d, ["model"], "grp", ["item"], 4, "s")):
        seen = spark.sparkContext.accumulator(0)
        found = refit(_counted(dec, seen))
        assert found.count() == found.where("b < 4").count() > 0 and seen.value <= 160
    pairs = dec.select("model", "grp", F.col("p")[0].alias("conf"), F.col("correct").alias("c1"), F.lit(1).alias("c2"), F.lit(0.5).alias("l1"), F.lit(1.0).alias("l2"))
    seen = spark.sparkContext.accumulator(0)
    found = resampling.refit_cascade(_counted(pairs, seen), ["model"], "grp", 4, "s", "l1", "l2")
    assert found.count() == found.where("b < 4").count() == 4 and seen.value == 80


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BUCKET_ROWS", 1)
    rows = spark.range(3000).select(F.lit("a").alias("g"), (F.col("id") / 3000).alias("conf"))
    assert resampling._bucketed(rows, ["g"], "conf").select("_b").distinct().count() > 1024


def test_cluster_medians_are_made_once(spark):
    """Of the estimates one reading finds large groups and one the medians."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([("a", i % 6, float(i * 7 % 31)) for i in range(60)], "analysis string, cluster int, v double")
    found = evidence.pooled(_counted(rows, seen), ["analysis"], "cluster", "v").collect()
    assert [(r["clusters"], r["ahead"]) for r in found] == [(6, 6)] and seen.value <= 120


def test_regression_reads_written_rows(spark, monkeypatch):
    """The fit and the predictions read their rows from files and make no draws again."""
    from pyspark.ml.classification import LogisticRegression

    from calibra.plans import records

    plans, fit = [], LogisticRegression.fit
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows: plans.append(plan(rows)) or fit(self, rows))
    found = records.m01_m02_logistic_regression(spark, "/root/testdata/sf0.001")
    plans.append(plan(found))
    assert len(plans) == 2 and not any("md5" in p for p in plans)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert found.count() == orders.count()
