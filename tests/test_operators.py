"""Edge cases: ties, empty classes, few rows, degenerate tests, and known values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.functions.documents import inverted
from calibra.functions.ranking import numbered
from calibra.operators import answers, calibration, comparison, curves, decide, design, evidence, ledger, metrics, overlap, rendering, significance
from calibra.plans.derived import judged

SCHEMA = "g string, ord long, p array<double>, y int"


def frame(spark, rows):
    return judged(spark.createDataFrame([("a", i, list(p), y) for i, (p, y) in enumerate(rows)], SCHEMA))


def numpy_ece(conf, right, bins=10):
    order = np.argsort(conf, kind="mergesort")
    conf, right = np.asarray(conf)[order], np.asarray(right)[order]
    edges = np.round(np.arange(bins + 1) * len(conf) / bins).astype(int)
    return sum((b - a) * abs(conf[a:b].mean() - right[a:b].mean()) for a, b in zip(edges[:-1], edges[1:]) if b > a) / len(conf)


@pytest.mark.parametrize("n", [7, 203])
def test_ece_with_ties_and_odd_counts(spark, n):
    rng = np.random.default_rng(1)
    tops = rng.choice([0.4, 0.55, 0.6, 0.7, 0.9], n)
    rows = [((float(t), float(1 - t)), int(rng.integers(0, 2))) for t in tops]
    dec = frame(spark, rows)
    conf = [max(p) for p, _ in rows]
    right = [float(np.argmax(p) == y) for p, y in rows]
    assert metrics.ece(dec, ["g"]).first()["ece"] == pytest.approx(numpy_ece(conf, right), abs=1e-12)
    m = metrics.murphy(dec, ["g"]).first()
    assert m["brier_top"] == pytest.approx(m["reliability"] - m["resolution"] + m["uncertainty"] + m["residual"], abs=1e-12)


def test_argmax_takes_the_first_maximum_and_unscored_rows_are_left_out(spark):
    dec = frame(spark, [((0.5, 0.5), 0), ((0.5, 0.5), 1)]).unionByName(judged(spark.createDataFrame([("a", 9, None, 1), ("a", 10, [0.9, 0.1], None)], SCHEMA)))
    got = metrics.point_scores(dec, ["g"]).first()
    assert (got["n"], got["accuracy"]) == (2, 0.5)


def test_auroc_half_ties_and_single_class(spark):
    df = spark.createDataFrame([("a", 0.5, True), ("a", 0.5, False), ("a", 0.9, True), ("b", 0.2, True)], "g string, s double, y boolean")
    got = {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"], "s", "y").collect()}
    assert got == {"a": 0.75, "b": None}


def test_coverage_at_risk_moves_ties_together_and_may_be_empty(spark):
    dec = frame(spark, [((0.9, 0.1), 1), ((0.8, 0.2), 0), ((0.8, 0.2), 1)])
    got = curves.coverage_at_risk(curves.risk_coverage(dec, ["g"]), ["g"], 0.1).first()
    assert (got["coverage"], got["threshold"], got["accepted"]) == (0.0, None, 0)


def test_mcnemar_known_value_and_no_discordant_pairs(spark):
    got = spark.createDataFrame([(13, 157), (0, 0)], "a long, b long").select(significance.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()
    assert got[0]["p"] == pytest.approx(1.446e-32, rel=1e-3)
    assert got[1]["p"] == 1.0


def test_clopper_pearson_known_bound_and_edges():
    assert significance.upper_bound(26, 555, 0.05) == pytest.approx(0.0644, abs=5e-5)
    assert significance.upper_bound(0, 0, 0.05) is None
    assert significance.upper_bound(4, 4, 0.05) == 1.0
    assert significance.upper_bound(0, 10, 0.05) == pytest.approx(1 - 0.05 ** (1 / 10), abs=1e-12)


def test_binomial_cdf_agrees_with_sums(spark):
    rows = [(k, n) for n in (1, 5, 40) for k in range(-1, n + 1)]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", significance.binomial_cdf(F.col("k"), F.col("n"), F.lit(0.3)).alias("c")).collect()
    for r in got:
        want = sum(math.comb(r["n"], i) * 0.3**i * 0.7 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["c"] == pytest.approx(want, abs=1e-12)


def test_holm_is_monotone_and_capped(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "a", 0.9)], "fam string, k string, p double")
    got = {(r["fam"], r["k"]): r["holm"] for r in significance.holm(df, ["fam"], "p", "k").collect()}
    assert got[("f", "a")] == pytest.approx(0.03)
    assert got[("f", "c")] == got[("f", "b")] == pytest.approx(0.06)
    assert got[("g", "a")] == 0.9


def test_temperature_fit_takes_the_first_minimum_of_flat_curves(spark):
    dec = frame(spark, [((0.5, 0.5), 0), ((0.5, 0.5), 1)])
    got = calibration.fit(dec, ["g"]).first()
    assert got["gi"] == 0 and got["at_low"] and got["temperature"] == pytest.approx(0.2)


def test_learn_then_test_rejects_none_on_errors(spark):
    dec = frame(spark, [((0.9, 0.1), 1)] * 30)
    got = decide.learn_then_test(dec, ["g"], 0.05, 0.1).first()
    assert (got["threshold"], got["accepted"]) == (None, 0)


def test_kappa_of_one_category_is_null(spark):
    rows = spark.createDataFrame([("d", "low", "low")] * 3, "d string, first string, second string")
    got = evidence.kappa(rows, ["d"]).first()
    assert got["agreement"] == 1.0 and got["kappa"] is None and got["weighted_kappa"] is None


@pytest.mark.parametrize(("text", "want"), [("acc 91.5 %", 91.5), ("acc 3/4", 75.0), ("acc 1 acc 2", None), ("none", None), (None, None)])
def test_single_number(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(evidence.single_number(F.col("t"), r"acc ([0-9./]+)").alias("v")).first()["v"] == want


def test_folds_are_even_and_keep_groups_whole(spark):
    df = spark.range(103).select((F.col("id") % 41).alias("grp"), "id")
    got = significance.folds(df, "grp", "s")
    sizes = [r["n"] for r in got.groupBy("fold").agg(F.count_distinct("grp").alias("n")).collect()]
    assert sum(sizes) == 41 and max(sizes) - min(sizes) <= 1
    assert got.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()


def test_balanced_folds_are_greedy():
    assert significance.balanced_folds([("a", 5), ("b", 3), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_nested_subsets_nest_and_hold_gold(spark):
    items = spark.range(20).select(F.col("id").alias("item"))
    d = design.permuted(items, "item", [f"o{i}" for i in range(9)], F.concat(F.lit("o"), (F.col("item") % 9).cast("string")), "s")
    got = design.nested_subsets(d, "item", [2, 4, 9]).collect()
    sets = {}
    for r in got:
        sets.setdefault((r["item"], r["k"]), set()).add(r["option"])
    for i in range(20):
        assert len(sets[(i, 2)]) == 2 and len(sets[(i, 9)]) == 9
        assert f"o{i % 9}" in sets[(i, 2)] <= sets[(i, 4)] <= sets[(i, 9)]


def selection(spark, **line):
    row = {"line": 2, "analysis": "r1", "group": "g", "include": "yes", "row_id": "L1", "a_field": None, "a_pattern": None, "b_row": None, "b_field": None, "b_pattern": None, "expr": None} | line
    kinds = ", ".join(f"`{c}` {'long' if c == 'line' else 'string'}" for c in row)
    book = spark.createDataFrame([("L1", "91.5 (n=40)", "1e"), ("L2", "83/84", " 70 "), ("L3", "70 of 80", "")], "row_id string, value string, comparator_value string")
    return [(r["a"], r["b"], r["val"]) for r in ledger.read_selection(spark.createDataFrame([tuple(row.values())], kinds), book).collect()]


def test_selection_lines_read_by_their_own_patterns(spark):
    assert selection(spark, a_pattern=r"n=(\d+)") == [(40.0, None, 40.0)]
    assert selection(spark, row_id="L2") == [(pytest.approx(98.8095238), None, pytest.approx(98.8095238))]
    assert selection(spark, row_id="L3", a_pattern=r"(\d+) of") == [(70.0, None, 70.0)]
    assert selection(spark, row_id="L3", a_pattern=r"(\d+) of", b_field="value", b_pattern=r"\d+$", expr="a-b") == [(70.0, 80.0, -10.0)]
    assert selection(spark, row_id="L2", a_field="comparator_value", b_row="L3", b_field="value", b_pattern=r"of (\d+)", expr="a/b") == [(70.0, 80.0, 0.875)]
    assert selection(spark, analysis="r2", row_id="L3", a_pattern="^(7.)", b_field="value", b_pattern="(8.)$", expr="a/100") == [(70.0, 0.8, 0.7)]
    assert selection(spark, include="no", row_id="L9") == []


@pytest.mark.parametrize(
    "line",
    [{"expr": "zzz"}, {"row_id": "L9"}, {"a_field": "nothing"}, {}, {"a_pattern": r"(\d)"}, {"a_pattern": "n=x"}, {"a_pattern": r"\((n)="}, {"a_pattern": r"n=(\d+)", "expr": "a-b"}, {"row_id": "L2", "b_field": "value", "b_pattern": "(84)", "b_row": "L9", "expr": "a-b"}],
)
def test_what_a_selection_line_may_not_be(spark, line):
    with pytest.raises(Exception, match="line 2 of r1"):
        selection(spark, **line)


def test_expressions_are_their_texts(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "a double, b double")
    for text in evidence.EXPRESSIONS:
        assert df.select(evidence.evaluated(F.lit(text), F.col("a"), F.col("b")).alias("v")).first()["v"] == pytest.approx(eval(text, {"a": 3.0, "b": 4.0}))


def test_failures_by_the_lines_own_words(spark):
    lines = [
        '{"key": "k1", "error": "over the prompt budget"}', '{"key": "k1", "answers": {"q": {"probs": {"a": 1.0}, "raw": {"usage_out": 800, "raw_text": "{\\"probabilities\\": [{\\"p\\": 0.4}, {\\"p\\": 1.7}]}"}}}}', "", None, "not json",
        '{"key": "k2", "error": "", "answers": {"q": {"probs": {}}, "r": {"raw": {"raw_text": "I cannot tell. {}"}}}}', '{"key": "k3", "error": {"code": 5}}', '{"key": "k2", "answers": {}}',
    ]
    df = spark.createDataFrame([("m", x) for x in lines], "model string, line string")
    assert tuple(answers.failures(df, ["model"], "line", F.lit(True)).first()) == ("m", 6, 3, 2, 2, 1, 1, 1, 3, 2, 1, 1, 1)
    assert tuple(answers.failures(df, ["model"], "line").first())[-3:] == (None, None, None)


def test_claim_rules(spark):
    def of(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert [of(ledger.ratio_direction(F.lit(x), F.lit(2.0))) for x in (2.0, 1.9, 1.0, 0.5, None)] == ["supported", "mixed", "contradicted", "contradicted", None]
    assert [of(ledger.absence_direction(F.lit(x))) for x in (0, 1, None)] == ["supported", "contradicted", None]
    assert [of(ledger.rank_direction(F.lit(x), F.lit(3))) for x in (0, 1, 3)] == ["supported", "mixed", "contradicted"]
    at = lambda q, c, l: F.struct(F.lit(q).alias("quality"), F.lit(c).alias("cost"), F.lit(l).alias("latency"))  # noqa: E731, E741
    assert [of(ledger.frontier_direction(at(5, 5, 5), F.array(at(*x)))) for x in ((5, 5, 5), (5, 4, 5), (6, 6, 6), (4, 4, 4))] == ["supported", "contradicted", "mixed", "supported"]
    assert of(ledger.frontier_direction(at(1, 1, 1), F.array().cast("array<struct<quality:int,cost:int,latency:int>>"))) is None


def test_printed_numbers(spark):
    texts = ["twelve of 1,234 items, .5 each", "Twenty-one and twenty, one-two", "no. 3 at 1.2.3 a.4", "someone 7,five", "two.5 of −8", "eleventh 1,2,3", "", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", overlap.numbers_of(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in found] == [["12", "1234", "0.5"], ["21", "20", "1", "2"], ["3", "1.2", "3", "0.4"], ["7"], ["2.5", "8"], ["123"], [], None]


def test_labels_stand_once_and_are_letters_and_digits(spark):
    rows = lambda *names: spark.createDataFrame([(n, 1) for n in names], "label string, value int")
    assert sorted(r["label"] for r in ledger.published(rows("a1", "bC"), "label", "syn.").collect()) == ["syn.a1", "syn.bC"]
    for names, said in ((("a1", "a1"), "repeated label syn.a1"), (("a-1",), "bad label a-1"), ((None,), "bad label")):
        with pytest.raises(Exception, match=said):
            ledger.published(rows(*names), "label", "syn.").collect()


def test_inverted_map_keeps_the_last_key(spark):
    m = F.create_map(*map(F.lit, ("a", "x", "b", "y", "c", "x")), F.lit("d"), F.lit(None).cast("string"))
    assert spark.range(1).select(inverted(m).alias("m")).first()["m"] == {"x": "c", "y": "b"}


@pytest.mark.parametrize("ids", [[], [5], [3, -2, 10**12, 7, 0], [4, 4, 9]])
def test_numbers_follow_a_key(spark, ids):
    found = numbered(spark.createDataFrame([(i,) for i in ids], "k long"), "k").orderBy("r").collect()
    assert [r["r"] for r in found] == list(range(1, len(ids) + 1)) and [r["k"] for r in found] == sorted(ids)


def test_keys_without_tokens_or_alike_are_fatal(spark):
    nodes = spark.createDataFrame([(1, [], 5, -0.5), (1, [5], 6, -1.0)], "item int, path array<int>, token int, lp double")
    keys = lambda *k: spark.createDataFrame([(1, str(i), list(t)) for i, t in enumerate(k)], "item int, opt string, tokens array<int>")
    assert rendering.key_likelihood(keys((5,), (5, 6)), nodes).count() == 2
    for bad, said in ((((5,), ()), "without tokens"), (((5,), (5,)), "same tokens")):
        with pytest.raises(Exception, match=said):
            rendering.key_likelihood(keys(*bad), nodes).collect()


def test_a_wholly_refused_number_of_options_has_no_scores(spark):
    rows = [("a", 1, i, [0.9, 0.1], i % 2) for i in range(4)] + [("a", 2, i, None, 0) for i in range(3)]
    dec = judged(spark.createDataFrame(rows, "model string, k int, ord int, p array<double>, y int"))
    found = {r["k"]: r for r in comparison.cardinality_sweep(dec, ["model"], "k", 1, 2).collect()}
    assert (found[1]["n"], found[1]["refused"], found[1]["accuracy"]) == (4, 0, 0.5)
    assert (found[2]["n"], found[2]["refused"], found[2]["accuracy"], found[2]["ece"], found[2]["loss"]) == (0, 3, None, None, None)


def test_ratings_outside_the_legal_values_are_fatal(spark):
    items = spark.createDataFrame([(i, f"s{i}") for i in (9, 4, 7)], "id long, name string")
    legal = {"grade": ("low", "high")}
    tasks = design.rating_tasks(items, "id", 2, legal)
    assert [(r["id"], r["part"], r["grade"], r["grade_may_be"]) for r in tasks.orderBy("id").collect()] == [(4, 1, "", "low | high"), (7, 2, "", "low | high"), (9, 1, "", "low | high")]
    assert [r["grade"] for r in design.read_ratings(tasks.withColumn("grade", F.lit(" High ")), "id", legal).collect()] == ["high"] * 3
    with pytest.raises(Exception, match="grade may not be medium"):
        design.read_ratings(tasks.withColumn("grade", F.lit("medium")), "id", legal).collect()
