"""Operators without SQL, and cases that tables don't hold, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import SF

from calibra import catalog
from calibra.functions import hashing
from calibra.operators import answers, calibration, comparison, decide, ledger, overlap, resampling
from calibra.plans.derived import decisions, judged


def test_area_differences_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 9, bool(rng.random() < 0.4), float(rng.integers(0, 8)) / 8, float(rng.integers(0, 8)) / 8) for i in range(60)]
    df = spark.createDataFrame(rows, "item long, grp long, positive boolean, score_a double, score_b double")
    got = {r["b"]: r["stat"] for r in comparison.auc_difference(df, "grp", 5, "s").collect()}

    def area(score, weight):
        wins = total = 0.0
        for x in rows:
            for y in rows:
                if x[2] and not y[2]:
                    w = weight[x[1]] * weight[y[1]]
                    total += w
                    wins += w * (1.0 if x[score] > y[score] else 0.5 if x[score] == y[score] else 0.0)
        return wins / total

    drawn = {r["grp"]: r["times"] for r in resampling.drawn(df.withColumn("_all", F.lit("")), ["_all"], "grp", 5, "s").collect()}
    assert sorted(got) == list(range(5))
    for b, stat in got.items():
        weight = {g: drawn[g][b] for g in range(9)}
        assert sum(weight.values()) == 9
        assert stat == pytest.approx(area(4, weight) - area(3, weight))


def test_refitted_temperatures(spark):
    dec = judged(decisions(spark, SF)).where("model = 'alpha' and item % 5 = 0")
    got = {r["b"]: r["gi"] for r in resampling.refit_temperatures(dec, ["model"], "grp", 3, "t").collect()}
    rows = dec.select("grp", "p", "y").collect()
    grid = np.array(calibration.grid(*calibration.WIDE))
    times = {r["grp"]: r["times"] for r in resampling.drawn(dec, ["model"], "grp", 3, "t").collect()}
    assert sorted(got) == [0, 1, 2]
    for b in got:
        total = np.zeros(len(grid))
        for r in rows:
            logs = np.log(np.maximum(r["p"], 1e-6))[None] / grid[:, None]
            total += times[r["grp"]][b] * -np.log(np.maximum(np.exp(logs[:, r["y"]]) / np.exp(logs).sum(1), 1e-6))
        assert got[b] == int(np.argmin(np.round(total, 6)))


def test_micro_batches_stay_under_their_budget(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, int(rng.integers(1, 90))) for g in range(4) for i in range(40)]
    got = answers.micro_batches(spark.createDataFrame(rows, "g long, i long, n long"), ["g"], "n", "i", 200).collect()
    for g in range(4):
        want, batch, held = {}, 0, 0
        for _, i, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            if held and n * (held + 1) > 200:
                batch, held = batch + 1, 0
            held += 1
            want[i] = batch
        assert {r["i"]: r["batch"] for r in got if r["g"] == g} == want


def test_heads_are_found_inside_words_and_alone(spark):
    pool = spark.createDataFrame([(1, "happiness is a cat"), (2, "cat"), (3, ""), (4, None), (5, "no such")], "pid long, text string")
    corpus = spark.createDataFrame([(10, "The unhappiness is a CAT, thing"), (11, "concatenate"), (12, None), (13, "")], "cid long, text string")
    assert {tuple(r) for r in overlap.contained(pool, corpus, "pid", "cid").collect()} == {(1, 10), (2, 10), (2, 11)}


@pytest.mark.parametrize("small", [0, 100_000])
def test_heads_against_every_pair(spark, monkeypatch, small):
    """Shared starts, heads of all lengths, letters beyond the plane, repeats, ids that are null; both joins."""
    monkeypatch.setattr(overlap, "SMALL_POOL", small)
    monkeypatch.setattr(overlap, "CHUNK", 300)
    rng = np.random.default_rng(5)
    letters = list("ab ç𝒳")
    corpus = [(i, "".join(rng.choice(letters, int(rng.integers(0, 90))))) for i in range(60)] + [(99, None), (7, "ab ab ab"), (None, "ab ç ab")]
    cuts = [(int(rng.integers(0, 60)), int(rng.integers(0, 40)), int(rng.integers(1, 50))) for _ in range(80)]
    pool = [(i, corpus[c][1][at : at + n]) for i, (c, at, n) in enumerate(cuts)] + [(500, "a" * 40), (501, "ab ab"), (501, "ab ab"), (502, "zzz"), (503, ""), (504, None)]
    frames = spark.createDataFrame(pool, "pid long, text string").repartition(3), spark.createDataFrame(corpus, "cid long, text string").repartition(3)
    got = [tuple(r) for r in overlap.contained(*frames, "pid", "cid", length=24).collect()]
    plain = [{(r[i], r["n"]) for r in f.select(i, overlap.norm(F.col("text")).alias("n")).collect()} for f, i in zip(frames, ("pid", "cid"), strict=True)]
    want = {(p, c) for p, h in plain[0] if h for c, t in plain[1] if t is not None and h[:24] in t}
    assert len(got) == len(set(got)) and set(got) == want


def test_best_match_by_index_equals_the_join(spark):
    rng = np.random.default_rng(2)
    text = lambda: " ".join(str(x) for x in rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 6))
    q = spark.createDataFrame([(i, text()) for i in range(12)], "qid long, text string")
    p = spark.createDataFrame([(i, text()) for i in range(80)] + [(99, None)], "pid long, text string")
    grams = lambda t: overlap.char_grams(overlap.norm(t))
    one = {(r["qid"], r["pid"], round(r["jaccard"], 9)) for r in overlap.best_match(q, p, "qid", "pid", grams).collect()}
    two = {(r["qid"], r["pid"], round(r["jaccard"], 9)) for r in overlap.joined_match(q, p, "qid", "pid", grams).collect()}
    assert one == two and len(one) == 12


@pytest.mark.parametrize("name", ["g", "i", "m", "e", "b", "k", "accepted_"])
def test_groups_may_bear_the_names_of_inner_columns(spark, name):
    dec = spark.createDataFrame([("x", [0.9, 0.1], 0, 0.9, 1)] * 400, f"`{name}` string, p array<double>, y int, conf double, correct int")
    assert decide.learn_then_test(dec, [name], 0.05, 0.1).first()["accepted"] == 400
    assert calibration.fit(dec, [name]).count() == 1


def test_what_is_fatal(spark):
    lines = spark.createDataFrame([("a", "r"), ("a", "r")], "analysis string, record string")
    with pytest.raises(Exception, match="not unique"):
        ledger.one_record(lines, ["analysis", "record"]).collect()
    with pytest.raises(Exception, match="no comparator class"):
        ledger.classed(lines, lines.where("false").withColumn("class", F.lit("c")), ["record"]).collect()
    rows = spark.createDataFrame([("i", "low", "high")], "item string, first string, second string")
    with pytest.raises(Exception, match="not settled"):
        ledger.overridden(rows, rows.where("false").select("item", F.lit("low").alias("final")), ["item"]).collect()


@pytest.mark.parametrize("seed", ["g17", "x" * 50, "ç" * 70])
def test_draws_in_numpy_are_those_of_the_column(spark, monkeypatch, seed):
    monkeypatch.setattr(hashing, "HASHED", 50)
    got = hashing.draws(seed, range(8, 12), range(95, 1003))
    cells = spark.range(8, 12).withColumnRenamed("id", "b").crossJoin(spark.range(95, 1003).withColumnRenamed("id", "j"))
    want = np.zeros(got.shape, np.uint32)
    for r in cells.select("b", "j", hashing.draw(seed, F.col("b"), F.col("j")).alias("d")).collect():
        want[r["b"] - 8, r["j"] - 95] = r["d"]
    assert (got == want).all()


def test_baseline_families_can_be_told_apart(spark):
    """Of 20 replicates no p is below 0.095; of 10,000 the least is 2 / 10,001."""
    found = catalog.queries()["g17_baseline_family"](spark, SF).collect()
    assert min(r["p"] for r in found) == pytest.approx(2 / 10_001, abs=1e-6)
