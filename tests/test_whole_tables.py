"""Queries without SQL, over all rows."""

from __future__ import annotations

import math

import pytest
from support import SF

from calibra import catalog
from calibra.operators import significance
from calibra.plans.derived import decisions, judged


def test_clopper_pearson_counts_all_decisions(spark):
    rows = catalog.queries()["r13_r14_clopper_pearson"](spark, SF).collect()
    assert sum(r["n"] for r in rows) == decisions(spark, SF).count()
    assert all(r["low"] < r["k"] / r["n"] < r["high"] for r in rows)


def test_refit_bootstrap_reads_all_types(spark):
    """Its interval lies around a replicate mean of all types, not of type 1 alone."""
    import numpy as np

    judged_ = judged(decisions(spark, SF)).select("model", "grp", "conf", "correct")

    def statistic(f):
        f = f.sort_values("conf", kind="mergesort")
        edges = np.round(np.arange(11) * len(f) / 10).astype(int)
        return sum((b - a) * abs(f["conf"].to_numpy()[a:b].mean() - f["correct"].to_numpy()[a:b].mean()) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a) / len(f)

    got = {r["model"]: (r["low"], r["high"]) for r in significance.interval(significance.bootstrap_any(judged_, ["model"], "grp", statistic, 20, 7), ["model"]).collect()}
    frame = judged_.toPandas()
    for model, part in frame.groupby("model"):
        groups = [g for _, g in part.groupby("grp", sort=True)]
        stats = []
        for b in range(20):
            rng = np.random.default_rng([7, b])
            stats.append(statistic(type(frame)(np.concatenate([groups[i].to_numpy() for i in rng.integers(0, len(groups), len(groups))]), columns=part.columns).astype({"conf": float, "correct": int})))
        assert got[model] == pytest.approx(np.percentile(stats, [2.5, 97.5]), abs=1e-6)


@pytest.mark.parametrize(("k", "n", "p"), [(201, 900, 0.25), (300, 1000, 0.3), (5000, 20000, 0.26), (999, 1000, 0.999)])
def test_long_binomial_tails(k, n, p):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    assert significance.binomial_tail(k, n, p) == pytest.approx(math.fsum(map(math.exp, logs)), rel=1e-8)
