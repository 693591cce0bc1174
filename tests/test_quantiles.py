"""Quantiles by selection against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from calibra.functions import quantiles as Q

SHARES = {"least": 0.0, "q": 0.025, "half": 0.5, "p95": 0.95, "most": 1.0}


@pytest.mark.parametrize("limit", [20, 10_000])
def test_quantiles_of_awkward_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "LIMIT", limit)
    monkeypatch.setattr(Q, "BUCKETS", 16)
    rng = np.random.default_rng(3)
    groups = {
        "even": rng.random(400), "ties": np.repeat([1.0, 2.0, 5.0], [300, 5, 2]), "one": np.full(90, -7.5), "few": np.array([3.0, 1.0]), None: rng.normal(size=77),
        "skewed": np.concatenate([rng.random(200) * 1e-9, [1e300, -1e300]]), "wide": np.array([-1.7e308, 1.7e308, 0.0] * 30), "long": np.exp(rng.normal(size=300) * 20),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in Q.quantiles(df, ["g"], "v", SHARES).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        values = np.sort(values)
        for name, share in SHARES.items():
            x = share * (len(values) - 1)
            low, high = values[int(np.floor(x))], values[int(np.ceil(x))]
            want = low if low == high else low + (high - low) * (x - np.floor(x))
            assert got[g][name] == pytest.approx(want, rel=1e-9), (g, name)


def test_no_rows(spark):
    assert Q.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", SHARES).count() == 0
