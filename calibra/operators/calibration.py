"""Temperature scaling: grid search, per-slice fits and cross-fitting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .metrics import scored

#: Points, least and greatest temperature of the two grids in use.
WIDE, NARROW = (120, 0.2, 20.0), (60, 0.25, 8.0)
#: Fixed value: decisions a slice needs for a temperature of its own.
LEAST_ROWS = 30
#: Groups whose sums a task holds, at most.
MOST_HELD = 4096


def grid(points: int, low: float, high: float) -> list[float]:
    """Temperatures equally spaced in their logarithm."""
    step = (math.log(high) - math.log(low)) / (points - 1)
    return [math.exp(math.log(low) + i * step) for i in range(points)]


def grid_nll(dec: DataFrame, by: list[str], spec: tuple = WIDE) -> DataFrame:
    """Summed negative log-likelihood of each group at each temperature: rows (by, gi, t, nll, n).

    Each batch of decisions meets the grid one temperature at a time, so a task holds one number for each
    decision; only partial sums of a fixed size for each group leave it.
    """
    temperatures = grid(*spec)
    rows = scored(dec).select(*by, "p", "y")
    kinds, floor = dict(rows.dtypes), V.FLOOR

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inverse = 1.0 / np.array(temperatures)
        held: dict[tuple, tuple[np.ndarray, int]] = {}
        for frame in batches:
            width = frame["p"].str.len().to_numpy()
            for k in np.unique(width):
                own = frame[width == k]
                groups = own.groupby(by, sort=False, dropna=False).indices if by else {(): np.arange(len(own))}
                order, sizes = np.concatenate(list(groups.values())), [len(at) for at in groups.values()]
                logs = np.log(np.maximum(np.stack(own["p"].to_numpy()).astype(float), floor)).T
                y = own["y"].to_numpy(np.int64)
                # Beside the right option's share, which is 1 over 1 and the others' quotients by it.
                row = np.arange(len(own))
                others = (logs[np.arange(k - 1)[:, None] + (np.arange(k - 1)[:, None] >= y), row] - logs[y, row])[:, order]
                first = np.cumsum([0, *sizes[:-1]])
                nll = np.stack([np.add.reduceat(np.minimum(np.log1p(np.exp(others * x).sum(0)), -np.log(floor)), first) for x in inverse], 1)
                for key, sums, n in zip(groups, nll, sizes, strict=True):
                    key = key if isinstance(key, tuple) else (key,)
                    key = tuple(None if x != x else x for x in key)
                    before = held.get(key, (0, 0))
                    held[key] = (before[0] + sums, before[1] + n)
                if len(held) > MOST_HELD:
                    yield from told(held)
                    held = {}
        yield from told(held)

    def told(held: dict) -> Iterator[pd.DataFrame]:
        for key, (nll, n) in held.items():
            out = pd.DataFrame({"gi": np.arange(len(temperatures), dtype=np.int32), "t": temperatures, "nll": nll, "n": n})
            for name, value in zip(by, key, strict=True):
                out[name] = value
            yield out[[*by, "gi", "t", "nll", "n"]]

    found = rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", " * bool(by) + "gi int, t double, nll double, n long")
    return found.groupBy(*by, "gi", "t").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"))


def choose(sums: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """The temperature of least NLL, the first if tied (to `digits`, as sums depend on their order)."""
    # Every group has all of the grid, so its own last place is the grid's; sums are made once.
    best = sums.groupBy(*by).agg(F.min(F.struct(F.round("nll", digits).alias("v"), "gi", "t")).alias("_b"), F.max("n").alias("n"), F.max("gi").alias("last"))
    return best.select(*by, F.col("_b.t").alias("temperature"), F.col("_b.gi").alias("gi"), "n", F.col("_b.gi").isin(0).alias("at_low"), (F.col("_b.gi") == F.col("last")).alias("at_high"))


def fit(dec: DataFrame, by: list[str], spec: tuple = WIDE) -> DataFrame:
    return choose(grid_nll(dec, by, spec), by)


def fit_by_slice(dec: DataFrame, by: list[str], spec: tuple = WIDE, least: int = LEAST_ROWS) -> DataFrame:
    """A temperature for each slice; 1 for slices of fewer decisions than `least`."""
    found = fit(dec, by, spec)
    return found.withColumn("temperature", F.when(F.col("n") >= least, F.col("temperature")).otherwise(F.lit(1.0)))


def cross_fit(dec: DataFrame, by: list[str], fold: str = "fold", spec: tuple = WIDE) -> DataFrame:
    """A temperature for each fold from the other folds: one pass over the data, each complement as
    the group's total less the fold's sum."""
    sums = grid_nll(dec, [*by, fold], spec)
    whole = Window.partitionBy(*by, "gi", "t")  # as many rows as folds
    rest = sums.select(*by, fold, "gi", "t", (F.sum("nll").over(whole) - F.col("nll")).alias("nll"), (F.sum("n").over(whole) - F.col("n")).alias("n"))
    return choose(rest, [*by, fold])


def scaled(dec: DataFrame, temperatures: DataFrame, on: list[str]) -> DataFrame:
    """Decisions with p at their group's temperature (1 where there is none); pred is unchanged."""
    out = dec.join(F.broadcast(temperatures.select(*on, "temperature")), on, "left")
    p = V.tempered(F.col("p"), F.coalesce("temperature", F.lit(1.0)))
    return out.withColumn("p", p).withColumn("conf", F.array_max("p"))
