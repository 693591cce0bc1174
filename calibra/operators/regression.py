"""Ridge-penalized multinomial logits over soft labels, fitted for many groups, folds and strengths at once.

A model is one (group, fold held out, strength). Newton's rounds read the rows once for all models; what
leaves a task is a sum of fixed size for each, so a group may hold any share of the rows. Models sit
on the driver and travel with the tasks: groups are settings such as a workflow's question, MODELS at most.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Models of one call; more are refused, as each is a matrix on the driver.
MODELS = 20_000
#: Least probability in a cross-entropy, and what classes unseen in training get.
FLOOR, UNSEEN = 1e-12, 1e-4
#: Rows that a task packs at a time, numbers of a step's widest matrix, and the share of the objective below
#: which a step's gain is noise of its sums.
HELD, CELLS, GAIN = 1 << 16, 1 << 19, 1e-14


@dataclass
class Model:
    group: str
    held: int | None
    strength: float
    n: int
    mean: np.ndarray
    scale: np.ndarray
    seen: np.ndarray
    weights: np.ndarray
    best: float = math.inf
    step: np.ndarray | None = None
    done: bool = False

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def probabilities(self, a: np.ndarray) -> np.ndarray:
        z = np.where(self.seen, a @ self.weights.T, -np.inf)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def served(self, x: np.ndarray) -> np.ndarray:
        """Predictions: classes unseen in training get a little, unless only one was seen."""
        p = self.probabilities(self.design(x))
        return p if self.seen.all() or self.seen.sum() < 2 else (p + UNSEEN) / (p + UNSEEN).sum(1, keepdims=True)


def _ready(rows: DataFrame, group: str, fold: str, x: str, y: str) -> DataFrame:
    out = rows.select(F.col(group).cast("string").alias("g"), F.col(fold).cast("int").alias("f"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"))
    mass = F.aggregate("y", F.lit(0.0), lambda a, v: a + v)
    whole = [F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v)) for c in ("x", "y")]
    return out.dropna().where(whole[0] & whole[1]).where(mass > 0).withColumn("y", F.transform("y", lambda v: v / mass))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (g, f, n, x, y, s, q, c): up to HELD rows of a group's fold, their vectors as bytes, read by every round
    without being unpacked again; beside them the sums of x, of its squares and of y."""

    def together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        vectors = {}
        for c in ("x", "y"):
            column = table.column(c).combine_chunks()
            widths = pc.min_max(pc.list_value_length(column)).as_py()
            if widths["min"] != widths["max"]:
                raise ValueError("vectors of different widths")
            vectors[c] = column.flatten().to_numpy().reshape(table.num_rows, -1)
        out = []
        for (g, f), at in table.select(["g", "f"]).to_pandas().groupby(["g", "f"], sort=False).indices.items():
            x, y = vectors["x"][at], vectors["y"][at]
            out.append((g, f, len(at), x.tobytes(), y.tobytes(), x.sum(0).tolist(), (x * x).sum(0).tolist(), y.sum(0).tolist()))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], list("gfnxysqc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield together(held)
                held, n = [], 0
        if n:
            yield together(held)

    return rows.mapInArrow(run, "g string, f int, n long, x binary, y binary, s array<double>, q array<double>, c array<double>")


def _vectors(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x).reshape(n, -1)


def _models(blocks: DataFrame, held: list[int | None] | None, strengths: list[float], standard: bool) -> list[Model]:
    """Unfitted models, from sums by group and fold; held None: every fold in turn and none."""
    first = blocks.select(F.size("s").alias("d"), F.size("c").alias("k")).first()
    if first is None:
        return []
    d, k = first
    added = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c)
    sums = blocks.groupBy("g", "f").agg(F.sum("n").alias("n"), added("s", d), added("q", d), added("c", k))
    cells: dict[str, dict[int, tuple]] = defaultdict(dict)
    for r in sums.collect():
        cells[r.g][r.f] = (r.n, np.array(r.s), np.array(r.q), np.array(r.c))
    if sum(len(c) + 1 for c in cells.values()) * len(strengths) > MODELS:
        raise ValueError(f"more than {MODELS} models")
    out = []
    for g, by_fold in sorted(cells.items()):
        for h in held if held is not None else [*sorted(by_fold), None]:
            rest = [c for f, c in by_fold.items() if f != h]
            if not rest:
                continue
            n, s, q, c = (sum(part) for part in zip(*rest, strict=True))
            mean, scale = np.zeros(d), np.ones(d)
            if standard:
                mean, scale = s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0.0))
                scale[scale < 1e-12] = 1.0
            out += [Model(g, h, v, n, mean, scale, c > 0, np.zeros((k, d + 1))) for v in strengths]
    return out


def _sums(x: np.ndarray, t: np.ndarray, models: list[Model]) -> np.ndarray:
    """A row for each model, all of one standardization: loss, gradient and upper half of the curvature."""
    (k, d), n = models[0].weights.shape, len(models)
    w, seen = np.concatenate([m.weights for m in models]), np.stack([m.seen for m in models])
    (u, v), (i, j) = np.triu_indices(k), np.triu_indices(d)
    out = np.zeros((n, 1 + k * d + len(u) * len(i)))
    step = max(1, CELLS // max(len(i), n * len(u)))
    for at in range(0, len(x), step):
        a, y = models[0].design(x[at : at + step]), t[at : at + step, None, :]
        z = np.where(seen, (a @ w.T).reshape(-1, n, k), -np.inf)
        z -= z.max(2, keepdims=True)
        e = np.exp(z)
        mass = e.sum(2, keepdims=True)
        p = e / mass
        out[:, 0] -= (y * np.maximum(z - np.log(mass), math.log(FLOOR))).sum((0, 2))
        out[:, 1 : 1 + k * d] += ((p - y).reshape(-1, n * k).T @ a).reshape(n, k * d)
        bend = p[:, :, u] * ((u == v) - p[:, :, v])
        out[:, 1 + k * d :] += (bend.reshape(-1, n * len(u)).T @ (a[:, i] * a[:, j])).reshape(n, -1)
    return out


def _newton_sums(blocks: DataFrame, models: list[Model]) -> dict[int, np.ndarray]:
    """Loss, gradient and curvature of each model over its rows, laid out as one vector."""
    own: dict[str, list[tuple[int, Model]]] = defaultdict(list)
    for i, m in enumerate(models):
        if not m.done:
            own[m.group].append((i, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                x, y = _vectors(r["x"], r["n"]), _vectors(r["y"], r["n"])
                alike: dict[tuple, list[tuple[int, Model]]] = defaultdict(list)
                for i, m in own.get(r["g"], ()):
                    if m.held != r["f"]:
                        alike[m.mean.tobytes(), m.scale.tobytes()].append((i, m))
                for some in alike.values():
                    for (i, _), part in zip(some, _sums(x, y, [m for _, m in some]), strict=True):
                        sums[i] = sums[i] + part if i in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "s"])

    parts = blocks.select("g", "f", "n", "x", "y").mapInArrow(run, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "v"))
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("s")).select("i", "s.v")
    out = {}
    for r in found.collect():
        k, d = models[r.i].weights.shape
        s, (u, v), (i, j) = np.array(r.v), np.triu_indices(k), np.triu_indices(d)
        bend = np.zeros((k, d, k, d))
        for at, (one, two) in enumerate(zip(u, v, strict=True)):
            block = np.zeros((d, d))
            block[i, j] = s[1 + k * d + at * len(i) : 1 + k * d + (at + 1) * len(i)]
            block[j, i] = block[i, j]
            bend[one, :, two, :], bend[two, :, one, :] = block, block
        out[r.i] = np.concatenate([s[: 1 + k * d], bend.ravel()])
    return out


def _fit(blocks: DataFrame, models: list[Model], rounds: int, tolerance: float) -> None:
    """Newton's method with halved steps where the objective rose; the sum of a model's cross-entropies
    times its strength, plus half the squared weights (not the intercept's)."""
    for _ in range(rounds):
        sums = _newton_sums(blocks, models)
        for i, s in sums.items():
            m = models[i]
            k, d = m.weights.shape
            ridge = np.ones((k, d))
            ridge[:, -1] = 0.0
            value = m.strength * s[0] + 0.5 * (ridge * m.weights**2).sum()
            if m.step is not None and value > m.best + 1e-9 * abs(m.best):
                m.step = m.step / 2
                m.weights = m.weights + m.step  # back by half of the last step
                m.done = np.abs(m.step).max() < tolerance
                continue
            m.best = value
            slope = m.strength * s[1 : 1 + k * d] + (ridge * m.weights).ravel()
            bend = m.strength * s[1 + k * d :].reshape(k * d, k * d) + np.diag(ridge.ravel())
            # One direction has no curvature, all intercepts by the same, and no slope either; closed, it stays
            # as it is. A ridge on all would shorten the steps in every direction that few but the penalty bend.
            flat = np.zeros((k, d))
            flat[:, -1] = 1.0
            bend += np.outer(flat, flat) * max(1.0, np.trace(bend) / (k * d)) + np.diag(np.repeat(1.0 * ~m.seen, d))
            m.step = np.linalg.solve(bend, slope).reshape(k, d)
            m.step[~m.seen] = 0.0
            m.weights = m.weights - m.step
            m.done = np.abs(m.step).max() < tolerance or slope @ m.step.ravel() <= GAIN * abs(value)
        if all(m.done for m in models):
            return


def _losses(blocks: DataFrame, models: list[Model]) -> DataFrame:
    """(i, loss, hits, n) of each model over the fold it has not seen."""
    own: dict[tuple[str, int], list[tuple[int, Model]]] = defaultdict(list)
    for i, m in enumerate(models):
        if m.held is not None:
            own[m.group, m.held].append((i, m))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for g, f, n, x, y in zip(*[frame[c] for c in "gfnxy"], strict=True):
                x, y = _vectors(x, n), _vectors(y, n)
                for i, m in own.get((g, f), ()):
                    p = m.served(x)
                    out.append((i, -(y * np.log(np.maximum(p, FLOOR))).sum(), int((p.argmax(1) == y.argmax(1)).sum()), len(x)))
            if out:
                yield pd.DataFrame(out, columns=["i", "loss", "hits", "n"])

    return blocks.select("g", "f", "n", "x", "y").mapInPandas(run, "i int, loss double, hits long, n long").groupBy("i").agg(F.sum("loss").alias("loss"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def select_strength(rows: DataFrame, group: str, fold: str, x: str, y: str, strengths: list[float], rounds: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """Of each group the strength of least cross-entropy over held-out folds (their mean; the first if
    tied), and the weights of a fit on all folds: (group, strength, cv_loss, n, weights).

    Rows with a null group or fold, a null or not a number in a vector, or without label mass are left out;
    no rows, no groups. Vectors of different widths are an error.
    A group of one fold has nothing to choose by and takes the first strength, with a null cv_loss.
    """
    spark, ready = rows.sparkSession, _blocks(_ready(rows, group, fold, x, y)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = _models(ready, None, strengths, False)
        _fit(ready, models, rounds, tolerance)
        found = {r.i: r.loss / r.n for r in _losses(ready, models).collect()} if models else {}
    finally:
        ready.unpersist()
    mean: dict[tuple[str, float], list[float]] = defaultdict(list)
    for i, v in found.items():
        mean[models[i].group, models[i].strength].append(v)
    out = []
    for g in dict.fromkeys(m.group for m in models):
        loss = {v: math.fsum(mean[g, v]) / len(mean[g, v]) for v in strengths if mean[g, v]}
        chosen = min(loss, key=loss.__getitem__) if loss else strengths[0]
        m = next(m for m in models if m.group == g and m.held is None and m.strength == chosen)
        out.append((g, chosen, loss.get(chosen), m.n, m.weights.tolist()))
    return spark.createDataFrame(out, f"`{group}` string, strength double, cv_loss double, n long, weights array<array<double>>")


def validated_strength(rows: DataFrame, group: str, fold: str, x: str, y: str, strengths: list[float], valid: int = 1, rounds: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """Of each group the strength of greatest accuracy on the fold `valid`, then of least cross-entropy, then
    the first, fitted on the other folds: (group, strength, accuracy, nll, n). Nulls as in select_strength;
    groups without rows in `valid` or outside it are not returned."""
    spark, ready = rows.sparkSession, _blocks(_ready(rows, group, fold, x, y)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = _models(ready, [valid], strengths, False)
        _fit(ready, models, rounds, tolerance)
        found = _losses(ready, models).collect() if models else []
    finally:
        ready.unpersist()
    best: dict[str, tuple] = {}
    for r in sorted(found, key=lambda r: r.i):
        m, score = models[r.i], (r.hits / r.n, -r.loss / r.n)
        if m.group not in best or score > best[m.group][0]:
            best[m.group] = (score, m.strength, r.n)
    return spark.createDataFrame([(g, v, s[0], -s[1], n) for g, (s, v, n) in best.items()], f"`{group}` string, strength double, accuracy double, nll double, n long")


def out_of_fold(rows: DataFrame, group: str, fold: str, x: str, y: str, key: str, strength: float = 0.5, rounds: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """(key, p) of every row by the model that has not seen its fold, features standardized on the others.

    A row is left out if select_strength leaves it out, or if its group has no other fold.
    """
    kind = dict(rows.dtypes)[key]
    ready = _blocks(_ready(rows, group, fold, x, y)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = [m for m in _models(ready, None, [strength], True) if m.held is not None]
        _fit(ready, models, rounds, tolerance)
    finally:
        ready.unpersist()
    own = {(m.group, m.held): m for m in models}
    asked = rows.select(F.col(key).alias("key"), F.col(group).cast("string").alias("g"), F.col(fold).cast("int").alias("f"), F.col(x).cast("array<double>").alias("x"), F.col(y).alias("y")).dropna(subset=["g", "f", "x", "y"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at_key, at in frame.groupby(["g", "f"], sort=False).indices.items():
                if at_key in own:
                    p = own[at_key].served(np.stack(frame["x"].to_numpy()[at]))
                    yield pd.DataFrame({"key": frame["key"].to_numpy()[at], "p": list(p)})

    return asked.drop("y").mapInPandas(run, f"key {kind}, p array<double>").withColumnRenamed("key", key)
