"""Resampling of clusters as weights: how often each replicate draws a cluster stands beside its rows.

Rows are never copied. Each carries one byte for each replicate, and a statistic of all replicates is
read off weighted running sums, so that even statistics that sort their rows (calibration error in
equal-mass bins, area under the curve, best threshold) sort them once for all replicates.

What replicates come to is a few rows and made once, as intervals and tests read it again and again.

Scores lie in [0, 1] and are cut into buckets; a task orders one bucket of one group, and what lies
before a bucket comes from at most MOST_BUCKETS rows of sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.dealing import kept
from .calibration import WIDE, grid
from .metrics import scored
from .significance import FOLDS

#: Clusters of a leaf, about, and the deepest tree.
LEAF, DEPTH = 1024, 14
#: Rows that a task orders at a time, about.
BUCKET_ROWS, MOST_BUCKETS = 8192, 1 << 16
#: Stands for clusters that a replicate doesn't draw.
UNDRAWN = 255
#: Fixed value: the threshold above every score.
TOP = 1 + 1e-9


def _kinds(df: DataFrame, by: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in by)


def _keyed(frame: pd.DataFrame, by: list[str], **columns) -> pd.DataFrame:
    """Columns beside the group's keys, which are plain objects even if there are no rows."""
    n = len(next(iter(columns.values())))
    return pd.DataFrame({**{c: pd.Series([frame[c].iloc[0]] * n, dtype=object) for c in by}, **columns})


def _unpacked(column: pd.Series, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


def node_seed(seed: str, keys: list) -> int:
    return zlib.crc32("|".join([seed, *map(str, keys)]).encode())


def split_draws(counts: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How many of each replicate's draws fall into each leaf. As many draws as there are clusters start
    at the root; a node's draws go left by a binomial draw with the left child's share of its clusters."""
    depth = (len(counts) - 1).bit_length()
    sums = [counts.reshape(1 << d, -1).sum(1) for d in range(depth + 1)]
    k = np.full((1, replicates), sums[0][0], np.int64)
    for d in range(depth):
        below = np.zeros((2 << d, replicates), np.int64)
        for node in np.flatnonzero(sums[d]):
            below[2 * node] = np.random.default_rng([seed, d, node]).binomial(k[node], sums[d + 1][2 * node] / sums[d][node])
        below[1::2] = k - below[::2]
        k = below
    return k


def leaf_draws(n: int, k: np.ndarray, seed: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, replicates): how often each of a leaf's n clusters is drawn, and its place in a drawn order of
    those that are."""
    times, place = np.zeros((n, len(k)), np.uint8), np.zeros((n, len(k)), np.int32)
    for b, draws in enumerate(k):
        rng = np.random.default_rng([seed, DEPTH + 1, leaf, b])
        found = np.bincount(rng.integers(0, n, draws), minlength=n)
        if found.max(initial=0) >= UNDRAWN:
            raise ValueError("a cluster is drawn too often for a byte")
        times[:, b] = found
        order = rng.permutation(n)
        at = order[found[order] > 0]
        place[at, b] = np.arange(len(at))
    return times, place


def drawn(df: DataFrame, by: list[str], cluster: str, replicates: int, seed: str, folds: int = FOLDS) -> DataFrame:
    """Rows (by, cluster, times, fold) for each group's clusters: bytes, one for each replicate, of how
    often it is drawn, and of the fold of the distinct drawn ones, dealt in a drawn order (UNDRAWN: not
    drawn). Equal groups of clusters draw alike under one seed, in any partitioning.

    Draws go down a tree of hash parts, so no cluster has a number and no task makes a replicate's
    draws: a group's task splits counts of at most 2 ** DEPTH leaves, and each leaf's draws its own.
    """
    named = kept(df.where(F.col(cluster).isNotNull()).select(*by, cluster).distinct())
    most = named.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = min(DEPTH, (max(most - 1, 0) // LEAF).bit_length())
    leaf = F.shiftrightunsigned(F.xxhash64(cluster), 64 - depth).cast("int") if depth else F.lit(0)
    placed = named.withColumn("_leaf", leaf)
    keys = _kinds(df, by)

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << depth, np.int64)
        counts[frame["_leaf"]] = frame["_n"]
        k = split_draws(counts, replicates, node_seed(seed, list(frame[by].iloc[0])))
        return _keyed(frame, by, _leaf=frame["_leaf"].to_numpy(), _n=frame["_n"].to_numpy(), _k=[k[i].tobytes() for i in frame["_leaf"]])

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = []
            for key, i, n, k in zip(frame[by].to_numpy().tolist(), frame["_leaf"], frame["_n"], frame["_k"], strict=True):
                times, _ = leaf_draws(n, np.frombuffer(k, np.int64), node_seed(seed, key), i)
                found.append((times > 0).sum(0).astype(np.int64).tobytes())
            yield frame.assign(_m=found)

    def before(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_leaf")
        m = _unpacked(frame["_m"], "<i8", replicates)
        return _keyed(frame, by, _leaf=frame["_leaf"].to_numpy(), _k=frame["_k"].to_numpy(), _o=[x.tobytes() for x in (m.cumsum(0) - m) % folds])

    def deal(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(cluster)
        times, place = leaf_draws(len(frame), np.frombuffer(told["_k"].iloc[0], np.int64), node_seed(seed, list(frame[by].iloc[0])), int(frame["_leaf"].iloc[0]))
        fold = np.where(times > 0, (place + np.frombuffer(told["_o"].iloc[0], np.int64)) % folds, UNDRAWN).astype(np.uint8)
        return _keyed(frame, by, **{cluster: frame[cluster].to_numpy()}, times=[x.tobytes() for x in times], fold=[x.tobytes() for x in fold])

    sizes = placed.groupBy(*by, "_leaf").agg(F.count("*").alias("_n"))
    splits = sizes.groupBy(*by).applyInPandas(split, f"{keys}, _leaf int, _n long, _k binary")
    counted = splits.repartition(F.col("_leaf"), *by).mapInPandas(distinct, f"{keys}, _leaf int, _n long, _k binary, _m binary")
    told = counted.groupBy(*by).applyInPandas(before, f"{keys}, _leaf int, _k binary, _o binary")
    return placed.groupBy(*by, "_leaf").cogroup(told.groupBy(*by, "_leaf")).applyInPandas(deal, f"{keys}, `{cluster}` {dict(df.dtypes)[cluster]}, times binary, fold binary")


def _bucketed(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """rows with the bucket _b of their score: as many buckets as hold BUCKET_ROWS of the largest group
    on average, at most MOST_BUCKETS."""
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n = min(MOST_BUCKETS, most // BUCKET_ROWS + 1)
    return rows.withColumn("_b", F.least(F.floor(F.col(score) * n), F.lit(n - 1)).cast("int"))


def weighted_ece(rows: DataFrame, by: list[str], score: str, value: str, ties: list[str], replicates: int, bins: int = 10) -> DataFrame:
    """Rows (by, b, stat): each replicate's calibration error over equal-mass bins of its drawn rows,
    ordered by (score, ties), copies of a row side by side. rows: by, score, value, ties, times."""
    cut = _bucketed(rows.select(*by, score, value, *ties, "times"), by, score)
    keys = _kinds(rows, by)

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return _keyed(frame, by, _b=[int(frame["_b"].iloc[0])], _w=[_unpacked(frame["times"], "u1", replicates).sum(0, dtype=np.int64).tobytes()])

    def before(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_b")
        w = _unpacked(frame["_w"], "<i8", replicates)
        return _keyed(frame, by, _b=frame["_b"].to_numpy(), _o=[x.tobytes() for x in w.cumsum(0) - w], _t=[w.sum(0).tobytes()] * len(frame))

    def cells(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([score, *ties])
        w = _unpacked(frame["times"], "u1", replicates).astype(np.int64)
        low, whole = (np.frombuffer(told[c].iloc[0], np.int64) for c in ("_o", "_t"))
        s, v = (np.append(frame[c].to_numpy(float), 0.0) for c in (score, value))
        out = []
        for b in range(replicates):
            c = np.concatenate([[0], np.cumsum(w[:, b])])
            x = np.clip(np.round(np.arange(bins + 1) * whole[b] / bins).astype(np.int64) - low[b], 0, c[-1])
            # The row in which a place lies, and the sums up to it.
            i = np.searchsorted(c[1:], x, "left")
            up_to = [np.concatenate([[0], np.cumsum(w[:, b] * y[:-1])])[i] + y[i] * (x - c[i]) for y in (s, v)]
            for j in np.flatnonzero(np.diff(x)):
                out.append((b, j, x[j + 1] - x[j], *(y[j + 1] - y[j] for y in up_to)))
        b, j, n, x, y = zip(*out, strict=True) if out else [[]] * 5
        return _keyed(frame, by, b=np.array(b, np.int32), _j=np.array(j, np.int32), _n=np.array(n, np.int64), _s=np.array(x, float), _v=np.array(y, float))

    sums = cut.groupBy(*by, "_b").applyInPandas(total, f"{keys}, _b int, _w binary")
    told = sums.groupBy(*by).applyInPandas(before, f"{keys}, _b int, _o binary, _t binary")
    found = cut.groupBy(*by, "_b").cogroup(told.groupBy(*by, "_b")).applyInPandas(cells, f"{keys}, b int, _j int, _n long, _s double, _v double")
    found = found.groupBy(*by, "b", "_j").agg(F.sum("_n").alias("_n"), F.abs(F.sum("_s") - F.sum("_v")).alias("_d"))
    return found.groupBy(*by, "b").agg((F.sum("_d") / F.sum("_n")).alias("stat"))


def weighted_area(rows: DataFrame, by: list[str], score: str, positive: str, replicates: int) -> DataFrame:
    """Rows (by, b, stat): each replicate's area under the curve, half for ties; replicates of one class
    are left out. rows: by, score, positive, times."""
    cut = _bucketed(rows.select(*by, score, positive, "times"), by, score)
    keys = _kinds(rows, by)

    def wins(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(score)
        w, pos = _unpacked(frame["times"], "u1", replicates).astype(np.int64), frame[positive].to_numpy(bool)[:, None]
        first = np.flatnonzero(np.append(True, np.diff(frame[score].to_numpy()) > 0))
        p, n = np.add.reduceat(w * pos, first), np.add.reduceat(w * ~pos, first)
        own = (p * (n.cumsum(0) - n / 2)).sum(0)
        return _keyed(frame, by, _b=[int(frame["_b"].iloc[0])], _own=[own.tobytes()], _p=[p.sum(0).tobytes()], _n=[n.sum(0).tobytes()])

    def area(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_b")
        own, p, n = _unpacked(frame["_own"], "<f8", replicates), _unpacked(frame["_p"], "<i8", replicates), _unpacked(frame["_n"], "<i8", replicates)
        won, pairs = (own + p * (n.cumsum(0) - n)).sum(0), p.sum(0) * n.sum(0)
        b = np.flatnonzero(pairs)
        return _keyed(frame, by, b=b.astype(np.int32), stat=won[b] / pairs[b])

    sums = cut.groupBy(*by, "_b").applyInPandas(wins, f"{keys}, _b int, _own binary, _p binary, _n binary")
    return sums.groupBy(*by).applyInPandas(area, f"{keys}, b int, stat double")


def weighted_mean(rows: DataFrame, by: list[str], value: str, cluster: str, draws: DataFrame, replicates: int) -> DataFrame:
    """Rows (by, b, stat): each replicate's mean of value; rows are summed by cluster before they meet
    their draws."""
    sums = rows.groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(value).alias("_n")).join(draws, [*by, cluster])
    return _summed(sums, by, replicates, {"_s": lambda f, w: w.T @ f["_s"].to_numpy(float), "_n": lambda f, w: w.T @ f["_n"].to_numpy(float)}).select(*by, "b", (F.col("_s") / F.col("_n")).alias("stat"))


def _summed(rows: DataFrame, by: list[str], replicates: int, sums: dict[str, Callable]) -> DataFrame:
    """Rows (by, b, sums): each function gives a partition's sum for each replicate from its rows and
    their weights (rows by replicates)."""
    names = list(sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, frame in batch.groupby(by, sort=False, dropna=False):
                w = _unpacked(frame["times"], "u1", replicates).astype(float)
                held[key] = held.get(key, 0) + np.stack([sums[c](frame, w) for c in names])
        for key, found in held.items():
            yield pd.DataFrame({**dict(zip(by, key, strict=True)), "b": np.arange(replicates, dtype=np.int32), **dict(zip(names, found, strict=True))})

    found = rows.mapInPandas(run, f"{_kinds(rows, by)}, b int, " + ", ".join(f"{c} double" for c in names))
    return found.groupBy(*by, "b").agg(*[F.sum(c).alias(c) for c in names])


def _logs(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with vectors of one length at a time: their places, and the logarithms."""
    width = frame["p"].str.len().to_numpy()
    for k in np.unique(width):
        at = np.flatnonzero(width == k)
        yield at, np.log(np.maximum(np.stack(frame["p"].iloc[at].to_numpy()).astype(float), V.FLOOR))


def _nll_of_grid(frame: pd.DataFrame, inverse: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed negative log-likelihood for each column of weights at each inverse temperature. The grid is met
    one temperature at a time, so a task holds one number for each decision."""
    y, out = frame["y"].to_numpy(np.int64), np.zeros((weights.shape[1], len(inverse)))
    for at, logs in _logs(frame):
        own, w = logs[np.arange(len(at)), y[at]], weights[at].T.astype(float)
        for g, x in enumerate(inverse):
            out[:, g] += w @ -np.log(np.maximum(np.exp(own * x) / np.exp(logs * x).sum(1), V.FLOOR))
    return out


def refit_temperatures(dec: DataFrame, by: list[str], cluster: str, replicates: int, seed: str, spec: tuple = WIDE) -> DataFrame:
    """Rows (by, b, temperature, gi, n): the temperature refitted to each replicate's drawn clusters, the
    first of the least likelihoods, and how many decisions it has. dec: by, cluster, p, y.

    A task multiplies its rows' weights with their likelihoods; what leaves it is a vector of the grid for
    each group and replicate.
    """
    rows = scored(dec).select(*by, cluster, "p", "y").join(drawn(dec, by, cluster, replicates, seed), [*by, cluster])
    temperatures = grid(*spec)
    inverse = 1 / np.array(temperatures)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, frame in batch.groupby(by, sort=False, dropna=False):
                w = _unpacked(frame["times"], "u1", replicates)
                held[key] = held.get(key, 0) + np.hstack([_nll_of_grid(frame, inverse, w), w.sum(0, dtype=float)[:, None]])
        for key, found in held.items():
            yield pd.DataFrame({**dict(zip(by, key, strict=True)), "b": np.arange(replicates, dtype=np.int32), "_n": [x.tobytes() for x in found]})

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        found = _unpacked(frame["_n"], "<f8", len(inverse) + 1).sum(0)
        gi = int(np.round(found[:-1], 6).argmin())
        return _keyed(frame, by, b=[int(frame["b"].iloc[0])], temperature=[temperatures[gi]], gi=[gi], n=[int(found[-1])])

    keys = _kinds(rows, by)
    parts = rows.select(*by, "p", "y", "times").mapInPandas(sums, f"{keys}, b int, _n binary")
    return kept(parts.groupBy(*by, "b").applyInPandas(best, f"{keys}, b int, temperature double, gi int, n long").where("n > 0"))


def refit_grid(rows: DataFrame, by: list[str], replicates: int, spec: tuple = WIDE, folds: int = FOLDS) -> DataFrame:
    """Rows (by, b, fold, gi): the place on the grid of the temperature fitted to each replicate's other
    folds, the first of the least likelihoods. rows: by, p, y, times, fold."""
    inverse = 1 / np.array(grid(*spec))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, frame in batch.groupby(by, sort=False, dropna=False):
                w, fold = (_unpacked(frame[c], "u1", replicates) for c in ("times", "fold"))
                own = np.hstack([w * (fold == f) for f in range(folds)])
                held[key] = held.get(key, 0) + _nll_of_grid(frame, inverse, own).reshape(folds, replicates, -1)
        for key, found in held.items():
            yield pd.DataFrame({**dict(zip(by, key, strict=True)), "b": np.arange(replicates, dtype=np.int32), "_n": [np.ascontiguousarray(found[:, b]).tobytes() for b in range(replicates)]})

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        found = _unpacked(frame["_n"], "<f8", folds * len(inverse)).sum(0).reshape(folds, -1)
        return _keyed(frame, by, b=[int(frame["b"].iloc[0])] * folds, fold=np.arange(folds), gi=np.round(found.sum(0) - found, 6).argmin(1))

    keys = _kinds(rows, by)
    return rows.select(*by, "p", "y", "times", "fold").mapInPandas(sums, f"{keys}, b int, _n binary").groupBy(*by, "b").applyInPandas(best, f"{keys}, b int, fold int, gi int")


def refit_ece(dec: DataFrame, by: list[str], cluster: str, ties: list[str], replicates: int, seed: str, spec: tuple = WIDE, folds: int = FOLDS) -> DataFrame:
    """Rows (by, b, what, stat): each replicate's calibration error as answered, and scaled with
    temperatures that are fitted anew by folds of its drawn clusters. dec: by, cluster, ties, p, y,
    correct.

    The chosen places on the grid (replicates times folds for each group) are few different ones; a
    decision is scaled once for each of them, and weighs where a replicate uses it.
    """
    dec = scored(dec)
    rows = kept(dec.select(*by, cluster, *ties, "p", "y", "correct").join(drawn(dec, by, cluster, replicates, seed, folds), [*by, cluster]))
    chosen: dict[tuple, np.ndarray] = {}
    for r in refit_grid(rows, by, replicates, spec, folds).collect():
        chosen.setdefault(tuple(r[c] for c in by), np.zeros((replicates, folds), np.int64))[r["b"], r["fold"]] = r["gi"]
    inverse, kinds = 1 / np.array(grid(*spec)), dict(dec.dtypes)

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, frame in batch.groupby(by, sort=False, dropna=False):
                w, fold = (_unpacked(frame[c], "u1", replicates) for c in ("times", "fold"))
                use = np.where(w > 0, chosen[key][np.arange(replicates), np.minimum(fold, folds - 1)], -1)
                for g in np.unique(use[use >= 0]):
                    conf = np.empty(len(frame))
                    for at, logs in _logs(frame):
                        e = np.exp(logs * inverse[g])
                        conf[at] = e.max(1) / e.sum(1)
                    own = w * (use == g)
                    at = np.flatnonzero(own.any(1))
                    same = {c: frame[c].to_numpy(object)[at] for c in [*by, *ties, "correct"]}
                    yield pd.DataFrame({**{c: same[c] for c in by}, "what": "scaled", **{c: same[c] for c in [*ties, "correct"]}, "conf": conf[at], "times": [own[i].tobytes() for i in at]}, dtype=object)

    after = rows.mapInPandas(scaled, f"{_kinds(dec, by)}, what string, " + ", ".join(f"`{c}` {kinds[c]}" for c in ties) + f", correct {kinds['correct']}, conf double, times binary")
    shipped = rows.select(*by, F.lit("shipped").alias("what"), *ties, "correct", F.array_max("p").alias("conf"), "times")
    return kept(weighted_ece(kept(after.unionByName(shipped)), [*by, "what"], "conf", "correct", ties, replicates))


def refit_thresholds(rows: DataFrame, by: list[str], replicates: int, folds: int = FOLDS) -> DataFrame:
    """Rows (by, tau), tau being doubles (fold by replicate): the threshold with the most right decisions
    in the replicate's other folds, the least if tied. rows: by, conf, c1, c2, times, fold."""
    cut, none, keys = _bucketed(rows.select(*by, "conf", "c1", "c2", "times", "fold"), by, "conf"), np.iinfo(np.int64).min // 2, _kinds(rows, by)

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("conf")
        w, fold = (_unpacked(frame[c], "u1", replicates) for c in ("times", "fold"))
        gain, conf = (frame["c2"] - frame["c1"]).to_numpy(np.int64)[:, None], frame["conf"].to_numpy()
        first = np.flatnonzero(np.append(True, np.diff(conf) > 0))
        total, value, tau = [], [], []
        for k in range(folds):
            own = w.astype(np.int64) * (fold != k)
            moved = np.add.reduceat(own * gain, first)
            at = np.where(np.add.reduceat(own, first) > 0, moved.cumsum(0) - moved, none)
            i = at.argmax(0)
            total.append(moved.sum(0)), value.append(at[i, np.arange(replicates)]), tau.append(conf[first[i]])
        return _keyed(frame, by, _b=[int(frame["_b"].iloc[0])], _t=[np.stack(total).tobytes()], _v=[np.stack(value).tobytes()], _x=[np.stack(tau).tobytes()])

    def over_all(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_b")
        total, value, tau = (_unpacked(frame[c], kind, folds * replicates) for c, kind in (("_t", "<i8"), ("_v", "<i8"), ("_x", "<f8")))
        ends = np.zeros((1, folds * replicates))
        value = np.concatenate([ends.astype(np.int64), value + total.cumsum(0) - total, total.sum(0)[None]])
        tau = np.concatenate([ends, tau, ends + TOP])
        return _keyed(frame, by, tau=[tau[value.argmax(0), np.arange(folds * replicates)].tobytes()])

    sums = cut.groupBy(*by, "_b").applyInPandas(best, f"{keys}, _b int, _t binary, _v binary, _x binary")
    return sums.groupBy(*by).applyInPandas(over_all, f"{keys}, tau binary")


def refit_cascade(pairs: DataFrame, by: list[str], cluster: str, replicates: int, seed: str, first_cost: str, second_cost: str, folds: int = FOLDS) -> DataFrame:
    """Rows (by, b, accuracy, gain, escalated, cost_fraction): a cascade's statistics in each replicate,
    each of its folds escalated below the threshold that is best for its other folds. pairs: by, cluster,
    conf, c1, c2 and the costs of both stages."""
    pairs = kept(pairs.select(*by, cluster, "conf", "c1", "c2", F.col(first_cost).alias("_l1"), F.col(second_cost).alias("_l2")))
    rows = kept(pairs.join(drawn(pairs, by, cluster, replicates, seed, folds), [*by, cluster]))
    taus = {tuple(r[c] for c in by): np.frombuffer(r["tau"], float).reshape(folds, replicates) for r in refit_thresholds(rows, by, replicates, folds).collect()}

    def up(frame: pd.DataFrame) -> np.ndarray:
        fold = _unpacked(frame["fold"], "u1", replicates)
        return frame["conf"].to_numpy()[:, None] < taus[tuple(frame[by].iloc[0])][np.minimum(fold, folds - 1), np.arange(replicates)]

    def of(name: str) -> Callable:
        return lambda f, w: w.T @ f[name].to_numpy(float)

    found = _summed(
        rows,
        by,
        replicates,
        {
            "n": lambda f, w: w.sum(0),
            "r": lambda f, w: (w * np.where(up(f), f[["c2"]], f[["c1"]])).sum(0),
            "r1": of("c1"),
            "r2": of("c2"),
            "up": lambda f, w: (w * up(f)).sum(0),
            "spent": lambda f, w: of("_l1")(f, w) + (w * up(f)).T @ f["_l2"].to_numpy(float),
            "alone": of("_l2"),
        },
    )
    return kept(found.select(*by, "b", (F.col("r") / F.col("n")).alias("accuracy"), ((F.col("r") - F.greatest("r1", "r2")) / F.col("n")).alias("gain"), (F.col("up") / F.col("n")).alias("escalated"), F.when(F.col("alone") > 0, F.col("spent") / F.col("alone")).alias("cost_fraction")))
