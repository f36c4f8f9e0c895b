"""Map optimisation: many starts over one small table of distances, fanned out by start.

The distances of one chart (some thousands of edges) go to every task; each task
runs the starts that it was dealt.  A start's random numbers depend on the seed
and its number alone, so results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relative change of stress and gradient norm at which a search ends.
PRECISION = {"fine": (1e-10, 1e-6), "rough": (1e-3, 0.5), "very_rough": (1e-1, 1.0)}
#: Edges of a chart that are sent to tasks, at most.
MOST_EDGES = 5_000_000


class Distances(NamedTuple):
    p1: np.ndarray
    p2: np.ndarray
    target: np.ndarray
    less: np.ndarray
    n_points: int


def collected(edges: DataFrame, n_points: int) -> Distances:
    """The edges of one chart as arrays, if they are few enough to be sent to every task."""
    n = edges.count()
    if n > MOST_EDGES:
        raise ValueError(f"{n} distances are too many for one chart")
    pdf = edges.select("p1", "p2", "kind", "distance").orderBy("p1", "p2").toPandas()
    return Distances(pdf.p1.to_numpy(), pdf.p2.to_numpy(), pdf.distance.to_numpy(float), (pdf.kind == "less_than").to_numpy(), n_points)


def stress_and_gradient(d: Distances, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Of a layout of shape (points, dimensions)."""
    delta = x[d.p1] - x[d.p2]
    m = np.sqrt((delta**2).sum(axis=1))
    m = np.where(m == 0, 1e-5, m)
    diff = d.target - m
    low = np.where(d.less, diff + 1, diff)
    s = 1 / (1 + np.exp(-np.clip(10 * low, -500, 500)))
    total = np.where(d.less, low * low * s, low * low).sum()
    by = np.where(d.less, 2 * low * s + low * low * s * (1 - s) * 10, 2 * low)
    force = (-by / m)[:, None] * delta
    g = np.stack([np.bincount(d.p1, force[:, k], d.n_points) - np.bincount(d.p2, force[:, k], d.n_points) for k in range(x.shape[1])], axis=1)
    return float(total), g


def minimise(d: Distances, x: np.ndarray, precision: str = "fine", fixed: np.ndarray | None = None, most: int = 3000, memory: int = 12, method: str = "quasi-newton") -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton descent, or conjugate gradients (method "cg"), with a backtracking line search; fixed marks points that stay."""
    relative, norm = PRECISION[precision]
    x = x.copy()
    free = np.ones(len(x), bool) if fixed is None else ~fixed
    f, g = stress_and_gradient(d, x)
    g = g * free[:, None]
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    before, last, reach = None, None, 1.0  # the gradient, step and length before, of conjugate gradients
    for _ in range(most):
        if np.sqrt((g * g).sum()) <= norm * 1e-3:
            break
        q, alphas = g.ravel().copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(pairs, reversed(alphas)):
            q += (a - r * (y @ q)) * s
        step = -q.reshape(x.shape)
        if method == "cg" and before is not None:
            step = -g + max(0.0, float((g * (g - before)).sum() / (before * before).sum())) * last
        slope = float((step * g).sum())
        if slope >= 0:
            step, slope, pairs = -g, -float((g * g).sum()), []
        before, last = g, step
        t = 2 * reach if method == "cg" and reach < 1.0 else 1.0 if pairs else min(1.0, 1.0 / (np.abs(g).max() + 1e-12))
        while True:
            f2, g2 = stress_and_gradient(d, x + t * step)
            if f2 <= f + 1e-4 * t * slope or t < 1e-12:
                break
            t /= 2
        reach = t
        if t < 1e-12:
            break
        g2 = g2 * free[:, None]
        s, y = (t * step).ravel(), (g2 - g).ravel()
        if method != "cg" and s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))]
        done = f - f2 <= relative * max(f, 1e-12)
        x, f, g = x + t * step, f2, g2
        if done:
            break
    return x, f


def reduced(x: np.ndarray, dims: int) -> np.ndarray:
    """The layout on its first principal axes."""
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    return centred @ vt[:dims].T


def start_layout(d: Distances, dims: int, seed: int, start: int, diameter: float) -> np.ndarray:
    """Uniform in a box; the numbers depend on seed and start alone."""
    return np.random.Generator(np.random.MT19937([seed, start])).uniform(-diameter / 2, diameter / 2, (d.n_points, dims))


def diameter_of(d: Distances, dims: int, seed: int) -> float:
    """Twice the extent of one very rough map from a box of the greatest distance."""
    first = float(d.target.max()) if len(d.target) else 1.0
    x, _ = minimise(d, start_layout(d, dims, seed, -1 % (1 << 31), first), "very_rough")
    return 2 * float(np.ptp(x, axis=0).max()) or first


def anneal(d: Distances, x: np.ndarray, dims: int, precision: str, fixed: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Down one dimension at a time: a rough map, its principal axes, and at the end the wanted precision."""
    for k in range(x.shape[1], dims, -1):
        x, _ = minimise(d, x, "rough", fixed)
        x = reduced(x, k - 1)
    return minimise(d, x, precision, fixed)


_layout_schema = "start int, stress double, point_no int, coord array<double>"


def _rows(start: int, stress: float, x: np.ndarray, there: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"start": start, "stress": stress, "point_no": np.arange(len(x)), "coord": [list(c) if t else None for c, t in zip(x.tolist(), there)]}).astype({"start": "int32", "point_no": "int32"})


def relax(spark: SparkSession, edges: DataFrame, n_points: int, starts: int, dims: int = 2, seed: int = 1, annealing_from: int | None = None, precision: str = "fine", partitions: int | None = None) -> DataFrame:
    """start, stress, point_no, coord (null: without distances) of every start."""
    d = collected(edges, n_points)
    there = np.zeros(n_points, bool)
    there[d.p1], there[d.p2] = True, True
    high = max(dims, annealing_from or dims)
    diameter = diameter_of(d, high, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in pdf["id"].tolist():
                x, f = anneal(d, start_layout(d, high, seed, start, diameter), dims, precision)
                yield _rows(start, f, x, there)

    return spark.range(0, starts, 1, partitions or min(starts, spark.sparkContext.defaultParallelism)).mapInPandas(run, _layout_schema)


def best(projections: DataFrame, keep: int = 1) -> DataFrame:
    """The projections with the least stress, place from 1; NaN counts as worst."""
    order = projections.groupBy("start").agg(F.first("stress").alias("stress")).orderBy("stress", "start").limit(keep)
    places = order.select("start", F.row_number().over(_by_stress()).alias("place"))
    return projections.join(F.broadcast(places), "start")  # keep rows


def _by_stress():
    from pyspark.sql import Window

    return Window.orderBy("stress", "start")


def relax_incremental(spark: SparkSession, edges: DataFrame, layout: np.ndarray, starts: int, freeze: bool = False, seed: int = 1, fine: int = 5) -> DataFrame:
    """Only points without coordinates are placed at random, or, if frozen, only they move; the best few of the rough maps are made fine."""
    d = collected(edges, len(layout))
    new = np.isnan(layout).any(axis=1)
    there = np.zeros(len(layout), bool)
    there[d.p1], there[d.p2] = True, True
    size = float(np.ptp(layout[~new], axis=0).max()) if (~new).any() else diameter_of(d, layout.shape[1], seed)
    middle = layout[~new].mean(axis=0) if (~new).any() else np.zeros(layout.shape[1])

    def begin(start: int) -> np.ndarray:
        x = middle + start_layout(d, layout.shape[1], seed, start, 2 * size)
        x[~new] = layout[~new]
        return x

    fixed = ~new if freeze else None

    def rough(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in pdf["id"].tolist():
                x, f = minimise(d, begin(start), "rough", fixed)
                yield _rows(start, f, x, there | ~new)

    found = spark.range(0, starts, 1, min(starts, spark.sparkContext.defaultParallelism)).mapInPandas(rough, _layout_schema)
    some = best(found, fine)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_no")
        x = np.array([c if c is not None else [0.0] * layout.shape[1] for c in pdf["coord"]])
        x, f = minimise(d, x, "fine", fixed)
        return _rows(int(pdf["start"].iloc[0]), f, x, there | ~new)

    return some.groupBy("start").applyInPandas(finish, _layout_schema)  # one layout a group


def grid_test(spark: SparkSession, edges: DataFrame, layout: np.ndarray, step: float = 0.1, far: float = 1.0, near_equal: float = 0.25, points: list[int] | None = None) -> DataFrame:
    """point_no, status (normal, trapped, hemisphering, disconnected), distance to the better place, change of its contribution, that place.

    Of every point its contribution to stress is computed at all points of a
    grid over the box in which its distances could be met.
    """
    d = collected(edges, len(layout))

    def one(p: int) -> tuple:
        mine = (d.p1 == p) | (d.p2 == p)
        other = np.where(d.p1[mine] == p, d.p2[mine], d.p1[mine])
        if not mine.any() or np.isnan(layout[p]).any():
            return p, "disconnected", None, None, None
        at, target, less = layout[other], d.target[mine], d.less[mine]
        ok = ~np.isnan(at).any(axis=1)
        at, target, less = at[ok], target[ok], less[ok]

        def cost(where: np.ndarray) -> np.ndarray:
            m = np.sqrt(((where[:, None, :] - at[None]) ** 2).sum(axis=2))
            low = target - m + less
            return np.where(less, low * low / (1 + np.exp(-np.clip(10 * low, -500, 500))), low * low).sum(axis=1)

        home = float(cost(layout[p][None])[0])
        lows, highs = (at - target[:, None] - 1).min(axis=0), (at + target[:, None] + 1).max(axis=0)
        axes = [np.arange(a, b + step, step) for a, b in zip(lows, highs)]
        least, place, hemi, hemi_place = home, None, None, None
        for first in axes[0]:  # one line of the grid at a time
            grid = np.stack(np.meshgrid([first], *axes[1:], indexing="ij"), axis=-1).reshape(-1, layout.shape[1])
            c = cost(grid)
            k = int(c.argmin())
            if c[k] < least:
                least, place = float(c[k]), grid[k]
            away = np.sqrt(((grid - layout[p]) ** 2).sum(axis=1)) > far
            if away.any() and (h := float(c[away].min())) < home + near_equal and (hemi is None or h < hemi):
                hemi, hemi_place = h, grid[away][int(c[away].argmin())]
        if place is not None and np.linalg.norm(place - layout[p]) > far:
            return p, "trapped", float(np.linalg.norm(place - layout[p])), least - home, place.tolist()
        if hemi_place is not None:
            return p, "hemisphering", float(np.linalg.norm(hemi_place - layout[p])), hemi - home, hemi_place.tolist()
        return p, "normal", 0.0, 0.0, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([one(p) for p in pdf["point_no"].tolist()], columns=["point_no", "status", "distance", "change", "place"])

    wanted = spark.createDataFrame([(int(p),) for p in (points if points is not None else range(len(layout)))], "point_no int")
    return wanted.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "point_no int, status string, distance double, change double, place array<double>")


def avidity_test(spark: SparkSession, edges: DataFrame, layout: np.ndarray, antigens: list[int], adjusts: tuple[float, ...] = (*range(-6, 0), *range(1, 7))) -> DataFrame:
    """antigen_no, adjust, stress_change, moved, most_moved: a map for every antigen with every adjustment of its titers, from the layout as it is."""
    d = collected(edges, len(layout))
    there = ~np.isnan(layout).any(axis=1)
    start = np.where(there[:, None], layout, 0.0)
    _, home = minimise(d, start, "rough")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p, a in zip(pdf["antigen_no"].tolist(), pdf["adjust"].tolist()):
                target = np.where((d.p1 == p) | (d.p2 == p), np.maximum(0, d.target - a), d.target)
                x, f = minimise(d._replace(target=target), start, "rough")
                moved = np.sqrt(((_onto(start[there], x[there]) - start[there]) ** 2).sum(axis=1))
                out.append((p, a, f - home, float(np.linalg.norm(_onto(start, x)[p] - start[p])), ",".join(str(k) for k in np.flatnonzero(there)[np.argsort(-moved, kind="stable")[:5]])))
            yield pd.DataFrame(out, columns=["antigen_no", "adjust", "stress_change", "moved", "most_moved"])

    pairs = spark.createDataFrame([(int(p), float(a)) for p in antigens for a in adjusts], "antigen_no int, adjust double")
    return pairs.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "antigen_no int, adjust double, stress_change double, moved double, most_moved string")


def best_avidity(results: DataFrame) -> DataFrame:
    """Of each antigen the adjustment that lowers stress most, 0 if none does."""
    low = results.groupBy("antigen_no").agg(F.min(F.struct("stress_change", "adjust")).alias("b"))
    return low.select("antigen_no", F.when(F.col("b.stress_change") < 0, F.col("b.adjust")).otherwise(0.0).alias("adjust"))


def _onto(primary: np.ndarray, secondary: np.ndarray) -> np.ndarray:
    a, b = primary.mean(axis=0), secondary.mean(axis=0)
    u, _, vt = np.linalg.svd((secondary - b).T @ (primary - a))
    return (secondary - b) @ (u @ vt) + a
