"""Projections of merged and refined maps: overlays, orientation, the loop over trapped points, chains of charts.

Layouts are tables (point_no, x, y, ...).  What is sums over points or edges is
relational; only searches for a minimum go to the kernels of optimise.py.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maps, optimise


def with_targets(layout: DataFrame, targets: DataFrame) -> DataFrame:
    """A layout under the numbers of a merged chart; targets: no, target."""
    return layout.join(targets.select(F.col("no").alias("point_no"), "target"), "point_no").drop("point_no").withColumnRenamed("target", "point_no")


def oriented(layout: DataFrame, master: DataFrame, common: DataFrame) -> DataFrame:
    """The layout turned, flipped and moved onto a master layout; common: primary_no (the master's), secondary_no."""
    matrix, translation, _, _ = maps.procrustes(master, layout, common)
    return maps.transform(layout, matrix, translation)


def angle_of(matrix: list[float]) -> tuple[float, bool]:
    """The angle of a two-dimensional transformation in radians, and whether it flips."""
    a, b, c, d = matrix
    flips = a * d - b * c < 0
    return (float(np.arctan2(b, a)), flips)


def overlaid(primary: DataFrame, secondary: DataFrame, keep: str = "middle") -> DataFrame:
    """point_no, coordinates and origin (primary, secondary, common) of two layouts under merged numbers.

    The secondary is oriented to the primary by their common points.  Those get
    the middle of both places, or, with keep="primary", the primary's.
    """
    dims = maps.dims_of(primary)
    both = maps.connected(primary).select("point_no").join(maps.connected(secondary).select("point_no"), "point_no")
    moved = oriented(secondary, primary, both.select(F.col("point_no").alias("primary_no"), F.col("point_no").alias("secondary_no")))
    b = moved.select("point_no", *(F.col(c).alias(f"_{c}") for c in dims), F.lit(True).alias("_there"))
    rows = primary.select("point_no", *dims, F.lit(True).alias("there")).join(b, "point_no", "full_outer")
    common = F.col("there").isNotNull() & F.col("_there").isNotNull()
    place = lambda c: F.when(common & F.lit(keep == "middle"), (F.col(c) + F.col(f"_{c}")) / 2).otherwise(F.coalesce(c, f"_{c}"))
    origin = F.when(common, "common").when(F.col("there").isNotNull(), "primary").otherwise("secondary")
    return rows.select("point_no", *(F.coalesce(place(c), F.col(c), F.col(f"_{c}")).alias(c) for c in dims), origin.alias("origin"))


def as_array(layout: DataFrame, n_points: int) -> np.ndarray:
    """One chart's layout as rows by point number; NaN where a point has no place."""
    dims = maps.dims_of(layout)
    out = np.full((n_points, len(dims)), np.nan)
    for r in layout.select("point_no", *dims).where(F.col("point_no") < n_points).collect():  # one chart's points
        out[r["point_no"]] = [np.nan if r[c] is None else r[c] for c in dims]
    return out


def as_table(spark: SparkSession, x: np.ndarray) -> DataFrame:
    rows = [(p, *(None if np.isnan(v) else float(v) for v in row)) for p, row in enumerate(x)]
    return spark.createDataFrame(rows, "point_no int, " + ", ".join(f"{c} double" for c in "xyzuvw"[: x.shape[1]]))


def relaxed(spark: SparkSession, edges: DataFrame, layout: np.ndarray, unmovable: np.ndarray | None = None, precision: str = "fine") -> tuple[np.ndarray, float]:
    """An existing projection relaxed, and its stress; points without a place stay without, and their distances don't count."""
    d = optimise.collected(edges, len(layout))
    there = ~np.isnan(layout).any(axis=1)
    use = there[d.p1] & there[d.p2]
    d = d._replace(p1=d.p1[use], p2=d.p2[use], target=d.target[use], less=d.less[use])
    fixed = ~there if unmovable is None else unmovable | ~there
    x, stress = optimise.minimise(d, np.where(there[:, None], layout, 0.0), precision, fixed)
    return np.where(there[:, None], x, np.nan), stress


def relaxed_in_steps(spark: SparkSession, edges: DataFrame, layout: np.ndarray, every: int = 10, most: int = 100) -> DataFrame:
    """step, stress, point_no, coord: a layout as it is, and after each so many iterations of its relaxation, until stress stays."""
    d, x = optimise.collected(edges, len(layout)), layout.copy()
    stress, rows = optimise.stress_and_gradient(d, x)[0], []
    for step in range(most):
        rows += [(step, float(stress), p, [float(v) for v in c]) for p, c in enumerate(x)]
        x, after = optimise.minimise(d, x, "fine", most=every)
        if stress - after <= 1e-9 * max(1.0, stress):
            break
        stress = after
    return spark.createDataFrame(rows, "step int, stress double, point_no int, coord array<double>")


def merged_projection(spark: SparkSession, kind: int, primary: DataFrame, secondary: DataFrame | None, edges: DataFrame, n_points: int) -> DataFrame | None:
    """The layout of a merged chart, by kind of merge; layouts are under merged numbers, edges those of the merged chart.

    1: none.  2: the primary's, new points without a place.  3: both overlaid,
    common points in the middle.  4: as 3, then what only the secondary has is
    relaxed, the rest fixed.  5: as 4, common points keeping the primary's place.
    """
    if kind == 1:
        return None
    if kind == 2:
        return primary
    if secondary is None:
        raise ValueError(f"a merge of type {kind} needs a secondary layout")
    both = overlaid(primary, secondary, "primary" if kind == 5 else "middle")
    if kind == 3:
        return both.drop("origin")
    fixed = np.zeros(n_points, bool)
    for r in both.where("origin <> 'secondary'").select("point_no").collect():  # one chart's points
        fixed[r["point_no"]] = True
    x, _ = relaxed(spark, edges, as_array(both.drop("origin"), n_points), fixed)
    return as_table(spark, x)


def merged_charts(charts: list, merge: Callable) -> object:
    """A left fold over charts: each is merged into what came before."""
    if len(charts) < 2:
        raise ValueError("too few charts to merge")
    out = charts[0]
    for chart in charts[1:]:
        out = merge(out, chart)
    return out


def scratch_or_incremental(spark: SparkSession, edges: DataFrame, layout: np.ndarray, starts: int) -> tuple[str, DataFrame]:
    """A step of a chain of merges: the better of maps from scratch and of maps from the layout that only place new points."""
    scratch = optimise.best(optimise.relax(spark, edges, len(layout), starts, layout.shape[1], precision="rough"))
    grown = optimise.best(optimise.relax_incremental(spark, edges, layout, starts, fine=1))
    least = [x.select("stress").first()["stress"] for x in (scratch, grown)]
    return ("incremental", grown) if least[1] < least[0] else ("scratch", scratch)


def untrapped(spark: SparkSession, edges: DataFrame, layout: np.ndarray, step: float = 0.1, most: int = 10) -> tuple[np.ndarray, float, DataFrame]:
    """A layout relaxed until a grid test finds no trapped point: in each round trapped and hemisphering points with a better place go there.

    Returns the layout, its stress, and a row for each round: round, stress,
    trapped, hemisphering, moved.
    """
    x, stress = relaxed(spark, edges, layout)
    rounds = []
    for k in range(most):
        found = optimise.grid_test(spark, edges, x, step).where("status in ('trapped', 'hemisphering')").collect()  # points of one chart
        trapped = sum(r["status"] == "trapped" for r in found)
        better = [r for r in found if r["change"] < 0]
        rounds.append((k + 1, stress, trapped, len(found) - trapped, len(better) if trapped else 0))
        if not trapped:
            break
        for r in better:
            x[r["point_no"]] = r["place"]
        x, stress = relaxed(spark, edges, x)
    return x, stress, spark.createDataFrame(rounds, "round int, stress double, trapped int, hemisphering int, moved int")


def moved_stress(edges: DataFrame, layout: DataFrame, point_no: int, place: list[float]) -> DataFrame:
    """stress: of the layout with one point elsewhere."""
    dims = maps.dims_of(layout)
    mine = F.col("point_no") == point_no
    return maps.stress(edges, layout.select("point_no", *(F.when(mine, F.lit(float(v))).otherwise(F.col(c)).alias(c) for c, v in zip(dims, place))))


def diameter_of_layout(layout: DataFrame) -> float:
    """The diagonal of the layout's bounding box: how far random starts around it reach."""
    dims = maps.dims_of(layout)
    r = layout.agg(*(F.max(c).alias(f"max_{c}") for c in dims), *(F.min(c).alias(f"min_{c}") for c in dims)).first()
    return float(np.sqrt(sum((r[f"max_{c}"] - r[f"min_{c}"]) ** 2 for c in dims)))


def beside_line(points: np.ndarray, a: tuple[float, float], b: tuple[float, float], side: int = 1) -> np.ndarray:
    """Random places on one side of the line through a and b (side 1: left of it); those beyond are mirrored."""
    (ax, ay), (bx, by) = a, b
    along = np.array([bx - ax, by - ay]) / np.hypot(bx - ax, by - ay)
    across = np.array([-along[1], along[0]])
    off = (points - np.array(a)) @ across
    return points - np.where(off * side < 0, 2 * off, 0.0)[:, None] * across


def inserted(projections: DataFrame, layout: DataFrame, start: int, stress: float | None = None) -> DataFrame:
    """Projections (start, stress, point_no, coord) with a layout as one more."""
    dims = maps.dims_of(layout)
    row = layout.select(F.lit(start).cast("int").alias("start"), F.lit(stress).cast("double").alias("stress"), "point_no", F.when(F.col(dims[0]).isNotNull(), F.array(*dims)).alias("coord"))
    return projections.unionByName(row)


def cloned(projections: DataFrame, start: int, to: int) -> DataFrame:
    """Projections with a copy of one of them under another number."""
    return projections.unionByName(projections.where(F.col("start") == start).withColumn("start", F.lit(to).cast("int")))


def problems_before_merging(projections: DataFrame, layouts: DataFrame) -> DataFrame:
    """problem, charts: what keeps the projections of charts from being merged; no rows if nothing does.

    projections: chart_id, minimum_column_basis, avidity (null or empty: not
    adjusted); layouts: chart_id, coord.  Merged projections have no adjusted
    avidity, one number of dimensions, and one minimum column basis.
    """
    adjusted = projections.where(F.size(F.coalesce("avidity", F.array().cast("array<double>"))) > 0)
    dims = layouts.where(F.col("coord").isNotNull()).select("chart_id", F.size("coord").alias("n")).distinct()
    told = lambda rows, problem: rows.agg(F.lit(problem).alias("problem"), F.array_sort(F.collect_set("chart_id")).alias("charts"))
    several = lambda rows, by: rows.withColumn("_k", F.lit(0)).join(rows.agg(F.count_distinct(by).alias("_n")).where("_n > 1").withColumn("_k", F.lit(0)), "_k", "left_semi")
    found = told(adjusted, "avidity is adjusted").unionByName(told(several(dims, "n"), "different numbers of dimensions"))
    return found.unionByName(told(several(projections, "minimum_column_basis"), "different minimum column bases")).where(F.size("charts") > 0)
