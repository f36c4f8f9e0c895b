"""Maps: layouts, stress and what is measured on them.

A layout is point_no with one column a dimension (x, y and, in three dimensions,
z); a null coordinate is a disconnected point.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import titer as T

STEEPNESS = 10.0


def dims_of(layout: DataFrame) -> list[str]:
    return [c for c in ("x", "y", "z") if c in layout.columns]


def connected(layout: DataFrame) -> DataFrame:
    cond = F.lit(True)
    for c in dims_of(layout):
        cond = cond & F.col(c).isNotNull() & ~F.isnan(c)
    return layout.where(cond)


def euclid(dims: list[str], a: str, b: str) -> Column:
    total = F.lit(0.0)
    for c in dims:
        total = total + F.pow(F.col(f"{a}_{c}") - F.col(f"{b}_{c}"), F.lit(2.0))
    return F.sqrt(total)


def with_map_distances(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """Edges (p1, p2) with both points' coordinates and map_distance; edges of disconnected points go."""
    dims, points = dims_of(layout), connected(layout)
    for p, prefix in (("p1", "a"), ("p2", "b")):
        edges = edges.join(points.select(F.col("point_no").alias(p), *(F.col(c).alias(f"{prefix}_{c}") for c in dims)), p)
    return edges.withColumn("map_distance", euclid(dims, "a", "b"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def contributions(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """Adds contribution: (t - m)^2, and for less-than titers d^2 * sigmoid(10 d) with d = t - m + 1."""
    d = F.col("distance") - F.col("map_distance")
    low = d + 1
    term = F.when(F.col("kind") == "regular", d * d).otherwise(low * low * sigmoid(low * STEEPNESS))
    return with_map_distances(edges, layout).withColumn("contribution", term)


def stress(edges: DataFrame, layout: DataFrame) -> DataFrame:
    return contributions(edges, layout).agg(F.sum("contribution").alias("stress"))


def point_contributions(edges: DataFrame, layout: DataFrame) -> DataFrame:
    both = contributions(edges, layout).select(F.explode(F.array("p1", "p2")).alias("point_no"), "contribution")
    return both.groupBy("point_no").agg(F.sum("contribution").alias("contribution"))


def gradient(edges: DataFrame, layout: DataFrame, unmovable: DataFrame | None = None) -> DataFrame:
    """point_no and the derivative of stress by each coordinate; 0 for unmovable points."""
    dims = dims_of(layout)
    rows = with_map_distances(edges, layout)
    m = F.when(F.col("map_distance") == 0, F.lit(1e-5)).otherwise(F.col("map_distance"))
    d = F.col("distance") - m
    low = d + 1
    s = sigmoid(low * STEEPNESS)
    by_distance = F.when(F.col("kind") == "regular", 2 * d).otherwise(2 * low * s + low * low * s * (1 - s) * STEEPNESS)
    rows = rows.withColumn("factor", -by_distance / m)
    one = lambda p, sign: F.struct(F.col(p).alias("point_no"), *((sign * F.col("factor") * (F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(c) for c in dims))
    sums = rows.select(F.explode(F.array(one("p1", 1.0), one("p2", -1.0))).alias("g")).select("g.*").groupBy("point_no").agg(*(F.sum(c).alias(f"d{c}") for c in dims))
    if unmovable is not None:
        sums = sums.join(unmovable.select("point_no").distinct().withColumn("fixed", F.lit(True)), "point_no", "left")
        sums = sums.select("point_no", *(F.when(F.col("fixed"), 0.0).otherwise(F.col(f"d{c}")).alias(f"d{c}") for c in dims))
    return sums


def error_lines(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """p1, p2, error: table less map distance; of less-than titers times the root of the sigmoid."""
    d = F.col("distance") - F.col("map_distance")
    low = d + 1
    return with_map_distances(edges, layout).select("p1", "p2", F.when(F.col("kind") == "regular", d).otherwise(low * F.sqrt(sigmoid(low * STEEPNESS))).alias("error"))


def bounds(layout: DataFrame) -> DataFrame:
    """Least, greatest and mean coordinate, and the area of the box."""
    dims = dims_of(layout)
    out = connected(layout).agg(*(f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))
    area = F.lit(1.0)
    for c in dims:
        area = area * (F.col(f"max_{c}") - F.col(f"min_{c}"))
    return out.withColumn("area", area)


def extreme_points(layout: DataFrame) -> DataFrame:
    return connected(layout).agg(*(f("point_no", F.struct(c, F.col("point_no"))).alias(f"{n}_{c}_point") for c in dims_of(layout) for n, f in (("min", F.min_by), ("max", F.max_by))))


def intersection_area(a: DataFrame, b: DataFrame) -> DataFrame:
    """Area common to the boxes of two layouts."""
    dims = dims_of(a)
    p, q = bounds(a), bounds(b).select(*(F.col(c).alias(f"b_{c}") for c in bounds(b).columns))
    area = F.lit(1.0)
    for c in dims:
        area = area * F.greatest(F.lit(0.0), F.least(f"max_{c}", f"b_max_{c}") - F.greatest(f"min_{c}", f"b_min_{c}"))
    return p.crossJoin(q).select(area.alias("area"))  # one row each


def all_pairs(layout: DataFrame) -> DataFrame:
    """p1 < p2 and their map distance.  A report over the points of one map."""
    dims, points = dims_of(layout), connected(layout)
    a = points.select(F.col("point_no").alias("p1"), *(F.col(c).alias(f"a_{c}") for c in dims))
    b = points.select(F.col("point_no").alias("p2"), *(F.col(c).alias(f"b_{c}") for c in dims))
    return a.join(b, F.col("p1") < F.col("p2")).select("p1", "p2", euclid(dims, "a", "b").alias("map_distance"))


# ---- transformations: row-major square matrices


def rotation(angle: float) -> list[float]:
    return [math.cos(angle), -math.sin(angle), math.sin(angle), math.cos(angle)]


def flip(x: float, y: float) -> list[float]:
    """Reflection at the line through the origin in the direction (x, y)."""
    n = x * x + y * y
    return [(x * x - y * y) / n, 2 * x * y / n, 2 * x * y / n, (y * y - x * x) / n]


def multiply(a: list[float], b: list[float]) -> list[float]:
    n = math.isqrt(len(a))
    return (np.array(a).reshape(n, n) @ np.array(b).reshape(n, n)).ravel().tolist()


def inverse(a: list[float]) -> list[float]:
    n = math.isqrt(len(a))
    return np.linalg.inv(np.array(a).reshape(n, n)).ravel().tolist()


def determinant(a: list[float]) -> float:
    n = math.isqrt(len(a))
    return float(np.linalg.det(np.array(a).reshape(n, n)))


def difference(a: list[float], b: list[float]) -> float:
    return float(np.abs(np.array(a) - np.array(b)).sum())


def transform(layout: DataFrame, matrix: list[float], translation: list[float] | None = None) -> DataFrame:
    """Coordinates as row vectors times the matrix, plus the translation."""
    dims = dims_of(layout)
    n, shift = len(dims), translation or [0.0] * len(dims)
    out = []
    for k, c in enumerate(dims):
        total = F.lit(float(shift[k]))
        for j, other in enumerate(dims):
            total = total + F.col(other) * F.lit(float(matrix[j * n + k]))
        out.append(total.alias(c))
    return layout.select(*(c for c in layout.columns if c not in dims), *out)


def _partners(primary: DataFrame, secondary: DataFrame, common: DataFrame) -> DataFrame:
    """primary_no, secondary_no and the coordinates a_ and b_ of connected points; a pair that common has twice is one."""
    rows = common.select("primary_no", "secondary_no").distinct()
    for no, prefix, layout in (("primary_no", "a", primary), ("secondary_no", "b", secondary)):
        rows = rows.join(connected(layout).select(F.col("point_no").alias(no), *(F.col(c).alias(f"{prefix}_{c}") for c in dims_of(primary))), no)
    return rows


def procrustes(primary: DataFrame, secondary: DataFrame, common: DataFrame, scaling: bool = False) -> tuple[list[float], list[float], float, float]:
    """Matrix, translation, scale and RMS that bring the secondary layout onto the primary over common points (primary_no, secondary_no).

    The sums over points are one aggregation; only a square matrix of as many
    rows as there are dimensions is decomposed on the driver.
    """
    dims, pairs = dims_of(primary), _partners(primary, secondary, common)
    a, b = [f"a_{c}" for c in dims], [f"b_{c}" for c in dims]
    sums = pairs.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in a + b), *(F.sum(F.col(p) * F.col(q)).alias(f"{p}{q}") for p in a + b for q in a + b)).first()
    n = sums["n"]
    if not n:
        raise ValueError("no common points with coordinates")
    mean_a, mean_b = np.array([sums[c] for c in a]) / n, np.array([sums[c] for c in b]) / n
    gram = lambda u, v, mu, mv: np.array([[sums[f"{p}{q}"] for q in v] for p in u]) - n * np.outer(mu, mv)
    ba, bb, aa = gram(b, a, mean_b, mean_a), gram(b, b, mean_b, mean_b), gram(a, a, mean_a, mean_a)
    u, s, vt = np.linalg.svd(ba)
    rotation_ = u @ vt
    scale = float(s.sum() / np.trace(bb)) if scaling and np.trace(bb) else 1.0
    matrix = scale * rotation_
    squares = np.trace(aa) - 2 * scale * s.sum() + scale * scale * np.trace(bb)
    return matrix.ravel().tolist(), (mean_a - mean_b @ matrix).tolist(), scale, math.sqrt(max(0.0, squares) / n)


def procrustes_distances(primary: DataFrame, secondary: DataFrame, common: DataFrame, matrix: list[float], translation: list[float]) -> DataFrame:
    """primary_no, secondary_no, distance between a point and its moved partner, longest first by place."""
    rows = _partners(primary, transform(secondary, matrix, translation), common)
    return rows.select("primary_no", "secondary_no", euclid(dims_of(primary), "a", "b").alias("distance"))


# ---- serum circles


def theoretical_circles(homologous: DataFrame, titers: DataFrame, bases: DataFrame, fold: float = 2.0) -> DataFrame:
    """serum_no, antigen_no, radius = fold + basis - logged homologous titer; and of a serum the least, at least 2."""
    rows = homologous.join(titers, ["antigen_no", "serum_no"]).where(T.sign(F.col("titer")) == "").join(bases, "serum_no")
    each = rows.select("serum_no", "antigen_no", (fold + F.col("column_basis") - T.logged(F.col("titer"))).alias("radius"))
    return each.withColumn("serum_radius", F.greatest(F.lit(2.0), F.min("radius").over(Window.partitionBy("serum_no"))))


def least_wrong_radius(near: DataFrame, *by: str) -> DataFrame:
    """by, radius: the mean of the radii that are wrong about the fewest rows (map_distance, protected 0 or 1) of a group."""
    w = Window.partitionBy(*by).orderBy("map_distance")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    # a midpoint between two distances has all before it inside; equal distances make a candidate with all of them inside
    before = F.lag("map_distance").over(w)
    near = near.withColumn("radius", F.when(before.isNull(), F.col("map_distance")).otherwise((F.col("map_distance") + before) / 2))
    inside = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    exact = before.isNull() | (before == F.col("map_distance"))
    wrong_inside = F.when(exact, F.sum(1 - F.col("protected")).over(inside)).otherwise(F.coalesce(F.sum(1 - F.col("protected")).over(upto), F.lit(0)))
    right_inside = F.when(exact, F.sum("protected").over(inside)).otherwise(F.coalesce(F.sum("protected").over(upto), F.lit(0)))
    near = near.withColumn("wrong", wrong_inside + F.sum("protected").over(whole) - right_inside)
    near = near.withColumn("least", F.min("wrong").over(whole))
    return near.where("wrong = least").groupBy(*by).agg(F.avg("radius").alias("radius"))


def empirical_circles(homologous: DataFrame, titers: DataFrame, bases: DataFrame, layout: DataFrame, n_antigens: int, fold: float = 2.0) -> DataFrame:
    """serum_no, antigen_no, status, radius for each serum and homologous antigen.

    An antigen is protected if its titer is within fold of the homologous one;
    a radius is wrong about protected antigens outside and others inside, and the
    mean of the radii that are wrong least often is taken.  Candidates are the
    midpoints between consecutive distances; counting what lies inside is a
    running sum over the sorted distances, not a join.
    """
    home = homologous.join(titers.withColumnRenamed("titer", "home_titer"), ["antigen_no", "serum_no"], "left").join(bases, "serum_no")
    home = home.withColumn("boundary", F.least("column_basis", T.logged_for_column_bases(F.col("home_titer"))) - fold)
    serum_at = connected(layout).select(F.col("point_no").alias("serum_point"), F.lit(True).alias("serum_there"))
    antigen_at = connected(layout).select(F.col("point_no").alias("antigen_no"), F.lit(True).alias("antigen_there"))
    home = home.withColumn("serum_point", F.col("serum_no") + n_antigens).join(serum_at, "serum_point", "left").join(antigen_at, "antigen_no", "left")
    status = F.when(F.col("home_titer").isNull() | (T.sign(F.col("home_titer")) != ""), "non_regular_homologous").when(F.col("boundary") < 1.0, "titer_too_low").when(F.col("serum_there").isNull() | F.col("antigen_there").isNull(), "disconnected").otherwise("good")
    home = home.withColumn("status", status).select("serum_no", "antigen_no", "serum_point", "boundary", "column_basis", "status")
    good = home.where("status = 'good'").select("serum_no", F.col("antigen_no").alias("home"), "boundary", "column_basis")
    edges = titers.select("serum_no", F.col("antigen_no").alias("p1"), (F.col("serum_no") + n_antigens).alias("p2"), "titer").where("titer <> '*'")
    near = with_map_distances(edges, layout).select("serum_no", "titer", "map_distance").join(good, "serum_no")
    seen = F.least("column_basis", T.logged(F.col("titer")))
    protects = F.when(T.sign(F.col("titer")) == "", seen >= F.col("boundary")).otherwise(seen > F.col("boundary"))
    near = near.withColumn("protected", protects.cast("int"))
    found = least_wrong_radius(near, "serum_no", "home").withColumnRenamed("home", "antigen_no")
    return home.join(found, ["serum_no", "antigen_no"], "left").select("serum_no", "antigen_no", "status", "radius")


def serum_coverage(homologous: DataFrame, titers: DataFrame, fold: float = 2.0) -> DataFrame:
    """serum_no, home, antigen_no, within: titrated antigens within fold of the homologous titer or beyond."""
    home = homologous.join(titers, ["antigen_no", "serum_no"]).where(T.sign(F.col("titer")) == "").select("serum_no", F.col("antigen_no").alias("home"), T.logged(F.col("titer")).alias("home_logged"))
    rows = titers.where("titer <> '*'").join(home, "serum_no")
    return rows.select("serum_no", "home", "antigen_no", (T.logged_with_thresholded(F.col("titer")) >= F.col("home_logged") - fold).alias("within"))


def circle_for_several_sera(homologous: DataFrame, titers: DataFrame, bases: DataFrame, layout: DataFrame, sera: DataFrame, n_antigens: int, fold: float = 2.0, conservative: bool = False) -> DataFrame:
    """One row for the sera (serum_no) together: centre (mean of their points), n antigens, n_protected, radius.

    Each serum's first homologous antigen with a boundary of 1 or more says which
    antigens it protects; an antigen counts if its votes are not even, and, if
    conservative, only if they all agree.  The radius is null where every antigen
    is protected, or none.
    """
    dims, points = dims_of(layout), connected(layout)
    ours = sera.select("serum_no").join(points.select((F.col("point_no") - n_antigens).alias("serum_no"), *dims), "serum_no")
    centre = ours.agg(*(F.avg(c).alias(f"b_{c}") for c in dims))
    home = homologous.join(titers, ["antigen_no", "serum_no"]).where("titer <> '*'").join(ours.select("serum_no"), "serum_no", "left_semi")
    home = home.join(points.select(F.col("point_no").alias("antigen_no")), "antigen_no", "left_semi").join(bases, "serum_no")  # one row a serum
    home = home.withColumn("boundary", F.least("column_basis", T.logged_for_column_bases(F.col("titer"))) - fold).where("boundary >= 1")
    home = home.groupBy("serum_no").agg(F.min(F.struct("antigen_no", "boundary", "column_basis")).alias("h")).select("serum_no", "h.boundary", "h.column_basis")
    seen = F.least("column_basis", T.logged_for_column_bases(F.col("titer")))
    protects = F.when(T.sign(F.col("titer")) == "", seen >= F.col("boundary")).otherwise(seen > F.col("boundary"))
    votes = titers.where("titer <> '*'").join(home, "serum_no").groupBy(F.col("antigen_no").alias("point_no")).agg(F.count_if(protects).alias("yes"))
    one_row = centre.crossJoin(home.agg(F.count("*").alias("voters")))  # one row each
    rows = points.where(F.col("point_no") < n_antigens).select("point_no", *(F.col(c).alias(f"a_{c}") for c in dims)).join(votes, "point_no", "left").crossJoin(F.broadcast(one_row))
    yes = F.coalesce("yes", F.lit(0))
    no = F.col("voters") - yes
    counts = (yes != no) & ((yes == 0) | (no == 0)) if conservative else yes != no
    near = rows.where(counts).select(F.lit(0).alias("k"), euclid(dims, "a", "b").alias("map_distance"), (yes > no).cast("int").alias("protected"))  # antigens of one chart
    sums = near.groupBy("k").agg(F.count("*").alias("n"), F.sum("protected").alias("n_protected")).join(least_wrong_radius(near, "k"), "k")
    radius = F.when((F.col("n_protected") > 0) & (F.col("n_protected") < F.col("n")), F.col("radius"))
    return centre.select(*(F.col(f"b_{c}").alias(c) for c in dims)).join(sums, how="left").select(*dims, "n", "n_protected", radius.alias("radius"))  # one row each


def procrustes_summary(distances: DataFrame) -> DataFrame:
    """Number, mean, root mean square and greatest of the distances between partners, and the point that moved farthest."""
    d = F.col("distance")
    return distances.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(d).alias("longest"), F.max_by("primary_no", F.struct(d, -F.col("primary_no"))).alias("longest_no"))
