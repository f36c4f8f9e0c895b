"""Merged and refined projections on small made maps."""

import numpy as np
import pytest

from cartograph.operators import maps, optimise, projections


@pytest.fixture(scope="module")
def made(spark):
    """Twelve points, all distances known exactly, and the edges between them."""
    r = np.random.default_rng(5)
    x = r.uniform(-5, 5, (12, 2))
    rows = [(a, b, "regular", float(np.linalg.norm(x[a] - x[b]))) for a in range(12) for b in range(a + 1, 12)]
    return x, spark.createDataFrame(rows, "p1 int, p2 int, kind string, distance double").cache()


def test_trapped_points_are_moved_until_none_is_left(spark, made):
    x, edges = made
    bad = x.copy()
    bad[3] = -2 * x[3] + 9
    fixed, stress = projections.relaxed(spark, edges, bad, np.arange(12) != 3)
    found, least, rounds = projections.untrapped(spark, edges, bad, 0.25)
    assert least < 1e-6 <= stress + 1 and rounds.where("trapped > 0").count() == rounds.count() - 1
    assert np.allclose(np.linalg.norm(found[3] - found[5]), np.linalg.norm(x[3] - x[5]), atol=1e-3)


def test_kinds_of_merges(spark, made):
    x, edges = made
    turn = np.array([[0.6, 0.8], [0.8, -0.6]])
    first = projections.as_table(spark, x[:8])
    second = projections.as_table(spark, np.r_[np.full((4, 2), np.nan), x[4:] @ turn + 3]).where("point_no >= 4")
    assert projections.merged_projection(spark, 1, first, second, edges, 12) is None
    assert projections.merged_projection(spark, 2, first, None, edges, 12) is first
    for kind in (3, 4, 5):
        got = projections.as_array(projections.merged_projection(spark, kind, first, second, edges, 12), 12)
        assert np.allclose(got, x, atol=1e-4), kind
    with pytest.raises(ValueError):
        projections.merged_projection(spark, 4, first, None, edges, 12)
    off = projections.as_table(spark, np.r_[np.full((4, 2), np.nan), x[4:8] + [[0.4, 0], [-0.4, 0], [0, 0.4], [0, -0.4]], x[8:]]).where("point_no >= 4")
    third, fifth = (projections.as_array(projections.merged_projection(spark, k, first, off, edges, 12), 12) for k in (3, 5))
    assert not np.allclose(third[4:8], x[4:8], atol=0.05) and np.allclose(fifth[:8], x[:8])
    assert {r.origin: r["count"] for r in projections.overlaid(first, off).groupBy("origin").count().collect()} == {"primary": 4, "common": 4, "secondary": 4}


def test_orientation_angle_and_line(spark):
    layout = projections.as_table(spark, np.array([[0.0, 0], [1, 0], [0, 2]]))
    turned = maps.transform(layout, maps.rotation(0.7))
    common = layout.selectExpr("point_no as primary_no", "point_no as secondary_no")
    assert np.allclose(projections.as_array(projections.oriented(turned, layout, common), 3), projections.as_array(layout, 3))
    angle, flips = projections.angle_of(maps.rotation(0.7))
    assert abs(abs(angle) - 0.7) < 1e-9 and not flips and projections.angle_of(maps.flip(1.0, 0.0))[1]
    sides = projections.beside_line(np.array([[1.0, 1], [1, -1]]), (0, 0), (5, 0))
    assert np.allclose(sides, [[1, 1], [1, 1]])
    assert abs(projections.diameter_of_layout(layout) - 5**0.5) < 1e-9


def test_chain_and_copies(spark, made):
    x, edges = made
    part = x.copy()
    part[9:] = np.nan
    name, best = projections.scratch_or_incremental(spark, edges, part, 6)
    assert name in ("scratch", "incremental") and best.first()["stress"] < 1
    more = projections.cloned(projections.inserted(best.drop("place"), projections.as_table(spark, x), 77, 0.0), 77, 78)
    assert more.where("start in (77, 78)").count() == 24
    assert projections.merged_charts([1, 2, 3], lambda a, b: a + b) == 6
    with pytest.raises(ValueError):
        projections.merged_charts([1], None)


def test_moved_stress(spark, made):
    x, edges = made
    layout = projections.as_table(spark, x)
    assert projections.moved_stress(edges, layout, 2, x[2].tolist()).first()["stress"] < 1e-9
    assert projections.moved_stress(edges, layout, 2, (x[2] + 1).tolist()).first()["stress"] > 1


def test_both_methods_find_the_map(spark, made):
    x, edges = made
    d = optimise.collected(edges, 12)
    start = x + np.random.default_rng(6).normal(0, 0.3, x.shape)
    for method in ("quasi-newton", "cg"):
        assert optimise.minimise(d, start, "fine", method=method)[1] < 1e-4


def test_relaxation_in_steps(spark, made):
    x, edges = made
    start = x + np.random.default_rng(7).normal(0, 0.3, x.shape)
    got = projections.relaxed_in_steps(spark, edges, start, every=3)
    by = [r.stress for r in got.select("step", "stress").distinct().orderBy("step").collect()]
    assert len(by) > 2 and by == sorted(by, reverse=True) and by[-1] < 1e-4 and got.count() == 12 * len(by)


def test_problems_before_merging(spark):
    p = lambda *rows: spark.createDataFrame(rows, "chart_id string, minimum_column_basis string, avidity array<double>")
    at = lambda *rows: spark.createDataFrame(rows, "chart_id string, coord array<double>")
    fine = projections.problems_before_merging(p(("a", "none", None), ("b", "none", [])), at(("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("b", None)))
    assert fine.count() == 0
    bad = projections.problems_before_merging(p(("a", "none", [0.5]), ("b", "1280", None)), at(("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0])))
    assert {(x.problem, tuple(x.charts)) for x in bad.collect()} == {("avidity is adjusted", ("a",)), ("different numbers of dimensions", ("a", "b")), ("different minimum column bases", ("a", "b"))}
