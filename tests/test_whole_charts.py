"""The avidity and grid queries cover every antigen, adjustment and point of the chart."""

from cartograph.plans import more
from cartograph.plans.fixtures import N_ANTIGENS, N_SERA


def test_avidity_covers_all_antigens_and_adjusts(spark, sf_dir):
    got = more.avidity(spark, sf_dir).collect()
    assert sorted((r.antigen_no, r.adjust) for r in got) == [(p, float(a)) for p in range(N_ANTIGENS) for a in range(-6, 7) if a]


def test_grid_covers_all_points(spark, sf_dir):
    assert sorted(r.point_no for r in more.grid(spark, sf_dir).collect()) == list(range(N_ANTIGENS + N_SERA))
