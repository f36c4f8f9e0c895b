"""Chains of aliases, exact shares, many charts against a fold, clades of outside trees."""

import random

import pytest

from cartograph.operators import locations, titers
from cartograph.sources import outside_trees


def test_chains_and_cycles_of_aliases(spark):
    r = random.Random(1)
    names = [f"place {k}" for k in range(10)]
    aliases = {f"a{k}": r.choice([f"A{r.randrange(60)}", f"a{k + 1}", f"a{k}", r.choice(names), "nowhere"]) for k in range(60)}

    def lead(x, seen=()):
        if x.upper() in {n.upper() for n in names}:
            return x.upper()
        return None if x.lower() in seen or x.lower() not in aliases else lead(aliases[x.lower()], (*seen, x.lower()))

    got = locations.closed(spark.createDataFrame(list(aliases.items()), "alias string, name string"), spark.createDataFrame([(n, n) for n in names], "name string, location string")).collect()
    assert {x.alias: x.name for x in got} == {a.upper(): lead(n) for a, n in aliases.items() if lead(n)}


@pytest.mark.parametrize("share,bin_cells", [(0.5, 100_000), (0.25, 3), (0.0, 3), (1.0, 3), (0.013, 1)])
def test_shares_are_exact(spark, monkeypatch, share, bin_cells):
    monkeypatch.setattr(titers, "BIN_CELLS", bin_cells)
    rows = spark.createDataFrame([(a, s, "*" if (a + s) % 10 == 0 else "40") for a in range(30) for s in range(10)], "antigen_no int, serum_no int, titer string")
    out = [titers.drop_share(rows, share, 3).orderBy("antigen_no", "serum_no").collect() for _ in range(2)]
    assert out[0] == out[1] and len(out[0]) == 300
    assert sum(x.titer == "*" for x in out[0]) == 30 + int(270 * share + 0.5)


def folded(charts):
    """(chart, number) to the number in the merge, chart by chart."""
    places, out = {}, {}
    for c, members in charts:
        seen = {}
        for no, key in members:
            nth = seen[key] = seen.get(key, 0) + 1
            out[c, no] = places.setdefault((key, nth), len(places))
    return out


def test_many_charts_as_a_fold(spark):
    r = random.Random(2)
    charts = [(c, [(k, r.choice("abcdefgh")) for k in range(r.randint(1, 9))]) for c in range(12)]
    members = [(c, k, key) for c, ms in charts for k, key in ms]
    cells = [(c, 0, a, s, r.choice(["10", "20", "<10", "80"])) for c, ms in charts for a, _ in ms for s, _ in ms]
    a = spark.createDataFrame(members, "chart_no int, antigen_no int, name string")
    s = spark.createDataFrame(members, "chart_no int, serum_no int, name string")
    layers = spark.createDataFrame(cells, "chart_no int, layer_no int, antigen_no int, serum_no int, titer string")
    antigens, sera, merged = titers.merge_many(a, s, layers, ("name",), ("name",))
    want = folded(charts)
    assert {(x.chart_no, x.antigen_no): x.new_no for x in antigens.collect()} == want == {(x.chart_no, x.serum_no): x.new_no for x in sera.collect()}
    plain = spark.createDataFrame([(want[c, x], want[c, y], t) for c, _, x, y, t in cells], "antigen_no int, serum_no int, titer string")
    assert {tuple(x) for x in merged.collect()} == {tuple(x) for x in titers.merge_layers(plain).collect()}
    length = lambda rows: len(titers.merge_many(a.where(rows), s, layers, ("name",), ("name",))[2]._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert length("chart_no < 2") == length("chart_no < 100")


def test_clades_of_outside_trees(spark, tmp_path):
    deep = '{"branch_attrs":{"labels":{"clade":"deep"},"mutations":{"HA1":["A1T"]}}}'
    for _ in range(150):  # beyond the levels that recursion has by default
        deep = '{"children":[' + deep + "]}"
    (tmp_path / "tree.json").write_text('{"tree":{"branch_attrs":{"labels":{"clade":"3C"},"mutations":{"HA1":["K160T"],"HA2":["I5V"],"nuc":["A10C","G60T"]}},"children":[{"branch_attrs":{"labels":{"clade":""}}},{"branch_attrs":{"labels":{"clade":"3C.1"}}},' + deep + "]}}")
    (tmp_path / "map.gff").write_text("##gff-version 3\ns\tp\tgene\t49\t1035\t.\t+\t.\tname=HA1\ns\tp\tgene\t1036\t1698\t.\t+\t.\tname=HA2\n")
    at = outside_trees.offsets(spark, f"{tmp_path}/map.gff").first()
    assert tuple(at) == (48, 1035)
    rows = outside_trees.clade_table(outside_trees.read(spark, f"{tmp_path}/tree.json"), *at).collect()
    assert sorted((x.clade, x.aa, x.nuc) for x in rows) == [("3C", ["160T", "334V"], ["12T"]), ("3C.1", None, None), ("deep", ["1T"], None)]
