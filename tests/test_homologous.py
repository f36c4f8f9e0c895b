"""Homologous antigens of sera against a comparison of all pairs, and how many rows meet on the way."""

import random

import pytest

from cartograph.operators import lookups, matching

ANTIGENS, SERA = "antigen_no int, name string, reassortant string, annotations string, passage string, date string", "serum_no int, name string, reassortant string, annotations string, passage string, serum_id string"


@pytest.fixture(scope="module")
def made(spark):
    """Members of few kinds, some without values; numbers of some sera are null or occur twice."""
    r = random.Random(4)
    some = lambda *x: r.choice([*x, None]) if r.random() < 0.05 else r.choice(x)
    a = [(k, some("A", "B", "C"), some("", "N"), some("", "NEW", "X", "Y Z"), some("E1", "E2", "MDCK1", "SIAT1"), f"2020-0{k % 3 + 1}-01") for k in range(120)]
    s = [(None if k == 5 else k % 55, some("A", "B", "C", "D"), some("", "N"), some("", "NEW", "CONC 2:1", "Z Y", "W"), some("E1", "E3", "MDCK1", ""), r.choice(["EGG 1", "S"])) for k in range(60)]
    return a, s, spark.createDataFrame(a, ANTIGENS), spark.createDataFrame(s, SERA)


def best(a, s, by_id):
    """serum_no to (same passage, antigen_no) of its best tier."""
    words = lambda x: None if x is None else " ".join(sorted(w for w in x.split() if w != "CONC" and w != "2:1"))
    egg = lambda p: None if p is None else p.startswith("E")
    pairs = {}
    for no, name, reassortant, annotations, passage, serum_id in s:
        kind = "EGG" in serum_id if by_id and passage == "" else egg(passage)
        for antigen, name2, reassortant2, annotations2, passage2, _ in a:
            if None not in (name, reassortant, kind, passage2) and (name, reassortant, kind) == (name2, reassortant2, egg(passage2)):
                tier = 1 if annotations is not None and words(annotations) == words(annotations2) else 2
                pairs.setdefault(no, []).append((tier, passage in (passage2, ""), antigen))
    return {no: [x[1:] for x in p if x[0] == min(p)[0]] for no, p in pairs.items()}


def wanted(found, mode):
    out = []
    for no, p in found.items():
        same, antigen = min(p, key=lambda x: (not x[0], x[1]))
        if mode == "all":
            out += [(no, x[1]) for x in p]
        elif mode == "relaxed" or same or (mode == "relaxed_strict" and len(p) == 1):
            out.append((no, antigen))
    return sorted(out, key=str)


@pytest.mark.parametrize("mode", ["all", "strict", "relaxed", "relaxed_strict"])
def test_modes(made, mode):
    a, s, antigens, sera = made
    got = lookups.homologous(antigens, sera, mode).select("serum_no", "antigen_no").collect()
    assert sorted(map(tuple, got), key=str) == wanted(best(a, s, True), mode)


def test_all_by_passage(made):
    a, s, antigens, sera = made
    assert sorted(map(tuple, matching.homologous(antigens, sera).select("serum_no", "antigen_no").collect()), key=str) == wanted(best(a, s, False), "all")


def test_first(made):
    a, s, antigens, sera = made
    least = {}
    for no, antigen in wanted(best(a, s, True), "all"):
        if no is not None:
            least[antigen] = min(no, least.get(antigen, no))
    order = sorted(a, key=lambda x: (least.get(x[0], 1000), x[5], x[0]))
    for pairs in (lookups.homologous(antigens, sera), lookups.first_homologous_serum(antigens, sera)):
        assert {r.antigen_no: r.place for r in lookups.homologous_first(antigens, pairs, "date").collect()} == {x[0]: k for k, x in enumerate(order)}


def rows_met(df):
    """The greatest number of rows that a step of the query's plan has put out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        if (n := plan.metrics().get("numOutputRows")).isDefined():
            most = max(most, n.get().value())
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return most


@pytest.mark.parametrize("mode", ["strict", "relaxed", "relaxed_strict", "first"])
def test_no_pairs_of_members_are_made(spark, mode):
    antigens = spark.range(2000).selectExpr("CAST(id AS INT) AS antigen_no", "'A' AS name", "'' AS reassortant", "'' AS annotations", "'E1' AS passage", "'' AS date")
    sera = spark.range(500).selectExpr("CAST(id AS INT) AS serum_no", "'A' AS name", "'' AS reassortant", "'' AS annotations", "'E2' AS passage", "'' AS serum_id")
    found = lookups.first_homologous_serum(antigens, sera) if mode == "first" else lookups.homologous(antigens, sera, mode)
    assert 500 <= rows_met(found) <= 2500


@pytest.mark.parametrize("find", [matching.homologous, lookups.homologous])
def test_pairs_are_not_exchanged(made, find):
    _, _, antigens, sera = made
    plan = find(antigens, sera)._jdf.queryExecution().optimizedPlan().toString()
    assert all("Window" not in line or "serum_no" in line for line in plan.splitlines()) and plan.splitlines()[0].startswith("Union")
