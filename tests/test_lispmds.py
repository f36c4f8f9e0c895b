"""The S-expression format: made files, names, round trips, files left out by filters."""

import random

import pytest
from pyspark.sql import functions as F

from cartograph.sources import lispmds

MADE = """;; a comment (with marks)
(MAKE-MASTER-MDS-WINDOW
  (HI-IN '(BI/16190/68 AH3N2/HK/1_r!NIB-1_p!MDCK2_2010-03-04_a!DIST..X!b |odd (name)|)
    '(S-1 A%2FB_i!SER%231!b)
    '((7.0 <1.0 ) (* >3) (2.5d0 nil-x))
    'TAB%7E1@b)
  :STARTING-COORDSS '((1.0 2.0) (-1d0 .5) (NIL) (3 4) (5 6) ((COL-BASES (0 0 0 7.0 3.5))))
  :BATCH-RUNS '((((1 1) (2 2) (3 3) (4 4) (5 5)) 12.5 MULTIPLE))
  :REFERENCE-ANTIGENS '(BI/16190/68))
"""


@pytest.fixture
def source(spark):
    lispmds.register(spark)
    return lambda path, table: spark.read.format("lispmds").option("table", table).load(str(path))


def test_a_made_file(source, tmp_path):
    (tmp_path / "one.save").write_text(MADE.replace("nil-x", "*"))
    at = lambda table: [tuple(r)[1:] for r in source(tmp_path / "one.save", table).collect()]
    assert at("antigens") == [(0, "BI/16190/68", "", "", "", True), (1, "A(H3N2)/HK/1", "NIB-1", "MDCK2 (2010-03-04)", "DIST,X", False), (2, "odd (name)", "", "", "", False)]
    assert at("sera") == [(0, "S-1", "", "", ""), (1, "A/B", "", "", "SER#1")]
    assert at("titers") == [(0, 0, "1280"), (0, 1, "<20"), (1, 1, ">80"), (2, 0, "57")]
    assert at("layouts")[:5] == [(0, 0, [1.0, 2.0]), (0, 1, [-1.0, 0.5]), (0, 2, None), (0, 3, [3.0, 4.0]), (0, 4, [5.0, 6.0])]
    assert at("projections") == [(0, None, [7.0, 3.5]), (1, 12.5, None)]


def test_names_there_and_back():
    r = random.Random(1)
    for _ in range(500):
        name = "".join(r.choice("AB/ ,%:?[]#|._-~'x1") for _ in range(r.randint(1, 12))).strip() or "x"
        if ".." in name or "_" in name or name[-2:] in lispmds.SIGNATURES or lispmds.encoded(name, lispmds.STRAIN).count("..") != name.count(",") or lispmds.encoded(name) == name:
            continue
        if "..." not in lispmds.encoded(name):
            assert lispmds.decoded(lispmds.encoded(name, lispmds.STRAIN)) == name
            assert lispmds.decoded(lispmds.encoded(name, lispmds.TABLE)) == name


@pytest.mark.parametrize("text", ["", "(OTHER)", "(MAKE-MASTER-MDS-WINDOW (HI-IN '(a) '(b) '((1)) 'c)", MADE + ")", "(MAKE-MASTER-MDS-WINDOW (HI-IN '() '(b) '() 'c))"])
def test_what_is_no_chart_is_an_error(text):
    with pytest.raises(ValueError):
        lispmds.Chart(text)


def test_deep_lists():
    assert lispmds.parsed("(" * 50_000 + ")" * 50_000)


def test_round_trip(spark, source, tmp_path):
    r = random.Random(3)
    charts = []
    for c in range(4):
        antigens = [(f"A(H3N2)/X {k}/{c}, y", r.choice(["", "R-1"]), r.choice(["", "E3 (2020-01-02)", "MDCK?"]), r.choice([[], ["DISTINCT"], ["a:b", "c"]]), k % 2 == 0) for k in range(6)]
        sera = [(f"S {k}", "", r.choice([[], ["CONC 2:1"]]), f"id {k}") for k in range(3)]
        titers = [[r.choice(["*", "10", "<20", "160", ">1280"]) for _ in sera] for _ in antigens]
        layouts = [[r.choice([None, [r.random(), -r.random()]]) for _ in range(9)] for _ in range(c)]
        charts.append((f"chart-{c}", f"t/{c}", antigens, sera, titers, layouts, [float(k) for k in range(c)]))
    df = spark.createDataFrame(charts, lispmds.WRITTEN).repartition(3)
    for _ in range(2):
        df.write.format("lispmds").mode("overwrite").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"chart-{c}.save" for c in range(4)]
    of = lambda c: f"{tmp_path}/chart-{c}.save"
    got = {(x.chart_id, x.antigen_no, x.serum_no): x.titer for x in source(tmp_path, "titers").collect()}
    assert got == {(of(c), a, s): x for c, chart in enumerate(charts) for a, row in enumerate(chart[4]) for s, x in enumerate(row) if x != "*"}
    antigens = source(tmp_path, "antigens").where(F.col("chart_id") == of(2)).orderBy("antigen_no").collect()
    plain = lambda s: s.replace("(H3N2)", "H3N2").replace("(", "").replace(")", "")  # noqa: E731  parentheses are not written
    assert [(plain(x.name), x.reassortant, plain(x.passage), x.annotations, x.reference) for x in antigens] == [(plain(n), re, plain(p), " ".join(a), ref) for n, re, p, a, ref in charts[2][2]]
    layouts = {(x.projection_no, x.point_no): x.coord for x in source(of(3), "layouts").collect()}
    assert layouts == {(n, k): c for n, layout in enumerate(charts[3][5]) for k, c in enumerate(layout)}


def test_filters_leave_files_unread(source, tmp_path):
    (tmp_path / "good.save").write_text(MADE.replace("nil-x", "*"))
    (tmp_path / "bad.save").write_text("not a chart")
    assert source(tmp_path, "sera").where(F.col("chart_id") == f"{tmp_path}/good.save").count() == 2
    with pytest.raises(Exception, match="expected|unexpected"):
        source(tmp_path, "sera").count()
