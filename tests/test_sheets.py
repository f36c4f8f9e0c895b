"""Sheets of the laboratories, on small made ones."""

import pytest

from cartograph.sources import sheets

SCHEMA = "file string, sheet string, row int, col int, text string"


def cells(spark, rows):
    return spark.createDataFrame([("f", "s", r, c, t) for r, line in enumerate(rows) for c, t in enumerate(line) if t], SCHEMA)


ANTIGENS = [["A/OSLO/1/2015", "3/14/2015", "MDCK2", "3000123456"], ["A/BERGEN/22/2016", "12/1/2016", "E3", "3000123457"], ["A/QUITO/7/2017", "1/30/2017", "SIAT1", "3000123458"]]


def tables(spark, rows, lab, **more):
    a, s, t = sheets.sheet_tables(cells(spark, rows), lab, **more)
    names = [(x.name, x.date, x.passage, x.lab_id) for x in a.orderBy("antigen_no").collect()]
    sera = [(x.name, x.passage, x.serum_id) for x in s.orderBy("serum_no").collect()]
    return names, sera, {(x.antigen_no, x.serum_no): x.titer for x in t.collect()}


def test_sera_below_linked_by_index(spark):
    rows = [["CDC table"], [], [], ["", "", "", "", "clade 1", "clade 2", "x"], ["", "", "", "", "A", "B", "C"]]
    rows += [[*a, *t] for a, t in zip(ANTIGENS, (["1280", "5", "40"], ["80", "640", "5"], ["160", "20", "80"]))]
    rows += [["INFLUENZA CONTROL AG", "", "", "", "10", "10", "10"], [], ["", "SERA", "LOT #", "PASSAGE", "SPECIES"], ["B1", "A/BERGEN/22/2016", "F16-02", "E3", "FERRET"], ["A1", "A/OSLO/1/2015", "F15-01", "MDCK2", "FERRET"], ["C1", "HUMAN POOL A/OSLO/1/2015", "H1", "", "HUMAN"]]
    names, sera, titers = tables(spark, rows, "CDC")
    assert names == [("A/OSLO/1/2015", "2015-03-14", "MDCK2", "3000123456"), ("A/BERGEN/22/2016", "2016-12-01", "E3", "3000123457"), ("A/QUITO/7/2017", "2017-01-30", "SIAT1", "3000123458")]
    assert sera == [("A/OSLO/1/2015", "MDCK2", "F15-01"), ("A/BERGEN/22/2016", "E3", "F16-02")]
    assert titers == {(0, 0): "1280", (0, 1): "<10", (1, 0): "80", (1, 1): "640", (2, 0): "160", (2, 1): "20"}


def test_own_names_and_whole_indexes(spark):
    rows = [["CNIC"], [], [], [], ["", "", "", "", "1", "11"]] + [["BV" + a[0][1:], *a[1:], *t] for a, t in zip(ANTIGENS, (["1280", "5"], ["80", "640"], ["160", "20"]))]
    rows += [["", "SERA", "ID", "PASSAGE"], ["11", "BV/BERGEN/22/2016", "N2", "E3"], ["1", "BY/OSLO/1/2015", "N1", "MDCK2"]]
    names, sera, titers = tables(spark, rows, "CNIC")
    assert names[0][0] == "B/OSLO/1/2015" and sera == [("B/OSLO/1/2015", "MDCK2", "N1"), ("B/BERGEN/22/2016", "E3", "N2")] and titers[(0, 1)] == "<10"


def test_names_in_two_rows_and_footnotes(spark):
    rows = [["Crick"], [], ["", "", "", "", "A/Oslo", "A/Bergen", "A/Quito"], ["", "", "", "", "1/15", "22/16", "7/17"], ["", "", "", "", "MDCK", "Egg", "Siat"], ["", "", "", "", "f 15/01^1", "F16/02^2", "F17/03"]]
    rows += [[*a, *t] for a, t in zip(ANTIGENS, (["1280", "<", "<"], ["<", "640", "ND"], ["160", "20", "80"]))] + [[], ["1 < = <40; 2 < = <20"]]
    names, sera, titers = tables(spark, rows, "CRICK")
    assert sera == [("A/OSLO/1/15", "MDCK", "F15/01"), ("A/BERGEN/22/16", "EGG", "F16/02"), ("A/QUITO/7/17", "SIAT", "F17/03")]
    assert titers[(1, 0)] == "<40" and titers[(0, 1)] == "<20" and (1, 2) not in titers and names[0][1] in ("", "2015-03-14")


def test_paired_columns(spark):
    rows = [["Crick PRN"], [], ["", "", "", "", "A/Oslo", "", "A/Bergen"], ["", "", "", "", "1/15", "", "22/16"], ["", "", "", "", "F1", "", "F2"]] + [[*a, *t] for a, t in zip(ANTIGENS, (["160", "200", "40", "55"], ["80", "91", "20", "33"], ["<", "10", "320", "300"]))]
    _, sera, titers = tables(spark, rows, "CRICK", paired=True)
    assert len(sera) == 2 and titers == {(0, 0): "160/200", (0, 1): "40/55", (1, 0): "80/91", (1, 1): "20/33", (2, 0): "</10", (2, 1): "320/300"}


def test_full_width_and_ids_in_names(spark):
    rows = [["NIID"], [], ["", "", "", "", "A/Oslo/1/2015 Egg No.3", "A/Bergen/22/2016 #12"]] + [[*a, *t] for a, t in zip(ANTIGENS, (["1280", "＜10"], ["80", "640"], ["160", "20"]))]
    _, sera, titers = tables(spark, rows, "NIID")
    assert sera == [("A/OSLO/1/2015", "EGG", "EGG NO.3"), ("A/BERGEN/22/2016", "", "#12")] and titers[(0, 1)] == "<10"


def test_titles_and_serum_ids_beside(spark):
    rows = [["VIDRL"], [], ["", "", "", "", "OSLO1", "BERG22"], ["", "", "", "", "MDCK2", "E3"], ["", "", "", "", "A100", "A200"], ["A/X/1/2000", "Sample date", "", "A1234-14D", "1000", "2000"]]
    rows += [[*a, *t] for a, t in zip(ANTIGENS, (["1280", "40"], ["80", "640"], ["160", "20"]))]
    names, sera, titers = tables(spark, rows, "VIDRL")
    assert [n[0] for n in names] == [a[0] for a in ANTIGENS] and [s[:2] for s in sera] == [("A/OSLO/1/2015", "MDCK2"), ("A/BERGEN/22/2016", "E3")] and titers[(0, 0)] == "1280"


@pytest.mark.parametrize("lab", sorted(sheets.LABS))
def test_laboratory_is_told_by_the_title(spark, lab):
    assert [r.lab for r in sheets.laboratory(cells(spark, [["Results"], [f"from {lab}, 2020"]])).collect()] == [lab]
    assert [r.lab for r in sheets.laboratory(cells(spark, [["Results"]])).collect()] == [""]
