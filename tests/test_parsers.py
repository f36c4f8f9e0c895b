"""The parsers on cases made for each of their branches."""

import pytest
from pyspark.sql import functions as F

from cartograph.functions import dates, names, passages

PASSAGES = {
    "E3": "E3", "m4": "MDCK4", "S2/E1": "SIAT2/E1", "C3, s1": "MDCK3/SIAT1", "VERO": "VERO?", "MDCK 3 +2": "MDCK3/MDCK2", "SPFCK-2\\E4": "SPFCK2/E4", "c?": "MDCK?", "X9": "X9",
    "siat7 (2020-02-29)": "SIAT7 (2020-02-29)", "Passage details: E1+E2": "E1/E2", "direct": "OR", "CLINICAL": "OR", "Orig. swab": "OR", "passage - ori": "OR",
    "kept in a freezer; no. 7": "KEPT IN A FREEZER; NO. 7", "MDCK?/X": "MDCK?/X", " e12 ": "E12",
}

DATES = {
    ("1999-12-31", False): "1999-12-31", ("7-3-5", False): None, ("07-03-05", False): "2007-03-05", ("68-10-02", False): "1968-10-02", ("2014", False): "2014-01-01", ("2014.06", False): "2014-06-01",
    ("2014/9/3", False): "2014-09-03", ("3/9/2014", False): "2014-09-03", ("3/9/2014", True): "2014-03-09", ("25/9/2014", True): "2014-09-25", ("9/25/2014", False): "2014-09-25",
    ("2015-02-29", False): None, ("2016-02-29", False): "2016-02-29", ("yesterday", False): None, ("", False): None,
}

LOCATIONS = [(x, x, c) for x, c in (("OSLO", "NORWAY"), ("BERGEN", "NORWAY"), ("QUITO", "ECUADOR"), ("TURKEY", "TURKEY"), ("NEW ULM", "UNITED STATES OF AMERICA"), ("GRAZ", "AUSTRIA"), ("GRAZ WEST", "AUSTRIA"))] + [("KRISTIANIA", "OSLO", "NORWAY")]

OSLO = ("A", "", "OSLO", "77", "2015", "", "")
NAMES = {
    # the parts of a name
    "A/Oslo/77/2015": OSLO, " a / oslo /0077/ 15": OSLO, "A/KRISTIANIA/77/2015": OSLO, "A(H1N1)/Oslo/77/2015": ("A(H1N1)", *OSLO[1:]), "ah3n2/oslo/77/2015": ("A(H3N2)", *OSLO[1:]),
    "B/New Ulm/XY-9/99": ("B", "", "NEW ULM", "XY-9", "1999", "", ""), "A/Oslo/77/2015-11-30": OSLO, "A/Oslo/77/2015 lab B7": (*OSLO[:6], "LAB B7"), "Oslo/77/2015": ("", *OSLO[1:]),
    # hosts: any word before a place, and those that are places too
    "A/Gull/Bergen/5/2003": ("A", "GULL", "BERGEN", "5", "2003", "", ""), "A/turkey/Graz/6/2010": ("A", "TURKEY", "GRAZ", "6", "2010", "", ""), "A/Fancy_Chicken/Turkey/8/2011": ("A", "FANCY_CHICKEN", "TURKEY", "8", "2011", "", ""),
    "A/harbour seal/Oslo/9/2014": ("A", "HARBOUR SEAL", "OSLO", "9", "2014", "", ""), "A/Graz/West/12/2012": ("A", "", "GRAZ WEST", "12", "2012", "", ""), "A/Quito/B/7/2012": ("A", "", "QUITO", "B-7", "2012", "", ""),
    # every spelling of a reassortant, before, after and around the name
    **{f"A/Oslo/77/2015 {spelled}": (*OSLO[:5], called, "") for spelled, called in {
        "NYMC X-501": "NYMC-501", "NYMC BX-502": "NYMC-502", "NYMC-503A": "NYMC-503A", "BX 504": "NYMC-504", "X-505": "NYMC-505", "NIB-61": "NIB-61", "NIBSC 62": "NIB-62", "NIBRG-63": "NIB-63", "PR8-IDCDC-RG 44A": "RG-44A",
        "IDCDC-RG45": "RG-45", "IBCDC-RG-46": "RG-46", "RG7.1": "RG-7.1", "CBER-31": "CBER-31", "BVR 32B": "BVR-32B", "IVR-333": "IVR-333", "CVR-34": "CVR-34", "CNIC-1501": "CNIC-1501", "SAN-012": "SAN-012", "IgYRP4.c2": "IGYRP4.C2", "PR8-HY": "PR8", "PR8": "PR8",
    }.items()},
    "A/Oslo/77/2015_X-7": (*OSLO[:5], "NYMC-7", ""), "NIB-61 (A/Oslo/77/2015)": (*OSLO[:5], "NIB-61", ""), "CVR-34(A/Oslo/77/2015": (*OSLO[:5], "CVR-34", ""), "A/Oslo/77/2015_PR8-HY": (*OSLO[:5], "PR8", ""),
    "BVR-9": ("", "", "", "", "", "BVR-9", ""), "NYMC X-9 CL-2": ("", "", "", "", "", "NYMC-9", "CL-2"),
    # declared ones: all names count
    "A/reassortant/NYMC X-9 CL-2(Oslo/77/2015)": ("", *OSLO[1:5], "NYMC-9 CL-2", ""), "A/RESASSORTANT/X-11(Oslo/77/2015)": ("", *OSLO[1:5], "NYMC-11", ""), "B/reassortant/CDC4(Oslo/77/2015)": ("", *OSLO[1:5], "CDC4", ""),
    "A/reassortant/BS(Oslo/77/2015)": ("", *OSLO[1:5], "BS", ""), "A/reassortant/NYMC X-12(NYMC X-13 x Oslo/77/2015)": ("", *OSLO[1:5], "NYMC-12 NYMC-13", ""), "A/reassortant/IVR-5(Oslo/77/2015 x IVR-6)": ("", *OSLO[1:5], "IVR-5 IVR-6", ""),
    "HighGrowth Reassortant SAN-3 (A/Oslo/77/2015)": (*OSLO[:5], "SAN-3", ""),
    # isolates that look like reassortants stay
    "A/Oslo/X-31/2015": (*OSLO[:3], "X-31", *OSLO[4:]), "A/Oslo/MAX9/2015": (*OSLO[:3], "MAX9", *OSLO[4:]),
}


def test_passages(spark):
    rows = spark.createDataFrame([(k,) for k in PASSAGES], "p string").select("p", passages.parsed(F.col("p"))["text"].alias("t")).collect()
    assert {r.p: r.t for r in rows} == PASSAGES


def test_passage_kinds(spark):
    rows = spark.createDataFrame([("SIAT1/E7",), ("E1/C2",), ("SPF2 (2001-01-31)",)], "p string").withColumn("x", passages.parsed(F.col("p")))
    got = rows.select(passages.is_egg(F.col("x")), passages.is_cell(F.col("x")), passages.without_date(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(True, False, "SIAT1/E7"), (False, True, "E1/MDCK2"), (True, False, "SPF2")]


@pytest.mark.parametrize("month_first", [False, True])
def test_dates(spark, month_first):
    cases = {k[0]: v for k, v in DATES.items() if k[1] == month_first}
    rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", dates.parse_date(F.col("d"), month_first, 2026).alias("t")).collect()
    assert {r.d: r.t for r in rows} == cases


def test_virus_names(spark):
    places = spark.createDataFrame(LOCATIONS, "name string, location string, country string")
    rows = names.parse_names(spark.createDataFrame([(k,) for k in NAMES], "name string"), places, this_year=2026).collect()
    got = {r["name"]: (r.subtype, r.host, r.location, r.isolation, r.year, r.reassortant, r.extra) for r in rows}
    assert {k: (v, NAMES[k]) for k, v in got.items() if v != NAMES[k]} == {}
    parts = ("subtype", "host", "location", "isolation", "year", "reassortant", "extra")
    made = spark.createDataFrame([("B", "GULL", "OSLO", "5", "2003", "NIB-1", "X")], ", ".join(f"{x} string" for x in parts)).select(names.rendered(*map(F.col, parts)))
    assert made.first()[0] == "B/GULL/OSLO/5/2003 NIB-1 X"


def test_series(spark):
    got = [(str(r.begin), str(r.end)) for r in dates.series(spark, "2011-05-31", "2011-07-02").collect()]
    assert got == [("2011-05-01", "2011-06-01"), ("2011-06-01", "2011-07-01"), ("2011-07-01", "2011-08-01")]
    assert str(dates.series(spark, "2026-11-28", "2026-11-29", "week").first().begin) == "2026-11-23"
