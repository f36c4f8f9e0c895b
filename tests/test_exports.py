"""Exports and dictionaries by round trips; ancestral states; reports."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from cartograph.operators import lookups, matching, semantic, titers, trees
from cartograph.sources import exports

DOC = {
    "  version": "locationdb-v2", "?names": "comment", "continents": ["EUROPE", "ASIA"], "countries": {"NORWAY": 0, "JAPAN": 1}, "names": {"OSLO": "OSLO", "KYOTO CITY": "KYOTO"},
    "replacements": {"KRISTIANIA": "OSLO"}, "cdc_abbreviations": {"OS": "OSLO"}, "locations": {"OSLO": [59.9, 10.75, "NORWAY", "EAST"], "KYOTO": [35.0, 135.75, "JAPAN", ""]},
}


def test_locations_by_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC, indent=1))
    t = exports.read_locations(spark, f"{tmp_path}/a.json")
    assert {tuple(r) for r in t["locations"].collect()} == {("OSLO", 59.9, 10.75, "NORWAY", "EAST", "EUROPE"), ("KYOTO", 35.0, 135.75, "JAPAN", "", "ASIA")}
    text = exports.locations_json(t).first()["json"]
    (tmp_path / "b.json").write_text(text)
    again = exports.read_locations(spark, f"{tmp_path}/b.json")
    assert all({tuple(r) for r in again[k].collect()} == {tuple(r) for r in t[k].collect()} for k in t)
    (tmp_path / "c.json").write_text(json.dumps(DOC | {"  version": "other"}))
    with pytest.raises(Exception, match="version"):
        exports.read_locations(spark, f"{tmp_path}/c.json")["names"].collect()


def test_sequences_are_saved_and_exported(spark, tmp_path):
    seqs = spark.createDataFrame([("A/X/1/2000", "E1", "", "ACDE", "h1", "2000-01-01", "US", "", "H3"), ("B/Y/2/2001", "M2", "R", "AC", "h2", "2001-01-01", "FR", "V", "B")], "name string, passage string, reassortant string, aa string, hash string, isolation_date string, country string, lineage string, subtype string")
    exports.save_sequences(seqs, f"{tmp_path}/db")
    assert {r.name for r in spark.read.parquet(f"{tmp_path}/db").where("subtype = 'B'").collect()} == {"B/Y/2/2001"}
    exports.export_sequences(seqs, f"{tmp_path}/out")
    fasta = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/out/fasta/part-*"))
    assert fasta.count(">") == 2 and ">A/X/1/2000_E1\nACDE\n" in fasta
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/metadata").count() == 2 and spark.read.json(f"{tmp_path}/out/json").count() == 2


def test_maps_and_grid_tests_are_exported(spark, tmp_path):
    layout = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, None, None)], "point_no int, x double, y double")
    edges = spark.createDataFrame([(0, 1, "regular", 4.0)], "p1 int, p2 int, kind string, distance double")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "point_no int, name string")
    exports.export_map(edges, layout, names, f"{tmp_path}/map")
    read = lambda x: spark.read.option("header", True).csv(f"{tmp_path}/map/{x}").collect()
    assert len(read("layout")) == 3 and [float(r.map_distance) for r in read("distances")] == [5.0] and len(read("all-pairs")) == 1 and [float(r.error) for r in read("error-lines")] == [-1.0]
    found = spark.createDataFrame([(0, "normal", 0.0, 0.0, None), (1, "trapped", 2.0, -1.0, [1.0, 2.0])], "point_no int, status string, distance double, change double, place array<double>")
    exports.export_grid_test(found, names, f"{tmp_path}/grid")
    assert [r.name for r in spark.read.json(f"{tmp_path}/grid/json").collect()] == ["b"]


def test_earlier_versions_are_kept(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert exports.write_versioned(spark.range(1), path) is None
    first = exports.write_versioned(spark.range(2), path)
    exports.write_versioned(spark.read.parquet(path).union(spark.range(5)), path)
    assert spark.read.parquet(path).count() == 7 and [spark.read.parquet(v).count() for v in exports.versions(spark, path)] == [1, 2] and exports.versions(spark, path)[0].endswith(first.rsplit("/", 1)[1])
    assert exports.text_table(spark.createDataFrame([("a", 1), ("long", None)], "name string, n int")) == "name  n\na     1\nlong"


def test_ancestral_states_by_shared_leaves(spark):
    schema = "node_id long, parent_id long, child_order int, is_leaf boolean, name string, edge double"
    mine = spark.createDataFrame([(0, None, 0, False, "", 0.0), (-1, 0, 0, False, "", 1.0), (1, -1, 0, True, "A", 1.0), (2, -1, 1, True, "B", 1.0), (3, 0, 1, True, "C", 1.0)], schema)
    other = spark.createDataFrame([(0, None, 0, False, "ROOT", 0.0), (1, 0, 0, True, "C", 1.0), (-9, 0, 1, False, "N1", 1.0), (2, -9, 0, True, "B", 1.0), (3, -9, 1, True, "A", 1.0)], schema)
    states = spark.createDataFrame([("N1", "ACD"), ("ROOT", "AAA")], "name string, state string")
    assert {tuple(r) for r in trees.ancestral_states(mine, other, states).collect()} == {(-1, "ACD"), (0, "AAA")}


def test_attributes_and_reports(spark):
    a = spark.createDataFrame([(0, "A/OSLO/1/2015", "", "E3", "2015-01-01"), (1, "A/OSLO/2/2016", "R", "M1", "")], "antigen_no int, name string, reassortant string, passage string, date string")
    clades = spark.createDataFrame([(1, "3C 2A")], "antigen_no int, clades string")
    got = {r.antigen_no: r.semantic for r in semantic.populated(a, matching.is_egg(F.col("passage")), "2016-06-20", clades, a.limit(1)).collect()}
    assert got == {0: {"p": "e", "age": "12", "R": "1"}, 1: {"p": "r", "age": "12", "C": "3C 2A"}}
    assert semantic.clade_rules(["x", "y"], ["red"])[1] == {"select": {"C": "y"}, "set": {"fill": "red"}, "title": "y"} and semantic.pale_rules()[0]["set"] == {"fill": "pale", "outline": "pale"}
    named = a.select(semantic.display_name(F.lit("NEW ULM"), F.lit("7"), F.lit("2019"), F.col("passage"), F.col("reassortant")).alias("n"))
    assert [r.n for r in named.collect()] == ["New Ulm/7/19 E3", "New Ulm/7/19 R"]
    with pytest.raises(ValueError, match="more than once"):
        matching.without_duplicates(a.withColumn("annotations", F.lit("")).union(a.withColumn("annotations", F.lit(""))), "name", "reassortant")
    marked = lookups.with_serology(a.withColumn("semantic", F.create_map(F.lit("serology"), F.lit("1"))), spark.createDataFrame([(1, 0), (0, 1)], "antigen_no int, choice int"))
    assert {r.antigen_no: r.semantic for r in marked.collect()} == {0: {}, 1: {"serology": "1"}}
    assert lookups.printed(spark.createDataFrame([(f"n{k:02}",) for k in range(25)], "n string"), "n") .endswith("n19\n... 5 more")
    layers = spark.createDataFrame([(0, 0, 0, "10"), (0, 0, 1, "20"), (0, 0, 2, "40")], "antigen_no int, serum_no int, layer_no int, titer string")
    assert {(r.layer_no, r.titer) for r in titers.remove_layers(layers, [1]).collect()} == {(0, "10"), (1, "40")}
    path = spark.range(1).select(lookups.table_path(F.lit("A(H3N2)"), F.lit("HI"), F.lit("CDC"), F.lit("Turkey")).alias("p")).first()["p"]
    assert path == "h3-hi-turkey-cdc"
