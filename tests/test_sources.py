"""Readers and writers: round trips and small files of each form."""

import io
import json
import lzma
import zipfile

import pytest
from pyspark.sql import functions as F

from cartograph.operators import trees
from cartograph.sources import charts, sequences, tables
from cartograph.sources import trees as tree_files

CHART = {
    "  version": "acmacs-ace-v1",
    "c": {
        "i": {"v": "INFLUENZA", "V": "A(H3N2)", "A": "HI", "D": "20210101", "l": "LAB"},
        "a": [{"N": "A/X/1/2020", "P": "MDCK1", "D": "2020-01-01", "a": ["NEW"]}, {"N": "A/Y/2/2020", "l": ["LAB#1"]}],
        "s": [{"N": "A/X/1/2020", "I": "S1", "s": "FERRET"}, {"N": "A/Z/3/2020", "I": "S2"}],
        "t": {"l": [["40", "<10"], ["*", ">1280"]], "L": [[{"0": "40", "1": "<10"}, {"1": ">1280"}], [{"0": "80"}, {}]]},
        "P": [{"s": 12.5, "l": [[0.5, 1.0], [], [2.0, None], [1.0, 1.0]], "m": "none", "U": [0]}],
    },
}


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_chart_tables_and_back(spark, tmp_path):
    docs = charts.read(spark, write(tmp_path / "a.ace", json.dumps(CHART)))
    assert charts.info(docs).first()["type_subtype"] == "A(H3N2)"
    assert [(r.antigen_no, r["name"], r.annotations) for r in charts.antigens(docs).orderBy("antigen_no").collect()] == [(0, "A/X/1/2020", "NEW"), (1, "A/Y/2/2020", "")]
    assert charts.sera(docs).where("serum_id = 'S1'").first()["serum_species"] == "FERRET"
    assert {(r.antigen_no, r.serum_no, r.titer) for r in charts.titers(docs).collect()} == {(0, 0, "40"), (0, 1, "<10"), (1, 1, ">1280")}
    layers = charts.layers(docs)
    assert {(r.layer_no, r.antigen_no, r.serum_no, r.titer) for r in layers.collect()} == {(0, 0, 0, "40"), (0, 0, 1, "<10"), (0, 1, 1, ">1280"), (1, 0, 0, "80")}
    assert [r.coord for r in charts.layouts(docs).orderBy("point_no").collect()] == [[0.5, 1.0], None, None, [1.0, 1.0]]
    assert charts.projections(docs).first()["stress"] == 12.5
    text = charts.to_json(charts.antigens(docs), charts.sera(docs), layers, CHART["c"]["i"]).first()["json"]
    again = charts.from_json(spark, text)
    assert sorted(map(tuple, charts.layers(again).drop("chart_id").collect())) == sorted(map(tuple, layers.drop("chart_id").collect()))
    assert charts.antigens(again).where("antigen_no = 0").first()["passage"] == "MDCK1"
    assert charts.composed_name(charts.info(docs)).first()["chart_name"] == "LAB INFLUENZA A(H3N2) HI 20210101"
    with pytest.raises(Exception, match="version"):
        charts.info(charts.read(spark, write(tmp_path / "b.ace", json.dumps(CHART | {"  version": "other"})))).collect()


def test_fasta(spark, tmp_path):
    long = "A/X/1/2020_|_a=EPI1_|_b=A / H3N2_|_c=E4_|_d=_|_e=2020-01-02_|_f=_|_g=_|_h=_|_i=ID1_|_j=LAB_|_k=_|_l=_|_m=_|_n=_|_o=_|_p=_|_"
    path = write(tmp_path / "x.fas", f">A/One/1/2020_MDCK\nacg t\nACG\n>{long}\nAAA\n>A/Two/2/2021 | 2021-03-04 | SIAT1 | x | CRICK | B | y\nCCC\n\n")
    rows = {r["name"]: r for r in sequences.parse_headers(sequences.read_fasta(spark, path)).collect()}
    one, two, three = rows["A/One/1/2020"], rows["A/X/1/2020"], rows["A/Two/2/2021"]
    assert (one.sequence, one.passage) == ("ACGTACG", "MDCK")
    assert (two.type_subtype, two.passage, two.date, two.lab, two.lab_id, two.sequence) == ("A(H3N2)", "E4", "2020-01-02", "LAB", "ID1", "AAA")
    assert (three.type_subtype, three.date, three.passage, three.lab) == ("B", "2021-03-04", "SIAT1", "CRICK")
    df = spark.createDataFrame([("s1", "ACGTACGTAC"), ("s2", "AC")], "name string, aa string")
    sequences.write_fasta(df, str(tmp_path / "out"), F.col("name"), wrap=4, width=6, pad="X")
    back = {r.header: r.sequence for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert back == {"s1": "ACGTAC", "s2": "ACXXXX"}


def test_ncbi_and_seqdb_and_clades(spark, tmp_path):
    fasta = write(tmp_path / "n.fas", ">gb|MT123456.1|x\nACG\n>gb|MT999999|y\nTTT\n")
    meta = write(tmp_path / "n.dat", "MT123456\tHuman\t4\tH3N2\tUSA\t2020/01/01\t3\tInfluenza A virus (A/X/1/2020(H3N2))\t\t\tc\nMT999999\tHuman\t6\tH3N2\tUSA\t2020\t3\tz\t\t\tc\n")
    got = sequences.read_ncbi(spark, fasta, meta).collect()
    assert [(r.accession, r["name"], r.sequence) for r in got] == [("MT123456", "A/X/1/2020(H3N2)", "ACG")]
    db = {"  version": "sequence-database-v4", "subtype": "B", "size": 1, "data": [{"N": "B/X/1/2020", "d": ["2020-01-01", "2020-02-01"], "l": "V", "s": [{"a": "MKT", "n": "ATG", "H": "AB", "p": ["E2"], "l": {"CDC": ["7"]}}, {"a": "MKT", "H": "AB"}]}]}
    seqs = sequences.read_seqdb(spark, write(tmp_path / "db.json", json.dumps(db)))
    assert [(r.isolation_date, r.is_master) for r in seqs.orderBy("seq_no").collect()] == [("2020-02-01", True), ("2020-02-01", False)]
    assert sequences.by_lab_id(seqs, "CDC", "7").count() == 1
    rules = {"  version": "clades-v2", "A(H3N2)": [{"N": "3C", "aa": "156S !145K"}, "comment"], "B/Vic": [{"N": "V1A", "nuc": "206G", "set": "x"}], "?no": []}
    got = {tuple(r) for r in sequences.read_clade_rules(spark, write(tmp_path / "c.json", json.dumps(rules))).collect()}
    assert got == {("A(H3N2)", "3C", "", "aa", 156, "S", True), ("A(H3N2)", "3C", "", "aa", 145, "K", False), ("B/Vic", "V1A", "x", "nuc", 206, "G", True)}


def test_org_table(spark, tmp_path):
    text = """- Lab: CRICK
- Date: 2021-01-01

|            | name  | date | passage |       | S/A/1/2020 | S/B/2/2020 |
|------------+-------+------+---------+-------+------------+------------|
| name       |       |      |         |       | A/P/1/2020 | A/Q/2/2020 |
| serum_id   |       |      |         |       | F1         | F2         |
| # note     | x     |      |         |       |            |            |
|            | A/R/1 | 2020 | E2      |       | 40         | <10        |
|            | A/S/2 | 2021 | MDCK1   |       | ND         | 80 / 160   |
"""
    meta, cells = tables.read_org(spark, write(tmp_path / "t.org", text.replace("| name  | date | passage |       | S/A/1/2020 | S/B/2/2020 |", "| name  | date | passage |       |            |            |")))
    assert {(r.key, r.value) for r in meta.collect()} == {("lab", "CRICK"), ("date", "2021-01-01")}
    antigens, sera, titers = tables.org_chart(cells)
    assert [(r["name"], r.passage) for r in antigens.orderBy("antigen_no").collect()] == [("A/R/1", "E2"), ("A/S/2", "MDCK1")]
    assert [(r["name"], r.serum_id) for r in sera.orderBy("serum_no").collect()] == [("A/P/1/2020", "F1"), ("A/Q/2/2020", "F2")]
    found = {(r.antigen_no, r.serum_no, r.titer) for r in titers.collect()}
    assert found == {(0, 0, "40"), (0, 1, "<10"), (1, 1, "80")}
    again = tables.org_chart(tables.read_org(spark, write(tmp_path / "u.org", tables.org_text(antigens, sera, titers, {"lab": "CRICK"})))[1])[2]
    assert {(r.antigen_no, r.serum_no, r.titer) for r in again.collect()} == found


def test_cdc_tsv(spark, tmp_path):
    head = "test_date test_protocol test_subtype ag_cdc_id ag_strain_name ag_passage ag_do_not_report sr_strain_name sr_lot sr_passage sr_do_not_report titer_value".split()
    rows = [["2020", "HI", "H3", "1", "A/X", "E1", "", "A/X", "L1", "E1", "", "40"], ["2020", "HI", "H3", "2", "A/Y", "E1", "0", "A/X", "L1", "E1", "", "5.0"], ["2020", "HI", "H3", "2", "A/Y", "E1", "1", "A/X", "L1", "E1", "", "7"], ["2020", "HI", "H3", "1", "A/X", "E1", "", "P", "POOL", "", "", "9"]]
    path = write(tmp_path / "c.tsv", "\n".join("\t".join(r) for r in [head, *rows]))
    assert sorted((r.antigen_no, r.serum_no, r.titer) for r in tables.read_cdc(spark, path).collect()) == [(0, 0, "40"), (1, 0, "5")]


def xlsx(rows):
    out = io.BytesIO()
    cells = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{t.replace("<", "&lt;")}</t></is></c>' for c, t in enumerate(row) if t) + "</row>" for r, row in enumerate(rows))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


SHEET = [["Report", "", "", "", "", ""], ["", "", "", "A/P/1/2020", "A/Q/2/2020", "pool/x"], ["", "", "", "E2", "SIAT1", ""], ["", "", "", "F11/19", "F12/19", ""], ["A/R/1/2020", "2020-01-01", "E2", "40", "<10", "80"], ["A/S/2/2021", "2021-02-02", "MDCK1", "ND", "80", "80"], ["A/T/3/2021", "2021-02-03", "MDCK2", "160", "320", "20"]]


@pytest.mark.parametrize("form", ["csv", "csv.xz", "xlsx"])
def test_sheets(spark, tmp_path, form):
    if form == "xlsx":
        cells = tables.read_xlsx(spark, write(tmp_path / "s.xlsx", xlsx(SHEET)))
    else:
        raw = "\n".join(",".join(f'"{t}"' for t in row) for row in SHEET).encode()
        cells = tables.read_csv_sheet(spark, write(tmp_path / f"s.{form}", lzma.compress(raw) if form.endswith("xz") else raw))
    block = tables.titer_block(cells).first()
    assert (block.first_row, block.last_row, block.first_col, block.last_col) == (4, 6, 3, 5)
    assert {r.kind: r.col for r in tables.label_columns(cells, tables.titer_block(cells)).collect()} == {"name": 0, "date": 1, "passage": 2}
    antigens, sera, titers = tables.sheet_chart(cells)
    assert [r["name"] for r in antigens.orderBy("antigen_no").collect()] == ["A/R/1/2020", "A/S/2/2021", "A/T/3/2021"]
    assert [(r["name"], r.passage, r.serum_id) for r in sera.orderBy("serum_no").collect()] == [("A/P/1/2020", "E2", "F11/19"), ("A/Q/2/2020", "SIAT1", "F12/19")]
    assert {(r.antigen_no, r.serum_no, r.titer) for r in titers.collect()} == {(0, 0, "40"), (0, 1, "<10"), (1, 1, "80"), (2, 0, "160"), (2, 1, "320")}
    assert tables.find_cells(cells, "^A/P", "^E2$").count() == 1


def test_trees(spark, tmp_path):
    text = "(A:0.1,(B:0.2,C:0.3)x:0.05);"
    nodes = tree_files.read(spark, write(tmp_path / "t.nwk", text))
    assert {r["name"]: r.edge for r in nodes.where("is_leaf").collect()} == {"A": 0.1, "B": 0.2, "C": 0.3}
    assert trees.newick(nodes) == text
    again = tree_files.read(spark, write(tmp_path / "t.json", tree_files.to_json(nodes)))
    assert trees.newick(again) == text
    deep = "(" * 3000 + "A:1" + ")" * 3000 + ";"
    assert len(tree_files.newick_nodes(deep)) == 3001
    for bad in ("((A,B);", "A,B));"):
        with pytest.raises(ValueError):
            tree_files.newick_nodes(bad)
    less = trees.remove_leaves(nodes, nodes.where("name = 'B'"))
    assert trees.newick(less) == "(A:0.1,C:0.35);"


def test_styles_and_hooks(spark, tmp_path):
    path = write(tmp_path / "styles.json", json.dumps({"c": {"R": {"reset": {"z": 1}, "-clades": {"T": "x"}}, "p": {"d": [1]}}}))
    got = {r["name"]: json.loads(r.style) for r in charts.styles(spark, path).collect()}
    assert got == {"reset": {"z": 1}, "-clades": {"T": "x"}, "plot": {"d": [1]}}
    rows = spark.createDataFrame([("a/x.fas", "h", "AC"), ("b/y.fas", "h", "AC")], "file string, header string, sequence string")
    fixed = sequences.preprocessed(rows, {"^a/": lambda df: df.withColumn("header", F.upper("header")), "x": lambda df: df.where("false")})
    assert sorted(r.header for r in fixed.collect()) == ["H", "h"]
