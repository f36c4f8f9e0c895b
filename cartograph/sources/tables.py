"""Titer tables as laboratories send them: org tables, tab-separated titers, CSV and XLSX sheets."""

from __future__ import annotations

import io
import lzma
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import titer as T

_cells = "file string, sheet string, row int, col int, text string"


def read_org(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Meta lines (file, key, value) and cells (file, row, col, text) of the | grid; rules and # rows are left out."""
    lines = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name()).select("file", F.posexplode(F.split("value", "\\r?\\n")).alias("line", "text"))
    meta = lines.where(F.col("text").rlike("^- [A-Za-z]+ *:")).select("file", F.lower(F.regexp_extract("text", "^- ([A-Za-z]+) *:", 1)).alias("key"), F.trim(F.regexp_extract("text", "^- [A-Za-z]+ *:(.*)$", 1)).alias("value"))
    grid = lines.where(F.col("text").rlike("^\\s*\\|") & ~F.col("text").rlike("^\\s*\\|-"))
    w = Window.partitionBy("file").orderBy("line")
    inner = F.split(F.regexp_replace(F.trim("text"), "^\\||\\|$", ""), "\\|")
    cells = grid.withColumn("row", F.row_number().over(w) - 1).select("file", "row", F.posexplode(inner).alias("col", "t")).select("file", "row", "col", F.trim("t").alias("text"))
    return meta, cells


def org_chart(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Antigens, sera and titers of an org grid: row 0 names antigen fields, column 0 names serum rows."""
    head = cells.where("row = 0 and text <> '' and col > 0 and not text like '#%'").select("file", "col", F.lower("text").alias("field"))
    side = cells.where("col = 0 and text <> '' and row > 0 and not text like '#%'").select("file", "row", F.lower("text").alias("field"))
    serum_rows, antigen_cols = side, head
    sera_cells = cells.join(serum_rows, ["file", "row"]).join(antigen_cols.select("file", "col"), ["file", "col"], "left_anti").where("col > 0 and text <> ''")
    numbers = lambda df, by, name: df.select("file", by).distinct().withColumn(name, F.row_number().over(Window.partitionBy("file").orderBy(by)) - 1)
    serum_no = numbers(sera_cells, "col", "serum_no")
    titer_rows = cells.where("row > 0").join(serum_rows.select("file", "row"), ["file", "row"], "left_anti").join(cells.where("col = 0 and text like '#%'").select("file", "row"), ["file", "row"], "left_anti")
    antigen_no = numbers(titer_rows.join(antigen_cols, ["file", "col"]).where("text <> ''"), "row", "antigen_no")
    wide = lambda df, no, keys: df.groupBy("file", no).agg(*(F.max(F.when(F.col("field") == k, F.col("text"))).alias(k) for k in keys)).na.fill("")
    antigens = wide(titer_rows.join(antigen_cols, ["file", "col"]).join(antigen_no, ["file", "row"]), "antigen_no", ["name", "date", "passage", "reassortant", "lab_id", "annotation"])
    sera = wide(sera_cells.join(serum_no, ["file", "col"]), "serum_no", ["name", "passage", "reassortant", "serum_id", "annotation", "species"])
    titers = titer_rows.join(antigen_no, ["file", "row"]).join(serum_no, ["file", "col"]).select("file", "antigen_no", "serum_no", T.checked(F.col("text")).alias("titer"))
    return antigens, sera, titers.where("titer <> '*'")


def org_text(antigens: DataFrame, sera: DataFrame, titers: DataFrame, meta: dict[str, str]) -> str:
    """The org form of one chart."""
    a_keys, s_keys = ["name", "date", "passage", "reassortant", "lab_id"], ["name", "passage", "reassortant", "serum_id"]
    a, s = antigens.orderBy("antigen_no").collect(), sera.orderBy("serum_no").collect()  # one chart
    cell = {(r["antigen_no"], r["serum_no"]): r["titer"] for r in titers.collect()}
    lines = [f"- {k.capitalize()}: {v}" for k, v in meta.items()] + [""]
    row = lambda xs: "| " + " | ".join(xs) + " |"
    lines.append(row(["", *a_keys, *("" for _ in s)]))
    lines += [row([k, *("" for _ in a_keys), *(r[k] or "" for r in s)]) for k in s_keys]
    lines += [row(["", *(r[k] or "" for k in a_keys), *(cell.get((r["antigen_no"], x["serum_no"]), "*") for x in s)]) for r in a]
    return "\n".join(lines) + "\n"


def read_cdc(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated titers, one a row, with table, antigen_no and serum_no; rows not to be reported are left out."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    no = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).isin("", "0", "n", "no", "false")
    rows = rows.where(no("ag_do_not_report") & no("sr_do_not_report"))
    rows = rows.withColumn("table", F.concat_ws(":", "test_subtype", "test_protocol", "test_date"))
    antigen = F.struct("ag_strain_name", "ag_passage", "ag_cdc_id")
    serum = F.struct("sr_strain_name", "sr_lot", "sr_passage")
    out = rows.withColumn("antigen", antigen).withColumn("serum", serum)
    out = out.withColumn("antigen_no", F.dense_rank().over(Window.partitionBy("table").orderBy("antigen")) - 1).withColumn("serum_no", F.dense_rank().over(Window.partitionBy("table").orderBy("serum")) - 1)
    return out.where(~F.upper(F.coalesce("sr_lot", F.lit(""))).contains("POOL")).withColumn("titer", T.checked(F.col("titer_value")))


def read_csv_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a CSV file: file, sheet, row, col, text; quotes, backslash escapes and line feeds in cells as usual."""
    files = spark.read.format("binaryFile").load(path)

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for pdf in frames:
            for name, raw in zip(pdf["path"], pdf["content"]):
                rows = list(csv.reader(io.StringIO(opened(bytes(raw)).decode("utf-8-sig")), escapechar="\\", doublequote=True))
                yield _frame(name, "", {(r, c): t for r, row in enumerate(rows) for c, t in enumerate(row)})

    return files.select("path", "content").mapInPandas(cells, _cells)


def opened(raw: bytes) -> bytes:
    """Decompressed by its first bytes: xz, gzip and bzip2."""
    import bz2
    import gzip

    if raw[:6] == b"\xfd7zXZ\0":
        return lzma.decompress(raw)
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else bz2.decompress(raw) if raw[:3] == b"BZh" else raw


def _frame(name: str, sheet: str, found: dict[tuple[int, int], str]) -> pd.DataFrame:
    rows = [(name, sheet, r, c, t.strip()) for (r, c), t in found.items() if t and t.strip()]
    return pd.DataFrame(rows, columns=["file", "sheet", "row", "col", "text"]).astype({"row": "int32", "col": "int32"})


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all sheets of XLSX files, as text."""
    files = spark.read.format("binaryFile").load(path)
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf["path"], pdf["content"]):
                z = zipfile.ZipFile(io.BytesIO(bytes(raw)))
                shared = []
                if "xl/sharedStrings.xml" in z.namelist():
                    shared = ["".join(t.text or "" for t in si.iter(ns + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(ns + "si")]
                for sheet in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                    found = {}
                    for c in ElementTree.fromstring(z.read(sheet)).iter(ns + "c"):
                        letters, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                        col = 0
                        for ch in letters:
                            col = 26 * col + ord(ch) - 64
                        value, inline = c.find(ns + "v"), c.find(ns + "is")
                        text = shared[int(value.text)] if c.get("t") == "s" else "".join(t.text or "" for t in inline.iter(ns + "t")) if inline is not None else value.text if value is not None else ""
                        found[(int(number) - 1, col - 1)] = text or ""
                    yield _frame(name, sheet.rsplit("/", 1)[1].removesuffix(".xml"), found)

    return files.select("path", "content").mapInPandas(cells, _cells)


TITER_CELL = "^\\s*[<>~]?\\s*[0-9]{1,6}(?:\\.0+)?\\s*$|^\\s*(?:\\*|ND|NT|<|>)\\s*$"
SHEET = ["file", "sheet"]


def titer_block(cells: DataFrame) -> DataFrame:
    """file, sheet, first_row, last_row, first_col, last_col: rows whose longest run of titer cells is as the most common one."""
    like = cells.where(F.col("text").rlike(TITER_CELL))
    w = Window.partitionBy(*SHEET, "row").orderBy("col")
    runs = like.withColumn("run", F.col("col") - F.row_number().over(w)).groupBy(*SHEET, "row", "run").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count("*").alias("n"))
    best = runs.groupBy(*SHEET, "row").agg(F.max_by(F.struct("first_col", "last_col"), F.struct("n", -F.col("first_col"))).alias("b"), F.max("n").alias("n")).where("n > 1")
    common = best.groupBy(*SHEET, "b").agg(F.count("*").alias("rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    return common.groupBy(*SHEET).agg(F.max_by(F.struct("first_row", "last_row", "b"), F.struct("rows", "first_row")).alias("x")).select(*SHEET, "x.first_row", "x.last_row", "x.b.first_col", "x.b.last_col")


# What cells of the columns beside the titers look like.
COLUMNS = {"name": "(?i)^(?:A|B)[/(].*/.*/|^[A-Z][A-Za-z .]+/[^/]+/\\d{2,4}$", "date": "^\\d{4}-\\d{2}-\\d{2}|^\\d{1,2}/\\d{1,2}/\\d{2,4}$", "passage": "(?i)^(?:E|EGG|MDCK|SIAT|C|S|X|M|QMC|OR|CELL|SPF)[0-9X?]*(?:[/,+ ].*)?$", "lab_id": "^(?:[A-Z]{1,4}-?)?\\d{5,10}$"}


def label_columns(cells: DataFrame, block: DataFrame) -> DataFrame:
    """file, sheet, kind, col: for each kind the column outside the block in whose rows most cells look like it."""
    inside = cells.join(block, SHEET).where("row between first_row and last_row and not (col between first_col and last_col)")
    each = inside.groupBy(*SHEET, "col").agg(*(F.count_if(F.col("text").rlike(p)).alias(k) for k, p in COLUMNS.items()))
    long = each.select(*SHEET, "col", F.explode(F.create_map(*(x for k in COLUMNS for x in (F.lit(k), F.col(k))))).alias("kind", "n")).where("n > 0")
    return long.groupBy(*SHEET, "kind").agg(F.max_by("col", F.struct("n", -F.col("col"))).alias("col"))


def find_cells(cells: DataFrame, pattern: str, below: str | None = None) -> DataFrame:
    """Cells that match; with below, those whose lower neighbour matches that."""
    hit = cells.where(F.col("text").rlike(pattern))
    if below is None:
        return hit
    under = cells.where(F.col("text").rlike(below)).select(*SHEET, (F.col("row") - 1).alias("row"), "col")
    return hit.join(under, [*SHEET, "row", "col"], "left_semi")


def sheet_chart(cells: DataFrame, control: str = "(?i)pool|control|normal") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Antigens, sera and titers of sheets with antigens in rows and serum names in the rows above the titers; control sera are left out."""
    block, labels = titer_block(cells), label_columns(cells, titer_block(cells))
    rows = cells.join(block, SHEET)
    number = lambda df, by, name: df.select(*SHEET, by).distinct().withColumn(name, F.row_number().over(Window.partitionBy(*SHEET).orderBy(by)) - 1)
    fields = rows.where("row between first_row and last_row").join(labels, [*SHEET, "col"])
    antigen_no = number(fields.where("kind = 'name'"), "row", "antigen_no")
    antigens = fields.join(antigen_no, [*SHEET, "row"]).groupBy(*SHEET, "antigen_no").agg(*(F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in COLUMNS)).na.fill("")
    above = rows.where("row < first_row and col between first_col and last_col")
    named = above.where(F.col("text").rlike(COLUMNS["name"])).groupBy(*SHEET, "col").agg(F.max_by("text", "row").alias("name"))
    passages = above.where(F.col("text").rlike(COLUMNS["passage"])).groupBy(*SHEET, "col").agg(F.max_by("text", "row").alias("passage"))
    ids = above.where(F.col("text").rlike("^[A-Z]*\\d[\\w/-]*$") & ~F.col("text").rlike(COLUMNS["passage"])).groupBy(*SHEET, "col").agg(F.max_by("text", "row").alias("serum_id"))
    serum = named.where(~F.col("name").rlike(control)).join(passages, [*SHEET, "col"], "left").join(ids, [*SHEET, "col"], "left").na.fill("")
    serum_no = number(serum, "col", "serum_no")
    titers = rows.where("row between first_row and last_row and col between first_col and last_col").join(antigen_no, [*SHEET, "row"]).join(serum_no, [*SHEET, "col"])
    titers = titers.select(*SHEET, "antigen_no", "serum_no", T.checked(F.col("text")).alias("titer")).where("titer <> '*'")
    return antigens, serum.join(serum_no, [*SHEET, "col"]).drop("col"), titers
