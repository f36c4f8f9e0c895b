"""Charts as JSON documents, and as tables keyed by chart_id."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keys_by_case

# Fixed value: the version that documents carry.
VERSION = "acmacs-ace-v1"

_member = "N:string, a:array<string>, D:string, L:string, P:string, R:string, l:array<string>, A:string, B:string, s:string, I:string, C:string, T:string"
_info = "v:string, V:string, A:string, D:string, N:string, l:string, r:string"
_projection = "c:string, l:array<array<double>>, s:double, m:string, C:array<double>, t:array<double>, f:array<double>, d:boolean, U:array<int>, D:array<int>, u:array<int>"
_sparse = "array<map<string,string>>"
SCHEMA = f"`  version` string, c struct<i:struct<{_info}, S:array<struct<{_info}>>>, a:array<struct<{_member}>>, s:array<struct<{_member}>>, t:struct<l:array<array<string>>, d:{_sparse}, L:array<{_sparse}>>, P:array<struct<{_projection}>>, R:string, p:string>, _corrupt string"


@keys_by_case
def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a document (files that Spark decompresses too): chart_id and c.  Other versions are an error."""
    docs = spark.read.schema(SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("chart_id", F.input_file_name())
    known = F.when(F.col("_corrupt").isNotNull(), F.raise_error(F.concat(F.lit("not a chart: "), "chart_id"))).when(F.col("`  version`") != VERSION, F.raise_error(F.concat(F.lit("version of a chart: "), F.col("`  version`")))).otherwise(F.col("c"))
    return docs.select("chart_id", known.alias("c"))


@keys_by_case
def from_json(spark: SparkSession, text: str, chart_id: str = "chart") -> DataFrame:
    rows = spark.createDataFrame([(chart_id, text)], "chart_id string, text string")
    return rows.select("chart_id", F.from_json("text", SCHEMA).alias("d")).select("chart_id", F.col("d.c").alias("c"))


def styles(spark: SparkSession, path: str) -> DataFrame:
    """chart_id, name, style: semantic styles of documents as JSON text, and the older plot specification under the name "plot"."""
    docs = spark.read.option("wholetext", True).text(path).withColumn("chart_id", F.input_file_name())
    named = F.from_json(F.get_json_object("value", "$.c.R"), "map<string,string>")
    plot = F.get_json_object("value", "$.c.p")
    each = F.map_concat(F.coalesce(named, F.create_map().cast("map<string,string>")), F.when(plot.isNotNull(), F.create_map(F.lit("plot"), plot)).otherwise(F.create_map().cast("map<string,string>")))
    return docs.select("chart_id", F.explode(each).alias("name", "style"))


@keys_by_case
def info(docs: DataFrame) -> DataFrame:
    names = {"v": "virus", "V": "type_subtype", "A": "assay", "D": "date", "N": "name", "l": "lab", "r": "rbc"}
    return docs.select("chart_id", *(F.coalesce(F.col(f"c.i.{k}"), F.lit("")).alias(v) for k, v in names.items()), F.coalesce(F.size("c.i.S"), F.lit(0)).alias("n_sources"))


def _members(docs: DataFrame, key: str, number: str) -> DataFrame:
    rows = docs.select("chart_id", F.posexplode(f"c.{key}").alias(number, "m"))
    text = lambda k: F.coalesce(F.col(f"m.{k}"), F.lit(""))
    names = {"N": "name", "R": "reassortant", "P": "passage", "D": "date", "L": "lineage", "A": "aa", "B": "nuc"} | ({"s": "serum_species", "I": "serum_id"} if key == "s" else {})
    return rows.select("chart_id", number, *(text(k).alias(v) for k, v in names.items()), F.array_join(F.coalesce("m.a", F.array()), " ").alias("annotations"), F.coalesce("m.l", F.array()).alias("lab_ids"), F.col("m.T").alias("semantic"))


@keys_by_case
def antigens(docs: DataFrame) -> DataFrame:
    return _members(docs, "a", "antigen_no")


@keys_by_case
def sera(docs: DataFrame) -> DataFrame:
    return _members(docs, "s", "serum_no")


def _long(rows: DataFrame, keys: list[str]) -> DataFrame:
    each = rows.select(*keys, F.posexplode("m").alias("antigen_no", "row")).select(*keys, "antigen_no", F.explode("row").alias("s", "titer"))
    return each.select(*keys, "antigen_no", F.col("s").cast("int").alias("serum_no"), "titer").where("titer <> '*'")


@keys_by_case
def titers(docs: DataFrame) -> DataFrame:
    """Merged titers, from the dense or the sparse form."""
    dense = docs.where("c.t.l is not null").select("chart_id", F.posexplode("c.t.l").alias("antigen_no", "row")).select("chart_id", "antigen_no", F.posexplode("row").alias("serum_no", "titer")).where("titer <> '*'")
    return dense.unionByName(_long(docs.where("c.t.d is not null").select("chart_id", F.col("c.t.d").alias("m")), ["chart_id"]))


@keys_by_case
def layers(docs: DataFrame) -> DataFrame:
    return _long(docs.where("c.t.L is not null").select("chart_id", F.posexplode("c.t.L").alias("layer_no", "m")), ["chart_id", "layer_no"])


@keys_by_case
def projections(docs: DataFrame) -> DataFrame:
    rows = docs.select("chart_id", F.posexplode("c.P").alias("projection_no", "p"))
    return rows.select("chart_id", "projection_no", F.col("p.s").alias("stress"), F.coalesce("p.m", F.lit("none")).alias("minimum_column_basis"), F.coalesce("p.c", F.lit("")).alias("comment"), F.col("p.t").alias("transformation"), F.col("p.C").alias("forced_column_bases"), F.col("p.f").alias("avidity"), F.coalesce("p.d", F.lit(False)).alias("dodgy_is_regular"), F.col("p.U").alias("unmovable"), F.col("p.D").alias("disconnected"))


@keys_by_case
def layouts(docs: DataFrame) -> DataFrame:
    """coord is null where a point is disconnected."""
    rows = docs.select("chart_id", F.posexplode("c.P").alias("projection_no", "p")).select("chart_id", "projection_no", F.posexplode("p.l").alias("point_no", "coord"))
    there = (F.size("coord") > 0) & ~F.exists("coord", lambda x: x.isNull() | F.isnan(x))
    return rows.select("chart_id", "projection_no", "point_no", F.when(there, F.col("coord")).alias("coord"))


def to_json(antigens_: DataFrame, sera_: DataFrame, layers_: DataFrame, info_: dict, projections_: list[dict] | None = None) -> DataFrame:
    """One row, json: the document of one chart, its titers in the sparse layers form."""
    keep = lambda m: F.map_filter(m, lambda _, v: v != "")
    one = lambda names: F.to_json(keep(F.create_map(*(x for k, c in names.items() for x in (F.lit(k), F.coalesce(F.col(c), F.lit("")))))))
    base = {"N": "name", "R": "reassortant", "P": "passage", "D": "date", "L": "lineage", "A": "aa", "B": "nuc"}

    def listed(df: DataFrame, number: str, names: dict) -> DataFrame:
        names = {k: c for k, c in names.items() if c in df.columns}
        rows = df.select(F.struct(number, one(names).alias("j")).alias("r"))
        return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["j"]), ",").alias(number))

    a = listed(antigens_, "antigen_no", base)
    s = listed(sera_, "serum_no", base | {"s": "serum_species", "I": "serum_id"})
    cells = layers_.groupBy("layer_no", "antigen_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("serum_no").cast("string"), "titer")))).alias("m"))
    grid = layers_.select("layer_no").distinct().crossJoin(antigens_.select("antigen_no"))  # one chart's layers and antigens
    rows = grid.join(cells, ["layer_no", "antigen_no"], "left").select("layer_no", "antigen_no", F.coalesce(F.to_json("m"), F.lit("{}")).alias("j"))
    per = rows.groupBy("layer_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("antigen_no", "j"))), lambda r: r["j"]), ",").alias("t"))
    t = per.agg(F.concat(F.lit("[["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer_no", "t"))), lambda r: r["t"]), "],["), F.lit("]]")).alias("L"))
    head = json.dumps({k: v for k, v in info_.items() if v}, ensure_ascii=False)
    tail = f',"P":{json.dumps(projections_)}' if projections_ else ""
    return a.crossJoin(s).crossJoin(t).select(F.concat(F.lit(f'{{"  version":"{VERSION}","c":{{"i":{head},"a":['), "antigen_no", F.lit('],"s":['), "serum_no", F.lit('],"t":{"L":'), "L", F.lit("}" + tail + "}}")).alias("json"))  # one row each


def composed_name(info_: DataFrame) -> DataFrame:
    """lab virus assay rbc date (number of tables), parts that are empty left out."""
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("lab", "virus", "type_subtype", "assay", "rbc", "date")]
    return info_.withColumn("chart_name", F.when(F.col("name") != "", F.col("name")).otherwise(F.concat_ws(" ", *parts, F.when(F.col("n_sources") > 1, F.concat(F.lit("("), F.col("n_sources"), F.lit(" tables)"))))))


def table_text(antigens_: DataFrame, sera_: DataFrame, titers_: DataFrame) -> DataFrame:
    """antigen_no, name and a column for each serum: the table as people read it (one chart)."""
    numbers = [r[0] for r in sera_.select("serum_no").orderBy("serum_no").collect()]
    return antigens_.select("antigen_no", "name").join(titers_.groupBy("antigen_no").pivot("serum_no", numbers).agg(F.first("titer")), "antigen_no", "left").fillna("*").orderBy("antigen_no")
