"""Location dictionaries, exports of sequences, maps and trees, and tables with earlier versions kept."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import maps
from ..session import keys_by_case
from .sequences import write_fasta

# The version and the parts of the location dictionary's document.
LOCATIONS_VERSION = "locationdb-v2"
PARTS = ("names", "replacements", "cdc_abbreviations", "countries", "locations")


@keys_by_case
def read_locations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """names (name, location), replacements (alias, name), abbreviations (abbreviation, location) and locations (location, latitude, longitude, country, division, continent) of the dictionary's JSON file."""
    schema = "`  version` string, continents array<string>, names map<string,string>, replacements map<string,string>, cdc_abbreviations map<string,string>, countries map<string,int>, locations map<string,array<string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    right = F.col("`  version`") == LOCATIONS_VERSION
    part = lambda c, *names: doc.select(F.explode(F.when(right, F.col(c)).otherwise(F.raise_error(F.lit("version of a location dictionary")))).alias(*names))
    countries = doc.select(F.explode("countries").alias("country", "k"), "continents").select("country", F.get("continents", F.col("k")).alias("continent"))
    places = part("locations", "location", "v").select("location", F.col("v")[0].cast("double").alias("latitude"), F.col("v")[1].cast("double").alias("longitude"), F.col("v")[2].alias("country"), F.col("v")[3].alias("division"))
    return {
        "names": part("names", "name", "location"),
        "replacements": part("replacements", "alias", "name"),
        "abbreviations": part("cdc_abbreviations", "abbreviation", "location"),
        "locations": places.join(countries, "country", "left").select("location", "latitude", "longitude", "country", "division", "continent"),
    }


def locations_json(tables: dict[str, DataFrame]) -> DataFrame:
    """One row, json: the dictionary's document from its tables."""
    pairs = lambda df, k, v: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias("m"))
    loc = tables["locations"]
    continents = loc.where("continent is not null").agg(F.array_sort(F.collect_set("continent")).alias("c"))
    countries = loc.where("continent is not null").select("country", "continent").distinct().crossJoin(F.broadcast(continents)).select("country", (F.array_position("c", F.col("continent")) - 1).cast("int").alias("k"))  # one row
    text = lambda c: F.to_json(F.col(c))
    places = loc.select("location", F.concat(F.lit("["), F.concat_ws(",", "latitude", "longitude", F.to_json(F.array("country", "division")).substr(F.lit(2), F.length(F.to_json(F.array("country", "division"))) - 2)), F.lit("]")).alias("v"))
    rows = places.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("location", "v"))), lambda x: F.concat(F.lit('"'), F.regexp_replace(x["location"], '(["\\\\])', "\\\\$1"), F.lit('":'), x["v"])), ",").alias("p"))
    one = pairs(tables["names"], "name", "location").select(F.col("m").alias("n")).crossJoin(pairs(tables["replacements"], "alias", "name").select(F.col("m").alias("r")))
    one = one.crossJoin(pairs(tables["abbreviations"], "abbreviation", "location").select(F.col("m").alias("a"))).crossJoin(pairs(countries, "country", "k").select(F.col("m").alias("k"))).crossJoin(continents).crossJoin(rows)  # one row each
    parts = [F.lit(f'{{"  version":"{LOCATIONS_VERSION}","continents":'), text("c"), F.lit(',"names":'), text("n"), F.lit(',"replacements":'), text("r"), F.lit(',"cdc_abbreviations":'), text("a"), F.lit(',"countries":'), text("k"), F.lit(',"locations":{'), F.col("p"), F.lit("}}")]
    return one.select(F.concat(*parts).alias("json"))


def save_sequences(seqs: DataFrame, path: str) -> None:
    """The sequence table as Parquet by subtype, sorted by name within a file, so that scans of a subtype or name skip the rest."""
    seqs.repartition("subtype").sortWithinPartitions("name").write.partitionBy("subtype").mode("overwrite").parquet(path)


def export_sequences(seqs: DataFrame, folder: str, columns: tuple[str, ...] = ("name", "isolation_date", "country", "lineage", "passage", "hash")) -> None:
    """fasta (amino acids, by seq_id), metadata (CSV with a header) and json (a document a line) below a folder."""
    ident = S.seq_id(F.col("name"), F.col("passage"), F.col("reassortant"))
    rows = seqs.withColumn("seq_id", ident)
    write_fasta(rows, f"{folder}/fasta", F.col("seq_id"))
    rows.select("seq_id", *columns).write.mode("overwrite").option("header", True).csv(f"{folder}/metadata")
    rows.write.mode("overwrite").json(f"{folder}/json")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_map(edges: DataFrame, layout: DataFrame, names: DataFrame, folder: str) -> None:
    """layout, distances (of table and map), all-pairs and error-lines of one chart as CSV; names: point_no, name."""
    write_csv(names.join(layout, "point_no", "left"), f"{folder}/layout")
    write_csv(maps.with_map_distances(edges, layout).select("p1", "p2", "kind", "distance", "map_distance"), f"{folder}/distances")
    write_csv(maps.all_pairs(layout), f"{folder}/all-pairs")
    write_csv(maps.error_lines(edges, layout), f"{folder}/error-lines")


def export_grid_test(found: DataFrame, names: DataFrame, folder: str) -> None:
    """Results of a grid test as JSON and CSV, with names; normal points are left out."""
    rows = found.where("status <> 'normal'").join(names, "point_no", "left")
    rows.write.mode("overwrite").json(f"{folder}/json")
    write_csv(rows.withColumn("place", F.array_join(F.transform("place", lambda x: F.round(x, 4).cast("string")), " ")), f"{folder}/csv")


def write_versioned(df: DataFrame, path: str) -> str | None:
    """Writes a Parquet table; one that is there already is kept beside it under its time, which is returned."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    here = hadoop.Path(path)
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = f"{path}.new-{time.time_ns()}"
    df.write.parquet(fresh)  # the old one stays until the new one is whole
    backup = None
    if files.exists(here):
        backup = f"{path}.~{time.strftime('%Y%m%d-%H%M%S')}-{time.time_ns() % 10**9:09d}~"
        files.rename(here, hadoop.Path(backup))
    files.rename(hadoop.Path(fresh), here)
    return backup


def versions(spark: SparkSession, path: str) -> list[str]:
    """The earlier versions of a table, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{path}.~*~")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(str(x.getPath().toString()) for x in found or [])


def text_table(df: DataFrame, gap: str = "  ", most: int = 1_000) -> str:
    """A table as lines of text with columns as wide as their longest value: for reports of at most so many rows."""
    rows = [df.columns, *([("" if v is None else str(v)) for v in r] for r in df.limit(most).collect())]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join(gap.join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows)
