"""The location dictionary as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored


def closed(replacements: DataFrame, names: DataFrame) -> DataFrame:
    """alias, name in capitals: where each chain of replacements leads to, the first name on it that is known.

    Pointer doubling; a chain has as many steps as there are aliases at most, so
    pointers that have not arrived after that many are in a cycle or lead
    nowhere, and their aliases are left out.
    """
    known = names.select(F.upper("name").alias("to")).distinct().withColumn("known", F.lit(True))
    state = stored(replacements.select(F.upper("alias").alias("alias"), F.upper("name").alias("to")).dropDuplicates(["alias"]).join(known, "to", "left"))
    for _ in range(state.count().bit_length()):
        if state.where("known is null").isEmpty():
            break
        on = state.select(F.col("alias").alias("to"), F.col("to").alias("_to"), F.col("known").alias("_known"))
        going = F.col("known").isNull()
        after = stored(state.join(on, "to", "left").select("alias", F.when(going, F.coalesce("_to", "to")).otherwise(F.col("to")).alias("to"), F.coalesce("known", "_known").alias("known")))
        discard(state)
        state = after
    return state.where("known").select("alias", F.col("to").alias("name"))


def resolve(rows: DataFrame, names: DataFrame, replacements: DataFrame, locations: DataFrame, column: str = "location") -> DataFrame:
    """Adds place, latitude, longitude, country, continent: by name, else by the name that replacements lead to, step by step; null if unknown.

    names: name, location; replacements: alias, name; locations: location,
    latitude, longitude, country, continent.
    """
    key = F.upper(F.trim(F.col(column)))
    df = rows.withColumn("_key", key).join(closed(replacements, names).select(F.col("alias").alias("_key"), F.col("name").alias("_other")), "_key", "left")
    df = df.join(names.select(F.upper("name").alias("_key"), F.col("location").alias("_p1")), "_key", "left").join(names.select(F.upper("name").alias("_other"), F.col("location").alias("_p2")), "_other", "left")
    df = df.withColumn("place", F.coalesce("_p1", "_p2"))
    places = locations.select(F.col("location").alias("place"), "latitude", "longitude", "country", "continent")
    return df.drop("_key", "_other", "_p1", "_p2").join(places, "place", "left")


def like(locations: DataFrame, pattern: str) -> DataFrame:
    return locations.where(F.col("location").like(pattern))


def near(locations: DataFrame, latitude: float, longitude: float, within: float = 0.01) -> DataFrame:
    return locations.where((F.abs(F.col("latitude") - latitude) <= within) & (F.abs(F.col("longitude") - longitude) <= within))


def unknown(rows: DataFrame, column: str = "location") -> DataFrame:
    """Names that did not resolve, with how often they occur."""
    return rows.where("place is null").groupBy(column).agg(F.count("*").alias("n"))


def added(table: DataFrame, **row: object) -> DataFrame:
    """A dimension table with one more row, in place of one with the same first column."""
    key = table.columns[0]
    new = table.sparkSession.createDataFrame([tuple(row[c] for c in table.columns)], table.schema)
    return table.where(F.col(key) != row[key]).unionByName(new)
