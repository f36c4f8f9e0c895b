"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(name: str = "cartograph", **settings: str) -> SparkSession:
    """The active session, or a new one; settings (with _ for .) go over the defaults."""
    named = {k.replace("_", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=SETTINGS | named).getOrCreate()


@contextmanager
def case_sensitive(spark: SparkSession) -> Iterator[None]:
    """While a plan is made, names that differ in case are different: the keys of some documents do."""
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def keys_by_case(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions whose first argument is the session or a DataFrame."""

    @wraps(f)
    def run(first: SparkSession | DataFrame, *args, **named) -> DataFrame:
        with case_sensitive(first if isinstance(first, SparkSession) else first.sparkSession):
            return f(first, *args, **named)

    return run
