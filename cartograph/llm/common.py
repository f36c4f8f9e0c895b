"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, \x09-\x0D and \x20: what separates words.
WS = " \t\n\x0b\f\r"
#: One word, as a Java regular expression.
WORD = "[^ \\t\\n\\x0B\\f\\r]+"

_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a temporary folder; on a
    cluster executors could not read each other's tables, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="cartograph-")
        named = _local["dir"]
    return named.rstrip("/")


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    What follows neither repeats the work above nor depends on any executor
    staying alive.  Tables go at the end of the block of scoped() that they are
    made in; those to keep live on to the end of the block around it, or, where
    there is none, for as long as the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _scopes.get()
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """A block whose cut tables are removed at its end; results that outlive it have to be cut to keep."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(docs: DataFrame, keep: bool = False) -> DataFrame:
    """docs with __uid, a number for each row, written once with the rows.

    The number depends on how a scan is split, which follows the executors that
    live at that time; so no later job may make it again.
    """
    return cut(docs.withColumn("__uid", F.monotonically_increasing_id()), keep)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of a text: one regular expression pass, no array is built."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")
