"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession

#: Rounds of pointer doubling after which a chain would have 2^64 steps.
MOST_ROUNDS = 64

_local: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a session on one machine, on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="cartograph-")
        named = _local["dir"]
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written as a table and read back: what follows neither repeats its work nor grows its plan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables from which nothing is read any more; other DataFrames are left alone."""
    for df in tables:
        if path := _paths.pop(df, None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark can reach."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def settled(state: DataFrame, step: Callable[[DataFrame], DataFrame], going: str | Column) -> DataFrame:
    """state after as many steps as it takes until no row is ``going``: each round's table replaces the one before.

    The last table stays, as the result is read from it.  What doesn't end after
    MOST_ROUNDS follows pointers round a cycle: an error.
    """
    state = stored(state)
    for _ in range(MOST_ROUNDS):
        if state.where(going).isEmpty():
            return state
        before, state = state, stored(step(state))
        discard(before)
    raise ValueError(f"not settled after {MOST_ROUNDS} rounds: the pointers form a cycle")
