"""The sequence table as a stream: state by hash, changes as output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.updates import INPUT, KEPT, REJECTED, RESULT, Holder, judged

#: The state store that the processor needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGES = "name string, hash string, is_holder boolean, aa string, passages string, dates string, seq_no long, epoch long, version long"


class Updates(StatefulProcessor):
    """Of each hash its holder, and by name what refers to it; a conflict empties the names."""

    def __init__(self, expiry_ms: int | None = None):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "name string, length long, epoch long, version long", self.expiry_ms)
        self.names = handle.getMapState("names", "name string", "aa string, passages string, dates string, seq_no long", self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows).sort_values(["seq_no", "name", "aa"])  # the rows of one hash in one micro-batch
        holder, version = None, 0
        if self.holder.exists():
            *state, version = self.holder.get()
            holder = Holder(*state)
        changed: dict[str, list] = {}
        for row in batch.itertuples():
            epoch = holder.epoch if holder else 0
            holder, verdict = judged(holder, row.name, len(row.aa), row.issues != "")
            if verdict == REJECTED:
                continue
            if holder.epoch != epoch:
                self.names.clear()
                changed.clear()
            if row.name in changed:
                aa, passages, dates, first = changed[row.name]
            elif self.names.containsKey((row.name,)):
                aa, passages, dates, first = self.names.getValue((row.name,))
            else:
                aa, passages, dates, first = None, "", "", row.seq_no
            dates = _united(dates, row.isolation_date if len(row.isolation_date) == 10 else "")
            changed[row.name] = [row.aa if verdict == KEPT else aa, _united(passages, row.passage), dates, min(first, row.seq_no)]
        for name, values in changed.items():
            self.names.updateValue((name,), tuple(values))
        self.holder.update((*holder, version + 1))
        out = [(name, key[0], name == holder.name, *values, holder.epoch, version + 1) for name, values in changed.items()]
        if out:
            yield pd.DataFrame(out, columns=[*RESULT, "epoch", "version"])

    def close(self) -> None:
        pass


def _united(old: str, new: str) -> str:
    return ",".join(sorted({*filter(None, old.split(",")), *filter(None, [new])}))


def changes(new: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """The stream of changed rows: the row of a (name, hash) as it is now, the epoch of its hash and a version that grows.

    With expiry_ms, a hash that nothing has come for in that time is forgotten:
    the next row with it holds it anew.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in INPUT[1:]]
    rows = new.select(F.col("seq_no").cast("long").alias("seq_no"), *filled)
    return rows.groupBy("hash").transformWithStateInPandas(Updates(expiry_ms), CHANGES, "Update", "ProcessingTime" if expiry_ms else "None")


def update_sequences(new: DataFrame, table: str, checkpoint: str, expiry_ms: int | None = None) -> StreamingQuery:
    """Each micro-batch's changes go to the table as a folder of its own; running a batch again replaces its folder."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    new.sparkSession.conf.set(*PROVIDER)
    return changes(new, expiry_ms).writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The rows of the table now: of each hash the last epoch, of each name in it the last version."""
    rows = spark.read.schema(CHANGES).parquet(table)
    last = rows.groupBy("hash").agg(F.max("epoch").alias("epoch"))
    newest = Window.partitionBy("hash", "name").orderBy(F.col("version").desc())
    return rows.join(last, ["hash", "epoch"]).withColumn("k", F.row_number().over(newest)).where("k = 1").select(*RESULT, "epoch", "version")


def compact(spark: SparkSession, table: str, to: str) -> None:
    """A table's current rows as one batch; reading it costs what it holds, not what has happened."""
    current(spark, table).write.parquet(f"{to}/batch=0")
