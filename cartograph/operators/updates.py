"""The sequence table under updates whose order matters: who holds a hash, who refers to the holder, who is evicted.

Rows come in the order of seq_no.  The first row with a hash holds it.  Later
rows of the holder's name replace its sequence; rows of other names refer to the
holder if their sequence is as long.  Where the length differs, the hash stands
for two sequences: a row with issues is rejected, one without evicts the holder
and all that refer to it, and holds the hash from then on (a new epoch).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

KEPT, REFERS, REJECTED = "kept", "refers", "rejected"
#: Columns that an update reads.
INPUT = ("seq_no", "name", "hash", "aa", "passage", "isolation_date", "issues")
RESULT = ("name", "hash", "is_holder", "aa", "passages", "dates", "seq_no")


class Holder(NamedTuple):
    """What one hash needs for the next row."""

    name: str
    length: int
    epoch: int


def judged(holder: Holder | None, name: str, length: int, issues: bool) -> tuple[Holder, str]:
    """The holder after a row, and what becomes of the row."""
    if holder is None:
        return Holder(name, length, 0), KEPT
    if name == holder.name:
        return holder._replace(length=length), KEPT
    if length == holder.length:
        return holder, REFERS
    if issues:
        return holder, REJECTED
    return Holder(name, length, holder.epoch + 1), KEPT


def _judge_sorted(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by hash and order: one holder is held at a time."""
    at, holder = None, None
    for pdf in frames:
        verdicts, epochs = [], []
        for h, name, length, issues in zip(pdf["hash"], pdf["name"], pdf["length"], pdf["has_issues"]):
            if h != at:
                at, holder = h, None
            holder, verdict = judged(holder, name, length, issues)
            verdicts.append(verdict)
            epochs.append(holder.epoch)
        yield pdf.assign(verdict=verdicts, epoch=epochs)[["row", "verdict", "epoch"]]


def _merged(rows: DataFrame) -> DataFrame:
    """One row a (name, hash): passages and full dates united, the holder's last sequence."""
    return rows.groupBy("name", "hash").agg(
        F.max_by("aa", F.when(F.col("verdict") == KEPT, F.col("seq_no"))).alias("aa"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("passage") != "", F.col("passage")))), ",").alias("passages"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.length("isolation_date") == 10, F.col("isolation_date")))), ",").alias("dates"),
        F.min("seq_no").alias("seq_no"),
        F.max(F.col("verdict") == KEPT).alias("is_holder"),
    ).select(*RESULT)


def updated(rows: DataFrame) -> DataFrame:
    """name, hash, is_holder, aa (null where the row refers to the holder), passages, dates, seq_no (the first): what the table holds in the end.

    A hash whose sequences are all of one length has no conflicts: aggregations
    do.  Only rows of the other hashes are put in order, each hash in one task,
    which keeps one holder and passes the rows through.  Null names, hashes and
    sequences count as empty; ties of seq_no go by name and sequence.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in INPUT[1:]]
    rows = stored(rows.select(F.col("seq_no").cast("long").alias("seq_no"), *filled).withColumn("row", F.monotonically_increasing_id()))
    n = F.length("aa")
    lengths = rows.groupBy("hash").agg(F.min(n).alias("least"), F.max(n).alias("most"))
    in_conflict = lengths.where("least <> most").select("hash")

    calm = rows.join(in_conflict, "hash", "left_anti")
    firsts = calm.groupBy("hash").agg(F.min(F.struct("seq_no", "name", "aa")).alias("first")).select("hash", F.col("first.name").alias("holder"))
    # by (name, hash) first, so that few rows of a common hash meet its holder
    names = _merged(calm.withColumn("verdict", F.lit(KEPT)))
    quiet = names.join(firsts, "hash").withColumn("is_holder", F.col("name") == F.col("holder")).withColumn("aa", F.when(F.col("is_holder"), F.col("aa"))).select(*RESULT)

    loud = rows.join(in_conflict, "hash")
    order = loud.select("hash", "seq_no", "name", "row", n.alias("length"), (F.col("issues") != "").alias("has_issues"), "aa").repartition("hash").sortWithinPartitions("hash", "seq_no", "name", "aa")
    verdicts = stored(order.select("hash", "name", "row", "length", "has_issues").mapInPandas(_judge_sorted, "row long, verdict string, epoch long"))
    loud = loud.join(verdicts.where(F.col("verdict") != REJECTED), "row")
    last = loud.groupBy("hash").agg(F.max("epoch").alias("epoch"))
    return quiet.unionByName(_merged(loud.join(last, ["hash", "epoch"])))
