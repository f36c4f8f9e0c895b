"""Streams against the batch forms of the same operators."""

import random

import pytest
from pyspark.sql import functions as F

from cartograph.operators.updates import updated
from cartograph.streaming import events as stream
from cartograph.streaming import sequences


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    """The events in three files by time, some of them twice."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = rows.selectExpr("percentile_approx(ts, array(0.33, 0.66)) AS b").first()["b"]
    part = F.when(F.col("ts") < F.lit(bounds[0]), 0).when(F.col("ts") < F.lit(bounds[1]), 1).otherwise(2)
    for k in range(3):
        some = rows.where(part == k)
        some.union(some.where("event_id % 10 = 0")).coalesce(1).write.mode("append").parquet(path)
    return path, rows.schema, rows


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


@pytest.mark.parametrize("form", [stream.tumbling_counts, stream.sliding_counts, stream.sessions])
def test_closed_windows_equal_the_batch(spark, files, tmp_path, form):
    path, schema, rows = files
    first = stream.first_events(stream.read_events(spark, path, schema))
    got = run(spark, form(first, late=None), form.__name__, tmp_path)
    batch = form(rows)
    want = {tuple(r) for r in batch.collect()}
    rounded = lambda found: {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found}
    assert got and rounded(got) <= rounded(want)
    last = rows.agg(F.max("ts") - F.expr("INTERVAL 2 DAYS")).first()[0]
    at = batch.columns.index("begin")
    assert {r for r in rounded(want) if r[at] < last} <= rounded(got)  # all that are closed


def test_first_events_have_each_id_once(spark, files, tmp_path):
    path, schema, rows = files
    got = run(spark, stream.first_events(stream.read_events(spark, path, schema)).select("event_id"), "first_events", tmp_path)
    assert got == {tuple(r) for r in rows.select("event_id").collect()}
    assert stream.first_events(rows.union(rows)).count() == rows.count()


UPDATES = "seq_no long, name string, hash string, aa string, passage string, isolation_date string, issues string"


def plain_updates(rows):
    """The table after the rows, one at a time: {(hash, name): [sequence, passages, dates, first]} and the holders."""
    table, holders = {}, {}
    for seq_no, name, h, aa, passage, date, issues in sorted(tuple(x if k == 0 else x or "" for k, x in enumerate(r)) for r in rows):
        holder = holders.get(h)
        kept = holder is None or holder == name
        if not kept and len(aa) != len(table[h, holder][0]):
            if issues:
                continue
            table = {k: v for k, v in table.items() if k[0] != h}
            kept = True
        if kept:
            holders[h] = name
        entry = table.setdefault((h, name), [None, set(), set(), seq_no])
        entry[0] = aa if kept else entry[0]
        entry[1] |= {passage} - {""}
        entry[2] |= {date} if len(date) == 10 else set()
    return {(name, h, holders[h] == name, e[0], ",".join(sorted(e[1])), ",".join(sorted(e[2])), e[3]) for (h, name), e in table.items()}


def random_updates(r, n):
    return [(k, r.choice([None, "", "a", "b", "c", "d"]), r.choice(["h1", "h2", "h3", None, "h5"]), "ACGT"[: r.choice([2, 2, 3, 3, 4])] if r.random() < 0.9 else None, r.choice(["E1", "E2", "", None]), r.choice(["2020-01-01", "2020", None]), r.choice(["", "", "s"])) for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_updates_evict_as_one_row_at_a_time(spark, seed):
    rows = random_updates(random.Random(seed), 120)
    got = updated(spark.createDataFrame(rows, UPDATES)).collect()
    assert {tuple(x) for x in got} == plain_updates(rows) and len(got) == len({(x.name, x.hash) for x in got})


def test_updates_as_a_stream(spark, tmp_path):
    rows = random_updates(random.Random(9), 90)
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], UPDATES).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
    incoming = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # nothing new the second time
        sequences.update_sequences(incoming, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
    table = sequences.current(spark, f"{tmp_path}/table")
    want = plain_updates(rows)
    assert {tuple(x)[:7] for x in table.collect()} == want
    assert table.agg(F.max("epoch")).first()[0] > 0  # there were evictions
    sequences.compact(spark, f"{tmp_path}/table", f"{tmp_path}/less")
    assert {tuple(x)[:7] for x in sequences.current(spark, f"{tmp_path}/less").collect()} == want
