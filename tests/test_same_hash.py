"""Classes of equal hashes against the pairs that they stand for, and on sequences without a number or a hash."""

import collections

import duckdb

from cartograph.operators import sequences
from cartograph.plans import fixtures, registered


def test_classes_are_all_pairs(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    pairs = con.execute(fixtures.with_views(" SELECT a.seq_no, b.seq_no AS other_no FROM seqs a JOIN seqs b ON a.hash = b.hash", "seqs")).fetchall()
    rows = registered.QUERIES["j2_find_all_by_hash"](spark, sf_dir).collect()
    members = collections.defaultdict(list)
    for r in rows:
        members[r.class_no].append(r.seq_no)
    assert len(pairs) > len(rows) and sum(r.n for r in rows) == len(pairs)
    assert sorted((a, b) for m in members.values() for a in m for b in m) == sorted(pairs)


def test_documents_without_an_id(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("CASE WHEN doc_id NOT IN (3, 8) THEN CASE WHEN doc_id = 5 THEN 0 ELSE doc_id END END AS doc_id", "lang", "source", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registered.SQL["j2_find_all_by_hash"]).fetchall()
    got = [tuple(r) for r in registered.QUERIES["j2_find_all_by_hash"](spark, str(tmp_path)).collect()]
    assert len(got) == docs.count() and collections.Counter(got) == collections.Counter(want)


def test_sequences_without_a_hash(spark):
    rows = [(4, "a", "x"), (2, "a", "y"), (7, None, "z"), (5, None, "z"), (None, "b", "z"), (9, "", "z")]
    found = sequences.same_hash(spark.createDataFrame(rows, "seq_no int, hash string, name string"))
    assert sorted(found.columns) == ["class_no", "hash", "n", "name", "seq_no"]
    got = sorted((tuple(r) for r in found.select("seq_no", "class_no", "n", "name").collect()), key=str)
    assert got == [(2, 2, 2, "y"), (4, 2, 2, "x"), (5, 5, 2, "z"), (7, 5, 2, "z"), (9, 9, 1, "z"), (None, None, 1, "z")]


def test_pairs_are_whole(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    pairs = con.execute(fixtures.with_views(" SELECT a.seq_no, b.seq_no AS other_no FROM seqs a JOIN seqs b ON a.hash = b.hash", "seqs")).fetchall()
    found = registered.QUERIES["j2_pairs_by_hash"](spark, sf_dir).select("seq_no", "other_no").collect()
    assert len(pairs) > 200 and sorted(map(tuple, found)) == sorted(pairs)
