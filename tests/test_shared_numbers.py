"""Queries over points against their SQL where there are so many parts that antigens have numbers of sera."""

import duckdb
import pytest
from test_registered import plain

from cartograph.plans import registered

QUERIES = ["a12_too_few_titers", "mg2_overlay_type3", "mg2_overlay_type5", "pr1_procrustes", "pr3_summary", "st5_gradient"]


@pytest.fixture(scope="module")
def many_parts(spark, sf_dir, tmp_path_factory):
    """All parts once more, up from a number below the first serum's."""
    path = tmp_path_factory.mktemp("many")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.unionByName(part.selectExpr("p_partkey + 999990 AS p_partkey", *(c for c in part.columns if c != "p_partkey"))).write.parquet(f"{path}/part.parquet")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, many_parts, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{many_parts}/{t}.parquet/*.parquet'")
    df = registered.QUERIES[name](spark, many_parts)
    cols = sorted(df.columns)
    found = con.execute(registered.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert plain([tuple(r[c] for c in cols) for r in df.collect()]) == plain([tuple(r[names.index(c)] for c in cols) for r in found.fetchall()])
