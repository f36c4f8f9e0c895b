"""Every registered query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from cartograph.plans import registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, str | bool):
            return v
        return None if isinstance(v, float) and math.isnan(v) else f"{float(v) + 0.0:.6g}" if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, oracle, sf_dir, name):
    df = registered.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name in registered.SQL:
        found = oracle.execute(registered.SQL[name])
        names = [d[0] for d in found.description]
        want = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
        assert sorted(names) == cols
        assert plain(got) == plain(want)
