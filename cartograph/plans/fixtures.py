"""Inputs of the registered queries, derived from the star-schema tables by integer arithmetic.

The same SQL text runs on Spark and on the SQL oracle.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Antigens and sera of one chart, for the queries that search maps of one.
N_ANTIGENS, N_SERA = 120, 30
#: Points of sera follow those of antigens at this number in the tables that grow with the data.
SERA_FROM = 1_000_000

_LAYERS = """
SELECT antigen_no, serum_no, layer_no, pfx, v, concat(pfx, CAST(v AS STRING)) AS titer FROM (
  SELECT antigen_no, serum_no, layer_no,
    CASE WHEN (antigen_no + serum_no) % 11 = 0 AND q % 2 = 0 THEN '<'
         WHEN (antigen_no + serum_no) % 13 = 0 AND q % 3 = 0 THEN '>'
         WHEN q % 29 = 0 THEN '<' WHEN q % 31 = 0 THEN '>' ELSE '' END AS pfx,
    CAST(pow(2, (antigen_no * 5 + serum_no * 3) % 6
         + CASE WHEN q % 17 = 0 THEN 4 WHEN q % 5 = 0 THEN 1 ELSE 0 END) AS INT) * 10 AS v
  FROM (SELECT CAST(l_partkey % 120 + {chart} * 120 AS INT) AS antigen_no, CAST(l_suppkey % 30 + {chart} * 30 AS INT) AS serum_no,
          CAST(l_linenumber - 1 AS INT) AS layer_no, CAST(min(l_quantity) AS INT) AS q FROM lineitem GROUP BY 1, 2, 3) t
  WHERE (antigen_no * 31 + serum_no * 17 + layer_no * 7) % 3 = 0) w
"""
#: A table of 120 antigens and 30 sera for each 6,000 orders, side by side.
TITER_LAYERS = _LAYERS.format(chart="CAST(floor(l_orderkey / 6000) AS INT)")
#: All titers folded to one chart.
CHART_LAYERS = _LAYERS.format(chart="0")

_PLACE = """CAST((p_partkey * 37 + p_size * 11) % 97 AS DOUBLE) / 16 AS x, CAST((p_partkey * 53 + p_size * 7) % 89 AS DOUBLE) / 16 AS y"""
#: A point for every part as an antigen and as a serum.
LAYOUT = f"""
SELECT CAST(p_partkey AS INT) AS point_no, {_PLACE} FROM part
UNION ALL SELECT CAST(p_partkey - 1 + {SERA_FROM} AS INT), y + 0.25, x + 0.5 FROM (SELECT p_partkey, {_PLACE} FROM part) s
"""
#: What a serum's point has more in the layout with a number for each point: antigens of large tables have numbers of sera too.
APART = 3 << 40
#: The layout's points, no two under one number; numbers modulo APART are the layout's.
LAYOUT_APART = f"""
SELECT CAST(p_partkey AS BIGINT) AS point_no, {_PLACE} FROM part
UNION ALL SELECT CAST(p_partkey - 1 + {SERA_FROM} + {APART} AS BIGINT), y + 0.25, x + 0.5 FROM (SELECT p_partkey, {_PLACE} FROM part) s
"""
#: The points of one chart.
CHART_LAYOUT = f"SELECT CAST(p_partkey AS INT) AS point_no, {_PLACE} FROM part WHERE p_partkey < 150"

SEQS = """
SELECT CAST(doc_id AS INT) AS seq_no, CAST(doc_id % 12 AS INT) AS cluster_no, lang AS lineage, source AS country,
  concat('20', CAST(10 + doc_id % 15 AS STRING), '-', CASE WHEN doc_id % 12 < 9 THEN '0' ELSE '' END,
         CAST(1 + doc_id % 12 AS STRING), '-01') AS isolation_date,
  concat(substr(base, 1, k - 1), substr(alt, k, 2), substr(base, k + 2)) AS aa,
  md5(concat(substr(base, 1, k - 1), substr(alt, k, 2), substr(base, k + 2))) AS hash,
  CASE WHEN doc_id % 17 = 0 THEN 's' WHEN doc_id % 23 = 0 THEN 'sX' ELSE '' END AS issues,
  concat('A/', upper(lang), '/', CAST(doc_id % 400 AS STRING), '/', CAST(2010 + doc_id % 15 AS STRING)) AS name,
  CASE WHEN doc_id % 5 = 0 THEN 'E4' WHEN doc_id % 5 = 1 THEN 'MDCK2/SIAT1' WHEN doc_id % 5 = 2 THEN 'SIAT2' WHEN doc_id % 5 = 3 THEN 'OR' ELSE 'E2/E1' END AS passage,
  CASE WHEN doc_id % 7 = 0 THEN 'NYMC-7' ELSE '' END AS reassortant
FROM (SELECT doc_id, lang, source, CAST(1 + doc_id % 30 AS INT) AS k,
    translate(md5(CAST(doc_id % 12 AS STRING)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS base,
    translate(md5(CAST(doc_id % 50 AS STRING)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS alt
  FROM documents) b
"""

CLADE_RULES = """
SELECT concat('C', CAST(cluster_no AS STRING)) AS clade, 5 AS pos, substr(base, 5, 1) AS letter, true AS eq FROM (
  SELECT cluster_no, translate(md5(CAST(cluster_no AS STRING)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS base
  FROM (SELECT DISTINCT CAST(doc_id % 12 AS INT) AS cluster_no FROM documents WHERE doc_id % 12 < 6) c) m
UNION ALL
SELECT concat('C', CAST(cluster_no AS STRING)), 9, substr(base, 9, 1), true FROM (
  SELECT cluster_no, translate(md5(CAST(cluster_no AS STRING)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS base
  FROM (SELECT DISTINCT CAST(doc_id % 12 AS INT) AS cluster_no FROM documents WHERE doc_id % 12 < 6) c) m
"""

NODES = """
SELECT CAST(0 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS child_order, false AS is_leaf,
       'root' AS name, CAST(0 AS DOUBLE) AS edge
UNION ALL
SELECT CAST(-1 - r_regionkey AS BIGINT), CAST(0 AS BIGINT), CAST(r_regionkey AS INT), false, r_name,
       CAST(r_regionkey * 7 % 13 + 1 AS DOUBLE) / 64 FROM region
UNION ALL
SELECT CAST(-100 - n_nationkey AS BIGINT), CAST(-1 - n_regionkey AS BIGINT), CAST(n_nationkey AS INT), false, n_name,
       CAST(n_nationkey * 11 % 17 + 1 AS DOUBLE) / 64 FROM nation
UNION ALL
SELECT CAST(-1000 - c_custkey AS BIGINT), CAST(-100 - c_nationkey AS BIGINT), CAST(c_custkey AS INT), false, concat('only ', c_name), CAST(0.125 AS DOUBLE)
FROM customer WHERE c_custkey % 50 = 0
UNION ALL
SELECT CAST(c_custkey + 1 AS BIGINT), CAST(CASE WHEN c_custkey % 50 = 0 THEN -1000 - c_custkey ELSE -100 - c_nationkey END AS BIGINT), CAST(c_custkey AS INT), true, c_name,
       CAST(c_custkey * 5 % 29 + 1 AS DOUBLE) / 64 FROM customer
"""

_AMINO = "translate(md5({0}), '0123456789abcdef', 'ACDEFGHIKLMNPQRS')"


def _block(k: int) -> str:
    """32 letters: those of the cluster with one of the document's own."""
    own, at = _AMINO.format(f"concat(CAST(doc_id AS STRING), '/{k}')"), f"CAST(1 + (doc_id * {2 * k + 3} + {k}) % 31 AS INT)"
    base = _AMINO.format(f"concat(CAST(doc_id % 12 AS STRING), '-{k}')")
    return f"concat(substr({base}, 1, {at} - 1), substr({own}, {at}, 1), substr({base}, {at} + 1))"


#: Sequences of 256 letters, all but a few different, in twelve clusters of relatives.
LONG_SEQS = f"""
SELECT CAST(doc_id AS BIGINT) AS seq_no, concat({", ".join(_block(k) for k in range(8))}) AS aa FROM documents
"""

#: A tree over all documents: chains of five nodes that branch in two; every sixth node and some leaves have a sequence.
DEEP_NODES = f"""
SELECT node_id, parent_id, CAST(node_id % 7 AS INT) AS child_order, is_leaf, edge, concat('n', CAST(node_id AS STRING)) AS name, CASE WHEN node_id % 6 = 0 OR (is_leaf AND node_id % 4 = 0) THEN aa END AS aa
FROM (SELECT CAST(doc_id AS BIGINT) AS node_id, CASE WHEN doc_id = 0 THEN NULL WHEN doc_id % 5 = 0 THEN CAST(floor(doc_id / 10) AS BIGINT) ELSE doc_id - 1 END AS parent_id,
  doc_id % 5 = 4 AND doc_id * 10 > last AS is_leaf, CAST(doc_id % 29 + 1 AS DOUBLE) / 64 AS edge, concat({", ".join(_block(k) for k in range(8))}) AS aa
  FROM (SELECT doc_id, (SELECT max(doc_id) FROM documents) AS last FROM documents) m) t
"""

#: Antigens of two charts: names repeat, so that matches are many to many.
ANTIGENS = """
SELECT CAST(p_partkey AS INT) AS antigen_no, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS chart_id, p_name AS name,
  CASE WHEN p_partkey % 9 = 0 THEN 'NYMC-9' ELSE '' END AS reassortant,
  CASE WHEN p_partkey % 11 = 0 THEN 'DISTINCT' WHEN p_partkey % 6 = 0 THEN 'NEW' ELSE '' END AS annotations,
  CASE WHEN p_size % 3 = 0 THEN concat('E', CAST(p_size % 5 AS STRING)) WHEN p_size % 3 = 1 THEN concat('MDCK', CAST(p_size % 4 AS STRING)) ELSE concat('SIAT', CAST(p_size % 3 AS STRING)) END AS passage,
  concat('20', CAST(10 + p_size % 12 AS STRING), '-0', CAST(1 + p_size % 9 AS STRING), '-1', CAST(p_size % 10 AS STRING)) AS date,
  CASE WHEN p_size % 4 = 0 THEN 'V' WHEN p_size % 4 = 1 THEN 'Y' ELSE '' END AS lineage
FROM part
"""

SERA = """
SELECT CAST(s_suppkey AS INT) AS serum_no, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS chart_id, p_name AS name,
  CASE WHEN p_partkey % 9 = 0 THEN 'NYMC-9' ELSE '' END AS reassortant,
  CASE WHEN p_partkey % 6 = 0 THEN 'NEW' WHEN p_partkey % 5 = 0 THEN 'CONC 2:1' ELSE '' END AS annotations,
  CASE WHEN p_size % 2 = 0 THEN 'E3' ELSE 'MDCK1' END AS passage, concat('S', CAST(s_suppkey AS STRING)) AS serum_id
FROM supplier JOIN part ON p_partkey = s_suppkey
"""

VIEWS = {"titer_layers": TITER_LAYERS, "layout": LAYOUT, "layout_apart": LAYOUT_APART, "chart_layers": CHART_LAYERS, "chart_layout": CHART_LAYOUT, "seqs": SEQS, "clade_rules": CLADE_RULES, "nodes": NODES, "long_seqs": LONG_SEQS, "deep_nodes": DEEP_NODES, "antigens": ANTIGENS, "sera": SERA}
TABLES = {"titer_layers": "lineitem", "layout": "part", "layout_apart": "part", "chart_layers": "lineitem", "chart_layout": "part", "seqs": "documents", "clade_rules": "documents", "nodes": "region nation customer", "long_seqs": "documents", "deep_nodes": "documents", "antigens": "part", "sera": "supplier part"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame (nothing is registered in the session)."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name].split()}
    sql = VIEWS[name]
    for t in tables:
        for word in ("FROM ", "JOIN "):
            sql = sql.replace(f"{word}{t} ", f"{word}{{{t}}} ").replace(f"{word}{t}\n", f"{word}{{{t}}}\n").replace(f"{word}{t})", f"{word}{{{t}}})")
    return spark.sql(sql, **tables)


def layout_number(column: str) -> Column:
    """The layout's number of a point of layout_apart."""
    return (F.col(column) % APART).cast("int")


@cache
def with_views(sql: str, *names: str) -> str:
    """SQL for the oracle: the named inputs as common table expressions before a query (which may begin with more of them)."""
    head = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    sql = sql.strip()
    return f"WITH {head}{',' if sql.startswith('+') else ''}\n{sql.removeprefix('+')}"
