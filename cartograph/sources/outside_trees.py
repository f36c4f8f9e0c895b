"""Clade tables from other programs' tree documents: nested JSON as VARIANT, taken apart by a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

_NODES = """
WITH RECURSIVE n (tree_id, node) AS (
  SELECT tree_id, try_variant_get(doc, '$.tree', 'variant') FROM {docs}
  UNION ALL
  SELECT n.tree_id, c.value FROM n, LATERAL variant_explode(try_variant_get(n.node, '$.children', 'variant')) c
)
SELECT tree_id, try_variant_get(node, '$.branch_attrs.labels.clade', 'string') AS clade,
  try_variant_get(node, '$.branch_attrs.mutations.HA1', 'array<string>') AS ha1,
  try_variant_get(node, '$.branch_attrs.mutations.HA2', 'array<string>') AS ha2,
  try_variant_get(node, '$.branch_attrs.mutations.nuc', 'array<string>') AS nuc
FROM n WHERE try_variant_get(node, '$.branch_attrs.labels.clade', 'string') <> ''
"""
_LIMITS = ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")


def read(spark: SparkSession, path: str) -> DataFrame:
    """tree_id, doc: a document a file, which is one value of Spark and so limited in size."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("tree_id"), F.parse_json("value").alias("doc"))


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """One row, ha1_offset and ha2_offset: nucleotides before the two parts, from a gene map (GFF)."""
    rows = spark.read.schema("seqid string, source string, type string, start long, stop long, score string, strand string, phase string, attributes string").option("sep", "\t").option("comment", "#").csv(path)
    of = lambda part: F.coalesce(F.max(F.when(F.contains("attributes", F.lit(part)), F.col("start") - 1)), F.lit(0))
    return rows.agg(of("HA1").alias("ha1_offset"), of("HA2").alias("ha2_offset"))


def clade_table(docs: DataFrame, ha1_offset: int, ha2_offset: int) -> DataFrame:
    """tree_id, clade, aa, nuc: of every node with a clade its amino acids as 160T, those of the second part numbered on, and its nucleotides from the first part on.

    aa is null where no amino acid changes, nuc where none are told.
    """
    spark = docs.sparkSession
    before = {k: spark.conf.get(k) for k in _LIMITS}
    for k in _LIMITS:
        spark.conf.set(k, "-1")  # a tree may be as deep and as large as its document
    try:
        nodes = stored(spark.sql(_NODES, docs=docs))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    number, letter = lambda m: F.substring(m, F.lit(2), F.length(m) - 2).cast("long"), lambda m: F.right(m, F.lit(1))
    further = (ha2_offset - ha1_offset) // 3
    none = F.array().cast("array<string>")
    first = F.transform(F.coalesce("ha1", none), lambda m: F.substring(m, F.lit(2), F.length(m)))
    second = F.transform(F.coalesce("ha2", none), lambda m: F.concat((number(m) + further).cast("string"), letter(m)))
    aa = F.concat(first, second)
    placed = F.transform("nuc", lambda m: F.struct((number(m) - ha1_offset).alias("pos"), letter(m).alias("letter")))
    nuc = F.transform(F.filter(placed, lambda p: p["pos"] > 0), lambda p: F.concat(p["pos"].cast("string"), p["letter"]))
    return nodes.select("tree_id", "clade", F.when(F.size(aa) > 0, aa).alias("aa"), F.when(F.size("nuc") > 0, nuc).alias("nuc"))
