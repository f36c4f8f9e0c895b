"""A corpus pipeline of the operators in cartograph.llm: each stage's result is written as Parquet and read again by the next.

Stages, in order: toxic documents go; repeated runs of lines go; one document of
each near-duplicate group stays; sources are mixed to their target weights; the
mix is packed into sequences.

Every stage takes rows with null or repeated ids, null, empty and very long
texts, and columns of any further name, as they are: a null text is empty (it
has nothing toxic, no lines, and nothing to mix, so mixing leaves it out; null
and empty texts are near copies of each other, of which one stays), repeated
rows are near copies too, an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.llm import linededup, mixing, nearcopies, packing, toxicity
from cartograph.llm.common import cut, numbered, remove, scoped, shared_dir, table
from cartograph.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs; those that are nothing but such copies go."""
    out = linededup.line_dedup(docs)
    out = out.where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))))
    changed = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of the five-word shingles or more) one row stays, of the smallest doc_id (null last)."""
    rows = numbered(docs)  # ids may be null or repeated
    with scoped(spark):
        first = cut(nearcopies.firsts(rows), keep=True)
    return rows.join(first, "__uid", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights, as documents."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    return packing.best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages learn a model, chain matches and permute blocks: SQL can't express them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again, and what it was made from removed."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)  # its tables stay, as the result is read from them
        with scoped(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        if k:
            remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
