"""Mixing sources to target weights by blocks of tokens (operator 9), with DataFrame functions only.

The words of a source, its documents in a fixed order, form one stream that is
cut into blocks of ``block_words``.  The mix is made of slots.  Each output
shard draws the sources of its slots, so its source counts are multinomial;
afterwards the draws beyond a source's number of slots are dropped and missing
ones dealt out, so that the totals hold.  A source's slots are numbered over all
shards and a pseudorandom permutation of its block indices (one for each pass
over the source) says which block a slot gets; slots and blocks are then joined
by index.  The permutation is the swap-or-not shuffle: a composition of keyed
involutions that permutes any range and needs no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, numbered, scoped, text_or_empty

#: Weights by a source's place in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words.
TOTAL = 1.5
#: A source gives at most so many times its words.
MOST = 2
BLOCK_WORDS = 2048
#: Slots of an output shard.
SHARD_SLOTS = 1024
#: Documents that one task numbers together.
BUCKET_ROWS = 4_000
#: Numbers that one row is counted off to at a time.
STEP = 1 << 14
ROUNDS = 24
SEED = 20_2611


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h (hash of doc_id and text) and uid, a number for each row, so that repeated rows stay apart."""
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text_or_empty()).alias("size"), F.col("__uid").alias("uid"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """One row a source: source, source_no, source_size, n_docs, target.

    target = min(most * size, level * weight): filling sources by weight up to
    their limits.  The level follows from the order in which limits are met.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    every = Window.partitionBy()  # one row a source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("source_no", F.row_number().over(order) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("source_no", F.lit(len(weights))).cast("int") + 1).cast("double"))
    by = by.withColumn("limit", (most * F.col("source_size")).cast("double")).withColumn("all", F.sum("source_size").over(every) * F.lit(float(total)))
    met = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before, after = met.rowsBetween(Window.unboundedPreceding, -1), met.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    by = by.withColumn("met", F.row_number().over(met))
    level = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("met"))).over(every)
    by = by.withColumn("target", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))))
    return by.select("source", "source_no", "source_size", "n_docs", "target")


def shuffled(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The place of index in a pseudorandom permutation of 0..n-1: swap-or-not, from the first round to the last."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        top = F.greatest(x, other)
        return F.when(F.xxhash64(key, r, top).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index.cast("long"), swap)


def streamed(sizes: DataFrame, by: DataFrame) -> DataFrame:
    """Adds source_no, source_size, target and first: where a document's words begin in its source's stream.

    Sums by (source, bucket of documents) give each bucket's first word; no task
    holds a whole source.  A bucket follows from doc_id and text, so the rows
    without an id, or of one id, are in many; reruns agree.
    """
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("long")
    small = by.select(F.col("source").alias("named"), "source_no", "source_size", "target", buckets.alias("buckets"))
    rows = sizes.join(small, sizes.source.eqNullSafe(small.named)).drop("named")
    rows = rows.withColumn("bucket", F.pmod("h", "buckets")).drop("buckets")
    within = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size", "h", "uid").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_first"))
    rows = rows.withColumn("first", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(firsts.hint("merge"), ["source_no", "bucket"]).withColumn("first", F.col("first") + F.col("bucket_first")).drop("bucket", "bucket_first", "h")


def counted_off(rows: DataFrame, name: str, first: Column, n: Column) -> DataFrame:
    """rows with name: first, first + 1, ... for n numbers.  One row becomes rows of STEP numbers, these are dealt over tasks and become one for each."""
    steps = rows.withColumn("__first", first.cast("long")).withColumn("__n", n.cast("long")).where("__n > 0")
    steps = steps.withColumn("__step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / STEP))))
    dealt = steps.repartition(F.xxhash64(*rows.columns, "__step"))
    last = F.least(F.col("__n"), (F.col("__step") + 1) * STEP) - 1
    return dealt.withColumn(name, F.explode(F.sequence(F.col("__first") + F.col("__step") * STEP, F.col("__first") + last))).drop("__first", "__n", "__step")


def slots(by: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """source_no, pass, block, slot, shard, words: the slots of the mix and how many words each takes of its block.

    Pass p of a source takes up to its size in words; its last block, if shorter,
    keeps the last index, so a slot's words follow from its number alone.
    """
    by = by.where(F.col("target") >= 0.5).withColumn("want", F.round("target").cast("long"))
    full = F.floor(F.col("source_size") / block_words)
    passes = by.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))).withColumn("want", F.least(F.col("source_size"), F.col("want") - F.col("pass") * F.col("source_size")))
    passes = passes.where(F.col("want") > 0).withColumn("n", F.ceil(F.col("want") / block_words)).withColumn("full", full)
    numbered = passes.withColumn("from", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    needed = counted_off(numbered.select("source_no", "source_size", "pass", "want", "full", "from", "n"), "k", F.lit(0), F.col("n"))
    j = F.col("k")
    block = F.when(j < F.col("full"), shuffled(j, F.col("full"), F.xxhash64(F.lit(seed), "source_no", "pass"))).otherwise(j)
    words = F.least(F.lit(block_words).cast("long"), F.col("want") - j * block_words)
    needed = needed.select("source_no", "pass", block.alias("block"), (F.col("from") + j).alias("slot"), words.alias("words"))
    return needed.join(dealt_slots(by, block_words, shard_slots, seed).hint("merge"), ["source_no", "slot"])


def dealt_slots(by: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """source_no, slot, shard: multinomial draws of each shard, settled so that a source has the slots that it needs.

    Draws are numbered within a source by (shard, number of the draw).  Those
    beyond the source's need are dropped; the slots that no draw has are dealt
    over all shards in turn.
    """
    one_pass = lambda p: F.greatest(F.lit(0), F.ceil(F.least(F.col("source_size"), F.round("target") - p * F.col("source_size")) / block_words))
    need = by.withColumn("need", sum(one_pass(p) for p in range(MOST)).cast("long"))
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    need = need.withColumn("upto", F.sum("need").over(upto)).withColumn("all", F.sum("need").over(Window.partitionBy()))
    need = need.select("source_no", "need", (F.col("upto") - F.col("need")).alias("low"), "upto", "all")
    shards = need.agg(F.max("all").alias("all")).select("all", F.greatest(F.lit(1), F.ceil(F.col("all") / shard_slots)).cast("long").alias("shards"))
    drawn = counted_off(shards.where(F.col("all") > 0), "shard", F.lit(0), F.col("shards"))
    drawn = drawn.select("all", "shard", F.explode(F.sequence(F.lit(0), F.lit(shard_slots - 1))).alias("draw"))
    drawn = drawn.where(F.col("shard") * shard_slots + F.col("draw") < F.col("all")).withColumn("u", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", "draw"), "all"))
    sources = need.where(F.col("need") > 0)
    # draws meet sources by bins of draws, about as many as there are sources, each of which lies in few
    width = F.greatest(F.lit(1), F.ceil(F.col("all") / F.col("n")))
    binned = sources.withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("width", width)
    binned = binned.select("source_no", "low", "upto", "need", F.explode(F.sequence(F.floor(F.col("low") / F.col("width")), F.floor((F.col("upto") - 1) / F.col("width")))).alias("bin"))
    drawn = drawn.crossJoin(F.broadcast(sources.agg(F.greatest(F.lit(1), F.ceil(F.max("all") / F.count("*"))).alias("width")))).withColumn("bin", F.floor(F.col("u") / F.col("width")))  # one row
    counts = drawn.join(binned, "bin").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("upto"))).groupBy("source_no", "shard").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    ends = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    kept = counts.withColumn("to", F.least("need", F.sum("n").over(ends))).withColumn("from", F.least("need", F.sum("n").over(ends) - F.col("n"))).where(F.col("to") > F.col("from"))
    own = kept.select("source_no", "shard", F.explode(F.sequence("from", F.col("to") - 1)).alias("slot"))
    had = kept.groupBy("source_no").agg(F.max("to").alias("had"))
    short = sources.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0))).where(F.col("had") < F.col("need")).crossJoin(F.broadcast(shards.select("shards")))  # one row
    rest = counted_off(short.select("source_no", "shards", "had", "need"), "slot", F.col("had"), F.col("need") - F.col("had")).select("source_no", F.pmod("slot", "shards").alias("shard"), "slot")
    return own.unionByName(rest)


def taken_parts(rows: DataFrame, by: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Each document's words that the mix takes, block by block: the rows of ``rows`` with pass, shard, slot, begin, end (words of the document)."""
    a, b = F.col("first"), F.col("first") + F.col("size")
    blocks = rows.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(a / block_words), F.floor((b - 1) / block_words))))
    joined = blocks.join(slots(by, block_words, seed=seed).hint("merge"), ["source_no", "block"])  # by hash at every size
    start = F.col("block") * block_words
    begin, end = F.greatest(a, start) - a, F.least(b, start + F.col("words")) - a
    return joined.withColumn("begin", begin).withColumn("end", end).where(F.col("end") > F.col("begin")).drop("block", "words")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_parts, shard, slot: what the mix takes of every document, in how many parts, and the first place of these: output shard and slot of the source, as drawn (null where nothing is taken).

    Null texts have no words and nothing is taken of them; a null source is a
    source, the last; repeated rows are documents of their own; an empty table
    gives no rows.
    """
    with scoped(docs.sparkSession):
        sizes = cut(sized(docs.withColumn("__uid", F.monotonically_increasing_id())))  # the rows themselves are not needed again
        by = cut(targets(sizes), keep=True)
        rows = cut(streamed(sizes, by), keep=True)
    taken = taken_parts(rows.select("uid", "source_no", "first", "size"), by, block_words, seed).groupBy("uid").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"), F.count("*").alias("n_parts"), F.min(F.struct("shard", "slot")).alias("place"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(taken.hint("merge"), "uid", "left").select("doc_id", "size", "source_size", "target", none("taken"), none("n_parts"), "place.shard", "place.slot")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, with the columns of docs.

    A document that a pass takes whole keeps its text; else its text is the taken
    words joined by one space.  Documents without words have nothing to mix and
    are left out; n_chars, if there, is set anew for cut texts.
    """
    rows_of = numbered(docs)
    with scoped(docs.sparkSession):
        sizes = cut(sized(rows_of))
        by = cut(targets(sizes))
        rows = streamed(sizes, by)
        parts = taken_parts(rows.select("uid", "source_no", "first", "size"), by, block_words, seed)
        spans = parts.groupBy("uid", "pass").agg(F.first("size").alias("size"), F.sum(F.col("end") - F.col("begin")).alias("n"), F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
        spans = cut(spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pass", "size", "n", "spans"))).alias("__takes")).withColumnRenamed("uid", "__uid"), keep=True)
    joined = rows_of.join(spans.hint("shuffle_hash"), "__uid").withColumn("__take", F.explode("__takes"))
    words = F.filter(F.split(F.col("text").cast("string"), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    whole = F.col("__take.n") == F.col("__take.size")
    some = F.array_join(F.flatten(F.transform(F.col("__take.spans"), lambda s: F.slice(words, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), " ")
    out = joined.withColumn("text", F.when(whole, F.col("text").cast("string")).otherwise(some))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*docs.columns)
