"""Line deduplication by winnowing (operator 10), with DataFrame functions only.

A gram is the shortest run of lines, from a line on, with GRAM_WORDS words; its
hash is taken over the hashes of those lines.  A window is the grams that lie in
the first RUN_WORDS words from a line on; the least hash of every window is
selected.  Windows follow from the lines in them alone, so a run of RUN_WORDS or
more words that two places share has a selected gram at the same line in both:
selected grams are guaranteed fingerprints.  They are joined by hash, and those
that only one place has are left.  Each match is then extended both ways, to the
shortest runs of RUN_WORDS words that hold it, from each line on and up to each
line; every one of these runs that has an equal one at an earlier place is
deleted.  Together they cover every repeated run of RUN_WORDS words or more, and
nothing else: a line goes if and only if it lies in such a run.

Places of a hash are never paired with each other, only with the first of them;
common hashes, of which there are few, are told to every task, so that a passage
that all documents share stays where it is; all else is linear in a document's
lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, numbered, scoped

GRAM_WORDS = 25
RUN_WORDS = 50
#: A hash is common from this share of all places on, if it has COMMON_ROWS: so there are no more common hashes than this.
MOST_COMMON = 10_000
COMMON_ROWS = 1_000


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """__uid, doc_id and lines: hash and number of words of every line that has a word."""
    each = F.transform(lines_of(F.col("text").cast("string")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return docs.select("__uid", F.col("doc_id").cast("long").alias("doc_id"), each.alias("lines"))


def _by_line(hashed: DataFrame) -> DataFrame:
    rows = hashed.select("__uid", "doc_id", F.posexplode("lines").alias("pos", "line"))
    return rows.select("__uid", "doc_id", "pos", "line.h", F.col("line.n").cast("long").alias("n"))


def selected(hashed: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """__uid, doc_id, pos, n (words of the line there), last (the gram's last line), gram: the selected grams of every document."""
    doc = Window.partitionBy("__uid").orderBy("pos")
    rows = _by_line(hashed)
    rows = rows.withColumn("c", F.sum("n").over(doc.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))  # words before the line
    on = Window.partitionBy("__uid").orderBy("c")
    lines = on.rangeBetween(0, gram_words - 1)
    rows = rows.withColumn("end", F.max(F.col("c") + F.col("n")).over(on.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("last", (F.col("pos") + F.count("h").over(lines) - 1).cast("int"))
    rows = rows.withColumn("gram", F.when(F.col("end") - F.col("c") >= gram_words, F.xxhash64(F.collect_list("h").over(lines))))
    spare = run_words - gram_words
    least = F.when(F.col("end") - F.col("c") >= run_words, F.min("gram").over(on.rangeBetween(0, spare)))
    best = F.max("least").over(on.rangeBetween(-spare, 0))  # none is greater than the gram itself
    rows = rows.withColumn("least", least).withColumn("best", best).where(F.col("gram") == F.col("best"))
    return rows.select("__uid", "doc_id", "pos", "n", "last", "gram")


def joined_by_hash(rows: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """Inner join of stored rows with one row for each key, which says how many times rows have it.

    Those of common keys, MOST_COMMON at most, are broadcast; every other key has
    few rows, which meet in one task.
    """
    few = cut(few)
    most = max(COMMON_ROWS, (few.agg(F.sum("times")).first()[0] or 0) // MOST_COMMON)
    common = F.broadcast(few.where(F.col("times") > most))
    rare = rows.join(common, [*keys], "left_anti").hint("merge").join(few.where(F.col("times") <= most), [*keys])
    return rows.join(common, [*keys]).unionByName(rare).drop("times")


def extended(hashed: DataFrame, matches: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """__uid, doc_id, a, b (first and last line), words, run (hash): the shortest runs of run_words words, from a line on or up to one, that hold a match.

    matches: __uid, doc_id, pos, n, last of grams.  They are laid before the line
    that they begin at, without words of their own, so that the frame of a run
    holds those that begin in it; the first of them ends first.
    """
    lines = _by_line(hashed).select("__uid", "doc_id", "pos", F.lit(1).alias("kind"), "h", "n", F.col("n").alias("own"), F.lit(None).cast("int").alias("last"))
    marks = matches.select("__uid", "doc_id", "pos", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("h"), "n", F.lit(0).cast("long").alias("own"), "last")
    doc = Window.partitionBy("__uid").orderBy("pos", "kind")
    rows = lines.unionByName(marks)
    rows = rows.withColumn("c", F.sum("own").over(doc.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own"))
    rows = rows.withColumn("e", F.col("c") + F.col("n"))  # words before the line, and up to its end
    onward = Window.partitionBy("__uid").orderBy("c").rangeBetween(0, run_words - 1)
    back = Window.partitionBy("__uid").orderBy("e").rangeBetween(1 - run_words, 0)
    rows = rows.withColumns({"ahead": F.collect_list("h").over(onward), "end": F.max("e").over(onward), "first": F.min("last").over(onward)})
    rows = rows.withColumns({"behind": F.collect_list("h").over(back), "begin": F.min("c").over(back), "first_back": F.min("last").over(back)}).where("kind = 1")
    run = lambda whole, lines, a, b, words: F.when(whole, F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), words.alias("words"), F.xxhash64(lines).alias("run")))
    pos, to, since = F.col("pos"), F.col("pos") + F.size("ahead") - 1, F.col("pos") - F.size("behind") + 1
    on = run((F.col("end") - F.col("c") >= run_words) & (F.col("first") <= to), "ahead", pos, to, F.col("end") - F.col("c"))
    # one that is also the shortest from its first line on has been found there
    up = run((F.col("c") - F.col("begin") >= run_words) & (F.col("first_back") <= pos), "behind", since, pos, F.col("e") - F.col("begin"))
    return rows.select("__uid", "doc_id", F.explode(F.array_compact(F.array(on, up))).alias("w")).select("__uid", "doc_id", "w.*")


def repeated_runs(hashed: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """__uid, runs (first and last line, from 0 among lines with a word; in order, apart from each other): what to delete."""
    marks = cut(selected(hashed, gram_words, run_words))
    matches = cut(joined_by_hash(marks, marks.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1"), "gram").drop("gram"))
    needed = hashed.hint("shuffle_hash").join(matches.select("__uid").distinct(), "__uid", "left_semi")
    runs = cut(extended(needed, matches, run_words))
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "__uid", "a")
    first = runs.groupBy("run", "words").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = joined_by_hash(runs, first, "run", "words").where((F.col("__uid") != F.col("first.__uid")) | (F.col("a") != F.col("first.a")))
    order = Window.partitionBy("__uid").orderBy("a", "b")
    island = F.sum(F.when(F.col("a") > F.coalesce(F.col("upto"), F.lit(-1)), 1).otherwise(0)).over(order)
    merged = later.select("__uid", "a", "b").withColumn("upto", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("island", island)
    merged = merged.groupBy("__uid", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("__uid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def line_dedup(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with text cleaned, and n_lines, n_removed (lines with a word, before and removed).

    Places are ordered by doc_id (null last), row and line.  Where nothing is
    removed the text stays as it is; else the lines with a word that stay are
    joined by a line feed (lines without a word go with the change).  A line is
    removed if it lies in a run of run_words words or more (whole lines) that an
    earlier place has too; one copy of each line stays.
    Null texts stay null, repeated rows are documents of their own, input columns
    named n_lines or n_removed are replaced, an empty table gives none.
    """
    rows = numbered(docs)
    with scoped(docs.sparkSession):
        runs = cut(repeated_runs(cut(hashed_lines(rows)), gram_words, run_words), keep=True)
    # by hash of the narrow side at every size: a broadcast would stop being possible as runs grow with the input
    joined = rows.join(runs.withColumnRenamed("runs", "__runs").hint("shuffle_hash"), "__uid", "left")
    lines, hit = lines_of(F.col("text").cast("string")), F.col("__runs").isNotNull()
    after = lambda k: F.when(k > 0, F.get("__runs", k - 1)["b"] + 1).otherwise(0)
    upto = lambda k: F.coalesce(F.get("__runs", k)["a"], F.size("__lines"))
    between = F.transform(F.sequence(F.lit(0), F.size("__runs")), lambda k: F.slice("__lines", after(k) + 1, upto(k) - after(k)))
    gone = F.aggregate("__runs", F.lit(0), lambda s, r: s + r["b"] - r["a"] + 1)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long")
    out = joined.withColumn("__lines", lines).withColumn("n_lines", n).withColumn("n_removed", F.when(hit, gone).otherwise(0).cast("long"))
    out = out.withColumn("text", F.when(hit, F.array_join(F.flatten(between), "\n")).otherwise(F.col("text").cast("string")))
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
