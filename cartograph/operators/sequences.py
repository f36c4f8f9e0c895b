"""Selections, lookups and statistics over a table of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..storage import discard, stored


#: Candidates that each query is compared with, at most.
MOST_MASTERS = 2_000


class Selected:
    """A chain of selections over sequences; each step is a lazy DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df

    def where(self, condition: Column | str) -> Selected:
        return Selected(self.df.where(condition))

    def exclude(self, condition: Column | str) -> Selected:
        return Selected(self.df.where(~(F.expr(condition) if isinstance(condition, str) else condition)))

    def exclude_with_issue(self, keep_too_short: bool = False) -> Selected:
        return self.where(F.col("issues").isin("", "s") if keep_too_short else F.col("issues") == "")

    def exclude_too_short(self, least: int) -> Selected:
        return self.where(F.length("aa") >= least)

    def masters_only(self) -> Selected:
        return self.where("nuc <> ''")

    def dates(self, first: str | None = None, last: str | None = None) -> Selected:
        """By the latest date, from first to before last; without date is out."""
        date = F.col("isolation_date")
        cond = (date != "") & date.isNotNull()
        if first:
            cond = cond & (date >= first)
        if last:
            cond = cond & (date < last)
        return self.where(cond)

    def lineage(self, value: str) -> Selected:
        return self.where(F.col("lineage") == value)

    def host(self, value: str) -> Selected:
        return self.where(F.col("host") == value)

    def human(self) -> Selected:
        return self.host("")

    def by_name(self, names: list[str]) -> Selected:
        return self.where(name_matches(names))

    def exclude_name(self, names: list[str]) -> Selected:
        return self.exclude(name_matches(names))

    def include_name(self, everything: DataFrame, names: list[str], key: str = "seq_no") -> Selected:
        """Adds matching rows that are not there yet."""
        return Selected(self.df.unionByName(everything.where(name_matches(names)).join(self.df.select(key), key, "left_anti")))

    def has(self, predicate: str, seq: str = "aa") -> Selected:
        return self.where(S.matches(F.col(seq), predicate))

    def remove_hash_duplicates(self) -> Selected:
        """Of sequences with the same hash the most recent stays."""
        w = Window.partitionBy("hash").orderBy(F.col("isolation_date").desc_nulls_last(), "seq_no")
        return Selected(self.df.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n"))

    def sort(self, by: str, descending: bool = False) -> Selected:
        """Missing values last in both directions."""
        c = F.when(F.col(by) != "", F.col(by))
        return Selected(self.df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "seq_no"))

    def move_to_front(self, names: list[str], order: str = "seq_no") -> Selected:
        return Selected(self.df.orderBy(F.when(name_matches(names), 0).otherwise(1), order))


def name_matches(names: list[str], column: str = "name") -> Column:
    """Any of: a part of the name; with ~ a pattern without regard to case; with _ a sequence id."""
    out = F.lit(False)
    for n in names:
        out = out | (F.col(column).rlike("(?i)" + n[1:]) if n.startswith("~") else S.seq_id(F.col(column)).contains(n) if "_" in n else F.col(column).contains(n))
    return out


def masters(seqs: DataFrame) -> DataFrame:
    """Of each hash the holder with the earliest date."""
    w = Window.partitionBy("hash").orderBy(F.col("isolation_date").asc_nulls_last(), "seq_no")
    return seqs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def with_master(seqs: DataFrame) -> DataFrame:
    """Adds master_no: the holder of the same sequence with the earliest date."""
    w = Window.partitionBy("hash").orderBy(F.col("isolation_date").asc_nulls_last(), "seq_no")
    return seqs.withColumn("master_no", F.first("seq_no").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def same_hash(seqs: DataFrame) -> DataFrame:
    """Adds class_no (the smallest number with the hash) and n (sequences with it): members of classes, not pairs.

    Every sequence is kept; those without a hash are one class.
    """
    classes = seqs.groupBy(F.col("hash").alias("__hash")).agg(F.min("seq_no").alias("class_no"), F.count("*").alias("n"))
    return seqs.join(classes, F.col("hash").eqNullSafe(F.col("__hash"))).drop("__hash")


def pairs_by_hash(seqs: DataFrame) -> DataFrame:
    """seq_no, other_no: every sequence with all that have its hash, itself included.  The pairs are the result and grow as the square of a class."""
    return seqs.select("seq_no", "hash").join(seqs.select(F.col("seq_no").alias("other_no"), "hash"), "hash").select("seq_no", "other_no")


def clades(seqs: DataFrame, rules: DataFrame, require_sequence: bool = True) -> DataFrame:
    """seq_no, clades: the clades all of whose positions a sequence has.

    Rules are a table that users write by hand; they go to every task, turned
    into one expression for each clade, so sequences are not multiplied.
    """
    by: dict[str, list] = {}
    for r in rules.select("clade", "pos", "letter", "eq").collect():  # a hand-written table
        by.setdefault(r["clade"], []).append(r)
    found = []
    for clade in sorted(by):
        cond = F.lit(True)
        for r in by[clade]:
            at = S.letter(F.col("aa"), r["pos"]) == r["letter"]
            cond = cond & (at if r["eq"] else ~at)
        found.append(F.when(cond, F.lit(clade)))
    names = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    if require_sequence:
        names = F.when(F.col("aa") != "", names).otherwise(F.array().cast("array<string>"))
    return seqs.withColumn("clades", F.array_join(names, " "))


def rank_of(a_reassortant: Column, a_passage: Column, s_reassortant: Column, s_passage: Column) -> Column:
    """How well a sequence fits an antigen: lower is better."""
    egg = lambda p: p.rlike("(?:^|/)E[0-9?]*$")
    passage = F.when(a_passage == s_passage, 0).when(egg(a_passage) & egg(s_passage), 10).when(~egg(a_passage) & ~egg(s_passage) & (s_passage != "OR"), 20).when(s_passage == "OR", 50).when(s_passage == "", 90).otherwise(99)
    return F.when(a_reassortant == s_reassortant, 0).otherwise(100) + passage


def populate(antigens: DataFrame, seqs: DataFrame) -> DataFrame:
    """antigen_no with its best sequence by name: reassortant first, then passage, then the sequence's number.

    The best is found by an aggregation (partial before the exchange), not by
    sorting all candidates of an antigen.
    """
    pairs = antigens.select("antigen_no", "name", F.col("reassortant").alias("r"), F.col("passage").alias("p")).join(seqs.select("name", "seq_no", "aa", F.col("reassortant").alias("sr"), F.col("passage").alias("sp")), "name")
    rank = rank_of(F.col("r"), F.col("p"), F.col("sr"), F.col("sp"))
    return pairs.groupBy("antigen_no").agg(F.min(F.struct(rank.alias("rank"), F.col("seq_no"), F.col("aa"))).alias("best")).select("antigen_no", "best.rank", "best.seq_no", "best.aa")


def nearest(queries: DataFrame, candidates: DataFrame, most: int | None = None) -> DataFrame:
    """For each query (seq_no, aa) the candidate at the least Hamming distance; ties to the smaller number.

    Equal letters that differ between a query and a candidate at distance d leave
    some of d + 1 pieces untouched; with ``most`` given, only candidates that
    share a piece at its place are compared.  Without it every candidate is:
    candidates are then a table of MOST_MASTERS masters at most.  Equal sequences
    are compared once; the smallest number stands for equal candidates.
    """
    asked = queries.select(F.col("seq_no").alias("query_no"), F.col("aa").alias("_aa"))
    q = asked.select(F.col("_aa").alias("q")).distinct()
    c = candidates.groupBy(F.col("aa").alias("c")).agg(F.min("seq_no").alias("seq_no"))
    if most is None:
        if (n := c.count()) > MOST_MASTERS:
            raise ValueError(f"{n} candidates are too many to compare with all; give the greatest distance")
        pairs = q.crossJoin(F.broadcast(c))  # checked above
    else:
        def pieces(col: str) -> Column:
            n = most + 1
            return F.explode(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("i"), F.length(col).alias("n"), F.substring(F.col(col), F.floor(F.length(col) * i / n).cast("int") + 1, F.floor(F.length(col) * (i + 1) / n).cast("int") - F.floor(F.length(col) * i / n).cast("int")).alias("part"))))

        pairs = q.withColumn("piece", pieces("q")).join(c.withColumn("piece", pieces("c")), "piece").select("q", "seq_no", "c").distinct()
    pairs = pairs.withColumn("distance", S.hamming(F.col("q"), F.col("c")))
    if most is not None:
        pairs = pairs.where(F.col("distance") <= most)
    best = pairs.groupBy("q").agg(F.min(F.struct("distance", "seq_no")).alias("best"))
    found = asked.join(best, F.col("_aa").eqNullSafe(F.col("q"))).groupBy("query_no").agg(F.min("best").alias("best"))
    return found.select("query_no", "best.distance", "best.seq_no")


def letter_counts(seqs: DataFrame, *by: str) -> DataFrame:
    """How often each letter stands at each position, by group.  Equal sequences are counted first and taken apart once."""
    whole = seqs.groupBy(*by, "aa").agg(F.count("*").alias("n"))
    each = whole.select(*by, "n", F.posexplode(F.split("aa", "")).alias("p", "letter")).where("letter <> ''")
    return each.groupBy(*by, (F.col("p") + 1).alias("pos"), "letter").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, *by: str) -> DataFrame:
    w = Window.partitionBy(*by, "pos").orderBy(F.col("n").desc(), "letter")
    return counts.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def diverse_positions(counts: DataFrame) -> DataFrame:
    return counts.groupBy("pos").agg(F.count_distinct("letter").alias("letters")).where("letters > 1")


def clear_differences(counts: DataFrame, group: str) -> DataFrame:
    """Positions at which no letter is shared between groups."""
    per = counts.groupBy("pos", "letter").agg(F.count_distinct(group).alias("groups"))
    return per.groupBy("pos").agg(F.max("groups").alias("most"), F.count_distinct("letter").alias("letters")).where("most = 1 and letters > 1").select("pos")


def length_histogram(seqs: DataFrame, column: str = "aa") -> DataFrame:
    return seqs.groupBy(F.length(column).alias("length")).agg(F.count("*").alias("n"))


def statistics(seqs: DataFrame) -> DataFrame:
    """Totals and those without issues, by lineage, year, both and neither."""
    rows = seqs.select("lineage", F.substring("isolation_date", 1, 4).alias("year"), (F.col("issues") == "").cast("int").alias("good"))
    return rows.cube("lineage", "year").agg(F.count("*").alias("total"), F.sum("good").alias("no_issue"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a (name, hash): passages and dates united, the earliest holder of a hash is its master."""
    both = old.unionByName(new)
    merged = both.groupBy("name", "hash", "aa").agg(F.array_join(F.array_sort(F.collect_set("passage")), ","), F.array_join(F.array_sort(F.collect_set("isolation_date")), ","), F.min("seq_no")).toDF("name", "hash", "aa", "passages", "dates", "seq_no")
    w = Window.partitionBy("hash").orderBy("dates", "seq_no")
    return merged.withColumn("is_master", F.row_number().over(w) == 1)


def nuc_hash(df: DataFrame, column: str = "nuc", out: str = "hash") -> DataFrame:
    """The 32-bit xxHash of a column, eight upper-case hexadecimal digits."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        import xxhash

        return s.map(lambda x: None if x is None else xxhash.xxh32_hexdigest(x.encode()).upper())

    return df.withColumn(out, digest(F.col(column)))


def gaps_against(df: DataFrame, master: str, column: str = "aa", least_head: int = 3, most: int = 200) -> DataFrame:
    """Adds aligned (with - for deletions) and insertions ("pos:letters", comma-joined): the sequence laid against a master letter by letter.

    Heads in common are taken; where letters differ, the shortest gap in either
    sequence is taken after which at least ``least_head`` letters agree again,
    if that is better than going on without one.
    """

    def lay(seq: str) -> tuple[str, str]:
        out, inserted, i, j = [], [], 0, 0
        while i < len(seq) and j < len(master):
            if seq[i] == master[j]:
                out.append(seq[i])
                i, j = i + 1, j + 1
                continue
            straight = _same(seq, i + 1, master, j + 1)
            step = None
            if straight < least_head:
                for g in range(1, most):
                    if _same(seq, i, master, j + g) > max(least_head, straight) - 1 and j + g < len(master):
                        step = ("-", g)
                        break
                    if _same(seq, i + g, master, j) > max(least_head, straight) - 1 and i + g < len(seq):
                        step = ("+", g)
                        break
                    if j + g >= len(master) and i + g >= len(seq):
                        break
            if step is None:
                out.append(seq[i])
                i, j = i + 1, j + 1
            elif step[0] == "-":
                out.append("-" * step[1])
                j += step[1]
            else:
                inserted.append(f"{j}:{seq[i : i + step[1]]}")
                i += step[1]
        return "".join(out) + seq[i:], ",".join(inserted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            laid = [lay(x or "") for x in pdf[column]]
            yield pdf.assign(aligned=[x[0] for x in laid], insertions=[x[1] for x in laid])

    # equal sequences are laid once
    laid = df.select(column).distinct().mapInPandas(run, f"`{column}` string, aligned string, insertions string")
    return df.join(laid, df[column].eqNullSafe(laid[column])).select(*(df[c] for c in df.columns), "aligned", "insertions")


def _same(a: str, i: int, b: str, j: int) -> int:
    n = 0
    while i < len(a) and j < len(b) and a[i] == b[j]:
        n, i, j = n + 1, i + 1, j + 1
    return n


def on_one_side(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """side (first or second), key: keys that only one of two tables has."""
    a, b = first.select(key).distinct(), second.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("first").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("second").alias("side"), key))


#: Leaves that are looked through for pivots, and pivots at most.
PIVOT_SAMPLE, MOST_PIVOTS = 1_000, 32
#: Letters of the leaves, and of the queries, that one task compares at a time.
CELL_LETTERS = 1 << 22
#: Numbers of an intermediate array in a task.
BATCH = 1 << 21
PAD = 0x110000  # no letter


def _letters(texts: list[str], width: int) -> np.ndarray:
    """Code points by row, PAD after the end: the distance of two rows is the number of letters that differ and those that one has more."""
    out = np.frombuffer("".join(t.ljust(width) for t in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width).copy()
    out[np.arange(width) >= np.array([len(t) for t in texts])[:, None]] = PAD
    return out


def _batches(texts: list[str], width: int) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, BATCH // max(1, width))
    for k in range(0, len(texts), step):
        yield k, _letters(texts[k : k + step], width)


def _pivots(leaves: DataFrame) -> list[str]:
    """A few leaves far from each other, of a sample that is the same in each run; the choice bears on the time only."""
    texts = [r["c"] for r in leaves.orderBy(F.xxhash64("c"), "c").select("c").limit(PIVOT_SAMPLE).collect()]  # bounded
    width = max(map(len, texts))
    rows = _letters(texts, width)
    apart = lambda k: np.concatenate([(rows[i : i + 64] != rows[k]).sum(1) for i in range(0, len(rows), 64)])
    chosen, near = [0], apart(0)
    first = near.max()
    while len(chosen) < MOST_PIVOTS and near.max() > first / 4:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, apart(chosen[-1]))
    return [texts[k] for k in chosen]


def _to_pivots(texts: list[str], pivots: list[str]) -> np.ndarray:
    """Distances of texts (rows) to the pivots."""
    width = max(map(len, [*texts, *pivots]))
    p = _letters(pivots, width)
    return np.concatenate([np.stack([(rows != x).sum(1) for x in p], 1) for _, rows in _batches(texts, width)])


def _unlike(texts: list[str], pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and letter wherever a text differs from the pivot, by row."""
    found = []
    for k, rows in _batches(texts, len(pivot)):
        i, j = np.nonzero(rows != pivot)
        found.append((i + k, j, rows[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best_of_cell(queries: list[str], leaves: list[str], less: np.ndarray, pivot: str, per_letter: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the least per_letter * distance - less, its leaf (the first of equals) and the distance.

    A query and a leaf differ where one of them differs from the pivot, unless
    both do, with the same letter: only places where they do are met.
    """
    width = max(map(len, [*queries, *leaves, pivot]))
    base = _letters([pivot], width)[0]
    leaf, place, letter = _unlike(leaves, base)
    own = np.bincount(leaf, minlength=len(leaves))
    order = np.argsort(place, kind="stable")
    leaf, letter = leaf[order], letter[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=width))])
    query, at, what = _unlike(queries, base)
    mine = np.bincount(query, minlength=len(queries))
    ends = np.cumsum(mine)
    met = np.concatenate([[0], np.cumsum(np.bincount(query, begin[at + 1] - begin[at], len(queries)))])  # leaves that the queries before meet
    out = np.empty(len(queries)), np.empty(len(queries), np.int64), np.empty(len(queries), np.int64)
    k = 0
    while k < len(queries):
        m = k + max(1, min(BATCH // len(leaves), int(np.searchsorted(met, met[k] + BATCH, "right")) - 1 - k))
        a, b = ends[k] - mine[k], ends[min(m, len(queries)) - 1]
        m = min(m, len(queries))
        first, n = begin[at[a:b]], begin[at[a:b] + 1] - begin[at[a:b]]
        of = np.repeat(np.arange(len(n)), n)
        to = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
        both = np.bincount((query[a:b][of] - k) * len(leaves) + leaf[to], 1 + (letter[to] == what[a:b][of]), (m - k) * len(leaves))
        distance = mine[k:m, None] + own[None, :] - both.reshape(m - k, len(leaves)).astype(np.int64)
        score = distance * per_letter - less
        best = score.argmin(1)
        row = np.arange(m - k)
        out[0][k:m], out[1][k:m], out[2][k:m] = score[row, best], best, distance[row, best]
        k = m
    return out


def nearest_leaves(queries: DataFrame, leaves: DataFrame, per_letter: float = 100.0) -> DataFrame:
    """seq_no, distance, leaf_no: for each query (seq_no, aa) the leaf (seq_no, aa, cumulative) with the least per_letter * distance - cumulative, ties to the smaller number.

    Exact without a given distance.  Each leaf belongs to the nearest of a few
    pivots.  By the triangle bound a query leaves out all leaves of a pivot that
    can't be as good as the best leaf that some pivot is known to have; with the
    others it meets in cells of a bounded number of leaves and queries.  There
    only the letters that differ from the pivot are compared.  Where no bound
    holds, all are compared with all, in as many cells as that takes.  Equal
    sequences are searched once.
    """
    spark = queries.sparkSession
    best_of = leaves.where("aa <> ''").groupBy("aa").agg(F.min(F.struct((-F.col("cumulative")).alias("less"), "seq_no")).alias("b"))
    unlike = stored(best_of.select(F.col("b.seq_no").cast("long").alias("leaf_no"), (-F.col("b.less")).alias("cumulative"), F.col("aa").alias("c")))
    if unlike.isEmpty():
        return spark.createDataFrame([], "seq_no long, distance int, leaf_no long")
    asked = stored(queries.where("aa <> ''").select("aa").distinct().withColumn("query", F.monotonically_increasing_id()))
    pivots = _pivots(unlike)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                d = _to_pivots(list(pdf["c"]), pivots)
                yield pdf.assign(pivot=d.argmin(1).astype("int32"), d=d.min(1).astype("int32"))

    held = stored(unlike.mapInPandas(placed, "leaf_no long, cumulative double, c string, pivot int, d int"))
    less = F.col("d") * per_letter - F.col("cumulative")
    told = held.groupBy("pivot").agg(F.count("*").alias("n"), F.sum(F.length("c")).alias("letters"), F.min("d").alias("low"), F.max("d").alias("high"), F.max("cumulative").alias("far"), F.min(less).alias("good")).collect()  # MOST_PIVOTS rows at most
    at, low, high, far, good = (np.array([r[c] for r in told]) for c in ("pivot", "low", "high", "far", "good"))

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                d = _to_pivots(list(pdf["aa"]), pivots)[:, at]
                known = (d * per_letter + good).min(1)
                least = np.maximum(np.maximum(d - high, low - d), 0) * per_letter - far
                row, k = np.nonzero(least <= known[:, None] + 1e-6 * (1 + np.abs(known[:, None])))
                yield pd.DataFrame({"query": pdf["query"].to_numpy()[row], "aa": pdf["aa"].to_numpy()[row], "pivot": at[k].astype("int32")})

    going = stored(asked.select("query", "aa").mapInPandas(sent, "query long, aa string, pivot int"))
    parts = lambda letters: 1 + letters // CELL_LETTERS
    sizes = {r["pivot"]: parts(r["letters"]) for r in going.groupBy("pivot").agg(F.sum(F.length("aa")).alias("letters")).collect()}  # MOST_PIVOTS rows at most
    cells = F.broadcast(spark.createDataFrame([(r["pivot"], parts(r["letters"]), sizes.get(r["pivot"], 0)) for r in told], "pivot int, leaf_parts int, query_parts int"))  # as many
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = going.join(cells, "pivot").select("query", "aa", "pivot", part("query", "query_parts").alias("qp"), every("leaf_parts").alias("lp"))
    right = held.join(cells, "pivot").where("query_parts > 0").select("leaf_no", "cumulative", "c", "pivot", part("leaf_no", "leaf_parts").alias("lp"), every("query_parts").alias("qp"))

    def searched(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query": [], "score": [], "leaf_no": [], "distance": []})
        x = x.sort_values("leaf_no")
        score, k, distance = _best_of_cell(list(q["aa"]), list(x["c"]), x["cumulative"].to_numpy(), pivots[int(q["pivot"].iloc[0])], per_letter)
        return pd.DataFrame({"query": q["query"].to_numpy(), "score": score, "leaf_no": x["leaf_no"].to_numpy()[k], "distance": distance})

    key = ["pivot", "qp", "lp"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(searched, "query long, score double, leaf_no long, distance long")
    best = stored(met.groupBy("query").agg(F.min(F.struct("score", "leaf_no", "distance")).alias("best")))
    discard(unlike, held, going)
    found = queries.join(asked, "aa").join(best, "query")
    return found.select("seq_no", F.col("best.distance").cast("int").alias("distance"), F.col("best.leaf_no").alias("leaf_no"))
