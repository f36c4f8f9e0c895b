"""Matching antigens and sera of charts by name, reassortant, annotations and passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

KEY = ["name", "reassortant", "annotations"]
DISTINCT = "DISTINCT"
#: Score of each level of a match, best first.
LEVELS = {"full": 4, "without_date": 3, "egg": 2, "ignored": 1}
#: Annotations of sera that do not count when they are compared with antigens'.
SERUM_ONLY = "CONC|RDE@|BOOST|BLEED|LAIV|^CDC$"


def is_egg(passage: Column) -> Column:
    last = F.element_at(F.split(without_date(passage), "/"), -1)
    return last.rlike("^(?:E|SPF|SPE)[0-9?X]*$")


def without_date(passage: Column) -> Column:
    return F.regexp_replace(passage, "\\s*\\([^)]*\\)\\s*$", "")


def is_distinct(annotations: Column) -> Column:
    return F.upper(annotations).contains(DISTINCT)


def designation(*parts: str) -> Column:
    """The parts that are not empty, with blanks between."""
    return F.concat_ws(" ", *(F.when(F.col(p) != "", F.col(p)) for p in parts))


def duplicates(rows: DataFrame, *parts: str) -> DataFrame:
    """Rows whose designation occurs more than once, distinct ones left out."""
    rows = rows.where(~is_distinct(F.col("annotations"))).withColumn("designation", designation(*parts))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("designation"))).where("n > 1").drop("n")


def without_duplicates(rows: DataFrame, *parts: str) -> DataFrame:
    """The rows, or an error that lists designations which occur more than once."""
    twice = [r[0] for r in duplicates(rows, *parts).select("designation").distinct().orderBy("designation").limit(20).collect()]
    if twice:
        raise ValueError("designations occur more than once: " + "; ".join(twice))
    return rows


def mark_distinct(rows: DataFrame, number: str, *parts: str) -> DataFrame:
    """The second and later rows of a designation are annotated as distinct."""
    w = Window.partitionBy(designation(*parts)).orderBy(number)
    return rows.withColumn("annotations", F.when((F.row_number().over(w) > 1) & ~is_distinct(F.col("annotations")), F.concat_ws(" ", F.when(F.col("annotations") != "", F.col("annotations")), F.lit(DISTINCT))).otherwise(F.col("annotations")))


def _classes(kind: str) -> list[tuple[str, Column]]:
    """For each level the class (null: none) that both members of a pair are in.

    All pairs of a class have the same score, so taking pairs by (primary,
    secondary) is pairing by rank: no pair that is not taken is ever made.
    """
    passage, there = F.col("passage"), F.col("passage") != ""
    if kind == "antigens":
        full, date = F.when(there, passage), F.when(there, without_date(passage))
        egg = F.when(there, F.when(is_egg(passage), "egg").otherwise("cell")).when(F.col("reassortant") != "", "none")
    else:
        full, date = F.when(F.col("serum_id") != "", F.col("serum_id")), F.lit(None).cast("string")
        egg = F.when(there, F.when(is_egg(passage), "egg").otherwise("cell"))
    return [("full", full), ("without_date", date), ("egg", egg), ("ignored", F.lit(""))]


def common(primary: DataFrame, secondary: DataFrame, number: str, kind: str = "antigens", level: str = "automatic") -> DataFrame:
    """primary_no, secondary_no, score: a one-to-one matching of two charts' antigens or sera.

    level: strict, relaxed, ignored, or automatic: scores in descending order as
    long as fewer than max(3, a tenth of the smaller side) are matched.
    """
    extra = ["serum_id"] if kind == "sera" else []
    sides = [x.where(~is_distinct(F.col("annotations"))).select(F.lit(k).alias("side"), F.col(number).alias("no"), *KEY, "passage", *extra) for k, x in ((1, primary), (2, secondary))]
    wanted = {"strict": ["full"], "relaxed": ["full", "without_date", "egg"], "ignored": ["ignored"]}.get(level, list(LEVELS))
    keyed = F.lit(True)
    for c in KEY:
        keyed = keyed & F.col(c).isNotNull()
    # one exchange by key; each level is windows within it over the members that finer levels have left
    rows = sides[0].unionByName(sides[1]).repartition(*KEY).withColumns({"score": F.lit(None).cast("int"), "rank": F.lit(None).cast("int"), "cls": F.lit(None).cast("string")})
    for name, cls in _classes(kind):
        if name not in wanted:
            continue
        rows = rows.withColumn("_cls", F.when(F.col("score").isNull() & keyed, cls))
        one, both = Window.partitionBy(*KEY, "_cls", "side").orderBy("no"), Window.partitionBy(*KEY, "_cls")
        there = [F.count_if(F.col("side") == k).over(both) for k in (1, 2)]
        rows = rows.withColumns({"_rank": F.row_number().over(one), "_pairs": F.least(*there)})
        taken = F.col("_cls").isNotNull() & (F.col("_rank") <= F.col("_pairs"))
        rows = rows.withColumns({"score": F.when(taken, LEVELS[name]).otherwise(F.col("score")), "rank": F.when(taken, F.col("_rank")).otherwise(F.col("rank")), "cls": F.when(taken, F.col("_cls")).otherwise(F.col("cls"))})
    member = lambda k: F.max(F.when(F.col("side") == k, F.col("no")))
    found = rows.where("score is not null").groupBy(*KEY, "score", "cls", "rank").agg(member(1).alias("primary_no"), member(2).alias("secondary_no")).select("primary_no", "secondary_no", "score")
    if level != "automatic":
        return found
    found = stored(found)
    sizes = primary.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(secondary.select(F.lit(0).alias("a"), F.lit(1).alias("b"))).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    enough, before, scores = max(3, min(sizes["a"] or 0, sizes["b"] or 0) // 10), 0, []
    for r in found.groupBy("score").count().orderBy(F.col("score").desc()).collect():  # at most four rows
        if before < enough:
            scores.append(r["score"])
        before += r["count"]
    return found.where(F.col("score").isin(scores)) if scores else found.limit(0)


def comparable_annotations(annotations: Column, serum: bool = False) -> Column:
    """Annotations in order, without those that only sera have."""
    words = F.filter(F.split(annotations, " "), lambda x: (x != "") & (~x.rlike(SERUM_ONLY) if serum else F.lit(True)))
    return F.array_join(F.array_sort(words), " ")


def reference_antigens(antigens: DataFrame, sera: DataFrame) -> DataFrame:
    """Antigens that share name and annotations with a serum."""
    keys = sera.where(~is_distinct(F.col("annotations"))).select("name", comparable_annotations(F.regexp_replace("annotations", "CONC [0-9:]+", ""), True).alias("key")).distinct()
    rows = antigens.where(~is_distinct(F.col("annotations"))).withColumn("key", comparable_annotations(F.col("annotations")))
    return rows.join(keys, ["name", "key"], "left_semi").drop("key")


def test_antigens(antigens: DataFrame, sera: DataFrame, number: str = "antigen_no") -> DataFrame:
    return antigens.join(reference_antigens(antigens, sera).select(number), number, "left_anti")


#: What a serum and its homologous antigens share; annotations (s_key, a_key) are compared too where that leaves any.
HOME = ["name", "reassortant", "egg"]


def tier() -> Column:
    return F.when(F.col("s_key") == F.col("a_key"), 1).otherwise(2)


def with_best_tier(sera: DataFrame, antigens: DataFrame) -> DataFrame:
    """Sera (serum_no, HOME, s_key) that have homologous antigens (HOME, a_key), with best: the least tier of a serum's number.

    Kinds of sera meet kinds of antigens; no pair of members is made.
    """
    met = sera.select(*HOME, "s_key").distinct().join(antigens.select(*HOME, "a_key").distinct(), HOME)
    found = met.groupBy(*HOME, F.col("s_key").alias("_s_key")).agg(F.min(tier()).alias("best"))
    rows = sera.join(found, HOME).where(F.col("s_key").eqNullSafe(F.col("_s_key"))).drop("_s_key")
    return rows.withColumn("best", F.min("best").over(Window.partitionBy("serum_no")))


def best_pairs(sera: DataFrame, antigens: DataFrame) -> DataFrame:
    """serum_no, antigen_no of the best tier.

    The tier is known before members meet: of the pairs none is put in order,
    exchanged or stored, and where annotations agree they are part of the key.
    """
    told, a = with_best_tier(sera, antigens), antigens.select("antigen_no", *HOME, "a_key")
    same = told.where("best = 1").join(a.withColumnRenamed("a_key", "s_key"), [*HOME, "s_key"])
    other = told.where("best = 2").join(a, HOME).where(tier() == 2)
    return same.select("serum_no", "antigen_no").unionByName(other.select("serum_no", "antigen_no"))


def homologous(antigens: DataFrame, sera: DataFrame) -> DataFrame:
    """serum_no, antigen_no: antigens of a serum's name, reassortant, annotations and kind of passage; where there is none, without regard to annotations."""
    s = sera.select("serum_no", "name", "reassortant", comparable_annotations(F.regexp_replace("annotations", "CONC [0-9:]+", ""), True).alias("s_key"), is_egg(F.col("passage")).alias("egg"))
    a = antigens.select("antigen_no", "name", "reassortant", comparable_annotations(F.col("annotations")).alias("a_key"), is_egg(F.col("passage")).alias("egg"))
    return best_pairs(s, a)


def new_antigens(antigens: DataFrame, previous: DataFrame, *parts: str) -> DataFrame:
    """Antigens whose designation the previous chart does not have."""
    return antigens.withColumn("d", designation(*parts)).join(previous.select(designation(*parts).alias("d")), "d", "left_anti").drop("d")


def merge_targets(primary: DataFrame, secondary: DataFrame, matched: DataFrame, number: str) -> DataFrame:
    """Numbers in a merged chart: chart (1, 2), its number, target.  The primary's keep theirs, matched ones get the partner's, the rest follow."""
    first = primary.select(F.lit(1).alias("chart"), F.col(number).alias("no")).withColumn("target", F.row_number().over(Window.orderBy("no")) - 1)  # one row a member
    rest = secondary.select(F.col(number).alias("no")).join(matched.select(F.col("secondary_no").alias("no"), "primary_no"), "no", "left")
    placed = rest.where("primary_no is not null").join(first.select(F.col("no").alias("primary_no"), "target"), "primary_no").select(F.lit(2).alias("chart"), "no", "target")
    size = primary.agg(F.count("*").alias("size"))
    added = rest.where("primary_no is null").withColumn("k", F.row_number().over(Window.orderBy("no")) - 1).crossJoin(F.broadcast(size))  # one row
    return first.unionByName(placed).unionByName(added.select(F.lit(2).alias("chart"), "no", (F.col("k") + F.col("size")).cast("int").alias("target")))


def merge_titers(layers1: DataFrame, layers2: DataFrame, antigen_targets: DataFrame, serum_targets: DataFrame) -> DataFrame:
    """Layers of both charts under the merged numbers; the second's layers come after the first's."""
    shift = layers1.agg(F.coalesce(F.max("layer_no") + 1, F.lit(0)).alias("shift"))
    both = layers1.select(F.lit(1).alias("chart"), "antigen_no", "serum_no", "layer_no", "titer").unionByName(layers2.crossJoin(F.broadcast(shift)).select(F.lit(2).alias("chart"), "antigen_no", "serum_no", (F.col("layer_no") + F.col("shift")).alias("layer_no"), "titer"))  # one row
    for col, targets in (("antigen_no", antigen_targets), ("serum_no", serum_targets)):
        both = both.join(targets.select("chart", F.col("no").alias(col), F.col("target").alias(f"{col}_t")), ["chart", col]).drop(col).withColumnRenamed(f"{col}_t", col)
    return both.select("antigen_no", "serum_no", "layer_no", "titer")


def same_tables(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows."""
    cols = sorted(a.columns)
    return sorted(b.columns) == cols and a.select(*cols).exceptAll(b.select(*cols)).isEmpty() and b.select(*cols).exceptAll(a.select(*cols)).isEmpty()


def repeated_assay(common_titers: DataFrame) -> DataFrame:
    """For pairs of cells (layer_no of the primary, titer, other) whether a layer of the primary repeats the other's titers throughout."""
    return common_titers.groupBy("layer_no").agg(F.bool_and(F.col("titer").eqNullSafe(F.col("other"))).alias("repeats"))
