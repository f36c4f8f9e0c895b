"""Lookups and reports over charts and sequences: by key, by passage and layers, by names and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions import sequence as S
from ..storage import stored
from . import matching

# Laboratories and subtypes as sequence databases write them.
LABS = {
    "CENTERS FOR DISEASE CONTROL AND PREVENTION": "CDC",
    "WHO CHINESE NATIONAL INFLUENZA CENTER": "CNIC",
    "CRICK WORLDWIDE INFLUENZA CENTRE": "CRICK",
    "NATIONAL INSTITUTE FOR MEDICAL RESEARCH": "Crick",
    "NATIONAL INSTITUTE OF INFECTIOUS DISEASES (NIID)": "NIID",
    "WHO COLLABORATING CENTRE FOR REFERENCE AND RESEARCH ON INFLUENZA": "VIDRL",
    "ERASMUS MEDICAL CENTER": "EMC",
    "NATIONAL INSTITUTE FOR BIOLOGICAL STANDARDS AND CONTROL (NIBSC)": "NIBSC",
}
PASSAGE_KINDS = ("cell", "egg", "reassortant")


# ---- sequences

def find_sequences(seqs: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Sequences by seq_id, by hash, or by name and hash: an equi-join on the keys."""
    return seqs.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def laboratory(name: Column) -> Column:
    """The short name of a laboratory, or the name itself."""
    out = F
    for long, short in LABS.items():
        out = out.when(F.upper(name) == long, short)
    return out.otherwise(name)


def database_subtype(text: Column) -> Column:
    """A(H3N2) of "A / H3N2", A(H3) of "A / H3N0", B; empty if it is neither."""
    t = F.upper(text)
    hn = F.substring(t, 5, 20)
    part = F.when((F.substring(t, 6, 1) != "0") & (F.substring(t, 8, 1) == "0"), F.substring(t, 5, 2)).otherwise(hn)
    return F.when(t.startswith("A") & (F.length(t) >= 8), F.concat(F.lit("A("), part, F.lit(")"))).when(t.startswith("B"), "B").otherwise("")


def labs_of(lab_ids: Column) -> Column:
    """The laboratories of an entry, each once, from its map of laboratory to ids."""
    return F.array_sort(F.array_distinct(F.map_keys(lab_ids)))


def clades_of(rules: DataFrame, subtype: str | None = None, group: str | None = None) -> DataFrame:
    """Clade rules of a subtype, and of a named set of them."""
    if subtype is not None:
        rules = rules.where(names.h_or_b(F.col("subtype")) == names.h_or_b(F.lit(subtype)))
    return rules if group is None else rules.where(F.array_contains("sets", group))


# ---- antigens and sera

def described(members: DataFrame, titers: DataFrame, number: str = "antigen_no") -> DataFrame:
    """Antigens or sera with what selections ask for: distinct, passage_kind, n_layers and layers, is_sequenced and has_clade where there are columns for them."""
    layers = titers.where("titer <> '*'").groupBy(number).agg(F.array_sort(F.collect_set("layer_no")).alias("layers"))
    out = members.join(layers, number, "left").withColumn("layers", F.coalesce("layers", F.array().cast("array<int>")))
    kind = F.when(F.col("reassortant") != "", "reassortant").when(matching.is_egg(F.col("passage")), "egg").otherwise("cell")
    out = out.withColumns({"n_layers": F.size("layers"), "distinct": matching.is_distinct(F.col("annotations")), "passage_kind": kind})
    if "aa" in members.columns:
        out = out.withColumn("is_sequenced", F.coalesce(F.col("aa") != "", F.lit(False)))
    if "clades" in members.columns:
        out = out.withColumn("has_clade", F.size(F.filter(F.split(F.coalesce("clades", F.lit("")), " "), lambda x: x != "")) > 0)
    return out


def select_antigens(antigens: DataFrame, condition: Column | str) -> DataFrame:
    return antigens.where(condition)


def select_sera(sera: DataFrame, condition: Column | str) -> DataFrame:
    return sera.where(condition)


def has_any_clade_of(clades: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.coalesce(clades, F.lit("")), " "), F.array(*map(F.lit, wanted)))


def by_name_and_passage(described_: DataFrame, wanted: DataFrame, number: str = "antigen_no") -> DataFrame:
    """place, name, passage_kind, number, n_layers: antigens for a list (place, name, passage or null for any), most layers first.

    Distinct ones and those that are disconnected (column connected, if there) are left out.
    """
    there = described_.where("not distinct")
    if "connected" in described_.columns:
        there = there.where("connected")
    pairs = there.join(wanted.select("place", "name", F.col("passage").alias("_passage")), "name").where("_passage is null or _passage = passage_kind")
    w = Window.partitionBy("place", "passage_kind").orderBy(F.col("n_layers").desc(), number)
    return pairs.withColumn("choice", F.row_number().over(w) - 1).select("place", "name", "passage_kind", number, "n_layers", "choice")


def with_serology(antigens: DataFrame, found: DataFrame, number: str = "antigen_no") -> DataFrame:
    """semantic.serology marks the first choice of each entry of by_name_and_passage."""
    first = found.where("choice = 0").select(number, F.lit(True).alias("_s")).distinct()
    bare = F.map_filter(F.coalesce("semantic", F.create_map().cast("map<string,string>")), lambda k, _: k != "serology")
    marked = F.when(F.col("_s"), F.map_concat(bare, F.create_map(F.lit("serology"), F.lit("1")))).otherwise(bare)
    return antigens.join(first, number, "left").withColumn("semantic", marked).drop("_s")


def _homes(antigens: DataFrame, sera: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Antigens and sera with what matching.HOME names; a serum without a passage has its kind in its id."""
    egg = F.when(F.col("passage") == "", F.upper("serum_id").contains("EGG")).otherwise(matching.is_egg(F.col("passage")))
    s = sera.select("serum_no", "name", "reassortant", F.col("passage").alias("s_passage"), egg.alias("egg"), matching.comparable_annotations(F.regexp_replace("annotations", "CONC [0-9:]+", ""), True).alias("s_key"))
    a = antigens.select("antigen_no", "name", "reassortant", "passage", matching.is_egg(F.col("passage")).alias("egg"), matching.comparable_annotations(F.col("annotations")).alias("a_key"))
    return a, s


def homologous(antigens: DataFrame, sera: DataFrame, mode: str = "all") -> DataFrame:
    """serum_no, antigen_no by mode: all candidates; strict: the same passage (one serum, one antigen); relaxed: strict ones, else the first of the same kind; relaxed_strict: strict ones, else a single candidate.

    Where a serum gets one antigen, kinds of sera (all that is compared is equal)
    meet kinds of antigens, of each the first number and how many there are; so
    work grows with members and kinds, not with pairs of members.
    """
    a, s = _homes(antigens, sera)
    if mode == "all":
        return matching.best_pairs(s, a)
    of_serum = [*matching.HOME, "s_key", "s_passage"]
    kinds = a.groupBy(*matching.HOME, "a_key", "passage").agg(F.min("antigen_no").alias("first"), F.count("*").alias("n"))
    met = s.select(*of_serum).distinct().join(kinds, matching.HOME).withColumn("tier", matching.tier())
    other = F.when((F.col("s_passage") == F.col("passage")) | (F.col("s_passage") == ""), 0).otherwise(1)
    of_tier = lambda k: F.sum(F.when(F.col("tier") == k, F.col("n")).otherwise(0)).alias(f"n{k}")
    found = met.groupBy(*(F.col(c).alias(f"_{c}") for c in of_serum)).agg(F.min(F.struct("tier", other.alias("other"), "first")).alias("choice"), of_tier(1), of_tier(2))
    mine = F.lit(True)
    for c in of_serum:
        mine = mine & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = s.join(found, mine).groupBy("serum_no").agg(F.min("choice").alias("choice"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    same, n = F.col("choice.other") == 0, F.when(F.col("choice.tier") == 1, F.col("n1")).otherwise(F.col("n2"))
    kept = {"strict": same, "relaxed": F.lit(True), "relaxed_strict": same | (n == 1)}[mode]
    return rows.where(kept).select("serum_no", F.col("choice.first").alias("antigen_no"))


def first_homologous_serum(antigens: DataFrame, sera: DataFrame) -> DataFrame:
    """antigen_no, serum_no: of homologous()'s pairs those with the least serum of an antigen; kinds meet, not members."""
    a, s = _homes(antigens, sera)
    told = matching.with_best_tier(s, a).groupBy(*matching.HOME, "s_key", "best").agg(F.min("serum_no").alias("serum_no"))
    met = a.select(*matching.HOME, "a_key").distinct().join(told, matching.HOME).where(matching.tier() == F.col("best"))
    found = met.groupBy(*matching.HOME, F.col("a_key").alias("_a_key")).agg(F.min("serum_no").alias("serum_no"))
    return a.join(found, matching.HOME).where(F.col("a_key").eqNullSafe(F.col("_a_key"))).select("antigen_no", "serum_no")


def inserted(members: DataFrame, rows: DataFrame, before: int, number: str = "antigen_no") -> DataFrame:
    """Members with further rows put before a number; those from it on move up."""
    n = rows.withColumn(number, F.row_number().over(Window.orderBy(number)) - 1 + F.lit(before))  # a few rows by hand
    shift = n.agg(F.count("*").alias("_n"))
    moved = members.crossJoin(F.broadcast(shift)).withColumn(number, F.when(F.col(number) >= before, F.col(number) + F.col("_n")).otherwise(F.col(number)).cast("int")).drop("_n")  # one row
    return moved.unionByName(n.withColumn(number, F.col(number).cast("int")))


def keep_only(matched: DataFrame, primary: DataFrame, secondary: DataFrame, number: str = "antigen_no") -> tuple[DataFrame, DataFrame]:
    """Both charts' members that a matching (primary_no, secondary_no) pairs."""
    return primary.join(matched.select(F.col("primary_no").alias(number)), number, "left_semi"), secondary.join(matched.select(F.col("secondary_no").alias(number)), number, "left_semi")


def common_points(antigens: DataFrame, sera: DataFrame, n_primary: int, n_secondary: int) -> DataFrame:
    """primary_no, secondary_no of points, from matchings of antigens and of sera; sera follow antigens."""
    return antigens.select("primary_no", "secondary_no").unionByName(sera.select((F.col("primary_no") + n_primary).alias("primary_no"), (F.col("secondary_no") + n_secondary).alias("secondary_no")))


def homologous_first(antigens: DataFrame, pairs: DataFrame, *then: str) -> DataFrame:
    """place, antigen_no: antigens with a homologous serum first, by the serum's number, then by the columns named.

    Places are counted within ranges of that order, after the members of the ranges before.
    """
    first = pairs.groupBy("antigen_no").agg(F.min("serum_no").alias("_serum"))
    order = [F.col("_serum").asc_nulls_last(), *then, "antigen_no"]
    rows = antigens.join(first, "antigen_no", "left").select("antigen_no", "_serum", *then)
    ranges = stored(stored(rows).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_within", within).join(base, "_range").select("antigen_no", (F.col("_base") + F.col("_within")).cast("int").alias("place"))


def detected_references(antigens: DataFrame, sera: DataFrame) -> DataFrame:
    """Antigens of a sheet that have a serum of the same name; years of two digits are read as four."""
    long = lambda c: F.regexp_replace(F.upper(F.col(c)), "/([0-9]{2})$", "/20$1")
    key = sera.select(long("name").alias("_key")).distinct()
    return antigens.withColumn("_key", long("name")).join(key, "_key", "left_semi").drop("_key")


# ---- tables and reports

def date_range(members: DataFrame) -> DataFrame:
    """first, last: of the dates that are there."""
    date = F.nullif("date", F.lit(""))
    return members.agg(F.min(date).alias("first"), F.max(date).alias("last"))


def lineages(members: DataFrame) -> DataFrame:
    return members.groupBy("lineage").agg(F.count("*").alias("n"))


def majority_lineage(members: DataFrame) -> DataFrame:
    """The lineage that most members have, the alphabetically first of equals; members without one don't count."""
    return lineages(members.where("lineage <> ''")).agg(F.min_by("lineage", F.struct(-F.col("n"), F.col("lineage"))).alias("lineage"))


def composed(rows: DataFrame, column: str, *by: str, sep: str = "+") -> DataFrame:
    """The different values of a column joined, by group; empty ones left out."""
    return rows.where(F.col(column) != "").groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(column)), sep).alias("composed"))


def grouped_by_letter(seqs: DataFrame, pos: int) -> DataFrame:
    """letter at a position, n, first_no."""
    return seqs.groupBy(S.letter(F.col("aa"), pos).alias("letter")).agg(F.count("*").alias("n"), F.min("seq_no").alias("first_no"))


def passage_counts(seqs: DataFrame) -> DataFrame:
    """passage, n and the first and last isolation date."""
    return seqs.groupBy("passage").agg(F.count("*").alias("n"), F.min("isolation_date").alias("first"), F.max("isolation_date").alias("last"))


def united_points(*sets: DataFrame) -> DataFrame:
    """Points that any of the sets has, each once."""
    out = sets[0].select("point_no")
    for s in sets[1:]:
        out = out.union(s.select("point_no"))
    return out.distinct()


def assay(name: Column, form: str = "full") -> Column:
    """Names of an assay: full, brief, hi_or_neut or HI_or_Neut, no_hi or no_HI (empty for haemagglutination inhibition)."""
    hi = F.coalesce(name, F.lit("")).isin("", "HI")
    if form == "full":
        return F.coalesce(name, F.lit(""))
    if form == "brief":
        return F.when(name == "PLAQUE REDUCTION NEUTRALISATION", "PRN").when(name == "FOCUS REDUCTION", "FRA").otherwise(F.coalesce(name, F.lit("")))
    low = form.islower()
    short = F.when(hi, "" if form in ("no_hi", "no_HI") else "HI").when(name == "HINT", "HINT").otherwise("Neut")
    return F.lower(short) if low else short


def table_path(subtype: Column, assay_: Column, lab: Column, rbc: Column) -> Column:
    """The folder of a table: subtype, assay (with red blood cells for haemagglutination inhibition), laboratory."""
    s = F.lower(F.regexp_replace(F.regexp_replace(subtype, "^A\\((H[0-9]+)(N[0-9]+)?\\)$", "$1"), "[^A-Za-z0-9]", ""))
    a = assay(assay_, "hi_or_neut")
    return F.concat_ws("-", s, F.when(a == "hi", F.concat_ws("-", a, F.nullif(F.lower(rbc), F.lit("")))).otherwise(a), F.lower(lab))


def message_counts(messages: DataFrame) -> DataFrame:
    """type, n and the values that each type of message names."""
    return messages.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("values"))


def letters_of(rows: DataFrame, column: str) -> DataFrame:
    """letter, n, share: how often each letter occurs in a column of texts; counts of parts can be added up."""
    counts = rows.select(F.explode(F.split(column, "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a letter


def printed(rows: DataFrame, column: str, most: int = 20) -> str:
    """The first names of a column, and how many more there are."""
    some = [r[0] for r in rows.select(column).orderBy(column).limit(most + 1).collect()]
    return "\n".join(some[:most]) + (f"\n... {rows.count() - most} more" if len(some) > most else "")


KEYS = {
    "name": lambda: F.col("name"), "reassortant": lambda: F.col("reassortant"), "annotations": lambda: F.col("annotations"), "passage": lambda: F.col("passage"), "date": lambda: F.col("date"),
    "lineage": lambda: F.col("lineage"), "serum_id": lambda: F.col("serum_id"), "no": lambda: F.coalesce(*(F.col(c).cast("string") for c in ("antigen_no",))), "designation": lambda: matching.designation("name", "annotations", "reassortant", "passage"),
    "name_without_subtype": lambda: F.regexp_replace("name", "^(?:A(?:\\([^)]*\\))?|B)/", ""), "year": lambda: F.regexp_extract("name", "/([0-9]{4})$", 1), "year2": lambda: F.substring(F.regexp_extract("name", "/([0-9]{4})$", 1), 3, 2),
    "location": lambda: F.element_at(F.split("name", "/"), -3), "isolation": lambda: F.element_at(F.split("name", "/"), -2), "passage_type": lambda: F.when(F.col("reassortant") != "", "reassortant").when(matching.is_egg(F.col("passage")), "egg").otherwise("cell"),
    "date_brief": lambda: F.translate(F.col("date"), "-", ""), "lineage_letter": lambda: F.substring("lineage", 1, 1),
}


def formatted(pattern: str) -> Column:
    """A text for each row by a pattern such as "{name} {passage:>8}{date_brief}"; a width pads, < left, > right; unknown keys are an error."""
    import re

    parts: list[Column] = []
    for text, key, side, width in re.findall(r"([^{]*)(?:\{([a-z_0-9]+)(?::([<>])([0-9]+))?\})?", pattern):
        if text:
            parts.append(F.lit(text))
        if key:
            value = F.coalesce(KEYS[key](), F.lit(""))
            if width:
                pad = F.repeat(F.lit(" "), F.greatest(F.lit(0), int(width) - F.length(value)))
                value = F.concat(value, pad) if side == "<" else F.concat(pad, value)
            parts.append(value)
    return F.regexp_replace(F.trim(F.concat(*parts)), " +", " ") if parts else F.lit("")


def fixed_at_ingest(parsed: DataFrame, subtype: Column) -> DataFrame:
    """Of parsed names (names.parse_names) what a table keeps: name with the table's subtype, reassortant, annotations with what was left over."""
    bare = F.concat_ws("/", *(F.nullif(F.col(c), F.lit("")) for c in ("host", "location", "isolation", "year")))
    good = F.col("issue").isin("", "unrecognized_location")
    join = lambda *c: F.concat_ws(" ", *(F.nullif(F.col(x), F.lit("")) for x in c))
    return parsed.withColumns({"fixed": F.when(good, F.concat_ws("/", F.nullif(subtype, F.lit("")), bare)).otherwise(F.upper("name")), "fixed_reassortant": join("own_reassortant", "reassortant"), "fixed_annotations": join("own_annotations", "extra")})
