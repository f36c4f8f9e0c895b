"""Semantic attributes of antigens and sera, and styles as tables of rules.

Attributes are a map from name to text; a rule is a selector (such a map) with
what it sets, and later or higher rules win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from . import maps


def with_attribute(df: DataFrame, name: str, value: Column, attributes: str = "semantic") -> DataFrame:
    """Sets an attribute where the value is not null or empty, removes it else."""
    bare = F.map_filter(F.coalesce(F.col(attributes), F.create_map().cast("map<string,string>")), lambda k, _: k != name)
    there = value.isNotNull() & (value != "")
    return df.withColumn(attributes, F.when(there, F.map_concat(bare, F.create_map(F.lit(name), value.cast("string")))).otherwise(bare))


def passage_type(reassortant: Column, egg: Column) -> Column:
    """r, e or c."""
    return F.when(reassortant != "", "r").when(egg, "e").otherwise("c")


def age_mark(date: Column, reference: str) -> Column:
    """12 if older than twelve months, 6 if older than six."""
    return F.when(dates.older_than(date, reference, 12), "12").when(dates.older_than(date, reference, 6), "6")


def selector(spec: dict[str, object], attributes: str = "semantic", number: str = "antigen_no", date: str = "date") -> Column:
    """A condition: true = has the attribute, false = has it not, a value = equals or is one of its words; !i a number, !D a pair of dates (half open)."""
    out = F.lit(True)
    for key, want in spec.items():
        value = F.col(attributes)[key]
        if key == "!i":
            out = out & (F.col(number) == want)
        elif key == "!D":
            first, last = want
            out = out & ((F.col(date) >= first) if first else F.lit(True)) & ((F.col(date) < last) if last else F.lit(True))
        elif want is True:
            out = out & value.isNotNull()
        elif want is False:
            out = out & value.isNull()
        else:
            out = out & F.coalesce((value == want) | F.array_contains(F.split(value, " "), str(want)), F.lit(False))
    return out


def styled(points: DataFrame, rules: list[dict], number: str = "antigen_no") -> DataFrame:
    """Adds what the rules set (fill, outline, size, shown, order): of the rules that select a point the last in (priority, place) wins, field by field."""
    fields = sorted({k for r in rules for k in r.get("set", {})})
    ordered = sorted(enumerate(rules), key=lambda x: (x[1].get("priority", 0), x[0]))
    out = points
    for field in fields:
        value = F.lit(None).cast("string")
        for _, r in ordered:
            if field in r.get("set", {}):
                value = F.when(selector(r.get("select", {}), number=number), F.lit(str(r["set"][field]))).otherwise(value)
        out = out.withColumn(field, value)
    return out


def legend(points: DataFrame, rules: list[dict], number: str = "antigen_no") -> DataFrame:
    """place, title, n: how many points each rule selects, counted in one pass."""
    counts = points.agg(*(F.count_if(selector(r.get("select", {}), number=number)).alias(str(k)) for k, r in enumerate(rules)))
    rows = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(r.get("title", "")).alias("title"), F.col(str(k)).alias("n")) for k, r in enumerate(rules)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def time_series_rules(periods: DataFrame) -> list[dict]:
    """A rule for each calendar period, for points dated in it."""
    return [{"select": {"!D": [str(r["begin"]), str(r["end"])]}, "set": {"shown": "true"}, "title": str(r["begin"])} for r in periods.collect()]  # a few periods


def vaccines(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Antigens of vaccine names by kind of passage, those in most layers first; choice counts from 0 in each (name, kind)."""
    w = Window.partitionBy("name", "passage_type").orderBy(F.col("n_layers").desc(), "antigen_no")
    return points.join(wanted.select("name", "surrogate"), "name").withColumn("choice", F.row_number().over(w) - 1)


def user_over_collected(user: DataFrame, collected: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the user's values go before, their order first."""
    fields = [c for c in collected.columns if c != key]
    u = user.withColumn("_u", F.lit(True)).select(key, "_u", *(F.col(c).alias(f"_{c}") for c in fields if c in user.columns))
    both = collected.join(u, key, "full_outer")
    return both.select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in user.columns else F.col(c) for c in fields), F.coalesce("_u", F.lit(False)).alias("from_user"))


def serum_circles(homologous: DataFrame, titers: DataFrame, bases: DataFrame, layout: DataFrame, n_antigens: int, folds: tuple[float, ...] = (2.0, 3.0)) -> DataFrame:
    """serum_no, fold, theoretical and empirical radius (the least over a serum's homologous antigens)."""
    out = None
    for fold in folds:
        t = maps.theoretical_circles(homologous, titers, bases, fold).groupBy("serum_no").agg(F.min("radius").alias("theoretical"))
        e = maps.empirical_circles(homologous, titers, bases, layout, n_antigens, fold).where("status = 'good'").groupBy("serum_no").agg(F.min("radius").alias("empirical"))
        both = t.join(e, "serum_no", "full_outer").select("serum_no", F.lit(fold).alias("fold"), "theoretical", "empirical")
        out = both if out is None else out.unionByName(both)
    return out


def populated(antigens: DataFrame, egg: Column, reference_date: str, clades: DataFrame | None = None, references: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Attributes that every chart gets, in order: passage (p), age, clades (C: antigen_no, clades), reference (R: antigen_no), continent and country (C9, c9: antigen_no, continent, country)."""
    out = antigens.withColumn("semantic", F.coalesce(F.col("semantic"), F.create_map().cast("map<string,string>")) if "semantic" in antigens.columns else F.create_map().cast("map<string,string>"))
    out = with_attribute(out, "p", passage_type(F.col("reassortant"), egg))
    out = with_attribute(out, "age", age_mark(F.col("date"), reference_date))
    if clades is not None:
        out = with_attribute(out.join(clades.select("antigen_no", F.col("clades").alias("_c")), "antigen_no", "left"), "C", F.col("_c")).drop("_c")
    if references is not None:
        out = with_attribute(out.join(references.select("antigen_no", F.lit("1").alias("_r")).distinct(), "antigen_no", "left"), "R", F.col("_r")).drop("_r")
    if places is not None:
        out = out.join(places.select("antigen_no", F.col("continent").alias("_k"), F.col("country").alias("_l")), "antigen_no", "left")
        out = with_attribute(with_attribute(out, "C9", F.col("_k")), "c9", F.col("_l")).drop("_k", "_l")
    return out


def clade_rules(clades: list[str], colours: list[str]) -> list[dict]:
    """A rule for each clade, in order, with the colours in turn."""
    return [{"select": {"C": c}, "set": {"fill": colours[k % len(colours)]}, "title": c} for k, c in enumerate(clades)]


def pale_rules(fields: tuple[str, ...] = ("fill", "outline")) -> list[dict]:
    """Old antigens, a year before the rest, are drawn pale."""
    return [{"select": {"age": "12"}, "set": {f: "pale" for f in fields}, "title": "older than 12 months"}]


def display_name(location: Column, isolation: Column, year: Column, passage: Column, reassortant: Column) -> Column:
    """What a label says: place, isolation and two digits of the year, and the passage or the reassortant."""
    kind = F.when(reassortant != "", reassortant).otherwise(passage)
    return F.concat_ws(" ", F.concat_ws("/", F.initcap(location), isolation, F.substring(year, -2, 2)), F.nullif(kind, F.lit("")))


def fixed_by_rules(column: Column, rules: list[tuple[str, str]]) -> Column:
    """A laboratory's table of pattern replacements, in order."""
    for pattern, new in rules:
        column = F.regexp_replace(column, pattern, new)
    return column
