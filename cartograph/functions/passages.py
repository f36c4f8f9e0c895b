"""Passage histories, such as MDCK2/SIAT1 or E4 (2012-11-01), as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of cells, and the words that mean an original specimen.
NAMES = {"C": "MDCK", "M": "MDCK", "S": "SIAT", "MK": "MDCK"}
ORIGINAL = "^(?:OR|ORI.*|ORG.*|CS|CLI.*|DIR.*)$"
_PART = "([A-Z](?:[A-WYZ]*)) ?-*((?:[0-9]|X|\\?)*) ?(\\([A-Z][A-Z0-9]*\\))?"


def _steps(text: Column) -> Column:
    """Elements of a passage: name and count; a count alone repeats the name before it."""
    parts = F.filter(F.split(text, " *[/\\\\,+]+ *"), lambda x: x != "")

    def step(found: Column, part: Column) -> Column:
        name, count = F.regexp_extract(part, "^" + _PART + "$", 1), F.regexp_extract(part, "^" + _PART + "$", 2)
        before = F.element_at(found, -1)["name"]
        name = F.when(part.rlike("^-*[0-9?]+$"), before).otherwise(name)
        count = F.when(part.rlike("^-*[0-9?]+$"), F.regexp_replace(part, "^-*", "")).otherwise(count)
        for short, long in NAMES.items():
            name = F.when(name == short, long).otherwise(name)
        count = F.when((count == "") | (count == "X"), F.when(name.isin("OR", "CS"), "").otherwise("?")).otherwise(count)
        return F.concat(found, F.array(F.struct(name.alias("name"), count.alias("count"))))

    return F.aggregate(parts, F.array().cast("array<struct<name:string,count:string>>"), step)


def parsed(passage: Column) -> Column:
    """Struct text, steps, date, good: the passage as it is written in tables; what can't be read is only made upper case."""
    source = F.upper(F.trim(passage))
    date = F.regexp_extract(source, "\\(([0-9/\\-]+)\\)?$", 1)
    text = F.trim(F.regexp_replace(source, "\\(([0-9/\\-]+)\\)?$", ""))
    text = F.regexp_replace(text, "^PASSAGE[ \\-]*(?:DETAILS)? *:? *", "")
    steps = F.when(text.rlike(ORIGINAL), F.array(F.struct(F.lit("OR").alias("name"), F.lit("").alias("count")))).otherwise(_steps(text))
    unsure = F.size(F.filter(steps, lambda s: s["count"].startswith("?")))
    good = (F.size(steps) > 0) & F.forall(steps, lambda s: (F.length(s["name"]) > 0) & (F.length(s["name"]) <= 5)) & (unsure < 2)
    joined = F.array_join(F.transform(steps, lambda s: F.concat(s["name"], s["count"])), "/")
    out = F.when(good, F.concat(joined, F.when(date != "", F.concat(F.lit(" ("), date, F.lit(")"))).otherwise(""))).otherwise(source)
    return F.struct(out.alias("text"), F.when(good, steps).alias("steps"), F.when(good, date).otherwise("").alias("date"), good.alias("good"))


def last_name(p: Column) -> Column:
    return F.element_at(p["steps"], -1)["name"]


def is_egg(p: Column) -> Column:
    return F.coalesce(last_name(p).isin("E", "SPF", "SPE"), F.lit(False))


def is_cell(p: Column) -> Column:
    return F.coalesce(last_name(p).isin("MDCK", "SIAT", "QMC", "HCK", "VERO", "X", "SPFCK"), F.lit(False))


def kind(p: Column) -> Column:
    return F.when(is_egg(p), "egg").otherwise("cell")


def without_date(p: Column) -> Column:
    return F.when(p["good"], F.array_join(F.transform(p["steps"], lambda s: F.concat(s["name"], s["count"])), "/")).otherwise(p["text"])
