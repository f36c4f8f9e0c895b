"""Column functions on titers: strings such as 40, <10, >1280, ~80 and *.

``*`` stands for a titer that is not there; it logs to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that counts as a titer.
VALID = "^(\\*|[<>~][0-9]*|[0-9]+)$"


def sign(titer: Column) -> Column:
    """<, >, ~, * or, for a regular titer, nothing."""
    return F.regexp_extract(titer, "^[<>~*]", 0)


def valid(titer: Column) -> Column:
    return titer.rlike(VALID)


def kind(titer: Column) -> Column:
    s = sign(titer)
    return F.when(~valid(titer), "invalid").when(s == "*", "dont_care").when(s == "<", "less_than").when(s == ">", "more_than").when(s == "~", "dodgy").otherwise("regular")


def value(titer: Column) -> Column:
    """The number without its sign; null for * and bare signs."""
    return F.nullif(F.regexp_replace(titer, "[^0-9]", ""), F.lit("")).cast("int")


def value_with_thresholded(titer: Column) -> Column:
    """Half the number below <, twice the number above >."""
    v = value(titer)
    return F.when(sign(titer) == "<", F.floor(v / 2).cast("int")).when(sign(titer) == ">", v * 2).otherwise(v)


def logged(titer: Column) -> Column:
    """log2(value / 10), the sign ignored."""
    return F.log2(value(titer) / F.lit(10.0))


def logged_with_thresholded(titer: Column) -> Column:
    """One less below <, one more above >."""
    return logged(titer) + F.when(sign(titer) == "<", -1.0).when(sign(titer) == ">", 1.0).otherwise(0.0)


def logged_for_column_bases(titer: Column) -> Column:
    """One more above >; -1 for * and ~."""
    return F.when(sign(titer).isin("*", "~"), F.lit(-1.0)).otherwise(logged(titer) + F.when(sign(titer) == ">", 1.0).otherwise(0.0))


def logged_as_string(titer: Column) -> Column:
    return F.when(sign(titer) == "*", F.lit("*")).otherwise(F.concat(sign(titer), F.regexp_replace(F.format_string("%.6f", logged(titer)), "\\.?0+$", "")))


def multiplied_by(titer: Column, by: float) -> Column:
    """The value multiplied and rounded half away from zero, the sign kept."""
    return F.when(sign(titer) == "*", titer).otherwise(F.concat(sign(titer), F.round(value(titer) * F.lit(float(by))).cast("long").cast("string")))


def from_logged(x: Column) -> Column:
    """round(10 * 2^x) as a titer."""
    return F.round(F.pow(F.lit(2.0), x) * 10).cast("long").cast("string")


def sort_key(titer: Column) -> Column:
    """Orders <n just below n and >n just above; * first."""
    v = value(titer)
    return F.when(sign(titer) == "*", -1).when(sign(titer) == "<", v - 1).when(sign(titer) == ">", v + 1).otherwise(v)


def checked(titer: Column) -> Column:
    """A titer as laboratories write it, made regular: blanks go, full-width signs are replaced, of a pair a / b the first is taken, what is unreadable becomes *."""
    t = F.translate(F.regexp_replace(titer, "\\s+", ""), "＜＞", "<>")
    t = F.element_at(F.split(t, "/"), 1)
    return F.when(t.isNull() | (t == "") | F.upper(t).isin("*", "ND", "NT", "QNS", "-"), F.lit("*")).when(t.rlike("^[<>~]?[0-9]+\\.[0-9]+$"), F.concat(sign(t), F.round(F.regexp_replace(t, "[<>~]", "").cast("double")).cast("long").cast("string"))).when(valid(t), t).otherwise(F.lit("*"))
