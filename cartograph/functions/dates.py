"""Dates in the forms that tables use, and calendar series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_date(text: Column, month_first: bool = False, this_year: int = 2030, incomplete: bool = True) -> Column:
    """YYYY-MM-DD of a date; a missing month or day is 1 if incomplete ones are allowed; null if it is no date."""
    t = F.trim(F.translate(text, "/.", "--"))
    part = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit("")).cast("int")
    day = lambda y, m, d: F.when(m.between(1, 12) & d.between(1, 31), F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d)).cast("date"))
    full, short, local, month = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})$", "^(\\d{2})-(\\d{1,2})-(\\d{1,2})$", "^(\\d{1,2})-(\\d{1,2})-(\\d{4})$", "^(\\d{4})-(\\d{1,2})$"
    one = F.lit(1)
    century = part(short, 1) + F.when(part(short, 1) <= this_year - 2000, 2000).otherwise(1900)
    by_month, by_day = day(part(local, 3), part(local, 1), part(local, 2)), day(part(local, 3), part(local, 2), part(local, 1))
    out = F.when(t.rlike(full), day(part(full, 1), part(full, 2), part(full, 3))).when(t.rlike(short), day(century, part(short, 2), part(short, 3))).when(t.rlike(local), F.coalesce(by_month, by_day) if month_first else F.coalesce(by_day, by_month))
    if incomplete:
        out = out.when(t.rlike(month), day(part(month, 1), part(month, 2), one)).when(t.rlike("^\\d{4}$"), day(t.try_cast("int"), one, one))
    return F.date_format(out, "yyyy-MM-dd")


def older_than(date: Column, reference: str, months: int) -> Column:
    """Before the month of the reference date less so many months; an empty date is."""
    return F.coalesce(date, F.lit("")) < F.date_format(F.add_months(F.trunc(F.lit(reference).cast("date"), "MM"), -months), "yyyy-MM-dd")


def series(spark: SparkSession, first: str, last: str, period: str = "month", every: int = 1) -> DataFrame:
    """begin, end (exclusive) of the calendar periods from the one that holds first to before last; weeks begin on Monday."""
    begin = F.date_trunc(period, F.lit(first).cast("timestamp")).cast("date")
    step = F.expr(f"interval {every} {period}")
    days = spark.range(1).select(F.explode(F.sequence(begin, F.lit(last).cast("date"), step)).alias("begin"))
    return days.select("begin", (F.col("begin") + step).cast("date").alias("end")).where(F.col("begin") < F.lit(last).cast("date"))


def by_period(rows: DataFrame, date: str, period: str = "month") -> DataFrame:
    """How many rows each period has, with the period before's."""
    w = Window.orderBy("begin")  # one row a period
    return rows.groupBy(F.date_trunc(period, F.col(date).cast("timestamp")).cast("date").alias("begin")).agg(F.count("*").alias("n")).withColumn("before", F.lag("n").over(w))
