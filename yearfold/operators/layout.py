"""The year layout of a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearfold.functions.scalars import partition_name

YEAR = "p_year"


def year_range(df: DataFrame, field: str, as_of: dt.date) -> DataFrame:
    """One row (min_year, max_year) of the non-null keys; without any, the year of as_of twice."""
    c = F.col(field)
    years = df.where(c.isNotNull()).agg(F.year(F.min(c)).alias("lo"), F.year(F.max(c)).alias("hi"))
    lo, hi = (F.coalesce(F.col(x), F.lit(as_of.year)) for x in ("lo", "hi"))
    return years.select(F.least(lo, hi).alias("min_year"), F.greatest(lo, hi).alias("max_year"))


def year_layout(df: DataFrame, field: str, table: str, as_of: dt.date) -> DataFrame:
    """(p_year, name, from_date, to_date): the years of the data, on to that of as_of and one more. Bounds are half open."""
    r = year_range(df, field, as_of)
    last = F.greatest("max_year", F.lit(as_of.year)) + 1
    y = r.select(F.explode(F.sequence("min_year", last)).alias(YEAR))
    return y.select(YEAR, partition_name(F.lit(table), F.col(YEAR)).alias("name"), F.make_date(YEAR, F.lit(1), F.lit(1)).alias("from_date"), F.make_date(F.col(YEAR) + 1, F.lit(1), F.lit(1)).alias("to_date"))


def with_year(df: DataFrame, field: str) -> DataFrame:
    return df.withColumn(YEAR, F.year(field))


def layout_row_counts(df: DataFrame, field: str, table: str, as_of: dt.date) -> DataFrame:
    """The layout with the rows of each year, 0 where there are none."""
    counts = df.groupBy(F.year(field).alias(YEAR)).agg(F.count(F.lit(1)).alias("n"))
    return year_layout(df, field, table, as_of).join(counts, YEAR, "left").select(YEAR, "name", F.coalesce("n", F.lit(0)).alias("n_rows"))


def in_range(field: str, start: dt.datetime, end: dt.datetime) -> Column:
    """start <= field < end, with the bounds on the year that let the scan skip partitions."""
    last = end.year - 1 if end == dt.datetime(end.year, 1, 1) else end.year
    c, y = F.col(field), F.col(YEAR)
    return (y >= start.year) & (y <= last) & (c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))
