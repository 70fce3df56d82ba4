"""Raw chart rows to one row per track and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["artist", "title"]
DAY_KEYS = [*KEYS, "date"]


def with_calendar(df: DataFrame) -> DataFrame:
    """Month, year and weekday (Monday is 0)."""
    return df.withColumns({"month": F.month("date"), "year": F.year("date"), "day_of_week": F.weekday("date")})


def daily_totals(charts: DataFrame) -> DataFrame:
    """Sum of plays per (artist, title, date); rows without a full key are left out.

    The sum is combined before the shuffle, so one track that holds a large part of the raw rows
    arrives as at most one row per day and input split.
    """
    keyed = charts.where(F.col("artist").isNotNull() & F.col("title").isNotNull() & F.col("date").isNotNull())
    totals = keyed.groupBy(*DAY_KEYS).agg(F.coalesce(F.sum("streams"), F.lit(0.0)).alias("streams"))
    return with_calendar(totals)
