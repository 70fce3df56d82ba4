"""Running totals inside groups of any size, and over whole tables.

A plain window puts a whole group into one task. Here all rows are sorted into ranges of (group, coarse, fine) of about
``every`` rows each, whatever the groups are, and written with the number of their range. The sums of the ranges are as few as
there are ranges and groups; added up before each range they give its offsets, and a row's result is that offset plus the
running total inside its range. No step has all rows of a group, or of a value, in one task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..runtime import discard, materialize

BEFORE = Window.unboundedPreceding


def _join_equal(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys come from the left."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def sorted_ranges(df: DataFrame, order: list[Column], every: int) -> DataFrame:
    """``df`` written in sorted ranges of about ``every`` rows, or as many as Spark's shuffles have if that is more, with
    the number of the range in ``_range``."""
    spark = df.sparkSession
    rows = materialize(df, "unordered")
    n = rows.count()
    parts = max(1, -(-n // every), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1000))
    out = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    discard(rows)
    return out


def _offsets(ranges: DataFrame, group: list[str]) -> DataFrame:
    """Sum and count before each range, inside the group. Without groups there is one row for each range."""
    totals = ranges.groupBy(*group, "_range").agg(F.sum("_value").cast("double").alias("_s"), F.count("*").alias("_n"))
    if group:
        earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(BEFORE, -1)
        return totals.select(*group, "_range", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"),
                             F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    found = sorted(totals.collect(), key=lambda r: r["_range"])
    before = [accumulate([0, *[r[c] or 0 for r in found]]) for c in ("_s", "_n")]
    rows = [(r["_range"], float(s), int(n)) for r, s, n in zip(found, *before)]
    return ranges.sparkSession.createDataFrame(rows, "_range int, _s0 double, _n0 long")


def running_totals(df: DataFrame, group: list[str], coarse: str, fine: str, value: Column | str,
                   descending: bool = False, every: int = DEFAULT.prefix_rows) -> DataFrame:
    """Add ``run_sum`` and ``run_count`` over (group) in the order coarse, fine, this row included.

    (group, coarse, fine) must be unique; NULLs are values of their own, last in a descending order.
    """
    value = F.col(value) if isinstance(value, str) else value
    order = [F.desc(coarse) if descending else F.asc(coarse), F.asc(fine)]
    ranges = sorted_ranges(df.withColumn("_value", value), [*map(F.asc, group), *order], every)
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(BEFORE, 0)
    return (_join_equal(ranges, _offsets(ranges, group), [*group, "_range"], "inner")
            .withColumns({"run_sum": F.col("_s0") + F.coalesce(F.sum("_value").over(inside), F.lit(0)),
                          "run_count": F.col("_n0") + F.count(F.lit(1)).over(inside)})
            .drop("_value", "_range", "_s0", "_n0"))
