"""Global order of a large table, and neighbours in it, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import materialize

ROW_BITS = 33


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """`df` written in sorted ranges, with a column at: number of the range, then row number in it, in one long."""
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")


def ranges(ordered: DataFrame) -> list[tuple[int, int]]:
    """(range, rows) of the ranges that have rows, in order: one entry for each range, whatever the number of rows."""
    part = F.shiftright("at", ROW_BITS)
    return sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())


def part_ends(rows: DataFrame, weight: int, size: str, *order: str) -> Column:
    """The last row of each part of the ascending order (columns `order`), in order, as a scalar array of structs. Parts have
    about `weight` by the sum of column `size`."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    ordered = rows.select(*order).repartitionByRange(total // weight + 1, *order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    last = ordered.groupBy(F.shiftright("at", ROW_BITS)).agg(F.max(F.struct(*order)).alias("end")).distinct()
    return last.agg(F.sort_array(F.collect_list("end"))).scalar()


def with_guests(rows: DataFrame, ends: Column, *order: str) -> DataFrame:
    """`rows` with columns part and own: each row in its part, and the last one of each part once more, not as its own, in the part that
    follows; after the last part comes the first."""
    at, known = F.struct(*order), F.col("ends")
    # Number of ends before the row, by binary search: every step is added if the end there is still before the row.
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    part = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(known, n + step - 1) < at, step).otherwise(0))
    # The optimizer merges these projections: the array is a constant of the plan, not a value of each row.
    placed = rows.withColumn("ends", ends).withColumn("part", part)
    own, guest = F.struct("part", F.lit(True).alias("own")), F.struct(((F.col("part") + 1) % F.size(known)).alias("part"), F.lit(False).alias("own"))
    places = F.when(F.get(known, F.col("part")) == at, F.array(own, guest)).otherwise(F.array(own))
    return placed.withColumn("place", F.explode(places)).select(*rows.columns, "place.part", "place.own")
