"""Lookup tables of a fixed size as scalar columns: membership filters and counts that never grow with the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import materialize

FILTER_LONGS = 1 << 17


def fixed_array(slots: DataFrame, size: int) -> Column:
    """Array of `size` longs from rows (slot, value), 0 where there is none, as a scalar."""
    spark = slots.sparkSession
    table = materialize(slots.where("value != 0"), "slots")
    dense = spark.range(0, size, 1, 1).join(table, F.col("id") == F.col("slot"), "left")
    packed = dense.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("value", F.lit(0)).alias("v")))).alias("all"))
    return packed.select(F.col("all.v")).scalar()


def membership(keys: DataFrame, longs: int = FILTER_LONGS) -> Column:
    """Bitmap of the 64-bit hashes in column `key`."""
    slot = keys.select(F.col("key").bitwiseAND(F.lit(longs - 1)).alias("slot"),
                       F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 40) & 63 as int))").alias("bit"))
    return fixed_array(slot.groupBy("slot").agg(F.bit_or("bit").alias("value")), longs)


def may_contain(bitmap: Column, key: Column, longs: int = FILTER_LONGS) -> Column:
    """False only if `key` is not in the bitmap."""
    word = F.get(bitmap, key.bitwiseAND(F.lit(longs - 1)).cast("int"))
    bit = F.shiftrightunsigned(key, 40).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1)) == 1
