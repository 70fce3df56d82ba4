"""Chart rows: curated ingest and reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT, WORLD_REGION
from ..functions import present
from ..runtime import path_exists

COLUMNS = [f.name for f in schema.CHARTS]


def region_filter(charts: DataFrame, regions: Sequence[str] = DEFAULT.regions,
                  all_regions: bool = False) -> DataFrame:
    """Keep the named regions, or with ``all_regions`` everything but the world total.

    The world row is the sum of the countries, so it would count plays twice. A missing region stays.
    """
    if all_regions:
        return charts.where(~F.col("region").eqNullSafe(WORLD_REGION))
    return charts.where(F.col("region").isin(*regions))


def drop_missing_streams(charts: DataFrame) -> DataFrame:
    return charts.where(present(F.col("streams")))


def _is_csv(path: str) -> bool:
    return path.rstrip("/").endswith(".csv")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV columns are read as text: the header decides which is which, whatever else the file holds."""
    return spark.read.option("header", True).option("escape", '"').csv(path) if _is_csv(path) else spark.read.parquet(path)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Chart columns under the fixed schema, NULL where the source lacks one. Nothing else leaves the scan."""
    raw = _raw(spark, path)

    def typed(f):
        if f.name not in raw.columns:
            return F.lit(None).cast(f.dataType)
        if not _is_csv(path):
            return F.col(f.name).cast(f.dataType)
        return F.try_to_date(F.col(f.name)) if f.name == "date" else F.col(f.name).try_cast(f.dataType)

    return raw.select(*[typed(f).alias(f.name) for f in schema.CHARTS])


def curate_charts(spark: SparkSession, raw: str, out: str | None = None,
                  regions: Sequence[str] | None = None, all_regions: bool = False) -> DataFrame:
    """Scan raw rows, keep five columns and the wanted regions, drop rows without plays.

    With ``out`` the result is written as Parquet by year (few, large directories) or, for a
    ``.csv`` path, as CSV. The input splits bound memory; nothing is concatenated anywhere.
    """
    kept = drop_missing_streams(region_filter(_scan(spark, raw), regions or DEFAULT.regions, all_regions))
    if out is None:
        return kept
    if _is_csv(out):
        kept.write.mode("overwrite").option("header", True).option("escape", '"').csv(out)
    else:
        kept.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(out)
    return _scan(spark, out)


def take_first(charts: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in date order. File order means nothing in a distributed scan."""
    return charts.orderBy("date", "artist", "title", "region", "streams").limit(n)


def read_charts(spark: SparkSession, path: str, sample: int | None = None, all_regions: bool = False,
                regions: Sequence[str] = DEFAULT.regions) -> DataFrame:
    """Chart rows ready for the audit. ``all_regions`` takes every row of an all-regions table."""
    rows = _scan(spark, path)
    if not all_regions and "region" in _raw(spark, path).columns:
        rows = region_filter(rows, regions)
    rows = drop_missing_streams(rows)
    return take_first(rows, sample) if sample else rows


def charts_or_empty(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first existing source, or a typed empty frame so that what reads it still runs."""
    for path in paths:
        if path_exists(spark, path):
            return _scan(spark, path)
    return spark.createDataFrame([], schema.CHARTS)
