"""Standardisation with population statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Mean and scale per feature; a constant feature has scale 1."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def vector(self):
        """``array<double>`` of the standardised features, in order. ``+ 0.0`` turns -0.0 into 0.0."""
        return F.array(*[(F.col(f).cast("double") - F.lit(m)) / F.lit(s) + F.lit(0.0)
                         for f, m, s in zip(self.features, self.means, self.scales)])


def _stats(df: DataFrame, features: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)],
                  *[F.stddev_pop(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)])


def scaler_frame(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature (feature, mean, scale), from one aggregation."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean"),
                 F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("scale"))
        for i, f in enumerate(features)]))
    return _stats(df, features).select(rows.alias("r")).select("r.*")


def fit_scaler(df: DataFrame, features: list[str]) -> Scaler:
    row = _stats(df, features).first()
    n = len(features)
    if row[0] is None:
        raise ValueError("cannot fit on an empty table")
    return Scaler(tuple(features), tuple(row[:n]), tuple(s if s > 0 else 1.0 for s in row[n:]))


def standardize(df: DataFrame, scaler: Scaler, out: str = "vec") -> DataFrame:
    return df.withColumn(out, scaler.vector())
