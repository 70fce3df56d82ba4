"""Ranks, top-k lists, rank metrics and AUC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..functions import normalize_name, round_even
from ..runtime import materialize
from .prefix import running_totals


def top_by(df: DataFrame, score: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the highest score; ties by name. Each task keeps n rows, then they are merged."""
    return df.orderBy(F.desc(score), *(ties or ("artist",))).limit(n)


def top_per_genre(artists: DataFrame, n: int = 10) -> DataFrame:
    """The n most suspicious artists of every genre (rows beyond n are dropped before the shuffle)."""
    order = Window.partitionBy("genre_category").orderBy(F.desc("bot_pct"), "artist")
    return (artists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n))


def best_per_name(results: DataFrame, score: str = "bot_pct") -> DataFrame:
    """One row per normalised name: the best score, ties by artist; a missing score only if there is no other."""
    rest = [c for c in results.columns if c not in ("artist", score)]
    row = F.struct(F.col(score).isNull().alias("_missing"), (-F.col(score)).alias("_neg"), F.col("artist"), F.col(score), *rest)
    best = (results.withColumn("_norm", normalize_name(F.col("artist")))
            .groupBy("_norm").agg(F.min(row).alias("_row")))
    return best.select(*[F.col(f"_row.{c}").alias(c) for c in results.columns], "_norm")


def suspicion_rank(results: DataFrame, score: str = "bot_pct", cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Rank 1..n by score, highest first and missing scores last, and the share of names ranked below, without one
    global sort."""
    best = materialize(best_per_name(results, score), "best")
    ranked = running_totals(best, [], score, "artist", F.lit(1.0), descending=True, every=cfg.prefix_rows)
    n = best.select(F.count("*")).scalar()
    return (ranked.withColumn("rank", F.col("run_count")).withColumn("n", n)
            .withColumn("percentile", (1 - F.col("rank") / F.col("n")) * 100)
            .drop("run_sum", "run_count", "n"))


def documented_names(incidents: DataFrame) -> DataFrame:
    """Distinct normalised names of verified incidents."""
    return incidents.where(F.col("verified")).select(normalize_name(F.col("artist")).alias("_norm")).distinct()


def documented_present(results: DataFrame, incidents: DataFrame) -> DataFrame:
    found = results.select(normalize_name(F.col("artist")).alias("_norm"))
    return documented_names(incidents).join(found, "_norm", "left_semi").select(F.col("_norm").alias("artist"))


def documented_absent(results: DataFrame, incidents: DataFrame) -> DataFrame:
    found = results.select(normalize_name(F.col("artist")).alias("_norm"))
    return documented_names(incidents).join(found, "_norm", "left_anti").select(F.col("_norm").alias("artist"))


def auc_parts(df: DataFrame, positive: Column, score: Column, every: int = DEFAULT.prefix_rows) -> DataFrame:
    """Counts per score value and the negatives below it, for any number of values: offsets of sorted ranges of scores."""
    groups = df.groupBy(score.alias("score")).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(1)).alias("neg"))
    run = running_totals(groups, [], "score", "pos", "neg", every=every)
    return run.withColumn("neg_below", F.col("run_sum") - F.col("neg")).drop("run_sum", "run_count")


def roc_auc(df: DataFrame, positive: Column, score: Column, digits: int = 3, every: int = DEFAULT.prefix_rows) -> DataFrame:
    """One row: tie-aware area under the ROC curve, NULL unless both classes occur."""
    parts = auc_parts(df, positive, score, every)
    pairs = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    area = pairs / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))
    return parts.agg(round_even(area, digits).alias("roc_auc"))


def precision_recall_at(positives: DataFrame, n: Column, ks: tuple[int, ...] = (10, 25, 50)) -> list[Column]:
    """Aggregates over the ranks of the positives: hits in the top k over k and over all hits."""
    out = []
    for k in ks:
        hits = F.count_if(F.col("rank") <= k)
        size = F.least(F.lit(k), F.first(n))
        out.append(round_even(F.try_divide(hits, size), 3).alias(f"precision_at_{k}"))
        out.append(F.coalesce(round_even(F.try_divide(hits, F.count("rank")), 3), F.lit(0.0))
                   .alias(f"recall_at_{k}"))
    return out


def upper_median(values: Column) -> Column:
    """The element at ``size // 2`` of a sorted array: the upper of the two middle values."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) > 0, F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")))
