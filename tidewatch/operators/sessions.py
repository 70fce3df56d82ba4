"""Listening sessions: behaviour features, profiles and per-artist shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import completion_rate, round_even

SESSION_FEATURES = ["completion_rate", "session_diversity", "repeat_count", "skipped", "odd_hour", "high_repeat"]


def session_features(sessions: DataFrame) -> DataFrame:
    return sessions.withColumns({
        "completion_rate": completion_rate(F.col("listen_duration_sec"), F.col("track_duration_sec")),
        "session_diversity": F.col("unique_tracks_in_session")
        / F.greatest(F.col("session_length_tracks"), F.lit(1)),
        "odd_hour": F.col("hour_of_day").between(2, 5).cast("int"),
        "high_repeat": (F.col("repeat_count") > 10).cast("int"),
    })


def streams_by_hour(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("hour_of_day").agg(F.count("*").alias("streams"))


def session_artist_stats(flagged: DataFrame) -> DataFrame:
    """Total, flagged and remaining sessions per artist."""
    stats = flagged.groupBy("artist").agg(F.count("session_id").alias("total_streams"),
                                          F.sum("is_bot").alias("bot_streams"))
    return stats.withColumns({
        "real_streams": F.col("total_streams") - F.col("bot_streams"),
        "bot_percentage": round_even(F.col("bot_streams") / F.col("total_streams") * 100.0, 1)})


def equal_width_histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in ``bins`` equal-width bins over [min, max], empty ones included; the last bin is closed.

    A constant column gets a range of one around its value.
    """
    rows = df.select(value.cast("double").alias("x")).where(F.col("x").isNotNull())
    span = rows.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    flat = F.col("a") == F.col("b")
    low = span.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a"))).scalar()
    high = span.select(F.when(flat, F.col("b") + 0.5).otherwise(F.col("b"))).scalar()
    placed = rows.withColumns({"lo": low, "hi": high}).withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    guess = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("step")), F.lit(bins - 1))
    placed = placed.withColumn("g", guess)
    # the guess may be one off next to an edge, because the edge itself is rounded
    left, right = F.col("lo") + F.col("g") * F.col("step"), F.col("lo") + (F.col("g") + 1) * F.col("step")
    bin_ = (F.when(F.col("x") < left, F.col("g") - 1)
            .when((F.col("x") >= right) & (F.col("g") < bins - 1), F.col("g") + 1).otherwise(F.col("g")))
    counts = placed.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    edges = (df.sparkSession.range(bins).select(F.col("id").alias("bin"))
             .withColumns({"lo": low, "hi": high}).withColumn("step", (F.col("hi") - F.col("lo")) / bins))
    return edges.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("left_edge"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("sessions"))


def session_anomaly(sessions: DataFrame, contamination: float = 0.05, trees: int = 100, seed: int = 42) -> DataFrame:
    """Flag sessions by a forest alone: ``anomaly_score`` is the score minus its threshold, below 0 is flagged."""
    from ..models.iforest import fit_forest, forest_scores
    from ..models.scaler import fit_scaler, standardize
    from ..runtime import materialize
    from .quantile import exact_quantiles

    rows = session_features(sessions)
    scaled = materialize(standardize(rows, fit_scaler(rows, SESSION_FEATURES)), "sessions")
    forest = fit_forest(scaled.select("session_id", "vec"), trees=trees, seed=seed)
    scored = materialize(forest_scores(scaled, forest).drop("vec"), "session_scores")
    limit = exact_quantiles(scored, "iso_score", [contamination])[0]
    return (scored.withColumn("anomaly_score", F.col("iso_score") - F.lit(limit))
            .withColumn("is_bot", (F.col("anomaly_score") < 0).cast("int")).drop("iso_score"))
