"""Flagged days to track and artist tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, REASONS, RELEASE_NOTE, AuditConfig
from ..functions import bot_pct, collab_names, confidence_score, reason_text
from .confounders import death_spike_adjust, holiday_confounder, oneoff_confounder
from .daily import KEYS

REASON_COLUMNS = [name for name, _ in REASONS]


def add_reason_flags(flagged: DataFrame, flag: str = "ensemble_bot", cfg: AuditConfig = DEFAULT) -> DataFrame:
    """One 0/1 column per reason; a reason only fires on a flagged day."""
    on = F.col(flag) == 1
    drop = F.col("drop_after_spike") > 0 if "drop_after_spike" in flagged.columns else F.lit(False)
    fired = {
        "r_velocity_spike": F.col("spike_ratio") > cfg.spike_flag,
        "r_seasonal_spike": F.col("seasonal_spike") > cfg.seasonal_flag,
        "r_plateau": (F.col("rolling_cv") > 0) & (F.col("rolling_cv") < cfg.low_cv),
        "r_drop_after_spike": drop,
    }
    return flagged.withColumns({name: F.coalesce(rule & on, F.lit(False)).cast("int")
                                for name, rule in fired.items()})


def add_flag_values(flagged: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Flagged plays, reasons and the holiday window of every day."""
    window = F.col("month").isin(*cfg.holiday_months).cast("int")
    out = flagged.withColumns({"bot_stream_val": F.col("streams") * F.col("ensemble_bot"),
                               "holiday_window": window})
    out = out.withColumns({"holiday_bot_stream_val": F.col("bot_stream_val") * F.col("holiday_window"),
                           "holiday_flag": F.col("ensemble_bot") * F.col("holiday_window")})
    return add_reason_flags(out, "ensemble_bot", cfg)


def track_rollup(flagged: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """One row per track."""
    tracks = flagged.groupBy(*KEYS).agg(
        F.sum("streams").alias("total_streams"),
        F.sum("bot_stream_val").alias("bot_streams"),
        F.sum("ensemble_bot").alias("flagged_days"),
        F.count("ensemble_bot").alias("total_days"),
        F.max("spike_ratio").alias("max_spike_ratio"),
        F.avg("rolling_cv").alias("avg_rolling_cv"),
        F.sum("drop_after_spike").alias("drop_after_spike_count"),
        F.max("release_adjusted").alias("release_adjusted"),
        *[F.sum(c).alias(c) for c in REASON_COLUMNS],
    )
    return tracks.select(
        *KEYS, "total_streams", "bot_streams", "flagged_days", "total_days", "max_spike_ratio",
        "avg_rolling_cv", "drop_after_spike_count",
        bot_pct(F.col("bot_streams"), F.col("total_streams")).alias("bot_pct"),
        confidence_score(F.col("flagged_days"), F.col("total_days"), F.col("max_spike_ratio"),
                         F.col("drop_after_spike_count"), cfg).alias("confidence"),
        reason_text().alias("flag_reasons"),
        F.when(F.col("release_adjusted") == 1, F.lit(RELEASE_NOTE)).otherwise(F.lit("")).alias("note"),
    )


def split_artist_totals(flagged: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Totals per single artist, with collaborations counted for everyone credited.

    Days are first summed per credit string and year. Only those few rows are split, exploded and
    shuffled by name, and a year is then one row per credit, so counting years needs no row-level distinct.
    """
    flag_date = F.when(F.col("ensemble_bot") == 1, F.col("date"))
    sums = {"total_streams": "streams", "bot_streams": "bot_stream_val", "flagged_days": "ensemble_bot",
            "drop_events": "drop_after_spike", "holiday_bot_streams": "holiday_bot_stream_val",
            "holiday_flagged_days": "holiday_flag", **{c: c for c in REASON_COLUMNS}}
    per_year = flagged.groupBy("artist", "year").agg(
        *[F.sum(src).alias(out) for out, src in sums.items()],
        F.count("ensemble_bot").alias("total_days"),
        F.max("spike_ratio").alias("max_spike_ratio"),
        F.min("date").alias("first_active"), F.max("date").alias("last_active"),
        F.min(flag_date).alias("first_flag"), F.max(flag_date).alias("last_flag"),
    )
    named = per_year.withColumn("artist", F.explode(collab_names(F.col("artist"), cfg.collab_pattern)))
    return named.groupBy("artist").agg(
        *[F.sum(out).alias(out) for out in sums],
        F.sum("total_days").alias("total_days"),
        F.size(F.collect_set("year")).cast("bigint").alias("years_active"),
        F.max("max_spike_ratio").alias("max_spike_ratio"),
        F.min("first_active").alias("first_active"), F.max("last_active").alias("last_active"),
        F.min("first_flag").alias("first_flag"), F.max("last_flag").alias("last_flag"),
    )


def qualify_artists(artists: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Enough track-days, plays and years, and not a holiday-catalogue act."""
    keep = ((F.col("total_days") >= cfg.min_days) & (F.col("total_streams") >= cfg.min_streams)
            & (F.col("years_active") >= cfg.min_years))
    if cfg.holiday_artists:
        keep = keep & ~F.col("artist").isin(*cfg.holiday_artists)
    return artists.where(keep)


def score_artists(totals: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Shares, confidence and reasons of artist totals."""
    return totals.withColumns({
        "bot_pct": bot_pct(F.col("bot_streams"), F.col("total_streams")),
        "confidence": confidence_score(F.col("flagged_days"), F.col("total_days"), F.col("max_spike_ratio"),
                                       F.col("drop_events"), cfg),
        "flag_reasons": reason_text(),
    }).drop(*REASON_COLUMNS)


def artist_rollup(flagged: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """One row per qualifying artist, after the tribute, holiday and one-off rules, in this order."""
    scored = score_artists(qualify_artists(split_artist_totals(flagged, cfg), cfg), cfg)
    cleared = oneoff_confounder(holiday_confounder(death_spike_adjust(scored, cfg), cfg), cfg)
    return cleared.select(
        "artist", "total_streams", "bot_streams", "flagged_days", "total_days", "years_active",
        "max_spike_ratio", "drop_events", "bot_pct", "confidence", "flag_reasons", "note",
        "holiday_flag_share", "flagged_span_days")
