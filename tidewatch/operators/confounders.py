"""Rules that clear legitimate bursts: launches, holidays, tributes and one-off events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEATH_SPIKE_NOTE, DEFAULT, HOLIDAY_NOTE, ONEOFF_NOTE, AuditConfig
from ..functions import round_even
from .daily import KEYS
from .signals import track_order


def release_confounder(flagged: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Clear launch-ramp flags of a track when most of its flags fall into its first rows.

    All rows of such a track get ``release_adjusted = 1``. Both windows share the track partitioning.
    """
    track = Window.partitionBy(*KEYS)
    numbered = flagged.withColumn("_early", F.row_number().over(track_order()) <= cfg.release_days)
    early_flag = F.when(F.col("_early"), F.col("ensemble_bot")).otherwise(0)
    summed = numbered.select("*", F.sum("ensemble_bot").over(track).alias("_all"),
                             F.sum(early_flag).over(track).alias("_launch"))
    cleared = (F.col("_all") > 0) & (F.col("_launch") / F.nullif(F.col("_all"), F.lit(0)) >= cfg.release_share)
    cleared = F.coalesce(cleared, F.lit(False))
    return (summed.withColumns({
        "ensemble_bot": F.when(cleared & F.col("_early"), 0).otherwise(F.col("ensemble_bot")).cast("int"),
        "release_adjusted": cleared.cast("int"),
    }).drop("_early", "_all", "_launch"))


def death_spike_adjust(artists: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Scale confidence down and annotate artists with a known tribute spike. Starts the notes."""
    known = F.col("artist").isin(*cfg.death_artists) if cfg.death_artists else F.lit(False)
    return artists.withColumns({
        "confidence": F.when(known, round_even(F.col("confidence") * cfg.death_factor, 1))
        .otherwise(F.col("confidence")),
        "note": F.when(known, F.lit(DEATH_SPIKE_NOTE)).otherwise(F.lit("")),
    })


def holiday_confounder(artists: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Take holiday-window plays off artists whose flags are concentrated there."""
    share = F.coalesce(F.col("holiday_flagged_days") / F.nullif(F.col("flagged_days"), F.lit(0)), F.lit(0.0))
    seasonal = (share >= cfg.holiday_share) & (F.col("flagged_days") > 0)
    left = F.greatest(F.col("bot_streams") - F.col("holiday_bot_streams"), F.lit(0.0))
    pct = round_even(F.try_divide(left, F.col("total_streams")) * 100.0, 1)
    return artists.withColumns({
        "holiday_flag_share": round_even(share, 2),
        "bot_streams": F.when(seasonal, left).otherwise(F.col("bot_streams")),
        "bot_pct": F.when(seasonal, pct).otherwise(F.col("bot_pct")),
        "confidence": F.when(seasonal, round_even(F.col("confidence") * cfg.holiday_factor, 1))
        .otherwise(F.col("confidence")),
        "note": F.when(seasonal, F.lit(HOLIDAY_NOTE)).otherwise(F.col("note")),
    })


def oneoff_confounder(artists: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Clear one short, sustained burst inside a long career; an earlier note stays."""
    span = F.datediff("last_flag", "first_flag")
    career = F.datediff("last_active", "first_active")
    event = F.coalesce((F.col("flagged_days") >= cfg.oneoff_min_flagged) & (span <= cfg.oneoff_span_days)
                       & (career >= cfg.oneoff_career_days), F.lit(False))
    return artists.withColumns({
        "flagged_span_days": F.coalesce(span, F.lit(-1)),
        "bot_streams": F.when(event, 0.0).otherwise(F.col("bot_streams")),
        "bot_pct": F.when(event, 0.0).otherwise(F.col("bot_pct")),
        "confidence": F.when(event, round_even(F.col("confidence") * cfg.oneoff_factor, 1))
        .otherwise(F.col("confidence")),
        "note": F.when(event & (F.length("note") == 0), F.lit(ONEOFF_NOTE)).otherwise(F.col("note")),
    }).drop("first_flag", "last_flag", "first_active", "last_active")
