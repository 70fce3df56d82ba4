"""Queries behind a results dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MASK_PREFIX, AuditConfig
from ..functions import millions, money, present, round_even, royalty
from .prefix import running_totals
from .ranking import top_by

DISPLAY = {
    "artist": "Artist", "genre_category": "Genre", "total_streams": "Total Streams",
    "bot_streams": "Bot Streams", "bot_pct": "Bot %", "royalty_lost": "💰 Royalties Lost ($)",
    "confidence": "Confidence", "flagged_days": "Flagged Days", "flag_reasons": "Why flagged", "note": "Note",
}
TRACK_DISPLAY = {
    "title": "Track", "total_streams": "Total Streams", "bot_streams": "Bot Streams", "bot_pct": "Bot %",
    "royalty_lost": "💰 Royalties Lost ($)", "flagged_days": "Flagged Days",
}


def artist_contains(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive literal substring of the artist name."""
    return df.where(F.lower("artist").contains(F.lower(F.lit(text))))


def leaderboard_filter(artists: DataFrame, genre: str | None = None, min_bot_pct: float = 0.0,
                       min_streams: float = 0.0, min_confidence: float = 0.0) -> DataFrame:
    keep = (F.col("bot_pct") >= min_bot_pct) & (F.col("total_streams") >= min_streams)
    if genre is not None:
        keep = keep & (F.col("genre_category") == genre)
    if "confidence" in artists.columns:
        keep = keep & (F.col("confidence") >= min_confidence)
    return artists.where(keep)


def dashboard_kpis(artists: DataFrame) -> DataFrame:
    return artists.agg(F.count("*").alias("artists"), F.avg("bot_pct").alias("avg_bot_pct"),
                       F.sum("royalty_lost").alias("royalty_lost"),
                       F.count_if(F.col("bot_pct") > 10).alias("high_risk"))


def royalty_summary(artists: DataFrame) -> DataFrame:
    return artists.agg(F.sum("bot_streams").alias("bot_streams"), F.sum("royalty_lost").alias("royalty_lost"),
                       F.avg("royalty_lost").alias("avg_royalty_lost"))


def with_royalty(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    return df.withColumn("royalty_lost", royalty(F.col("bot_streams"), cfg.payout_per_stream))


def top_royalty(artists: DataFrame, n: int = 10) -> DataFrame:
    return top_by(artists, "royalty_lost", n)


def royalty_display(artists: DataFrame) -> DataFrame:
    return artists.select(F.col("artist").alias("Artist"), millions(F.col("bot_streams")).alias("Bot Streams"),
                          money(F.col("royalty_lost")).alias("Royalties Lost"))


def top_tracks_of(tracks: DataFrame, artist: str, n: int = 15) -> DataFrame:
    return top_by(artist_contains(tracks, artist), "bot_pct", n, "artist", "title")


def track_display(tracks: DataFrame) -> DataFrame:
    return tracks.select(*[F.col(c).alias(name) for c, name in TRACK_DISPLAY.items()])


def artist_timeline(charts: DataFrame, artist: str) -> DataFrame:
    """Plays per day over all rows whose credit contains the artist."""
    return artist_contains(charts, artist).groupBy("date").agg(F.sum("streams").alias("streams"))


def timeline_spikes(timeline: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Trailing mean, threshold at twice that mean, and whether a day is above it.

    A timeline is one row per calendar day, so its single ordered window is bounded by the calendar.
    """
    order = Window.orderBy("date").rowsBetween(1 - cfg.rolling_rows, 0)
    return (timeline.withColumn("rolling_avg", F.avg("streams").over(order))
            .withColumn("threshold", F.col("rolling_avg") * cfg.spike_flag)
            .withColumn("is_spike", (F.col("streams") > F.col("threshold")).cast("int")))


def incident_summary(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count("*").alias("incidents"), F.count_if("verified").alias("verified"),
                         F.sum(F.when(F.col("verified"), F.col("streams_removed"))).alias("streams_removed"))


def confirmed_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where(present(F.col("streams_removed")))


def incident_badges(incidents: DataFrame) -> DataFrame:
    """Headline strings of an incident."""
    removed = F.concat(round_even(F.col("streams_removed") / 1e6).cast("bigint").cast("string"),
                       F.lit("M streams removed"))
    return incidents.select(
        "artist", "year",
        F.when(F.col("verified"), "✅ Verified").otherwise("⚠️ Alleged").alias("status_badge"),
        F.when(F.col("legal_action"), " ⚖️ Legal Action").otherwise("").alias("legal_badge"),
        F.coalesce(removed, F.lit("Stream count unconfirmed")).alias("removed_badge"))


def mask_low_confidence(df: DataFrame, reveal: float, on: bool = True, name: str = "artist",
                        order: str = "bot_pct", cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Replace names below a confidence by ``… #i``, numbered in display order (score down, name up).

    Numbers run over the whole table, split as in :func:`running_totals`.
    """
    if not on or "confidence" not in df.columns:
        return df
    hidden = F.coalesce(F.col("confidence") < reveal, F.lit(False))
    numbered = running_totals(df, [], order, name, hidden.cast("bigint"), descending=True, every=cfg.prefix_rows)
    label = F.concat(F.lit(MASK_PREFIX), F.col("run_sum").cast("bigint").cast("string"))
    return (numbered.withColumn(name, F.when(hidden, label).otherwise(F.col(name)))
            .drop("run_sum", "run_count").select(*df.columns))


def leaderboard(artists: DataFrame, reveal: float = 0.0, mask: bool = True, **filters) -> DataFrame:
    """Filtered, masked artists under display names; the caller orders or limits what it shows."""
    shown = mask_low_confidence(leaderboard_filter(artists, **filters), reveal, mask)
    return shown.select(*[F.col(c).alias(label) for c, label in DISPLAY.items() if c in shown.columns])
