"""Chart, session, genre, incident and label views over a TPC-H-like star and its event table.

These stand in for a chart feed: the same operators run on them as on curated charts.
Joins carry no hints; the optimizer knows the sizes of the dimension tables and broadcasts
the ones that fit its threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def charts_view(spark: SparkSession, folder: str) -> DataFrame:
    """Plays per shipped line: nation (with brand as a guest) is the artist, part type the title."""
    part = _table(spark, folder, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    place = (_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
             .join(_table(spark, folder, "nation").select("n_nationkey", "n_name"),
                   F.col("s_nationkey") == F.col("n_nationkey")))
    guest = F.col("p_size") % 10
    return (_table(spark, folder, "lineitem")
            .select("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_quantity")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(place, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("p_type").alias("title"),
                    F.col("l_shipdate").cast("date").alias("date"),
                    F.when(guest == 0, F.concat("n_name", F.lit(" & "), "p_brand"))
                    .when(guest == 1, F.concat("n_name", F.lit(" feat. "), "p_brand"))
                    .otherwise(F.col("n_name")).alias("artist"),
                    F.when(F.col("l_returnflag") == "A", "United States")
                    .when(F.col("l_returnflag") == "N", "Global").otherwise("Mexico").alias("region"),
                    (F.col("l_quantity") * 1000).alias("streams")))


def genres_view(spark: SparkSession, folder: str) -> DataFrame:
    """Region of the nation as the category of an artist; brands have none."""
    return (_table(spark, folder, "nation")
            .join(_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias("artist"), F.col("r_name").alias("genre_category"),
                    F.col("r_name").alias("genres")))


def incidents_view(spark: SparkSession, folder: str) -> DataFrame:
    """One documented case per supplier, named after its nation or, with a debt, after itself."""
    balance = F.col("s_acctbal")
    return (_table(spark, folder, "supplier")
            .join(_table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.when(balance < 0, F.col("s_name"))
                    .otherwise(F.concat("n_name", F.lit(" ("), "s_name", F.lit(")"))).alias("artist"),
                    F.when(balance >= 2000, F.floor(balance).cast("double") * 1000).alias("streams_removed"),
                    F.concat(F.lit("plays removed from "), "s_name").alias("incident"),
                    F.col("n_name").alias("source"), F.col("r_name").alias("label"),
                    (F.lit(2020) + F.col("s_nationkey") % 6).cast("int").alias("year"),
                    ((balance >= 6000) | (balance < 0)).alias("verified"),
                    (balance < 1000).alias("legal_action")))


def sessions_view(spark: SparkSession, folder: str) -> DataFrame:
    """One session row per user, day and event type. Cents are summed as integers, so sums are exact."""
    events = _table(spark, folder, "events").select(
        "user_id", "event_type", "ts", F.to_date("ts").alias("day"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    per_type = events.groupBy("user_id", "day", "event_type").agg(
        F.count("*").alias("n"), F.sum("cents").alias("cents"), F.max("cents").alias("top_cents"),
        F.min("ts").alias("first_ts"))
    per_day = per_type.groupBy("user_id", "day").agg(
        F.sum("n").alias("day_n"), F.count("*").alias("day_types"),
        F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("skipped"))
    return per_type.join(per_day, ["user_id", "day"]).select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.col("day").cast("string"), "event_type")
        .alias("session_id"),
        F.concat(F.lit("Channel_"), "event_type").alias("artist"),
        F.concat(F.lit("Track_"), F.col("user_id").cast("string")).alias("track"),
        (F.col("cents") / F.col("n") / 100.0).alias("listen_duration_sec"),
        (F.col("top_cents") / 100.0).alias("track_duration_sec"),
        F.col("skipped").cast("int").alias("skipped"),
        F.col("n").alias("repeat_count"),
        F.hour("first_ts").alias("hour_of_day"),
        F.col("day_n").alias("session_length_tracks"),
        F.col("day_types").alias("unique_tracks_in_session"))


def labels_view(tracks: DataFrame) -> DataFrame:
    """Review labels for every track from the first hex digit of a hash, in mixed case and padding."""
    digit = F.substring(F.md5(F.concat_ws("|", F.lit("42"), "artist", "title")), 1, 1)
    return tracks.select(
        F.when(digit < "4", F.lit(" Bot ")).when(digit < "9", F.lit("LEGIT"))
        .when(digit < "c", F.lit("unsure")).otherwise(F.lit("")).alias("label"),
        "artist", "title", F.lit(0).cast("bigint").alias("flagged_days"), F.lit(0.0).alias("bot_pct"))
