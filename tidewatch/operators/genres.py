"""Genre dimension: assignment from name lists, joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import royalty
from ..functions.text import OTHER_GENRE

# When a name is on several lists the earlier category wins.
PRECEDENCE = ("Latin", "Country", "EDM / Electronic", "R&B / Soul", "Hip Hop / Rap", "Pop")


def assign_genre(artists: DataFrame, names: DataFrame, precedence: tuple[str, ...] = PRECEDENCE) -> DataFrame:
    """Category per artist from a curated (name, category) table; unlisted artists get ``Other``.

    Categories outside ``precedence`` come after it, alphabetically.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col("category"))
    order = F.struct(F.when(place > 0, place).otherwise(F.lit(len(precedence) + 1)).alias("p"), "category")
    best = names.groupBy("name").agg(F.min(order)["category"].alias("_found"))
    joined = artists.join(best, artists["artist"] == best["name"], "left").drop("name")
    category = F.coalesce("_found", F.lit(OTHER_GENRE))
    return joined.withColumns({"genre_category": category, "genres": category}).drop("_found")


def join_genre(artists: DataFrame, genres: DataFrame) -> DataFrame:
    """Add the category (``Other`` when unknown) and the estimated payout of flagged plays."""
    dim = genres.select("artist", "genre_category")
    return artists.join(dim, "artist", "left").withColumns({
        "genre_category": F.coalesce("genre_category", F.lit(OTHER_GENRE)),
        "royalty_lost": royalty(F.col("bot_streams"))})


def genre_counts(genres: DataFrame) -> DataFrame:
    return genres.groupBy("genre_category").agg(F.count("*").alias("artists"))


def artists_in(genres: DataFrame, category: str) -> DataFrame:
    return genres.where(F.col("genre_category") == category).select("artist")
