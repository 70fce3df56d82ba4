"""String expressions on artist names and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COLLAB_PATTERN

# Ordered rules, the first category with a matching substring wins.
GENRE_RULES = (
    ("Hip Hop / Rap", ("hip hop", "rap", "trap")),
    ("Pop", ("pop", "dance pop", "electropop")),
    ("R&B / Soul", ("r&b", "soul", "urban")),
    ("Rock / Alternative", ("rock", "indie", "alternative")),
    ("Latin", ("latin", "reggaeton", "urbano")),
    ("Country", ("country",)),
    ("EDM / Electronic", ("edm", "electronic", "house", "techno")),
)
OTHER_GENRE = "Other"


def strip_space(c: Column) -> Column:
    """Strip every kind of leading and trailing white space (``trim`` only knows blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collab_names(artist: Column, pattern: str = COLLAB_PATTERN) -> Column:
    """Array of the non-empty names in a credit such as ``A & B feat. C``."""
    parts = F.transform(F.split(artist, pattern), strip_space)
    return F.filter(parts, lambda name: F.length(name) > 0)


def normalize_name(artist: Column) -> Column:
    """Drop a trailing parenthetical: ``Group (Member)`` becomes ``Group``."""
    return strip_space(F.regexp_replace(F.coalesce(artist, F.lit("nan")), r"\s*\(.*?\)\s*$", ""))


def genre_from_tags(tags: Column) -> Column:
    """Map a free-text tag string to a broad category."""
    outcome = F.lit(OTHER_GENRE)
    for category, words in reversed(GENRE_RULES):
        hit = reduce(lambda a, b: a | b, [tags.contains(w) for w in words])
        outcome = F.when(hit, F.lit(category)).otherwise(outcome)
    return outcome
