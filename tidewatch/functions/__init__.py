"""Column expressions: everything here stays in the JVM and in whole-stage codegen."""

from .text import collab_names, genre_from_tags, normalize_name, strip_space
from .scores import (
    bot_pct, completion_rate, confidence_score, money, millions, reason_text, risk_band, round_even,
    royalty, present,
)

__all__ = [
    "bot_pct", "collab_names", "completion_rate", "confidence_score", "genre_from_tags",
    "millions", "money", "normalize_name", "present", "reason_text", "risk_band", "round_even", "royalty",
    "strip_space",
]
