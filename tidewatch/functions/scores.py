"""Numeric expressions: rounding, shares, confidence, reasons and display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, NO_REASON, REASONS, AuditConfig


def round_even(c: Column, digits: int = 0) -> Column:
    """Round half to even by scale, rint and unscale; never needs decimals."""
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


def present(c: Column) -> Column:
    """True when a double holds a number: not NULL and not NaN."""
    return c.isNotNull() & ~F.isnan(c)


def bot_pct(bot: Column, total: Column) -> Column:
    return round_even(F.try_divide(bot, total) * 100.0, 1)


def royalty(bot: Column, rate: float = DEFAULT.payout_per_stream) -> Column:
    return round_even(bot * rate, 0)


def _clip(c: Column, low: float, high: float) -> Column:
    # least/greatest skip NULLs, so the missing case is kept apart
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def confidence_score(flagged: Column, days: Column, spike: Column, drops: Column,
                     cfg: AuditConfig = DEFAULT) -> Column:
    """0-100: share of flagged days, height of the largest spike, frequency of drops."""
    days = F.greatest(days, F.lit(1)).cast("double")
    raw = (flagged / days * cfg.weight_flagged
           + _clip(spike, 0.0, cfg.spike_cap) / cfg.spike_cap * cfg.weight_spike
           + drops / days * cfg.weight_drop)
    return round_even(_clip(raw, 0.0, 100.0), 1)


def reason_text(counts: Sequence[tuple[str, str]] = REASONS, top: int = 3) -> Column:
    """The most frequent reasons, ties in their fixed order, as one readable string."""
    entries = F.array(*[
        F.struct((-F.col(col).cast("long")).alias("n"), F.lit(i).alias("pos"), F.lit(label).alias("label"))
        for i, (col, label) in enumerate(counts)
    ])
    fired = F.array_sort(F.filter(entries, lambda e: e["n"] < 0))
    text = F.array_join(F.transform(F.slice(fired, 1, top), lambda e: e["label"]), ", ")
    return F.when(F.size(fired) > 0, text).otherwise(F.lit(NO_REASON))


def risk_band(confidence: Column) -> Column:
    return F.when(confidence > 60, "high").when(confidence > 30, "medium").otherwise("low")


def completion_rate(listened: Column, length: Column) -> Column:
    return _clip(F.try_divide(listened, length), 0.0, 1.0)


def money(c: Column) -> Column:
    """``$12,345``"""
    return F.concat(F.lit("$"), F.format_number(c, 0))


def millions(c: Column, digits: int = 1) -> Column:
    """``12.3M``"""
    return F.concat(round_even(c / 1e6, digits).cast("string"), F.lit("M"))
