"""Structured Streaming jobs on the same operators as the batch audit."""

from .live import LiveScorer, live_daily, live_tracks

__all__ = ["LiveScorer", "live_daily", "live_tracks"]
