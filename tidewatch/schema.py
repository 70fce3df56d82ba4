"""Explicit schemas of every table that is read; nothing is inferred."""

from pyspark.sql import types as T

S, D, I, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols])


CHARTS = _struct(("title", S), ("date", T.DateType()), ("artist", S), ("region", S), ("streams", D))

TRACK_RESULTS = _struct(
    ("artist", S), ("title", S), ("total_streams", D), ("bot_streams", D), ("flagged_days", T.LongType()),
    ("total_days", T.LongType()), ("max_spike_ratio", D), ("avg_rolling_cv", D),
    ("drop_after_spike_count", D), ("bot_pct", D), ("confidence", D), ("flag_reasons", S), ("note", S),
)

ARTIST_RESULTS = _struct(
    ("artist", S), ("total_streams", D), ("bot_streams", D), ("flagged_days", T.LongType()),
    ("total_days", T.LongType()), ("years_active", T.LongType()), ("max_spike_ratio", D), ("drop_events", D),
    ("bot_pct", D), ("confidence", D), ("flag_reasons", S), ("note", S),
    ("holiday_flag_share", D), ("flagged_span_days", I),
)

INCIDENTS = _struct(
    ("artist", S), ("streams_removed", D), ("incident", S), ("source", S), ("label", S),
    ("year", I), ("verified", B), ("legal_action", B),
)

GENRES = _struct(("artist", S), ("genre_category", S), ("genres", S))

LABELS = _struct(
    ("label", S), ("artist", S), ("title", S), ("total_streams", D), ("bot_pct", D), ("confidence", D),
    ("flagged_days", T.LongType()), ("flag_reasons", S), ("note", S),
)

SESSIONS = _struct(
    ("session_id", S), ("artist", S), ("track", S), ("listen_duration_sec", D), ("track_duration_sec", D),
    ("skipped", I), ("repeat_count", T.LongType()), ("hour_of_day", I),
    ("session_length_tracks", T.LongType()), ("unique_tracks_in_session", T.LongType()),
)
