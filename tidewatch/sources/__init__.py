"""Readers and sinks."""

from .charts import charts_or_empty, curate_charts, read_charts, region_filter, take_first
from .star_schema import charts_view, genres_view, incidents_view, labels_view, sessions_view
from .tables import (
    incident_table, read_artists, read_genres, read_incidents, read_labels, read_tracks, write_report,
    write_table,
)

__all__ = [
    "charts_or_empty", "charts_view", "curate_charts", "genres_view", "incident_table", "incidents_view",
    "labels_view", "read_artists", "read_charts", "read_genres", "read_incidents", "read_labels",
    "read_tracks", "region_filter", "sessions_view", "take_first", "write_report", "write_table",
]
