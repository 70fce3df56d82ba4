"""The whole audit, and scoring of new rows with a saved model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig, features_for
from ..models.detector import Detector
from ..operators.confounders import release_confounder
from ..operators.daily import daily_totals
from ..operators.rollup import add_flag_values, artist_rollup, track_rollup
from ..operators.signals import engineer_signals
from ..runtime import materialize
from ..sources.charts import read_charts
from ..sources.results import publish


@dataclass
class Audit:
    days: DataFrame
    tracks: DataFrame
    artists: DataFrame
    detector: Detector


def signal_table(charts: DataFrame, mode: str, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Usable days with signals, written once: scaler, forest, neighbours and flags all read it."""
    return materialize(engineer_signals(daily_totals(charts), mode, cfg=cfg), "signals")


def flagged_days(raw_flags: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Model flags to final flags and the values the roll-ups sum."""
    return add_flag_values(release_confounder(raw_flags, cfg), cfg)


def audit_charts(charts: DataFrame, mode: str = "retrospective", cfg: AuditConfig = DEFAULT,
                 detector: Detector | None = None) -> Audit:
    """Signals, models, confounders and roll-ups over filtered chart rows."""
    detector = detector or Detector.of(cfg)
    raw = detector.fit_flag(signal_table(charts, mode, cfg), features_for(mode))
    days = materialize(flagged_days(raw, cfg), "flagged")
    return Audit(days, track_rollup(days, cfg), artist_rollup(days, cfg), detector)


def run_audit(spark: SparkSession, data: str, out: str, mode: str = "retrospective", sample: int | None = None,
              all_regions: bool = False, save_model: bool = True, cfg: AuditConfig = DEFAULT) -> Audit:
    """Read, audit, and publish the track and artist tables and, if wanted, the model as one set.

    ``tidewatch.sources.results.current(spark, out)`` is the folder of the set that was published last; it holds ``tracks``,
    ``artists`` and ``model``. A run that is lost on the way leaves the earlier set in place.
    """
    charts = read_charts(spark, data, sample, all_regions, cfg.regions)
    audit = audit_charts(charts, mode, cfg)
    model = {"model": lambda path: audit.detector.save(spark, path)} if save_model else {}
    publish(spark, out, {"tracks": audit.tracks, "artists": audit.artists}, model)
    return audit


def incremental_score(charts: DataFrame, detector: Detector, mode: str | None = None,
                      history: DataFrame | None = None, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Flag new chart rows with a trained detector, without refitting and without confounders.

    Windows need earlier days: alone, the first two days of a track have no signal. ``history`` (chart
    rows before the new ones) supplies them; only days of the new rows are returned.
    """
    mode = mode or detector.mode
    daily = daily_totals(charts)
    if history is None:
        return detector.transform(materialize(engineer_signals(daily, mode, cfg=cfg), "signals"))
    both = daily_totals(history).withColumn("_new", F.lit(False)).unionByName(daily.withColumn("_new", F.lit(True)))
    days = engineer_signals(both, mode, cfg=cfg).where("_new").drop("_new")
    return detector.transform(materialize(days, "signals"))
