"""Per-track time-series signals. A missing signal is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MODES, AuditConfig, features_for
from .daily import KEYS
from .prefix import running_totals

SIGNALS = ["pct_change", "spike_ratio", "seasonal_spike", "rolling_cv"]
def track_order():
    return Window.partitionBy(*KEYS).orderBy("date")


def _ratio(top: Column, bottom: Column) -> Column:
    return top / F.when(bottom != 0, bottom)


def _trailing(cfg: AuditConfig):
    return track_order().rowsBetween(1 - cfg.rolling_rows, 0)


def add_velocity(daily: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Day-over-day change and the ratio to the mean of the last rows (rows, not calendar days)."""
    return daily.select("*", F.lag("streams").over(track_order()).alias("prev_streams"),
                        F.avg("streams").over(_trailing(cfg)).alias("rolling_7d_avg")
                        ).withColumns({
                            "pct_change": _ratio(F.col("streams"), F.col("prev_streams")) - 1,
                            "spike_ratio": _ratio(F.col("streams"), F.col("rolling_7d_avg"))})


def add_plateau(daily: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Coefficient of variation of the last rows; automated plays run unnaturally flat."""
    frame = _trailing(cfg)
    std = F.when(F.count("streams").over(frame) >= cfg.std_min_rows, F.stddev_samp("streams").over(frame))
    return (daily.withColumn("rolling_std", std)
            .withColumn("rolling_cv", _ratio(F.col("rolling_std"), F.col("rolling_7d_avg"))))


def add_drop_after_spike(daily: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """1.0 on a spike whose next row falls below the trailing mean. Looks ahead: retrospective only."""
    fell = F.lead("streams").over(track_order()) < F.col("rolling_7d_avg")
    hit = (F.col("spike_ratio") > cfg.spike_flag) & fell
    return daily.withColumn("drop_after_spike", F.coalesce(hit, F.lit(False)).cast("double"))


def month_means(daily: DataFrame) -> DataFrame:
    """Mean plays per artist and calendar month over all years."""
    return daily.groupBy("artist", "month").agg(F.avg("streams").alias("month_avg"))


def add_seasonal(daily: DataFrame, mode: str = "retrospective", cfg: AuditConfig = DEFAULT,
                 month_base: DataFrame | None = None) -> DataFrame:
    """Plays relative to the artist's mean for the month.

    Retrospective: the full mean, aggregated (combined before its shuffle) and joined back; an artist
    with very many rows is a skewed but splittable side of that join. Live: the mean of everything up
    to the row in the order date, title, through :func:`running_totals`, so no artist has to fit into
    one task. ``month_base`` (artist, month, base_sum, base_count) holds totals of earlier runs.
    """
    if mode == "retrospective":
        means = month_means(daily).withColumnsRenamed({"artist": "_artist", "month": "_month"})
        # a null-safe match on the month adds no filter below the daily sum, whose shuffle is then shared
        joined = daily.join(means, (F.col("artist") == F.col("_artist")) & F.col("month").eqNullSafe(F.col("_month")))
        return (joined.withColumn("seasonal_spike", _ratio(F.col("streams"), F.col("month_avg")))
                .drop("_artist", "_month", "month_avg"))
    run = running_totals(daily, ["artist", "month"], "date", "title", "streams", every=cfg.prefix_rows)
    total, count = F.col("run_sum"), F.col("run_count")
    if month_base is not None:
        run = run.join(month_base, ["artist", "month"], "left")
        total = total + F.coalesce("base_sum", F.lit(0.0))
        count = count + F.coalesce("base_count", F.lit(0))
    out = run.withColumn("seasonal_spike", _ratio(F.col("streams"), total / count))
    return out.drop("run_sum", "run_count", "base_sum", "base_count")


def add_weekend_ratio(daily: DataFrame) -> DataFrame:
    """Mean weekend plays over mean weekday plays plus one; 0 when a track lacks either kind of day."""
    weekend = F.col("day_of_week") >= 5
    whole = Window.partitionBy(*KEYS)
    ratio = (F.avg(F.when(weekend, F.col("streams"))).over(whole)
             / (F.avg(F.when(~weekend, F.col("streams"))).over(whole) + 1))
    return daily.select("*", weekend.cast("int").alias("is_weekend"),
                        F.coalesce(ratio, F.lit(0.0)).alias("weekend_ratio"))


def track_signals(daily: DataFrame, mode: str = "retrospective", cfg: AuditConfig = DEFAULT) -> DataFrame:
    """All windows over one track. They share one partitioning and one sort."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    out = add_plateau(add_velocity(daily, cfg), cfg)
    if mode == "retrospective":
        return add_drop_after_spike(out, cfg)
    return out.withColumn("drop_after_spike", F.lit(0.0))


def usable_days(signals: DataFrame) -> DataFrame:
    return signals.na.drop(subset=SIGNALS)


def engineer_signals(daily: DataFrame, mode: str = "retrospective", weekend: bool = False,
                     cfg: AuditConfig = DEFAULT) -> DataFrame:
    """The full signal stack of a mode, without the days on which a signal is undefined."""
    out = track_signals(daily, mode, cfg)
    if weekend:
        out = add_weekend_ratio(out)
    return usable_days(add_seasonal(out, mode, cfg))


def clean_number(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def feature_matrix(signals: DataFrame, mode: str = "retrospective", keep: list[str] | None = None) -> DataFrame:
    """Model features in their fixed order with missing and infinite values as 0, after the ``keep`` columns."""
    return signals.select(*(keep or []), *[clean_number(F.col(f)).alias(f) for f in features_for(mode)])


def stand_in_flags(signals: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """A rule-based ``ensemble_bot``: lets everything after the models run, and be checked, without them."""
    hit = (F.col("spike_ratio") > cfg.spike_flag) | F.col("rolling_cv").between(1e-9, cfg.low_cv)
    return signals.withColumn("ensemble_bot", hit.cast("int"))


def causality_diff(full: DataFrame, part: DataFrame, columns: list[str] | None = None,
                   tolerance: float = 1e-9) -> DataFrame:
    """Days of a truncated run whose signals differ from the full run; empty when no signal looks ahead."""
    columns = columns or SIGNALS
    a, b = full.alias("a"), part.alias("b")
    keys = [*KEYS, "date"]
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    gap = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns])
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], gap.alias("gap")).where(F.col("gap") > tolerance)
