"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema, streaming
from tidewatch.config import DEFAULT
from tidewatch.functions import collab_names, genre_from_tags, normalize_name, reason_text, risk_band
from tidewatch.functions.frames import round_columns
from tidewatch.models import detector as detectors, scaler
from tidewatch.models.detector import Detector
from tidewatch.models.iforest import fit_forest, forest_scores
from tidewatch.models.knn import knn_join
from tidewatch.models.lof import collapse, fit_lof, novelty_lof
from tidewatch.operators import (
    confounders, daily as day_ops, genres, inject, labels, leaderboard as board, ranking, rollup, sessions,
    signals,
)
from tidewatch.operators.prefix import running_totals
from tidewatch.operators.quantile import exact_quantiles
from tidewatch.plans import audit, sweeps
from tidewatch.plans.audit import audit_charts, signal_table
from tidewatch.plans.evaluate import evaluate_documented, positive_ranks
from tidewatch.runtime import materialize, new_path
from tidewatch.sources import (
    charts_or_empty, charts_view, curate_charts, genres_view, incidents_view, labels_view, read_artists, read_charts,
    read_genres, read_incidents, read_labels, read_tracks, region_filter, results, sessions_view, take_first,
    write_report, write_table,
)
from tidewatch.sources.charts import drop_missing_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the list-driven rules, in terms of the star's names.
CFG = replace(DEFAULT, holiday_artists=("NATION_3",), death_artists=("NATION_5", "NATION_11"))
# Looser event rules, so that every branch is taken on this data.
EVENT_CFG = replace(CFG, holiday_share=0.2, oneoff_span_days=2000, oneoff_min_flagged=2)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def kept(s: SparkSession, d: str) -> DataFrame:
    return drop_missing_streams(region_filter(charts_view(s, d)))


def daily(s: SparkSession, d: str) -> DataFrame:
    return day_ops.daily_totals(kept(s, d))


def signal_days(s: SparkSession, d: str, mode: str = "retrospective", weekend: bool = False) -> DataFrame:
    return signals.engineer_signals(daily(s, d), mode, weekend, CFG)


def flagged(s: SparkSession, d: str) -> DataFrame:
    released = confounders.release_confounder(signals.stand_in_flags(signal_days(s, d), CFG), CFG)
    return rollup.add_flag_values(released, CFG)


def tracks(s: SparkSession, d: str) -> DataFrame:
    return rollup.track_rollup(flagged(s, d), CFG)


def artists(s: SparkSession, d: str) -> DataFrame:
    return rollup.artist_rollup(flagged(s, d), CFG)


def artist_totals(s: SparkSession, d: str) -> DataFrame:
    return rollup.split_artist_totals(flagged(s, d), CFG)


def genre_artists(s: SparkSession, d: str) -> DataFrame:
    return genres.join_genre(artists(s, d), genres_view(s, d))


TRACK_ROUNDED = ("max_spike_ratio", "avg_rolling_cv")


# ---- sources -------------------------------------------------------------------------------------

@query
def curate_charts_csv(s, d):
    """CSV ingest to curated Parquet and back."""
    raw = new_path(s, "raw") + ".csv"
    charts_view(s, d).withColumn("rank", F.lit(1)).write.option("header", True).csv(raw)
    return curate_charts(s, raw, new_path(s, "curated"))


@query
def curate_all_regions(s, d):
    raw = new_path(s, "raw") + ".csv"
    charts_view(s, d).write.option("header", True).csv(raw)
    return curate_charts(s, raw, new_path(s, "curated"), all_regions=True)


@query
def read_charts_parquet(s, d):
    path = new_path(s, "charts")
    charts_view(s, d).write.parquet(path)
    return read_charts(s, path)


@query
def head_sample(s, d):
    return take_first(kept(s, d), 5000)


@query
def incident_table(s, d):
    return incidents_view(s, d)


@query
def confirmed_incidents(s, d):
    return board.confirmed_incidents(incidents_view(s, d)).select("artist", "streams_removed", "source")


# ---- filters and projections ------------------------------------------------------------------------

@query
def region_filter_default(s, d):
    return region_filter(charts_view(s, d))


@query
def all_regions_filter(s, d):
    return region_filter(charts_view(s, d), all_regions=True)


@query
def drop_null_streams(s, d):
    rows = charts_view(s, d).withColumn("streams", F.nullif("streams", F.lit(7000.0)))
    return drop_missing_streams(rows)


@query
def usable_days(s, d):
    out = signals.usable_days(signals.add_seasonal(signals.track_signals(daily(s, d), cfg=CFG), cfg=CFG))
    return out.groupBy("artist", "title").agg(F.count("*").alias("days"), F.min("date").alias("first_day"),
                                              F.sum("streams").alias("streams"))


@query
def qualify_artists(s, d):
    return rollup.qualify_artists(artist_totals(s, d), CFG).select(
        "artist", "total_streams", "total_days", "years_active")


@query
def leaderboard_filter(s, d):
    rows = board.leaderboard_filter(genre_artists(s, d), None, 1.0, 6e6, 0.5)
    return rows.select("artist", "genre_category", "bot_pct", "total_streams", "confidence")


@query
def leaderboard_of_genre(s, d):
    rows = board.leaderboard_filter(genre_artists(s, d), genre="ASIA", min_streams=1e6)
    return rows.select("artist", "genre_category", "bot_pct", "total_streams", "confidence")


@query
def artist_contains(s, d):
    return board.artist_contains(tracks(s, d), "nation_1").select("artist", "title", "total_streams", "bot_pct")


@query
def verified_incidents(s, d):
    return incidents_view(s, d).where("verified").select("artist", "year", "streams_removed", "legal_action")


@query
def usable_labels(s, d):
    return labels.usable_labels(labels_view(tracks(s, d))).select("label", "artist", "title")


@query
def feature_matrix(s, d):
    out = signals.feature_matrix(signal_days(s, d), "retrospective", ["artist", "title", "date"])
    return round_columns(out, "pct_change", "spike_ratio", "seasonal_spike", "rolling_cv")


@query
def feature_matrix_live(s, d):
    out = signals.feature_matrix(signal_days(s, d, "live"), "live", ["artist", "title", "date"])
    return round_columns(out, "pct_change", "spike_ratio", "seasonal_spike", "rolling_cv")


@query
def presentation_columns(s, d):
    return board.leaderboard(genre_artists(s, d), mask=False).select("Artist", "Genre", "Total Streams", "Bot %", "Note")


# ---- joins -------------------------------------------------------------------------------------------

@query
def weekend_ratio(s, d):
    out = signals.add_weekend_ratio(daily(s, d)).select("artist", "title", "date", "is_weekend", "weekend_ratio")
    return round_columns(out, "weekend_ratio")


@query
def artist_genre_join(s, d):
    return genre_artists(s, d).select("artist", "genre_category", "bot_streams", "royalty_lost")


@query
def label_result_join(s, d):
    """Every label against all tracks; the tracks of every fifth title have changed their name since."""
    t = tracks(s, d)
    renamed = F.when(F.length("title") % 5 == 0, F.concat("title", F.lit(" (remastered)"))).otherwise(F.col("title"))
    return labels.join_labels(labels_view(t), t.withColumn("title", renamed)).select(
        "label", "artist", "title", "flagged_days", "bot_pct")


@query
def assign_genre(s, d):
    """Names listed under several categories: nations by region, brands by the category of their size."""
    part = s.read.parquet(f"{d}/part.parquet")
    size = F.col("p_size") % 4
    listed = part.select(F.col("p_brand").alias("name"),
                         F.when(size == 0, "Pop").when(size == 1, "Country").when(size == 2, "R&B / Soul")
                         .otherwise("Jazz").alias("category"))
    return genres.assign_genre(artist_totals(s, d).select("artist"), listed)


@query
def documented_present(s, d):
    return ranking.documented_present(artists(s, d), incidents_view(s, d))


@query
def documented_absent(s, d):
    return ranking.documented_absent(artists(s, d), incidents_view(s, d))


@query
def positives_with_rank(s, d):
    return positive_ranks(ranking.suspicion_rank(artists(s, d)), incidents_view(s, d))


@query
def tracks_outside_top(s, d):
    t = tracks(s, d)
    top = ranking.top_by(t, "bot_pct", 60, "artist", "title")
    return t.join(top.select("artist", "title"), ["artist", "title"], "left_anti").select("artist", "title", "bot_pct")


@query
def death_spike_adjust(s, d):
    scored = rollup.score_artists(artist_totals(s, d), CFG)
    return confounders.death_spike_adjust(scored, CFG).select("artist", "confidence", "note")


@query
def causality_diff(s, d):
    """Live signals of every day against a run that ends one day earlier."""
    days = daily(s, d)
    past = days.where(F.col("date") < days.agg(F.max("date")).scalar())
    full, part = (signals.add_seasonal(signals.track_signals(x, "live", CFG), "live", CFG) for x in (days, past))
    columns = ["pct_change", "spike_ratio", "rolling_cv", "seasonal_spike"]
    gaps = signals.causality_diff(full, part, columns, tolerance=-1.0)
    return gaps.agg(F.count("*").alias("compared"), F.count_if(F.col("gap") > 1e-9).alias("changed"))


# ---- aggregations --------------------------------------------------------------------------------------

@query
def daily_streams(s, d):
    return daily(s, d)


@query
def track_rollup(s, d):
    return round_columns(tracks(s, d), *TRACK_ROUNDED)


@query
def artist_rollup(s, d):
    return round_columns(artists(s, d), "max_spike_ratio")


@query
def artist_rollup_event_rules(s, d):
    out = rollup.artist_rollup(flagged(s, d), EVENT_CFG)
    return round_columns(out, "max_spike_ratio")


@query
def years_active(s, d):
    return artist_totals(s, d).select("artist", "years_active")


@query
def activity_span(s, d):
    return artist_totals(s, d).select("artist", "first_active", "last_active", "first_flag", "last_flag")


@query
def month_mean(s, d):
    return round_columns(signals.month_means(daily(s, d)), "month_avg")


@query
def genre_counts(s, d):
    return genres.genre_counts(genre_artists(s, d))


@query
def artists_of_genre(s, d):
    return genres.artists_in(genre_artists(s, d), "EUROPE")


@query
def dashboard_kpis(s, d):
    return round_columns(board.dashboard_kpis(genre_artists(s, d)), "avg_bot_pct")


@query
def royalty_summary(s, d):
    return round_columns(board.royalty_summary(genre_artists(s, d)), "avg_royalty_lost")


@query
def artist_timeline(s, d):
    return board.artist_timeline(kept(s, d), "NATION_7")


@query
def incident_summary(s, d):
    return board.incident_summary(incidents_view(s, d))


@query
def session_artist_stats(s, d):
    """Shares per artist with a rule in place of the model."""
    rows = sessions.session_features(sessions_view(s, d))
    rule = (F.col("odd_hour") == 1) | (F.col("completion_rate") > 0.9) & (F.col("repeat_count") > 1)
    return sessions.session_artist_stats(rows.withColumn("is_bot", rule.cast("int")))


@query
def streams_by_hour(s, d):
    return sessions.streams_by_hour(sessions_view(s, d))


@query
def completion_histogram(s, d):
    rows = sessions.session_features(sessions_view(s, d))
    return round_columns(sessions.equal_width_histogram(rows, F.col("completion_rate"), 50), "left_edge", "right_edge")


@query
def repeat_histogram(s, d):
    clipped = F.least(F.col("repeat_count"), F.lit(30))
    return round_columns(sessions.equal_width_histogram(sessions_view(s, d), clipped, 30), "left_edge", "right_edge")


@query
def confusion_metrics(s, d):
    t = tracks(s, d)
    return labels.confusion_metrics(labels.join_labels(labels_view(t), t))


@query
def flagged_fraction(s, d):
    return round_columns(inject.flagged_fraction(tracks(s, d)), "flagged_fraction")


@query
def injection_metrics(s, d):
    planted = inject.inject(daily(s, d), n_tracks=300, boost=5.0, pattern="spike")
    scored = signals.stand_in_flags(signals.engineer_signals(planted, cfg=CFG), CFG)
    return inject.injection_metrics(scored)


@query
def roc_auc(s, d):
    marked = tracks(s, d).withColumn("hot", F.col("max_spike_ratio") > 3)
    return ranking.roc_auc(marked, F.col("hot"), F.col("bot_pct"), digits=6)


@query
def roc_auc_of_raw_scores(s, d):
    """Scores with about as many values as there are days, in ranges of a few thousand."""
    days = signal_days(s, d)
    return ranking.roc_auc(days, F.col("drop_after_spike") == 1, F.col("spike_ratio"), digits=6, every=1 << 12)


@query
def scaler_stats(s, d):
    out = scaler.scaler_frame(signals.feature_matrix(signal_days(s, d)), signals.features_for("retrospective"))
    return round_columns(out, "mean", "scale")


@query
def score_quantile(s, d):
    sig = materialize(signal_days(s, d).select("spike_ratio"), "scores")
    probs = [0.01, 0.02, 0.05, 0.5, 0.98]
    found = exact_quantiles(sig, "spike_ratio", probs)
    out = s.createDataFrame(list(zip(probs, found)), "probability double, threshold double")
    return round_columns(out, "threshold")


@query
def best_per_name(s, d):
    renamed = incidents_view(s, d).select("artist", "year", F.coalesce("streams_removed", F.lit(0.0)).alias("score"))
    return ranking.best_per_name(renamed, "score")


# ---- windows ---------------------------------------------------------------------------------------------

@query
def velocity(s, d):
    out = signals.add_velocity(daily(s, d), CFG).select(
        "artist", "title", "date", "prev_streams", "pct_change", "rolling_7d_avg", "spike_ratio")
    return round_columns(out, "pct_change", "rolling_7d_avg", "spike_ratio")


@query
def plateau_cv(s, d):
    out = signals.add_plateau(signals.add_velocity(daily(s, d), CFG), CFG)
    return round_columns(out.select("artist", "title", "date", "rolling_std", "rolling_cv"), "rolling_std", "rolling_cv")


@query
def drop_after_spike(s, d):
    return signals.track_signals(daily(s, d), cfg=CFG).select("artist", "title", "date", "drop_after_spike")


@query
def seasonal_retrospective(s, d):
    out = signals.add_seasonal(daily(s, d), "retrospective", CFG)
    return round_columns(out.select("artist", "title", "date", "seasonal_spike"), "seasonal_spike")


@query
def seasonal_live(s, d):
    # small pieces, so that the split path runs
    out = signals.add_seasonal(daily(s, d), "live", replace(CFG, prefix_rows=1 << 12))
    return round_columns(out.select("artist", "title", "date", "seasonal_spike"), "seasonal_spike")


@query
def suspicion_rank(s, d):
    out = ranking.suspicion_rank(artists(s, d)).select("artist", "bot_pct", "rank", "percentile")
    return round_columns(out, "percentile")


@query
def track_suspicion_rank(s, d):
    """Rank of every track by score, with the split path."""
    rows = tracks(s, d).select(F.concat_ws("|", "artist", "title").alias("name"), "bot_pct")
    out = running_totals(rows, [], "bot_pct", "name", F.lit(1.0), descending=True, every=64)
    return out.select("name", "bot_pct", F.col("run_count").alias("rank"))


@query
def timeline_spikes(s, d):
    out = board.timeline_spikes(board.artist_timeline(kept(s, d), "NATION_7"), CFG)
    return round_columns(out, "rolling_avg", "threshold")


# ---- sort, limit, sampling ----------------------------------------------------------------------------------

@query
def top_suspicious(s, d):
    return ranking.top_by(artists(s, d), "bot_pct", 10).select("artist", "total_streams", "bot_pct", "confidence", "flag_reasons")


@query
def top_per_genre(s, d):
    return ranking.top_per_genre(genre_artists(s, d)).select("genre_category", "artist", "bot_pct", "place")


@query
def top_tracks_of_artist(s, d):
    return board.top_tracks_of(tracks(s, d), "Nation_2").select("artist", "title", "bot_pct")


@query
def top_royalty(s, d):
    return board.top_royalty(genre_artists(s, d)).select("artist", "bot_streams", "royalty_lost")


@query
def control_sample(s, d):
    return labels.control_sample(tracks(s, d), 40).select("artist", "title", "bot_pct")


@query
def review_sheet(s, d):
    return labels.review_sheet(materialize(tracks(s, d), "tracks"))


# ---- expressions ------------------------------------------------------------------------------------------------

@query
def collab_split(s, d):
    names = kept(s, d).select(F.explode(collab_names(F.col("artist"))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"))


@query
def collab_split_of_documents(s, d):
    """The literal separators on whole texts, where they also cut inside words."""
    text = s.read.parquet(f"{d}/documents.parquet")
    return text.select("doc_id", F.size(collab_names(F.col("text"))).alias("parts"))


@query
def normalize_names(s, d):
    return incidents_view(s, d).select("artist", normalize_name(F.col("artist")).alias("name"))


@query
def confidence_score(s, d):
    return tracks(s, d).select("artist", "title", "confidence", risk_band(F.col("confidence")).alias("band"))


@query
def flag_reasons(s, d):
    counts = flagged(s, d).groupBy("artist", "year").agg(*[F.sum(c).alias(c) for c in rollup.REASON_COLUMNS])
    return counts.withColumn("flag_reasons", reason_text())


@query
def reason_day_flags(s, d):
    return flagged(s, d).select("artist", "title", "date", "ensemble_bot", *rollup.REASON_COLUMNS)


@query
def royalty_impact(s, d):
    return board.with_royalty(tracks(s, d), CFG).select("artist", "title", "bot_pct", "royalty_lost")


@query
def holiday_window(s, d):
    return flagged(s, d).select("artist", "title", "date", "holiday_window", "holiday_flag", "holiday_bot_stream_val")


@query
def session_features(s, d):
    out = sessions.session_features(sessions_view(s, d)).select("session_id", *sessions.SESSION_FEATURES)
    return round_columns(out, "completion_rate", "session_diversity")


@query
def genre_from_tags_of_documents(s, d):
    text = s.read.parquet(f"{d}/documents.parquet")
    return text.select("doc_id", genre_from_tags(F.lower("text")).alias("genre_category"))


@query
def risk_bands(s, d):
    return artists(s, d).select("artist", risk_band(F.col("confidence")).alias("band"),
                                (F.col("bot_pct") > 10).cast("int").alias("high_risk"))


@query
def display_formats(s, d):
    return board.royalty_display(genre_artists(s, d))


@query
def incident_badges(s, d):
    return board.incident_badges(incidents_view(s, d))


# ---- confounders and composed -------------------------------------------------------------------------------

@query
def release_confounder(s, d):
    out = confounders.release_confounder(signals.stand_in_flags(signal_days(s, d), CFG), CFG)
    return out.select("artist", "title", "date", "ensemble_bot", "release_adjusted")


@query
def holiday_confounder(s, d):
    scored = confounders.death_spike_adjust(rollup.score_artists(artist_totals(s, d), EVENT_CFG), EVENT_CFG)
    return confounders.holiday_confounder(scored, EVENT_CFG).select(
        "artist", "bot_streams", "bot_pct", "confidence", "note", "holiday_flag_share")


@query
def oneoff_confounder(s, d):
    scored = confounders.death_spike_adjust(rollup.score_artists(artist_totals(s, d), EVENT_CFG), EVENT_CFG)
    return confounders.oneoff_confounder(scored, EVENT_CFG).select(
        "artist", "bot_streams", "bot_pct", "confidence", "note", "flagged_span_days")


@query
def engineer_signals(s, d):
    out = signal_days(s, d, weekend=True).drop("prev_streams", "rolling_std")
    return round_columns(out, "rolling_7d_avg", "pct_change", "spike_ratio", "rolling_cv", "seasonal_spike", "weekend_ratio")


def flat_report(report: DataFrame) -> DataFrame:
    """All of a report, its lists as text."""
    row = F.transform("positives", lambda p: F.concat_ws("|", p["artist"], p["rank"].cast("string"), F.format_string("%.1f", p["percentile"]),
                                                         F.format_string("%.1f", p["bot_pct"]), F.format_string("%.1f", p["confidence"])))
    return report.withColumns({"positives": F.array_join(row, ";"), "documented_absent": F.array_join("documented_absent", ";")})


@query
def evaluate_documented_report(s, d):
    return flat_report(evaluate_documented(artists(s, d), incidents_view(s, d)))


@query
def evaluate_by_confidence(s, d):
    return flat_report(evaluate_documented(artists(s, d), incidents_view(s, d), "confidence"))


@query
def label_score(s, d):
    t = materialize(tracks(s, d), "tracks")
    return labels.label_score(labels_view(t), t)


@query
def mask_low_confidence(s, d):
    return board.mask_low_confidence(artists(s, d), 2.0, cfg=replace(CFG, prefix_rows=4)).select("artist", "bot_pct", "confidence")


@query
def leaderboard(s, d):
    return board.leaderboard(materialize(genre_artists(s, d), "artists"), reveal=1.5, min_bot_pct=0.1)


@query
def inject_spike(s, d):
    return round_columns(inject.inject(daily(s, d), 300, 5, 5.0, pattern="spike"), "streams")


@query
def inject_plateau(s, d):
    return round_columns(inject.inject(daily(s, d), 300, 5, 3.0, pattern="plateau"), "streams")


# ---- models ----------------------------------------------------------------------------------------------------

def vectors(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def fitted(s: SparkSession, d: str, mode: str = "retrospective"):
    """A detector trained on the signals of the chart view, and its flagged rows."""
    detector = Detector.of(CFG)
    flags = detector.fit_flag(signal_table(kept(s, d), mode, CFG), signals.features_for(mode))
    return detector, flags


@query
def knn_embeddings(s, d):
    points = collapse(vectors(s, d), id_col="id")
    lists = knn_join(points, points, 10, True, cell_rows=100)
    return lists.select("id", F.posexplode("ids").alias("pos", "neighbor"), "dists").select(
        "id", (F.col("pos") + 1).alias("rank"), "neighbor", F.round(F.get("dists", "pos"), 6).alias("distance"))


def part_points(s: SparkSession, d: str) -> DataFrame:
    """All parts by size and price: few dimensions, so cells are left out by their bounds. Parts with equal values count as one point."""
    part = s.read.parquet(f"{d}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") * F.lit(20.0), F.col("p_retailprice")).alias("vec"))


@query
def knn_features(s, d):
    """Cells of about 32 points, eight to a level, so several levels deep."""
    points = materialize(collapse(part_points(s, d), id_col="id").withColumn("weight", F.lit(1).cast("bigint")), "points")
    lists = knn_join(points, points, 10, True, cell_rows=32, fanout=8)
    return lists.select("id", F.posexplode("ids").alias("pos", "neighbor"), "dists").select(
        "id", (F.col("pos") + 1).alias("rank"), "neighbor", F.round(F.get("dists", "pos"), 6).alias("distance"))


@query
def lof_features(s, d):
    points = materialize(collapse(part_points(s, d), id_col="id").withColumn("weight", F.lit(1).cast("bigint")), "points")
    return fit_lof(points, 20, cell_rows=64).select("id", F.round("lof", 6).alias("lof"))


@query
def lof_embeddings(s, d):
    out = fit_lof(collapse(vectors(s, d), id_col="id"), 20, cell_rows=100)
    return out.select("id", F.round("lof", 6).alias("lof"))


@query
def lof_novelty_embeddings(s, d):
    """Every vector read backwards, as a new point against all vectors."""
    reference = fit_lof(collapse(vectors(s, d), id_col="id"), 20, cell_rows=100)
    new = vectors(s, d).withColumn("vec", F.reverse("vec"))
    return novelty_lof(materialize(new, "new"), materialize(reference, "reference"), 20, cell_rows=100).select(
        "id", F.round("lof", 6).alias("lof"))


@query
def standardize(s, d):
    sig = materialize(signals.feature_matrix(signal_days(s, d), keep=["artist", "title", "date"]), "features")
    names = signals.features_for("retrospective")
    out = scaler.standardize(sig, scaler.fit_scaler(sig, names))
    return out.select("artist", "title", "date", *[F.round(F.get("vec", F.lit(i)), 6).alias(f"z_{n}")
                                                   for i, n in enumerate(names)])


@query
def ensemble_flags(s, d):
    """Two rule-based votes in place of the models."""
    votes = signal_days(s, d).select("artist", "title", "date",
                                     (F.col("seasonal_spike") > 1.8).cast("int").alias("iso_bot"),
                                     (F.col("spike_ratio") > 1.8).cast("int").alias("lof_bot"))
    return detectors.ensemble_flags(votes)


@query
def iforest_nodes(s, d):
    sig = materialize(signal_days(s, d), "signals")
    names = signals.features_for("retrospective")
    scaled = scaler.standardize(sig, scaler.fit_scaler(sig, names)).select("artist", "title", "date", "vec")
    return s.createDataFrame(fit_forest(scaled).nodes).withColumn("split", F.round("split", 6))


@query
def iforest_scores(s, d):
    sig = materialize(signal_days(s, d), "signals")
    names = signals.features_for("retrospective")
    scaled = scaler.standardize(sig, scaler.fit_scaler(sig, names)).select("artist", "title", "date", "vec")
    return round_columns(forest_scores(scaled, fit_forest(scaled)).drop("vec"), "iso_score")


@query
def detector_fit(s, d):
    _, flags = fitted(s, d)
    return flags.select("artist", "title", "date", "iso_score", "lof_score", "iso_bot", "lof_bot", "ensemble_bot")


@query
def detector_save_load(s, d):
    """Save, load, and score live signals of the same table as new rows."""
    detector, _ = fitted(s, d, "live")
    path = new_path(s, "model")
    detector.save(s, path)
    rows = materialize(signal_days(s, d, "live"), "signals")
    return Detector.load(s, path).transform(rows).select("artist", "title", "date", "iso_bot", "lof_bot", "ensemble_bot")


@query
def full_audit_artists(s, d):
    return audit_charts(kept(s, d), cfg=CFG).artists


@query
def full_audit_tracks(s, d):
    return audit_charts(kept(s, d), cfg=CFG).tracks


@query
def incremental_score(s, d):
    """Train on the days before 2000, score the later ones with the earlier as history."""
    charts = materialize(kept(s, d), "charts")
    past = charts.where(F.col("date") < "2000-01-01")
    detector = audit_charts(past, cfg=CFG).detector
    out = audit.incremental_score(charts.where(F.col("date") >= "2000-01-01"), detector, history=past, cfg=CFG)
    return out.select("artist", "title", "date", "iso_bot", "lof_bot", "ensemble_bot")


@query
def session_anomaly(s, d):
    out = sessions.session_anomaly(sessions_view(s, d)).select("session_id", "artist", "anomaly_score", "is_bot")
    return round_columns(out, "anomaly_score")


@query
def session_anomaly_stats(s, d):
    return sessions.session_artist_stats(sessions.session_anomaly(sessions_view(s, d)))


@query
def boost_sweep(s, d):
    return sweeps.boost_sweep(daily(s, d), cfg=CFG)


@query
def contamination_sweep(s, d):
    return sweeps.contamination_sweep(daily(s, d), cfg=CFG)


@query
def contamination_tune(s, d):
    return sweeps.contamination_tune(kept(s, d), incidents_view(s, d), cfg=CFG)


# ---- sinks and typed reads ---------------------------------------------------------------------------------------

@query
def first_existing_source(s, d):
    """The first path does not exist, the second is read."""
    path = new_path(s, "charts")
    charts_view(s, d).write.parquet(f"{path}/second")
    return charts_or_empty(s, [f"{path}/first", f"{path}/second"])


@query
def published_results(s, d):
    """Tracks and artists as one set, published twice; the tracks of the current set."""
    out, found = new_path(s, "results"), tracks(s, d)
    for _ in range(2):
        results.publish(s, out, {"tracks": found, "artists": artists(s, d)})
    return round_columns(read_tracks(s, f"{results.current(s, out)}/tracks"), *TRACK_ROUNDED)


@query
def artists_csv(s, d):
    path = f"{new_path(s, 'artists')}.csv"
    write_table(artists(s, d), path)
    return round_columns(read_artists(s, path), "max_spike_ratio")


@query
def labels_csv(s, d):
    """Labels keep their padding on the way through a file; an empty one is NULL."""
    path = f"{new_path(s, 'labels')}.csv"
    write_table(labels_view(tracks(s, d)), path)
    return read_labels(s, path).select("label", "artist", "title")


@query
def genres_csv(s, d):
    path = f"{new_path(s, 'genres')}.csv"
    write_table(genres_view(s, d), path)
    return read_genres(s, path)


@query
def incidents_csv(s, d):
    path = f"{new_path(s, 'incidents')}.csv"
    write_table(incidents_view(s, d), path)
    return read_incidents(s, path)


@query
def sweep_csv(s, d):
    """Metrics of two injected patterns, written as a sweep's table."""
    rows = None
    for pattern, boost in (("spike", 5.0), ("plateau", 3.0)):
        injected = inject.inject(daily(s, d), 300, 5, boost, pattern=pattern)
        row = inject.injection_metrics(signals.stand_in_flags(signals.engineer_signals(injected, cfg=CFG), CFG)).withColumn("pattern", F.lit(pattern))
        rows = row if rows is None else rows.unionByName(row)
    return sweeps.write_sweep(rows, f"{new_path(s, 'sweep')}.csv")


@query
def report_json(s, d):
    """A report file; the second report is not to be written and leaves it alone."""
    path = new_path(s, "report")
    report = evaluate_documented(artists(s, d), incidents_view(s, d))
    write_report(report, path)
    write_report(report.where("false"), path, write=False)
    return flat_report(s.read.schema(report.schema).json(path))


@query
def review_sheet_of_few_columns(s, d):
    """A track table without confidence, reasons and notes: these are blank."""
    return labels.review_sheet(tracks(s, d).drop("confidence", "flag_reasons", "note"))


# ---- streaming ---------------------------------------------------------------------------------------------------

def chart_stream(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "stream")
    kept(s, d).write.parquet(path)
    return s.readStream.schema(schema.CHARTS).parquet(path)


@query
def live_daily(s, d):
    """A stream of all chart rows, drained; the two newest days stay open behind the watermark."""
    out = new_path(s, "live")
    running = (streaming.live_daily(chart_stream(s, d)).writeStream.outputMode("append").format("parquet")
               .option("path", f"{out}/days").option("checkpointLocation", f"{out}/query")
               .trigger(availableNow=True).start())
    running.awaitTermination()
    return s.read.parquet(f"{out}/days")


@query
def live_signals(s, d):
    """The causal signals of every closed day, from the streaming job."""
    job = streaming.LiveScorer(s, new_path(s, "live"), cfg=CFG)
    job.start(chart_stream(s, d), availableNow=True).awaitTermination()
    out = job.scored().select("artist", "title", "date", *signals.SIGNALS)
    return round_columns(out, *signals.SIGNALS)


@query
def live_score(s, d):
    """Streaming flags with a detector trained on the live signals of the same charts."""
    detector, _ = fitted(s, d, "live")
    job = streaming.LiveScorer(s, new_path(s, "live"), detector, CFG)
    job.start(chart_stream(s, d), availableNow=True).awaitTermination()
    return job.scored().select("artist", "title", "date", "iso_bot", "lof_bot", "ensemble_bot")
