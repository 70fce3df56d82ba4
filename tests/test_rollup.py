from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import day
from tidewatch.config import DEATH_SPIKE_NOTE, DEFAULT, HOLIDAY_NOTE, ONEOFF_NOTE, RELEASE_NOTE
from tidewatch.config import COLLAB_PATTERN_STRICT
from tidewatch.functions import (
    collab_names, confidence_score, genre_from_tags, normalize_name, reason_text, risk_band, round_even,
)
from tidewatch.operators import confounders, genres, rollup


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_collab_split(spark):
    rows = [("Drake & Future",), ("Post Malone, Swae Lee",), ("SZA feat. Kendrick",), ("A ft. B",), ("\tA ,, ",),
            ("Daft Punk",), ("Taylor Swift",)]
    got = values(spark, collab_names(F.col("a")), rows, "a string")
    assert got == [["Drake", "Future"], ["Post Malone", "Swae Lee"], ["SZA", "Kendrick"], ["A", "B"], ["A"],
                   ["Da", "Punk"], ["Taylor Swi"]]
    strict = values(spark, collab_names(F.col("a"), COLLAB_PATTERN_STRICT), rows, "a string")
    assert strict[2:4] == [["SZA", "Kendrick"], ["A", "B"]] and strict[5:] == [["Daft Punk"], ["Taylor Swift"]]


def test_normalize_name(spark):
    assert values(spark, normalize_name(F.col("a")), [("Group (Member)",), ("Solo",), ("A (b) c",)], "a string") == [
        "Group", "Solo", "A (b) c"]


def test_round_half_even(spark):
    assert values(spark, round_even(F.col("x"), 1), [(0.25,), (0.35,), (1.05,), (-0.25,)], "x double") == [
        0.2, 0.4, 1.0, -0.2]


def confidence(spark, *rows):
    cols = [F.col(c) for c in ("f", "n", "s", "d")]
    return values(spark, confidence_score(*cols), rows, "f int, n int, s double, d double")


def test_confidence_grows_with_flags_and_is_bounded(spark):
    low, high, top, none, empty = confidence(spark, (10, 100, 5.0, 2.0), (90, 100, 5.0, 2.0), (100, 100, 100.0, 100.0),
                                             (1, 1, None, 0.0), (0, 0, 0.0, 0.0))
    assert low < high and top == 100.0 and none is None and empty == 0.0


def test_reasons_are_ranked_with_fixed_ties(spark):
    schema = "r_velocity_spike int, r_seasonal_spike int, r_plateau int, r_drop_after_spike int"
    assert values(spark, reason_text(), [(1, 3, 1, 2), (0, 0, 0, 0), (0, 1, 1, 0)], schema) == [
        "seasonal_spike, drop_after_spike, velocity_spike", "—", "seasonal_spike, plateau_low_variance"]


def test_bands_and_tags(spark):
    assert values(spark, risk_band(F.col("c")), [(60.1,), (60.0,), (30.0,)], "c double") == ["high", "medium", "low"]
    assert values(spark, genre_from_tags(F.col("t")), [("dance pop, rap",), ("indie pop",), ("techno",), ("",)],
                  "t string") == ["Hip Hop / Rap", "Pop", "EDM / Electronic", "Other"]


def flagged_track(spark, n, hits, artist="A", title="T"):
    first = day("2020-01-01")
    return spark.createDataFrame([(artist, title, first + timedelta(days=i), int(i in hits), 100.0) for i in range(n)],
                                 "artist string, title string, date date, ensemble_bot int, streams double")


@pytest.mark.parametrize("hits, left, adjusted", [
    ({0, 1, 2, 3}, 0, 1), ({20, 21, 22, 23}, 4, 0), ({3, 18, 19, 20, 21}, 5, 0), ({0, 1, 2, 20}, 1, 1), (set(), 0, 0)])
def test_release_confounder(spark, hits, left, adjusted):
    out = confounders.release_confounder(flagged_track(spark, 30, hits)).collect()
    assert sum(r.ensemble_bot for r in out) == left
    assert {r.release_adjusted for r in out} == {adjusted}


def artist_row(spark, **kw):
    base = dict(artist="A", bot_streams=0.0, holiday_bot_streams=0.0, total_streams=1000.0, flagged_days=0,
                holiday_flagged_days=0, bot_pct=0.0, confidence=50.0, note="")
    base.update(kw)
    return spark.createDataFrame([base])


def test_holiday_confounder(spark):
    out = confounders.holiday_confounder(artist_row(
        spark, bot_streams=800.0, holiday_bot_streams=800.0, flagged_days=10, holiday_flagged_days=10, bot_pct=80.0,
        confidence=90.0)).first()
    assert (out.bot_pct, out.confidence, out.holiday_flag_share, out.note) == (0.0, 27.0, 1.0, HOLIDAY_NOTE)
    out = confounders.holiday_confounder(artist_row(
        spark, bot_streams=500.0, holiday_bot_streams=50.0, flagged_days=20, holiday_flagged_days=1, bot_pct=50.0,
        confidence=70.0)).first()
    assert (out.bot_pct, out.confidence, out.note) == (50.0, 70.0, "")


@pytest.mark.parametrize("first, last, start, end, n, cleared", [
    ("2018-06-01", "2018-06-21", "2016-01-01", "2020-01-01", 10, True),
    ("2018-06-01", "2020-06-01", "2018-01-01", "2021-01-01", 10, False),
    ("2019-06-01", "2019-06-11", "2019-05-01", "2019-07-01", 10, False),
    ("2018-06-01", "2018-06-01", "2016-01-01", "2020-01-01", 2, False)])
def test_oneoff_confounder(spark, first, last, start, end, n, cleared):
    row = artist_row(spark, flagged_days=n, bot_streams=800.0, bot_pct=80.0, first_active=day(start),
                     last_active=day(end), first_flag=day(first), last_flag=day(last))
    out = confounders.oneoff_confounder(row).first()
    assert out.bot_pct == (0.0 if cleared else 80.0)
    assert out.note == (ONEOFF_NOTE if cleared else "")
    assert out.confidence == (10.0 if cleared else 50.0)


def test_death_spike_and_kept_note(spark):
    row = artist_row(spark, artist="Mac Miller", flagged_days=9, bot_pct=5.0, first_active=day("2016-01-01"),
                     last_active=day("2020-01-01"), first_flag=day("2018-09-07"), last_flag=day("2018-09-20"))
    out = confounders.oneoff_confounder(confounders.death_spike_adjust(row)).first()
    assert out.note == DEATH_SPIKE_NOTE and out.confidence == 4.0


def signal_rows(spark):
    first, rows = day("2019-01-01"), []
    for year in range(2):
        for i in range(60):
            rows.append(("A & B", "T", first + timedelta(days=365 * year + i), 60_000.0, int(i in (30, 31)), 3.0, 1.0,
                         0.5, 0.0))
    return spark.createDataFrame(rows, "artist string, title string, date date, streams double, ensemble_bot int,"
                                       " spike_ratio double, seasonal_spike double, rolling_cv double,"
                                       " drop_after_spike double").withColumns(
        {"month": F.month("date"), "year": F.year("date"), "release_adjusted": F.lit(0)})


def test_rollups(spark):
    days = rollup.add_flag_values(signal_rows(spark))
    t = rollup.track_rollup(days).first()
    assert (t.total_days, t.flagged_days, t.bot_pct, t.flag_reasons, t.note) == (120, 4, 3.3, "velocity_spike", "")
    out = {r.artist: r for r in rollup.artist_rollup(days).collect()}
    assert set(out) == {"A", "B"}
    assert (out["A"].total_days, out["A"].years_active, out["A"].bot_streams) == (120, 2, 240_000.0)
    adjusted = rollup.track_rollup(days.withColumn("release_adjusted", F.lit(1))).first()
    assert adjusted.note == RELEASE_NOTE


def test_holiday_catalogue_is_left_out(spark):
    days = rollup.add_flag_values(signal_rows(spark).withColumn("artist", F.lit("Brenda Lee")))
    assert rollup.artist_rollup(days).count() == 0
    assert DEFAULT.min_days == 90


def test_assign_genre_precedence(spark):
    names = spark.createDataFrame([("X", "Pop"), ("X", "Latin"), ("Y", "Hip Hop / Rap"), ("Y", "R&B / Soul")],
                                  "name string, category string")
    artists = spark.createDataFrame([("X",), ("Y",), ("Z",)], "artist string")
    out = {r.artist: r.genre_category for r in genres.assign_genre(artists, names).collect()}
    assert out == {"X": "Latin", "Y": "R&B / Soul", "Z": "Other"}
