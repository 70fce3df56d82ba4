from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import column, day, track
from tidewatch.config import DEFAULT, features_for
from tidewatch.operators import signals
from tidewatch.operators.daily import daily_totals
from tidewatch.operators.prefix import running_totals


def engineered(spark, values, mode="retrospective", **kw):
    return signals.engineer_signals(daily_totals(track(spark, values)), mode, **kw)


def test_same_day_rows_are_summed_and_keyless_rows_dropped(spark):
    rows = track(spark, [100]).unionByName(track(spark, [50])).unionByName(track(spark, [7], artist=None))
    out = daily_totals(rows).collect()
    assert [(r.artist, r.streams, r.month, r.year, r.day_of_week) for r in out] == [("A", 150.0, 1, 2020, 2)]


def test_spike_is_detected_on_its_day_only(spark):
    ratios = column(engineered(spark, [100] * 13 + [1000]), "spike_ratio")
    assert ratios[-1] > DEFAULT.spike_flag
    assert max(ratios[:-1]) < DEFAULT.spike_flag


def test_first_two_days_have_no_usable_signal(spark):
    assert column(engineered(spark, [100] * 5), "date") == [day("2020-01-03"), day("2020-01-04"), day("2020-01-05")]


def test_constant_series_has_zero_variation(spark):
    assert max(column(engineered(spark, [500] * 20), "rolling_cv")) == 0.0


def test_zero_days_give_missing_signals_not_errors(spark):
    daily = daily_totals(track(spark, [0, 0, 0, 0, 5, 5]))
    rows = signals.add_seasonal(signals.track_signals(daily)).orderBy("date").collect()
    assert rows[1].pct_change is None and rows[2].spike_ratio is None and rows[2].rolling_cv is None
    assert rows[4].pct_change is None and rows[4].spike_ratio == 5.0


def test_seasonal_spike_within_month(spark):
    assert column(engineered(spark, [100] * 20 + [1500]), "seasonal_spike")[-1] > DEFAULT.seasonal_flag


def test_weekend_ratio(spark):
    daily = daily_totals(track(spark, [100, 100, 100, 1000, 1000, 100, 100]))
    assert column(signals.add_weekend_ratio(daily), "weekend_ratio")[0] == pytest.approx(1000 / 101)
    weekdays = daily_totals(track(spark, [100, 100]))
    assert column(signals.add_weekend_ratio(weekdays), "weekend_ratio") == [0.0, 0.0]


def test_drop_after_spike_needs_the_future(spark):
    values = [100] * 13 + [1000, 100]
    assert sum(column(engineered(spark, values), "drop_after_spike")) == 1
    assert sum(column(engineered(spark, values, "live"), "drop_after_spike")) == 0


def test_live_signals_do_not_change_when_days_are_added(spark):
    values = [100, 120, 90, 300, 110, 105, 400, 95, 130, 100, 115, 250, 100, 108]
    full, part = engineered(spark, values, "live"), engineered(spark, values[:-1], "live")
    assert signals.causality_diff(full, part).count() == 0
    assert signals.causality_diff(full, part, tolerance=-1.0).count() == 11
    changed = signals.causality_diff(engineered(spark, values), engineered(spark, values[:-1]))
    assert changed.count() > 0


def test_feature_order_and_cleaning(spark):
    rows = spark.createDataFrame([(1.0, None, float("nan"), float("inf"), -float("inf"), 1.0)],
                                 "streams double, pct_change double, spike_ratio double, seasonal_spike double,"
                                 " rolling_cv double, drop_after_spike double")
    out = signals.feature_matrix(rows)
    assert out.columns == features_for("retrospective")
    assert list(out.first()) == [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    assert signals.feature_matrix(rows, "live").columns == features_for("live")
    with pytest.raises(ValueError):
        features_for("both")


def test_running_totals_are_the_same_for_any_piece_size(spark):
    rows = spark.createDataFrame(
        [("hot" if i % 3 else "cold", i % 7, f"name{i:03}", float(i)) for i in range(300)],
        "g string, c int, f string, v double")
    want = {}
    for g, c, f, v in sorted(map(tuple, rows.collect())):
        total, count = want.get(("last", g), (0.0, 0))
        want["last", g] = want[g, c, f] = (total + v, count + 1)
    for every in (1, 5, 1 << 18):
        got = running_totals(rows, ["g"], "c", "f", "v", every=every)
        assert {(r.g, r.c, r.f): (r.run_sum, r.run_count) for r in got.collect()} == {
            k: v for k, v in want.items() if k[0] != "last"}


def test_live_seasonal_of_a_hot_artist_is_split(spark):
    rows = track(spark, [10, 20, 30], title="a")
    for i in range(40):
        rows = rows.unionByName(track(spark, [i, 2 * i, 5], title=f"t{i:02}"))
    daily = daily_totals(rows)
    small = signals.add_seasonal(daily, "live", replace(DEFAULT, prefix_rows=3))
    large = signals.add_seasonal(daily, "live", DEFAULT)
    assert sorted(map(tuple, small.select(sorted(small.columns)).collect())) == sorted(
        map(tuple, large.select(sorted(large.columns)).collect()))


def test_signals_do_not_depend_on_partitions_or_row_order(spark):
    rows = track(spark, [3, 1, 4, 1, 5, 9, 2, 6]).unionByName(track(spark, [2, 7, 1, 8, 2, 8], title="U"))
    a = signals.engineer_signals(daily_totals(rows))
    b = signals.engineer_signals(daily_totals(rows.orderBy(F.rand(3)).repartition(5)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_windows_share_one_shuffle_of_the_daily_rows(spark):
    plan = signals.track_signals(daily_totals(track(spark, [1, 2, 3])))._jdf.queryExecution().sparkPlan().toString()
    prepared = signals.track_signals(daily_totals(track(spark, [1, 2, 3])))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    assert prepared.count("Exchange hashpartitioning") == 2   # the daily sum, then all windows of a track


def test_monthly_mean_shares_the_shuffle_of_the_daily_sum(spark, tmp_path):
    track(spark, [1, 2, 3, 4, 5]).write.parquet(f"{tmp_path}/charts")
    out = signals.engineer_signals(daily_totals(spark.read.parquet(f"{tmp_path}/charts")))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
