import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import day, track
from tidewatch import schema
from tidewatch.operators import inject, labels, leaderboard, ranking, sessions
from tidewatch.operators.daily import daily_totals
from tidewatch.operators.quantile import exact_quantiles
from tidewatch.plans.evaluate import evaluate_documented
from tidewatch.sources import (
    charts_or_empty, curate_charts, incident_table, read_charts, read_labels, read_tracks, write_report, write_table,
)


def test_injection_boosts_one_window(spark):
    daily = daily_totals(track(spark, [100] * 60))
    out = inject.inject(daily, 1, 5, 4.0).collect()
    planted = sorted(r.date for r in out if r.is_injected)
    assert len(out) == 60 and len(planted) == 5 and (planted[-1] - planted[0]).days == 4
    assert {r.streams for r in out if r.is_injected} == {400.0}
    assert {r.streams for r in out if not r.is_injected} == {100.0}
    assert (planted[0] - day("2020-01-01")).days >= 15


def test_injected_plateau_is_flat(spark):
    daily = daily_totals(track(spark, [50, 150] * 30))
    out = inject.inject(daily, 1, 5, 4.0, pattern="plateau").where("is_injected = 1")
    assert {r.streams for r in out.collect()} == {400.0}
    assert inject.inject(daily_totals(track(spark, [1] * 24)), 1, 5, 4.0).where("is_injected = 1").count() == 0
    with pytest.raises(ValueError):
        inject.inject(daily, pattern="ramp")


def test_patterns_share_their_windows(spark):
    daily = daily_totals(track(spark, [100] * 60).unionByName(track(spark, [7] * 50, title="U")))
    a, b = (inject.inject(daily, 2, 5, 4.0, pattern=p).where("is_injected = 1").select("title", "date").collect()
            for p in inject.PATTERNS)
    assert sorted(a) == sorted(b)


def test_label_metrics(spark):
    rows = spark.createDataFrame([("bot", 3, 10.0), (" Bot", 0, 0.0), ("LEGIT ", 0, 0.0), ("legit", 2, 1.0), ("unsure", 5, 8.0)],
                                 "label string, flagged_days int, bot_pct double")
    m = labels.confusion_metrics(rows).first()
    assert (m.labeled, m.tp, m.fp, m.fn, m.tn, m.precision, m.recall) == (4, 1, 1, 1, 1, 0.5, 0.5)
    assert labels.label_auc(rows).first()[0] == 0.625
    none = labels.confusion_metrics(rows.where("label = 'unsure'")).first()
    assert (none.labeled, none.precision, none.f1, none.accuracy) == (0, 0.0, 0.0, 0.0)
    assert labels.label_auc(rows.where("label = 'bot'")).first()[0] is None


def test_labels_take_fresh_results(spark, tmp_path):
    tracks = spark.createDataFrame([("A", "T", 2, 9.0)], "artist string, title string, flagged_days long, bot_pct double")
    stale = spark.createDataFrame([("bot", "A", "T", 0, 0.0), ("bot", "gone", "T", 5, 5.0)],
                                  "label string, artist string, title string, flagged_days long, bot_pct double")
    out = {r.artist: (r.flagged_days, r.bot_pct) for r in labels.join_labels(stale, tracks).collect()}
    assert out == {"A": (2, 9.0), "gone": (None, None)}
    assert labels.label_score(stale, tracks).first().fn == 1
    write_table(stale, f"{tmp_path}/labels.csv")
    assert read_labels(spark, f"{tmp_path}/labels.csv").columns == ["label", "artist", "title", "bot_pct", "flagged_days"]


def tracks_table(spark, n):
    return spark.createDataFrame([("A", f"T{i:03}", float(i % 50)) for i in range(n)],
                                 "artist string, title string, bot_pct double")


def test_review_sheet(spark):
    sheet = labels.review_sheet(tracks_table(spark, 200), 10, 5).collect()
    assert len(sheet) == 15 and {r.label for r in sheet} == {""} and {r.note for r in sheet} == {""}
    assert sum(r.bot_pct >= 47 for r in sheet) >= 10
    assert labels.review_sheet(tracks_table(spark, 8), 10, 5).count() == 8


def test_rank_metrics_by_hand(spark):
    names = ["Group", "Group (One)", "Solo", "Other"] + [f"n{i:02}" for i in range(30)]
    pct = [3.0, 9.0, 9.5, 1.0] + [0.5] * 30
    results = spark.createDataFrame([(a, p, 1.0) for a, p in zip(names, pct)], "artist string, bot_pct double, confidence double")
    incidents = spark.createDataFrame([("Group (Two)", True), ("Other", True), ("Missing", True), ("Solo", False)],
                                      "artist string, verified boolean")
    ranked = {r._norm: r["rank"] for r in ranking.suspicion_rank(results).collect()}
    assert (ranked["Solo"], ranked["Group"], ranked["Other"], ranked["n00"], len(ranked)) == (1, 2, 3, 4, 33)
    m = evaluate_documented(results, incidents).first()
    assert (m.n_artists, m.documented_verified, m.documented_present, m.documented_absent) == (33, 3, 2, ["Missing"])
    assert (m.precision_at_10, m.recall_at_10, m.precision_at_50) == (0.2, 1.0, round(2 / 33, 3))
    assert m.median_percentile_of_positives == round((1 - 2 / 33) * 100, 1)
    assert m.roc_auc == round(60 / 62, 3)
    assert [p.artist for p in m.positives] == ["Group", "Other"]


def test_report_without_positives(spark, tmp_path):
    results = spark.createDataFrame([("A", 1.0, 1.0)], "artist string, bot_pct double, confidence double")
    incidents = spark.createDataFrame([("B", True)], "artist string, verified boolean")
    report = evaluate_documented(results, incidents)
    m = report.first()
    assert (m.documented_present, m.precision_at_10, m.recall_at_10, m.roc_auc) == (0, 0.0, 0.0, None)
    assert m.median_percentile_of_positives is None
    write_report(report, f"{tmp_path}/skipped", write=False)
    assert not (tmp_path / "skipped").exists()
    write_report(report, f"{tmp_path}/report")
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert json.loads(text)["n_artists"] == 1


def test_auc_against_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), float(rng.randrange(6))) for _ in range(80)]
    pos, neg = ([s for y, s in rows if y == v] for v in (1, 0))
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "y int, s double")
    assert ranking.roc_auc(df, F.col("y") == 1, F.col("s"), 9).first()[0] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("limit", [10, 10_000])
def test_exact_quantiles(spark, limit):
    import numpy as np
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=400), np.full(300, 0.25), [1e9, -1e12]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    probs = [0.0, 0.013, 0.5, 0.77, 0.999, 1.0]
    assert exact_quantiles(df, "x", probs, one_pass_rows=limit) == pytest.approx(list(np.quantile(x, probs)), rel=1e-12)


def test_histogram(spark):
    import numpy as np
    x = [0.0, 0.1, 0.5, 0.5, 0.999, 1.0, 0.3]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    rows = sessions.equal_width_histogram(df, F.col("x"), 10).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins=10)
    assert [r.sessions for r in rows] == list(counts)
    assert [r.left_edge for r in rows] == pytest.approx(list(edges[:-1]))
    flat = sessions.equal_width_histogram(df.where("x = 0.5"), F.col("x"), 3).orderBy("bin").collect()
    assert [r.sessions for r in flat] == [0, 2, 0]


def test_masking_numbers_in_display_order(spark):
    df = spark.createDataFrame([("a", 9.0, 1.0), ("b", 8.0, 50.0), ("c", 7.0, 2.0), ("d", 7.0, None)],
                               "artist string, bot_pct double, confidence double")
    out = leaderboard.mask_low_confidence(df, 10.0).orderBy(F.desc("bot_pct"), "confidence").collect()
    assert sorted(r.artist for r in out) == ["b", "d", "🔒 Under review #1", "🔒 Under review #2"]
    assert {r.artist: r.bot_pct for r in out}["🔒 Under review #1"] == 9.0
    assert leaderboard.mask_low_confidence(df, 10.0, on=False) is df
    bare = df.drop("confidence")
    assert leaderboard.mask_low_confidence(bare, 10.0) is bare


def test_contains_is_literal(spark):
    df = spark.createDataFrame([("A$AP Rocky",), ("other",), (None,)], "artist string")
    assert leaderboard.artist_contains(df, "a$ap").count() == 1


def test_sources(spark, tmp_path):
    rows = track(spark, [5, None, 7], region="Global").unionByName(track(spark, [9], region="France")).unionByName(
        track(spark, [4], region=None))
    raw = f"{tmp_path}/raw.csv"
    rows.withColumn("rank", F.lit(3)).select("rank", *reversed(rows.columns)).write.option("header", True).csv(raw)
    assert curate_charts(spark, raw, f"{tmp_path}/out").count() == 2
    assert curate_charts(spark, raw, f"{tmp_path}/all", all_regions=True).count() == 2
    curated = read_charts(spark, f"{tmp_path}/out")
    assert curated.schema == schema.CHARTS and curated.count() == 2
    assert read_charts(spark, f"{tmp_path}/out", sample=1).first().streams == 5.0
    assert curate_charts(spark, raw, f"{tmp_path}/out.csv", regions=["France"]).first().streams == 9.0
    assert charts_or_empty(spark, [f"{tmp_path}/none", f"{tmp_path}/out"]).count() == 2
    empty = charts_or_empty(spark, [f"{tmp_path}/none"])
    assert empty.schema == schema.CHARTS and empty.count() == 0
    write_table(spark.createDataFrame([("A", 'say "x", y', 1.0)], "artist string, title string, bot_pct double"), f"{tmp_path}/t.csv")
    assert read_tracks(spark, f"{tmp_path}/t.csv").first().title == 'say "x", y'


def test_incidents(spark):
    table = incident_table(spark)
    s = leaderboard.incident_summary(table).first()
    assert (s.incidents, s.verified, s.streams_removed) == (8, 7, 450e6)
    assert leaderboard.confirmed_incidents(table).count() == 6
    badges = {r.artist: r.removed_badge for r in leaderboard.incident_badges(table).collect()}
    assert badges["Drake"] == "Stream count unconfirmed" and badges["BTS (Jin)"] == "15M streams removed"


def test_missing_scores_rank_last_and_keep_their_names(spark):
    from tidewatch.operators.leaderboard import mask_low_confidence
    from tidewatch.operators.ranking import suspicion_rank

    rows = [("X", None), ("X (a)", 5.0), ("Y", None), ("Z", 9.0)]
    ranks = {r["artist"]: r["rank"] for r in suspicion_rank(spark.createDataFrame(rows, "artist string, bot_pct double")).collect()}
    assert ranks == {"Z": 1, "X (a)": 2, "Y": 3}
    shown = mask_low_confidence(spark.createDataFrame([(*r, c) for r, c in zip(rows, (1.0, 1.0, 90.0, 1.0))],
                                                      "artist string, bot_pct double, confidence double"), 50.0)
    assert shown.count() == 4 and shown.where("artist = 'Y'").count() == 1


def test_quoted_csv_lines_are_read(spark, tmp_path):
    from tidewatch.sources.charts import curate_charts

    path = tmp_path / "raw.csv"
    path.write_text('title,date,artist,region,streams\n"Say ""Hi"", Bob",2020-01-01,A,Global,5\n')
    out = curate_charts(spark, str(path), str(tmp_path / "out.csv"), regions=["Global"]).collect()
    assert [(r["title"], r["artist"], r["streams"]) for r in out] == [('Say "Hi", Bob', "A", 5.0)]


def test_order_over_a_million_scores_has_no_single_task(spark):
    """Ranks and AUC of a million different scores: ranges with offsets, no exchange into one partition."""
    import contextlib
    import io

    from tidewatch.operators.prefix import running_totals
    df = spark.range(1_000_000).select("id", (F.xxhash64("id") / 1e9).alias("s"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).alias("y"))
    run = running_totals(df, [], "s", "id", F.lit(1.0), descending=True, every=1 << 16)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        run.explain()
    assert "SinglePartition" not in shown.getvalue()
    assert run.where(F.col("run_sum") != F.col("run_count")).isEmpty()
    x = df.select("s", "y").toPandas()
    order = x["s"].rank(ascending=False)
    got = run.agg(F.max("run_count").alias("n"), F.max_by("s", "run_count").alias("last"), F.min_by("s", "run_count").alias("first")).first()
    assert (got["n"], got["last"], got["first"]) == (1_000_000, x["s"].min(), x["s"].max())
    n1 = int(x["y"].sum())
    n0 = len(x) - n1
    want = (x["s"].rank()[x["y"]].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert ranking.roc_auc(df, F.col("y"), F.col("s"), 9).first()[0] == pytest.approx(want, abs=1e-9)
    assert order.max() == 1_000_000


def test_running_totals_split_one_hot_value(spark):
    """All rows share the group and the coarse value; NULLs are values of their own."""
    from tidewatch.operators.prefix import running_totals
    rows = [("g", 1.0, f"n{i:05}", float(i)) for i in range(3000)] + [(None, None, "a", 2.0), (None, None, None, 3.0), ("g", None, "z", None)]
    df = spark.createDataFrame(rows, "g string, c double, f string, v double").repartition(3)
    got = {(r["g"], r["c"], r["f"]): (r["run_sum"], r["run_count"]) for r in running_totals(df, ["g"], "c", "f", "v", every=100).collect()}
    assert len(got) == len(rows)
    assert got["g", None, "z"] == (0.0, 1) and got[None, None, None] == (3.0, 1) and got[None, None, "a"] == (5.0, 2)
    assert all(got["g", 1.0, f"n{i:05}"] == (i * (i + 1) / 2, i + 2) for i in range(3000))


def test_result_sets_appear_whole(spark, tmp_path, monkeypatch):
    """A writer that is lost between two tables changes nothing; the next one is seen whole, and old sets go."""
    from tidewatch.sources import results
    out = f"{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        results.current(spark, out)

    def tables(n):
        return {"tracks": spark.range(n), "artists": spark.range(n + 1)}

    def seen():
        folder = results.current(spark, out)
        return tuple(spark.read.parquet(f"{folder}/{t}").count() for t in ("tracks", "artists"))

    results.publish(spark, out, tables(1))
    assert seen() == (1, 2)
    keep = results.write_table

    def lost(df, path):
        if path.endswith("artists"):
            raise RuntimeError("lost")
        keep(df, path)

    monkeypatch.setattr(results, "write_table", lost)
    with pytest.raises(RuntimeError):
        results.publish(spark, out, tables(5))
    assert seen() == (1, 2)
    monkeypatch.setattr(results, "write_table", keep)

    def no_model(path):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        results.publish(spark, out, tables(6), {"model": no_model})
    assert seen() == (1, 2)
    opened = results.current(spark, out)
    for n in (7, 8):
        results.publish(spark, out, tables(n))
        assert seen() == (n, n + 1)
    from tidewatch.runtime import path_exists
    assert not path_exists(spark, opened) and len(list((tmp_path / "out" / "_commits").glob("0*"))) == 2
