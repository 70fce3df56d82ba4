from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import day, track
from tidewatch import schema, streaming
from tidewatch.models.detector import Detector
from tidewatch.operators import signals
from tidewatch.operators.daily import daily_totals
from tidewatch.config import features_for
from tidewatch.runtime import materialize

@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables: a stream has a task for each partition and stateful step in every micro-batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


COLUMNS = ["artist", "title", "date", "streams", *signals.SIGNALS]


def charts(spark):
    a = track(spark, [100, 120, 90, 300, 110, 105, 400, 95, 130, 100, 115, 250], "A", "T")
    b = track(spark, [10, 30, 20, 60, 50, 40, 90, 80, 70, 20, 10, 60], "A", "U")
    c = track(spark, [5, 4, 6, 7, 3, 9, 8, 9], "B", "V", "2020-01-03")
    return a.unionByName(b).unionByName(c).unionByName(track(spark, [1], "A", "T"))


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(COLUMNS).collect())


def batch_live(spark, until):
    days = signals.engineer_signals(daily_totals(charts(spark)), "live")
    return days.where(F.col("date") <= day(until))


def test_stream_equals_batch_over_many_micro_batches(spark, tmp_path):
    """The charts arrive over several runs of the job; each run continues from the written state."""
    source = f"{tmp_path}/source"
    job = streaming.LiveScorer(spark, f"{tmp_path}/job")
    for start, end in (("2020-01-01", "2020-01-04"), ("2020-01-05", "2020-01-06"), ("2020-01-07", "2020-01-12")):
        charts(spark).where(F.col("date").between(start, end)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema.CHARTS).parquet(source)
        streaming.LiveScorer(spark, f"{tmp_path}/job").start(stream, availableNow=True).awaitTermination()
    got = job.scored()
    last = got.agg(F.max("date")).first()[0]
    assert last == day("2020-01-10")
    assert rounded(got) == rounded(batch_live(spark, str(last)))


def tracked(spark):
    """What the keyed state emits for closed days, from the batch windows."""
    return signals.track_signals(daily_totals(charts(spark)), "live")


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    job = streaming.LiveScorer(spark, f"{tmp_path}/job")
    first, second = tracked(spark).where("date < '2020-01-06'"), tracked(spark).where("date >= '2020-01-06'")
    job.process(first, 0)
    job.process(second, 1)
    job.process(second, 1)
    assert rounded(job.scored()) == rounded(batch_live(spark, "2020-02-01"))


def daily_files(spark, folder, days, tracks_on):
    """One file a day; `tracks_on` gives the tracks of a day."""
    for d in range(days):
        rows = [(f"T{t}", day("2020-01-28") + timedelta(days=d), f"A{t % 3}", "Global", float((t * 7 + d * d * 13) % 101 + 1)) for t in tracks_on(d)]
        spark.createDataFrame(rows, schema.CHARTS).coalesce(1).write.mode("append").parquet(folder)


def run_by_file(spark, job, source, files=1):
    stream = spark.readStream.schema(schema.CHARTS).option("maxFilesPerTrigger", files).parquet(source)
    job.start(stream, availableNow=True).awaitTermination()


def test_twenty_micro_batches_with_replays(spark, tmp_path):
    """Every day is a micro-batch; results equal one batch, also if some are replayed, and tables stay few."""
    source = f"{tmp_path}/source"
    daily_files(spark, source, 23, lambda d: range(8) if d < 3 or d % 4 == 0 else [d % 8, (d * 3) % 8])
    job = streaming.LiveScorer(spark, f"{tmp_path}/job", compact_every=4)
    seen = []
    keep = job.process
    def process(batch, number):  # noqa: E306
        keep(batch, number)
        seen.append(number)
        if number % 6 == 5:
            keep(batch, number)
    job.process = process
    run_by_file(spark, job, source)
    assert len(seen) >= 20
    want = signals.engineer_signals(daily_totals(spark.read.parquet(source)), "live").where(F.col("date") <= day("2020-02-17"))
    got = job.scored()
    assert got.agg(F.max("date")).first()[0] == day("2020-02-17") and rounded(got) == rounded(want)
    months = Path(f"{tmp_path}/job/months")
    assert len(list((months / "base").iterdir())) <= 2 and len(list((months / "delta").iterdir())) <= 9


def test_state_written_grows_with_the_tracks_touched(spark, tmp_path):
    source = f"{tmp_path}/source"
    daily_files(spark, source, 8, lambda d: range(2000) if d in (0, 4) else range(3))
    job = streaming.LiveScorer(spark, f"{tmp_path}/job", compact_every=50)
    run_by_file(spark, job, source)
    # operator 0 of the query is the later one, the windows of the tracks
    written = {}
    for f in Path(f"{tmp_path}/job/query/state").rglob("*.changelog"):
        operator, version = f.relative_to(f"{tmp_path}/job/query/state").parts[0], int(f.name.split("_")[0].split(".")[0])
        written.setdefault(operator, {}).setdefault(version, 0)
        written[operator][version] += f.stat().st_size
    assert len(written) == 2
    for sizes in written.values():
        big, small = max(sizes.values()), sorted(sizes.values())[len(sizes) // 2]
        assert small < big / 10
    deltas = sorted(spark.read.parquet(str(p)).count() for p in Path(f"{tmp_path}/job/months/delta").iterdir())
    assert deltas[0] == 3 and all(n <= 3 for n in deltas)
    assert rounded(job.scored()) == rounded(signals.engineer_signals(daily_totals(spark.read.parquet(source)), "live").where("date <= '2020-02-02'"))


def test_silent_tracks_are_forgotten_on_request(spark, tmp_path):
    """Track T0 is silent for seven days; forgotten after two, it begins anew, while T1 goes on."""
    source = f"{tmp_path}/source"
    daily_files(spark, source, 13, lambda d: [1] if 3 <= d < 10 else [0, 1])
    job = streaming.LiveScorer(spark, f"{tmp_path}/job", forget_days=2)
    run_by_file(spark, job, source, 2)
    got = {(r["title"], r["date"]) for r in job.scored().collect()}
    days = signals.engineer_signals(daily_totals(spark.read.parquet(source)), "live").where("date <= '2020-02-07'")
    want = {(r["title"], r["date"]) for r in days.collect()}
    assert {x for x in got if x[0] == "T1"} == {x for x in want if x[0] == "T1"}
    assert ("T0", day("2020-02-07")) in want and ("T0", day("2020-02-07")) not in got


def test_late_rows_and_keyless_rows_are_dropped(spark, tmp_path):
    source = f"{tmp_path}/source"
    sink = f"{tmp_path}/days"
    late = track(spark, [999], "A", "T", "2020-01-02")
    for rows in (charts(spark).unionByName(track(spark, [5], None)), late):
        rows.coalesce(1).write.mode("append").parquet(source)
        (streaming.live_daily(spark.readStream.schema(schema.CHARTS).parquet(source)).writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", f"{tmp_path}/query").trigger(availableNow=True)
         .start().awaitTermination())
    got = spark.read.parquet(sink)
    want = daily_totals(charts(spark)).where("date <= '2020-01-10'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_live_flags_equal_batch_flags(spark, tmp_path):
    rows = materialize(signals.engineer_signals(daily_totals(charts(spark)), "live"), "signals")
    detector = Detector(contamination=0.2, trees=30, neighbors=5)
    detector.fit_flag(rows, features_for("live"))
    job = streaming.LiveScorer(spark, f"{tmp_path}/job", detector)
    job.process(tracked(spark).where("date < '2020-01-07'"), 0)
    job.process(tracked(spark).where("date >= '2020-01-07'"), 1)
    key = ["artist", "title", "date", "ensemble_bot"]
    assert sorted(map(tuple, job.scored().select(key).collect())) == sorted(
        map(tuple, detector.transform(rows).select(key).collect()))
    with pytest.raises(ValueError):
        streaming.LiveScorer(spark, str(tmp_path), Detector(features=features_for("retrospective")))


def test_state_is_small(spark, tmp_path):
    days = daily_totals(charts(spark))
    months = streaming.live.next_months(days, streaming.live.next_months(days, None)).collect()
    assert {(r.artist, r.month): r.base_count for r in months} == {("A", 1): 48, ("B", 1): 16}
    source = f"{tmp_path}/source"
    charts(spark).coalesce(1).write.parquet(source)
    job = streaming.LiveScorer(spark, f"{tmp_path}/job")
    run_by_file(spark, job, source)
    tail = (spark.read.format("statestore").option("stateVarName", "tail").option("operatorId", 0).load(f"{tmp_path}/job/query")
            .select("key.*", "value.*").collect())
    assert {(r["artist"], r["title"]) for r in tail} == {("A", "T"), ("A", "U"), ("B", "V")}
    assert all(len(r["days"]) == len(r["streams"]) == 6 for r in tail)
