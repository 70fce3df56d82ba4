"""Daily totals from a stream of chart rows, and causal signals with flags for every closed day.

A day is emitted once the watermark has passed it, so days arrive in order and each is final. Two kinds of state
follow, and what a micro-batch writes to either grows with the keys it touches, not with all keys ever seen:

* the last rows of every track, keyed by (artist, title) in Spark's state store (RocksDB with a changelog). A hot artist is
  many keys. With ``forget_days`` a timer on the watermark drops a track that has been silent for so long;
* totals per artist and calendar month, as one small delta table per micro-batch, summed into a base from time to time.
  The live mean of a row needs the order (date, title) over all tracks of its artist, which no single key may hold, so the
  batch operator takes the offsets from these totals and splits the day itself.

Everything is in shared storage. A lost executor or a restarted query continues from the last complete version, and a
replayed micro-batch reads the state before it and overwrites only its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, AuditConfig
from ..functions import present
from ..models.detector import Detector
from ..operators.daily import KEYS, with_calendar
from ..operators.signals import add_seasonal, usable_days
from ..runtime import delete_path, discard, list_names, materialize, path_exists

DAY_SECONDS = 86_400
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
TAIL = "days array<int>, streams array<double>"
WINDOWS = ("prev_streams", "rolling_7d_avg", "pct_change", "spike_ratio", "rolling_std", "rolling_cv")
TRACKED = "artist string, title string, day int, streams double, " + ", ".join(f"{c} double" for c in WINDOWS)


def live_daily(charts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming daily totals in append mode; rows later than ``delay`` behind the newest day are dropped.

    Event time is midnight UTC of the date, whatever the time zone of the session.
    """
    days = _windowed(charts, delay)
    start = F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / DAY_SECONDS).cast("int"))
    return with_calendar(days.select(*KEYS, start.alias("date"), "streams"))


def _windowed(charts: DataFrame, delay: str) -> DataFrame:
    rows = charts.where(F.col("artist").isNotNull() & F.col("title").isNotNull() & F.col("date").isNotNull()
                        & present(F.col("streams")))
    timed = rows.withColumn("ts", F.timestamp_seconds(F.unix_date("date") * DAY_SECONDS))
    return (timed.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), *KEYS)
            .agg(F.sum("streams").alias("streams")))


class TrackWindows(StatefulProcessor):
    """The windows over the last rows of one track, for rows that arrive in order of their days."""

    def __init__(self, cfg: AuditConfig = DEFAULT, forget_days: int | None = None):
        self.rows, self.std_rows, self.forget_days = cfg.rolling_rows, cfg.std_min_rows, forget_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", TAIL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["day"].to_numpy(), f["streams"].to_numpy(float)) for f in rows]
        days, streams = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(days)
        days, streams = days[order], streams[order]
        kept = self.tail.get() or ([], [])
        series = np.concatenate([np.array(kept[1], float), streams])
        last = slice(1 - self.rows, None) if self.rows > 1 else slice(0, 0)
        self.tail.update((np.concatenate([np.array(kept[0], np.int64), days])[last].tolist(), series[last].tolist()))
        if self.forget_days is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((int(days[-1]) + self.forget_days) * DAY_SECONDS * 1000)
        columns = {k: v[len(kept[1]):] for k, v in track_windows(series, self.rows, self.std_rows).items()}
        yield pd.DataFrame({"artist": key[0], "title": key[1], "day": days, "streams": streams, **columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tail.clear()
        return iter(())

    def close(self) -> None:
        pass


def track_windows(series: np.ndarray, rows: int, std_rows: int) -> dict[str, np.ndarray]:
    """The windows over the last `rows` values at every value; NaN where there is none."""
    padded = np.concatenate([np.full(rows - 1, np.nan), series])
    windows = np.lib.stride_tricks.sliding_window_view(padded, rows)
    here = np.minimum(np.arange(1, len(series) + 1), rows)
    mean = np.nansum(windows, axis=1) / here
    before = np.concatenate([[np.nan], series[:-1]])
    with np.errstate(divide="ignore", invalid="ignore"):
        std = np.sqrt(np.nansum((windows - mean[:, None]) ** 2, axis=1) / (here - 1))
        std[here < max(2, std_rows)] = np.nan
        by_mean, by_before = np.where(mean != 0, mean, np.nan), np.where(before != 0, before, np.nan)
        return {"prev_streams": before, "rolling_7d_avg": mean, "pct_change": series / by_before - 1, "spike_ratio": series / by_mean,
                "rolling_std": std, "rolling_cv": std / by_mean}


def live_tracks(charts: DataFrame, delay: str = "1 day", cfg: AuditConfig = DEFAULT, forget_days: int | None = None) -> DataFrame:
    """Closed days with the live-mode windows of their track, as a stream. Needs the state store of ``STATE_STORE``."""
    days = _windowed(charts, delay).select(*KEYS, F.floor(F.unix_seconds("window.start") / DAY_SECONDS).cast("int").alias("day"), "streams", "window")
    tracked = days.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=TrackWindows(cfg, forget_days), outputStructType=TRACKED, outputMode="Append",
        timeMode="None" if forget_days is None else "EventTime")
    return tracked.select(*KEYS, F.date_from_unix_date("day").alias("date"), "streams", *[F.nanvl(c, F.lit(None)).alias(c) for c in WINDOWS],
                          F.lit(0.0).alias("drop_after_spike"))


def next_months(days: DataFrame, months: DataFrame | None) -> DataFrame:
    """Totals per artist and calendar month, over everything seen."""
    sums = days.groupBy("artist", "month").agg(F.sum("streams").alias("base_sum"), F.count("*").alias("base_count"))
    return sums if months is None else summed(sums.unionByName(months))


def summed(months: DataFrame) -> DataFrame:
    return months.groupBy("artist", "month").agg(F.sum("base_sum").alias("base_sum"), F.sum("base_count").alias("base_count"))


class MonthTotals:
    """Totals per (artist, month) as deltas of micro-batches and a base that holds those up to a batch.

    A table counts once its ``_SUCCESS`` is written. The totals before batch n are the newest base below n and the deltas
    between; so batch n can be replayed after it has written both. Each compaction keeps the base before it and drops
    what only older ones need, so the number of tables stays below about twice ``every``.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 10):
        self.spark, self.folder, self.every = spark, folder, every

    def _numbers(self, kind: str) -> list[int]:
        root = f"{self.folder}/{kind}"
        return sorted(int(n) for n in list_names(self.spark, root) if path_exists(self.spark, f"{root}/{n}/_SUCCESS"))

    def _paths(self, number: int) -> list[str]:
        base = max((b for b in self._numbers("base") if b < number), default=-1)
        deltas = [f"{self.folder}/delta/{d}" for d in self._numbers("delta") if base < d < number]
        return ([f"{self.folder}/base/{base}"] if base >= 0 else []) + deltas

    def before(self, number: int) -> DataFrame | None:
        paths = self._paths(number)
        return summed(self.spark.read.parquet(*paths)) if paths else None

    def add(self, days: DataFrame, number: int) -> None:
        """Writes the delta of a batch, and a base in its place if enough have gathered."""
        next_months(days, None).write.mode("overwrite").parquet(f"{self.folder}/delta/{number}")
        if len(self._paths(number + 1)) > self.every:
            bases = [b for b in self._numbers("base") if b < number]
            self.before(number + 1).write.mode("overwrite").parquet(f"{self.folder}/base/{number}")
            for b in bases[:-1]:
                delete_path(self.spark, f"{self.folder}/base/{b}")
            for d in self._numbers("delta"):
                if bases and d <= bases[-1]:
                    delete_path(self.spark, f"{self.folder}/delta/{d}")


class LiveScorer:
    """Scores closed days of a chart stream; ``detector=None`` emits the signals alone."""

    def __init__(self, spark: SparkSession, folder: str, detector: Detector | None = None,
                 cfg: AuditConfig = DEFAULT, compact_every: int = 10, forget_days: int | None = None):
        if detector is not None and detector.mode != "live":
            raise ValueError("a live job needs a detector that was trained on live-mode signals")
        self.spark, self.folder, self.detector, self.cfg = spark, folder.rstrip("/"), detector, cfg
        self.months, self.forget_days = MonthTotals(spark, f"{self.folder}/months", compact_every), forget_days

    def process(self, tracked: DataFrame, number: int) -> None:
        """One micro-batch of rows of :func:`live_tracks`: the seasonal signal, flags, and the totals for the next one."""
        rows = materialize(with_calendar(tracked), "live")
        try:
            if rows.isEmpty():
                return
            signals = usable_days(add_seasonal(rows, "live", self.cfg, self.months.before(number)))
            signals = materialize(signals, "live-signals")
            scored = signals if self.detector is None else self.detector.transform(signals)
            scored.write.mode("overwrite").parquet(f"{self.folder}/scored/batch={number}")
            self.months.add(rows, number)
            discard(signals)
        finally:
            discard(rows)

    def start(self, charts: DataFrame, delay: str = "1 day", **trigger):
        """Start the query; ``trigger`` is passed on, for example ``availableNow=True``."""
        conf = self.spark.conf
        earlier = {k: conf.get(k, None) for k in STATE_STORE}
        for k, v in STATE_STORE.items():
            conf.set(k, v)
        try:
            writer = (live_tracks(charts, delay, self.cfg, self.forget_days).writeStream.outputMode("append").foreachBatch(self.process)
                      .option("checkpointLocation", f"{self.folder}/query"))
            return (writer.trigger(**trigger) if trigger else writer).start()
        finally:
            for k, v in earlier.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def scored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/scored").drop("batch")
