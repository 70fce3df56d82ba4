"""Helpers shared by the operators: table access and vectorised views of UTF-8 text inside tasks."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES_PATTERN = r"[\x20\x09-\x0D]+"

#: Spark's xxhash64 of the empty string.
EMPTY = -7444071767201028348


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_place(documents: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """`documents` with its columns named c0, c1, ... by place, so that none clashes with a column of an operator nor with
    another one that differs in case alone, and the new names of the columns `names`. `toDF(*documents.columns)` undoes it."""
    columns = documents.columns
    lowered = [c.lower() for c in columns]
    places = [columns.index(n) if n in columns else lowered.index(n.lower()) for n in names]
    return documents.toDF(*[f"c{k}" for k in range(len(columns))]), [f"c{k}" for k in places]


def only(documents: DataFrame, *names: str) -> DataFrame:
    """The columns `names` of `documents` alone, under these names."""
    placed, found = by_place(documents, *names)
    return placed.select(*[F.col(c).alias(n) for c, n in zip(found, names)])


def hashes_of(text: Column) -> Column:
    """Hashes of the words of a text, repeats and empty strings at its ends included."""
    return F.transform(F.split(text, SPACES_PATTERN), lambda w: F.xxhash64(w))


def blank_split(line: Column) -> Column:
    """Words of a line, and empty strings between them where white space repeats. A single blank is split without a
    regular expression, which is several times faster on short lines."""
    other = r"[\t\n\x0B\f\r]"
    return F.split(F.when(line.rlike(other), F.regexp_replace(line, other, " ")).otherwise(line), " ")


def release(spark: SparkSession) -> None:
    """Lets the driver's JVM collect its garbage: shuffle files of finished steps are deleted once their plans are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row offsets into them; nulls count as empty."""
    column = column.fill_null("") if column.null_count else column
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about `target` bytes of text each, so that temporary arrays stay small."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + target, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """Hashes of arbitrary byte ranges by prefix sums of a polynomial modulo 2^64 with random byte values."""

    def __init__(self, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = (int(rng.integers(1, 1 << 62)) << 2 | 1) & (1 << 64) - 1 | 4
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self._up) < n:
            self._up, self._down = self._powers(self.base, n), self._powers(self.inverse, n)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.values[data] * self._up[:n - 1], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (prefix[ends] - prefix[starts]) * self._down[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """`ranges` of all ranges of `length` bytes, by start."""
        many = max(0, len(prefix) - length)
        raw = (prefix[length:] - prefix[:many]) * self._down[:many]
        return mix64(raw + np.uint64(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1))

    def marks(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Short hashes above 0 of all ranges of `length` bytes, by start: good to choose positions by, not to name bytes."""
        many = max(0, len(prefix) - length)
        raw = (prefix[length:] - prefix[:many]) * self._down[:many]
        return (raw >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each row the index of its first word, one more at the end."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
