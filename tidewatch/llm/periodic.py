"""Periodic runs of words: block convolution at dyadic scales.

At scale B the words are cut into blocks of B. A run of period p, B <= p < 2B, of at least four periods begins less than B
words before some block that recurs p words later, both in the run. The sum of squared differences between a block and
each place of its following window is a correlation, taken exactly by a number-theoretic transform; where it is zero
the block occurs again, and the distance is a candidate period that comparing words extends in both directions.

Blocks go through the transform only if every word of theirs recurs within 2B words, and not if the three blocks
from them lie in a run of a period below B: by the theorem of Fine and Wilf two runs share less than the sum of their
periods, so no run is lost, and a text that repeats one word costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import RollingHash, mix64, pieces, utf8, words_of

#: 15 * 2^27 + 1, with 31 as a generator of its multiplicative group: transforms of up to 2^27 words.
PRIME, GENERATOR = 2013265921, 31
REPEATS = 4           # periods that a run has at least
SHORTEST = 6          # words that a run has at least
TABLE = 1 << 19       # numbers transformed together


# ---- exact transform


def _roots(half: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    step = pow(root, -1, PRIME) if inverse else root
    out = np.ones(half, np.uint64)
    size, power = 1, step
    while size < half:
        out[size:2 * size] = out[:size] * np.uint64(power) % PRIME
        size, power = 2 * size, power * power % PRIME
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Transforms of the rows (a power of two of numbers below PRIME), in bit-reversed order."""
    half = rows.shape[1] // 2
    while half:
        view = rows.reshape(len(rows), -1, 2, half)
        low, high = view[:, :, 0], view[:, :, 1]
        rows = np.stack([(low + high) % PRIME, (low + PRIME - high) * _roots(half, False) % PRIME], axis=2).reshape(rows.shape)
        half //= 2
    return rows


def restore(rows: np.ndarray) -> np.ndarray:
    """The rows whose transforms are given in bit-reversed order."""
    half = 1
    while half < rows.shape[1]:
        view = rows.reshape(len(rows), -1, 2, half)
        low, high = view[:, :, 0], view[:, :, 1] * _roots(half, True) % PRIME
        rows = np.stack([(low + high) % PRIME, (low + PRIME - high) % PRIME], axis=2).reshape(rows.shape)
        half *= 2
    return rows * np.uint64(pow(rows.shape[1], -1, PRIME)) % PRIME


def recurrences(codes: np.ndarray, squares: np.ndarray, blocks: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of all places scale to 2 * scale - 1 after a block where its words stand again.

    `codes` are below PRIME, `squares` the sums of their squares before each place. Every block has 3 * scale words from its start.
    """
    starts, distances = [], []
    for part in np.array_split(blocks, -(-len(blocks) * 2 * scale // TABLE)):
        own = codes[part[:, None] + np.arange(scale)].astype(np.uint64)
        window = np.zeros((len(part), 2 * scale), np.uint64)
        window[:, :2 * scale - 1] = codes[part[:, None] + np.arange(scale, 3 * scale - 1)]
        turned = np.zeros_like(window)
        turned[:, :scale] = own[:, ::-1]
        products = restore(transform(turned) * transform(window) % PRIME)[:, scale - 1:2 * scale - 1].astype(np.int64)
        at = part[:, None] + np.arange(scale, 2 * scale)
        total = squares[part + scale] - squares[part]
        differences = (total[:, None] + squares[at + scale] - squares[at] - 2 * products) % PRIME
        block, lag = np.nonzero(differences == 0)
        starts.append(part[block])
        distances.append(lag + scale)
    return np.concatenate(starts), np.concatenate(distances)


# ---- runs


class Covered:
    """Which ranges lie inside one of the runs."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        known = np.array(sorted(runs), np.int64).reshape(-1, 3)
        self.starts, self.ends = known[:, 0], np.maximum.accumulate(known[:, 1]) if len(known) else known[:, 1]

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(low), bool)
        at = np.searchsorted(self.starts, low, side="right") - 1
        return (at >= 0) & (self.ends[np.maximum(at, 0)] >= high)


def _stretch(codes: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """Largest range around `at` whose words equal those d later, as long as the first d words that follow it belong to it."""
    high, step = at, 64
    while high < len(codes) - d:
        stop = min(high + step, len(codes) - d)
        odd = np.flatnonzero(codes[high:stop] != codes[high + d:stop + d])
        if len(odd):
            high += int(odd[0])
            break
        high, step = stop, 2 * step
    low, step = at, 64
    while low > 0:
        stop = max(low - step, 0)
        odd = np.flatnonzero(codes[stop:low] != codes[stop + d:low + d])
        if len(odd):
            low = stop + int(odd[-1]) + 1
            break
        low, step = stop, 2 * step
    return low, high + d


def find_runs(codes: np.ndarray, following: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all stretches of at least REPEATS periods that no neighbouring word extends.

    `codes` differ between texts, so no run crosses them; `following` is the distance to the next equal code, `rows` the text of each word.
    """
    n = len(codes)
    if n < REPEATS:
        return []
    longest = int(np.bincount(rows).max())
    squares = np.concatenate([[0], np.cumsum(codes * codes % PRIME)])
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, RollingHash().base | 1, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * powers[:n])])
    found: set[tuple[int, int, int]] = set()
    scale = 1
    while REPEATS * scale <= longest:
        covered = Covered(list(found))
        count = n // scale
        near = following[:count * scale].reshape(count, scale).max(axis=1) < 2 * scale
        blocks = np.flatnonzero(near) * scale
        blocks = blocks[blocks + 3 * scale <= n]
        blocks = blocks[rows[blocks] == rows[blocks + 3 * scale - 1]]
        blocks = blocks[~covered(blocks, blocks + 3 * scale)]
        if len(blocks):
            b, d = recurrences(codes, squares, blocks, scale)
            # what a run of this period has at least from its first block on
            size = (REPEATS - 1) * d - scale + 1
            left = (b + d + size <= n) & ~covered(b, b + d + scale)
            b, d, size = b[left], d[left], size[left]
            left = (sums[b + size] - sums[b]) * powers[d] == sums[b + d + size] - sums[b + d]
            b, d = b[left], d[left]
            # neighbouring blocks with one distance lie in one stretch
            key = np.sort(d * n + b)
            heads = key[~np.isin(key - scale, key)]
            for d, at in zip((heads // n).tolist(), (heads % n).tolist()):
                low, high = _stretch(codes, at, d)
                if high - low >= REPEATS * d:
                    found.add((low, high, d))
        scale *= 2
    return sorted(found)


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, source: np.ndarray, roll: RollingHash) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, equal only for equal words of one text, and the distance to the next equal one (many, if none)."""
    words = roll.ranges(roll.prefix(data), starts, ends)[source]
    key = mix64(words + mix64(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    codes = np.empty(len(key), np.int64)
    codes[order] = np.concatenate([[0], np.cumsum(~same)]) if len(key) else 0
    following = np.full(len(key), np.iinfo(np.int64).max)
    following[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return codes, following


def rewritten(first: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The place of each word in the given texts, after the rows with a mark h (divisible by 10) were made periodic from
    word a on: g = h / 10, a = g mod n, period 1 + (n - a) / (3 + g mod 8). A mark of -1 changes nothing."""
    source = np.arange(first[-1])
    for row in np.flatnonzero((marks >= 0) & (marks % 10 == 0) & (np.diff(first) > 0)).tolist():
        low, n, g = int(first[row]), int(first[row + 1] - first[row]), int(marks[row]) // 10
        a = g % n
        source[low + a:low + n] = low + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return source


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Strings of counts[0], counts[1], ... of the words, with one blank between them."""
    size = ends - starts + 1
    to = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    n = size - 1
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to, n) + inside] = data[np.repeat(starts, n) + inside]
    last = np.cumsum(counts)
    edges = np.concatenate([to, [len(out)]])[np.concatenate([[0], last])]
    raw = out.tobytes()
    return pa.array([raw[a:max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary()).cast(pa.string())


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(documents: DataFrame, mark: Column | None = None) -> DataFrame:
    """`documents` (with a text) as rows (doc, n_words, runs, collapsed): the row as a struct, its runs as (start, length,
    period) by start and then period, and the text without the words of any run after its first period.

    A run is a stretch of words (without white space of ASCII) with smallest period q, at least 6 words and 4 * q, that neither
    neighbour extends. A null or empty text has none and collapses to an empty text; equal rows stay apart; other columns
    keep their names inside the struct; an empty table gives an empty result. A text is looked at whole: a task needs
    some 60 bytes for each byte of its longest text. `mark`: see `rewritten`.
    """
    base = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), F.col("text").cast("string").alias("text"),
                            (F.lit(-1) if mark is None else F.coalesce(mark, F.lit(-1))).cast("long").alias("mark"))
    schema = T.StructType([base.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 19):
                data, offsets = utf8(batch.column("text"))
                starts, ends, first = words_of(data, offsets)
                rows = np.repeat(np.arange(batch.num_rows), np.diff(first))
                source = rewritten(first, batch.column("mark").to_numpy())
                codes, following = coded(data, starts, ends, rows, source, roll)
                found = np.array([r for r in find_runs(codes, following, rows) if r[1] - r[0] >= SHORTEST], np.int64).reshape(-1, 3)
                found = found[np.lexsort((found[:, 2], found[:, 0]))]
                edge = np.zeros(len(codes) + 1, np.int64)
                np.add.at(edge, found[:, 0] + found[:, 2], 1)
                np.add.at(edge, found[:, 1], -1)
                kept = np.cumsum(edge)[:-1] == 0
                row = rows[found[:, 0]]
                parts = [pa.array(x, pa.int64()) for x in (found[:, 0] - first[row], found[:, 1] - found[:, 0], found[:, 2])]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()),
                                                 pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
                text = _joined(data, starts[source[kept]], ends[source[kept]], np.bincount(rows[kept], minlength=batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.diff(first), pa.int64()), lists, text],
                                                 names=["doc", "n_words", "runs", "collapsed"])

    return base.mapInArrow(run, schema)


def run_digest(found: DataFrame) -> DataFrame:
    """Per row of `periodic_runs`: number of runs, the longest (then the first, then of the shortest period) and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select("doc.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                      (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
                      F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
