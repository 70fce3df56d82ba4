"""Removal of repeated substrings by prefix doubling over sampled positions.

Sampled positions depend on nearby bytes only: an anchor has the least hash of 16 bytes in some window of WINDOW
positions, and the position WINDOW bytes before it is ranked. Both occurrences of a repeated string of `length` bytes have
the same anchors in their inner part, so the first ranked position in them is the same and has `length` - WINDOW bytes of
the string ahead. Whether a position is ranked is settled by the BASE bytes from it on, and its first rank is that of these
bytes. Then prefix doubling: the rank of a position, the rank of the last position that the bytes of the first rank reach, and
the distance of the two are a pair, which stands for all bytes of both; Spark sorts pairs and positions into ranges, and the
number of its pair in that order is the new rank of a position. Positions with a pair of their own leave at each step. The
distances double (`steps`) up to the bytes that both occurrences must share; the last one is cut to them: strings of 400 bytes
have first ranks of 175 bytes, one step to 320 and one to 400. Equal pairs
are neighbours in the order, also where they fill many ranges, so a passage in very many texts is no hot key.

Positions whose last rank and following bytes repeat over the whole length are marked for sure. Of the others with a
repeated last rank, those whose surroundings are not wholly marked name the classes that are still open. The window around each
position of an open class, in any text, holds all strings that belong to it: windows that repeat are marked, and one of each
kind of window ranks all its positions over the full length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import RollingHash, pieces, release, utf8
from tidewatch.llm.fixed import may_contain, membership
from tidewatch.runtime import discard, materialize

LENGTH = 400
WINDOW = 80
GRAM = 16
HEAVY = 256
PIECE = 1 << 17              # bytes of texts that are hashed together
BASE = 2 * WINDOW + GRAM - 1
LEVEL_BITS, RANGE_BITS = 59, 36       # a rank: level of doubling, sorted range, number in the range


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i:i + width] for every i that fits, by doubling."""
    span, out = 1, x
    while 2 * span <= width:
        out = best(out[:len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return best(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions with the least hash of some window of WINDOW positions (ties: all of them). The hashes, above 0, are of GRAM bytes
    each; texts that end at `ends` lie one after the other, and windows over an end don't count."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    least = _slide(grams, WINDOW, np.minimum)
    across = np.subtract.outer(ends, np.arange(1, WINDOW + GRAM - 1)).ravel()
    least[across[(across >= 0) & (across < len(least))]] = 0
    padded = np.zeros(len(grams) + WINDOW - 1, grams.dtype)
    padded[WINDOW - 1:WINDOW - 1 + len(least)] = least
    return np.flatnonzero(_slide(padded, WINDOW, np.maximum) == grams)


class Text:
    """Names of byte ranges of one text."""

    def __init__(self, raw: bytes, roll: RollingHash):
        self.data = np.frombuffer(raw, np.uint8)
        self.roll, self.prefix = roll, roll.prefix(self.data)

    def names(self, starts: np.ndarray, length: int) -> np.ndarray:
        return self.roll.ranges(self.prefix, starts, starts + length)

    def ranked(self) -> np.ndarray:
        found = anchors(self.roll.marks(self.prefix, GRAM), np.array([len(self.data)])) - WINDOW
        return found[found >= 0]


POSITION = "key long, i int, at int, rest long"


def steps(length: int) -> list[int]:
    """Most bytes to the second position of a pair at each step. Ranks of a step reach the last position within some number of
    bytes, and BASE bytes more; the second position lies inside these, and its own reach ends with the shared bytes."""
    span, reach, out = length - WINDOW - BASE, 0, []
    while reach < span:
        out.append(min(reach + BASE - (WINDOW if out else 0), span - reach))
        reach += out[-1]
    return out


def _jumps(length: int) -> list[str]:
    return [f"jump_{k}" for k in range(len(steps(length)))]


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Ranked positions of the texts, numbered by i: the name of their BASE bytes, that of the bytes from the end of their last rank
    to `length` (odd; even: end of a shorter text), and how many positions on the second one of a pair is at each step."""
    roll = RollingHash()
    for batch in batches:
        columns, size = [], 0
        for part in pieces(batch, "raw", PIECE):
            data, offsets = utf8(part.column("raw"))
            prefix, sizes, ends = roll.prefix(data), np.diff(offsets), offsets[1:]
            at = anchors(roll.marks(prefix, GRAM), ends) - WINDOW
            row = np.searchsorted(ends, at + WINDOW, side="right")
            fits = (at >= offsets[row]) & (at + BASE <= ends[row]) & (sizes[row] >= length)
            at, row = at[fits], row[fits]
            number, first, final = np.arange(len(at)), np.searchsorted(row, row), np.searchsorted(row, row, side="right") - 1
            reached = [np.minimum(np.searchsorted(at, at + most, side="right") - 1, final) for most in steps(length)]
            last = number
            for ahead in reached:        # where the rank of a step ends: the end of its second position's rank
                last = last[ahead]
            rest = (2 * sizes[row]).astype(np.uint64)
            long = at + length <= ends[row]
            rest[long] = roll.ranges(prefix, at[last[long]] + BASE, at[long] + length) | np.uint64(1)
            columns.append((part.column("key").to_numpy()[row], (number - first).astype(np.int32), (at - offsets[row]).astype(np.int32), rest.view(np.int64),
                            roll.ranges(prefix, at, at + BASE).view(np.int64), *((ahead - number).astype(np.int32) for ahead in reached)))
            size += len(at)
            if size > 1 << 18:
                yield _batch(columns, length)
                columns, size = [], 0
        if columns:
            yield _batch(columns, length)


def _batch(columns, length: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns)], names=["key", "i", "at", "rest", "a", *_jumps(length)])


def _number_pairs(batches: Iterator[pa.RecordBatch], level: int, jumps: list[str]) -> Iterator[pa.RecordBatch]:
    """New ranks in one sorted range; rows of equal positions become one (twice). Columns that the rows lack are 0. A pair of one
    position leaves, but for the first and last pair of the range, which may go on in others: two rows with i = -1 tell these (at: occurrences, 2 for more)."""
    carried = ["key", "i", "at", "rest", *jumps, "twice"]
    kinds = [np.int64, np.int32, np.int32, np.int64, *[np.int32] * len(jumps), bool]
    names, zeros = [*carried, "a", "gap", "b"], dict(zip([*carried, "a", "gap", "b"], [*kinds, np.int64, np.int64, np.int64]))
    first = level << LEVEL_BITS | TaskContext.get().partitionId() << RANGE_BITS
    held, group, open_size, ends = None, -1, 0, []

    def emit(x, keep, rank):
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(x[n][keep].astype(t)) for n, t in zip(carried, kinds)), pa.array(rank[keep]), none, none, none],
                                          names=[*carried, "rank", "a", "gap", "b"])

    def numbered(x):
        """(rows merged by position, pair starts) of whole rows in order."""
        new = np.ones(len(x["key"]), bool)
        new[1:] = np.any([x[n][1:] != x[n][:-1] for n in ("a", "gap", "b", "key", "i")], axis=0)
        at = np.flatnonzero(new)
        twice = np.logical_or.reduceat(x["twice"], at) | (np.diff(np.append(at, len(new))) > 1)
        x = {n: v[at] for n, v in x.items()} | {"twice": twice}
        start = np.ones(len(at), bool)
        start[1:] = np.any([x[n][1:] != x[n][:-1] for n in ("a", "gap", "b")], axis=0)
        return x, start

    def flush(x, final):
        """Emits all rows but the last one, which may go on in the next batch."""
        nonlocal held, group, open_size
        x, start = numbered(x)
        start[0] = held is None or held["start"]
        rank = group + np.cumsum(start)
        stay = len(rank) if final else len(rank) - 1
        same = np.zeros(len(rank), bool)
        same[1:] = ~start[1:]
        same[:-1] |= ~start[1:]
        same[0] |= not start[0]
        weight = 1 + x["twice"].astype(np.int64)
        if stay:
            # occurrences of the first pair of the range, and of the pair that is open at the end of these rows
            if not ends:
                ends.append([int(x[n][0]) for n in ("a", "gap", "b")] + [0])
            ends[0][3] += int(weight[:stay][rank[:stay] == 0].sum())
            of_last = int(weight[:stay][rank[:stay] == rank[stay - 1]].sum())
            open_size = of_last + (open_size if rank[stay - 1] == group else 0)
            last = [int(x[n][stay - 1]) for n in ("a", "gap", "b")] + [open_size]
            ends[1:] = [last]
            group = int(rank[stay - 1])
        keep = same | x["twice"] | (rank == 0) | (final & (np.arange(len(rank)) == len(rank) - 1))
        keep[stay:] = False
        out = emit(x, keep, first + rank)
        held = None if final else {"rows": {n: v[-1:] for n, v in x.items()}, "start": bool(start[-1])}
        return out

    for batch in batches:
        if batch.num_rows:
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) if n in batch.schema.names else np.zeros(batch.num_rows, zeros[n]) for n in names}
            if held is not None:
                x = {n: np.concatenate([held["rows"][n], x[n]]) for n in names}
            yield flush(x, False)
    if held is None:
        return
    yield flush(held["rows"], True)
    sides = [(first, ends[0]), (first + group, ends[1])][:1 + (group > 0)]
    told = {n: np.zeros(len(sides), t) for n, t in zip(carried, kinds)}
    told |= {"i": np.full(len(sides), -1, np.int32), "at": np.array([min(e[3], 2) for _, e in sides], np.int32)}
    yield pa.RecordBatch.from_arrays([*(pa.array(told[n]) for n in carried), pa.array([r for r, _ in sides], pa.int64()),
                                      *(pa.array([e[k] for _, e in sides], pa.int64()) for k in range(3))], names=[*carried, "rank", "a", "gap", "b"])


def _rerank(pairs: DataFrame, level: int, name: str, jumps: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Positions whose pair (a, gap, b) occurs at least twice, with its number in the sorted order as rank, and the table to discard.
    Columns of pairs that are 0 in all rows may be left out, and aren't shuffled.

    The driver sees the first and last pair of each range only: two rows for a task, whatever the number of positions."""
    jumps = jumps or []
    order = [n for n in ("a", "gap", "b", "key", "i") if n in pairs.columns]
    columns = ", ".join([POSITION, *(f"{j} int" for j in jumps), "twice boolean, rank long, a long, gap long, b long"])
    ordered = pairs.repartitionByRange(*order).sortWithinPartitions(*order)
    table = materialize(ordered.mapInArrow(lambda b: _number_pairs(b, level, jumps), columns), name)
    joined = []
    for r in sorted(table.where("i < 0").select("rank", "a", "gap", "b", "at").collect()):
        if joined and joined[-1][0] == r[1:4]:
            joined[-1][1].append(r["rank"])
            joined[-1][2] += r["at"]
        else:
            joined.append([r[1:4], [r["rank"]], r["at"]])
    moved = [(rank, ranks[0], n > 1) for _, ranks, n in joined for rank in ranks]
    moved = pairs.sparkSession.createDataFrame(moved, "rank long, to long, stays boolean")
    rows = table.where("i >= 0").join(moved, "rank", "left").where(F.coalesce("stays", F.lit(True)))
    return rows.select("key", "i", "at", "rest", *jumps, "twice", F.coalesce("to", "rank").alias("rank")), table


def _doubled(anchors: DataFrame, length: int) -> DataFrame:
    """Columns key, i, at, rest, twice, rank: the positions with `length` - WINDOW bytes ahead whose last rank is not theirs alone."""
    jumps = _jumps(length)
    rows, table = _rerank(anchors, 0, "ranks-0", jumps)
    for level, jump in enumerate(jumps, 1):
        left = jumps[level:]
        other = rows.select("key", F.col("i").alias("next"), F.col("at").alias("next_at"), F.col("rank").alias("b"))
        pairs = rows.withColumn("next", F.col("i") + F.col(jump)).join(other, ["key", "next"])
        pairs = pairs.select("key", "i", "at", "rest", *left, "twice", F.col("rank").alias("a"), (F.col("next_at") - F.col("at")).cast("long").alias("gap"), "b")
        before = table
        rows, table = _rerank(pairs, level, f"ranks-{level}", left)
        discard(before)
        release(anchors.sparkSession)
    end = F.when(F.col("rest").bitwiseAND(F.lit(1)) == 1, F.col("at") + length).otherwise(F.shiftright("rest", 1))
    done = materialize(rows.where(F.col("at") + length - WINDOW <= end), "ranks")
    discard(table)
    return done


def _open_classes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Ranks of the positions that some string may belong to whose bytes are not all marked in its text."""
    for batch in batches:
        near, sure = batch.column("near"), batch.column("sure")
        at, rest, rank = (near.values.field(n).to_numpy().astype(np.int64) for n in ("at", "rest", "rank"))
        marked = sure.values.to_numpy().astype(np.int64)
        ends, low = np.where(rest & 1, at + length, rest >> 1), np.maximum(at - WINDOW + 1, 0)
        open_ = np.zeros(len(at), bool)
        for a, b, first, last in zip(near.offsets[:-1].to_pylist(), near.offsets[1:].to_pylist(), sure.offsets[:-1].to_pylist(), sure.offsets[1:].to_pylist()):
            if first == last:
                open_[a:b] = True
                continue
            covered = np.concatenate([[0], np.cumsum(_cover(marked[first:last], length, int(ends[a:b].max())))])
            open_[a:b] = covered[ends[a:b]] - covered[low[a:b]] < ends[a:b] - low[a:b]
        yield pa.RecordBatch.from_arrays([pa.array(rank[open_])], names=["rank"])


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Names of the windows around the listed positions of a text, each window once with all its positions: in a text
    shorter than `length` + WINDOW several positions have the same one."""
    roll = RollingHash()
    for batch in batches:
        for key, raw, chosen in zip(batch.column("key").to_pylist(), batch.column("raw"), batch.column("chosen")):
            text = Text(raw.as_py(), roll)
            at = np.sort(chosen.values.to_numpy().astype(np.int64))
            low, high = np.maximum(at - WINDOW + 1, 0), np.minimum(at + length, len(text.data))
            wide = high - low >= length
            at, low, high = at[wide], low[wide], high[wide]
            new = np.flatnonzero(np.diff(low, prepend=-1) | np.diff(high, prepend=-1))
            shared = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
            low, high = low[new], high[new]
            names = roll.ranges(text.prefix, low, high)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), key, np.int64)), shared, *(pa.array(x.astype(np.int32)) for x in (low, high - length)),
                                              pa.array(names.view(np.int64))], names=["key", "ats", "low", "high", "name"])


def _candidate_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Names over the full length of the positions in the windows of the listed positions of a text."""
    roll = RollingHash()
    for batch in batches:
        for key, raw, chosen in zip(batch.column("key").to_pylist(), batch.column("raw"), batch.column("chosen")):
            text = Text(raw.as_py(), roll)
            every = text.ranked()
            # every position belongs to the ranked one at or after it
            belong = np.repeat(np.isin(every, chosen.values.to_numpy()), np.diff(every, prepend=-1))
            position = np.flatnonzero(belong[:len(text.data) - length + 1])
            for cut in range(0, len(position), 1 << 17):
                part = position[cut:cut + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key, np.int64)), pa.array(part.astype(np.int32)),
                                                  pa.array(text.names(part, length).view(np.int64))], names=["key", "at", "name"])


def _cover(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, size), -1)
    return np.cumsum(edge)[:size] > 0


def _having(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The rows whose value of `name` is in `wanted`. Values with more than one of HEAVY rows are fewer than HEAVY; their rows
    are not shuffled by the value."""
    total = rows.count()
    heavy = [r[0] for r in rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HEAVY > total).select(name).collect()]
    often = [r[0] for r in wanted.where(F.col(name).isin(heavy)).select(name).collect()]
    return rows.where(F.col(name).isin(often)).unionByName(rows.where(~F.col(name).isin(heavy)).join(wanted, name, "left_semi").select(*rows.columns))


def repeated_starts(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Columns key, starts: for each text (its key, see `_keyed`) the starts of repeated strings that cover all removed bytes."""
    if length < WINDOW + BASE:
        raise ValueError(f"strings must have at least {WINDOW + BASE} bytes")
    spark = documents.sparkSession
    texts = _keyed(documents).select("key", "raw")
    long = texts.where(F.octet_length("raw") >= length)
    rows = materialize(long.mapInArrow(lambda b: _anchor_rows(b, length), ", ".join([POSITION, "a long", *(f"{j} int" for j in _jumps(length))])), "anchors")
    last = _doubled(rows, length)
    discard(rows)
    release(spark)
    whole, whole_table = _rerank(last.where("rest & 1 = 1").select("key", "i", "at", "twice", F.col("rank").alias("a"), F.col("rest").alias("b")),
                                 0, "ranks-whole")
    full = whole.select("key", "at")
    near = last.groupBy("key").agg(F.collect_list(F.struct("at", "rest", "rank")).alias("near"))
    sure = full.groupBy("key").agg(F.collect_set("at").alias("sure"))
    marks = near.join(sure, "key", "left").select("near", F.coalesce("sure", F.array().cast("array<int>")).alias("sure"))
    still = materialize(marks.mapInArrow(lambda b: _open_classes(b, length), "rank long").distinct(), "open-ranks")
    chosen = _having(last, still, "rank").groupBy("key").agg(F.collect_set("at").alias("chosen"))
    chosen = materialize(chosen, "open-anchors")
    discard(last)
    release(spark)

    def in_texts(listed: DataFrame) -> DataFrame:
        bitmap = membership(listed.select("key"))
        return texts.where(may_contain(bitmap, F.col("key"))).join(listed, "key").select("key", "raw", "chosen")

    windows = in_texts(chosen).mapInArrow(lambda b: _window_rows(b, length), "key long, ats array<int>, low int, high int, name long")
    windows = materialize(windows, "windows")
    release(spark)
    alike = materialize(windows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "ats")).alias("one")), "window-kinds")
    single = alike.select("one.key", F.explode("one.ats").alias("at")).groupBy("key").agg(F.collect_set("at").alias("chosen"))
    candidates = materialize(in_texts(single).mapInArrow(lambda b: _candidate_rows(b, length), "key long, at int, name long"), "candidates")
    release(spark)
    doubled = _having(windows, alike.where("n > 1").select("name"), "name").select("key", F.explode(F.array("low", "high")).alias("at"))
    alone = candidates.select("key", F.col("at").alias("i"), F.col("name").alias("a"))
    found, found_table = _rerank(alone, 0, "ranks-candidates")
    starts = full.unionByName(found.select("key", F.col("i").alias("at"))).unionByName(doubled)
    starts = materialize(starts.groupBy("key").agg(F.collect_set("at").alias("starts")), "starts")
    for table in (whole_table, found_table, still, chosen, windows, alike, candidates):
        discard(table)
    release(spark)
    return starts


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), text).alias("key"),
                            text.cast("binary").alias("raw"))


def _strip(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans, kept = [], []
        for raw, starts in zip(batch.column("raw"), batch.column("starts")):
            raw = raw.as_py()
            if not starts.is_valid or not len(starts):
                spans.append([])
                kept.append(raw)
                continue
            gone = _cover(starts.values.to_numpy().astype(np.int64), length, len(raw))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(batch.column("raw")).cast(pa.int64()),
                                          pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Columns doc_id, n_bytes, spans (array of start, end), kept (binary): one row for every row of `documents`.

    Texts are UTF-8 bytes, null counts as empty. Every byte inside a string of `length` bytes that also starts elsewhere, in
    the same text or another one, is removed; strings never cross texts and are judged on the input. Equal rows are
    occurrences of each other. Extra columns are ignored, an empty table gives an empty result.
    """
    starts = repeated_starts(documents, length)
    base = _keyed(documents)
    touched = may_contain(membership(starts.select("key")), F.col("key"))
    joined = base.where(touched).join(starts, "key", "left").select("doc_id", "raw", "starts")
    columns = "doc_id long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary"
    changed = joined.mapInArrow(lambda b: _strip(b, length), columns)
    same = base.where(~touched).select("doc_id", F.length("raw").cast("long").alias("n_bytes"),
                                       F.array().cast("array<struct<start: int, end: int>>").alias("spans"), F.col("raw").alias("kept"))
    return changed.unionByName(same)
