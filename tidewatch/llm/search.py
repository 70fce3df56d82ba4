"""Ranked lexical search by bit-sliced Bloom signatures: upper bounds first, exact scores only where they can matter.

`build_index` reads every text once. Documents of similar length form blocks; a block is a matrix with a row of bits (a
slice) for each position of the Bloom filter and a column for each document. A document sets its terms' positions once for
each level of occurrences (1, 2, 3, 5, 9, 17) that the term reaches. The same pass counts in how many documents each term occurs.

`search` ands the slices of a term at each level, which finds at least the documents that have it so often, and sums the weights
over the terms: an upper bound of every document's score. The documents with the best bounds are scored from their texts,
and the k-th best score of a query excludes all documents whose bound is below. The rest is scored from the texts.
The filter only ever overestimates, so the result is exact whatever its size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import RollingHash, mix64, pieces, utf8
from tidewatch.runtime import materialize

#: Bytes of terms: digits, letters and all beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
TERM_PATTERN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LEVELS = (1, 2, 3, 5, 9, 17)       # occurrences; a bound takes the next level less one
BITS, HASHES = 12, 4               # of the filter for each key
BLOCK_DOCS = 1024
BLOCK_BITS = 1 << 22               # of a block's matrix: half a megabyte
PENDING = 1 << 21                  # keys that a task gathers before it makes blocks
COUNTED = 200_000                  # terms that a task counts before it hands them on
LOT = 1000                         # queries looked up together
FIRST = 64                         # documents by bound whose scores give a query's limit
INDEX = "term binary, df long, bits int, slices binary, names array<bigint>, sizes array<int>, tops array<int>"


def row_name() -> Column:
    """Rows with one name are scored together; a clash of names only costs time."""
    return F.xxhash64("doc_id", "text")


def terms_of(text: str | None) -> list[bytes]:
    return TERM_PATTERN.findall((text or "").encode().lower())


LEVEL_SALTS = np.arange(1, len(LEVELS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def positions(keys: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """The places (one column for each hash) of terms' hashes at a level in a filter of so many bits."""
    first = mix64(keys + LEVEL_SALTS[level])
    second = mix64(first) | np.uint64(1)
    return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * second[:, None]) % np.uint64(bits)).astype(np.int64)


# ---- index


@dataclass
class Pending:
    """Documents that wait for a block: for each its name, terms, most occurrences; and their (document, hash, level)s."""

    names: list[int]
    sizes: list[int]
    tops: list[int]
    keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def blocks(self) -> Iterator[tuple]:
        names, sizes, tops = (np.array(x, np.int64) for x in (self.names, self.sizes, self.tops))
        owner, key, level = (np.concatenate(x) for x in zip(*self.keys))
        count = np.bincount(owner, minlength=len(names))
        order = np.argsort(count, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        owner = place[owner]
        by_owner = np.argsort(owner, kind="stable")
        owner, key, level = owner[by_owner], key[by_owner], level[by_owner]
        low = 0
        while low < len(order):
            most = max(8, 2 * int(count[order[low]]))
            high = int(np.searchsorted(count[order], most, side="right"))
            high = min(high, low + BLOCK_DOCS, low + max(1, BLOCK_BITS // (BITS * most)))
            docs = order[low:high]
            bits = BITS * max(8, int(count[docs[-1]]))
            matrix = np.zeros((bits, -(-len(docs) // 8) * 8), bool)
            own = slice(*np.searchsorted(owner, (low, high)))
            matrix[positions(key[own], level[own], bits), (owner[own] - low)[:, None]] = True
            yield bits, np.packbits(matrix, axis=1).tobytes(), names[docs], sizes[docs], tops[docs]
            low = high


def _rows(terms: dict[bytes, int], blocks: list[tuple]) -> pa.RecordBatch:
    n, m = len(terms), len(blocks)
    bits, slices, names, sizes, tops = zip(*blocks) if blocks else ((),) * 5
    return pa.RecordBatch.from_arrays([
        pa.array([*terms, *[None] * m], pa.binary()), pa.array([*terms.values(), *[None] * m], pa.int64()),
        pa.array([*[None] * n, *bits], pa.int32()), pa.array([*[None] * n, *slices], pa.binary()),
        *(pa.array([*[None] * n, *(x.tolist() for x in part)], pa.list_(kind)) for part, kind in ((names, pa.int64()), (sizes, pa.int32()), (tops, pa.int32())))],
        names=["term", "df", "bits", "slices", "names", "sizes", "tops"])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, and how often it occurs."""
    order = np.argsort(keys)
    head = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]])[:len(keys)])
    return order[head], np.diff(np.append(head, len(keys)))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roll, counts, wait, waiting = RollingHash(), {}, Pending([], [], [], []), 0
    for whole in batches:
        for batch in pieces(whole, "text"):
            data, offsets = utf8(batch.column("text"))
            if not len(data):
                continue
            solid = TERM[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            start = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | edge[:-1]))
            end = np.flatnonzero(solid & (~np.append(solid[1:], False) | edge[1:])) + 1
            data = LOWER[data]
            keys = roll.ranges(roll.prefix(data), start, end)
            doc = np.searchsorted(offsets, start, side="right") - 1
            at, often = _groups(mix64(keys + mix64(doc.astype(np.uint64) + np.uint64(1))))
            term, owner = keys[at], doc[at]
            one, n = _groups(term)      # documents of each term
            raw = data.tobytes()
            for a, b, k in zip(start[at[one]].tolist(), end[at[one]].tolist(), n.tolist()):
                word = raw[a:b]
                counts[word] = counts.get(word, 0) + k
            # keys of each document
            size = np.bincount(doc, minlength=batch.num_rows)
            top = np.zeros(batch.num_rows, np.int64)
            np.maximum.at(top, owner, often)
            used = np.flatnonzero(size)
            number = np.full(batch.num_rows, -1)
            number[used] = len(wait.names) + np.arange(len(used))
            wait.names += batch.column("name").to_numpy()[used].tolist()
            wait.sizes += size[used].tolist()
            wait.tops += top[used].tolist()
            for level, least in enumerate(LEVELS):
                has = often >= least
                wait.keys.append((number[owner[has]], term[has], np.full(int(has.sum()), level, np.int8)))
                waiting += int(has.sum())
            if waiting > PENDING:
                for block in wait.blocks():
                    yield _rows({}, [block])
                wait, waiting = Pending([], [], [], []), 0
            if len(counts) > COUNTED:
                yield _rows(counts, [])
                counts = {}
    if wait.names:
        for block in wait.blocks():
            yield _rows({}, [block])
    yield _rows(counts, [])


def build_index(documents: DataFrame) -> DataFrame:
    """Index of all `documents` (doc_id, text), written as a table: rows with a term hold counts to be summed, the others
    blocks of documents. Texts without a term (null, empty) are in no block."""
    base = documents.select(row_name().alias("name"), F.col("text").cast("string").alias("text"))
    return materialize(base.mapInArrow(_index, INDEX), "signatures")


# ---- search


@dataclass(frozen=True)
class Lot:
    """Queries with their terms (as numbers, with repeats), the terms' hashes and weights, and the corpus' counts."""

    ids: list
    terms: list[list[int]]
    words: list[bytes]
    keys: np.ndarray
    weights: np.ndarray
    documents: int
    length: int

    def penalty(self, n: np.ndarray | int):
        return 100 - 25 + 25 * n * self.documents // self.length


def factor(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def bounds(lot: Lot, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block its documents' names and an upper bound of the score for each query and document."""
    plans = [(np.array(sorted(c := Counter(t)), np.int64), np.array([c[k] for k in sorted(c)], float)) for t in lot.terms]
    for bits, slices, names, sizes, tops in zip(*(batch.column(c) for c in ("bits", "slices", "names", "sizes", "tops"))):
        bits, names = bits.as_py(), names.values.to_numpy()
        n, top = sizes.values.to_numpy().astype(np.int64), tops.values.to_numpy().astype(np.int64)
        matrix = np.frombuffer(slices.as_buffer(), np.uint8).reshape(bits, -1)
        m = lot.penalty(n)
        total = np.zeros((len(plans), len(names)))
        alive, before = np.arange(len(lot.keys)), np.zeros(len(names), np.int64)
        has = None
        for number, least in enumerate(LEVELS):
            most = np.minimum(LEVELS[number + 1] - 1, top) if number + 1 < len(LEVELS) else top
            value = factor(np.maximum(most, 1), m)
            found = np.bitwise_and.reduce(matrix[positions(lot.keys[alive], number, bits)], axis=1)
            found = found if has is None else found & has
            some = found.any(axis=1)
            alive, has = alive[some], found[some]
            if not len(alive):
                break
            present = np.unpackbits(has, axis=1, count=len(names)).astype(float) * lot.weights[alive, None]
            place = np.full(len(lot.keys), -1)
            place[alive] = np.arange(len(alive))
            gain = np.maximum(value - before, 0).astype(float)
            for i, (terms, times) in enumerate(plans):
                at = place[terms]
                if (at >= 0).any():
                    total[i] += (times[at >= 0] @ present[at[at >= 0]]) * gain
            before = np.maximum(value, before)
        yield names, total


def best_bounds(index: DataFrame, lot: Lot, first: int) -> DataFrame:
    """(query, name): of each query the documents with the highest bounds, `first` at least if so many have one above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, who = np.zeros((len(lot.terms), first)), np.zeros((len(lot.terms), first), np.int64)
        for batch in batches:
            for names, bound in bounds(lot, batch):
                top = np.concatenate([top, bound], axis=1)
                who = np.concatenate([who, np.tile(names, (len(lot.terms), 1))], axis=1)
                at = np.argpartition(-top, first - 1, axis=1)[:, :first]
                top, who = np.take_along_axis(top, at, 1), np.take_along_axis(who, at, 1)
        query, column = np.nonzero(top > 0)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(who[query, column], pa.int64()), pa.array(top[query, column])], names=["query", "name", "bound"])

    blocks = index.where("term is null").select("bits", "slices", "names", "sizes", "tops")
    found = blocks.mapInArrow(run, "query int, name long, bound double")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "name")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).select("query", "name")


def not_excluded(index: DataFrame, lot: Lot, limits: np.ndarray) -> DataFrame:
    """(query, name): documents whose bound reaches the query's limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, bound in bounds(lot, batch):
                query, column = np.nonzero(bound >= np.maximum(limits, 1)[:, None])
                if len(query):
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(names[column], pa.int64())], names=["query", "name"])

    blocks = index.where("term is null").select("bits", "slices", "names", "sizes", "tops")
    return blocks.mapInArrow(run, "query int, name long")


def scored(documents: DataFrame, candidates: DataFrame, lot: Lot) -> DataFrame:
    """(query, doc_id, score) of the candidates' whole texts, by counting their terms. A document has at most one row for each query of the lot."""
    wanted = candidates.groupBy("name").agg(F.collect_set("query").alias("queries"))
    rows = documents.select(row_name().alias("name"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(lot.words)}
        weights = lot.weights.tolist()
        for batch in batches:
            out = []
            for doc_id, text, queries in zip(*(batch.column(c) for c in ("doc_id", "text", "queries"))):
                words = terms_of(text.as_py())
                m = lot.penalty(len(words))
                has = {number[w]: k for w, k in Counter(words).items() if w in number}
                value = {t: weights[t] * factor(tf, m) for t, tf in has.items()}
                for q in queries.as_py():
                    score = sum(value.get(t, 0) for t in lot.terms[q])
                    if score > 0:
                        out.append((q, doc_id.as_py(), score))
            query, doc, score = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

    joined = rows.join(wanted, "name").select("doc_id", "text", "queries")
    return joined.mapInArrow(run, "query int, doc_id long, score long")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lots_of(index: DataFrame, queries: DataFrame) -> Iterator[Lot]:
    """The queries in lots of LOT, each with what the corpus says about its terms."""
    spark = index.sparkSession
    sums = index.where("term is null").agg(F.sum(F.size("names")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    documents, length = sums[0] or 0, sums[1] or 0
    items = materialize(queries.select("item_id", F.col("text").cast("string").alias("text")).repartition(max(1, -(-queries.count() // LOT))), "queries")
    for part in sorted(r["part"] for r in items.select(F.spark_partition_id().alias("part")).distinct().collect()):
        rows = items.where(F.spark_partition_id() == part).collect()
        own = [terms_of(r["text"]) for r in rows]
        words = sorted({w for t in own for w in t})
        if not words or not documents:
            continue
        asked = spark.createDataFrame([(w,) for w in words], "term binary")
        df = {bytes(r["term"]): r["df"] for r in index.where("term is not null").select("term", "df").join(F.broadcast(asked), "term")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()}
        number = {w: i for i, w in enumerate(words)}
        roll, ends = RollingHash(), np.cumsum([0, *map(len, words)])
        keys = roll.ranges(roll.prefix(np.frombuffer(b"".join(words), np.uint8)), ends[:-1], ends[1:])
        weights = np.array([weight(documents, df.get(w, 0)) for w in words], np.int64)
        yield Lot([r["item_id"] for r in rows], [[number[w] for w in t] for t in own], words, keys, weights, documents, length)


def search(index: DataFrame, documents: DataFrame, queries: DataFrame, k: int = 20, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query row (item_id, text) its k highest-scoring documents with a score above 0.

    Equal scores by ascending doc_id, missing ids last; repeated rows of either table each count, and equal rows get ranks of
    their own. A query or text that is null or has no term has no results. Queries are read in lots of LOT, so only these and
    their terms pass through the driver; other columns are ignored.
    """
    spark, out = index.sparkSession, None
    kind = queries.schema["item_id"].dataType.simpleString()
    for lot in lots_of(index, queries):
        start = ranked(scored(documents, best_bounds(index, lot, first), lot), k).groupBy("query").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n"))
        limits = np.zeros(len(lot.ids))
        for r in start.collect():
            limits[r["query"]] = r["score"] if r["n"] == k else 0
        found = ranked(scored(documents, not_excluded(index, lot, limits), lot), k)
        names = spark.createDataFrame(list(enumerate(lot.ids)), f"query int, item_id {kind}")
        found = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out
