"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries.

Two fingerprints within the error budget agree in at least one of budget + 1 blocks of bits. For every block, the
fingerprints are dealt by its value; below it they form a binary trie. Node pairs of a trie are traversed together
from the top, differing bits add up, and a pair is dropped once they exceed the budget. Tries that hold too many
fingerprints are cut at deeper nodes, and the pairs of such nodes within the budget become units of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import by_place, only
from tidewatch.llm.components import components
from tidewatch.runtime import materialize

SEED = 42
MASK = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()      # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:len(words) - span + 1].tolist(), ends[span - 1:].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * total > len(hashes)) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """Columns doc_id, digest (of the text), fp (64 bits in a long). A null text counts as empty; without words, fp is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in batch.column("raw")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(values.view(np.int64))],
                                             names=["doc_id", "digest", "fp"])

    texts = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"),
                             F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))
    return texts.mapInArrow(run, "doc_id long, digest long, fp long")


def _digest(text: str = "text"):
    return F.xxhash64(F.col(text).cast("string"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_pairs(values: np.ndarray, groups: np.ndarray, budget: int, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of `values` in the same group that differ in at most `budget` bits. `values` is sorted by group, then
    value; a node of a trie is a range of it. The frontier is worked off depth first in bounded chunks."""
    edges = np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), len(values))
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(63, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))] if len(lo) else []
    while stack:
        bit, front = stack.pop()
        if front.shape[1] > chunk:
            stack += [(bit, front[:, :chunk]), (bit, front[:, chunk:])]
            continue
        a0, a1, b0, b1, diff = front
        single = (a1 - a0 == 1) & (b1 - b0 == 1) & (a0 != b0)
        if single.any():
            i, j = a0[single], b0[single]
            near = _popcount(values[i] ^ values[j]) <= budget
            yield i[near], j[near]
        if bit < 0:
            continue
        front = front[:, ~single]
        a0, a1, b0, b1, diff = front
        if not len(a0):
            continue
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        same = a0 == b0
        down = [np.stack([a0, am, b0, bm, diff]), np.stack([am, a1, bm, b1, diff]), np.stack([a0, am, bm, b1, diff + 1]),
                np.stack([am, a1, b0, bm, diff + 1])[:, ~same]]
        front = np.concatenate(down, axis=1)
        a0, a1, b0, b1, diff = front
        alive = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        stack.append((bit - 1, front[:, alive]))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """For each range, where the values with this bit set begin (all higher bits are equal inside a range)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (values[np.minimum(mid, len(values) - 1)] >> np.uint64(bit)) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index reachable by the pairs, for every index."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _local_links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Links inside the units of a partition that is sorted by unit: a spanning forest of each, as pairs of fingerprints."""
    held_u, held_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def solve(units, values):
        order = np.lexsort((values, units))
        units, values = units[order], values[order]
        root = _forest(len(values), trie_pairs(values, units, budget))
        moved = np.flatnonzero(root != np.arange(len(values)))
        return pa.RecordBatch.from_arrays([pa.array(values[moved].view(np.int64)), pa.array(values[root[moved]].view(np.int64))], names=["u", "v"])

    for batch in batches:
        units = np.concatenate([held_u, batch.column("unit").to_numpy(zero_copy_only=False)])
        values = np.concatenate([held_v, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(units):
            continue
        cut = int(np.searchsorted(units, units[-1]))
        if cut:
            yield solve(units[:cut], values[:cut])
        held_u, held_v = units[cut:], values[cut:]
    if len(held_u):
        yield solve(held_u, held_v)


def _bits(column, start: int, width: int):
    """`width` bits of a long from bit `start` (0 is the highest)."""
    return F.shiftrightunsigned(column, 64 - start - width).bitwiseAND(F.lit((1 << width) - 1))


def near_links(unique: DataFrame, budget: int = 2, unit_rows: int = 20_000) -> DataFrame:
    """Pairs u, v of fingerprints (column fp, distinct) that connect everything within `budget` bits."""
    blocks = budget + 1
    ends = [64 * (k + 1) // blocks for k in range(blocks)]
    starts = [0, *ends[:-1]]
    dealt = unique.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), _bits(F.col("fp"), s, e - s).alias("node")) for k, (s, e) in enumerate(zip(starts, ends))])).alias("x")
    ).select("fp", "x.block", "x.node")
    # Rotated so that the bits after the block lead: the trie below a block value.
    rotated = F.coalesce(*[F.when(F.col("block") == k, F.shiftleft("fp", e % 64).bitwiseOR(F.shiftrightunsigned("fp", 64 - e)) if e % 64 else F.col("fp"))
                           for k, e in enumerate(ends)])
    dealt = materialize(dealt.withColumn("below", rotated), "tries")
    counts = dealt.groupBy("block", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialize(counts, "trie-sizes")
    depth = {}
    large = counts.where(F.col("n") > unit_rows).select("block", "node")
    # Depth at which every node of a large trie is small enough; chosen for each trie from the counts of its nodes.
    deep = dealt.join(large, ["block", "node"])
    sizes = None
    for d in (8, 16, 24, 32, 40):
        level = (deep.groupBy("block", "node", _bits(F.col("below"), 0, d).alias("sub")).agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("block", "node").agg(F.max("n").alias("most"))
                 .select("block", "node", F.lit(d).alias("depth"), "most"))
        sizes = level if sizes is None else sizes.unionByName(level)
        depth[d] = [sum(1 << b for b in bits) for bits in _ball(d, budget)]
    chosen = sizes.groupBy("block", "node").agg(F.coalesce(F.min(F.when(F.col("most") <= unit_rows // 2, F.col("depth"))), F.lit(40)).alias("depth"))
    unit = F.xxhash64
    plain = (dealt.join(counts.where(F.col("n") <= unit_rows).select("block", "node"), ["block", "node"])
             .select(unit("block", "node").alias("unit"), "fp"))
    if large.isEmpty():
        work = plain
    else:
        placed = deep.join(materialize(chosen, "trie-depths"), ["block", "node"])
        cut = None
        for d, ball in depth.items():
            sub = _bits(F.col("below"), 0, d)
            part = (placed.where(F.col("depth") == d)
                    .select("block", "node", "fp", sub.alias("own"), F.explode(F.transform(F.lit(ball).cast("array<bigint>"), lambda x: x.bitwiseXOR(sub))).alias("other"))
                    .select(unit("block", "node", F.lit(d), F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "fp"))
            cut = part if cut is None else cut.unionByName(part)
        work = plain.unionByName(cut)
    work = work.repartition("unit").sortWithinPartitions("unit")
    return work.mapInArrow(lambda batches: _local_links(batches, budget), T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])).distinct()


def _ball(width: int, budget: int) -> list[tuple[int, ...]]:
    from itertools import combinations

    return [c for r in range(budget + 1) for c in combinations(range(width), r)]


def near_groups(documents: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """Columns doc_id, digest, fp, root, component_id: one row for every row of `documents` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most `budget` differing bits, root the smallest
    fingerprint. A null text counts as empty, texts without words share fingerprint 0, texts below the shingle length
    have one shingle. Null ids are grouped like others but never name a group unless all its ids are null. Repeated
    rows stay, extra columns are ignored, an empty table gives an empty result.
    """
    prints = materialize(fingerprints(documents, shingle), "fingerprints")
    unique = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints-distinct")
    roots = components(near_links(unique.select("fp"), budget))
    placed = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    group = materialize(placed.select("fp", "root").join(names, "root").select("fp", "root", "component_id"), "groups")
    return prints.join(group, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def keep_one(documents: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """One document of each group, with the columns of `documents`: the row whose doc_id names the group. Of several rows
    with that id the one with the smallest text digest stays, of equal texts the smallest row."""
    placed, [doc, text] = by_place(documents, "doc_id", "text")
    groups = near_groups(documents, shingle, budget).where("doc_id <=> component_id")
    best = groups.groupBy("root").agg(F.min(F.struct("digest", "doc_id")).alias("best"))
    kept = (groups.select("root", "digest", "doc_id").join(best, "root").where("digest = best.digest")
            .groupBy(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).agg(F.count(F.lit(1)).alias("rows")))
    kept = materialize(kept, "kept")
    same = F.col(doc).cast("long").eqNullSafe(F.col("kept_id")) & (_digest(text) == F.col("kept_digest"))
    once = placed.join(kept.where("rows = 1"), same, "left_semi")
    again = placed.join(kept.where("rows > 1"), same, "left_semi")
    least = again.groupBy(F.col(doc).cast("long"), _digest(text)).agg(F.min(F.struct(*placed.columns)).alias("first"))
    return once.unionByName(least.select(*[F.col("first").getField(c).alias(c) for c in placed.columns])).toDF(*documents.columns)
