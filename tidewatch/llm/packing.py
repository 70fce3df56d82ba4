"""Best-fit packing of documents into training sequences under conflict constraints.

Texts longer than a sequence are cut into full pieces and a rest; full pieces are sequences of their own. Rests are
dealt into independent lots of bounded size by a hash, so copies and large sources spread over all lots. In a lot the
open bins are ordered by residual space and carry bitmaps of their sources and duplicate clusters: for each piece,
largest first, the search starts at the tightest bin that has room and goes on to the next larger residual until
no bitmap conflicts; else it opens a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES_PATTERN
from tidewatch.llm.mixing import size_of
from tidewatch.runtime import materialize

CAPACITY = 2048
PER_SOURCE = 3
LOT_PIECES = 4000


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, slot) of every piece. A bin takes at most one piece of a cluster and `per_source` pieces of a source: the
    source bitmap of a bin has `per_source` planes of bits, filled in turn."""
    n_sources = {s: k for k, s in enumerate(dict.fromkeys(sources))}
    n_clusters = {c: k for k, c in enumerate(dict.fromkeys(clusters))}
    width = len(n_sources)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    open_bins: list[tuple[int, int]] = []            # (residual, bin), ascending
    source_bits, cluster_bits, filled = [], [], []
    placed = [(0, 0)] * len(sizes)
    for i in order:
        size, cluster = sizes[i], 1 << n_clusters[clusters[i]]
        source = 1 << n_sources[sources[i]]
        full = source << width * (per_source - 1)
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not cluster_bits[b] & cluster and not source_bits[b] & full:
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(filled)
            source_bits.append(0)
            cluster_bits.append(0)
            filled.append(0)
        plane = source
        while source_bits[b] & plane:
            plane <<= width
        source_bits[b] |= plane
        cluster_bits[b] |= cluster
        placed[i] = (b, filled[b])
        filled[b] += 1
        if residual > size:
            insort(open_bins, (residual - size, b))
    return placed


def pack(documents: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, lot_pieces: int = LOT_PIECES) -> DataFrame:
    """Columns doc_id, source, copy, piece, start_word, n_words, cluster, bin_id, slot: one row for every piece.

    A piece is a run of at most `capacity` words of a text; all words of all texts are in exactly one piece, and a text
    without words has one piece of 0 words. A cluster is the set of rows with the same words; two of its pieces with
    the same number never share a bin, nor do more than `per_source` pieces of a source. Rows with equal ids are told
    apart by copy (1, 2, ...); null ids, texts and sources count as values of their own. Extra columns are ignored;
    an empty table gives an empty result. No text is moved, only sizes and digests.
    """
    words = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES_PATTERN, " "))
    base = materialize(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(words).alias("cluster"), size_of(F.col("text").cast("string")).alias("size")), "packing")
    # Equal rows become numbered copies without gathering them: counted, then dealt out again.
    counted = base.groupBy("doc_id", "source", "cluster", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    last = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int")
    split = (rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last - 1)))
             .withColumn("start_word", F.col("piece").cast("long") * capacity)
             .withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start_word"))))
    split = split.drop("size")
    number = split.where(F.col("n_words") < capacity).count()
    lots = max(1, -(-number // lot_pieces))
    key = F.xxhash64("doc_id", "source", "cluster", "copy", "piece")
    lot = F.pmod(key, F.lit(lots))
    full = split.where(F.col("n_words") == capacity).withColumn("bin_id", F.concat(F.lit("full-"), F.hex(key))).withColumn("slot", F.lit(0))
    rest = split.where(F.col("n_words") < capacity).withColumn("lot", lot)
    names = ["doc_id", "source", "copy", "piece", "start_word", "n_words", "cluster"]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "cluster", "piece", "doc_id", "source", "copy"], ascending=[False] + [True] * 5, kind="stable")
        sources = part["source"].where(part["source"].notna(), None).tolist()
        placed = best_fit(part["n_words"].tolist(), sources, list(zip(part["cluster"], part["piece"])), capacity, per_source)
        head = f"{part['lot'].iloc[0]}-"
        out = part[names].copy()
        out["bin_id"], out["slot"] = [head + str(b) for b, _ in placed], [s for _, s in placed]
        return out

    schema = "doc_id long, source string, copy int, piece int, start_word long, n_words long, cluster long, bin_id string, slot int"
    tasks = min(lots, max(200, lots // 16))
    packed = rest.repartition(tasks, "lot").groupBy("lot").applyInPandas(solve, schema)
    return packed.unionByName(full.select(*names, "bin_id", "slot"))


def sequences(documents: DataFrame, placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Columns bin_id, n_words, doc_ids, text: the packed sequences, pieces in slot order, one line each.

    A bin holds at most `capacity` words, which bounds what a task gathers for it; words of null or empty texts add nothing.
    """
    words = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES_PATTERN, " "))
    texts = documents.select(F.col("doc_id").cast("long").alias("text_id"), words.alias("words")).withColumn("cluster_of", F.xxhash64("words")).distinct()
    joined = placed.join(texts, F.col("doc_id").eqNullSafe(F.col("text_id")) & (F.col("cluster") == F.col("cluster_of")))
    piece = F.array_join(F.slice(F.split("words", " "), (F.col("start_word") + 1).cast("int"), F.greatest(F.col("n_words").cast("int"), F.lit(1))), " ")
    parts = F.array_sort(F.collect_list(F.struct("slot", "doc_id", piece.alias("part"))))
    return (joined.groupBy("bin_id").agg(F.sum("n_words").alias("n_words"), parts.alias("parts"))
            .select("bin_id", "n_words", F.col("parts.doc_id").alias("doc_ids"), F.array_join("parts.part", "\n").alias("text")))
