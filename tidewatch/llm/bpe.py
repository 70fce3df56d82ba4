"""Byte-level BPE: frequent words by a minimal acyclic transducer, unseen ones by exact merging, and back.

Spark counts the words of all texts. The most frequent ones are merged once and compiled into a transducer
(`transducer.py`) whose outputs are places in a flat array of ids; with the vocabulary it lies in one file that every
worker maps into memory. A task follows the words of about a megabyte of text through it together. A word that is not in it is
merged by its ranks, so which words are compiled changes the time and never the result.

Long texts are cut before a blank that follows a solid ASCII character. No token of the pattern crosses such a place and
none looks beyond it, so memory is bounded by the longest stretch without one.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from tidewatch.llm.arrays import mapped, publish
from tidewatch.llm.common import RollingHash, pieces, utf8
from tidewatch.llm.transducer import compile_words, rank
from tidewatch.runtime import discard, materialize

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Letters end before this code point in every edition of Unicode so far.
CLASSED = 0x34000
#: Endings that the pattern splits off after an apostrophe. Fixed values of the vocabulary's pattern.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
LEXICON = 1 << 17      # words compiled at most
LONGEST = 32           # bytes of a compiled word
PIECE = 1 << 20        # bytes of text looked at together
COUNTED = 200_000      # words that a task counts before it hands them on
WIDTHS = (8, 16, 32, 64)   # bytes of words that are merged together
TABLE_ROWS = 1 << 14


# ---- vocabulary


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if it is printable Latin-1, else the next code
    points after 255."""
    solid = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(solid)]
    return {chr(b): b for b in solid} | {chr(256 + k): b for k, b in enumerate(odd)}


def read_vocabulary(path: str) -> dict[str, np.ndarray]:
    """The vocabulary file as arrays: bytes of each id, merges by rank, added strings. Files of another kind are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"]
    plain = (model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
             and spec["normalizer"] is None and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"])
    added = spec["added_tokens"]
    if not plain or any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] or not a["content"] or set(a["content"]) & set(" \t\n\r\f\v") for a in added):
        raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
    letters = byte_letters()
    size = max([*model["vocab"].values(), *(a["id"] for a in added)]) + 1
    content = [b""] * size
    for token, i in model["vocab"].items():
        content[i] = bytes(letters[c] for c in token)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    for a in added:
        content[a["id"]] = a["content"].encode()
    ids = model["vocab"]
    merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    single = {b: ids[c] for c, b in letters.items()}
    return {"token_bytes": np.frombuffer(b"".join(content), np.uint8), "token_ends": np.cumsum([0, *map(len, content)]).astype(np.int64),
            "merges": merges.reshape(-1), "bytes": np.array([single[b] for b in range(256)], np.int64),
            "added": np.array(sorted(a["id"] for a in added), np.int64), "classes": code_point_classes()}


@functools.cache
def code_point_classes() -> np.ndarray:
    """Kind of each code point as the library's own pattern has it: which of a letter, a digit and a sign it stays with."""
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    out = np.full(CLASSED, SPACE, np.uint8)
    for low in range(0, CLASSED, 1 << 15):
        points = [c for c in range(low, min(low + (1 << 15), CLASSED)) if not 0xD800 <= c < 0xE000]
        for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            found = cut.pre_tokenize_str("".join(probe + chr(c) for c in points))
            starts = np.array([span[0] for _, span in found])
            apart = np.zeros(2 * len(points), bool)
            apart[starts] = True
            out[np.array(points, np.int64)[~apart[1::2]]] = kind
    return out


class Merger:
    """Merges the bytes of words by rank: always the leftmost of the pairs with the lowest rank.

    Words of up to the last of WIDTHS bytes are merged together as rows of a table, one pair of each in a step; longer ones by a heap.
    """

    def __init__(self, merges: np.ndarray, singles: np.ndarray):
        left, right, self.made = merges.reshape(-1, 3).T
        self.size, self.singles = int(max(merges.max(initial=0), singles.max())) + 1, singles
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys, self.none = keys[self.order], len(keys)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, `none` where there is no such merge."""
        if not self.none:
            return np.zeros(len(left), np.int64)
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), self.none - 1)
        return np.where(self.keys[at] == wanted, self.order[at], self.none)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        size = np.zeros(len(starts), np.int64)
        found, low = [], 0
        for width in WIDTHS:
            rows = np.flatnonzero((ends - starts > low) & (ends - starts <= width))
            for part in np.array_split(rows, -(-len(rows) // TABLE_ROWS)) if len(rows) else ():
                ids, size[part] = self._table(data, starts[part], ends[part], width)
                found.append((part, ids))
            low = width
        for row in np.flatnonzero(ends - starts > low).tolist():
            ids = np.array(self._heap(self.singles[data[starts[row]:ends[row]]].tolist()), np.int64)
            size[row] = len(ids)
            found.append((np.array([row]), ids))
        to = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        for rows, ids in found:
            out[spread(to[rows], size[rows])] = ids
        return out, size

    def _table(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, column = len(starts), np.arange(width)
        inside = column < (ends - starts)[:, None]
        ids = np.where(inside, self.singles[data[np.minimum(starts[:, None] + column, len(data) - 1)]], -1)
        rank = np.full((n, width), self.none)
        pair = inside[:, 1:]
        rank[:, :-1][pair] = self.ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        after = np.where(column + 1 < (ends - starts)[:, None], column + 1, -1)
        before = np.tile(column - 1, (n, 1))
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(axis=1)
            low = rank[rows, at]
            left = low < self.none
            rows, at, low = rows[left], at[left], low[left]
            gone = after[rows, at]
            ids[rows, at], ids[rows, gone] = self.made[low], -1
            rank[rows, gone] = self.none
            follow = after[rows, gone]
            after[rows, at] = follow
            more = follow >= 0
            before[rows[more], follow[more]] = at[more]
            rank[rows, at] = self.none
            rank[rows[more], at[more]] = self.ranks(ids[rows[more], at[more]], ids[rows[more], follow[more]])
            lead = before[rows, at]
            more = lead >= 0
            rank[rows[more], lead[more]] = self.ranks(ids[rows[more], lead[more]], ids[rows[more], at[more]])
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        todo = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < self.none]
        heapq.heapify(todo)
        known: dict[tuple[int, int], int] = {}
        while todo:
            r, i, left, right = heapq.heappop(todo)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    pair = ids[a], ids[b]
                    if pair not in known:
                        known[pair] = int(self.ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if known[pair] < self.none:
                        heapq.heappush(todo, (known[pair], a, *pair))
        return [i for i in ids if i >= 0]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then those of the next."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


# ---- words


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first bytes of all characters, and their code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    if len(at) == len(data):
        return at, lead
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    follow = [(padded[at + k] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
    two, three, four = lead >= 0xC0, lead >= 0xE0, lead >= 0xF0
    out = np.where(two, (lead & 0x1F) << 6 | follow[0], lead)
    out = np.where(three, (lead & 0x0F) << 12 | follow[0] << 6 | follow[1], out)
    return at, np.where(four, (lead & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2], out)


def word_starts(data: np.ndarray, edges: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First bytes of the pattern's words. `edges`: where a text or part begins, so that no word crosses it."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, point = code_points(data)
    kind = np.where(point < len(classes), classes[np.minimum(point, len(classes) - 1)], OTHER)
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    first = first[at]
    last = np.append(first[1:], True)
    space, blank = kind == SPACE, point == 32
    before = np.empty_like(kind)
    before[0], before[1:] = SPACE, kind[:-1]
    blank_before = np.append(False, blank[:-1])
    next_solid = np.append(~space[1:], False) & ~last
    start = np.where(space, (before != SPACE) | next_solid, (kind != before) & ~blank_before) | first
    # endings: an apostrophe that begins a word takes its letters and ends there
    for i in np.flatnonzero((point == 39) & start & next_solid):
        for ending in ENDINGS:
            stop = i + 1 + len(ending)
            if stop <= len(point) and not first[i + 1:stop].any() and all(point[i + 1 + k] == ord(c) for k, c in enumerate(ending)):
                start[i + 1] = False
                if stop < len(point) and kind[stop] != SPACE:
                    start[stop] = True
                break
    return at[start]


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row offsets, and further places in rows over twice PIECE bytes at which nothing changes by cutting."""
    out = [offsets]
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if high - low > 2 * PIECE:
            part = data[low:high]
            solid = (part[:-1] > 32) & (part[:-1] < 127)
            places = np.flatnonzero(solid & ((part[1:] == 32) | (part[1:] == 10))) + 1
            if len(places):
                wanted = np.searchsorted(places, np.arange(PIECE, high - low - PIECE, PIECE))
                out.append(low + np.unique(places[np.minimum(wanted, len(places) - 1)]))
    return np.unique(np.concatenate(out)) if len(out) > 1 else offsets


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of rows, each with its bytes in parts of about PIECE bytes: (bytes, edges in them, the rows' and the parts' own)."""
    for whole in batches:
        for batch in pieces(whole, "text", PIECE):
            data, offsets = utf8(batch.column("text"))
            cuts = safe_cuts(data, offsets)
            if len(cuts) == len(offsets):
                yield batch, [(data, offsets)]
            else:
                yield batch, [(data[a:b], np.array([0, b - a])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def word_counts(documents: DataFrame, classes: str, longest: int) -> DataFrame:
    """(word, n): the words of all texts of at most `longest` bytes. Summed in the task, then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, kinds, counts = RollingHash(), mapped(classes)["classes"], {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for _, parts in runs_of(batches):
            for data, edges in parts:
                starts = word_starts(data, edges, kinds)
                ends = np.append(starts[1:], len(data))
                short = ends - starts <= longest
                starts, ends = starts[short], ends[short]
                if not len(starts):
                    continue
                _, first, n = np.unique(roll.ranges(roll.prefix(data), starts, ends), return_index=True, return_counts=True)
                raw = data.tobytes()
                for a, b, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist()):
                    word = raw[a:b]
                    counts[word] = counts.get(word, 0) + k
                if len(counts) > COUNTED:
                    yield out()
                    counts = {}
        yield out()

    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[bytes]:
    """The words of the highest counts, at most `most`: a limit on the count is read off a few hundred sums."""
    level = F.floor(8 * F.log2("n"))
    left, limit = most, None
    for r in sorted(counts.where("n > 1").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["level"]):
        left -= r["words"]
        if left < 0:
            break
        limit = r["level"]
    if limit is None:
        return []
    return sorted(bytes(r["word"]) for r in counts.where("n > 1").where(level >= limit).select("word").collect())


def build_lexicon(documents: DataFrame, vocabulary: str, most: int = LEXICON, longest: int = LONGEST) -> str:
    """Counts the words of all `documents`, compiles the frequent ones and hands the file to the executors. Returns its
    name, which `encode` and `decode` take. At most `most` words of `longest` bytes pass through the driver."""
    spark = documents.sparkSession
    fixed = read_vocabulary(vocabulary)
    counts = materialize(word_counts(documents, publish(spark, "classes", {"classes": fixed["classes"]}), longest), "words")
    words = frequent(counts, most)
    discard(counts)
    ends = np.cumsum([0, *map(len, words)])
    ids, size = Merger(fixed["merges"], fixed["bytes"])(np.frombuffer(b"".join(words), np.uint8), ends[:-1], ends[1:])
    return publish(spark, "lexicon", fixed | compile_words(words) | {"ids": ids.astype(np.uint32), "id_ends": np.concatenate([[0], np.cumsum(size)])})


# ---- encoding and decoding


class Encoder:
    def __init__(self, lexicon: str):
        self.arrays = mapped(lexicon)
        self.merge = Merger(self.arrays["merges"], self.arrays["bytes"])
        ends, content = self.arrays["token_ends"], self.arrays["token_bytes"]
        self.added = sorted(((content[ends[i]:ends[i + 1]].tobytes(), int(i)) for i in self.arrays["added"]), key=lambda x: (-len(x[0]), x[0]))

    def _added_at(self, raw: bytes, edges: np.ndarray) -> list[tuple[int, int, int]]:
        """Added strings in the texts, leftmost first, of those at one place the longest: (start, end, id)."""
        found = []
        for text, i in self.added:
            at = raw.find(text)
            while at >= 0:
                if np.searchsorted(edges, at, side="right") == np.searchsorted(edges, at + len(text) - 1, side="right"):
                    found.append((at, at + len(text), i))
                at = raw.find(text, at + 1)
        out, free = [], 0
        for a, b, i in sorted(found, key=lambda x: (x[0], -x[1])):
            if a >= free:
                out.append((a, b, i))
                free = b
        return out

    def __call__(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between the edges, and how many each has."""
        raw = data.tobytes()
        added = self._added_at(raw, edges)
        cuts = np.unique(np.concatenate([edges, *([a, b] for a, b, _ in added)])) if added else edges
        starts = word_starts(data, cuts, self.arrays["classes"])
        if added:
            a, b, _ = np.array(added, np.int64).T
            last = np.maximum(np.searchsorted(a, starts, side="right") - 1, 0)
            starts = starts[(starts <= a[last]) | (starts >= b[last])]
        ends = np.append(starts[1:], len(data))
        place = rank(self.arrays, data, starts, ends)
        fixed = np.searchsorted(starts, np.array([a for a, _, _ in added], np.int64))
        place[fixed] = 0
        id_ends, flat = self.arrays["id_ends"], self.arrays["ids"]
        known, other = place >= 0, np.flatnonzero(place < 0)
        known[fixed] = False
        known = np.flatnonzero(known)
        merged, n = self.merge(data, starts[other], ends[other])
        size = np.ones(len(starts), np.int64)
        size[other], size[known] = n, id_ends[place[known] + 1] - id_ends[place[known]]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = np.empty(to[-1], np.uint32)
        ids[to[fixed]] = [i for _, _, i in added]
        ids[spread(to[known], size[known])] = flat[spread(id_ends[place[known]], size[known])]
        ids[spread(to[other], n)] = merged
        return ids, np.diff(to[np.searchsorted(starts, edges)])


def encode(documents: DataFrame, lexicon: str) -> DataFrame:
    """`documents` (with a text) as rows (doc, ids, n_tokens): the row as a struct without its text, the ids packed as
    little-endian unsigned 32-bit integers, and their number.

    A null or empty text has no ids. Equal rows stay apart, other columns keep their names inside the struct, an empty table
    gives an empty result. A string of an added token (such as the end-of-text mark) in a text becomes that token.
    """
    own = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    base = documents.select((F.struct(*own) if own else F.struct(F.lit(None).alias("none"))).alias("doc"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([base.schema["doc"], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lexicon)
        for batch, parts in runs_of(batches):
            if len(parts) == 1:
                ids, n = encoder(*parts[0])
            else:
                ids = np.concatenate([encoder(*part)[0] for part in parts])
                n = np.array([len(ids)])
            ends = np.concatenate([[0], np.cumsum(n)])
            raw = ids.astype("<u4").tobytes()
            packed = [raw[4 * a:4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(packed, pa.binary()), pa.array(n, pa.int64())], names=["doc", "ids", "n_tokens"])

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, lexicon: str) -> DataFrame:
    """Adds text: the tokens' bytes one after another as UTF-8, with the replacement character for what is none."""
    kept = [c for c in encoded.columns if c != "text"]
    base = encoded.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*base.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = mapped(lexicon)
        content, ends = arrays["token_bytes"], arrays["token_ends"]
        for batch in batches:
            texts = []
            for packed in batch.column("ids"):
                ids = np.frombuffer(packed.as_py() or b"", "<u4").astype(np.int64)
                texts.append(content[spread(ends[ids], ends[ids + 1] - ends[ids])].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return base.mapInArrow(run, schema)
