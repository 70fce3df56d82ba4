"""Quality rules by repetition: characters inside repeated n-grams and lines, by rolling hashes in numpy.

Each task views a run of texts as one byte array. Words, lines and word windows are hashed from prefix sums, so a text
of any length costs linear time, and a text is never joined with or compared to another one: no shuffle.
A window of n words can only repeat if the shorter windows inside it repeat, so longer ones are hashed only there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import SPACE, RollingHash, by_place, mix64, pieces, row_sums, utf8, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS = 50
#: Words of a window: the largest share of a text's word characters that may lie in repeated windows of that length.
NGRAM_LIMITS = {3: 0.45, 5: 0.35, 7: 0.30, 10: 0.25}
LINE_LIMIT = 0.30
#: Symbols for each word.
SYMBOL_LIMIT = 0.25
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
            *(f"dup_chars_{n}" for n in NGRAM_LIMITS))


def _repeated(keys: np.ndarray, first: bool) -> np.ndarray:
    """Which keys occur more than once; without `first`, the first of each is left out."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


def measure(data: np.ndarray, offsets: np.ndarray, roll: RollingHash) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    starts, ends, first = words_of(data, offsets)
    n_words = np.diff(first)
    row = np.repeat(np.arange(rows), n_words)
    prefix = roll.prefix(data)
    head = (data & 0xC0) != 0x80
    solid = ~SPACE[data] & head
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=points[1:])
    out = {"n_words": n_words, "word_chars": points[offsets[1:]] - points[offsets[:-1]],
           "n_symbols": row_sums(SYMBOLS[data], offsets)}
    weight = points[ends] - points[starts]
    salt = mix64(np.arange(rows, dtype=np.uint64) + np.uint64(1))

    # lines
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1], breaks + 1) if rows else offsets[:-1]
    line_starts = line_starts[line_starts < len(data)]
    bounds = np.append(line_starts[1:], len(data))
    line_row = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = np.where((bounds > line_starts) & (data[bounds - 1] == 10), bounds - 1, bounds) if len(bounds) else bounds
    chars = points[line_ends] - points[line_starts]
    keep = chars > 0
    line_starts, line_ends, line_row, chars = line_starts[keep], line_ends[keep], line_row[keep], chars[keep]
    dup = _repeated(roll.ranges(prefix, line_starts, line_ends) ^ salt[line_row], first=False)
    out["n_dup_lines"] = np.bincount(line_row[dup], minlength=rows)
    out["dup_line_chars"] = np.bincount(line_row[dup], chars[dup], minlength=rows).astype(np.int64)

    # windows of words, the longer ones only where the shorter ones repeat
    hashes = roll.ranges(prefix, starts, ends)
    left = first[1:][row] - np.arange(len(row))          # words from here to the end of the text
    last, last_n = np.ones(len(row), bool), 1
    for n in NGRAM_LIMITS:
        fits = left >= n
        for shift in range(n - last_n + 1):
            fits[:len(row) - shift] &= last[shift:]
        at = np.flatnonzero(fits)
        key = salt[row[at]]
        for k in range(n):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
        window = np.zeros(len(row), bool)
        window[at] = _repeated(key, first=True)
        edge = np.zeros(len(row) + n + 1, np.int32)
        hit = np.flatnonzero(window)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + n, -1)
        covered = np.cumsum(edge)[:len(row)] > 0
        out[f"dup_chars_{n}"] = np.bincount(row[covered], weight[covered], minlength=rows).astype(np.int64)
        if n == 3:
            out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
        last, last_n = window, n
    return out


def repetition(documents: DataFrame) -> DataFrame:
    """The columns of `documents` (with a text) and, for each row, the measures of its whole text.

    A null or empty text has 0 everywhere. Rows stay apart even if they are equal; columns of `documents` with the name
    of a measure are replaced; an empty table gives an empty result. Lengths count code points; a line or window counts
    as repeated only within its own text.
    """
    kept = [c for c in documents.columns if c not in MEASURES]
    return _measured(documents.select(*[F.col(f"`{c}`") for c in kept]), "text")


def _measured(base: DataFrame, text: str) -> DataFrame:
    schema = T.StructType([*base.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        for whole in batches:
            for batch in pieces(whole, text):
                found = measure(*utf8(batch.column(text)), roll)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[m], pa.int64()) for m in MEASURES)],
                                                 names=[*batch.schema.names, *MEASURES])

    return base.mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def passes():
    """Verdict of the rules for a row of `repetition`: long enough, few symbols, and few characters in repeated windows
    and lines."""
    verdict = (~base_failed() & (F.col("n_symbols") <= SYMBOL_LIMIT * F.col("n_words"))
               & (F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")))
    for n, limit in NGRAM_LIMITS.items():
        verdict = verdict & (F.col(f"dup_chars_{n}") <= limit * F.col("word_chars"))
    return verdict


def quality_filter(documents: DataFrame) -> DataFrame:
    """The documents that pass, with all their own columns, those with the name of a measure too."""
    placed, [text] = by_place(documents, "text")
    return _measured(placed, text).where(passes()).select(*placed.columns).toDF(*documents.columns)
