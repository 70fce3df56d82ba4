"""Secret scan: fixed patterns plus probabilistic automata inferred from the credentials that these label.

One pass over the whole texts finds the pattern matches and all other key-like runs. Matches are labelled credentials:
a bounded, hash-chosen sample of them is put into a prefix tree for each kind, and states whose observed futures do
not differ significantly (Hoeffding bound) are merged, as are states for ordinary text. Every key-like run is then
scored by its likelihood under each credential automaton against the one of ordinary text.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import materialize

KINDS = ("assign", "access", "hex")
LEARNED = "grammar"

# The patterns of the base scan and their least lengths.
ASSIGN = re.compile(r"""(?:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
PLAIN = re.compile(r"[A-Za-z]{4,}")
ONE_CLASS = re.compile(r"[0-9]+|[A-Za-z]?[a-z]+|[A-Z]+|[_=/+-]+")

FOUND = "doc_id long, kinds array<string>, starts array<int>, ends array<int>, values array<string>"


def base_matches(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret value) of the fixed patterns, by start, then kind as listed."""
    found = []
    lowered = text.encode().lower()
    if any(word in lowered for word in KEYWORDS):
        found += [(m.start(), m.end(), 0, m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_MIN]
    if b"akia" in lowered:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k], v) for s, e, k, v in sorted(found)]


def _inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            text = text or ""
            base = base_matches(text)
            found = [(k, s, e, v) for s, e, k, v in base]
            for m in RUN.finditer(text):
                if any(s < m.end() and m.start() < e for s, e, _, _ in base):
                    continue
                around = text[m.start() - 1:m.start()] + text[m.end():m.end() + 1]
                plain = ONE_CLASS.fullmatch(m[0]) or "@" in around
                found.append(("plain" if plain else "candidate", m.start(), m.end(), m[0]))
            if text:   # one ordinary word of each text for the automaton of ordinary text
                word = PLAIN.search(text, zlib.crc32(text.encode()) % len(text))
                if word and not any(s < word.end() and word.start() < e for s, e, _, _ in base):
                    found.append(("plain", -1, -1, word[0]))
            rows.append((doc_id, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [f[3] for f in found]))
        yield pd.DataFrame(rows, columns=["doc_id", "kinds", "starts", "ends", "values"]).astype({"doc_id": "Int64"})


def symbol(char: str) -> str:
    """Class of a character: digit, hexadecimal letter, other lower case, upper case, or itself."""
    if "0" <= char <= "9":
        return "9"
    if "a" <= char <= "f":
        return "f"
    if "g" <= char <= "z":
        return "z"
    if "A" <= char <= "Z":
        return "Z"
    return char


class Automaton:
    """Probabilistic automaton grown from a prefix tree by merging compatible states (red and blue states)."""

    END = ""

    def __init__(self, words: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [defaultdict(int)]
        for word in words:
            state = 0
            for c in map(symbol, word):
                self.seen[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.seen.append(defaultdict(int))
                state = self.next[state][c]
            self.seen[state][self.END] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self.total = [sum(s.values()) for s in self.seen]
        self.symbols = len({c for s in self.seen for c in s}) + 1

    def _differ(self, a: int, b: int, c: str) -> bool:
        na, nb = sum(self.seen[a].values()), sum(self.seen[b].values())
        if not na or not nb:
            return False
        gap = abs(self.seen[a].get(c, 0) / na - self.seen[b].get(c, 0) / nb)
        return gap > self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if any(self._differ(a, b, c) for c in {*self.seen[a], *self.seen[b]}):
                return False
            stack += [(self.next[a][c], self.next[b][c]) for c in self.next[b] if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """b is the root of a tree: its counts join those of a, and so on below."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            for c, n in self.seen[b].items():
                self.seen[a][c] += n
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_all(self) -> None:
        red, at = [0], 0
        while True:
            blue = next(((r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in red), None)
            if blue is None:
                break
            parent, c = blue
            state = self.next[parent][c]
            goal = next((r for r in red if self._compatible(r, state)), None)
            if goal is None:
                red.append(state)
            else:
                self.next[parent][c] = goal
                self._fold(goal, state)
            at += 1
        self.states = len(red)

    def likelihood(self, word: str) -> float:
        """Mean log probability of a character; symbols unseen in a state get a small share and restart at the root."""
        state, total = 0, 0.0
        for c in [*map(symbol, word), self.END]:
            total += math.log((self.seen[state].get(c, 0) + 0.05) / (self.total[state] + 0.05 * self.symbols))
            state = self.next[state].get(c, 0)
        return total / (len(word) + 1)


def fit(found: DataFrame, sample: int = 1000, max_length: int = 128) -> dict[str, Automaton]:
    """Automata from at most `sample` distinct labelled strings of each kind (the ones with the smallest hashes) of up
    to `max_length` characters. The bound is on training only; all candidates are scored."""
    labelled = (found.select(F.explode(F.arrays_zip("kinds", "values")).alias("x"))
                .select(F.col("x.kinds").alias("kind"), F.col("x.values").alias("value"))
                .where(F.length("value") <= max_length).groupBy("kind", "value").agg(F.first(F.lit(1)).alias("one")))
    automata = {}
    for kind in (*KINDS, "plain"):
        chosen = labelled.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample)
        words = [r[0] for r in chosen.select("value").collect()]
        if words:
            automata[kind] = Automaton(words)
    return automata


def find_secrets(documents: DataFrame, sample: int = 1000, margin: float = 0.5) -> DataFrame:
    """Columns doc_id, spans array<struct<kind, start, end, score>>: one row for every row of `documents` (doc_id, text).

    A null or empty text has no spans. Spans of the fixed patterns carry a null score; a span of kind `grammar` is a run
    that is likelier under a credential automaton than as ordinary text by `margin` for each character. Rows with equal
    or null ids are kept apart, extra columns are ignored, an empty table gives an empty result. Without labelled
    credentials of any kind nothing is learned and only the patterns count.
    """
    found = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                        .mapInPandas(_inspect, FOUND), "secrets")
    automata = fit(found, sample)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = automata.get("plain")
        known = [automata[k] for k in KINDS if k in automata]
        for batch in batches:
            rows = []
            for doc_id, kinds, starts, ends, values in batch.itertuples(index=False):
                spans = []
                for kind, start, end, value in zip(kinds, starts, ends, values):
                    if kind in KINDS:
                        spans.append((int(start), int(end), kind, None))
                    elif kind == "candidate" and known and plain:
                        gain = max(a.likelihood(value) for a in known) - plain.likelihood(value)
                        if gain >= margin:
                            spans.append((int(start), int(end), LEARNED, gain))
                spans.sort(key=lambda s: (s[0], (*KINDS, LEARNED).index(s[2])))
                rows.append((doc_id, [{"kind": k, "start": s, "end": e, "score": g} for s, e, k, g in spans]))
            yield pd.DataFrame(rows, columns=["doc_id", "spans"]).astype({"doc_id": "Int64"})

    return found.mapInPandas(score, "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>")


def secret_digest(spans: DataFrame) -> DataFrame:
    """Counts, digest of the pattern spans and all spans as text, for each row."""
    def joined(part):
        return F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != LEARNED)
    return spans.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count(LEARNED))
