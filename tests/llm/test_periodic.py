"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All (start, length, smallest period), by comparing every word with those q before it."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                whole = words[i:j + q]
                if not any(whole[p:] == whole[:-p] for p in range(1, q)):
                    out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def special():
    rng = random.Random(4)
    prose = lambda n, k=40: [f"w{rng.randrange(k)}" for _ in range(n)]
    texts = [prose(10) + prose(p) * k + prose(rng.randrange(p)) for p in (1, 2, 3, 5, 7, 8, 9, 16, 31, 33, 64, 100) for k in (3, 4, 5, 9)]
    for _ in range(120):
        p = rng.randint(1, 20)
        unit = prose(p, rng.choice([2, 3, 30]))
        texts.append(prose(rng.randint(0, 30), 3) + (unit * 12)[:rng.randint(3 * p, 10 * p)] + prose(rng.randint(0, 30), 3))
    texts += [prose(300, k) for k in (1, 2, 3)]
    for p in (1, 2, 3, 4, 6):     # runs in runs: a unit that itself holds runs, and a run broken by one word
        inner = prose(p, 2) * 6 + ["x"]
        texts += [inner * 5, (["a"] * 40 + ["b"]) * p + ["a"] * 90, ["a", "b"] * 30 + ["b", "a"] * 30]
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    thue = [0]
    while len(thue) < 256:
        thue = thue + [1 - t for t in thue]
    return [*texts, fib[1], [f"t{t}" for t in thue] * 5, [], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4]


def test_equals_brute_force(spark):
    texts = special()
    frame = spark.createDataFrame([(i, " ".join(t), "r", "c") for i, t in enumerate(texts)], "doc_id long, text string, runs string, collapsed string").repartition(3)
    out = {r["doc"]["doc_id"]: r for r in periodic.periodic_runs(frame).collect()}
    assert len(out) == len(texts)
    for i, words in enumerate(texts):
        want = brute(words)
        assert [tuple(r) for r in out[i]["runs"]] == want, words
        assert out[i]["collapsed"] == collapse(words, want)
        assert (out[i]["doc"]["runs"], out[i]["doc"]["collapsed"], out[i]["n_words"]) == ("r", "c", len(words))


def test_rows_of_all_kinds(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = [(r["doc"]["doc_id"], r["doc"]["text"], r["collapsed"], [tuple(x) for x in r["runs"]]) for r in periodic.periodic_runs(docs).collect()]
    want = [(i, t, collapse(w := WORD.findall(t or ""), found := brute(w)), found) for i, t in rows]
    assert sorted(map(repr, out)) == sorted(map(repr, want))
    assert periodic.periodic_runs(none).count() == 0 and periodic.run_digest(periodic.periodic_runs(none)).count() == 0


def test_long_texts_stay_cheap(spark):
    unit = [f"u{i}" for i in range(977)]
    texts = ["a " * 200_000, "a b " * 100_000, " ".join(["a"] * 60_000 + ["b"] + ["a"] * 60_000), " ".join(unit * 150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc"]["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.periodic_runs(frame).collect()}
    assert out == {0: [(0, 200_000, 1)], 1: [(0, 200_000, 2)], 2: [(0, 60_000, 1), (60_001, 60_000, 1)], 3: [(0, 977 * 150, 977)]}


@pytest.mark.parametrize("scale", [1, 2, 8, 64])
def test_transform_counts_differences_exactly(scale):
    rng = np.random.default_rng(scale)
    codes = rng.integers(0, 3, 6 * scale).astype(np.int64)
    squares = np.concatenate([[0], np.cumsum(codes * codes)])
    blocks = np.arange(0, 3 * scale + 1, scale)
    b, d = periodic.recurrences(codes, squares, blocks, scale)
    want = [(i, k) for i in blocks.tolist() for k in range(scale, 2 * scale) if (codes[i:i + scale] == codes[i + k:i + k + scale]).all()]
    assert sorted(zip(b.tolist(), d.tolist())) == want
    rows = rng.integers(0, periodic.PRIME, (3, 2 * scale)).astype(np.uint64)
    assert (periodic.restore(periodic.transform(rows)) == rows).all()


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    out = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where(F.length("text") < 6000).collect()
    planted = 0
    for doc_id, text in rows:
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found, got = brute(words), out[doc_id]
        planted += bool(found)
        assert got["n_runs"] == len(found)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        assert (got["start"], got["length"], got["period"]) == (best or (None,) * 3)
        assert got["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(collapse(words, found).encode()).hexdigest()
    assert planted > 5
