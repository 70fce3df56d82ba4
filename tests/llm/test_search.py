"""Ranked search against scoring every document, and the bounds against the scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in queries:
        asked, scores = terms(text), []
        for i, c, n in counts:
            m = 100 - 25 + 25 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in asked if w in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, place, i, s) for place, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    pick = lambda: words[min(int(rng.paretovariate(0.6)) - 1, 299)]
    docs = [(i, " ".join(pick() for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)] + [(n + 50, "same " * 500), (n + 51, "Same SAME é-É ß"), (n + 52, None), (n + 53, ""), (n + 54, "-- !!"), (None, "w5 w9 same"), docs[7], docs[7]]
    queries = [(i, " ".join(pick() for _ in range(rng.choice([1, 3, 30])))) for i in range(30)]
    queries += [(100, docs[3][1]), (101, "same"), (102, "É é"), (103, None), (104, ""), (105, "absent"), (106, "w1 w1 w1"), (None, "w2 same"), (101, "same")]
    return docs, queries


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits,first", [(12, 64), (1, 20), (12, 1)])
def test_equals_brute_force_whatever_the_filter(spark, monkeypatch, bits, first):
    """A filter of one bit a key lets nearly everything pass and must not change the result."""
    monkeypatch.setattr(search, "BITS", bits)
    docs, queries = corpus(bits, 400)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in queries], "item_id long, text string, score string, rank int")
    index = search.build_index(frame)
    assert rows(search.search(index, frame, asked, first=first)) == brute(docs, queries)


def test_lots_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "LOT", 7)
    monkeypatch.setattr(search, "BLOCK_DOCS", 8)
    docs, queries = corpus(5, 150)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    assert rows(search.search(search.build_index(frame), frame, asked, k=3)) == brute(docs, queries, 3)


def test_bounds_are_never_below_the_scores(spark):
    docs, queries = corpus(9, 300)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    index = search.build_index(frame)
    names = {r["name"]: r["doc_id"] for r in frame.select("doc_id", search.row_name().alias("name")).collect()}
    lot = next(search.lots_of(index, asked))
    exact = {}
    for item, _, doc, score in brute(docs, [(q, " ".join(lot.words[t].decode() for t in own)) for q, own in enumerate(lot.terms)], 10_000):
        exact[item, doc] = score
    seen = 0
    for batch in index.where("term is null").toArrow().to_batches():
        for who, bound in search.bounds(lot, batch):
            for q, d in np.ndindex(bound.shape):
                seen += 1
                assert bound[q, d] >= exact.get((q, names[int(who[d])]), 0)
    assert seen == len(lot.ids) * sum(1 for _, t in docs if terms(t))


def test_the_fixture_and_empty_tables(spark, docs, none):
    asked = docs.select("doc_id", "text", "key").withColumnRenamed("doc_id", "item_id").where("item_id < 15")
    known = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = brute(known, [(r["item_id"], r["text"]) for r in asked.collect()])
    assert rows(search.search(search.build_index(docs), docs, asked)) == wanted
    nothing = asked.where("false")
    assert search.search(search.build_index(none), none, asked).count() == 0
    assert search.search(search.build_index(docs), docs, nothing).count() == 0


def test_few_documents_pass_the_bounds(spark):
    """On the given texts the bounds exclude most documents."""
    folder = "/root/testdata/sf0.01"
    docs, asked = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet")
    index = search.build_index(docs)
    lot = next(search.lots_of(index, asked))
    limits = np.zeros(len(lot.ids))
    for r in search.ranked(search.scored(docs, search.best_bounds(index, lot, 64), lot), 20).where("rank = 20").collect():
        limits[r["query"]] = r["score"]
    assert search.not_excluded(index, lot, limits).count() < 0.15 * len(lot.ids) * docs.count()
