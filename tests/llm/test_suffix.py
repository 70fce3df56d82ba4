"""Prefix doubling against brute force: pairs over many ranges and small batches, repetitive and very long texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import suffix


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@pytest.mark.parametrize("kinds", [1, 3, 60, 400])
def test_pairs_are_numbered_alike_in_all_ranges(spark, small_batches, kinds):
    rng = random.Random(kinds)
    rows = [(k, i, 7, 0, False, rng.randrange(kinds), 0, rng.randrange(2)) for k in range(30) for i in range(10)]
    rows += [rows[0], rows[5], rows[5], rows[299]]                 # equal rows are occurrences of each other
    seen = Counter((r[5], r[7]) for r in rows)
    pairs = spark.createDataFrame(rows, suffix.POSITION + ", twice boolean, a long, gap long, b long").repartition(4)
    out, _ = suffix._rerank(pairs, 3, "test-ranks")
    got = {(r["key"], r["i"]): r["rank"] for r in out.collect()}
    assert out.count() == len(got)
    assert set(got) == {r[:2] for r in rows if seen[r[5], r[7]] > 1}
    names = defaultdict(set)
    for r in rows:
        if r[:2] in got:
            names[r[5], r[7]].add(got[r[:2]])
    assert all(len(n) == 1 for n in names.values()) and len({min(n) for n in names.values()}) == len(names)
    assert all(rank >> suffix.LEVEL_BITS == 3 for rank in got.values())


def expected(rows, length):
    seen, out = Counter(), []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(hash(b[p:p + length]) for p in range(len(b) - length + 1))
    for i, b in texts:
        edge = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[hash(b[p:p + length])] > 1:
                edge[p] += 1
                edge[p + length] -= 1
        gone = np.cumsum(edge)[:len(b)] > 0
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [suffix.WINDOW + suffix.BASE, 300, 400, 900])
def test_repetitive_and_long_texts(spark, length):
    rng = random.Random(length)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    shared, unit = letters(3000), letters(70)
    rows = [(0, "a" * 5000), (1, "ab" * 700 + letters(500)), (2, unit * 40), (3, letters(200) + unit * 9), (4, None), (5, ""), (6, "x" * length), (7, "x" * (length - 1))]
    for k in range(12):
        start, size = rng.randrange(2500), rng.randint(length - 5, length + 60)
        rows.append((8 + k, letters(rng.randrange(900)) + shared[start:start + size] + letters(rng.randrange(900))))
    long = letters(60000)
    rows += [(30, long), (31, letters(300) + long[20000:20000 + length] + letters(90)), (32, letters(50) + long[40000:40000 + length - 1])]
    rows += [rows[9], rows[9], (None, rows[10][1])]
    found = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length)
    assert sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in found.collect()), key=repr) == expected(rows, length)


def test_shortest_length(none):
    with pytest.raises(ValueError):
        suffix.remove_repeats(none, suffix.WINDOW + suffix.BASE - 1)


def test_constant_columns_are_not_shuffled(spark):
    rows = [(k % 7, k % 3, k % 5) for k in range(60)]
    pairs = spark.createDataFrame(rows, "key long, i int, a long").repartition(4)
    out, table = suffix._rerank(pairs, 0, "test-lean")
    assert {(r["key"], r["i"]) for r in out.collect()} == {r[:2] for r in rows}
    assert {r["rest"] for r in out.collect()} == {0}


def test_windows_are_ranges():
    roll = suffix.RollingHash()
    data = np.frombuffer(bytes(range(200)) * 3, np.uint8)
    for size in (0, 15, 16, 17, 600):
        prefix = roll.prefix(data[:size])
        starts = np.arange(max(0, size - 15))
        assert (roll.windows(prefix, 16) == roll.ranges(prefix, starts, starts + 16)).all()


def test_open_classes():
    import pyarrow as pa
    near = [[{"at": 100, "rest": 1, "rank": 5}, {"at": 700, "rest": 1, "rank": 6}], [{"at": 90, "rest": 900, "rank": 7}], [{"at": 100, "rest": 1, "rank": 8}]]
    sure = pa.array([[10, 100, 650], [], [21, 100]], pa.list_(pa.int32()))
    kind = pa.list_(pa.struct([("at", pa.int32()), ("rest", pa.int64()), ("rank", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(near, kind), sure], names=["near", "sure"])
    found = lambda b: [x for out in suffix._open_classes(iter([b]), 400) for x in out.column("rank").to_pylist()]
    assert found(batch) == [6, 7] and found(batch.slice(1)) == [7]


def test_texts_hashed_together_have_the_positions_of_each_alone(monkeypatch):
    import pyarrow as pa
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcd") for _ in range(n)).encode()
    texts = [letters(n) for n in (400, 3000, 0, 7, 399, 401, 94, 95, 5000, 254, 255, 800)] + [b"ab" * 900, b"a" * 700, "é".encode() * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 100 + len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["key", "raw"])
    found = []
    for piece in (1, 4000, 1 << 20):
        monkeypatch.setattr(suffix, "PIECE", piece)
        found.append([r for b in suffix._anchor_rows(iter([batch.slice(2), batch.slice(0, 2)]), 400) for r in zip(*b.to_pydict().values())])
    assert found[0] == found[1] == found[2]
    alone = {100 + k: suffix.Text(t, suffix.RollingHash()).ranked().tolist() for k, t in enumerate(texts)}
    want = [(key, i, at) for key, places in alone.items() for i, at in enumerate(places) if at + suffix.BASE <= len(texts[key - 100]) >= 400]
    assert len(want) > 100 and sorted(r[:3] for r in found[2]) == want
