"""Encoding against the tokenizers library, whose answer is the definition; decoding as a round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import bpe, queries
from tidewatch.llm.transducer import compile_words, rank

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["'s 're 'll 't''t 'stop x's's y'd've can't 'sx  ' s ''s", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|> c<|endof", "<|<|endoftext|>|>",
       "  \n\n\t x   y 　 z　", "é" * 300 + " ñ1２³½", "a" * 500, "\x00\x01\x7f हिन्दी ไทย 中文字 ①²Ⅷ\U000e0001\U00030000�", "", None, "   ", "'", "' 's", "x'", "ͅa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def texts():
    rng = random.Random(7)
    parts = ["'s", " ", "\n", "'", "re", "ll", "a", "1", "!", "é", " ", "<|endoftext|>", "\t", "the "]
    out = list(ODD) + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0x2ff), rng.randrange(0x300, 0xd7ff), rng.randrange(0xe000, 0x10ffff), 32])) for _ in range(40)) for _ in range(300)]
    return out + ["".join(rng.choice("abcdeqxz0189+/=") for _ in range(n)) for n in (63, 64, 65, 200, 3000)]


def check(rows, library):
    """rows: (text, packed ids, n_tokens, decoded)"""
    want = library.encode_batch([t or "" for t, *_ in rows], add_special_tokens=False)
    for (text, packed, n, decoded), e in zip(rows, want):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == e.ids and n == len(ids), text
        assert decoded == library.decode(e.ids, skip_special_tokens=False) == (text or "")


@pytest.mark.parametrize("most", [0, 50, 1 << 17])
def test_equals_the_library(spark, library, most):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts() * 2)], "doc_id long, text string").repartition(3)
    lexicon = bpe.build_lexicon(frame, VOCABULARY, most=most)
    out = bpe.decode(bpe.encode(frame, lexicon), lexicon).select("doc.doc_id", "ids", "n_tokens", "text").collect()
    assert len(out) == frame.count()
    known = texts() * 2
    check([(known[r["doc_id"]], bytes(r["ids"]), r["n_tokens"], r["text"]) for r in out], library)


def test_long_texts_are_cut_where_nothing_changes(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 700)
    rng = random.Random(2)
    long = ["".join(rng.choice(["word ", "don't ", "\n\n", "x  y ", "é ", "   ", "<|endoftext|> ", "1 ", "!? "]) for _ in range(3000)), "b" * 9000, " " * 5000]
    for text in long:
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = bpe.safe_cuts(data, np.array([0, len(data)]))
        parts = [text.encode()[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])]
        assert "".join(parts) == text
        assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids
    assert len(bpe.safe_cuts(np.frombuffer(long[0].encode(), np.uint8), np.array([0, len(long[0].encode())]))) > 10


def test_rows_and_names_are_kept(spark, docs, none):
    clash = docs.withColumnsRenamed({"key": "ids", "name": "n_tokens"})
    lexicon = bpe.build_lexicon(clash, VOCABULARY)
    out = bpe.decode(bpe.encode(clash, lexicon), lexicon)
    got = out.select("doc.*", "text").collect()
    want = clash.select(*[c for c in clash.columns if c != "text"], "text").collect()
    assert sorted(map(repr, got)) == sorted(repr(r).replace("text=None", "text=''") for r in want)
    empty = bpe.build_lexicon(none, VOCABULARY)
    assert bpe.decode(bpe.encode(none, empty), empty).count() == 0


def test_query_equals_the_library(spark, library):
    import hashlib
    folder = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows.items()}
    got = queries.op11_bpe_round_trip(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("words", [[], [b""], [b"a"], "few", "bytes"])
def test_transducer_ranks_words(words):
    rng = random.Random(1)
    if words == "few":
        words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 6))) for _ in range(300)})
    elif words == "bytes":
        words = sorted({bytes(rng.randrange(256) for _ in range(rng.randint(1, 3))) for _ in range(3000)})
    asked = list(words) + [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    ends = np.cumsum([0, *map(len, asked)])
    place = {w: i for i, w in enumerate(words)}
    got = rank(compile_words(words), np.frombuffer(b"".join(asked) + b"x", np.uint8), ends[:-1], ends[1:])
    assert got.tolist() == [place.get(w, -1) for w in asked]


def test_suffixes_are_shared():
    from tidewatch.llm.transducer import minimal_states
    words = sorted(a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"s", b"ed", b"ing"))
    assert len(minimal_states(words)[0]) < sum(map(len, words)) / 3
