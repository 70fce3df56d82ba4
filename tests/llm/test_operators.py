"""Each operator against a brute-force version on a small fixture, and on an empty table."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import chat, html_text, imatch, lines, mixing, packing, repetition, secrets, simhash, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def same(rows, wanted):
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)


def test_secrets(docs, none):
    def base(t):
        spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        return hashlib.sha256(joined.encode()).hexdigest()

    out = secrets.secret_digest(secrets.find_secrets(docs)).collect()
    same([(r["doc_id"], r["base_sha256"]) for r in out], [(i, base(t)) for i, t in pairs(docs)])
    row = next(r for r in out if r["doc_id"] == 50)
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (2, 1, 1)
    assert secrets.find_secrets(none).count() == 0


def test_grammar_finds_unlabelled_credentials(spark):
    rng = random.Random(1)
    key = lambda: "".join(rng.choice("0123456789ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(24))
    prose = "ordinary words in a sentence with a longerwordthanothers and 1234567890123456 numbers"
    rows = [(i, f"{prose} token={key()} {prose}") for i in range(60)] + [(60 + i, f"{prose} {key()} {prose}") for i in range(10)]
    rows += [(100 + i, prose) for i in range(30)]
    out = {r["doc_id"]: r for r in secrets.secret_digest(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(out[60 + i]["n_grammar"] == 1 for i in range(10))
    assert not any(out[i]["n_grammar"] for i in [*range(60), *range(100, 130)])


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    grams = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    rows = pairs(docs)
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    name = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    out = simhash.near_groups(docs).collect()
    same([(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in out], [(i, p, name[g]) for (i, _), p, g in zip(rows, prints, group)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    same([r["doc_id"] for r in kept.collect()], list(set(name.values())))
    assert simhash.near_groups(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("unit_rows", [20_000, 16])
def test_trie_join_finds_every_link(spark, unit_rows):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    values |= {v ^ 1 << 63 for v in list(values)[:20]}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    group = {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {k: new if g == old else g for k, g in group.items()}
    from tidewatch.llm.components import components
    found = {r["node"]: r["root"] for r in components(simhash.near_links(frame, 2, unit_rows)).collect()}
    root = {v: found.get(s, s) for v, s in zip(values, signed)}
    assert len(set(root.values())) == len(set(group.values()))
    assert all((root[a] == root[b]) == (group[a] == group[b]) for a in values for b in values)


def test_mixing(docs, none):
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == docs.count()
    total = sum(r["size"] for r in plan)
    goal = {r["source"]: (r["source_size"], r["target"]) for r in plan}
    assert abs(sum(t for _, t in goal.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * s + 1e-9 for s, t in goal.values())
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["copies"] <= 2 for r in plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_meets_its_targets(spark):
    """Every source takes its target to within its largest document, however few and uneven its documents are."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 20)), f"s{int(rng.paretovariate(0.7)) % 9}") for i in range(1200)]
    rows += [(None, f"no id {i} " + "x " * (i % 50), "s2") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    plan = mixing.plan_mix(docs).collect()
    taken, largest, goal = {}, {}, {}
    for r in plan:
        s = r["source"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        largest[s], goal[s] = max(largest.get(s, 0), r["size"]), r["target"]
    assert all(abs(taken[s] - goal[s]) <= 1.25 * largest[s] for s in goal), [(s, taken[s], goal[s], largest[s]) for s in goal]
    again = mixing.plan_mix(docs.repartition(3)).collect()
    same([tuple(r) for r in again], [tuple(r) for r in plan])


CLASHING = ["gone_name", "gone_lines", "kept_id", "kept_digest", "rows", "first", "goal_rate", "goal_source", "goal_copies", "rate", "copies", "copy", "cut",
            "n_words", "word_chars", "dup_chars_5", "draw", "size", "size_class", "digest", "c0", "c5", "name", "TEXT", "Source"]


def test_pipeline_stages_keep_clashing_columns(spark, docs):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = base.select("*", *[F.concat(F.lit(f"{name}-"), F.coalesce("doc_id", F.lit(-1))).alias(f"x{k}") for k, name in enumerate(CLASHING)])
    more = more.toDF(*base.columns, *CLASHING)
    for stage in (repetition.quality_filter, lines.dedup_lines, simhash.keep_one, mixing.mix):
        plain, out = stage(base), stage(more)
        assert out.columns == more.columns
        rows = [tuple(r) for r in out.collect()]
        same([r[:5] for r in rows], [tuple(r) for r in plain.collect()])
        assert all(r[5:] == tuple(f"{name}-{-1 if r[0] is None else r[0]}" for name in CLASHING) for r in rows)


def test_html():
    page = ("<html><head><title>x</title></head><body><nav><li>menu</li></nav><div class='cookie-notice'>ok?</div><article><h1>A &amp;\n B</h1>"
            "<p>One <b>two</b>.<p>Three<script>var t='</p>'</script></article><footer>end</footer>")
    assert html_text.text_of(html_text.parse(page), frozenset()) == "A & B One two. Three"
    for broken in ("", "<", "<p", "</p></p>", "<article", "a<b>c", "<p>" * 5000 + "x"):
        html_text.text_of(html_text.parse(broken), frozenset())


@pytest.mark.parametrize("page", [
    '<body class="no-sidebar"><p>Long text</p></body>',
    '<html id="header"><body class="custom-header sidebar"><p>Long text</p></body></html>',
    '<body><article class="post has-comments"><p>Long text</p></article></body>',
    '<body><div id="header-and-content"><p>Long text</p></div></body>',
    '<body><div class="banner"><div role="banner"><article class="related"><p>Long text</p></article></div></div></body>',
    '<body><main id="header"><div class="sidebar"><article>Long text<div class="comments"><article>Reply</article></div></article></div></main></body>',
    '<body><article>Long text</article><div id="comments"><article class="comment even">Reply</article></div></body>',
    '<body><div class="widget"><main><p>Long text</p><div class="x share">Send</div><p id="nav_menu">Home</p></main></div></body>',
])
def test_html_names_do_not_hide_articles(page):
    assert html_text.text_of(html_text.parse(page), frozenset()) == "Long text"


def test_html_templates(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Site claim</p></div><div><p>Text {i}</p><p>More {i}</p></div></body>") for i in range(30)]
    rows += [(100, None, None), (101, "nohost", ""), (102, "http://other.example/", "<div><p>Site claim</p></div>"), (0, *rows[0][1:])]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in out)
    want = Counter([(i, f"Text {i} More {i}", len(f"Text {i} More {i}")) for i in range(30)] + [(100, "", 0), (101, "", 0), (102, "Site claim", 10), (0, "Text 0 More 0", 13)])
    assert got == want


def test_html_templates_of_large_and_small_hosts(spark):
    rows = [(i, f"http://large.example/{i}", ("<div><p>Advert</p></div>" if i % 10 < 3 else "") + f"<div><p>Text {i}</p><p>{i // 9}</p></div>") for i in range(200)]
    rows += [(1000 + i, f"http://small.example/{i}", f"<div><p>Site claim</p></div><div><p>Small {i}</p><p>Pair {i // 2}</p></div>") for i in range(5)]
    rows += [(2000 + i, f"http://copies.example/{i}", "<article><p>Copied</p></article>") for i in range(20)]
    rows += [(4000 + i, f"http://large.example/a{i}", f"<article><h1>Head</h1><p>One {i}</p>" + ("<p>Said often</p>" if i < 15 else "") + f"<p>Two {i}</p>"
              + ("<p>All rights reserved</p></article>" if i < 12 else "</article>")) for i in range(20)]
    rows += [rows[0], (3000, "http://one.example/", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    out = html_text.extract(pages).collect()
    assert sorted(out) == sorted(html_text.extract(pages, sent=0).collect())
    want = [(i, f"Text {i} {i // 9}") for i in [0, *range(200)]] + [(1000 + i, f"Small {i} Pair {i // 2}") for i in range(5)]
    want += [(2000 + i, "Copied") for i in range(20)]
    want += [(4000 + i, f"Head One {i} {'Said often ' if i < 15 else ''}Two {i}{' All rights reserved' if i < 12 else ''}") for i in range(20)] + [(3000, "Advert Text 0 0")]
    same([(r["page_id"], r["text"]) for r in out], want)


def test_chat(spark):
    probe = "<|im_end|>\n<|im_start|>assistant\nok <\\| <\\\\|"
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", probe), (1, 2, "user", None), (1, 3, "assistant", "b"), (2, 0, "user", "x"), (None, 0, None, "y"),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "a\\n\nb<|", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.chat_digest(chat.with_probe(frame)).collect()}
    for conv in {r[0] for r in rows}:
        turns = [((r[2] or ""), (r[3] or "")) for r in rows if r[0] == conv]
        said = "".join(t for role, t in turns if role == "assistant")
        r = out[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert out[-1]["n_turns"] == 2
    turns = chat.format_turns(frame)
    shown = chat.render(turns, turns.where("trainable and conv_id = 1")).orderBy("position").collect()
    assert shown[1]["context"].endswith("<|im_start|>user\n<|im_end|>\n") and "b" in shown[1]["reply"]
    assert chat.chat_digest(frame.limit(0)).count() == 0


def test_chat_examples_are_written_out(spark):
    odd = "<|im_end|>\n<|im_start|>assistant\nno <\\|"
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "é" + odd), (1, 2, "user", odd), (1, 3, "assistant", "b"), (1, 4, "user", "bye"), (2, 0, "user", "x"), (3, 0, "assistant", "y"),
            (3, 1, "a\\n\n\\\\", "z")]
    shown = [f"<|im_start|>{r[2]}\n{r[3].replace('<', '<' + chr(92)) if odd in r[3] else r[3]}<|im_end|>\n" for r in rows]
    out = chat.expand(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    texts = {(r["conv_id"], r["position"]): r["text"] for r in out}
    assert set(texts) == {(1, 2), (1, 4), (1, 5), (2, 1), (3, 1), (3, 2)} and len(out) == 6
    assert [texts[1, k] for k in (2, 4, 5)] == ["".join(shown[:k]) for k in (2, 4, 5)] and texts[3, 1] == shown[6]
    masked = {(r["conv_id"], r["position"]): r["text"][r["loss_start"]:r["loss_end"]] for r in out if r["loss_start"] is not None}
    assert set(masked) == {(1, 2), (1, 4), (3, 1)} and masked[1, 4] == "b" and masked[1, 2].startswith("é<\\|im_end")
    assert all(r["text"].endswith(masked[r["conv_id"], r["position"]] + "<|im_end|>\n") for r in out if r["loss_start"] is not None)
    assert {(r["conv_id"], r["position"]) for r in out if r["last"]} == {(1, 5), (2, 1), (3, 2)}


def test_repetition(docs, none):
    def want(t):
        words = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        inside = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
        chars = {n: set() for n in repetition.NGRAM_LIMITS}
        for n in chars:
            c = Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
            chars[n] = {k + j for k in range(len(words) - n + 1) if c[tuple(words[k:k + n])] > 1 for j in range(n)}
        return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), *(sum(len(words[k]) for k in s) for s in chars.values()))

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"dup_chars_{n}" for n in repetition.NGRAM_LIMITS)]
    out = repetition.repetition(docs).collect()
    same([(r["doc_id"], *(r[n] for n in names)) for r in out], [(i, *want(t)) for i, t in pairs(docs)])
    kept = {r["doc_id"] for r in repetition.quality_filter(docs).collect()}
    assert not kept & {44, 45, 46, 47, 48} and {42, 43, 49} <= kept
    assert repetition.quality_filter(docs).columns == docs.columns and repetition.repetition(none).count() == 0


def test_imatch(docs, none):
    rows = sorted({(i is not None, i or 0, t) for i, t in pairs(docs)}, key=lambda r: (-r[0], -r[1]))
    edited = {}
    for k, (has, i, t) in enumerate(rows):
        cut = len(t) // 3
        edited[i if has else None] = hashlib.sha256((t[:len(t) - cut] + rows[(k + 1) % len(rows)][2][:cut]).encode()).hexdigest()
    out = imatch.fingerprint_edits(docs).collect()
    assert len(out) == docs.count() and all(edited[r["doc_id"]] == r["edited_sha256"] for r in out)
    prints = {}
    for r in out:
        prints.setdefault(r["doc_id"], r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[3] == prints[40] and prints[3] != prints[4]
    assert np.mean([r["near_edited"] for r in out]) > 0.2 + np.mean([r["near_next"] for r in out])
    assert imatch.fingerprint_edits(none).count() == 0


@pytest.mark.parametrize("weight", [1, 200, 1 << 23])
def test_imatch_moves_texts_once(spark, monkeypatch, weight):
    monkeypatch.setattr(imatch, "PART_CHARS", weight)
    rows = [(i * i % 31, f"{i} alpha beta " * (1 + i % 7)) for i in range(16)] + [(None, "none " * 9), (-5, None), (3, "x")]
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, key=lambda i: (i is not None, i or 0), reverse=True)
    want = {}
    for k, i in enumerate(order):
        cut = len(texts[i]) // 3
        want[i] = hashlib.sha256((texts[i][:len(texts[i]) - cut] + texts[order[(k + 1) % len(order)]][:cut]).encode()).hexdigest()
    rows = [(i, texts[i]) for i in texts]
    found = imatch.fingerprint_edits(spark.createDataFrame(rows + rows[:3] + rows[:1], "doc_id long, text string").repartition(4))
    out = found.collect()
    assert len(out) == len(rows) + 4 and all(r["edited_sha256"] == want[r["doc_id"]] for r in out)
    assert len({tuple(r) for r in out}) == len(rows)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Window") == 3


def test_suffix(docs, none):
    rows = [(i, t.encode()) for i, t in pairs(docs)]
    seen = Counter(b[p:p + 400] for _, b in rows for p in range(len(b) - 399))
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p:p + 400]] > 1:
                gone[p:p + 400] = True
        want.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g)))
    out = suffix.remove_repeats(docs).collect()
    same([(r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in out], want)
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_of_texts_shorter_than_two_windows(spark):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for shared in [*range(330, 400, 3), 399, 400, 401, 430]:
        passage = letters(shared)
        for _ in range(2):
            size = rng.randint(max(400, shared), 479)
            before = rng.randint(0, size - shared)
            rows.append((len(rows), letters(before) + passage + letters(size - shared - before)))
    rows += [rows[0], (len(rows), rows[3][1]), (len(rows) + 1, rows[5][1][:410])]
    seen = Counter(t[p:p + 400] for _, t in rows for p in range(len(t) - 399))
    want = []
    for i, t in rows:
        gone = {k for p in range(len(t) - 399) if seen[t[p:p + 400]] > 1 for k in range(p, p + 400)}
        want.append((i, "".join(c for k, c in enumerate(t) if k not in gone)))
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    same([(r["doc_id"], bytes(r["kept"]).decode()) for r in out], want)


def test_lines(docs, none):
    rows = sorted({(i is None, i or 0, t) for i, t in pairs(docs)})
    sets, want = [], {}
    for missing, i, t in rows:
        keep = []
        for line in t.split("\n"):
            s = frozenset(WORD.findall(line))
            if not s or not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in sets):
                keep.append(line)
            if s:
                sets.append(s)
        want[None if missing else i] = "\n".join(keep)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all((r["text"] or "") == want[r["doc_id"]] for r in out.collect())
    assert lines.dedup_lines(none).count() == 0


def test_lines_split_each_text_once(spark):
    """Kept lines are picked from a column of split lines: a split inside the lambda runs again for every line of a text."""
    out = lines.dedup_lines(spark.createDataFrame([(1, "a b c\na b c\nd e f"), (2, "g h i")], "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array_except(" in plan and not re.search(r"lambdafunction\([^\n]{0,40}split\(", plan)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b c\nd e f"), (2, "g h i")]


def test_lines_of_all_sizes_and_white_space(spark):
    """Against brute force: sets on both sides of the bitmaps' width, any white space between words, lines of blanks alone."""
    rng = random.Random(11)
    rows, seen = [], []
    for i in range(120):
        body = []
        for _ in range(3):
            n = rng.choice((1, 2, 4, 5, 9, 30, lines.NARROW - 3, lines.NARROW, lines.NARROW + 1, lines.NARROW + 6, 110))
            words = [f"w{rng.randrange(3000)}" for _ in range(n)]
            if seen and rng.random() < 0.7:
                words = list(rng.choice(seen))
                for _ in range(rng.randint(0, 1 + len(words) // 5)):
                    words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
                words = words[:max(1, len(words) - rng.randint(0, 1 + len(words) // 8))]
            seen.append(words)
            line = words[0]
            for w in words[1:]:
                line += rng.choice((" ", " ", " ", "  ", "\t", "\r", "\x0b \f") if i % 3 else " ") + w
            body += [rng.choice(("", " ", "\t", "\r", " \x0b\f ")) + line] + ["  ", "\t\r", ""][:rng.randint(0, 2)]
        rows.append((i, "\n".join(body)))
    sets, want = [], []
    for i, t in rows:
        keep = []
        for line in t.split("\n"):
            s = frozenset(WORD.findall(line))
            if not s or not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in sets):
                keep.append(line)
            if s:
                sets.append(s)
        want.append((i, "\n".join(keep)))
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in out) == want
    assert 50 < sum(len(t.split("\n")) for _, t in rows) - sum(len(t.split("\n")) for _, t in want) < 350


def test_lines_of_rows_with_null_and_equal_ids(spark):
    rng = random.Random(7)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(9))
    again, pair = line(), line()
    rows = [(i, "\n".join([line(), line()])) for i in (None, None, None, 5, 5, 5, (1 << 63) - 1)]
    rows += [(None, "\n".join([again, line(), again])), (None, "\n".join([line(), line(), line()]))]
    rows += [(i, f"{pair}\n{line()}") for i in (None, None, 8, 8)] + [(8, None), (None, None), (None, "")]
    rows += [rows[0], rows[3]]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == len(rows)
    left = Counter((r["doc_id"], r["text"]) for r in out)
    whole = [r for r in rows if again not in (r[1] or "") and pair not in (r[1] or "")]
    assert all(left[r] == n for r, n in Counter(whole).items())
    [short] = [t for i, t in left if again in (t or "")]
    assert short.split("\n") == rows[7][1].split("\n")[:2]
    [(keeper, n)] = [(r, n) for r, n in left.items() if pair in (r[1] or "")]
    assert keeper[0] == 8 and n == 1
    ends = Counter((i, t.split("\n")[1]) for i, t in rows[9:13])
    assert Counter((i, t.split("\n")[-1]) for i, t in left if (i, (t or "").split("\n")[-1]) in ends) == ends


def test_packing(docs, none):
    placed = packing.pack(docs, capacity=300, per_source=2).collect()
    words = Counter()
    bins = {}
    for r in placed:
        words[(r["doc_id"], r["copy"], r["cluster"])] += r["n_words"]
        bins.setdefault(r["bin_id"], []).append(r)
    same(list(words.values()), [len(WORD.findall(t)) for _, t in pairs(docs)])
    for part in bins.values():
        assert sum(r["n_words"] for r in part) <= 300
        assert len({(r["cluster"], r["piece"]) for r in part}) == len(part)
        assert max(Counter(r["source"] for r in part).values()) <= 2
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    texts = packing.sequences(docs, packing.pack(docs, capacity=300, per_source=2), 300).collect()
    same([len(WORD.findall(r["text"])) for r in texts], [r["n_words"] for r in texts])
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    placed = packing.best_fit([6, 5, 4, 4], ["a", "b", "c", "d"], [1, 2, 1, 3], 10, 1)
    assert placed[2][0] == placed[1][0] and placed[3][0] == placed[0][0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
    packed = corpus_pipeline.run(spark, folder)
    assert packed.agg(F.sum("n_words")).first()[0] == out.agg(F.sum(mixing.size_of(F.col("text")))).first()[0]
