"""Edge cases of the operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from sparkquarry.llm import bpe, chat, epsgrid, exact, minhash, packing, quality, toxicity, urls
from sparkquarry.llm.components import components

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

DOCS = [
    (1, "One two three four five six seven", "x"), (2, "ONE two three four five six seven", "x"), (3, None, "y"), (4, "", "y"), (5, "   \t", None), (6, "one two", "z"),
    (7, "ONE TWO", "z"), (7, "ONE TWO", "z"), (None, "one two", None), (8, "É é 漢字 " * 3000, "w"), (9, "a" * 50_000, "w"),
]


def tiktoken_encoding():
    import base64

    import tiktoken

    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    """A table with columns that operators use inside."""
    return spark.createDataFrame([(*d, 1, "k") for d in DOCS], "doc_id long, text string, source string, digest int, k string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_bpe_against_the_library(spark, docs, nothing):
    encoding = tiktoken_encoding()
    out = bpe.encode_table(docs, PATH, PATTERN).collect()
    assert len(out) == len(DOCS)
    want = {}
    for k, t, _ in DOCS:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        want[k] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want[r["doc_id"]] for r in out)
    assert bpe.encode_table(nothing, PATH, PATTERN).count() == 0
    texts = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode_table(bpe.encode_table(docs, PATH, PATTERN), PATH, PATTERN).collect()}
    assert texts[8] == DOCS[9][1] and texts[3] == ""


def test_bpe_random_texts():
    encoding, own = tiktoken_encoding(), bpe.encoder(PATH, PATTERN)
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("ab \n\t \x1c é漢1²½_'s.,!\r​😀") for _ in range(rng.randrange(0, 16)))
        assert list(memoryview(own.encode(t)).cast("I")) == encoding.encode_ordinary(t)


def test_exact(docs, nothing):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_duplicates(docs).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 7, 4, False), (7, 7, 4, True), (None, 7, 4, False), (8, 8, 1, True), (9, 9, 1, True)}
    assert exact.exact_duplicates(nothing).count() == 0


def test_minhash(spark, docs, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (0, 3, True) and got[5] == (0, 5, True)
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False) and got[None] == (1, None, True) and got[9] == (1, 9, True)
    assert minhash.near_duplicates(nothing).count() == 0


def test_minhash_against_brute_force(spark, monkeypatch):
    """A group around one text, some members below the threshold, with nodes small enough that all branches are used."""
    monkeypatch.setattr(minhash, "SMALL", 6)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for k in range(60):
        words = list(base) if k < 45 else [f"v{rng.randrange(9000)}" for _ in range(100)]
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8]) if k < 45 else 0):
            words[rng.randrange(len(words))] = f"u{rng.randrange(9999)}"
        rows.append((k, " ".join(words)))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    low = {k: k for k in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in sets}


def test_minhash_trees_have_their_own_coordinates():
    """Texts that differ in a few coordinates only share children in most trees, whichever coordinates these are."""
    one = np.arange(minhash.SKETCH, dtype=np.uint16) + np.uint16(7)
    roots = np.arange(minhash.TREES) * 1000 + 1
    for first in range(minhash.TREES, minhash.SKETCH - 3, 9):
        two = one.copy()
        two[first : first + 4] += np.uint16(1000)
        *_, (row, path) = minhash._walk(np.stack([roots, roots]), np.stack([one, two]), [np.sort(roots)])
        assert len(set(path[row == 0]) & set(path[row == 1])) >= minhash.TREES


def test_minhash_forest_takes_the_likest_pairs():
    near = np.array([[64, 60, 40, 10], [60, 64, 50, 10], [40, 50, 64, 10], [10, 10, 10, 64]], np.uint8)
    assert minhash._tree(near) == [(0, 1), (1, 2)]


def test_minhash_repeated_keys(spark):
    """A key with several texts links them; none of them loses its own copies."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, a), (4, c), (5, c), (5, c), (6, b + " tail")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 1}
    rows = [(1, a), (1, b), (1, c), (2, c + " tail"), (7, "other words stand here alone")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {1: 1, 2: 1, 7: 7}


def test_minhash_recall_around_a_centre(spark):
    """A thousand near copies of a text that isn't the smallest key, most of them unlike each other: nodes large at every level.

    Links found are held against all pairs.
    """
    rng = random.Random(11)
    base = [f"w{rng.randrange(100_000)}" for _ in range(150)]
    rows = []
    for k in range(1000):
        words = list(base)
        for at in rng.sample(range(150), 0 if k == 700 else rng.choice([3, 4, 5])):
            words[at] = f"u{k}x{at}"
        rows.append((k, " ".join(words)))
    words = minhash.Words()
    sets = [minhash.shingles(t, words) for _, t in rows]
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    x = np.zeros((1000, at.max() + 1), np.float32)
    x[np.repeat(np.arange(1000), [len(s) for s in sets]), at] = 1
    common, n = x @ x.T, np.array([len(s) for s in sets])
    linked = 100 * common >= 75 * (n[:, None] + n[None, :] - common)
    component = np.arange(1000)
    while True:
        low = np.where(linked, component[None, :], 1000).min(axis=1)
        if (low == component).all():
            break
        component = low
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lonely = linked.sum(axis=1) == 1
    assert 20 < lonely.sum() < 900  # the group isn't all one star
    assert got == {k: component[k] for k in range(1000)}


def test_minhash_links_in_large_groups(spark, monkeypatch):
    """200 texts around one passage; each has one partner, no text is near the smallest key, and all nodes count as large."""
    monkeypatch.setattr(minhash, "SMALL", 1)
    passage = [f"p{i}" for i in range(100)]
    rows = []
    for k in range(200):
        rows.append((k, " ".join(passage + [f"a{k % 100}x{i}" for i in range(60)] + [f"b{k}x{i}" for i in range(24)])))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k % 100 for k in range(200)}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 200)], "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[100] == got[101] == 100
    assert components(links.where("false")).collect() == []


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(epsgrid, "BLOCK", 16)
    monkeypatch.setattr(epsgrid, "LEAF", 4)
    monkeypatch.setattr(epsgrid, "FAN", 2)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    v = [(centres[i % 12] + rng.normal(size=16) * 0.25 * (i % 3)).astype("f4").tolist() for i in range(150)]
    v += [v[0], v[0], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, x) for i, x in enumerate(v)]
    ok = {i: np.asarray(x, float) for i, x in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    links = {(a, b) for a in ok for b in ok if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.9}
    low = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in links:
            low[b] = min(low[b], low[a])
    got = epsgrid.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (sum(a == i for a, _ in links), low[i]) for i, _ in rows}
    assert epsgrid.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_embeddings_with_odd_keys(spark):
    """Repeated and null keys, and columns with names that are used inside."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a, 0, 0), (1, b, 0, 0), (2, b, 0, 0), (None, a, 0, 0), (3, a, 0, 0), (3, a, 0, 0), (4, [1.0, 1.0], 0, 0)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in epsgrid.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, k int, component int")).collect())
    assert got == [(0, 0, None), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_urls(spark):
    rules = [urls.Rule("com", "/en/", "block"), urls.Rule("example.com", "/en/7", "allow")]
    pages = [(1, "http://A.Example.com/en/7x?q"), (2, "https://example.com/en/8#f"), (3, None), (4, "no scheme"), (5, "http://xcom/en/1"), (6, "http://spam-a.org/x"), (7, "x://b.com/EN/"), (8, "http://e.org/x.com/en/1"), (9, "http://" + "a" * 5000 + ".com/en/")]
    got = {r["page_id"]: (r["host"][:12], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(pages, "page_id int, url string"), rules, ["spam-**", "*.spam-**"]).collect()}
    assert got == {
        1: ("a.example.co", "example.com/en/7", "allow"), 2: ("example.com", "com/en/", "block"), 3: ("", None, "allow"), 4: ("", None, "allow"), 5: ("xcom", None, "allow"), 6: ("spam-a.org", None, "block"),
        7: ("b.com", None, "allow"), 8: ("e.org", None, "allow"), 9: ("a" * 12, "com/en/", "block"),
    }


def test_url_rules_take_signs_literally(spark):
    rules = [urls.Rule("com", "/a*b?", "block")]
    pages = [(1, "http://x.com/a*b?/c"), (2, "http://x.com/a*b"), (3, "http://x.com/axxb/"), (4, "http://com/a*b")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id int, url string"), [urls.Rule("com", "/a*b", "block")], []).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block"}
    assert rules[0].globs() == ["com/a\\*b\\?**", "*.com/a\\*b\\?**"]


def test_bpe_with_another_pattern():
    import regex
    import tiktoken

    pattern = r"[a-z]+ [a-z]+|\p{N}{1,3}|."
    base = bpe.encoder(PATH, PATTERN)
    encoding = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=base.ranks, special_tokens={})
    own = bpe.encoder(PATH, pattern)
    text = "two words 12345 and more words é  x"
    assert list(memoryview(own.encode(text)).cast("I")) == encoding.encode_ordinary(text) and regex.compile(pattern)


def test_glob_automaton_against_regex():
    import re

    rng = random.Random(4)
    globs = ["".join(rng.choice("ab/*?") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    regex = [re.compile("(?s)" + re.sub(r"\*\*+|\*|\?|.", lambda m: ".*" if m[0][:2] == "**" else "[^/]*" if m[0] == "*" else "[^/]" if m[0] == "?" else re.escape(m[0]), g)) for g in globs]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    fits = urls.GlobAutomaton(globs).fits([t.encode() for t in texts])
    assert [[bool(r.fullmatch(t)) for r in regex] for t in texts] == fits.tolist()


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\l<s>[x]"), (1, 1, "assistant", "</s>[INST] ok"), (1, 1, None, None), (2, None, "assistant", ""), (None, 5, "assistant", "é漢")]
    out = chat.read_back(chat.formatted(chat.canonical(chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).collect()
    assert all([(t["role"], t["text"]) for t in r["turns"]] == [(t["role"], t["text"]) for t in r["read_turns"]] for r in out)
    one = next(r for r in out if r["conv_id"] == 1)
    assert one["loss_texts"] == ["", "", "</s>[INST] ok"] and one["formatted"].count("</s>") == 3
    json_rows = [(1, '{"messages": [{"role": "user", "content": "q"}, {"role": "gpt", "content": "a"}], "extra": 1}'), (2, '{"instruction": "i", "input": "x", "output": "o"}'), (3, "no json"), (4, None), (5, '{"other": 1}')]
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]] if r["turns"] is not None else None) for r in chat.canonical_json(spark.createDataFrame(json_rows, "id int, doc string"), "id", "doc").collect()}
    assert got[1] == ("messages", [("user", "q"), ("assistant", "a")]) and got[2] == ("instruction", [("user", "i\n\nx"), ("assistant", "o")])
    assert got[3] == got[4] == got[5] == (None, None)
    # columns with the names of the results are replaced
    typed = chat.canonical(spark.createDataFrame([("p", "r", 1, 2)], "prompt string, response string, turns int, layout int")).first()
    assert typed["layout"] == "prompt_response" and [tuple(t) for t in typed["turns"]] == [("user", "p"), ("assistant", "r")]
    empty = chat.read_back(chat.formatted(chat.canonical(chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))))
    assert empty.count() == 0
    long = "</s>[x] é\\" * 40_000
    back = chat.read_back(chat.formatted(chat.canonical(chat.conversations(spark.createDataFrame([(1, 0, "Human", long)], "conv_id long, turn long, role string, text string"))))).first()
    assert [tuple(t) for t in back["read_turns"]] == [("Human", long)]


def test_chat_fingerprints_pick_the_layout():
    assert len({x.fingerprint for x in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_packing(spark, docs, nothing):
    lengths = [(i, n) for i, n in enumerate([5, 17, 0, 64, 200, 33, 1, 1, 16, 48])] + [(None, 3), (3, 64)]
    got = packing.packed(spark.createDataFrame(lengths, "doc_id long, n int"), "n", [16, 64]).collect()
    assert sum(r["n_tokens"] for r in got) == sum(n for _, n in lengths)
    bins: dict[str, list] = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    for rows in bins.values():
        used = sum(r["n_tokens"] for r in rows)
        assert {r["capacity"] for r in rows} == {16 if used <= 16 else 64} and used <= 64
        at = 0
        for r in sorted(rows, key=lambda r: (r["bin_offset"], r["n_tokens"])):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
    assert packing.packed(packing.words(docs), "n_words", [512]).groupBy("doc_id").count().count() == 10
    assert packing.packed(packing.words(nothing), "n_words", [512]).count() == 0


def test_toxicity(spark, docs, nothing):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        bad = k % 5 == 0
        if bad:
            words[rng.randrange(60)] = rng.choice(["grobix", "zlumpa", "zlumpo", "zlumpet"])
            words[rng.randrange(60)] = rng.choice(["grobix", "zlumpa", "zlumpi"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(1000, "quite clean words here"), (1001, "you GR0BIX go away"), (1002, "zlumру yes"), (1003, None), (1004, "")]
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judged(table, marks).collect()}
    assert all(got[k]["predicted"] == y for k, y in labels)
    assert got[1000]["predicted"] == got[1003]["predicted"] == got[1004]["predicted"] == 0 and got[1001]["predicted"] == 1
    assert toxicity.judged(docs, marks.where("false")).count() == len(DOCS) and toxicity.judged(nothing, marks).count() == 0
    assert toxicity.folded("ІDIОТ s1lly 2024 z​ap!") == " idiot silly 2024 zap  "


def test_toxicity_exceptions():
    lexicon = toxicity.Lexicon({" grob": 4.0, " zap ": 3.0}, [" zap gun "])
    matcher = toxicity.Matcher(lexicon)
    assert list(matcher.words(" zap gun grobs zap ").values()) == [4.0, 3.0]


def test_quality(spark, docs, nothing):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(120)]
        if k % 3 == 0:
            words[40:90] = ["JUNK!!"] * 50 if k % 2 else [w + "###" for w in words[40:90]]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 != 0)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judged(table, marks).collect()}
    held = [(got[k]["predicted"], y) for k, y in labels if got[k]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert quality.judged(docs, marks.where("false")).count() == len(DOCS) and quality.judged(nothing, marks).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    x, v = rng.normal(size=(3, 9)).astype("f4"), rng.normal(size=(9, 4)).astype("f4")
    m = quality.Machine(quality.Settings(), None, None, 0.0, np.zeros(9, "f4"), v)
    pairs = [sum(float(v[i] @ v[j]) * r[i] * r[j] for i in range(9) for j in range(i)) for r in x]
    assert m.logits(x) == pytest.approx(pairs, rel=1e-4)
