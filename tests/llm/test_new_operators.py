"""Main text of pages, whitening and alignment against plain versions, and odd rows."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from sparkquarry.llm import align, chat, htmltext, queries, whiten

SF = "/root/testdata/sf0.01"


# -- main text ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tree(spark):
    return htmltext.trained(spark)


def words(n: int) -> str:
    return " ".join(f"w{i}" for i in range(n))


def test_pages_have_the_text_of_their_article(spark):
    """These pages have one article element without anything else in it, so a plain reading of it is the whole answer."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op11_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for row in rows:
        article = re.search("<article>(.*)</article>", pages[row["page_id"]]["html"], re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article))
        want = "\n".join(p for p in parts if p)
        assert (row["text"], row["n_chars"], row["url"]) == (want, len(want), pages[row["page_id"]]["url"])


def test_labelled_blocks_are_told_apart(tree):
    rows, labels = map(np.array, zip(*htmltext.examples(), strict=True))
    assert (tree.predict(rows) == labels).mean() > 0.995 and {-1, 0, 1} >= {int(x) for x in rows[:, htmltext.FEATURES.index("standing")]}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{words(30)}</p><p>One.</p><div class='comments'><p>{words(50)}</p></div></article><footer>c</footer>", f"Title\n{words(30)}\nOne."),
        (f"<div id=nav><a>x</a></div><div class='content'><h1>Title here</h1><p>{words(30)}<p>{words(3)}</div><div id=footer>foo</div>", f"Title here\n{words(30)}\n{words(3)}"),
        ("<article><p>a&nbsp;b &lt;i&gt; &#65; &amp;amp;<br>c\t d</p></article>", "a b <i> A &amp; c d"),
        (f"<main><h1>T</h1><p>{words(10)}</p><form><label>Name</label><input></form></main><aside>{words(80)}</aside>", f"T\n{words(10)}"),
        (f"<p>{words(60)}</p><p>{words(40)}</p>", f"{words(60)}\n{words(40)}"),
        ("<p>Just a few words.</p>", "Just a few words."),
        (f"<div class='cookie-banner'>{words(40)} <button>OK</button></div><article><h1>T x</h1><p>{words(20)}</p><ul><li>i one<li>i two</ul><div class=ad>buy</div><p>end</article>", f"T x\n{words(20)}\ni one\ni two\nend"),
        (f"<header><h1>Site</h1></header><article><h2>T</h2><p>{words(25)}</p></article><section id='comments'><h3>C</h3><article class='comment'><p>{words(70)}</p></article></section>", f"T\n{words(25)}"),
        ("<article><p>a <b>b<i>c</b>d</i> e</p><p title='x > y' class=\"q>r\">f</p><script>var p = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>g", "a bcd e\nf\ng"),
        ("<article><p>kept</p><!-- never closed <p>gone</p></article>", "kept"),
        ("<article><p>kept</p><script>never closed <p>gone</p></article>", "kept"),
        ("<article><p>1 < 2 and &unknown; &amp</p><p></p><p> \n </p></article>", "1 < 2 and &unknown; &"),
        ("<article>loose<p>x</p>more <span class=ad>buy</span>text</article>", "loose\nx\nmore text"),
        ("", ""),
        (None, ""),
    ],
)
def test_pages_of_other_kinds(tree, page, want):
    assert htmltext.main_texts([page], tree) == [want]


def test_deep_and_broken_pages_take_time_in_proportion(tree):
    for page in ("<div>" * 100_000 + "x", "<p>" * 50_000, "</b></i></div>" * 50_000, "<b><i>" * 50_000 + "</p>" * 50_000, '<a href="' * 20_000, "<!--" * 50_000, "<" * 100_000, "<script>" * 20_000):
        htmltext.main_texts([page], tree)
    long = f"<article><p>{'word ' * 400_000}</p></article>"
    assert len(htmltext.main_texts([long], tree)[0]) == 400_000 * 5 - 1


def test_extraction_of_odd_rows(spark, tree):
    rows = [(1, None, None), (None, "u", "<article>x</article>"), (1, "v", "<article>y</article>"), (2**60 + 1, "", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, htmltext.extracted(pages, tree).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "x", 1), (1, "v", "y", 1), (2**60 + 1, "", "", 0)], key=str)
    assert htmltext.extracted(pages.limit(0), tree).collect() == []


# -- whitening ------------------------------------------------------------------------------------


def plain_whitening(vectors: list[list[float]]):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, (x - sums / n) @ components, values


def held_against_plain(rows, keys, vectors, take):
    n, deviation, projected, values = plain_whitening(vectors)
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r
    assert len(rows) == take * len(keys) and {*got} == {*keys}
    table = np.array([[got[k][c + 1]["whitened"] for c in range(take)] for k in keys])
    want = projected[:, :take] / np.sqrt(values[:take])
    assert np.abs(table - want * np.sign((table * want).sum(axis=0))).max() < 1e-6
    for k, d in zip(keys, deviation, strict=True):
        assert all(r["deviation"] == d and r["n"] == n for r in got[k].values())
    first = got[keys[0]]
    assert np.allclose([first[c + 1]["explained"] for c in range(take)], values[:take] / values.sum(), rtol=1e-9)
    assert {r["identity_error"] for r in rows} == {first[1]["identity_error"]} and first[1]["identity_error"] < 1e-9


def test_whitening_query_against_eigenvectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    held_against_plain(queries.op12_whitening(spark, SF).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 16)


def test_whitening_of_many_partitions_and_copies(spark, monkeypatch):
    """Copies count once; 300 factors are merged in three rounds."""
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(500, 5)) * [5, 4, 3, 2, 1] + 7).tolist()
    rows = [(i, v) for i, v in enumerate(base + base[:100] + [base[0]] * 300)]
    monkeypatch.setattr(whiten, "BATCH", 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = whiten.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    held_against_plain(got, [i for i, _ in rows], [v for _, v in rows], 5)


def test_whitening_of_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, n long"
    good = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (1, [9.0, 2.0]), (2**60 + 1, [1.0, 2.0])]
    bad = [(5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1e30, 1.0]), (11, [1.0, 2.0, 3.0])]
    rows = whiten.whitened(spark.createDataFrame([(*r, 1) for r in good + bad], kind)).collect()
    n, deviation, _, _ = plain_whitening([v for _, v in good])
    assert sorted(((r["vec_id"], r["deviation"], r["n"]) for r in rows if r["component"] == 1), key=str) == sorted(((k, d, n) for (k, _), d in zip(good, deviation, strict=True)), key=str)
    assert n == 4 and len(rows) == 10
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whiten.whitened(spark.createDataFrame([(*r, 1) for r in few], kind)).collect() == []
    flat = whiten.whitened(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [4.0, 2.0], 1)], kind)).collect()  # one entry never changes
    assert sorted((r["vec_id"], r["component"], r["explained"]) for r in flat) == [(1, 1, 1.0), (2, 1, 1.0)]


def test_deviations_beyond_a_long():
    centred = whiten.Centred(10**9, [10**15] * 3)
    assert centred.deviations(np.array([[10**6, 10**6, 10**6], [10**6 + 10, 10**6, 10**6]])) == [0, None]


# -- alignment ------------------------------------------------------------------------------------

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    """The contract, token by token, with the libraries that the files are made for."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_own, b_own = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_own.encode_special_tokens = True
    alphabet = align._byte_alphabet()
    a_table = {i: bytes(alphabet.get(c, 0) for c in entry) for entry, i in a_own.get_vocab().items()}

    def piece(i: int) -> bytes:
        entry = b_own.id_to_piece(i)
        return bytes([int(entry[3:5], 16)]) if b_own.is_byte(i) else entry.replace("▁", " ").encode()

    told, counts = [], Counter()
    for text in texts:
        a, b = (a_own.encode(" " + text, add_special_tokens=False).ids, b_own.encode(text)) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(a_table[i] for i in a) != want or b"".join(map(piece, b)) != want:
            a, b = [], []
        groups, left, right, i, j = [], [], [], 0, 0
        at_a = at_b = 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                left.append(a[i])
                at_a += len(a_table[a[i]])
                i += 1
            else:
                right.append(b[j])
                at_b += len(piece(b[j]))
                j += 1
            if at_a == at_b:
                groups.append((left, right))
                left, right = [], []
        links = [(x, y) for g, h in groups for x in g for y in h]
        counts.update({*links})
        told.append((a, b, groups, links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    digest = lambda groups: hashlib.sha256(";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups).encode()).hexdigest() if groups else ""
    return [(len(a), len(b), len(g), len(ls), sum(counts[x] == top[x[0]] for x in ls), sum(counts[x] for x in ls), digest(g)) for a, b, g, ls in told]


def test_alignment_query_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], plain_alignment([r["text"] for r in docs]), strict=True))
    rows = queries.op13_alignment(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want and len(rows) == len(docs)


ODD = [
    None, "", " ", "  two  spaces ", "\n\ttabs\n\n", "a" * 5000, "日本語のテキスト。", "naïve café — “quotes”", "🎉🎉 emoji \U0001f468‍\U0001f469", "<s> </s> <|endoftext|> <unk> <0x41>",
    "▁ a real lower block", "x", "x", "The cat sat on the mat. " * 400, "\x00\x01 control", "ｆｕｌｌ", "é combining", "12345678901234567890", "aaaabaaaabaaaab" * 50, " nbsp　wide",
]


@pytest.mark.parametrize("limit", [1 << 20, 5])
def test_alignment_of_odd_texts(spark, monkeypatch, limit):
    """limit 5: every document with more links is taken in blocks of A ids, and tasks tell partial counts early."""
    keys = [*range(len(ODD) - 2), None, 3]
    docs = spark.createDataFrame([(k, t, 1) for k, t in zip(keys, ODD, strict=True)], "doc_id long, text string, n_a int").repartition(3)
    monkeypatch.setattr(align, "LINKS", limit)
    monkeypatch.setattr(align, "HELD", limit)
    monkeypatch.setattr(align, "BATCH", 4)
    a_bytes, b_bytes = (align._lengths(x.table) for x in align._loaded(align._read(A), align._read(B)))
    tokens = align.tokenised(docs, A, B).collect()
    blocks = list(align.Aligned([r["a"] for r in tokens], [r["b"] for r in tokens], a_bytes, b_bytes).pairs())
    found = np.concatenate([k for k, _ in blocks])
    assert len(found) == len(np.unique(found)) and (limit > 5 or len(blocks) > 5)
    got = sorted(map(tuple, align.alignment(docs, A, B).collect()), key=str)
    assert got == sorted([(k, *w) for k, w in zip(keys, plain_alignment(ODD), strict=True)], key=str)
    assert align.alignment(docs.limit(0), A, B).collect() == []


def test_other_byte_level_files_are_run_by_their_library():
    import json

    told = json.loads(align._read(A))
    told["model"]["merges"] = told["model"]["merges"][:1000]
    told["model"]["vocab"] = {k: v for k, v in told["model"]["vocab"].items() if v < 1256}
    swapped = json.loads(json.dumps(told))
    swapped["model"]["merges"][10:12] = swapped["model"]["merges"][11:9:-1]
    one, two = align.ByteLevel(json.dumps(told).encode()), align.ByteLevel(json.dumps(swapped).encode())
    assert one.encode.__self__.__class__.__module__.startswith("tiktoken") and two.encode.__name__ == "<lambda>"
    assert all(max(x.encode(" the cat in the hat")) < 1256 for x in (one, two))


# -- records of several layouts -------------------------------------------------------------------


def test_records_of_several_layouts_give_their_turns(spark):
    """Each record's own fingerprint picks its layout; all turns come back as they were."""
    turns = {1: [("user", "a"), ("assistant", "b")], 2: [("system", ""), ("user", "q"), ("assistant", "r")], 3: [("User", "x")], 4: [("user", "p"), ("user", "p"), ("tool", "{}")], 5: [("gpt", "")], 6: [("", "")]}
    rows = [(k + 10 * n, i, r, t) for n in range(12) for k, ts in turns.items() for i, (r, t) in enumerate(ts)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.mixed(chat.conversations(table))
    got = chat.canonical_records(records, "conv_id", "record").collect()
    assert all([tuple(t) for t in r["turns"]] == turns[r["conv_id"] % 10] for r in got) and len(got) == 72
    assert {r["layout"] for r in got} == {"turn_records", "messages", "shared", "prompt_response", "system_question"} and len({r["fingerprint"] for r in got}) == 5


def test_queries_records_come_in_several_layouts(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    found = chat.canonical_records(chat.mixed(chat.conversations(rows)), "conv_id", "record").groupBy("layout").count().collect()
    assert len(found) >= 3 and all(r["layout"] for r in found)


def test_records_without_a_layout_have_no_turns(spark):
    rows = spark.createDataFrame([(1, (None, None)), (2, ("x", None)), (3, ("x", "y"))], "k long, record struct<prompt: string, response: string>")
    assert [(r["layout"], r["turns"]) for r in chat.canonical_records(rows, "k", "record").orderBy("k").collect()] == [(None, None), (None, None), ("prompt_response", [("user", "x"), ("assistant", "y")])]
