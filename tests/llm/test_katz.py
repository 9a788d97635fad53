from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest

from sparkquarry.llm import katz


def plain(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """The same model, written out over dictionaries."""
    words = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    uni, pair, ctx = Counter(), Counter(), Counter()
    for k, t in docs:
        if not held(k):
            before = "start"
            for w in words(t):
                uni[w] += 1
                pair[before, w] += 1
                ctx[before] += 1
                before = w
    total, distinct = sum(uni.values()), len(uni)

    def cut(counts):
        n = Counter(counts)
        return katz.discounts([0] + [n[r] for r in range(1, katz.CUT + 2)])

    kept = lambda c, d: c - katz.FIXED if c > katz.CUT else d[c] * c
    d1, d2 = cut(uni.values()), cut(pair.values())
    mass = sum(kept(c, d1) for c in uni.values())
    unknown = max(1 - mass / total, 1 / (total + 1)) if total else 1.0
    p1 = {w: kept(c, d1) / mass * (1 - unknown) for w, c in uni.items()}
    after = defaultdict(list)
    for a, b in pair:
        after[a].append(b)

    def logp(a, b):
        if (a, b) in pair:
            return math.log10(kept(pair[a, b], d2) / ctx[a])
        p = p1.get(b, unknown)
        if ctx[a]:
            seen = sum(kept(pair[a, x], d2) for x in after[a]) / ctx[a]
            p *= max(1 - seen, 1e-12) / max(1 - sum(p1[x] for x in after[a]), 1e-12)
        return math.log10(p)

    out = {}
    for k, t in docs:
        w = words(t)
        base = sum(math.log10((uni[x] + 1) / (total + distinct + 1)) for x in w)
        out[k] = (held(k), len(w), sum(uni[x] > 0 for x in w), total, base, sum(logp(a, b) for a, b in zip(["start", *w], w)))
    return out


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain(docs)
    got = katz.scores(df.repartition(3)).collect()
    assert len(got) == len(docs)
    for r in got:
        h, n, known, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in rows] + [(900, None), (901, ""), (902, "only unseen zzz qqq"), (905, "a  b\ta\nB" * 3)])


@pytest.mark.parametrize("sizes", [(1, 16, 50, 40)])
def test_small_buckets_and_table(spark, monkeypatch, sizes):
    """With few frequent words, narrow buckets and a small head, every path is taken."""
    head, frequent, bucket, chunk = sizes
    for name, value in zip(("HEAD", "FREQUENT", "BUCKET", "CHUNK"), sizes):
        monkeypatch.setattr(katz, name, value)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()
    check(spark, [(k, t[:900]) for k, t in rows])


def test_no_rows_and_no_training_rows(spark):
    assert katz.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    check(spark, [(4, "a b")] if zlib.crc32(b"4") % 7 == 2 else [(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2), "a b")])
