"""The registered queries of the operators: against SQL where there is some, else against plain versions and held-out labels."""

from __future__ import annotations

import itertools
import random
import zlib

import pytest
from test_oracles import SF, compared

from sparkquarry.llm import katz, packing, quality, queries, registry, stages, toxicity, urls


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    compared(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def labels(spark, sf: str, column: str) -> dict[int, int]:
    return {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


@pytest.mark.parametrize(("query", "column", "parts", "fold"), [(queries.op3_toxicity, "toxic", 5, 0), (queries.op5_quality, "quality", 3, 1)])
def test_classifiers_on_held_out_labels(spark, query, column, parts, fold):
    sf = "/root/testdata/sf0.1"
    rows = query(spark, sf).collect()
    want = labels(spark, sf, column)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == fold) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], r["predicted"], want[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in want]
    assert sum(p == y for _, p, y in held) >= 0.9 * len(held)
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) >= 0.93 * len(good) * len(bad)


def test_toxicity_is_the_same_over_any_partitions(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0"))
    one = toxicity.learned(docs.repartition(7), marks, "toxic", 5, 0)
    two = toxicity.learned(docs.orderBy("text").coalesce(2), marks.repartition(3), "toxic", 5, 0)
    assert one.entries == two.entries and one.exceptions == two.exceptions and one.calibration == pytest.approx(two.calibration, rel=1e-9)


def test_exception_phrases_are_learned(spark):
    """A word that marks bad texts, but not in one phrase."""
    rng = random.Random(1)
    filler = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(600):
        words = [rng.choice(filler) for _ in range(30)]
        bad = k % 3 == 0
        if bad:
            words[10] = "grimble"
        elif k % 9 == 1:
            words[10:12] = ["grimble", "street"]
        rows.append((k, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    lexicon = toxicity.learned(docs, marks, "toxic", 5, 0, toxicity.Settings(least_odds=3.0, least_share=0.01))
    assert " grimble street " in lexicon.exceptions
    assert not toxicity.Matcher(lexicon).words(toxicity.folded("in grimble street")) and toxicity.Matcher(lexicon).words(toxicity.folded("a gr1mble"))


def capacity(lengths, sizes, assignment) -> int:
    total = 0
    for b in set(assignment):
        used = sum(n for n, x in zip(lengths, assignment, strict=True) if x == b)
        if used > sizes[-1]:
            return 1 << 60
        total += next(s for s in sizes if s >= used)
    return total


def test_packing_against_all_packings():
    """On a few pieces, against the best of all packings: never above it by half, and by little on average."""
    rng = random.Random(7)
    ratio = []
    for _ in range(60):
        sizes = sorted(rng.sample(range(4, 40), 3))
        lengths = [rng.randrange(1, sizes[-1] + 1) for _ in range(rng.randrange(2, 7))]
        pieces, bins = packing.pack(lengths, sizes)
        used = {b: sum(n for _, x, _, n in pieces if x == b) for b in bins}
        assert sorted(n for _, _, _, n in pieces) == sorted(lengths) and all(used[b] <= bins[b] for b in bins)
        best = min(capacity(lengths, sizes, a) for a in itertools.product(range(len(lengths)), repeat=len(lengths)))
        ratio.append(sum(bins.values()) / best)
    assert max(ratio) <= 1.5 and sum(ratio) / len(ratio) <= 1.08


def test_packing_chooses_lengths_jointly():
    """Pieces that only the shorter length fits well; and small ones that fill up the rest of long bins."""
    _, bins = packing.pack([1700] * 200, [1750, 8192])
    assert sum(bins.values()) <= 1.04 * 200 * 1700
    _, bins = packing.pack([6000] * 20 + [548] * 80, [4096, 8192])
    assert sum(bins.values()) <= 1.01 * (20 * 6000 + 80 * 548)


def test_packing_spreads_one_key(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    rows = spark.createDataFrame([(None, 7)] * 1000, "doc_id long, n int")
    got = packing.packed(rows, "n", [64])
    per_shard = [r["count"] for r in got.groupBy(got["bin_id"].substr(1, 2).alias("s")).count().collect()]
    assert got.count() == 1000 and len({r["bin_id"].split("-")[0] for r in got.collect()}) == 20 and max(per_shard) < 500


def test_packing_query(spark):
    rows = queries.op4_best_fit_packing(spark, SF).collect()
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total: dict[int, int] = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == words
    assert sum({r["bin_id"]: r["capacity"] for r in rows}.values()) <= 1.1 * sum(words.values()) + 512


EXTRA = "doc_id long, text string, lang string, score int, k int, n int"


def test_edges_of_urls(spark):
    rule = [urls.Rule("com", "/en/", "block")]
    assert urls.judge(spark.createDataFrame([], "page_id int, url string"), rule, []).count() == 0
    rows = [(1, "http://a.com/en/", "h", 1), (1, "http://a.com/en/", "h", 1), (None, None, None, None)]
    got = sorted(tuple(r) for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string, host string, verdict int"), rule, []).select("host", "verdict").collect())
    assert got == [("", "allow"), ("a.com", "block"), ("a.com", "block")]


def test_edges_of_classifiers(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} here", "en", 1, 2, 3) for i in range(20)] + [(None, None, None, None, None, None), (3, "", "x", 0, 0, 0), (3, "", "x", 0, 0, 0), (30, "bad " * 30_000, "x", 0, 0, 0)], EXTRA)
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, toxic int, quality int")
    for judged in (lambda d, m: toxicity.judged(d, m), lambda d, m: quality.judged(d, m)):
        rows = judged(docs, marks).collect()
        assert len(rows) == 24 and all(0 <= r["score"] <= 1 for r in rows)
        empty = {r["score"] for r in rows if r["doc_id"] is None or r["doc_id"] == 3}
        assert len(empty) <= 2
        assert judged(docs.where("false"), marks).count() == 0
        assert judged(docs, marks.where("false")).count() == 24


def test_edges_of_language_model(spark):
    docs = spark.createDataFrame([(None, "a b a b", "", 1, 1, 1), (None, None, "", 1, 1, 1), (5, "a b", "", 1, 1, 1), (5, "b a", "", 1, 1, 1), (6, "x y " * 40_000, "", 1, 1, 1)], EXTRA)
    rows = katz.scores(docs).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 3, 3, 5, 80_001] and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)


def test_stages_with_odd_rows(spark):
    """Rows that repeat a key, null keys and texts, names that stages use inside, and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _mark string, _id string, _digest string"
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "s", 1, "m", "i", "d"), (7, text.upper(), "en", "s", 1, "m", "i", "d"), (7, text, "en", "s", 1, "m", "i", "d"), (None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (9, "", "", "", 0, "", "", ""), (8, "other", "", "", 0, "", "", ""), (6, text + " tail", "", "", 0, "", "", "")]
    docs = spark.createDataFrame(rows, schema)
    kept = stages.exact_dedup(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept) == [(6, text + " tail"), (7, text), (8, "other"), (9, "")]
    near = stages.minhash_dedup(spark, docs, SF)
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == {1, 8, 9, None}
    for stage in (stages.exact_dedup, stages.minhash_dedup):
        assert stage(spark, docs.where("false"), SF).collect() == []
