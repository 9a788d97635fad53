"""The pipeline against plain versions of its stages, each on what its predecessor kept."""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquarry.llm import packing, stages, storage
from sparkquarry.llm.storage import BATCH, BATCH_BYTES, BITS, CLEANUP, SENT, Packed, bitmap, written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def texts(df) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "exact_dedup", "minhash_dedup", "best_fit_packing"]
    assert all(df.columns == kept[0].columns for df in kept[:5])


def test_filters_follow_the_labels(spark, kept):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for before, after, column, good in ((0, 1, "quality", 1), (1, 2, "toxic", 0)):
        was, now = texts(kept[before]), texts(kept[after])
        clean = [k for k in was if k in labels and labels[k][column] == good]
        bad = [k for k in was if k in labels and labels[k][column] != good]
        assert sum(k in now for k in clean) >= 0.97 * len(clean)
        assert sum(k in now for k in bad) <= max(1, 0.3 * len(bad))


def test_exact_stage(kept):
    was, now = texts(kept[2]), texts(kept[3])
    keep: dict[bytes, int] = {}
    for k, t in was.items():
        key = t.encode().lower()
        keep[key] = max(k, keep.get(key, k))
    assert set(now) == set(keep.values())


def test_near_stage(kept):
    was, now = texts(kept[3]), texts(kept[4])
    sets = {}
    for k, t in was.items():
        w = t.encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    low = {k: k for k in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    assert set(now) == {find(k) for k in keys}


def test_packing_stage(kept):
    was = {r["doc_id"]: r["n_words"] for r in packing.words(kept[4].select("doc_id", "text")).collect()}
    total: dict[int, int] = {}
    used: dict[str, int] = {}
    capacity = {}
    for r in kept[5].collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        used[r["bin_id"]] = used.get(r["bin_id"], 0) + r["n_tokens"]
        capacity[r["bin_id"]] = r["capacity"]
    assert total == was
    assert all(n <= capacity[b] and not any(n <= c < capacity[b] for c in stages.CAPACITIES) for b, n in used.items())


def test_null_rows_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3)
    extra = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (7000, "", "en", "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        got = stage(spark, docs.unionAll(extra), SF).select("doc_id").collect()
        assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in docs.collect()} | {None, 7000}
        if name in ("exact_dedup", "minhash_dedup", "best_fit_packing"):
            assert 7000 in {r["doc_id"] for r in got}


def test_classifiers_get_bounded_batches(spark, monkeypatch):
    """However many rows or bytes one partition has, a worker gets TEXTS rows and about SENT bytes at a time; no row is lost."""

    def strict(*_):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                if len(texts) > stages.TEXTS or texts.str.len().sum() > 2 * SENT:
                    raise ValueError(f"{len(texts)} texts of {texts.str.len().sum()} characters at once")
                yield texts.str.startswith("x").astype("int32")

        return F.pandas_udf(run, "int")

    monkeypatch.setattr(stages.quality, "learned", lambda *_: None)
    monkeypatch.setattr(stages.toxicity, "learned", lambda *_: None)
    monkeypatch.setattr(stages.quality, "predicted", strict)
    monkeypatch.setattr(stages.toxicity, "predicted", strict)
    before = {k: spark.conf.get(k) for k in (BATCH, BATCH_BYTES)}
    many = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "if(id % 2 = 0, 'x', 'y') as text")
    long = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "repeat(if(id % 2 = 0, 'x', 'y'), 100000) as text")
    for docs, n in ((many, 2500), (long, 200)):
        good, clean = stages.quality_filter(spark, docs, SF), stages.toxicity_filter(spark, docs, SF)
        assert good.columns == clean.columns == docs.columns
        assert good.selectExpr("count(*)", "sum(doc_id % 2)").first() == (n, 0)
        assert clean.selectExpr("count(*)", "sum(doc_id % 2)").first() == (n, n)
    assert before == {k: spark.conf.get(k) for k in (BATCH, BATCH_BYTES)}


def _shuffled(spark) -> int:
    """Files of shuffles in the folders of the driver, which runs the tasks of tests."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.name.startswith("shuffle_") for d in folders for p in Path(d).rglob("*"))


def test_steps_leave_no_shuffle_files(spark):
    """A written table, and a bitmap, keep nothing of what was shuffled to make them; nor does the setting stay."""
    was = spark.conf.get(CLEANUP)
    counted = spark.range(0, 100_000, 1, 4).selectExpr("id % 1000 as bit").groupBy("bit").count()
    before = _shuffled(spark)
    table = written(counted, "counted")
    assert np.unpackbits(bitmap(counted.select("bit"))).sum() == 1000
    deadline = time.time() + 20  # files go beside the caller
    while (left := _shuffled(spark)) > before and time.time() < deadline:
        time.sleep(0.2)
    assert left <= before
    assert table.selectExpr("sum(count)").first()[0] == 100_000
    assert spark.conf.get(CLEANUP) == was


def test_bitmaps_are_sent_packed():
    """Executors write what is broadcast to disk; few bits take few bytes, and workers get the same bitmap."""
    bits = np.zeros(BITS // 8, np.uint8)
    bits[:: len(bits) // 1000] = 5
    data = pickle.dumps(Packed(bits))
    assert len(data) < len(bits) / 50
    assert (pickle.loads(data) == bits).all()


def test_tables_go_when_nothing_reads_them(spark, monkeypatch, tmp_path):
    """Samples that classifiers are fitted on, and in the whole pipeline what stages before the last one wrote."""
    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    names = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "stage-minhash_dedup" in names
    assert not names & {"quality-sample", "toxicity-sample", "good", "clean", "stage-exact_dedup"}
    assert got.count() > 0
