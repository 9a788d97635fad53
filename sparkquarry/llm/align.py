"""Cross-tokenizer alignment: which ids of two tokenizers share bytes of a text, and in how many documents they do.

Tokenizer A (byte-level BPE, a JSON file) reads a space and the text; tokenizer B (pieces, a model file) reads the text
and adds the space itself. Byte offsets at which tokens of both end cut a text into groups; every A token of a group
is linked with every B token of it. An id pair is one integer, `a << 20 | b`.

1. One pass tokenises every text and writes both id sequences, packed. Texts that are null or empty, or whose tokens
   don't give the bytes of space and text again, have no tokens.
2. Tasks turn ids into the distinct pairs of each document and count them with np.unique; what they hold is bounded by
   HELD pairs, beyond which partial counts are told. These are dealt by ranges of the pair, sorted, and runs are summed.
3. The sorted counts are written to the shared folder and sent to executors with addFile. A worker that needs a shard
   maps it into memory (whichever comes first in an executor's folder lays it out) and finds pairs by searchsorted.

The work is bounded by LINKS pairs at a time: a group with more is first reduced to its distinct ids, then taken in
blocks of A ids. The counts are bounded by the product of the vocabularies, not by the documents; best counts are one
number for each A id. A lost executor's shards come from the shared folder again: its table must stay.

Documents are rows: rows that repeat a key or a text count one by one, and null keys stay null. Other columns of the
input stay out of the result. An empty table gives an empty table.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, written

#: Bits of an id within a pair; both vocabularies are smaller. A document's number stands above both ids.
BITS = 20
PAIR = (1 << 2 * BITS) - 1
#: Links that are expanded at once, and distinct pairs that a task holds before it tells partial counts.
LINKS, HELD = 1 << 19, 1 << 20
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: Texts that a Python worker gets at a time.
BATCH = 256

#: Fixed value: the pattern that byte-level tokenizers of this kind split texts by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in entries of a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A. The JSON's merges rank like the ids they make, so tiktoken runs it; any other JSON is run by its own library."""

    def __init__(self, data: bytes) -> None:
        told = json.loads(data)
        alphabet = _byte_alphabet()
        added = {x["id"] for x in told.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in entry): i for entry, i in told["model"]["vocab"].items() if i not in added}
        self.table = [b""] * (max([*ranks.values(), *added]) + 1)
        for entry, i in ranks.items():
            self.table[i] = entry
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        made = [told["model"]["vocab"][a + b] for a, b in pairs]
        split = told.get("pre_tokenizer") or {}
        if made == sorted(set(made)) and len(made) + 256 == len(ranks) and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer"):
            import tiktoken

            self.encode = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(data.decode())
            own.encode_special_tokens = True
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=data)
        entries = [own.id_to_piece(i) for i in range(own.vocab_size())]
        self.table = [bytes([int(x[3:5], 16)]) if own.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(entries)]
        self.encode = own.encode


@lru_cache(maxsize=4)
def _loaded(a: bytes, b: bytes) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


def _packed(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def tokenised(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, a, b) of each row: the ids of both tokenizers as little-endian integers of 16 bits, or of 32 where a vocabulary needs them. The driver reads both files and sends them on."""
    sent = docs.sparkSession.sparkContext.broadcast((_read(a_path), _read(b_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_level, pieces = _loaded(*sent.value)
        packed = _packed(max(len(byte_level.table), len(pieces.table)))
        for batch in batches:
            a, b = [], []
            for t in batch.column(1).to_pylist():
                x, y = (byte_level.encode(f" {t}"), pieces.encode(t)) if t else ((), ())
                want = f" {t}".encode() if t else b""
                if b"".join(map(byte_level.table.__getitem__, x)) != want or b"".join(map(pieces.table.__getitem__, y)) != want:
                    x = y = ()
                a.append(np.array(x, packed).tobytes())
                b.append(np.array(y, packed).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary())], [key, "a", "b"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, a binary, b binary")


class Aligned:
    """Groups of some documents. Their ids stand one after the other; every document ends a group, so no group spans two."""

    def __init__(self, a: list[bytes], b: list[bytes], a_bytes: np.ndarray, b_bytes: np.ndarray) -> None:
        packed = np.dtype(_packed(max(len(a_bytes), len(b_bytes))))
        self.a, self.b = (np.frombuffer(b"".join(x), packed).astype(np.int64) for x in (a, b))
        self.n_a, self.n_b = (np.array([len(y) // packed.itemsize for y in x], np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(a_bytes[self.a]), np.cumsum(b_bytes[self.b])
        last_a, last_b = _within(ends_a, ends_b), _within(ends_b, ends_a)
        self.group_a, self.group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        self.in_a, self.in_b = (np.bincount(x, minlength=int(last_a.sum())) for x in (self.group_a, self.group_b))
        self.doc_a = np.repeat(np.arange(len(a)), self.n_a)
        self.doc_b = np.repeat(np.arange(len(b)), self.n_b)
        self.group_doc = self.doc_a[last_a]
        self.n_groups = np.bincount(self.group_doc, minlength=len(a))
        self.n_links = _summed(self.group_doc, self.in_a * self.in_b, len(a))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document << 40 | pair, how many links) of all links, sorted; each document's pair comes in one block only."""
        links = self.n_links
        ends = np.cumsum(links)
        start = 0
        while start < len(links):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LINKS, "right")))
            if links[start] > LINKS:
                yield from self._large(start)
            elif links[start:stop].any():
                yield self._small(start, stop)
            start = stop

    def _small(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        of_a, of_b = (slice(*np.searchsorted(x, (start, stop))) for x in (self.doc_a, self.doc_b))
        groups, times = self.group_a[of_a], self.in_b[self.group_a[of_a]]
        first_b = (np.cumsum(self.in_b) - self.in_b)[groups]
        total = int(times.sum())
        step = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
        keys = np.repeat(self.doc_a[of_a] << 2 * BITS | self.a[of_a] << BITS, times) | self.b[np.repeat(first_b, times) + step]
        return np.unique(keys, return_counts=True)

    def _large(self, doc: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One document with many links: ids of a group are made distinct, then blocks of A ids meet the B ids of their groups."""
        of_a, of_b = (slice(*np.searchsorted(x, (doc, doc + 1))) for x in (self.doc_a, self.doc_b))
        (a, times_a), (b, times_b) = (np.unique(g[s] << BITS | x[s], return_counts=True) for g, s, x in ((self.group_a, of_a, self.a), (self.group_b, of_b, self.b)))
        order = np.argsort(a & (1 << BITS) - 1, kind="stable")
        a, times_a = a[order], times_a[order]
        group, a = a >> BITS, a & (1 << BITS) - 1
        low, high = np.searchsorted(b, group << BITS), np.searchsorted(b, group + 1 << BITS)
        b &= (1 << BITS) - 1
        firsts = np.flatnonzero(np.diff(a, prepend=-1))
        sizes = np.add.reduceat(high - low, firsts)
        block = np.cumsum(sizes) // LINKS
        for rows in np.split(np.arange(len(a)), firsts[1:][np.diff(block) > 0]):
            keys, times = [], []
            for i in rows:
                keys.append(doc << 2 * BITS | int(a[i]) << BITS | b[low[i] : high[i]])
                times.append(times_a[i] * times_b[low[i] : high[i]])
            yield _run_sums(np.concatenate(keys), np.concatenate(times))

    def digests(self) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2` of each document, the empty text for one without tokens."""
        words = _words(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1)
        before_a, before_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        at_a = np.arange(len(self.a)) + before_b[self.group_a]
        at_b = np.arange(len(self.b)) + (before_a + self.in_a)[self.group_b]
        place = np.empty(len(self.a) + len(self.b), np.int64)
        place[at_a] = 3 * self.a + np.append(np.diff(self.group_a) > 0, [True] * bool(len(self.a)))
        place[at_b] = 3 * self.b + 2 * np.append(np.diff(self.group_b) > 0, [True] * bool(len(self.b)))
        told = [words[i] for i in place]
        ends = np.cumsum(self.n_a + self.n_b)
        return [hashlib.sha256(b"".join(told[e - n : e])[:-1]).hexdigest() if n else "" for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True)]


def _within(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    at = np.searchsorted(others, ends)
    return (others[np.minimum(at, len(others) - 1)] == ends) if len(others) else np.zeros(len(ends), bool)


def _summed(of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by class, exactly."""
    out = np.zeros(size, np.int64)
    np.add.at(out, of, values)
    return out


def _run_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    firsts = np.flatnonzero(np.append([True], keys[1:] != keys[:-1])) if len(keys) else order
    return keys[firsts], np.add.reduceat(values, firsts) if len(firsts) else values


_told: list[bytes] = []


def _words(size: int) -> list[bytes]:
    """Every id in decimal, followed by a comma, by a bar and by a semicolon."""
    for i in range(len(_told) // 3, size):
        _told.extend(b"%d%s" % (i, end) for end in (b",", b"|", b";"))
    return _told


def _lengths(table: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in table], np.int64)


def pair_counts(tokens: DataFrame, a_bytes: np.ndarray, b_bytes: np.ndarray) -> DataFrame:
    """(pair, n): in how many rows of tokenised() a pair is linked. Sorted within and over the partitions of the written table."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for found, _ in (block for at in range(0, batch.num_rows, BATCH) for block in Aligned(*(c.to_pylist() for c in batch.slice(at, BATCH).columns), a_bytes, b_bytes).pairs()):
                pair, n = np.unique(found & PAIR, return_counts=True)
                keys.append(pair)
                counts.append(n)
                held += len(pair)
                if held > HELD:
                    pair, n = _run_sums(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [pair], [n], len(pair)
                    if held > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])
                        keys, counts, held = [], [], 0
        if keys:
            pair, n = _run_sums(np.concatenate(keys), np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, count = -1, 0
        for pdf in batches:
            pair, n = _run_sums(np.append([last], pdf["pair"].to_numpy()), np.append([count], pdf["n"].to_numpy()))
            ended = slice(int(pair[0] < 0), -1)
            yield pd.DataFrame({"pair": pair[ended], "n": n[ended]})
            last, count = int(pair[-1]), int(n[-1])
        if last >= 0:
            yield pd.DataFrame({"pair": [last], "n": [count]})

    spark = tokens.sparkSession
    parts = written(tokens.select("a", "b").mapInArrow(partial, "pair long, n long"), "pair-parts", BATCH)  # dealing by ranges looks at them twice
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = written(parts.repartitionByRange(shards, "pair").sortWithinPartitions("pair").mapInPandas(runs, "pair long, n long"), "pair-counts")
    release(parts)
    return counts


def sent_files(table: DataFrame) -> list[str]:
    """Names of the files of a table made by written(), in the order of its partitions; executors get them by addFile."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(table._table_path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = sorted(f.getPath().toString() for f in files if f.getPath().getName().startswith("part-"))
    for name in names:
        spark.sparkContext.addFile(name)
    return [os.path.basename(name) for name in names]


class Shards:
    """Sorted counts in the files of an executor's folder. Each is laid out once an executor as plain arrays and then mapped into memory."""

    def __init__(self, names: list[str]) -> None:
        import pyarrow.parquet as pq

        found = []
        for name in names:
            meta = pq.ParquetFile(SparkFiles.get(name)).metadata
            if meta.num_rows:
                found.append((meta.row_group(0).column(0).statistics.min, name))
        found.sort()
        self.firsts = np.array([x for x, _ in found], np.int64)
        self.names = [x for _, x in found]
        self.mapped: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _map(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.parquet as pq

        path = SparkFiles.get(self.names[k])
        with open(f"{path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(f"{path}.n"):
                with open(f"{path}.pair", "wb") as pairs, open(f"{path}.new", "wb") as counts:
                    for batch in pq.ParquetFile(path).iter_batches(columns=["pair", "n"]):
                        batch.column(0).to_numpy().tofile(pairs)
                        batch.column(1).to_numpy().tofile(counts)
                os.rename(f"{path}.new", f"{path}.n")
        return np.memmap(f"{path}.pair", np.int64, "r"), np.memmap(f"{path}.n", np.int64, "r")

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each of some sorted pairs."""
        out = np.zeros(len(pairs), np.int64)
        cuts = np.append(np.searchsorted(pairs, self.firsts), len(pairs))
        for k in np.flatnonzero(np.diff(cuts)):
            keys, n = self.mapped.get(k) or self.mapped.setdefault(k, self._map(k))
            out[cuts[k] : cuts[k + 1]] = n[np.searchsorted(keys, pairs[cuts[k] : cuts[k + 1]])]
        return out


def alignment(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    n_best: links whose pair has the highest count of all pairs with its A id; count_sum: the sum of counts over links.
    """
    spark = docs.sparkSession
    a_bytes, b_bytes = (_lengths(x.table) for x in _loaded(_read(a_path), _read(b_path)))
    if max(len(a_bytes), len(b_bytes)) > 1 << BITS:
        raise ValueError(f"a vocabulary has more than {1 << BITS} entries")
    tokens = written(tokenised(docs, a_path, b_path, key, text), "tokens", BATCH)
    tokens_read = tokens.select(F.col(key).alias("k"), "a", "b")
    counts = pair_counts(tokens_read, a_bytes, b_bytes)
    top = np.zeros(len(a_bytes), np.int64)  # one number for each A id
    for row in counts.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("n").alias("n")).toLocalIterator():
        top[row["a"]] = row["n"]
    names = sent_files(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(names)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = Aligned(part.column(1).to_pylist(), part.column(2).to_pylist(), a_bytes, b_bytes)
                best, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for keys, times in found.pairs():
                    pairs, back = np.unique(keys & PAIR, return_inverse=True)
                    n = shards.counts(pairs)[back]
                    best += _summed(keys >> 2 * BITS, times * (n == top[keys >> BITS & (1 << BITS) - 1]), part.num_rows)
                    total += _summed(keys >> 2 * BITS, times * n, part.num_rows)
                columns = [found.n_a, found.n_b, found.n_groups, found.n_links, best, total, found.digests()]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], [key, *COLUMNS, "groups_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = written(tokens_read.mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{c} long' for c in COLUMNS)}, groups_sha256 string"), "aligned", BATCH)
    release(tokens)
    return out
