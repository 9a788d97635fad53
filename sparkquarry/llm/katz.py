"""Katz backoff language model of order 2 over words, with Good-Turing discounts and exactly normalised backoff weights.

    P(b | a) = d(c(a b)) c(a b) / c(a)   if a b was seen,      alpha(a) P(b)   if only a was,      P(b)   otherwise
    P(b)     = what a discounted relative frequency gives if b was seen, else the mass that the discounts leave
    alpha(a) = (1 - sum over seen b of P(b | a)) / (1 - sum over seen b of P(b))

A text is its words and one end; the context of its first word is a start mark. d is the Good-Turing discount for
counts up to CUT; larger counts lose FIXED, so that every context keeps some mass. All unknown words are one event.

No table holds texts, and no step holds more than a bucket of pairs:
  1. Counts of all words, and of all pairs within the HEAD words. Words with high counts make a table of FREQUENT entries
     at most, in order of their counts, which is broadcast. Which words are the head changes the work and no result: they
     come from SPREAD texts that a hash picks from the whole table, so a pair that is a thousandth of all pairs lies within.
  2. Pairs go to buckets by their context. A context with more pairs than fit is dealt to as many buckets as it needs by
     its next word. A bucket counts the training texts' pairs and sends every token's count back to its chunk of texts, and
     what backoff needs of its contexts: the discounts are known only when all buckets have counted.
  3. Each chunk adds up its texts. Tokens that back off from a frequent context take its alpha from a broadcast table; those
     of rare contexts or rare words (which hold few tokens a key) meet alpha and P by joins.
The number of buckets follows the number of tokens. Columns of numbers travel as byte planes under zstd.

Null texts count as empty; an empty text is one end. Each row has a score of its own, whatever keys repeat. Without
training texts every token has the mass of unknown words, which is then 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import remainder
from .storage import release, written

CUT = 5
FIXED = 0.01
HEAD = 1024
SPREAD = 5000
FREQUENT = 1 << 19
#: Pairs of a bucket, and pairs that a task packs at a time.
BUCKET = 800_000
CHUNK = 400_000
END = 2
#: A word's code is this flag and its place in the frequent table, or else its hash without the last bit.
FLAG = np.uint64(1 << 63)
#: Texts of a chunk, at most.
DOCS = 1 << 20
NONE = np.iinfo(np.uint32).max
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between runs of ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; those below 3 are END's and the like."""
    return np.maximum(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.uint64(3))


def discounts(n: list[int]) -> np.ndarray:
    """d(1) to d(CUT) from the numbers n[r] of types seen r times, r up to CUT + 1; where Good-Turing fails, half a count."""
    out = np.ones(CUT + 1)
    rest = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts above 0 after discounting."""
    return np.where(c > CUT, c - FIXED, d[np.minimum(c, CUT).astype(int)] * c)


def planes(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers as compressed byte planes."""
    head = np.array([len(columns), *(x for c in columns for x in (len(c), c.itemsize))], "<u4").tobytes()
    data = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return head + zstandard.compress(data, 1)


def unplanes(blob: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(blob[:4], "<u4")[0])
    sizes = np.frombuffer(blob[4 : 4 + 8 * count], "<u4").reshape(count, 2).astype(int)
    data, at, out = np.frombuffer(zstandard.decompress(blob[4 + 8 * count :]), np.uint8), 0, []
    for n, width in sizes:
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).reshape(-1).view(f"<u{width}"))
        at += n * width
    return out


def steps(slots: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, and back by cumsum."""
    return np.diff(slots, prepend=0).astype("<u4")


@dataclass
class Unigrams:
    """What all tasks need of the word counts."""

    hashes: np.ndarray  # of frequent words, sorted
    ranks: np.ndarray  # their places in counts
    counts: np.ndarray  # in descending order
    head: dict[bytes, int]  # place of a head word in the square; 0 is the start mark and 1 the end
    square_of: np.ndarray  # by rank, and last for the start mark: place in the square or -1
    total: int
    distinct: int
    texts: int
    unknown: float
    scale: float
    cut: np.ndarray
    buckets: int

    def probability(self, c: np.ndarray) -> np.ndarray:
        """P(b) of words seen c times."""
        c = np.asarray(c, float)
        return np.where(c > 0, self.scale * kept(np.maximum(c, 1), self.cut), self.unknown)

    def codes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return h >> np.uint64(1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, FLAG | self.ranks[at].astype(np.uint64), h >> np.uint64(1))

    def contexts(self) -> np.ndarray:
        """Counts of frequent words as contexts, and last the start mark's."""
        return np.append(self.counts, self.texts)

    def fan(self) -> np.ndarray:
        """Buckets of each frequent context."""
        return np.minimum(8 * self.contexts() // BUCKET + 1, self.buckets)


class Coder(dict):
    """Code by word; forgets all when it has grown large."""

    def __init__(self, u: Unigrams) -> None:
        self.u, self.end = u, u.codes(np.array([END], np.uint64))[0]

    def text(self, text: str | None) -> np.ndarray:
        found = words_of(text)
        new = [w for w in set(found) if w not in self]
        if new:
            if len(self) > 200_000:
                self.clear()
                new = list(set(found))
            self.update(zip(new, self.u.codes(hashed(new)).tolist(), strict=True))
        out = np.empty(len(found) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        out[-1] = self.end
        return out


def _head(docs: DataFrame) -> dict[bytes, int]:
    rows = docs.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                seen.update(words_of(t))
        top = seen.most_common(HEAD)
        yield pd.DataFrame({"w": [w for w, _ in top], "n": [n for _, n in top]})

    some = docs.where(F.pmod(F.xxhash64("k", "t"), F.lit(max(1, rows // SPREAD))) == 0).select("t").mapInPandas(run, "w binary, n long")
    found = some.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(max(0, HEAD - 2)).collect()
    return {bytes(r["w"]): i + 2 for i, r in enumerate(found)}


def _counts(docs: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """(kind, key, n): 0 and a word's hash, or 1 and a pair of places in the head; over training texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        texts, side = 0, len(head) + 2
        square = np.zeros(side * side, np.int64)
        place = head.get

        def out() -> pd.DataFrame:
            return pd.DataFrame({"kind": 0, "key": hashed(list(seen)).astype(np.int64), "n": list(seen.values())})

        for pdf in batches:
            held, size = [], 0
            for t in pdf["t"]:
                words = words_of(t)
                seen.update(words)
                texts += 1
                held.append(0)
                held += [place(w, -1) for w in words]
                held.append(1)
                if len(held) > 200_000:
                    _within(held, square, side)
                    held = []
            _within(held, square, side)
            if len(seen) > 300_000:
                yield out()
                seen.clear()
        yield out()
        yield pd.DataFrame({"kind": [0], "key": [END], "n": [texts]})
        at = np.flatnonzero(square)
        yield pd.DataFrame({"kind": 1, "key": at, "n": square[at]})

    return docs.where("train").select("t").mapInPandas(run, "kind int, key long, n long").where("n > 0").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _within(held: list[int], square: np.ndarray, side: int) -> None:
    if held:
        at = np.array(held)
        both = (at[:-1] >= 0) & (at[1:] >= 0) & (at[:-1] != 1)
        square += np.bincount(at[:-1][both] * side + at[1:][both], minlength=side * side)


def _unigrams(counts: DataFrame, head: dict[bytes, int]) -> Unigrams:
    words = counts.where("kind = 0")
    row = words.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(F.when(F.col("n") > CUT, F.col("n") - FIXED)).alias("large"), F.sum(F.when(F.col("key") == END, F.col("n"))).alias("texts"), *[F.sum(F.when(F.col("n") == r, 1)).alias(f"n{r}") for r in range(1, CUT + 2)]).first()
    n = [0] + [row[f"n{r}"] or 0 for r in range(1, CUT + 2)]
    total, cut = row["total"] or 0, discounts(n)
    mass = (row["large"] or 0.0) + sum(cut[r] * r * n[r] for r in range(1, CUT + 1))
    unknown = max(1 - mass / total, 1 / (total + 1)) if total else 1.0
    # The least count that leaves FREQUENT words or fewer, from the numbers of words above powers of two.
    powers = [1 << i for i in range(48)]
    above = words.agg(*[F.sum(F.when(F.col("n") >= s, 1)).alias(f"s{s}") for s in powers]).first()
    least = next(s for s in powers if (above[f"s{s}"] or 0) <= FREQUENT)
    table = words.where((F.col("n") >= least) | (F.col("key") == END)).select("key", "n").toPandas()
    h, c = table["key"].to_numpy(np.int64).astype(np.uint64), table["n"].to_numpy(np.int64)
    down = np.lexsort((h, -c))
    h, c = h[down], c[down]
    order = np.argsort(h)
    square_of = np.full(len(c) + 1, -1)
    u = Unigrams(h[order], order, c, head, square_of, total, row["distinct"] or 0, row["texts"] or 0, unknown, (1 - unknown) / mass if mass else 0.0, cut, max(1, -(-total // BUCKET)))
    square_of[-1] = 0
    if len(c):
        code = u.codes(np.append(np.uint64(END), hashed(list(head))))
        known = code >= FLAG  # head words outside the table go the usual way
        square_of[(code[known] ^ FLAG).astype(np.int64)] = np.append(1, list(head.values())).astype(int)[known]
    return u


def _packed(docs: DataFrame, sent, square) -> DataFrame:
    """(bucket, chunk, keys, blob): packed pairs; bucket < 0 for what a chunk knows of its own texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u: Unigrams = sent.value
        table: np.ndarray = square.value
        side = len(u.head) + 2
        contexts, fan = u.contexts(), u.fan()
        logs = np.log10(np.append(u.counts, 0) + 1.0)
        shares = np.log10(np.maximum(contexts, 1.0))
        start = FLAG | np.uint64(len(u.counts))
        coder, number = Coder(u), TaskContext.get().partitionId() << 20

        def out(held: list[np.ndarray], train: list[bool], keys: list) -> pd.DataFrame:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            b = np.concatenate(held)
            text = np.repeat(np.arange(len(held)), sizes)
            first = np.cumsum(sizes) - sizes
            a = np.roll(b, 1)
            a[first] = start
            a_known, b_known = a >= FLAG, b >= FLAG
            a_at, b_at = np.where(a_known, a ^ FLAG, 0).astype(np.int64), np.where(b_known, b ^ FLAG, len(u.counts)).astype(np.int64)
            total = lambda x: np.bincount(text, weights=x, minlength=len(held))
            base, known = total(logs[b_at] * b_known), total(b_known)
            score = total(-shares[a_at] * a_known)
            # Pairs within the head are counted already.
            one, two = np.where(a_known, u.square_of[a_at], -1), np.where(b_known, u.square_of[b_at], -1)
            local = (one >= 0) & (two >= 0)
            where = np.flatnonzero(local)
            c = table[one[where] * side + two[where]]
            high, lost = c > CUT, c == 0
            score += np.bincount(text[where[high]], weights=np.log10(c[high] - FIXED), minlength=len(held))
            low, gone = where[~high & ~lost], where[lost]
            none = np.zeros(0, "<u4")
            own = planes(sizes.astype("<u4"), np.array(train, np.uint8), known.astype("<u4"), base.view("<u8"), score.view("<u8"))
            parts = planes(steps(text[low]), c[~high & ~lost].astype("<u4"), none, none, steps(text[gone]), a_at[gone].astype("<u4"), b_at[gone].astype("<u4"))
            rows = [(-1 - number, number, keys, own), (-1 - number, number, None, parts)]
            rest = np.flatnonzero(~local)
            a, b, text, a_at, a_known = a[rest], b[rest], text[rest], a_at[rest], a_known[rest]
            bucket = ((a * _GOLD >> np.uint64(32)) + (b * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.where(a_known, fan[a_at], 1).astype(np.uint64)) % np.uint64(u.buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            mine = (text * 2 + np.array(train, np.int64)[text]) if len(text) else text
            for part in np.split(order, cuts) if len(order) else []:
                rows.append((int(bucket[part[0]]), number, None, planes(steps(mine[part]), a[part], b[part])))
            return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "blob"])

        held: list[np.ndarray] = []
        train: list[bool] = []
        keys: list = []
        size = 0
        for pdf in batches:
            for k, t, y in zip(pdf["k"].astype("Int64").tolist(), pdf["t"], pdf["train"], strict=True):
                held.append(coder.text(t))
                train.append(bool(y))
                keys.append(None if k is pd.NA else k)
                size += len(held[-1])
                if size >= CHUNK or len(held) >= DOCS - 1:
                    yield out(held, train, keys)
                    held, train, keys, size = [], [], [], 0
                    number += 1
        if held:
            yield out(held, train, keys)

    return docs.mapInPandas(run, "bucket long, chunk long, keys array<long>, blob binary")


#: kind 0: blob for a chunk i, with keys if it is what the chunk knows; 1: a token of text i backs off from the rare context j;
#: 2: sums of the context j; 3: the rare word b follows the context j; 4: b pairs were seen j times; 5: a token of text i is the rare word b
FOUND = "kind int, i long, j long, b long, x double, y double, m1 long, m2 long, m3 long, m4 long, m5 long, keys array<long>, blob binary"
COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


def _frame(kind: int, n: int, **columns) -> pd.DataFrame:
    out = pd.DataFrame({c: columns.get(c, np.zeros(n, float if c in ("x", "y") else np.int64)) for c in COLUMNS if c not in ("kind", "keys", "blob")})
    out.insert(0, "kind", np.full(n, kind, np.int32))
    return out.assign(keys=columns.get("keys", [None] * n), blob=columns.get("blob", [None] * n))


def _bucket(pdf: pd.DataFrame, u: Unigrams) -> Iterator[pd.DataFrame]:
    """Everything that one bucket tells; see the module's text."""
    parts = [unplanes(x) for x in pdf["blob"]]
    chunks = pdf["chunk"].to_numpy(np.int64)
    sizes = np.fromiter((len(p[0]) for p in parts), np.int64, len(parts))
    mine = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts])
    a, b = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    del parts
    text, train = mine >> 1, (mine & 1).astype(bool)
    mixed = a * _GOLD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x94D049BB133111EB)
    order = np.argsort(mixed)
    new = np.concatenate(([True], np.diff(mixed[order]) != 0))
    pair = np.empty(len(a), np.int64)
    pair[order] = np.cumsum(new) - 1
    first = order[new]
    del mixed, order, new
    c = np.bincount(pair, weights=train, minlength=len(first)).astype(np.int64)
    name, context = np.unique(a[first], return_inverse=True)
    frequent = name >= FLAG
    at = np.where(frequent, name ^ FLAG, 0).astype(np.int64)
    total = np.where(frequent, u.contexts()[at], np.bincount(context, weights=c, minlength=len(name)).astype(np.int64))
    b_of = b[first]
    b_known = b_of >= FLAG
    b_at = np.where(b_known, b_of ^ FLAG, 0).astype(np.int64)
    count, ctx = c[pair], context[pair]
    seen, rare = count > 0, ~frequent[ctx]
    lost = ~seen
    starts = total[ctx] > 0
    edges = np.cumsum(sizes) - sizes
    blobs = []
    a32, b32 = np.where(frequent[ctx] & starts, at[ctx], NONE).astype("<u4"), np.where(b_known[pair], b_at[pair], NONE).astype("<u4")
    for i, n in zip(edges, sizes, strict=True):
        s = slice(i, i + n)
        t, f, r = text[s], seen[s], rare[s]
        gone = lost[s] & ((a32[s] != NONE) | (b32[s] != NONE))
        blobs.append(planes(steps(t[f]), count[s][f].astype("<u4"), steps(t[r]), (total[ctx[s][r]] * 2 + f[r]).astype("<u4"), steps(t[gone]), a32[s][gone], b32[s][gone]))
    yield _frame(0, len(blobs), i=chunks, blob=blobs)
    who = (np.repeat(chunks, sizes) << 20) | text
    far = lost & rare & starts
    signed = name.astype(np.int64)
    label = np.where(frequent, -1 - at, signed)
    yield _frame(1, int(far.sum()), i=who[far], j=label[ctx[far]])
    strange = lost & ~b_known[pair]
    yield _frame(5, int(strange.sum()), i=who[strange], b=b_of[pair[strange]].astype(np.int64))
    # Tokens may back off from wide contexts in other buckets, and from head words where no bucket sees them.
    need = frequent & ((u.fan()[at] > 1) | (u.square_of[at] >= 0))
    need[ctx[lost]] = True
    need &= total > 0
    took = need[context] & (c > 0)
    if need.any():
        def summed(mask, weights=None):
            return np.bincount(context[mask], weights=weights, minlength=len(name))[need]

        small = {f"m{k}": summed(took & (c == k)) for k in range(1, CUT + 1)}
        big, known = took & (c > CUT), took & b_known
        yield _frame(2, int(need.sum()), j=label[need], b=total[need], x=summed(big, c[big] - FIXED), y=summed(known, u.probability(u.counts[b_at[known]]) if len(u.counts) else None), **small)
        tail = took & ~b_known
        yield _frame(3, int(tail.sum()), j=label[context[tail]], b=b_of[tail].astype(np.int64))
    yield _frame(4, CUT + 1, j=np.arange(1, CUT + 2), b=np.array([(c == k).sum() for k in range(1, CUT + 2)]))


def scores(docs: DataFrame, parts: int = 7, held_out: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; the key is an integer.

    base_score is that of word counts with one added, as the sum over tokens of log10((c + 1) / (N + V + 1)).
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"), (remainder(docs[key], parts) != held_out).alias("train"))
    head = _head(rows)
    counts = written(_counts(rows, head), "word-counts", 2000)
    u = _unigrams(counts, head)
    side = len(head) + 2
    square = np.zeros(side * side, np.int64)
    pairs = counts.where("kind = 1").select("key", "n").toPandas()
    square[pairs["key"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.int64)
    usable = np.zeros(side, bool)
    usable[u.square_of[u.square_of >= 0]] = True
    square *= np.outer(usable, usable).reshape(-1)
    sent, table = spark.sparkContext.broadcast(u), spark.sparkContext.broadcast(square)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] >= 0:
            return pd.concat([x for x in _bucket(pdf, sent.value) if len(x)], ignore_index=True)
        return _frame(0, len(pdf), i=pdf["chunk"].to_numpy(np.int64), keys=pdf["keys"].tolist(), blob=pdf["blob"].tolist())

    found = written(_packed(rows, sent, table).groupBy("bucket").applyInPandas(run, FOUND), "pair-counts", 2000)
    n = [0] * (CUT + 2)
    for r in found.where("kind = 4").groupBy("j").agg(F.sum("b").alias("b")).collect():
        n[r["j"]] = int(r["b"])
    for r in range(1, CUT + 2):
        n[r] += int((square == r).sum())
    d = discounts(n)
    # alpha of each context that a token backs off from
    rare = counts.where("kind = 0").select(F.shiftrightunsigned("key", 1).alias("b"), F.col("n").alias("c")).groupBy("b").agg(F.max("c").alias("c"))
    chance = F.when(F.col("c") > CUT, (F.col("c") - FIXED) * u.scale)
    for r in range(1, CUT + 1):
        chance = chance.when(F.col("c") == r, float(u.cut[r] * r * u.scale))
    rare = rare.select("b", chance.alias("p"))
    tail = found.where("kind = 3").select("j", "b").join(rare, "b").groupBy("j").agg(F.sum("p").alias("y"))
    contexts = found.where("kind = 2").select("j", "b", "x", "y", *[f"m{r}" for r in range(1, CUT + 1)]).unionByName(_head_contexts(spark, u, square))
    mass = contexts.select("j", "b", (F.col("x") + sum(F.col(f"m{r}") * float(d[r] * r) for r in range(1, CUT + 1))).alias("x"), "y").unionAll(tail.select("j", F.lit(None).cast("long"), F.lit(0.0), "y"))
    alpha = mass.groupBy("j").agg(F.max("b").alias("b"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    alpha = written(alpha.select("j", F.log10(F.greatest(1 - F.col("x") / F.col("b"), F.lit(1e-12)) / F.greatest(1 - F.col("y"), F.lit(1e-12))).alias("alpha")), "alpha")
    known = alpha.where("j < 0").toPandas()  # FREQUENT + 1 rows at most
    backoff = np.zeros(len(u.counts) + 1)
    backoff[-1 - known["j"].to_numpy(np.int64)] = known["alpha"].to_numpy(float)
    last = spark.sparkContext.broadcast((d, backoff))

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        u, (d, backoff) = sent.value, last.value
        i, own = int(pdf["i"].iloc[0]), next(r for r in pdf.itertuples(index=False) if r.keys is not None)
        sizes, train, known, base, score = unplanes(own.blob)
        known, base, score = known.astype(np.int64), base.view("<f8").copy(), score.view("<f8").copy()
        shares, chances = np.log10(np.maximum(u.contexts(), 1.0)), np.log10(u.probability(u.counts))
        total = lambda t, w: np.bincount(t, weights=w, minlength=len(sizes))
        for r in pdf.itertuples(index=False):
            if r.keys is not None:
                continue
            t, c, t_rare, rare, t_lost, a, b = unplanes(r.blob)
            t, t_rare, t_lost = (np.cumsum(x, dtype=np.int64) for x in (t, t_rare, t_lost))
            score += total(t, np.log10(kept(c.astype(np.int64), d)))
            n = rare >> 1
            base += total(t_rare, np.log10(n + 1.0))
            known += np.bincount(t_rare[n > 0], minlength=len(sizes))
            score -= total(t_rare, np.where(rare & 1, np.log10(np.maximum(n, 1)), 0.0))
            f, w = a != NONE, b != NONE
            score += total(t_lost[f], (backoff + shares)[a[f]])
            score += total(t_lost[w], chances[b[w]])
        keys = pd.array([None if k is None or k != k else int(k) for k in own.keys], "Int64")
        return pd.DataFrame({"i": (i << 20) | np.arange(len(sizes)), "x": score, "base": base, "known": known, key: keys, "n_tokens": sizes.astype(np.int64), "held_out": train == 0})

    texts = found.where("kind = 0").select("i", "keys", "blob").groupBy("i").applyInPandas(gathered, f"i long, x double, base double, known long, `{key}` long, n_tokens long, held_out boolean")
    # What tokens of rare contexts and rare words add; the rows of a key are few, since the key is rare.
    more = found.where("kind = 1").select("i", "j").join(alpha, "j").select("i", F.col("alpha").alias("x"))
    word = F.coalesce(F.log10("p"), F.lit(float(np.log10(u.unknown))))
    more = more.unionAll(found.where("kind = 5").select("i", "b").join(rare, "b", "left").select("i", word.alias("x")))
    more = more.groupBy("i").agg(F.sum("x").alias("more"))
    norm = float(np.log10(u.total + u.distinct + 1))
    out = texts.join(more, "i", "left")
    return out.select(key, "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(u.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("score"))


def _head_contexts(spark, u: Unigrams, square: np.ndarray) -> DataFrame:
    """What pairs within the head add to the sums of their contexts."""
    schema = "j long, b long, x double, y double, m1 long, m2 long, m3 long, m4 long, m5 long"
    side = len(u.head) + 2
    table, contexts = square.reshape(side, side), u.contexts()
    p = np.zeros(side)
    ranks = np.flatnonzero(u.square_of >= 0)
    words = ranks[ranks < len(u.counts)]
    p[u.square_of[words]] = u.probability(u.counts[words])
    rows = []
    for rank in ranks[contexts[ranks] > 0]:
        c = table[u.square_of[rank]]
        if c.any():
            rows.append((int(-1 - rank), int(contexts[rank]), float((c[c > CUT] - FIXED).sum()), float(p[c > 0].sum()), *(int((c == r).sum()) for r in range(1, CUT + 1))))
    return spark.createDataFrame(rows, schema)
