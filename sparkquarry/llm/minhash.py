"""Near duplicates by a chosen-path set similarity join over minwise tokens, confirmed on full shingle sets.

A document's set has its distinct five-word shingles. Equal sets are one text from here on. TREES independent trees are
grown. A root takes one minwise coordinate and sends each text to the child named by its token there. A node with more
than SMALL texts branches: in BRANCHES ways it takes a further coordinate, which the path to it (and so the tree) chooses
among those that no root takes, and sends each text to the child named by its token. Two texts of similarity s share a
child of a root with probability s, and 2 s children of a node that branches on average; DEPTH levels lose few pairs.

Only components are asked for, so links are confirmed in two rounds:
  1. Small nodes are compared in full by sketches, and each sends on a spanning forest of its pairs, the likest first.
     In a large root every text is held against one centre: the text that agrees most with the tokens most common there.
     So a group of copies is joined by as many comparisons as it has texts, however large.
  2. Nodes whose texts are in one component by now are done, at any depth. The others branch while they are large; then
     all their pairs of different components are compared by sketches, and those that pass are confirmed. Nodes that are
     still large at the last level are compared in blocks, the texts outside the main component against all.
So every pair of different components that shares a node which doesn't branch is compared. A sketch has SKETCH minwise
tokens; a pair at the threshold agrees in 3/4 of them, and passes from AGREE on, which it misses with a probability below
one in 10,000. Pairs of the second round must also pass by the least hash of each of BINS ranges of hashes, a sample of
the two sets without replacement, down to SIGMAS deviations below the threshold.

A row of a node carries its text's tokens, so no step joins nodes with texts. Which nodes are large is told by lists of
their paths: a node is large above SMALL texts and above 1 / LARGE_NODES of all rows, so a list has LARGE_NODES paths a
level at most (times BRANCHES a level, if no branch ever parts two texts). A task takes the texts of a node that isn't large.

A confirmation counts common shingles of two whole texts. Texts without words have an empty set and no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import BITS, Packed, bitmap, lookup, release, written

WORDS = 5
TREES = 10
BRANCHES = 2
#: Levels of a tree, the root's included.
DEPTH = 7
SMALL = 250
LARGE_NODES = 50_000
#: Texts that a large node's common tokens are taken from, about.
SAMPLE = 24
BLOCK = 128
SKETCH = 64
#: Sketch tokens that must agree.
AGREE = 34
BINS = 512
SIGMAS = 4.0

_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_STEP = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 62, WORDS)]
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hash by word; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: Words) -> np.ndarray:
    """Sorted hashes of the set of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = len(h)
    if not n:
        return h
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=n)], np.uint64)
    out = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        out += _mixed(h[k : n - WORDS + 1 + k] * _STEP[k] + np.uint64(k))
    return np.unique(out)


def minwise(s: np.ndarray) -> np.ndarray:
    """SKETCH minwise tokens of a set that isn't empty."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048]
        for k in range(SKETCH):
            least[k] = min(least[k], (part * _MULTIPLY[k] + _ADD[k]).min())
    return _mixed(least)


def binned(s: np.ndarray) -> np.ndarray:
    """A byte of the least hash in each of BINS ranges of hashes; 0 where the set has none."""
    edges = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    full = np.diff(edges, append=len(s)) > 0
    out = np.zeros(BINS, np.uint8)
    out[full] = s[edges[full]] % np.uint64(255) + np.uint64(1)
    return out


def _signatures(docs: DataFrame) -> DataFrame:
    """(k, n, same, roots, tokens, bins): size, a hash of the set, the text's node in each root, SKETCH tokens of 16 bits, bytes of bins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                s = shingles(t, words)
                if len(s):
                    m = minwise(s)
                    roots = _mixed(m[:TREES] * (np.arange(TREES, dtype=np.uint64) * np.uint64(2) + np.uint64(3)))
                    out.append((k, len(s), xxhash.xxh3_128_digest(s.tobytes()), roots.astype("<i8").tobytes(), (m & np.uint64(0xFFFF)).astype("<u2").tobytes(), binned(s).tobytes()))
                else:
                    out.append((k, 0, None, None, None, None))
            yield pd.DataFrame(out, columns=["k", "n", "same", "roots", "tokens", "bins"])

    return docs.mapInPandas(run, "k long, n long, same binary, roots binary, tokens binary, bins binary")


def _texts(signed: DataFrame) -> DataFrame:
    """(same, w, k, id, n, roots, tokens, bins): one row for each set; a hot set is grouped before it is shuffled.

    id is the smallest key k of the set's documents; where documents that repeat a key have several sets, all but one
    of those take a negative number of their own.
    """
    first = [F.first(c).alias(c) for c in ("n", "roots", "tokens", "bins")]
    sets = signed.where("n > 0 and k is not null").groupBy("same").agg(F.min("k").alias("k"), F.count("*").alias("w"), *first)
    shared = sets.groupBy("k").agg(F.min("same").alias("one"), F.count("*").alias("sets")).where("sets > 1").select(F.col("k").alias("_k"), "one")
    own = F.col("one").isNull() | (F.col("one") == F.col("same"))
    # -2 ** 63 + 62 bits of a hash: far below any key
    other = F.lit(-(1 << 63)).cast("long") + F.shiftrightunsigned(F.xxhash64("same"), 2)
    return sets.join(shared, sets["k"] == shared["_k"], "left").select("same", "w", "k", F.when(own, F.col("k")).otherwise(other).alias("id"), "n", "roots", "tokens", "bins")


def _columns(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Root paths and tokens as matrices."""
    return np.frombuffer(b"".join(pdf["roots"]), "<i8").reshape(-1, TREES), np.frombuffer(b"".join(pdf["tokens"]), "<u2").reshape(-1, SKETCH)


def _matrix(cells, column: str) -> np.ndarray:
    data = b"".join(map(bytes, cells))
    return np.frombuffer(data, "<u2").reshape(-1, SKETCH) if column == "tokens" else np.frombuffer(data, np.uint8).reshape(-1, BINS)


def _place(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of x in a sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _children(path: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Paths of the children that rows go to, BRANCHES each: a matrix. tokens has the rows' tokens."""
    row, out = np.arange(len(path)), []
    for b in range(BRANCHES):
        chosen = _mixed(path.astype(np.uint64) * _GOLD + np.uint64(b))
        at = TREES + (chosen % np.uint64(SKETCH - TREES)).astype(np.int64)
        out.append(_mixed(chosen * _GOLD + tokens[row, at]).astype(np.int64))
    return np.stack(out, axis=1)


def _walk(roots: np.ndarray, tokens: np.ndarray, branch: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, path) of each level that large nodes lead to, the root's first. branch: sorted paths of large nodes by level."""
    row, path = np.repeat(np.arange(len(roots)), TREES), roots.reshape(-1)
    yield row, path
    for large in branch:
        hit = _place(large, path) >= 0
        row, path = row[hit], path[hit]
        path = _children(path, tokens[row]).reshape(-1)
        row = np.repeat(row, BRANCHES)
        yield row, path


def _rows(pdf: pd.DataFrame, row: np.ndarray, path: np.ndarray, columns: list[str]) -> pd.DataFrame:
    out = pdf[columns].iloc[row].reset_index(drop=True)
    out.insert(0, "path", path)
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of the number of tokens in which rows of a and of b agree."""
    if len(a) * len(b) <= 1024:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2, dtype=np.uint8)
    out = np.zeros((len(a), len(b)), np.uint8)
    for i in range(SKETCH):
        out += a[:, i, None] == b[None, :, i]
    return out


def _close(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the bins of pairs of rows, of sets with n and m shingles, allow the threshold."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 14):
        part = slice(at, at + (1 << 14))
        a, b = x[part], y[part]
        seen = ((a | b) != 0).sum(axis=1)
        common = ((a == b) & (a != 0)).sum(axis=1)
        union = (n[part] + m[part]) / 1.75  # of a pair at the threshold
        left = np.clip(1 - (seen - 1) / np.maximum(union - 1, 1), 0.05, 1)
        out[part] = common >= seen * (0.75 - SIGMAS * np.sqrt(0.1875 * left / np.maximum(seen, 1)))
    return out


def _sizes_allow(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= 75 * np.maximum(n, m)


def _tree(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the likest pairs by a matrix of agreements, of those that reach AGREE."""
    m = len(near)
    best, via, inside, out = near[0].astype(np.int16), np.zeros(m, np.int64), np.zeros(m, bool), []
    inside[0] = True
    best[0] = -1
    for _ in range(m - 1):
        j = int(best.argmax())
        if best[j] >= AGREE:
            out.append((int(via[j]), j))
        inside[j] = True
        better = (near[j] > best) & ~inside
        best[better], via[better] = near[j][better], j
        best[j] = -1
    return out


def _by_node(rows: DataFrame, columns: list[str], work) -> DataFrame:
    """Pairs (a, b) that work(path, *columns of one node) gives; a node's rows are together, and a task holds a batch of them.

    columns begin with id; tokens and bins come as matrices.
    """

    def arrays(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [_matrix(pdf[c], c) if c in ("tokens", "bins") else pdf[c].to_numpy(np.int64) for c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(pdf: pd.DataFrame) -> pd.DataFrame:
            path = pdf["path"].to_numpy(np.int64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)]))
            values = arrays(pdf)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if j - i > 1:
                    for x, y in work(path[i], *[v[i:j] for v in values]):
                        a.append(x)
                        b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            now = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            end = int(np.searchsorted(now["path"].to_numpy(np.int64), now["path"].iloc[-1]))  # the last node may go on
            held = now.iloc[end:]
            if end:
                yield out(now.iloc[:end])
        if held is not None:
            yield out(held)

    return rows.repartition("path").sortWithinPartitions("path", "id").select("path", *columns).mapInPandas(run, "a long, b long")


def _paths(texts: DataFrame, branch: list[np.ndarray], columns: list[str]) -> DataFrame:
    """(path, columns) of the level below the last list of branch, for texts (id, n, roots, tokens, c)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            *_, (row, path) = _walk(*_columns(pdf), branch)
            yield _rows(pdf, row, path, columns)

    return texts.mapInPandas(run, ", ".join(f"{c} long" for c in ["path", *columns]))


def _bits(paths: DataFrame) -> np.ndarray:
    return bitmap(paths.select(F.pmod("path", F.lit(BITS)).alias("bit")))


def _marked(bits: np.ndarray, path: np.ndarray) -> np.ndarray:
    at = path % BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _likely(texts: DataFrame, rows: int) -> DataFrame:
    """Pairs of the first round, from texts (id, n, roots, tokens); rows is their number in all roots."""
    texts = texts.drop("bins")
    spark = texts.sparkSession
    limit = max(SMALL, rows // LARGE_NODES)
    sized = written(_paths(texts, [], []).groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), "nodes")
    shared = spark.sparkContext.broadcast(Packed(_bits(sized)))
    large = sized.where(F.col("m") > limit).toPandas().sort_values("path")
    release(sized)
    stars = None
    sent = spark.sparkContext.broadcast(large["path"].to_numpy(np.int64))
    if len(large):
        stars = _centred(texts, large["path"].to_numpy(np.int64), large["m"].to_numpy(np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, path = next(_walk(*_columns(pdf), []))
            keep = _marked(shared.value, path) & (_place(sent.value, path) < 0)
            yield _rows(pdf, row[keep], path[keep], ["id", "n", "tokens"])

    def forest(path, ids, n, tokens):
        if len(ids) > SMALL:  # a node that isn't large for so many texts: against its centre
            agree = (tokens == _common(tokens)).sum(axis=1)
            at = int(agree.argmax())
            good = ((tokens == tokens[at]).sum(axis=1) >= AGREE) & _sizes_allow(n, n[at]) & (ids != ids[at])
            yield np.full(int(good.sum()), ids[at]), ids[good]
            return
        near = _agree(tokens, tokens)
        near[~_sizes_allow(n[:, None], n[None, :])] = 0
        pairs = _tree(near)
        if pairs:
            at = np.array(pairs)
            yield ids[at[:, 0]], ids[at[:, 1]]

    small = _by_node(texts.mapInPandas(run, "path long, id long, n long, tokens binary"), ["id", "n", "tokens"], forest)
    return small if stars is None else small.unionAll(stars)


def _common(tokens: np.ndarray) -> np.ndarray:
    """The most common token of each coordinate."""
    out = np.zeros(SKETCH, np.uint16)
    for i in range(SKETCH):
        value, n = np.unique(tokens[:, i], return_counts=True)
        out[i] = value[n.argmax()]
    return out


def _centred(texts: DataFrame, large: np.ndarray, size: np.ndarray) -> DataFrame:
    """Pairs of the texts of large roots with the centre of each. What reaches the driver has a few rows a large root."""
    sc = texts.sparkSession.sparkContext
    known = sc.broadcast((large, size))

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, m = known.value
        for pdf in batches:
            row, path = next(_walk(*_columns(pdf), []))
            at = _place(paths, path)
            chance = _mixed(path.astype(np.uint64) ^ (pdf["id"].to_numpy(np.int64)[row].astype(np.uint64) * _GOLD)) / 2.0**64
            keep = (at >= 0) & (chance * m[at] < SAMPLE)
            yield _rows(pdf, row[keep], path[keep], ["tokens"])

    common = np.zeros((len(large), SKETCH), np.uint16)
    for path, rows in texts.mapInPandas(sampled, "path long, tokens binary").toPandas().groupby("path"):
        common[_place(large, np.array([path]))[0]] = _common(np.frombuffer(b"".join(rows["tokens"]), "<u2").reshape(-1, SKETCH))
    profile = sc.broadcast(common)

    def closest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, _ = known.value
        for pdf in batches:
            roots, tokens = _columns(pdf)
            row, path = next(_walk(roots, tokens, []))
            at = _place(paths, path)
            row, path, at = row[at >= 0], path[at >= 0], at[at >= 0]
            agree = (tokens[row] == profile.value[at]).sum(axis=1)
            ids = pdf["id"].to_numpy(np.int64)[row]
            order = np.lexsort((ids, -agree, at))
            first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
            yield _rows(pdf, row[first], path[first], ["id", "n", "tokens"]).assign(agree=agree[first].astype(np.int64))

    best = texts.mapInPandas(closest, "path long, id long, n long, tokens binary, agree long").groupBy("path").agg(F.max_by(F.struct("id", "n", "tokens"), F.struct("agree", -F.col("id"))).alias("x")).select("path", "x.*").toPandas().sort_values("path")
    centre = sc.broadcast((best["path"].to_numpy(np.int64), best["id"].to_numpy(np.int64), best["n"].to_numpy(np.int64), np.frombuffer(b"".join(best["tokens"]), "<u2").reshape(-1, SKETCH)))

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, one, n1, t1 = centre.value
        for pdf in batches:
            roots, tokens = _columns(pdf)
            row, path = next(_walk(roots, tokens, []))
            at = _place(paths, path)
            row, at = row[at >= 0], at[at >= 0]
            ids, n = pdf["id"].to_numpy(np.int64)[row], pdf["n"].to_numpy(np.int64)[row]
            good = (ids != one[at]) & _sizes_allow(n, n1[at]) & ((tokens[row] == t1[at]).sum(axis=1) >= AGREE)
            a, b = one[at[good]], ids[good]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return texts.mapInPandas(stars, "a long, b long")


def _across(one: list[np.ndarray], two: list[np.ndarray], own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in different components whose sizes and sketches allow the threshold; both sides are (id, c, n, tokens, bins).

    own: the second side begins with the rows of the first, and a pair of them counts once.
    """
    (ids, c, n, tokens, bins), (ids2, c2, n2, tokens2, bins2) = one, two
    maybe = (c[:, None] != c2[None, :]) & _sizes_allow(n[:, None], n2[None, :])
    if own:
        maybe &= np.arange(len(ids))[:, None] < np.arange(len(ids2))[None, :]
    i, j = np.nonzero(maybe)
    agree = np.zeros(len(i), np.int16)
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        agree[part] = (tokens[i[part]] == tokens2[j[part]]).sum(axis=1)
    i, j = i[agree >= AGREE], j[agree >= AGREE]
    near = _close(bins[i], bins2[j], n[i], n2[j])
    return ids[i[near]], ids2[j[near]]


def _pairs_within(level: int, path: np.int64, node: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components in one node that a task holds; above SMALL texts it branches here."""
    _, c, _, tokens, _ = node
    todo = [(level, path, np.arange(len(c)))]
    while todo:
        depth, path, rows = todo.pop()
        part = c[rows]
        if len(rows) < 2 or (part == part[0]).all():
            continue
        if len(rows) > SMALL and depth + 1 < DEPTH:
            children = _children(np.full(len(rows), path), tokens[rows])
            for b in range(BRANCHES):
                order = np.argsort(children[:, b], kind="stable")
                cuts = np.flatnonzero(np.diff(children[order, b])) + 1
                todo += [(depth + 1, children[g[0], b], rows[g]) for g in np.split(order, cuts)]
            continue
        for at in range(0, len(rows), BLOCK):
            one, two = rows[at : at + BLOCK], rows[at:]
            yield _across([v[one] for v in node], [v[two] for v in node], own=True)


#: What a text of a node has in the second round.
SIDE = ["id", "c", "n", "tokens", "bins"]


def _open(texts: DataFrame, rows: int) -> list[DataFrame]:
    """Tables of pairs (a, b) of different components that share a node which doesn't branch, from texts with c."""
    spark = texts.sparkSession
    limit = max(SMALL, rows // LARGE_NODES)
    branch: list[np.ndarray] = []
    done: list[np.ndarray] = []
    mixed_nodes, last = [], None
    for depth in range(DEPTH):
        parts = _paths(texts, branch, ["c"]).groupBy("path", "c").agg(F.count("*").alias("w"))
        nodes = parts.groupBy("path").agg(F.sum("w").alias("m"), F.count("*").alias("parts"), F.max(F.struct("w", "c")).alias("most"))
        nodes = written(nodes.where((F.col("parts") > 1) | (F.col("m") > limit)).select("path", "m", "parts", "most.c", (F.col("m") - F.col("most.w")).alias("rest")), f"nodes{depth}")
        mixed_nodes.append(nodes)
        large = nodes.where(F.col("m") > limit).toPandas().sort_values("path")
        mixed = large["parts"].to_numpy() > 1
        done.append(large["path"].to_numpy(np.int64)[~mixed])
        if not mixed.any():
            break
        last = large[mixed]
        branch.append(last["path"].to_numpy(np.int64))
    every = mixed_nodes[0]
    for nodes in mixed_nodes[1:]:
        every = every.unionAll(nodes)
    bits = _bits(every.where("parts > 1"))
    release(*mixed_nodes)
    at_end = len(branch) == DEPTH  # large nodes of the last level don't branch
    sent = spark.sparkContext.broadcast((Packed(bits), branch, done))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, branch, done = sent.value
        for pdf in batches:
            for depth, (row, path) in enumerate(_walk(*_columns(pdf), branch[: DEPTH - 1])):
                keep = _marked(bits, path) & (_place(done[depth], path) < 0)
                if depth < len(branch):
                    keep &= _place(branch[depth], path) < 0
                yield _rows(pdf, row[keep], path[keep], SIDE).assign(level=depth)

    schema = "path long, id long, c long, n long, tokens binary, bins binary"
    cold = _by_node(texts.mapInPandas(run, f"{schema}, level long"), [*SIDE, "level"], lambda path, *node: _pairs_within(int(node[-1][0]), path, list(node[:-1])))
    if not at_end:
        return [cold]
    left = spark.sparkContext.broadcast((last["path"].to_numpy(np.int64), last["c"].to_numpy(np.int64), last["m"].to_numpy(np.int64), last["rest"].to_numpy(np.int64)))

    def remaining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, main, m, rest = left.value
        for pdf in batches:
            *_, (row, path) = _walk(*_columns(pdf), sent.value[1][: DEPTH - 1])
            at = _place(paths, path)
            row, path, at = row[at >= 0], path[at >= 0], at[at >= 0]
            out = _rows(pdf, row, path, SIDE)
            yield out.assign(outside=out["c"].to_numpy(np.int64) != main[at], size=m[at], rest=rest[at])

    deep = texts.mapInPandas(remaining, f"{schema}, outside boolean, size long, rest long")
    return [cold, _blocks(deep)]


def _blocks(large: DataFrame) -> DataFrame:
    """Pairs within large nodes: texts outside a node's main component against all of its texts, in blocks."""
    block = lambda n: F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / BLOCK)).alias("block")
    packed = F.collect_list(F.struct(*SIDE))
    every = large.groupBy("path", block("size")).agg(packed.alias("two"))
    rest = large.where("outside").groupBy("path", block("rest")).agg(packed.alias("one"))
    both = rest.select("path", "one").join(every.select("path", "two"), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts(cell) -> list[np.ndarray]:
            return [_matrix([r[x] for r in cell], x) if x in ("tokens", "bins") else np.array([r[x] for r in cell], np.int64) for x in SIDE]

        for pdf in batches:
            for one, two in zip(pdf["one"], pdf["two"], strict=True):
                a, b = _across(parts(one), parts(two))
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return both.mapInPandas(run, "a long, b long")


#: Pairs of one text that a task takes on, about, and pairs of whole texts that Python holds at a time.
TOGETHER = 256
CONFIRM = 256


def _copies(pairs: str):
    return F.ceil(F.col(pairs) / TOGETHER)


def _needed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that pairs name and a few more, once each: a bitmap of fixed size keeps the others out of the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(Packed(bitmap(pairs.select(F.explode(F.array("a", "b")).alias("k")).select(F.pmod("k", F.lit(BITS)).alias("bit")))))

    def there(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in batches:
            yield pd.Series(_marked(bits.value, k.to_numpy(np.int64)))

    return docs.where(F.pandas_udf(there, "boolean")("k")).groupBy(F.col("k").alias("_k")).agg(F.first("t").alias("t"))


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of written (a, b), those with 100 * common >= 75 * all, from whole texts (k, t).

    A text that is in many pairs is copied, so that no task gets all of them.
    """
    texts = _needed(docs, pairs)
    many = written(pairs.groupBy("a").agg(F.count("*").alias("w")), "leaders")
    salts = lookup(pairs, many, "a", "w", pairs.count(), "b").select("a", "b", F.pmod(F.xxhash64("b"), _copies("w")).alias("salt"))
    one = salts.join(texts, salts["b"] == texts["_k"]).select("a", "b", "salt", F.col("t").alias("tb"))
    copied = many.join(texts, many["a"] == texts["_k"]).select(F.col("a").alias("_a"), F.explode(F.sequence(F.lit(0), _copies("w") - 1)).alias("_s"), F.col("t").alias("ta"))
    both = one.join(copied, (one["a"] == copied["_a"]) & (one["salt"] == copied["_s"])).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, last, sa = Words(), None, None
        for pdf in batches:
            keep = []
            for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"], strict=True):
                if a != last:
                    last, sa = a, shingles(ta, words)
                sb = shingles(tb, words)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * common >= 75 * (len(sa) + len(sb) - common))
            yield pdf.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _sources(rows: DataFrame, twice: DataFrame, texts: DataFrame) -> DataFrame:
    """(k, t) of rows, k the id of the text's set. Only keys that have several sets need their sets made again."""
    if not twice.head(1):
        return rows.where("k is not null")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            yield pd.DataFrame({"_same": [xxhash.xxh3_128_digest(shingles(t, words).tobytes()) for t in pdf["t"]], "t": pdf["t"]})

    several = rows.join(twice, rows["k"] == twice["_k"], "left_semi").mapInPandas(digests, "_same binary, t string")
    several = several.join(texts.select("same", F.col("id").alias("k")), F.col("_same") == F.col("same")).select("k", "t")
    return written(rows.join(twice, rows["k"] == twice["_k"], "left_anti").where("k is not null").unionAll(several), "sources")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row; the key is an integer and names a document.

    Rows that repeat a key are one document, and link all their sets. Null keys have no links.
    """
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))
    signatures = written(_signatures(rows), "signatures", 2000)
    texts = written(_texts(signatures), "texts")
    signed = written(signatures.select("k", "n", "same"), "sets")
    release(signatures)
    spread = texts.count() * TREES
    twice = written(signed.where("n > 0 and k is not null").groupBy("k").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo < hi").select(F.col("k").alias("_k")), "twice")
    homes = written(texts.select("same", "w", "k", "id"), "homes")
    sources = _sources(rows, twice, homes)
    tokens = texts.select("id", "n", "roots", "tokens", "bins")
    pairs = written(_likely(tokens, spread).distinct(), "pairs", 4000)
    links = written(_confirmed(pairs, sources).distinct(), "links", CONFIRM)
    release(pairs)
    # Sets of one key
    several = signed.join(twice, signed["k"] == twice["_k"]).where("n > 0").select("k", "same").distinct().join(homes.select("id", "same"), "same")
    least = several.groupBy("k").agg(F.min("id").alias("a"))
    links = written(links.unionAll(several.join(least, "k").select("a", F.col("id").alias("b")).where("a <> b")), "links")
    tagged = written(tokens.join(components(links).withColumnRenamed("node", "id"), "id", "left").select(*tokens.columns, F.coalesce("component", "id").alias("c")), "tagged")
    release(texts)
    found, *more = _open(tagged, spread)
    for m in more:
        found = found.unionAll(m)
    pairs = written(found.distinct(), "pairs", 4000)
    release(tagged)
    if pairs.head(1):
        links = links.unionAll(written(_confirmed(pairs, sources).distinct(), "links", CONFIRM))
    release(pairs)
    joined = components(links)
    # A component's name is the smallest key of its documents; copies of a set follow the text that stands for it.
    named = homes.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    named = named.select("same", "w", "k", "c")
    if twice.head(1):
        least = written(named.where("c < 0").groupBy("c").agg(F.min("k").alias("least"), F.count("*").alias("sets")), "least")
        named = lookup(named, least, "c", "sets", spread, "k").withColumn("c", F.coalesce("least", "c"))
    of_set = named.select(F.hex("same").alias("same"), "w", F.col("c").alias("component_id"))
    alone = F.concat(F.lit("="), F.coalesce(F.col("k"), F.lit(0)).cast("string"))
    left = signed.select("k", "n", F.when((F.col("n") > 0) & F.col("k").isNotNull(), F.hex("same")).otherwise(alone).alias("same"))
    out = lookup(left, of_set, "same", "w", signed.count(), "k")
    component = F.coalesce("component_id", "k")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept"))
