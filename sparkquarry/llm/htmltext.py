"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut into flat blocks at block-level tags; inline tags and <br> (white space) stay inside a block. Comments, scripts,
styles and markup make no text. Each block has its words and link density, those of the blocks before and after it,
and what the open elements tell of its place. A decision tree, trained with Spark's library on the table of
html_examples, says which blocks are main text. These are joined in page order by one \\n: nothing is dropped for its
length, and nothing is capped.

The text of a block has its character references decoded, white space as one space, and no space at its ends. Null and
empty pages give the empty text, as do pages without main text. Open ends are read as browsers do: a comment, script or tag
that is never closed reaches to the end of the page, an element to the end of what holds it. The work is in proportion to
a page's length, however deep or broken its tags are. Rows that repeat a key are each judged alone; other columns stay out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

from . import html_examples

#: Names of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
SILENT = set("script style textarea title iframe noembed noframes head template svg object audio video canvas select option datalist".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav noscript ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = set("body div section td article main form header footer aside nav blockquote".split())
#: Elements that an opening tag ends if they are open in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}} | {tag: {"p"} for tag in BLOCK - {"body", "html", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd"}}
BOUNDARY = set("article aside body div footer form header main nav section table td th ul ol dl button html".split())
ASIDE = {"nav", "aside", "footer", "form", "fieldset", "button", "menu", "dialog", "noscript", "search"}
#: Words in the class, id or role of elements that aren't, or are, main text.
AWAY = set(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog discussion "
    "disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related "
    "replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser teasers toolbar widget widgets".split()
)
INLINE_AWAY = {"ad", "ads", "advert", "advertisement", "sponsored"}
HEAD = {"header", "masthead", "topbar"}
MAIN = {"article", "content", "entry", "main", "post", "story"}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "standing", "head", "heading", "share"]
#: What an element tells of the text in it, as bits. Elements inherit them.
ARTICLE, AWAY_BIT, HEAD_BIT, HEADING, SILENT_BIT, LINK = 1, 2, 4, 8, 16, 32


@dataclass
class Block:
    text: str
    words: int
    links: float
    place: int
    container: int


@lru_cache(maxsize=4096)
def _tells(name: str, rest: str) -> int:
    """Bits of an element from its name and attributes."""
    out = SILENT_BIT * (name in SILENT) | AWAY_BIT * (name in ASIDE) | HEAD_BIT * (name == "header") | ARTICLE * (name in ("article", "main")) | HEADING * (name in HEADINGS) | LINK * (name == "a")
    if rest and name not in ("html", "body"):
        for _, *values in MARKS.findall(rest):
            for value in "".join(values).lower().split():
                words = WORD.findall(value)
                if words[:1] in (["has"], ["with"], ["no"], ["is"]):
                    continue
                if name not in BLOCK:
                    out |= SILENT_BIT * (not INLINE_AWAY.isdisjoint(words))
                elif not AWAY.isdisjoint(words) and name not in HEADINGS and not (name == "main" or name == "article" and not {"comment", "comments"} & {*words} and {*words} & MAIN):
                    out |= AWAY_BIT
                elif not HEAD.isdisjoint(words):
                    out |= HEAD_BIT
                elif not MAIN.isdisjoint(words):
                    out |= ARTICLE
        if HIDDEN.search(rest):
            out |= AWAY_BIT if name in BLOCK else SILENT_BIT
    return out


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order."""
    out: list[Block] = []
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, bits, container
    opened: Counter[str] = Counter()
    bits, container, containers = 0, 0, 0
    place, held = 0, 0

    def flush() -> None:
        nonlocal pieces, linked
        text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            words = text.count(" ") + 1
            out.append(Block(text, words, min(1.0, len(html.unescape(" ".join(linked)).split()) / words) if linked else 0.0, place, held))
        pieces, linked = [], []

    def put(text: str) -> None:
        nonlocal place, held
        if bits & SILENT_BIT or not text:
            return
        if not pieces or pieces[-1].isspace() and len(pieces) == 1:
            place, held = bits & ~LINK, container
        pieces.append(text)
        if bits & LINK:
            linked.append(text)

    def close(upto: int) -> None:
        """Close the elements from a place of the stack on."""
        nonlocal bits, container
        while len(stack) > upto:
            name, bits, container = stack.pop()
            opened[name] -= 1

    at = 0
    while m := TOKEN.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                put("\n")
            elif name == "p" and not opened["p"]:
                flush()
            elif opened[name] > 0:
                cut = len(stack) - 1
                while stack[cut][0] != name:
                    cut -= 1
                if any(x[0] in BLOCK for x in stack[cut:]):
                    flush()
                close(cut)
            continue
        if name in BLOCK:
            flush()
        if name == "br":
            put("\n")
        for other in ENDS.get(name, ()):
            if opened[other] > 0:
                cut = len(stack) - 1
                while stack[cut][0] != other and stack[cut][0] not in BOUNDARY:
                    cut -= 1
                if stack[cut][0] == other:
                    close(cut)
        if name in VOID:
            continue
        stack.append((name, bits, container))
        opened[name] += 1
        bits |= _tells(name, m["rest"] if len(m["rest"]) < 400 else " ".join(x[0] for x in MARKS.finditer(m["rest"])))
        if name in CONTAINERS:
            containers += 1
            container = containers
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if name == "xmp":
                put(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page)
    put(page[at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of one page.

    standing: 1 inside the page's article, -1 outside of it or in a menu, footer, form and the like, 0 where a page tells
    neither. share: the part of the page's unlinked words that stands in the same container.
    """
    words = np.array([b.words for b in found], float)
    links = np.array([b.links for b in found])
    place = np.array([b.place for b in found], int)
    container = np.array([b.container for b in found], int)
    article, away = (place & ARTICLE) > 0, (place & AWAY_BIT) > 0
    own = np.where(away, 0, words * (1 - links))
    by = np.bincount(container, own, minlength=1)
    share = by[container] / max(own.sum(), 1e-9)
    before = lambda x: np.append([0.0], x[:-1])
    after = lambda x: np.append(x[1:], [0.0])
    inside = article & ~away
    standing = np.where(inside, 1, np.where(away | inside.any(), -1, 0))
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), standing, (place & HEAD_BIT) > 0, (place & HEADING) > 0, share]).astype(float)


@dataclass
class Tree:
    """A decision tree as arrays: a row goes left if its feature is at most the limit; leaves have feature -1 and their class as limit."""

    feature: list[int]
    limit: list[float]
    left: list[int]
    right: list[int]

    def predict(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), int)
        feature, limit, left, right = (np.array(x) for x in (self.feature, self.limit, self.left, self.right))
        while (inner := feature[node] >= 0).any():
            at = node[inner]
            node[inner] = np.where(rows[np.flatnonzero(inner), feature[at]] <= limit[at], left[at], right[at])
        return limit[node] > 0.5


def examples() -> list[tuple[np.ndarray, int]]:
    """Features and label of every block of the labelled pages."""
    out = []
    for page in html_examples.pages():
        found = blocks(page)
        labels = [int(b.text.startswith("§")) for b in found]
        out += zip(features(found), labels, strict=True)
    return out


def trained(spark: SparkSession, depth: int = 8) -> Tree:
    """The tree fitted to the labelled table, whose size is fixed."""
    rows = spark.createDataFrame([(Vectors.dense(x), float(y)) for x, y in examples()], ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(rows.coalesce(1))
    tree = Tree([], [], [], [])

    def take(node) -> int:
        at = len(tree.feature)
        inner = node.subtreeDepth() > 0
        tree.feature.append(node.split().featureIndex() if inner else -1)
        tree.limit.append(float(node.split().threshold() if inner else node.prediction()))
        tree.left.append(0)
        tree.right.append(0)
        if inner:
            tree.left[at], tree.right[at] = take(node.leftChild()), take(node.rightChild())
        return at

    take(model._call_java("rootNode"))
    return tree


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The main text of each page; the blocks of all of them are judged together."""
    found = [blocks(p) if p else [] for p in pages]
    rows = [features(f) for f in found if f]
    kept = iter(tree.predict(np.vstack(rows)) if rows else ())
    return ["\n".join(b.text for b, k in [(b, next(kept)) for b in f] if k) for f in found]


def extracted(pages: DataFrame, tree: Tree | None = None, key: str = "page_id", url: str = "url", page: str = "html", batch: int = 64) -> DataFrame:
    """(key, url, text, n_chars) of each row, in one pass without a shuffle. batch: pages whose blocks are judged together."""
    tree = tree or trained(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = main_texts(part.column(2).to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return pages.select(pages[key].alias("k"), pages[url].alias("u"), pages[page].alias("h")).mapInArrow(run, f"`{key}` {kind[key]}, `{url}` {kind[url]}, text string, n_chars long")
