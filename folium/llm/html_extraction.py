"""Main texts of web pages by a graphical model over the tree of each page.

Every block element of a page is a variable: main text or not. What is seen of the element (its tag, the words
of its class and id, how much text and how much of it in links stands below it, how many sentences end in it)
gives it a potential, and so does its place below its parent. Messages are passed from the leaves to the root
and back, sum-product, which on a tree gives each element's exact marginal; text stays where that is above a half.

Both kinds of potential are learnt as counts over labelled pages. An element is labelled by the nearest element
about it that says so: the attribute data-main, or else a tag that names its part (article, main; nav, aside,
footer, form). The pages of a table that have such a tag and, as one table's pages tend to look alike, copies of
them in other layouts (layouts.py) are the labelled pages of `learn`.

Inline elements belong to the block about them, so links and bold words stay in their paragraph. White space
within a block becomes one space; a block ends where a block element or line break starts or ends. Null and
empty pages give an empty text; a page that repeats gives the same each time. Elements more than 512 deep
count as siblings, as in browsers. Work is linear in a page's length.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm import layouts

#: Labelled pages that are learnt from at most, and copies of each in other layouts.
FIT_PAGES = 600
COPIES = 3
#: Copies of an empty page.
PLAIN_COPIES = 300
#: Fixed values of the language: elements that never hold text of a page, that stand within a line, that are
#: never closed, and what the start of an element closes.
SKIPPED = set("script style noscript template head title iframe object svg canvas select textarea button datalist audio video map".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
IN_PARAGRAPH = INLINE | VOID | SKIPPED - {"title"}
DEEPEST = 512
#: Tags that tell an element's part, for labels.
MAIN, OTHER = {"article", "main"}, {"nav", "aside", "footer", "form"}
#: Tags that count by themselves; others are one kind.
KINDS = set("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th nav header footer aside form blockquote pre figure figcaption fieldset details".split())
#: A feature tells no more than this, and one that was seen more seldom nothing.
MOST_ODDS, FEWEST = 5.0, 5
#: What is seen of the texts below an element says much the same several times over, so it counts in part.
TEXT_WEIGHT = 0.5


@dataclass
class Page:
    """Block elements in page order: tag, words of class and id, parent, label; and pieces of text with their
    element and block."""

    tags: list[str]
    words: list[set[str]]
    parents: list[int]
    labels: list[int]
    pieces: list[tuple[int, int, str, bool]]


def _words(value: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value[:500])]


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page(["html"], [set()], [-1], [0], [])
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.counts = Counter({"html": 1})
        self.links = self.block = 0
        self.skipped = ""

    def _pop(self) -> None:
        tag, _ = self.open.pop()
        self.counts[tag] -= 1
        self.links -= tag == "a"
        self.block += tag not in INLINE

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] in stop:
                return
            if self.open[at][0] in tags:
                while len(self.open) > at:
                    self._pop()
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped:
            return
        if tag in SKIPPED:
            self.skipped = tag
            return
        if tag in VOID:
            self.block += tag in ("br", "hr")
            return
        if tag in ("html", "body") and self.counts[tag]:
            return
        if self.counts["p"] and tag not in IN_PARAGRAPH:
            self._close({"p"}, {"td", "th"})
        if tag in CLOSED_BY:
            self._close(*(set(x.split()) for x in CLOSED_BY[tag]))
        at = self.open[-1][1]
        if tag not in INLINE:
            self.block += 1
            said = {k: v or "" for k, v in attrs}
            main = said.get("data-main", "1" if tag in MAIN else "0" if tag in OTHER else "")
            page, words = self.page, set(_words(" ".join([said.get("class", ""), said.get("id", ""), said.get("role", "")])))
            page.labels.append(int(main == "1") if main else page.labels[at])
            page.tags.append(tag)
            page.words.append(words | ({"hidden"} if "hidden" in said else set()))
            page.parents.append(at)
            at = len(page.tags) - 1
        if len(self.open) < DEEPEST:
            self.open.append((tag, at))
            self.counts[tag] += 1
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SKIPPED:  # a stroke at its end closes none but these
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            self.skipped = "" if tag == self.skipped else self.skipped
        elif tag == "br":
            self.block += 1
        elif self.counts[tag] and tag not in ("html", "body"):
            # the end of an inline element closes no block
            if tag not in INLINE or self._inline(tag):
                while self.open[-1][0] != tag:
                    self._pop()
                self._pop()

    def _inline(self, tag: str) -> bool:
        for name, _ in reversed(self.open):
            if name == tag:
                return True
            if name not in INLINE:
                return False
        return False

    def handle_data(self, data: str) -> None:
        if not self.skipped and data:
            self.page.pieces.append((self.open[-1][1], self.block, data, self.links > 0))


def read(html: str) -> Page:
    reader = _Reader()
    reader.feed(html.replace("<![", "<! ["))
    reader.close()
    return reader.page


def _bin(x: float, edges: tuple[float, ...]) -> int:
    return sum(x > e for e in edges)


def features(page: Page) -> list[list[str]]:
    """What is seen of each element, as names."""
    n = len(page.tags)
    size, linked, ends, own = [0] * n, [0] * n, [0] * n, [0] * n
    for at, _, text, in_link in page.pieces:
        k = len(text) - text.count(" ")
        size[at] += k
        own[at] += k
        linked[at] += k if in_link else 0
        ends[at] += text.count(". ") + text.rstrip().endswith((".", "!", "?", "。"))
    for at in range(n - 1, 0, -1):
        up = page.parents[at]
        size[up] += size[at]
        linked[up] += linked[at]
        ends[up] += ends[at]
    out = []
    for at in range(n):
        links = _bin(linked[at] / size[at], (0, 0.25, 0.6, 0.9)) if size[at] else 9
        kind = page.tags[at] if page.tags[at] in KINDS else "other"
        seen = [f"tag {kind}", f"links {links}", f"size {_bin(size[at], (0, 20, 80, 300, 1000))} {own[at] > 0}", f"ends {_bin(ends[at], (0, 1, 4))} {own[at] > 0}"]
        out.append(seen + [f"word {w}" for w in page.words[at]])
    return out


def _edge(tag: str, words: set[str]) -> str:
    """The kind of an element's place below its parent."""
    return f"{tag if tag in KINDS else 'other'} {'named' if words else 'plain'}"


@dataclass(frozen=True)
class Model:
    """odds: of each feature, in logarithms, for main text; edges: of each kind of place the chances that a child
    is main text below a parent that is not, and below one that is."""

    odds: dict[str, float]
    edges: dict[str, tuple[float, float]]


def marginals(parents: list[int], odds: list[float], edges: list[tuple[float, float]]) -> list[float]:
    """The chance of each variable of a tree to be 1, by messages up and down; parents come before children.
    odds: each one's own, in logarithms; edges: the chances to be 1 below a parent of 0 and below one of 1 (of
    the root: below 0)."""
    n = len(parents)
    # of 0 and 1: what is seen at and below each variable, and what each child tells its parent
    below = [(1.0, math.exp(o)) if o < 0 else (math.exp(-o), 1.0) for o in odds]
    told = [(1.0, 1.0)] * n
    for at in range(n - 1, 0, -1):
        (b0, b1), (low, high) = below[at], edges[at]
        t0, t1 = b0 * (1 - low) + b1 * low, b0 * (1 - high) + b1 * high
        m = t0 if t0 > t1 else t1
        told[at] = t0, t1 = t0 / m, t1 / m
        up = parents[at]
        p0, p1 = below[up][0] * t0, below[up][1] * t1
        m = p0 if p0 > p1 else p1
        below[up] = (p0 / m, p1 / m)
    out, above = [0.0] * n, [(1.0, 1.0)] * n
    for at in range(n):
        if at:
            # the parent without this child's own message
            up, (t0, t1), (low, high) = parents[at], told[at], edges[at]
            p0, p1 = below[up][0] * above[up][0] / t0, below[up][1] * above[up][1] / t1
            a0, a1 = p0 * (1 - low) + p1 * (1 - high), p0 * low + p1 * high
        else:
            a0, a1 = 1 - edges[0][0], edges[0][0]
        above[at] = a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
        s0, s1 = below[at][0] * a0, below[at][1] * a1
        out[at] = s1 / (s0 + s1)
    return out


def content(page: Page, model: Model) -> list[float]:
    """Each element's chance to be main text."""
    odds = [sum(model.odds.get(f, 0.0) for f in seen) for seen in features(page)]
    usual = model.edges["other plain"]
    edges = [model.edges.get(_edge(t, w), usual) for t, w in zip(page.tags, page.words)]
    return marginals(page.parents, [max(-30.0, min(30.0, o)) for o in odds], edges)


def extract(html: str | None, model: Model) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = read(html)
    chances = content(page, model)
    blocks: dict[int, list[str]] = {}
    for at, block, text, _ in page.pieces:
        if chances[at] > 0.5:
            blocks.setdefault(block, []).append(text)
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


def _counted(page: Page) -> Counter:
    """Of one labelled page: features by label, places by label of parent and child."""
    found = Counter()
    for at, seen in enumerate(features(page)):
        y, up = page.labels[at], page.labels[page.parents[at]] if at else 0
        found.update((f, -1, y) for f in [*seen, "any"])
        found[_edge(page.tags[at], page.words[at]), up, y] += 1
    return found


def counts(pages: DataFrame, html: Column, key: Column, copies: int = COPIES) -> DataFrame:
    """name, up, y, n: counts over labelled pages and their copies; up is -1 for features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for one, seed in zip(batch["html"], batch["seed"].to_pylist()):
                page = read(one.as_py())
                found.update(_counted(page))
                parts = layouts.parts(page)
                for copy in range(copies):
                    found.update(_counted(read(layouts.dressed(parts, seed + copy))))
        rows = [(*k, n) for k, n in found.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "up", "y", "n"), r)) for r in rows], pa.schema([("name", pa.string()), ("up", pa.int32()), ("y", pa.int32()), ("n", pa.int64())]))

    each = pages.select(html.alias("html"), F.xxhash64(key).alias("seed")).mapInArrow(count, "name string, up int, y int, n long")
    return each.groupBy("name", "up", "y").agg(F.sum("n").alias("n"))


def learn(pages: DataFrame, html: str = "html", key: str = "page_id", most: int = FIT_PAGES) -> Model:
    """The model of the labelled pages among pages, of at most most of them, picked by a hash of their key; null
    keys and repeated ones are as good as others. Copies of an empty page come first, so that there is a model
    where few pages are labelled or none."""
    found = Counter()
    for seed in range(PLAIN_COPIES):
        found.update(_counted(read(layouts.dressed(layouts.Parts([], []), seed))))
    marked = F.col(html).rlike(r"(?i)<(article|main)\b|\bdata-main=")
    picked = pages.where(marked).select(key).distinct().orderBy(F.xxhash64(key), key).limit(most)
    some = pages.where(marked).select(html, key).join(F.broadcast(picked.withColumnRenamed(key, "_picked")), F.col(key).eqNullSafe(F.col("_picked")), "left_semi")
    for r in counts(some, F.col(html), F.col(key)).collect():  # names of a bounded number of pages
        found[r["name"], r["up"], r["y"]] += r["n"]
    return model(found)


def model(found: Counter) -> Model:
    """Odds and chances out of counts, each with one more of either kind."""
    all_0, all_1 = found["any", -1, 0], found["any", -1, 1]
    odds, edges = {}, {"other plain": (0.05, 0.95)}
    for name, up in {(name, up) for name, up, _ in found}:
        n0, n1 = found[name, up, 0], found[name, up, 1]
        if up == -1:
            if n0 + n1 >= FEWEST and name != "any":
                ratio = math.log((n1 + 1) / (all_1 + 2)) - math.log((n0 + 1) / (all_0 + 2))
                odds[name] = max(-MOST_ODDS, min(MOST_ODDS, ratio)) * (1.0 if name.startswith(("tag ", "word ")) else TEXT_WEIGHT)
        elif name not in edges:
            low, high = ((found[name, y, 1] + s) / (found[name, y, 0] + found[name, y, 1] + 1) for y, s in ((0, 0.05), (1, 0.95)))
            edges[name] = (low, high)
    return Model(odds, edges)


def main_texts(pages: DataFrame, model: Model, html: str = "html", name: str = "text") -> DataFrame:
    """pages without html, with the main text in a column of that name; others of that name are replaced."""
    kept = [c for c in pages.columns if c not in (html, name)]
    given = pages.select(*kept, F.col(html).alias(name))
    schema, at = given.schema, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few pages at a time, as one may be very long
            for s in range(0, len(batch), 64):
                part = batch.slice(s, 64)
                texts = pa.array([extract(h.as_py(), model) for h in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], texts], names=part.schema.names)

    return given.mapInArrow(run, schema)
