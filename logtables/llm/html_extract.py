"""The main text of web pages: boosted trees over DOM nodes, decoded down the hierarchy.

Pages come without labels, so the trees learn from layouts made anew: the words of a bounded
sample of pages are set in articles of many forms, between menus, headers, notices, adverts,
forms, sidebars, comments and footers of many forms, and every node's label is known.

Each node of a page, element or run of text, is scored by itself from the density of its
subtree, the words of its attributes, its depth and its siblings. Decoding then chooses for
each subtree the best of three: all kept, all dropped, or its children decide. A kept element
therefore never has a dropped ancestor, and nothing in it is dropped but by a mixed one.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.llm import dom
from logtables.scratch import materialise

#: Pages whose words training uses, words of each, and layouts made of each.
TRAIN_PAGES, TRAIN_WORDS, LAYOUTS = 200, 400, 4
#: Trees and their depth.
TREES, TREE_DEPTH = 16, 5
#: Least gain in log likelihood for which an element's children are judged apart.
SPLIT = 2.5
#: Characters of HTML decoded together.
CHUNK_CHARS = 4 << 20

_FALLBACK = "the river ran slowly past old mill and children watched it every morning before school".split()


class _Layout:
    """A page made of ``words`` by chance; ``main`` are the places of its main text."""

    def __init__(self, words: list[str], seed: int) -> None:
        self.chance, self.words = random.Random(seed), words or _FALLBACK
        self.html: list[str] = []
        self.length, self.main = 0, []

    def put(self, html: str) -> None:
        self.html.append(html)
        self.length += len(html)

    def some(self, least: int, most: int) -> str:
        n = self.chance.randint(least, most)
        at = self.chance.randrange(len(self.words))
        said = (self.words[at:] + self.words * (1 + n // len(self.words)))[:n]
        return " ".join(said).replace("&", "&amp;").replace("<", "&lt;")

    def sentence(self, least: int = 3, most: int = 40) -> str:
        return self.some(least, most).capitalize() + self.chance.choice([".", ".", ".", "!", "?", ""])

    def named(self, tag: str, *kinds: str) -> str:
        """A start tag, often with words that tell what it is for, often with none."""
        pick, attrs = self.chance.choice, ""
        if kinds and self.chance.random() < 0.8:
            word = pick(dom.TOKENS[pick(kinds)].split())
            word = pick([word, f"{word}-{pick(['box', 'wrap', 'inner', 'list', 'item', '1'])}", f"site-{word}", f"{word} col-{self.chance.randint(1, 12)}"])
            attrs = f' {pick(["class", "class", "id", "role"])}="{word}"'
        elif self.chance.random() < 0.5:
            attrs = f' class="{pick(["row", "col-8", "c12", "x", "container", "wrap", "inner", "box"])}"'
        return f"<{tag}{attrs}>"

    def links(self, least: int, most: int, listed: bool = True) -> None:
        for _ in range(self.chance.randint(least, most)):
            link = f'<a href="/{self.chance.randint(1, 999)}">{self.some(1, 4)}</a>'
            self.put(f"<li>{link}</li>" if listed else link + self.chance.choice([" ", " | ", ""]))

    def menu(self) -> None:
        tag = self.chance.choice(["nav", "div", "ul", "nav", "header"])
        self.put(self.named(tag, "menu", "top") + ("" if tag == "ul" else "<ul>"))
        self.links(3, 12)
        self.put("</ul>" + ("" if tag == "ul" else f"</{tag}>"))

    def header(self) -> None:
        tag = self.chance.choice(["header", "div", "header"])
        self.put(self.named(tag, "top") + f"<a href='/'>{self.some(1, 3)}</a>")
        self.put(self.chance.choice(["", f"<p>{self.sentence(3, 12)}</p>", f"<h2>{self.some(2, 5)}</h2>"]))
        self.put(f"</{tag}>")

    def advert(self) -> None:
        tag = self.chance.choice(["div", "aside", "section", "ins"])
        body = self.sentence(3, 30)
        self.put(self.named(tag, "advert") + self.chance.choice([body, f"<p>{body}</p>", f"<a href='#'>{body}</a>"]) + f"</{tag}>")

    def notice(self) -> None:
        tag = self.chance.choice(["div", "section", "dialog", "aside"])
        self.put(self.named(tag, "notice") + f"<p>{self.sentence(6, 40)}</p><button>{self.some(1, 2)}</button></{tag}>")

    def form(self) -> None:
        self.put(self.named("form", "forms") + self.chance.choice(["", f"<p>{self.sentence(4, 20)}</p>", f"<h3>{self.some(2, 5)}</h3>"]))
        for _ in range(self.chance.randint(1, 4)):
            self.put(f"<label>{self.some(1, 3)}</label><input type='text'>")
        self.put(self.chance.choice([f"<button>{self.some(1, 2)}</button>", "<select><option>" + self.some(1, 2) + "<option>" + self.some(1, 2) + "</select>"]))
        self.put("</form>")

    def sidebar(self) -> None:
        tag = self.chance.choice(["aside", "div", "section", "aside"])
        self.put(self.named(tag, "side") + self.chance.choice(["", f"<h3>{self.some(1, 4)}</h3>"]))
        if self.chance.random() < 0.5:
            self.put("<ul>")
            self.links(2, 10)
            self.put("</ul>")
        else:
            for _ in range(self.chance.randint(1, 4)):
                self.put(f"<div><h4><a href='#'>{self.some(2, 8)}</a></h4><p>{self.sentence(5, 30)}</p></div>")
        self.put(f"</{tag}>")

    def share(self) -> None:
        self.put(self.named("div", "share"))
        self.links(2, 5, self.chance.random() < 0.3)
        self.put("</div>")

    def comments(self) -> None:
        tag = self.chance.choice(["section", "div", "ol", "ul"])
        inner = "li" if tag in ("ol", "ul") else self.chance.choice(["div", "article", "div"])
        self.put(self.named(tag, "comments") + ("" if inner == "li" else self.chance.choice(["", f"<h3>{self.some(1, 3)}</h3>"])))
        for _ in range(self.chance.randint(1, 6)):
            who = self.chance.choice(["b", "span", "a", "cite"])
            self.put(self.named(inner, "comments") + f"<{who}>{self.some(1, 2)}</{who}>")
            for _ in range(self.chance.randint(1, 3)):
                self.put(f"<p>{self.sentence(2, 60)}</p>")
            self.put(f"</{inner}>")
        self.put(f"</{tag}>")

    def footer(self) -> None:
        tag = self.chance.choice(["footer", "div", "footer"])
        self.put(self.named(tag, "bottom") + self.chance.choice(["&copy; ", "", "<p>"]) + self.some(1, 4))
        self.put(" &middot; " + self.sentence(3, 25))
        if self.chance.random() < 0.5:
            self.links(2, 8, False)
        self.put(f"</{tag}>")

    def said(self, html: str) -> None:
        """A part of the main text."""
        start = self.length
        self.put(html)
        self.main.append((start, self.length))

    def passage(self) -> None:
        body = self.sentence(*self.chance.choice([(1, 4), (5, 30), (20, 120), (40, 250)]))
        if self.chance.random() < 0.3:
            words = body.split(" ")
            at = self.chance.randrange(len(words))
            tag = self.chance.choice(["b", "i", "em", "a href='/x'", "strong", "span", "code"])
            words[at] = f"<{tag}>{words[at]}</{tag.split(' ')[0]}>"
            body = " ".join(words)
        kind = self.chance.random()
        if kind < 0.62:
            self.said(f"<p>{body}</p>")
        elif kind < 0.70:
            self.said(f"<p><b>{body}<br>")
        elif kind < 0.75:
            self.said(f"<h{self.chance.randint(2, 4)}>{self.some(1, 8)}</h2>")
        elif kind < 0.81:
            items = "".join(f"<li>{self.sentence(2, 20)}</li>" for _ in range(self.chance.randint(2, 6)))
            self.said(self.chance.choice([f"<ul>{items}</ul>", f"<ol>{items}</ol>"]))
        elif kind < 0.85:
            self.said(f"<blockquote><p>{body}</p></blockquote>")
        elif kind < 0.89:
            rows = "".join(f"<tr><td>{self.some(1, 4)}</td><td>{self.some(1, 4)}</td></tr>" for _ in range(self.chance.randint(2, 6)))
            self.said(f"<table>{rows}</table>")
        elif kind < 0.92:
            self.said(f"<figure><img src='x.png'><figcaption>{self.sentence(2, 15)}</figcaption></figure>")
        elif kind < 0.94:
            self.said(f"<pre>{body}</pre>")
        else:
            self.said(f"{body}<br><br>")

    def article(self) -> None:
        pick = self.chance.choice
        outer = pick(["article", "article", "main", "div", "section", "div"])
        self.put(self.named(outer, "content"))
        depth = pick([0, 0, 0, 1, 1, 2])
        if self.chance.random() < 0.8:
            title = f"<h1>{self.some(1, 12)}</h1>"
            self.said(pick([title, title, f"<header>{title}</header>", f"<div>{title}</div>"]))
        inside = [self.share, self.advert, self.form, self.sidebar]
        for _ in range(depth):
            self.put(self.named("div", "content"))
        for _ in range(pick([1, 1, 2, 3, 5, 8, 12, 20])):
            self.passage()
            if self.chance.random() < 0.04:
                pick(inside)()
        for _ in range(depth):
            self.put("</div>")
        if self.chance.random() < 0.3:
            pick([self.comments, self.comments, self.share, self.sidebar])()
        self.put(f"</{outer}>")

    def page(self) -> tuple[str, list[tuple[int, int]]]:
        chance = self.chance
        self.put(f"<!DOCTYPE html><html><head><title>{self.some(1, 8)}</title><script>var a='</p>';</script></head><body>")
        wrapped = chance.random() < 0.4
        if wrapped:
            self.put(self.named("div"))
        for part, share in (
            (self.notice, 0.25), (self.header, 0.4), (self.menu, 0.8), (self.form, 0.15),
            (self.advert, 0.35), (self.sidebar, 0.15),
        ):
            if chance.random() < share:
                part()
        held = chance.random() < 0.3
        if held:
            self.put(chance.choice([self.named("div"), "<main>", self.named("div", "content")]))
        self.article()
        for part, share in ((self.comments, 0.3), (self.share, 0.2), (self.sidebar, 0.3), (self.advert, 0.2)):
            if chance.random() < share:
                part()
        if held:
            self.put("</div></main>")
        for part, share in ((self.form, 0.2), (self.notice, 0.2), (self.footer, 0.85)):
            if chance.random() < share:
                part()
        self.put("</body></html>" if chance.random() < 0.9 else "")
        return "".join(self.html), self.main


def labelled(html: str, main: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes that are wholly, or not at all, main text."""
    page = dom.parse(html, {})
    chars, offset, end = np.array(page.chars), np.array(page.offset), np.array(page.end)
    bounds = np.array(main or [(0, 0)])
    place = np.searchsorted(bounds[:, 0], offset, side="right") - 1
    inside = (place >= 0) & (offset < bounds[place, 1])
    sums = np.concatenate(([0], np.cumsum(chars)))
    kept = np.concatenate(([0], np.cumsum(chars * inside)))
    here = np.arange(len(chars))
    total, main_chars = sums[end] - sums[here], kept[end] - kept[here]
    sure = (total > 0) & ((main_chars == 0) | (main_chars == total))
    return dom.features([page])[sure], (main_chars > 0)[sure]


Forest = list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def learn(pages: DataFrame, train_pages: int = TRAIN_PAGES, layouts: int = LAYOUTS) -> Forest:
    """Boosted trees as arrays, from layouts made of the words of at most ``train_pages`` pages.

    The pages with the smallest hash of their id and url are taken, ``TRAIN_WORDS`` words of
    each; without any words, layouts are made of a few fixed ones.
    """
    sample = pages.select(F.xxhash64("page_id", "url").alias("seed"), "html")
    sample = sample.orderBy("seed").limit(train_pages)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed, html in zip(batch.column("seed").to_pylist(), batch.column("html").to_pylist()):
                said = dom.parse(html or "", {}).text
                words = " ".join(x for x in said if x).split()[:TRAIN_WORDS]
                for i in range(layouts):
                    rows, labels = labelled(*_Layout(words, seed * layouts + i).page())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(rows), pa.list_(pa.float64())), pa.array(labels.astype(float))],
                        ["x", "label"],
                    )

    # A fixed set of layouts even where the table is empty.
    blank = pages.sparkSession.range(train_pages, numPartitions=1).select(
        F.xxhash64("id").alias("seed"), F.lit("").alias("html")
    )
    sample = sample.unionByName(blank).limit(train_pages).repartition(8, "seed")
    rows = materialise(sample.mapInArrow(nodes, "x array<double>, label double"), "layout_nodes")
    rows = rows.select("label", array_to_vector("x").alias("features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, maxBins=64, seed=11, cacheNodeIds=False)
    return _arrays(trees.fit(rows))


def _arrays(model: GBTClassificationModel) -> Forest:
    forest = []
    for weight, tree in zip(model.treeWeights, model.trees):
        features, bounds, left, right = [], [], [], []

        def add(node) -> int:
            i = len(features)
            features.append(0)
            bounds.append(float(node.prediction()))
            left.append(i)
            right.append(i)
            if node.subtreeDepth() > 0:
                features[i], bounds[i] = node.split().featureIndex(), float(node.split().threshold())
                left[i], right[i] = add(node.leftChild()), add(node.rightChild())
            return i

        add(tree._java_obj.rootNode())
        forest.append((weight, *map(np.array, (features, bounds, left, right))))
    return forest


def scores(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """The chance of each node to be main text."""
    margin, every = np.zeros(len(rows)), np.arange(len(rows))
    for weight, features, bounds, left, right in forest:
        at = np.zeros(len(rows), int)
        for _ in range(TREE_DEPTH):
            down = np.where(rows[every, features[at]] <= bounds[at], left[at], right[at])
            # A leaf is its own child.
            at = down
        margin += weight * bounds[at]
    return 1 / (1 + np.exp(-2 * margin))


def decode(page: dom.Page, chance: np.ndarray, split: float = SPLIT) -> np.ndarray:
    """Which nodes are kept: the likeliest choice in which no subtree contradicts its root."""
    n = len(page.parent)
    said = np.array(page.chars) > 0
    sums = np.concatenate(([0], np.cumsum(said)))
    end, here = np.array(page.end), np.arange(n)
    counts = sums[end] > sums[here]
    chance = np.clip(chance, 0.02, 0.98)
    keep = np.concatenate(([0], np.cumsum(np.log(chance) * counts)))
    drop = np.concatenate(([0], np.cumsum(np.log(1 - chance) * counts)))
    keep, drop = (keep[end] - keep[here]).tolist(), (drop[end] - drop[here]).tolist()
    apart = [-split] * n
    choice = [0] * n
    for i in range(n - 1, -1, -1):
        best = max(keep[i], drop[i])
        choice[i] = 1 if keep[i] >= drop[i] else 0
        if page.text[i] is None and apart[i] > best:
            best, choice[i] = apart[i], 2
        if page.parent[i] >= 0:
            apart[page.parent[i]] += best
    for i in range(n):
        if page.parent[i] >= 0 and choice[page.parent[i]] != 2:
            choice[i] = choice[page.parent[i]]
    return np.array(choice) == 1


def extract(pages: DataFrame, forest: Forest) -> DataFrame:
    """``page_id``, ``url``, ``text`` (empty if there is none) and ``n_chars`` of each row.

    The whole HTML counts; a null or empty one, or one without text, gives an empty text.
    Broken markup is read as far as it goes. Rows that repeat are treated alike, null ids and
    urls stay, other columns are ignored, an empty table gives no rows.
    """
    known = pages.sparkSession.sparkContext.broadcast(forest)

    def texts(html: list[str], flags: dict) -> list[str]:
        trees = [dom.parse(x, flags) for x in html]
        chances = scores(known.value, dom.features(trees))
        told, at = [], 0
        for tree in trees:
            n = len(tree.parent)
            told.append(dom.blocks(tree, decode(tree, chances[at : at + n])) if n else "")
            at += n
        return told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[str, int] = {}
        for batch in batches:
            html = ["" if x is None else x for x in batch.column("html").to_pylist()]
            first = 0
            while first < len(html):
                last, size = first, 0
                while last < len(html) and (last == first or size + len(html[last]) <= CHUNK_CHARS):
                    size += len(html[last])
                    last += 1
                told = texts(html[first:last], flags)
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("page_id"),
                        rows.column("url"),
                        pa.array(told, pa.string()),
                        pa.array([len(x) for x in told], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )
                first = last

    pages = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html")
    return pages.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
