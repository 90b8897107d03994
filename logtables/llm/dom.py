"""HTML as flat arrays of nodes, and what can be said of each node."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

# The elements of HTML that matter here, by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
SILENT = set("script style noscript iframe template svg math head title object noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img".split()
)
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: A start tag closes an open element of these, up to the scope's end.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TAG_GROUPS = {
    "main": "article main",
    "section": "section div",
    "nav": "nav menu",
    "header": "header hgroup",
    "footer": "footer",
    "aside": "aside dialog",
    "form": "form button select option textarea label fieldset legend input",
    "paragraph": "p blockquote pre",
    "heading": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol li dl dt dd",
    "table": "table tr td th tbody thead",
    "link": "a",
}
#: Words of class, id and role that tell what an element is for.
TOKENS = {
    "content": "article articles body content entry main post story text prose blog news page",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager tabs skip toc",
    "top": "header masthead top topbar logo brand hero banner branding",
    "bottom": "footer bottom copyright colophon legal imprint",
    "side": "sidebar aside side widget related recommended rail complementary trending popular more tags",
    "advert": "ad ads advert advertisement adsense promo promoted sponsor sponsored teaser offer",
    "comments": "comment comments reply replies respond discussion disqus feedback thread",
    "notice": "cookie cookies consent notice gdpr modal popup overlay alert toast dialog privacy",
    "forms": "form search login signup subscribe newsletter register contact searchbox",
    "share": "share sharing social follow like tweet buttons toolbar",
}

GROUPS, FLAGS = list(TAG_GROUPS), list(TOKENS)
_GROUP = {tag: i for i, g in enumerate(GROUPS) for tag in TAG_GROUPS[g].split()}
_FLAG = {word: 1 << i for i, f in enumerate(FLAGS) for word in TOKENS[f].split()}
#: Group of text nodes and of other elements.
TEXT, OTHER = len(GROUPS), len(GROUPS) + 1
_LINK = 1 << (len(FLAGS) + _GROUP["a"])

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Nodes in document order, the elements and the runs of text between tags."""

    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)


def _flags(tag: str, attrs: str, known: dict[str, int]) -> int:
    if (found := known.get(tag + attrs)) is not None:
        return found
    flags = 0
    for values in _ATTR.findall(attrs):
        for word in _WORD.findall("".join(values)):
            flags |= _FLAG.get(word.lower(), 0)
    if (group := _GROUP.get(tag)) is not None:
        flags |= 1 << (len(FLAGS) + group)
    if len(known) < 10_000:
        known[tag + attrs] = flags
    return flags


def parse(html: str, known: dict[str, int]) -> Page:
    """The nodes of a page. Never fails: what can't be a tag is text, open elements end with
    the page, end tags without a start are ignored."""
    page, stack, names = Page(), [], []
    open_of: dict[str, int] = {}
    silent, block, at = 0, 0, 0

    def add(tag_group: int, own: int, text: str | None, offset: int) -> None:
        up = stack[-1] if stack else -1
        page.parent.append(up)
        page.end.append(0)
        page.depth.append(len(stack))
        page.group.append(tag_group)
        page.own.append(own)
        page.above.append(page.above[up] | page.own[up] if stack else 0)
        page.text.append(text)
        page.block.append(block)
        page.offset.append(offset)
        said = text.split() if text else []
        page.words.append(len(said))
        page.chars.append(sum(map(len, said)))
        page.stops.append(len(_ENDS.findall(text)) if said else 0)

    def close() -> None:
        nonlocal silent
        tag = names.pop()
        open_of[tag] -= 1
        silent -= tag in SILENT
        page.end[stack.pop()] = len(page.parent)

    def close_to(tags: set[str], barrier: set[str]) -> None:
        if not any(open_of.get(t) for t in tags):
            return
        for i in range(len(names) - 1, -1, -1):
            if names[i] in tags:
                while len(names) > i:
                    close()
                return
            if names[i] in barrier:
                return

    def say(start: int, stop: int) -> None:
        if stop > start and not silent:
            text = unescape(html[start:stop])
            if text:
                add(TEXT, 0, text, start)
                page.end[-1] = len(page.parent)

    while True:
        found = _TOKEN.search(html, at)
        if not found:
            break
        say(at, found.start())
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        if found["close"]:
            if not open_of.get(tag):
                continue
            if tag in INLINE:
                # An inline end tag doesn't end blocks that began inside.
                for i in range(len(names) - 1, -1, -1):
                    if names[i] == tag:
                        while len(names) > i:
                            close()
                        break
                    if names[i] not in INLINE:
                        break
            else:
                close_to({tag}, set())
            continue
        if tag in ENDS_P:
            close_to({"p"}, {"td", "th", "table", "button", "caption"})
        elif tag in CLOSES:
            close_to(*CLOSES[tag])
        add(_GROUP.get(tag, OTHER), _flags(tag, found["attrs"], known), None, found.start())
        if tag in VOID or found["attrs"].endswith("/") and tag in ("svg", "math"):
            page.end[-1] = len(page.parent)
            continue
        stack.append(len(page.parent) - 1)
        names.append(tag)
        open_of[tag] = open_of.get(tag, 0) + 1
        silent += tag in SILENT
        if tag in RAW:
            ending = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            stop = ending.start() if ending else len(html)
            say(at, stop)
            at = stop
    say(at, len(html))
    while names:
        close()
    return page


#: Numbers told of a node; then own and inherited flags, own group.
NUMBERS = 22
N_FEATURES = NUMBERS + 2 * (len(FLAGS) + len(GROUPS)) + 2


def features(pages: list[Page]) -> np.ndarray:
    """A row of numbers for each node of all pages, one page after the other."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = int(sizes.sum())

    def column(name: str, kind=np.int64) -> np.ndarray:
        return np.fromiter((x for p in pages for x in getattr(p, name)), kind, n)

    here, end = np.arange(n), column("end") + first
    up = column("parent")
    has_up = up >= 0
    up = np.where(has_up, up + first, here)
    group, own, above = column("group"), column("own"), column("above")
    chars, words, stops = column("chars"), column("words"), column("stops")
    inside_link = (above & _LINK) != 0

    def subtree(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return (sums[end] - sums[here]).astype(float)

    text, said, ended = subtree(chars), subtree(words), subtree(stops)
    linked = subtree(chars * inside_link) / np.maximum(text, 1)
    nodes, runs = subtree(group != TEXT), subtree(chars > 0)
    paragraphs, items = subtree(group == GROUPS.index("paragraph")), subtree(group == GROUPS.index("list"))
    inputs = subtree(group == GROUPS.index("form"))
    whole = np.repeat([max(sum(p.chars), 1) for p in pages], sizes)
    before = np.cumsum(chars) - chars
    before = before - np.repeat(before[first[np.cumsum(sizes)[sizes > 0] - 1]], sizes[sizes > 0])
    # Siblings lie next to each other when nodes are sorted by parent.
    family = np.where(has_up, up, -1 - first)
    order = np.argsort(family, kind="stable")
    new = np.ones(n, bool)
    new[1:] = family[order][1:] != family[order][:-1]
    group_no = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    number = np.empty(n)
    number[order] = np.arange(n) - starts[group_no]
    count = np.empty(n)
    count[order] = np.diff(np.append(starts, n))[group_no]
    alike = np.empty(n)
    _, which, times = np.unique(np.stack([group_no, group[order]]), axis=1, return_inverse=True, return_counts=True)
    alike[order] = times[which.reshape(-1)] / count[order]
    siblings_text = np.empty(n)
    siblings_text[order] = np.add.reduceat(text[order], starts)[group_no] if n else 0
    last, next_ = np.zeros(n), np.zeros(n)
    same = ~new[1:]
    last[order[1:][same]] = linked[order[:-1][same]]
    next_[order[:-1][same]] = linked[order[1:][same]]
    numbers = [
        np.log1p(text),
        np.log1p(said),
        linked,
        nodes / (1 + said),
        np.log1p(nodes),
        text / np.maximum(runs, 1),
        ended / np.maximum(said, 1),
        column("depth"),
        (before + text / 2) / whole,
        text / whole,
        text / np.maximum(text[up], 1),
        np.log1p(count),
        number / count,
        alike,
        last,
        next_,
        linked[up],
        np.log1p(paragraphs),
        items / (1 + nodes),
        np.log1p(inputs),
        (siblings_text - text) / np.maximum((count - 1) * 100, 1),
        np.log1p(text[up]),
    ]
    bits = np.arange(len(FLAGS) + len(GROUPS))
    flags = [(own[:, None] >> bits) & 1, (above[:, None] >> bits) & 1]
    kinds = [(group == TEXT)[:, None], (group == OTHER)[:, None]]
    return np.concatenate([np.stack(numbers, axis=1), *flags, *kinds], axis=1).astype(np.float64)


def blocks(page: Page, keep: np.ndarray) -> str:
    """The text of the kept runs: one space for white space, one between blocks."""
    said, now, parts = [], None, []
    for text, block, kept in zip(page.text, page.block, keep):
        if text is None or not kept:
            continue
        if block != now:
            said.extend("".join(parts).split())
            now, parts = block, []
        parts.append(text)
    said.extend("".join(parts).split())
    return " ".join(said)
