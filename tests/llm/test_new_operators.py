"""Extraction, collocations and the prefix trie against brute force and written-out cases."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from logtables.llm import dom, html_extract
from logtables.llm.collocations import _plain, collocations
from logtables.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt

# ---- 11


@pytest.fixture(scope="module")
def forest(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return html_extract.learn(pages, train_pages=120)


MAIN = (
    "<h1>On rivers</h1><p>The river ran slowly past the old mill, and the <b>children</b> watched it "
    "every morning.<p>Their mother hung\n the washing &amp; sang; nobody heard her over the water."
    "<ul><li>First stone</li><li>Second stone</li></ul>"
    "<p>In spring the ice broke up, and boats came down from the hills with wood and wool.</p>"
)
SAID = (
    "On rivers The river ran slowly past the old mill, and the children watched it every morning. "
    "Their mother hung the washing & sang; nobody heard her over the water. First stone Second stone "
    "In spring the ice broke up, and boats came down from the hills with wood and wool."
)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Place {i}</a></li>' for i in range(6)) + "</ul>"
AROUND = [
    ("<nav>{}</nav><article>".format(MENU), "</article><footer>&copy; The mill</footer>"),
    (
        f'<header><a href="/">The mill</a><p>News from the valley</p></header><div class="menu">{MENU}</div>'
        '<div id="cookie-notice"><p>We use cookies to make this site better for you.</p><button>Agree</button></div>'
        '<main><article class="post">',
        '</article><section class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I remember '
        "the boats well, my father built three of them.</p></div></section></main>"
        f'<aside class="sidebar"><h3>Related</h3>{MENU}</aside><footer>Imprint | Contact</footer>',
    ),
    (
        f'<div class="navbar">{MENU}</div><div class="container"><div class="entry-content">',
        '</div><div class="ad-box">Buy wool now, the best wool in the valley.</div><form class="newsletter">'
        "<label>Your mail</label><input><button>Send</button></form></div>"
        '<div class="footer">All rights reserved by the mill and its keepers.</div>',
    ),
]


def extracted(spark, forest, html):
    rows = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    return html_extract.extract(rows, forest).first().text


@pytest.mark.parametrize("before, after", AROUND)
def test_main_text_of_other_layouts(spark, forest, before, after):
    page = f"<html><head><title>t</title><script>var a = '<p>no</p>';</script></head><body>{before}{MAIN}{after}</body></html>"
    assert extracted(spark, forest, page) == SAID


def test_given_pages(spark, forest):
    """The one article element of each given page holds its main text."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages, forest).collect()}
    for page in pages.collect():
        main = re.search("<article>(.*?)</article>", page.html, re.S).group(1)
        text = unescape(re.sub("<(?:/?(?:h1|p)|br)>", " ", main).replace("<b>", ""))
        assert got[page.page_id].text == " ".join(text.split())
        assert got[page.page_id].n_chars == len(got[page.page_id].text)


def test_held_out_layouts(forest):
    right = wrong = missed = 0
    words = MAIN.split()
    for seed in range(150):
        html, main = html_extract._Layout(words, 10**9 + seed).page()
        page = dom.parse(html, {})
        keep = html_extract.decode(page, html_extract.scores(forest, dom.features([page])))
        bounds, offset, chars = np.array(main), np.array(page.offset), np.array(page.chars)
        place = np.searchsorted(bounds[:, 0], offset, side="right") - 1
        inside = (place >= 0) & (offset < bounds[place, 1])
        right += (chars * (keep & inside)).sum()
        wrong += (chars * (keep & ~inside)).sum()
        missed += (chars * (~keep & inside)).sum()
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.93


def test_decoding_never_contradicts(forest):
    for seed in range(40):
        page = dom.parse(html_extract._Layout(["a", "b", "c"], seed).page()[0], {})
        chance = np.random.default_rng(seed).random(len(page.parent))
        keep = html_extract.decode(page, chance)
        for i, up in enumerate(page.parent):
            assert up < 0 or keep[i] or not keep[up]


def test_decoding_is_the_best_choice():
    page = dom.parse("<div><p>a b</p><div><p>c</p>d</div></div><p>e</p>", {})
    chance = np.random.default_rng(5).uniform(0.05, 0.95, len(page.parent))
    children = defaultdict(list)
    for i, up in enumerate(page.parent):
        children[up].append(i)

    def under(i):
        return [i] + [x for c in children[i] for x in under(c)]

    def best(i):
        keep = sum(np.log(chance[x]) for x in under(i))
        drop = sum(np.log(1 - chance[x]) for x in under(i))
        options = [(keep, {x: True for x in under(i)}), (drop, {x: False for x in under(i)})]
        if page.text[i] is None:
            parts = [best(c) for c in children[i]]
            told = {i: False} | {k: v for _, p in parts for k, v in p.items()}
            options.append((sum(s for s, _ in parts) - 0.7, told))
        return max(options, key=lambda o: o[0])

    want = {k: v for root in children[-1] for k, v in best(root)[1].items()}
    assert html_extract.decode(page, chance, split=0.7).tolist() == [want[i] for i in range(len(page.parent))]


def test_broken_pages(spark, forest):
    html = [
        None, "", "   ", "<", "<<<>>>", "a < b", "<p", "<!-- <p>x</p>", "</div></p>", "<script>x", "&amp",
        "<div>" * 30_000 + "</p>" * 30_000, "<b>" * 2000 + "deep", "<p class=\"x", "\x00<p>퟿</p>",
        "<table><tr><td>1<td>2<tr><td>3</table>", "<article>" + MAIN * 400,
    ]
    rows = [(i, None, h, 1, "n") for i, h in enumerate(html)] + [(None, "u", None, 1, "n"), (0, "u", "<p>x", 1, "n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int, n_chars string")
    got = html_extract.extract(pages, forest).collect()
    assert len(got) == len(rows)
    told = {r.page_id: r for r in got if r.url is None}
    assert all(told[i].text == "" and told[i].n_chars == 0 for i in (0, 1, 2, 9))
    assert len(told[16].text) > 390 * len(SAID)
    assert html_extract.extract(pages.limit(0), forest).count() == 0
    assert html_extract.learn(pages.limit(0), train_pages=10)


def test_markup_is_read_as_told():
    page = dom.parse("<p>a<b>b</b>c<br>d&nbsp;&lt;e<p>f<td>g</td><li>h<li>i", {})
    assert dom.blocks(page, np.ones(len(page.parent), bool)) == "abc d <e f g h i"
    page = dom.parse("x<style>p{}</style><!-- y --><textarea><p>z</textarea><svg><text>no</text></svg>w", {})
    assert dom.blocks(page, np.ones(len(page.parent), bool)) == "x <p>z w"


# ---- 12


def plain_collocations(rows, least, top, longest=5):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in (text or "").encode().translate(_plain()).split(b"\n"):
            words = piece.decode().replace("\n", " ").split(" ")
            words = [w for w in words if w]
            sizes[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    found = []
    for lang, of in counts.items():
        phrases = [p for p, f in of.items() if f >= least and len(p) > 1]
        rows = []
        for p in phrases:
            inside = any(
                of[q] >= of[p] for q in phrases if len(q) > len(p)
                and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            )
            if inside:
                continue
            cuts = [
                (1000 * of[p] * sizes[lang] // (of[p[:k]] * of[p[k:]]), k, of[p[:k]], of[p[k:]])
                for k in range(1, len(p))
            ]
            score, _, left, right = min(cuts)
            rows.append((-score, -of[p], " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(found)


def told_collocations(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, f int, w1 int")
    found = collocations(docs.repartition(3), **options)
    return sorted(
        (r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect()
    )


@pytest.mark.parametrize("budget", [1 << 20, 40, 3])
def test_collocations_equal_plain_counts(spark, budget):
    chance = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["É x", "Und", "AN\tan"]
    rows = []
    for i in range(90):
        said = chance.choices(words, [20 / (k + 1) for k in range(len(words))], k=chance.randint(0, 60))
        text = "".join(w + chance.choice([" ", " ", "  ", ", ", "\n", "."]) for w in said)
        rows.append((chance.choice(["a", "b", None, "und"]), text))
    rows += [("a", "the same long passage of words here")] * 30 + [("a", None), (None, None), ("b", "")]
    rows += [("c", "x " * 500), ("c", "x")]
    for least, top in ((4, 2000), (10, 5)):
        got = told_collocations(spark, rows, least=least, top=top, budget=budget, chunk_bytes=200)
        assert got == plain_collocations(rows, least, top) and got


def test_no_collocations(spark):
    assert told_collocations(spark, [("a", None), (None, "")], least=1) == []
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations(docs).count() == 0


# ---- 13


def plain_trie(rows, block=20, choices=4):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    whole = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % choices
        whole[c] = tuple(turns.get(c - c % block, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    nodes = list(members)
    rows = []
    for node in nodes:
        below = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        spared = sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
        rows.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
            len(children), len(leaves), spared, sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def told_trie(spark, rows):
    turns = spark.createDataFrame(
        [(*r, 1, 2) for r in rows], "conv_id bigint, turn int, role string, text string, place int, depth int"
    )
    return sorted(map(tuple, prefix_trie(*rebuilt(numbered_turns(turns.repartition(3)))).collect()), key=repr)


def test_trie_equals_plain(spark):
    chance, rows = random.Random(3), []
    for conv in [*range(0, 90), 1000, 1003, 1007]:
        for turn in range(chance.choice([1, 1, 2, 3, 4, 6])):
            text = chance.choice(["hello there", "one two three", "", None, "a\tb\nc"])
            rows.append((conv, turn or None, chance.choice(["user", "user", None, ""]), text))
    rows += [(None, 1, "user", "nobody's"), (5, 99, "user", "last"), (5, 99, "user", "last")]
    assert told_trie(spark, rows) == plain_trie(rows)


def test_copies_long_and_lone_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 60) for t in range(5)]
    assert told_trie(spark, rows) == plain_trie(rows)
    # crc32("3") % 4 is 3: the opening is absent, nothing is left of this one.
    alone = [(c, 0, "user", "x") for c in range(400, 500) if crc32(str(c).encode()) % 4 and c % 20][:1]
    assert told_trie(spark, alone) == plain_trie(alone)
    assert [r[1] for r in told_trie(spark, alone)] == [0]
    assert told_trie(spark, []) == []


def test_turns_beyond_a_chunk(spark, monkeypatch):
    monkeypatch.setattr("logtables.llm.prefix_trie.CHUNK", 4)
    rows = [(c, t, "user", f"w{t if c % 3 else t // 2}") for c in range(20, 32) for t in range(11 + c % 4)]
    assert told_trie(spark, rows) == plain_trie(rows)
