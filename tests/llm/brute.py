"""The operators once more, on one machine and by the plainest way."""

import itertools
import math
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, size):
    w = words(lower(text))
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def linked(a, b, percent):
    return bool(a) and 100 * len(a & b) >= percent * len(a | b)


def classes(sets, percent):
    """Class number of each set."""
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if linked(sets[i], sets[j], percent):
            up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def hits(text, items, window):
    """Number of words, of hit words, and the items found."""
    w = bench_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        x = bench_words(item)
        n = min(window, len(x))
        if not n:
            continue
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                if item_id is not None:
                    found.add(str(item_id))
    return len(w), len(hit), sorted(found)


def quality(text):
    """The five measures and the verdict."""
    t = text or ""
    w = words(t)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i : i + 8])] > 1:
            again.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if words(x)]
    m = dict(
        n_words=len(w),
        word_chars=sum(map(len, w)),
        n_symbols=sum(c in "#*$%&|<>" for c in t),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=len(again),
    )
    n = m["n_words"]
    base = n < 20 or 100 * m["n_repeat_words"] > 30 * n
    bad = (
        base
        or 100 * sum(c in "#*$%&<>" for c in t) > 25 * n
        or 2 * t.count("!!") > n
        or 2 * m["n_dup_lines"] > len(lines)
        or m["word_chars"] < 2 * n
        or m["word_chars"] > 20 * n
    )
    return m, base, not bad


def dropped_lines(rows, depth=3, min_docs=10, long_words=50, long_docs=2, min_words=3, fixed=70):
    """For each (doc_id, text): the numbers of its lines that go."""

    def known(line):
        """Leaf and tokens: digits masked, unless too few words would be left fixed."""
        raw = tuple(words(line))
        tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in raw)
        alone = 100 * sum(t != "<*>" for t in tokens) < fixed * len(tokens)
        return ((len(raw), alone, raw) if alone else (len(raw), alone, tokens[:depth])), (raw if alone else tokens)

    def needed(n):
        return long_docs if n >= long_words else min_docs

    lines = []  # per row: (line_no, leaf, tokens) of the lines that can be templates
    for _, text in rows:
        split = [] if text is None else text.split("\n")
        lines.append([(i, *known(x)) for i, x in enumerate(split) if len(words(x)) >= min_words])
    holders = defaultdict(set)
    for (_, text), found in zip(rows, lines):
        for _, leaf, tokens in found:
            holders[leaf, tokens].add(text)
    leaves, support = defaultdict(set), Counter()
    for (leaf, tokens), texts in holders.items():
        leaves[leaf] |= texts
        for place, token in enumerate(tokens):
            support[leaf, place, token] += len(texts)
    template = {}
    for leaf, tokens in holders:
        if len(leaves[leaf]) < needed(leaf[0]):
            continue
        is_fixed = [
            support[leaf, i, x] >= needed(leaf[0]) and x != "<*>" for i, x in enumerate(tokens)
        ]
        shape = tuple(x if f else "<*>" for x, f in zip(tokens, is_fixed))
        template[leaf, tokens] = (leaf, shape if 100 * sum(is_fixed) >= fixed * len(tokens) else tokens)

    def place(doc_id):
        return doc_id is None, doc_id or 0

    # What recurs: templates, and runs of shared lines with enough words.
    units = []
    for (_, text), found in zip(rows, lines):
        mine = [
            (("template", template[leaf, t]), needed(leaf[0]), [i])
            for i, leaf, t in found if (leaf, t) in template
        ]
        shared = [len(holders[leaf, t]) >= long_docs for _, leaf, t in found]
        for s in range(len(found)):
            for step in (1, -1):
                total, e = 0, s
                while 0 <= e < len(found) and shared[e] and total < long_words:
                    total += len(found[e][2])
                    e += step
                run = sorted(range(s, e, step))
                if total >= long_words and len(run) > 1:
                    key = tuple(found[k][1:] for k in run)
                    mine.append((("run", key), long_docs, [found[k][0] for k in run]))
        units.append(mine)
    reach, first = defaultdict(set), {}
    for (doc_id, text), mine in zip(rows, units):
        for key, *_ in mine:
            reach[key].add(text)
            first[key] = min(first.get(key, place(doc_id)), place(doc_id))
    return [
        sorted({
            i for key, least, places in mine
            if len(reach[key]) >= least and first[key] != place(doc_id) for i in places
        })
        for (doc_id, _), mine in zip(rows, units)
    ]


def secrets(text):
    """(kind, start, end) of the base forms, in order."""
    t = text or ""
    out = []
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I | re.A,
    )
    for m in assign.finditer(t):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", t):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, m.end(), "hex"))
    for rank, kind, chars, bits in (
        (3, "entropy_hex", "[0-9a-fA-F]+", 3.0),
        (4, "entropy_base64", "[A-Za-z0-9+/_=-]+", 3.7),
    ):
        for m in re.finditer(chars, t):
            s = m[0]
            if len(s) < 20 or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
                continue
            if rank == 4 and re.fullmatch("[0-9a-fA-F]+", s):
                continue
            if re.search("(?i)example|0123456789abcdef|abcdefghijklmnop", s):
                continue
            best = max(
                -sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values())
                for i in range(len(s) - 19)
            )
            if best >= bits - 1e-7:
                out.append((m.start(), rank, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]
