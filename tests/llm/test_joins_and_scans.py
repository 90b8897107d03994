"""Operators 1, 3, 4, 5, 9 and 10 against their brute-force versions."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logtables.llm import decontaminate, jaccard_join, line_dedup, quality, secret_scan
from logtables.llm.license_scan import scan_licenses
from logtables.llm.links import components

from . import brute
from .conftest import EDGE, HEX, PROSE


def near_copies(n, seed):
    """Texts of which many are near copies of others."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.7:
            w = out[rng.randrange(len(out))].split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            out.append(" ".join(w))
        else:
            out.append(" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 120))))
    return out


def rows_by_row(found, columns):
    return sorted(map(repr, found.select(*columns).toPandas().itertuples(index=False, name=None)))


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, edge, size, percent):
    rows = [*EDGE, *((100 + i, t) for i, t in enumerate(near_copies(120, 1)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    sets = [brute.shingles(t, size) for _, t in rows]
    numbers = brute.classes(sets, percent)
    least = {}
    for (i, _), k in zip(rows, numbers):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    want = sorted(
        repr((i, len(s), least[k] if s else i)) for (i, _), s, k in zip(rows, sets, numbers)
    )
    found = jaccard_join.jaccard_classes(docs, size, percent, block=500)
    got = [tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(map(repr, got)) == want


def test_one_of_each_class_stays(spark, edge, nothing):
    kept = jaccard_join.keep_one(edge, 3, 90)
    assert kept.columns == edge.columns
    ids = sorted(kept.toPandas()["doc_id"].tolist(), key=str)
    assert ids.count(2) == 0 and ids.count(1) == 1  # 2 is a near copy of 1
    assert sum(i == 7 for i in ids) == 0 and sum(i == 6 for i in ids) == 1
    assert {3, 4, 5} <= set(ids)  # no words: nothing to link
    assert jaccard_join.keep_one(nothing, 3, 90).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([80, 90, 95]), st.booleans())
def test_divide_skip_connects_what_links_connect(seed, percent, two_blocks):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(14):
        if sets and rng.random() < 0.7:
            s = sets[rng.integers(len(sets))].copy()
            s[rng.integers(len(s))] = rng.integers(1, 1000)
        else:
            s = rng.integers(1, 1000, rng.integers(1, 40))
        sets.append(np.unique(s.astype(np.uint64)))
    first = 7 if two_blocks else 0
    pairs = list(jaccard_join.divide_skip(sets, first, percent))
    plain = [frozenset(s.tolist()) for s in sets]
    want = {
        (i, j)
        for i in range(14)
        for j in range(i)
        if brute.linked(plain[i], plain[j], percent) and (not first or j < 7 <= i)
    }
    assert {(max(p), min(p)) for p in pairs} <= want

    def connected(links):
        up = list(range(14))
        for _ in up:
            for a, b in links:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert connected(pairs) == connected(want)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([80, 90]))
def test_linked_sets_share_a_signature(seed, percent):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 300))
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    b = np.unique(np.r_[a[: len(a) - int(rng.integers(0, max(1, n // 8)))], a[:1]])
    b = np.unique(np.r_[b, rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 12))), dtype=np.uint64)])
    if brute.linked(frozenset(a.tolist()), frozenset(b.tolist()), percent):
        assert np.intersect1d(
            jaccard_join.signatures(a, percent), jaccard_join.signatures(b, percent)
        ).size


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, None), (60, 60)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: i // 10 * 10 for i in range(40)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


ITEMS = [(1, PROSE), (2, "two words"), (3, ""), (4, None), (5, PROSE + " more"), (None, "naïve façade")]


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_passages_equal_naive_search(spark, edge, part_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    extra = [(20, "xx " + PROSE[4:] + " Two-words, TWO words"), (21, PROSE.replace("children", "men"))]
    docs = edge.select("doc_id", "text", "items").union(
        spark.createDataFrame([(*r, None) for r in extra], "doc_id bigint, text string, items array<int>")
    )
    found = decontaminate.find_passages(docs, bench, 10, part_bytes=part_bytes)
    got = sorted(
        repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]))
        for r in found.collect()
    )
    want = []
    for i, t in [*EDGE, *extra]:
        n, hit, items = brute.hits(t, ITEMS, 10)
        want.append(repr((i, n, hit, items, hit > 0)))
    assert got == sorted(want)


def test_clean_documents_stay_whole(spark, edge, nothing):
    bench = spark.createDataFrame([(1, PROSE)], "item_id bigint, text string")
    kept = decontaminate.clean_only(edge, bench)
    assert kept.columns == edge.columns
    assert 1 not in [r["doc_id"] for r in kept.collect()]
    assert decontaminate.clean_only(edge, bench.limit(0)).count() == len(EDGE)
    assert decontaminate.clean_only(nothing, bench).count() == 0


@settings(max_examples=80, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("abc"), min_size=3, max_size=3), max_size=5),
    st.lists(st.sampled_from("abcd"), max_size=40),
)
def test_wu_manber_finds_every_occurrence(patterns, words):
    known = {tuple(p): {1} for p in patterns}
    got = [at for at, _ in decontaminate.WuManber(known, 3).find(words)]
    assert got == [i for i in range(len(words) - 2) if tuple(words[i : i + 3]) in known]


SECRETS = [
    (30, f"API_KEY='abcdefghijkl' apikey = x token:token=abcdefghijkl{HEX[:15]}"),
    (31, "AKIA AKIAAKIAAKIAAKIA12 AKIA123 xAKIAABCDEFGHIJKLMNO"),
    (32, "Zx9aQw8eRt7yUi6oPa5sDf4g 0123456789abcdef0123456789 aB1" + "c" * 30),
    (33, "\x01\x02" + HEX.upper() + "\U0001f600" + HEX),
    (34, f"{HEX}{HEX} secret\"  :  '{HEX}' password==========="),
]


def test_secrets_equal_regular_expressions(spark, edge, nothing):
    docs = edge.select("doc_id", "text").union(
        spark.createDataFrame(SECRETS, "doc_id bigint, text string")
    )
    found = secret_scan.digest(secret_scan.find_secrets(docs))
    want = [
        repr((i, ",".join(f"{k}:{a}:{b}" for k, a, b in brute.secrets(t)))) for i, t in [*EDGE, *SECRETS]
    ]
    assert sorted(repr((r["doc_id"], r["spans"])) for r in found.collect()) == sorted(want)
    assert secret_scan.find_secrets(nothing).count() == 0


def test_measures_equal_counting(spark, edge, nothing):
    rng = random.Random(3)
    extra = [
        (40, "a b c d e f g h " * 5),
        (41, " ".join(rng.choice("ab") for _ in range(300))),
        (42, "same line of words\n" * 9 + PROSE),
        (43, PROSE + "*** ### $$$ %%% &&& ||| <<< >>> &&& &&&"),
        (44, PROSE + " " + PROSE[:90] + " again and " + PROSE[:90]),
        (45, "!! ".join(PROSE.split())),
    ]
    docs = edge.select("doc_id", "text", "n_words").union(
        spark.createDataFrame([(*r, 0) for r in extra], "doc_id bigint, text string, n_words int")
    )
    want = []
    for i, t in [*EDGE, *extra]:
        m, base, kept = brute.quality(t)
        want.append(repr((i, *m.values(), base, kept)))
    got = quality.measured(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(want)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(brute.quality(t)[2] for _, t in [*EDGE, *extra])
    assert quality.keep_good(nothing).count() == 0


def test_cascade_order_changes_nothing(edge):
    names = [r.name for r in quality.RULES]
    there = edge.filter(quality.cascade(edge, order=names).isNull()).count()
    back = edge.filter(quality.cascade(edge, order=names[::-1]).isNull()).count()
    assert there == back == sum(brute.quality(t)[2] for _, t in EDGE)


def test_recurring_lines_equal_the_tree(spark, edge, nothing):
    rows = list(EDGE)
    for i in range(30):
        own = f"Nobody else has line {'abcdefghijklmnop'[i % 16]}{i}x here today."
        lines = [own, f"Page {i} of 30 pages in total", "Home About us Contact now"]
        if i % 3 == 0:
            lines.append(" ".join(f"passage{k % 7}" if k % 5 else "word" for k in range(60)))
        if i % 2:
            lines.insert(0, "")
        rows.append((100 + i, "\n".join(lines)))
    rows += [(200 + i, "Copies of one text say nothing\nabout their own lines here") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = line_dedup.drop_recurring(docs)
    want = []
    for (i, t), gone in zip(rows, brute.dropped_lines(rows)):
        lines = t.split("\n") if t is not None else []
        text = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want.append(repr((i, len(lines), len(gone), text)))
    got = found.select("document.doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(want)
    assert sum(r["n_dropped"] for r in got) > 60
    kept = line_dedup.without_recurring(edge)
    assert kept.columns == edge.columns and kept.count() == len(EDGE)
    assert line_dedup.without_recurring(nothing).count() == 0


def test_licenses_equal_dice(spark, edge, nothing):
    found = {r["doc_id"]: r["licenses"] for r in scan_licenses(edge).collect() if r["doc_id"]}
    assert [(x["license"], x["dice"], x["unit"], x["place"]) for x in found[10]] == [
        ("Apache-2.0", 100, "line", 1)
    ]
    assert not any(found[i] for i in found if i != 10)
    own = {"a": ("red green blue white black",), "b": ("red green blue white",), "none": ("x",)}

    def grams(text):
        w = brute.bench_words(text)
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)}

    lines = [
        "Red, green; BLUE white black", "red green blue white", "red green blue white grey",
        "green blue white", "one red green blue white black two", "", "red red red",
    ]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    for r in scan_licenses(docs, own, 70).collect():
        scores = []
        for name in ("a", "b"):
            x, y = grams(lines[r["doc_id"]]), grams(own[name][0])
            if x and 200 * len(x & y) >= 70 * (len(x) + len(y)):
                scores.append((200 * len(x & y) // (len(x) + len(y)), name))
        best = max(scores, key=lambda s: (s[0], s[1] == "a"), default=None)
        assert [(x["dice"], x["license"]) for x in r["licenses"]] == ([best] if best else [])
    assert scan_licenses(nothing).count() == 0
    assert scan_licenses(edge, {}).count() == len(EDGE)


@pytest.mark.parametrize("n", [1, 19, 20, 255, 256, 257, 475, 493, 494, 3000])
def test_entropy_of_long_runs(spark, n):
    """Cut or whole, a run has the same least sum."""
    run = "".join(random.Random(n).choice("abcABC0123+/") for _ in range(n))
    row = spark.createDataFrame([(run,)], "run string").select(
        secret_scan.least_order(F.col("run"), 20).alias("whole"),
        secret_scan.least_order_of_run(F.col("run"), 20).alias("cut"),
    ).first()
    assert row.whole == row.cut


def test_secret_at_the_end_of_a_very_long_run(spark):
    """A run of a hundred thousand characters, random only in its last twenty."""
    run = "aA1" * 33_333 + "Zk8Qw2Xv5Ln9Tb3Rm7Yd"
    docs = spark.createDataFrame([(1, run), (2, "aA1" * 33_333)], "doc_id bigint, text string")
    started = time.monotonic()
    got = {r.doc_id: [tuple(f)[:4] for f in r.found] for r in secret_scan.find_secrets(docs).collect()}
    assert got == {1: [(0, 4, len(run), "entropy_base64")], 2: []}
    assert time.monotonic() - started < 120
