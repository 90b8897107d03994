"""Template mining against a plain one-message-at-a-time model."""

import random
import time

import pytest
from pyspark.sql import functions as F

from logtables.functions.text import mask_variables, message_pattern, pattern_tokens
from logtables.operators import templates as T


class Sequential:
    """Brute force: every message against every template of its leaf, in order."""

    def __init__(self, levels=2, threshold=0.4, limit=100):
        self.levels, self.threshold, self.limit = levels, threshold, limit
        self.children, self.leaves, self.made = {}, {}, []

    def leaf_of(self, tokens):
        path = (str(len(tokens)),)
        for token in tokens[: self.levels]:
            known = self.children.setdefault(path, [])
            if token not in known:
                if len(known) < self.limit:
                    known.append(token)
                else:
                    token = "<*>"
                    if token not in known:
                        known.append(token)
            path += (token,)
        return path

    def feed(self, pattern):
        tokens = pattern.split()
        here = self.leaves.setdefault(self.leaf_of(tokens), [])
        score = [
            sum(a in ("<*>", b) for a, b in zip(t["tokens"], tokens)) / max(1, len(tokens))
            if tokens
            else 1.0
            for t in here
        ]
        if score and max(score) >= self.threshold:
            hit = here[score.index(max(score))]
            hit["tokens"] = [a if a == b else "<*>" for a, b in zip(hit["tokens"], tokens)]
        else:
            hit = {"id": len(self.made), "tokens": tokens, "count": 0}
            here.append(hit)
            self.made.append(hit)
        hit["count"] += 1
        return hit["id"]


def stream(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "c", "<*>", "d"]
    if seed % 2:
        return [
            " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(n)
        ]
    shapes = ["conn to %s from %s failed", "job %s done by %s", "job x%s ended", "%s up %s"]
    hosts = ["h" + c for c in "abcdefgh"]
    return [s.replace("%s", "{}").format(rng.choice(hosts), rng.choice(hosts), 1)
            for s in (rng.choice(shapes) for _ in range(n))]


def run(spark, messages, limit=100, chunk=100_000):
    events = spark.createDataFrame(list(enumerate(messages)), "n long, message string")
    counts = T.pattern_counts(events, order="n")
    keyed, book = T.mine_templates(counts, max_children=limit, chunk=chunk)
    intervals = T.assignment_intervals(keyed, book)
    described = T.describe_templates(book)
    tagged = T.tag_events(events, intervals, described, order="n")
    counted = T.template_counts(events, keyed, intervals, order="n").join(
        described, ["leaf", "template_no"]
    )
    return described, tagged, counted


@pytest.mark.parametrize("seed,limit,chunk", [(1, 100, 100_000), (2, 100, 4), (3, 3, 5), (4, 2, 100_000), (5, 2, 3)])
def test_equals_sequential_model(spark, seed, limit, chunk):
    messages = stream(seed, 250)
    model = Sequential(limit=limit)
    want = [model.feed(m) for m in messages]
    described, tagged, counted = run(spark, messages, limit, chunk)
    got = {r.template_id: r.tokens for r in described.collect()}
    assert got == {t["id"]: t["tokens"] for t in model.made}
    ids = {r.n: r.template_id for r in tagged.collect()}
    assert [ids[i] for i in range(len(messages))] == want
    totals = {r.template_id: r["count"] for r in counted.collect()}
    assert totals == {t["id"]: t["count"] for t in model.made}


def test_examples(spark):
    def mined(*lines):
        described, _, counted = run(spark, list(lines))
        return sorted((r["count"], r.template) for r in counted.collect())

    assert mined(
        "Pump p-4 restarted after 12 seconds (cycle=ab12)",
        "Pump p-9 restarted after 40 seconds (cycle=cd34)",
        "Pump p-2 restarted after 7 seconds (cycle=ef56)",
    ) == [(3, "Pump p-<*> restarted after <*> seconds <*>")]
    assert [c for c, _ in mined(
        "valve opened by hand",
        "valve opened by hand",
        "tank nearly empty now",
        "order 17 left the dock",
    )] == [1, 1, 2]
    assert len(mined("lamp red went out", "lamp green went out")) == 2
    assert len(mined("gate closed", "gate closed too late")) == 2
    assert mined("belt 3 moved 120 mm", "belt 8 moved 75 mm") == [(2, "belt <*> moved <*> mm")]


def test_events_without_message_are_tagged_too(spark):
    described, tagged, counted = run(spark, ["gate closed", None, "gate closed", None])
    assert sorted(r["count"] for r in counted.collect()) == [2, 2]
    assert tagged.filter("template_id is null").count() == 0 and tagged.count() == 4


def test_one_scan_masks_like_four(spark):
    rng = random.Random(7)
    bits = ["12345678-1234-1234-1234-123456789abc", "10.0.0.1", "1.2.3.4.5", "0x1f", "0x", "42",
            "-", ".", " ", "x", "é", "1234", "abcdef01-", "ffffffff-ffff-ffff-ffff-ffffffffffff"]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in lines], "v string")
    one = F.col("v")
    from logtables.functions.text import MASKS
    for mask in MASKS:
        one = F.regexp_replace(one, "(?U)" + mask, "<*>")
    assert df.filter(one != mask_variables(F.col("v"))).count() == 0


def test_tokens_of_blank_messages(spark):
    df = spark.createDataFrame([("",), ("  \t",), (" a   b ",)], "v string")
    got = [r[0] for r in df.select(pattern_tokens(message_pattern(F.col("v")))).collect()]
    assert got == [[], [], ["a", "b"]]


def _many_masks(spark, n_templates=60, n_tokens=12, seed=5):
    """Templates of one leaf, hardly two with the same wild positions, and patterns of some."""
    rng = random.Random(seed)
    book, patterns = [], set()
    for no in range(n_templates):
        tokens = [f"w{rng.randrange(6)}" for _ in range(n_tokens)]
        wild = set(rng.sample(range(n_tokens), rng.randint(0, n_tokens if no % 7 == 0 else 4)))
        book.append(("x", no, " ".join("<*>" if i in wild else t for i, t in enumerate(tokens))))
        for _ in range(3):
            patterns.add(
                " ".join(f"z{rng.randrange(3)}" if i in wild else t for i, t in enumerate(tokens))
            )
    patterns |= {" ".join(f"w{rng.randrange(6)}" for _ in range(n_tokens)) for _ in range(40)}
    patterns = [("x", p) for p in sorted(patterns)] + [("0", "")]
    book.append(("0", 0, ""))
    rows = spark.createDataFrame(book, "leaf string, template_no int, template string")
    rows = rows.withColumn("pattern", F.col("template")).selectExpr(
        "leaf", "template_no", "pattern", "template",
        f"cast(array() as {T._AT.join(('array<', '>'))}) as steps",
        "cast(array() as array<int>) as wild",
    )
    want = {
        (p, no)
        for leaf, p in patterns
        for other, no, t in book
        if leaf == other
        and all(a in ("<*>", b) for a, b in zip(t.split(), p.split()))
    }
    return spark.createDataFrame(patterns, "leaf string, pattern string"), rows, want


@pytest.mark.parametrize("masks", [0, 3])
def test_a_leaf_of_many_masks_is_asked_by_few_parts(spark, monkeypatch, masks):
    # a pattern was blanked once for every set of wild positions of its leaf
    monkeypatch.setattr(T, "MASKS", masks)
    written, plain = {}, T.materialise
    monkeypatch.setattr(
        T, "materialise", lambda df, name: written.setdefault(name, plain(df, name))
    )
    patterns, book, want = _many_masks(spark)
    got = [(r.pattern, r.template_no) for r in T.coverings(patterns, book).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert book.filter("leaf = 'x'").count() > 2 * 12 + masks
    slots = written["slots"].filter("leaf = 'x'").select("_slot").distinct().count()
    assert slots <= 2 * 12 + masks


def test_a_leaf_of_many_templates_is_replayed_in_proportion():
    # each pattern was compared with all templates of its leaf
    def seconds(n):
        rng = random.Random(3)
        lines = [" ".join(str(rng.randrange(2000)) for _ in range(40)) for _ in range(n)]
        leaf, began = T._Leaf("40"), time.process_time()
        for line in lines:
            leaf.see(line, {"ord": 0}, 0.4)
        assert len(leaf.rows) == n
        return time.process_time() - began

    seconds(500)
    assert seconds(12_000) < 20 * seconds(1500)


def test_a_few_templates_leave_the_events_in_their_tasks(spark):
    # events were gathered by pattern, so one of many events was sorted in one task
    lines = [(i, f"job {i} done" if i % 2 else f"user {i} is up") for i in range(200)]
    events = spark.createDataFrame(lines, "ts bigint, message string")
    keyed, book = T.mine_templates(T.pattern_counts(events))
    tagged = T.tag_events(events, T.assignment_intervals(keyed, book), T.describe_templates(book))
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(pattern" not in plan
    assert tagged.count() == 200
