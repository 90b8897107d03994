"""Cases that the operators once cut short."""

import itertools
import random
import re
import time
import unicodedata
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from logtables.llm import jaccard_join, language_id, line_dedup, packing, quality
from logtables.llm.license_scan import TEMPLATES, _words, scan_licenses

from . import brute


def words(n, tag):
    """``n`` words without digits that no other tag has."""
    return " ".join(f"{tag}{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(n))


def left(spark, rows):
    """(doc_id, text without recurring lines, lines dropped), in order."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = line_dedup.drop_recurring(docs).select("document.doc_id", "text", "n_dropped")
    return sorted(map(tuple, found.collect()))


def test_long_line_of_two_documents_goes(spark):
    long, short = words(50, "p"), words(49, "q")
    rows = [(i, f"{short}\n{words(6, f'own{c}')}\n{long}") for i, c in enumerate("xy")]
    rows += [(5 + i, f"{words(60, 'copy')}\nequal texts count once") for i in range(2)]
    gone = brute.dropped_lines(rows, long_docs=2)
    assert gone == [[], [2], [], []]
    assert [n for *_, n in left(spark, rows)] == [len(x) for x in gone]


def test_rows_of_numbers_that_differ_stay(spark):
    rows = [
        (i, f"{i} {i + 45} {i + 78}\n{i} March 20{i}\n{words(7, 'total')} {i} {i} {i}\n1 2 3 4")
        for i in range(10, 25)
    ]
    # words that vary don't let variables stand in for them
    rows += [
        (i, f"{words(5, 'lead')} {words(2, f'own{chr(i)}')} {i} {i} {i}") for i in range(97, 115)
    ]
    want = [(i, t if i == 10 or i > 90 else "\n".join(t.split("\n")[:2])) for i, t in rows]
    assert [(i, t) for i, t, _ in left(spark, rows)] == want


def runs_dropped(rows):
    """Numbers of the lines that stand in a run of 50 words that a text before has too."""

    def lines(text):
        cut = [(i, tuple(brute.words(x))) for i, x in enumerate(text.split("\n"))]
        return [(i, w) for i, w in cut if len(w) >= 3]

    def common(a, b):
        """Places in ``a`` of the runs it shares with ``b``."""
        for i in range(len(a)):
            for j in range(len(b)):
                if i and j and a[i - 1][1] == b[j - 1][1]:
                    continue
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                    n += 1
                if n > 1 and sum(len(w) for _, w in a[i : i + n]) >= 50:
                    yield from (k for k, _ in a[i : i + n])

    out = []
    for _, text in rows:
        found = set()
        for other in rows[: len(out)]:
            found |= set(common(lines(text), lines(other[1])))
        out.append(found)
    return out


def test_wrapped_passage_of_two_documents_goes(spark):
    passage = "\n".join(words(10, t) for t in "abcdef")
    rows = [
        (1, f"{words(8, 'mine')}\n{passage}\n{words(8, 'end')}"),
        (2, f"{words(7, 'yours')}\n{passage}"),
        (3, "\n".join(passage.split("\n")[:4]) + f"\n{words(7, 'forty')}"),
    ]
    assert left(spark, rows) == [(*rows[0], 0), (2, words(7, "yours"), 6), (*rows[2], 0)]


def test_runs_equal_all_pairs(spark):
    rng = random.Random(1)
    # as many words as 3 to 49, so that no line is long by itself
    pool = [words(n, f"line{'abcdefghijklmnopqrstuvwxyz'[k]}") for k, n in enumerate(rng.choices([3, 5, 12, 20, 30, 49], k=26))]
    rows = []
    for i in range(60):
        own = [words(4, f"own{chr(200 + i)}")]
        at = rng.randrange(20)
        run = pool[at : at + rng.randrange(2, 8)]
        if rng.random() < 0.5:
            run.insert(rng.randrange(len(run)), rng.choice(["", "two words", own[0]]))
        rows.append((i, "\n".join(own + run + pool[:1] * (i % 2))))
    want = runs_dropped(rows)
    alone = brute.dropped_lines(rows, min_docs=100, long_words=10**6)
    assert not any(alone) and sum(map(len, want)) > 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = line_dedup.drop_recurring(docs, min_docs=100).select("document.doc_id", "text", "n_dropped")
    cut = [
        (i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone))
        for (i, t), gone in zip(rows, want)
    ]
    assert sorted(map(tuple, found.collect())) == cut


def test_notices_among_other_words_are_found(spark):
    short, apache = TEMPLATES["Apache-2.0"]
    wrapped = apache.split()
    wrapped = "\n".join(" ".join(wrapped[i : i + 14]) for i in range(0, len(wrapped), 14))
    mit = "\n\n".join(TEMPLATES["MIT"][2:])
    rows = [
        (1, f"Copyright 2020 Example Corp. and all the others. {short} {words(30, 'prose')}"),
        (2, f"{words(40, 'code')}\n{wrapped}\n{words(60, 'more')}"),
        (3, f"{words(99, 'prose')} {mit.replace(chr(10), ' ')}\n{words(80, 'end')}"),
        (4, f"{words(90, 'prose')}\n{short}\n{words(30, 'end')}"),
        (5, f"{words(5, 'a')}\n{short}\n{words(9, 'b')} {short} {words(9, 'c')}"),
        (6, words(99, "nothing")),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {
        r["doc_id"]: [(x["license"], x["dice"], x["unit"], x["place"]) for x in r["licenses"]]
        for r in scan_licenses(docs).collect()
    }
    assert got == {
        1: [("Apache-2.0", 100, "window", 8)],
        2: [("Apache-2.0", 100, "window", 40)],
        3: [("MIT", 100, "window", 99), ("MIT", 100, "window", 99 + len(_words(TEMPLATES["MIT"][2])))],
        4: [("Apache-2.0", 100, "line", 1)],
        5: [("Apache-2.0", 100, "line", 1), ("Apache-2.0", 100, "window", 22)],
        6: [],
    }


def test_tables_of_words_stay_and_noise_goes(spark):
    table = " | ".join(words(60, "cell").split())
    rows = [(1, table), (2, " ".join(w + "$$$ ###" for w in words(40, "x").split())), (3, words(30, "plain"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [1, 3]


def test_letters_and_their_marks():
    assert language_id._WORD.findall("½ ② ² 12 _") == []
    assert language_id._WORD.findall("नमस्ते दुनिया a1é́") == ["नमस्ते", "दुनिया", "a", "é́"]


ODD_WORDS = ["ΑΣ", "Σ", "İz", "ß", "中文字", "𝔘𝔫𝔦", "𞤀𞤁", "नमस्ते", "naïve", "ǅ", "o" * 3000, "a"]


def plain_slots(word):
    padded = f"^{word.lower()}$"
    grams = (padded[i : i + 3] for i in range(len(padded) - 2))
    return [xxhash.xxh3_64_intdigest(gram) % language_id.SLOTS for gram in grams]


def test_words_go_by_category_on_every_plane():
    rng, pools = random.Random(4), {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        kind = unicodedata.category(c)[0]
        pools.setdefault((kind if kind in "LM" else "", c > "\uffff"), []).append(c)
    pools = list(pools.values())
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 25)))
        want = [""]
        for c in text:
            kind = unicodedata.category(c)[0]
            if kind == "L" or kind == "M" and want[-1]:
                want[-1] += c
            elif want[-1]:
                want.append("")
        assert language_id._WORD.findall(text) == [w for w in want if w]


def test_words_cost_little_more_than_by_a_plain_class():
    text = "an olé of 3 — ça va 😀 " * 20_000

    def seconds(pattern):
        took = []
        for _ in range(3):
            began = time.process_time()
            pattern.findall(text)
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(language_id._WORD) < 4 * seconds(re.compile(r"[^\W\d_]+"))


def test_a_trigram_is_hashed_once(monkeypatch):
    hashed = []

    def digest(gram):
        hashed.append(gram)
        return xxhash.xxh3_64_intdigest(gram)

    monkeypatch.setattr(language_id, "xxhash", SimpleNamespace(xxh3_64_intdigest=digest))
    scores = np.random.default_rng(1).normal(size=(2, language_id.SLOTS)).astype(np.float32)
    model = language_id.Model(["a", "b"], scores, np.ones((len(language_id.SCRIPTS) + 1, 2), bool))
    words = ["".join(w) for w in itertools.product("abcd", repeat=5)]
    model.score(words)
    assert len(hashed) == len(set(hashed)) == 4**3 + 2 * 4**2


def test_slots_and_counts_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(language_id, "BATCH_LETTERS", 7)
    monkeypatch.setattr(language_id, "KNOWN_WORDS", 5)
    flat, sizes = language_id.slots_of(ODD_WORDS)
    assert sizes.tolist() == [len(plain_slots(w)) for w in ODD_WORDS]
    assert flat.tolist() == [x for w in ODD_WORDS for x in plain_slots(w)]
    rng = random.Random(6)
    rows = [(rng.choice("xy"), rng.choices(ODD_WORDS, k=rng.randrange(9))) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(w) or None for _, w in rows], "lang": [k for k, _ in rows]})
    got, want = Counter(), Counter()
    for part in language_id._count(iter([batch.slice(0, 25), batch.slice(25)])):
        for r in part.to_pylist():
            got[r["lang"], r["kind"], r["slot"]] += r["n"]
    for lang, words in rows:
        want.update((lang, 0, x) for w in words for x in plain_slots(w))
        for w in words:
            fits = [k for k, (_, a, b) in enumerate(language_id.SCRIPTS) if a <= ord(w[0]) <= b]
            want[lang, 1, (fits or [len(language_id.SCRIPTS)])[0]] += 1
    assert got == want


def test_texts_of_any_length_equal_plain_labels(spark, monkeypatch):
    langs, kinds = ["a", "b", "c"], len(language_id.SCRIPTS) + 1
    scores = np.random.default_rng(3).normal(0, 2, (3, language_id.SLOTS)).astype(np.float32)
    uses = np.ones((kinds, 3), bool)
    uses[0, 2] = False
    rng = random.Random(9)
    pool = ODD_WORDS + ["".join(rng.choices("abcdef", k=4)) for _ in range(60)]
    texts = [rng.choices(pool, k=rng.choice([0, 1, 2, 3, 30, 200])) for _ in range(80)]
    texts += texts[:9]
    model = language_id.Model(langs, scores, uses)
    docs = spark.createDataFrame(
        [(i, " ".join(words) if i % 7 else f"7 {' '.join(words)}!") for i, words in enumerate(texts)] + [(None, None)],
        "doc_id bigint, text string",
    ).coalesce(2)
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert found[None][1:] == ("und", 0, [])
    for i, words in enumerate(texts):
        best, came, worth = np.zeros(3, np.float32), [], []
        for word in words:
            raw = scores[:, plain_slots(word)].sum(axis=1)
            raw[~uses[language_id.scripts([word])[0]]] = -np.inf
            worth.append(np.maximum(raw - raw.max(), -language_id.CLIP))
            jump = best.max() - language_id.SWITCH
            came.append([int(best.argmax()) if jump > best[k] else k for k in range(3)])
            best = np.maximum(best, jump) + worth[-1]
        path = [int(best.argmax())] if words else []
        for back in reversed(came[1:]):
            path.append(back[path[-1]])
        mass = Counter()
        for k, word in zip(reversed(path), words):
            mass[langs[k]] += len(word)
        want = [langs[k] for k in reversed(path)]
        assert [x["lang"] for x in found[i]["spans"] for _ in range(x["words"])] == want
        assert [x["first"] for x in found[i]["spans"]] == [t for t in range(len(want)) if not t or want[t] != want[t - 1]]
        if words:
            top = max(sorted(mass), key=mass.__getitem__)
            assert found[i]["lang_pred"] == top
            assert found[i]["score"] == pytest.approx(mass[top] / sum(mass.values()))
        else:
            assert found[i]["lang_pred"] == "und" and found[i]["score"] == 0


def test_short_pieces_fill_their_sequences(spark):
    for length, n in ((1, 9000), (3, 3000), (10, 2000), (17, 1000), (31, 700)):
        pieces = spark.range(n).select(
            F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("start"),
            F.lit(length).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("ids_crc32"),
            F.lit(length).cast("bigint").alias("doc_tokens"), F.lit(4096 // length).alias("class"),
            F.xxhash64("id").alias("key"),
        )
        found = packing.place(pieces, 4096).toPandas()
        sizes = found.groupby("sequence_id").length.sum()
        assert sizes.max() <= 4096 and len(found) == n
        assert len(sizes) <= -(-n // (4096 // length))


def test_a_loose_bound_loses_no_links(spark):
    pool = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = random.Random(i // 4).sample(pool, 30)
        rows.append((i, " ".join(base[: 12 + 6 * (i % 4)])))
    rows += [(None, rows[0][1])] * 25 + [(None, rows[5][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for percent in (50, 60):
        got = jaccard_join.jaccard_classes(docs, size=1, percent=percent).collect()
        sets = {i: set(t.split()) for i, t in rows if i is not None}
        up = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        up[a] = up[b] = min(up[a], up[b])
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == up
        assert len(got) == len(rows)
