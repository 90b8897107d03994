"""Operators 2, 6, 7 and 8, and the pipeline: laws, round trips, held-out accuracy."""

import datetime
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logtables.llm import kd_shards, language_id, packing, pseudonyms
from logtables.llm.queries import QUERIES, tokenizer_path

from . import brute
from .conftest import EDGE, PROSE

SF = "/root/testdata/sf0.001"


def test_shards_are_near_equal_and_slots_gapless(spark, edge, nothing):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(400)) for i in range(600)]
    rows += [(i, PROSE) for i in range(600, 900)]  # a third: copies, some of one id
    rows += [(600, PROSE)] * 20 + [(None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = kd_shards.shard(docs, 10).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["size"].sum()
    assert set(sizes.index) == set(range(10))
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    want = Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert Counter(zip(got["size"], got["text_crc32"])) == want
    assert kd_shards.shard(nothing, 10).count() == 0
    assert kd_shards.shard(edge, 40).count() == len(EDGE)


def test_cuts_follow_the_widest_axis(spark):
    docs = spark.createDataFrame([(i, "ab") for i in range(64)], "doc_id bigint, text string")
    axes = {"x": F.col("doc_id") % 8, "y": F.floor(F.col("doc_id") / 8) * 100}
    got = kd_shards.shard(docs, 2, axes).toPandas()
    # both are full width, so the first is cut, at its median
    assert set(got[got["shard"] == 0]["doc_id"] % 8) == {0, 1, 2, 3}


def small_model():
    langs = ["a", "b"]
    scores = np.zeros((2, language_id.SLOTS), np.float32)
    for lang, word in ((0, "aha"), (1, "obo")):
        for slot in language_id.slots(word):
            scores[lang, slot] = 3
    uses = np.ones((len(language_id.SCRIPTS) + 1, 2), bool)
    return language_id.Model(langs, scores, uses)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["aha", "obo", "aho", "x"]), max_size=9), min_size=1, max_size=6))
def test_labels_are_the_best_path(texts):
    import itertools

    model = small_model()
    for words, labels in zip(texts, model.label(texts)):
        if not words:
            assert len(labels) == 0
            continue
        scores = model.score(words)

        def worth(path):
            switches = sum(a != b for a, b in itertools.pairwise(path))
            return sum(scores[i, k] for i, k in enumerate(path)) - language_id.SWITCH * switches

        best = max(map(worth, itertools.product(range(2), repeat=len(words))))
        assert abs(worth(labels.tolist()) - best) < 1e-4


def test_language_is_learnt(spark, edge, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op6_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count() > 0
    model = language_id.learn(docs)
    found = {r["doc_id"]: r for r in language_id.identify(edge, model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (3, 4, 5, 11))
    assert found[1]["lang_pred"] in model.langs and 0 < found[1]["score"] <= 1
    assert language_id.identify(nothing, model).count() == 0
    unlearnt = language_id.learn(nothing)
    assert {r["lang_pred"] for r in language_id.identify(edge, unlearnt).collect()} == {"und"}


def test_mixed_text_has_spans(spark):
    model = small_model()
    docs = spark.createDataFrame([(1, "aha " * 9 + "obo " * 5)], "doc_id bigint, text string")
    row = language_id.identify(docs, model).first()
    assert [tuple(s) for s in row["spans"]] == [("a", 0, 9), ("b", 9, 5)]
    assert row["lang_pred"] == "a" and row["score"] == pytest.approx(27 / 42)


KEY = b"test"


@pytest.mark.parametrize("radices", [[10, 10, 10], [7], [3, 5, 2]])
def test_pseudonyms_permute(radices):
    n = int(np.prod(radices))
    seen = set()
    for value in range(n):
        digits, rest = [], value
        for r in reversed(radices):
            rest, d = divmod(rest, r)
            digits.insert(0, d)
        new = pseudonyms.permuted(digits, radices, KEY, b"t")
        assert pseudonyms.permuted(new, radices, KEY, b"t", back=True) == digits
        seen.add(tuple(new))
    assert len(seen) == n


PRIVATE = (
    "Call +1 (651) 555-8500 or 4720843956327691, 4111 1111 1111 1111, mail the.72@mail3.example.com "
    "from 169.122.221.182 born 1980-02-29, 31/12/1999, 12/31/2001 account DE89 3704 0044 0532 0130 00 "
    "ssn 123-45-6789"
)


def test_values_keep_their_form_and_links(spark, edge, nothing):
    new, spans = pseudonyms.pseudonymise(PRIVATE, KEY)
    assert [k for k, _, _ in spans] == "phone card card mail ip date date date iban ssn".split()
    assert pseudonyms.pseudonymise(new, KEY, back=True)[0] == PRIVATE
    values = {k: new[a:b] for k, a, b in spans}
    assert all(old not in new for old in ("555-8500", "4720843956327691", "the.72@", "169.122"))
    cards = [new[a:b] for k, a, b in spans if k == "card"]
    assert not pseudonyms.luhn(pseudonyms._digits_of(cards[0]))
    assert pseudonyms.luhn(pseudonyms._digits_of(cards[1])) and cards[1].count(" ") == 3
    assert pseudonyms._is_iban(values["iban"]) and values["iban"].startswith("DE")
    datetime.date.fromisoformat(new[spans[5][1] : spans[5][2]])
    for plain in ("13/13/2000", "999.1.1.1", "12-34", "version 3.0.1", "2024", None, ""):
        assert pseudonyms.pseudonymise(plain, KEY) == (plain, [])
    again, _ = pseudonyms.pseudonymise("x 4720843956327691 y", KEY)
    assert cards[0] in again
    found = pseudonyms.replace_private(edge, KEY)
    back = pseudonyms.replace_private(found, KEY, back=True)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(
        map(str, edge.select("doc_id", "text").collect())
    )
    assert pseudonyms.replace_private(nothing, KEY).count() == 0


@given(st.integers(1, 70_000))
def test_pieces_add_up(length):
    cuts = packing.cuts(length, 4096, 32, 0.04)
    assert sum(cuts) == length and all(0 < c <= 4096 for c in cuts)
    for c in cuts:
        assert c < 4096 // 23 or 1 - (4096 // c) * c / 4096 <= 0.04


def check_packing(got, texts, capacity=4096):
    """Every id is in one piece; sequences are gapless and hold what they may."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in texts]
    pieces = Counter()
    for (i, _), x in zip(texts, ids):
        at = 0
        for n in packing.cuts(len(x), capacity, packing.SHORTEST, packing.WASTE):
            crc = zlib.crc32(np.array(x[at : at + n], "<u4").tobytes())
            pieces[str(i), at, n, crc, len(x)] += 1
            at += n
    found = Counter(
        (str(None if r.doc_id != r.doc_id else int(r.doc_id)), r.start, r.length, r.ids_crc32, r.doc_tokens)
        for r in got.itertuples()
    )
    assert found == pieces
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert ((ends - got["length"]) == got["offset"]).all() and ends.max() <= capacity
    return ends.groupby(got["sequence_id"]).max()


def test_packing_round_trip(spark, edge, nothing):
    rows = [*EDGE, *((50 + i, f"{PROSE} " * (i * 7 % 90)) for i in range(200)), (60, "Σίσυφος İ ŉ ½ é <|endoftext|> it's we'll")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    fill = check_packing(packing.pack(docs, tokenizer_path()).toPandas(), rows)
    assert fill.sum() >= 0.95 * 4096 * (len(fill) - 1)
    assert packing.pack(nothing, tokenizer_path()).count() == 0
    pieces = docs.mapInArrow(
        packing._pieces(tokenizer_path(), 2, 4096, 32, 0.04),
        "doc_id bigint, start long, length long, ids_crc32 long, doc_tokens long",
    ).withColumns(
        {
            "class": F.least(F.floor(F.lit(4096) / F.col("length")), F.lit(128)).cast("int"),
            "key": F.xxhash64(F.monotonically_increasing_id()),
        }
    )
    # many small workers, several levels
    check_packing(packing.place(pieces, 4096, run=4).toPandas(), rows)


def test_pipeline_equals_brute_force(spark):
    con = duckdb.connect()
    rows = con.execute(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    bench = con.execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    rows = [r for r in rows if brute.quality(r[1])[2]]
    cut = []
    for (i, t), gone in zip(rows, brute.dropped_lines(rows)):
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or brute.words(text):
            cut.append((i, text))
    sets = [brute.shingles(t, 5) for _, t in cut]
    numbers = brute.classes(sets, 80)
    one = [r for k, r in enumerate(cut) if numbers[k] == k or not sets[k]]
    clean = [r for r in one if not brute.hits(r[1], bench, 10)[1]]
    assert len(clean) < len(one) < len(cut) and len(clean) > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, stage(spark, docs, SF)
        assert docs.columns == before
    got = docs.toPandas()
    assert sorted(zip(got["doc_id"], got["text"])) == sorted(clean)
    assert (got["n_chars"] == got["text"].str.len()).all()
    check_packing(corpus_pipeline.run(spark, SF).toPandas(), clean)


def test_pipeline_takes_edge_cases(spark, edge, nothing):
    for docs in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
        assert docs.columns == edge.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
