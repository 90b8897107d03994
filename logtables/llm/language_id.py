"""Language of texts, and of spans of mixed texts.

Scripts narrow the candidates of a word; each candidate scores it by its letter trigrams;
Viterbi with a penalty for each switch labels the words, so that a span has one language.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.llm.worker import kept

#: Labelled rows per language that the model is learnt from, at most (about; by hash).
ROWS_PER_LANGUAGE = 20_000
#: Slots that trigrams are hashed to: with the languages, the size of the model.
SLOTS = 1 << 15
#: What a switch costs, in nats, and the most that one word may say for a language.
SWITCH, CLIP = 8.0, 6.0
#: Share of a script below which a language doesn't use it.
RARE = 0.01
#: Distinct words whose scores or counts a worker keeps.
KNOWN_WORDS = 300_000
#: Words that the labelling holds at once, and letters whose trigrams are hashed at once.
BATCH_WORDS = 1_000_000
BATCH_LETTERS = 1_000_000


def _word_pattern() -> re.Pattern:
    """A letter, then letters and the marks on them, by Unicode category; no number signs.

    A class up to U+FFFF is one lookup for ``re``, while ranges above are tried one by one;
    so these have classes of their own, and only characters that are above meet them.
    """
    kinds = "".join(unicodedata.category(chr(i))[0] for i in range(0x110000))

    def ranges(kind: str, first: int, last: int) -> str:
        spans = (m.span() for m in re.finditer(f"{kind}+", kinds[first : last + 1]))
        return "".join(f"\\U{first + a:08x}-\\U{first + b - 1:08x}" for a, b in spans)

    letters, marked = (ranges(kind, 0, 0xFFFF) for kind in ("L", "[LM]"))
    high_letters, high_marked = (ranges(kind, 0x10000, 0x10FFFF) for kind in ("L", "[LM]"))
    high = "\\U00010000-\\U0010ffff"
    return re.compile(
        f"[{letters}{high}](?:(?<![{high}])|(?<=[{high_letters}]))"
        f"[{marked}]*(?:(?=[{high}])[{high_marked}]+[{marked}]*)*"
    )


_WORD = _word_pattern()
#: First and last code points of scripts, from the Unicode block list.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("thai", 0x0E00, 0x0E7F),
    ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF),
)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def scripts(words: list[str]) -> np.ndarray:
    """Numbers of the scripts of the first letters; len(SCRIPTS) for any other."""
    points = _points("".join(word[0] for word in words))
    out = np.full(len(points), len(SCRIPTS))
    for k, (_, first, last) in enumerate(SCRIPTS):
        out[(first <= points) & (points <= last)] = k
    return out


def slots(word: str) -> list[int]:
    return slots_of([word])[0].tolist()


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams of all words, and how many each has; a trigram is hashed once."""
    lowered = [word.lower() for word in words]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = _points(f"^{'$^'.join(lowered)}$").astype(np.uint64)
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    whole = np.ones(len(codes), bool)  # not over the end of a word
    ends = np.cumsum(sizes + 2)[:-1]
    whole[ends - 2] = whole[ends - 1] = False
    grams, which = np.unique(codes[whole], return_inverse=True)
    found = [
        xxhash.xxh3_64_intdigest(chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF)) % SLOTS
        for g in grams.tolist()
    ]
    return np.array(found, np.int64)[which], sizes


def _parts(words: list[str]) -> Iterator[list[str]]:
    """The words in parts of about BATCH_LETTERS letters."""
    upto = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    first = 0
    while first < len(words):
        held = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, held + BATCH_LETTERS, side="right")))
        yield words[first:last]
        first = last


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (language, kind, slot): trigrams (0) and scripts (1)."""
    counts: dict[str, list[np.ndarray]] = {}
    words: dict[str, Counter] = {}

    def settle(lang: str) -> None:
        grams, used = counts.setdefault(
            lang, [np.zeros(SLOTS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)]
        )
        seen = words.pop(lang)
        for part in _parts(list(seen)):
            times = np.fromiter(map(seen.__getitem__, part), np.int64, len(part))
            found, sizes = slots_of(part)
            grams += np.bincount(found, np.repeat(times, sizes), SLOTS).astype(np.int64)
            used += np.bincount(scripts(part), times, len(used)).astype(np.int64)

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            words.setdefault(lang, Counter()).update(_WORD.findall(text or ""))
            if len(words[lang]) > KNOWN_WORDS:
                settle(lang)
    for lang in list(words):
        settle(lang)
    for lang, kinds in counts.items():
        for kind, values in enumerate(kinds):
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(at), pa.string()),
                    pa.array(np.full(len(at), kind, np.int32)),
                    pa.array(at.astype(np.int32)),
                    pa.array(values[at]),
                ],
                names=["lang", "kind", "slot", "n"],
            )


class Model:
    def __init__(self, langs: list[str], scores: np.ndarray, uses: np.ndarray):
        self.langs, self.scores, self.uses = langs, scores, uses
        self.by_slot = np.ascontiguousarray(scores.T)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.table = np.empty((0, len(self.langs)), np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """What each word says for each language, the best at 0; no candidate far below."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        new = list(islice(self.known, len(self.table), None))
        self.table = np.concatenate([self.table, *map(self._score, _parts(new))])
        found = self.table[at]
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        return found

    def _score(self, words: list[str]) -> np.ndarray:
        found, sizes = slots_of(words)
        raw = np.add.reduceat(self.by_slot[found], np.cumsum(sizes) - sizes, axis=0)
        uses = self.uses[scripts(words)]
        uses |= ~uses.any(axis=1, keepdims=True)
        raw = np.where(uses, raw, -np.inf)
        return np.maximum(raw - raw.max(axis=1, keepdims=True), -CLIP).astype(np.float32)

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Languages of the words of each text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        labels = self.label_words(list(chain.from_iterable(texts)), lengths)
        ends = np.cumsum(lengths)
        return [labels[a:b] for a, b in zip(ends - lengths, ends)]

    def label_words(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        """Languages of the words of texts of these lengths, all texts going forward together.

        From ``firsts[t]`` on come the words numbered t, those of the longest text first.
        """
        n, longest = len(words), int(lengths.max(initial=0))
        if not n:
            return np.empty(0, np.int64)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        starts = np.cumsum(lengths) - lengths
        lives = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
        firsts = np.r_[0, np.cumsum(lives)]
        place = firsts[np.arange(n) - np.repeat(starts, lengths)] + np.repeat(rank, lengths)
        best = np.empty((len(self.langs), n), np.float32)
        best[:, place] = self.score(words).T
        firsts = firsts.tolist()
        for t in range(1, longest):
            was, now = firsts[t - 1], slice(firsts[t], firsts[t + 1])
            last = best[:, was : was + now.stop - now.start]
            best[:, now] += np.maximum(last, last.max(axis=0) - SWITCH)
        top, peak = np.zeros(n, np.int64), best[0].copy()
        for k in range(1, len(best)):
            top[best[k] > peak] = k
            np.maximum(peak, best[k], out=peak)
        moves = best < peak - SWITCH  # came from the top
        labels, at = top.copy(), np.arange(n)
        for t in range(longest - 1, 0, -1):
            label = labels[firsts[t] : firsts[t + 1]]
            was = slice(firsts[t - 1], firsts[t - 1] + len(label))
            labels[was] = np.where(moves[label, at[was]], top[was], label)
        return labels[place]


def learn(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model from ``text`` and ``lang``; rows without either teach nothing.

    A language of more than ``rows_per_language`` rows is thinned by a hash of its texts to
    about that many. Counting is distributed; at most SLOTS numbers per language come back.
    """
    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    # only languages of many rows are thinned, and there can't be many of those
    large = rows.groupBy("lang").count().filter(F.col("count") > rows_per_language).collect()
    place = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20))
    taken = F.lit(True)
    for lang, n in large:
        share = int((1 << 20) * rows_per_language / n)
        taken = F.when(F.col("lang") == lang, place < share).otherwise(taken)
    rows = rows.filter(taken)
    counted = rows.select("text", "lang").mapInArrow(_count, "lang string, kind int, slot int, n bigint")
    table = counted.groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    grams = np.zeros((len(langs), SLOTS))
    used = np.zeros((len(langs), len(SCRIPTS) + 1))
    for (lang, kind), part in table.groupby(["lang", "kind"]):
        (grams, used)[kind][langs.index(lang), part["slot"]] = part["n"]
    scores = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * SLOTS))
    uses = (used / np.maximum(used.sum(axis=1, keepdims=True), 1)).T >= RARE
    return Model(langs, scores.astype(np.float32), uses)


def spans(labels: np.ndarray, words: list[str], langs: list[str]) -> list[tuple[str, int, int]]:
    """(language, first word, words) of a labelled text."""
    out, at = [], 0
    for label, run in groupby(labels.tolist()):
        n = sum(1 for _ in run)
        out.append((langs[label], at, n))
        at += n
    return out


def _predict(shared, key: str, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("language", key), lambda: Model(*shared.value))
        langs = model.langs

        def emit(rows: pa.RecordBatch, words: list[str], lengths: np.ndarray) -> pa.RecordBatch:
            n, some = len(lengths), lengths > 0
            preds, scores = np.full(n, "und", object), np.zeros(n)
            found: list[list[dict]] = [[] for _ in range(n)]
            if words and langs:
                labels = model.label_words(words, lengths)
                sizes = np.fromiter(map(len, words), np.float64, len(words))
                cells = np.repeat(np.arange(n), lengths) * len(langs) + labels
                mass = np.bincount(cells, sizes, n * len(langs)).reshape(n, -1)[some]
                preds[some] = np.array(langs, object)[mass.argmax(axis=1)]
                scores[some] = mass.max(axis=1) / mass.sum(axis=1)
                ends = np.cumsum(lengths).tolist()
                for k, (a, b) in enumerate(zip([0, *ends], ends)) if with_spans else ():
                    found[k] = [
                        {"lang": lang, "first": first, "words": held}
                        for lang, first, held in spans(labels[a:b], words[a:b], langs)
                    ]
            kind = pa.list_(
                pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())])
            )
            return (
                rows.drop_columns(["text"])
                .append_column("lang_pred", pa.array(preds, pa.string()))
                .append_column("score", pa.array(scores, pa.float64()))
                .append_column("spans", pa.array(found, kind))
            )

        for batch in batches:
            words, lengths, first = [], [], 0
            for k, text in enumerate(batch.column("text").to_pylist()):
                mine = _WORD.findall(text or "")
                words += mine
                lengths.append(len(mine))
                if len(words) >= BATCH_WORDS:
                    yield emit(batch.slice(first, k + 1 - first), words, np.array(lengths))
                    words, lengths, first = [], [], k + 1
            if lengths:
                yield emit(batch.slice(first), words, np.array(lengths))

    return run


def identify(documents: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``spans`` for every row of ``documents``.

    The prediction is the language that most letters are labelled with, ``score`` its share
    of them; ties go to the first name. A null text, one without letters, or a model
    without languages gives ``und`` with score 0 and no spans. Rows that repeat are
    predicted alike; other columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.scores, model.uses))
    docs = documents.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, lang_pred string, score double, "
        "spans array<struct<lang:string,first:bigint,words:bigint>>"
    )
    return docs.mapInArrow(_predict(shared, uuid.uuid4().hex, with_spans), schema)
