"""Fixed-length training sequences by harmonic packing.

A document's tokens are cut into pieces. A piece of length l is of class k when
capacity/(k+1) < l <= capacity/k: k pieces of that class share a sequence, whatever their
exact lengths, so workers fill the sequences of a class with k pieces each and need not ask
one another. A piece that would waste more than ``waste`` of its share is cut at the next
reciprocal of the capacity, so that the front part fills its share and only the tail is
classed anew.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtables.llm.worker import kept
from logtables.scratch import materialise

CAPACITY = 4096
#: Smallest piece that a cut may leave, and the share of a place that may stay empty.
SHORTEST, WASTE = 32, 0.04
#: Pieces that one worker numbers within a class.
RUN = 50_000
#: Words whose ids a worker keeps, besides as many from before.
KNOWN = 400_000

# Letters of which case, composition and class are the same to Python and to the tokenizer.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xffĀ-įı-ſ]*")
_SPECIAL = "<|"


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    The tokenizer takes about a second per megabyte, nearly all of it for words it has seen
    before. For plain Latin text the words are therefore cut here, by the tokenizer's own
    pattern, and the ids of each known word are kept; any other text goes to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters = "a-z\xdf-\xf6\xf8-\xffĀ-įı-ſ"
        self.words = re.compile(
            pattern.replace(r"\p{L}", letters).replace(r"\p{N}", "0-9"), re.ASCII
        )
        end = spec["model"]["end_of_word_suffix"]
        vocabulary = spec["model"]["vocab"]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(end)]] = True

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """All new words as one text: the last id of each has the end-of-word mark."""
        ids = self._encoded(" ".join(words))
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words):
            for word in words:
                self.known[word] = self._encoded(word).tobytes()
            return
        data, at = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist()):
            self.known[word] = data[at:end]
            at = end

    def ids(self, text: str) -> bytes:
        if _SPECIAL in text or not _PLAIN.fullmatch(text):
            return self._encoded(text).tobytes()
        words = self.words.findall(text.lower())
        if len(self.known) > KNOWN:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = [w for w in set(words) if w not in known]
        if new:
            known.update((w, before[w]) for w in new if w in before)
            if new := [w for w in new if w not in before]:
                self._learn(new)
        return b"".join(map(known.__getitem__, words))


def cuts(length: int, capacity: int, shortest: int, waste: float) -> list[int]:
    """Lengths of the pieces, in order, of a document of ``length`` tokens."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        part = k + 1
        while rest - capacity // part < shortest and capacity // part >= shortest:
            part += 1  # else the tail would be too short
        place = capacity // part
        if 1 - k * rest / capacity <= waste or place < shortest:
            out.append(rest)
            break
        out.append(place)
        rest -= place
    return out


def _pieces(path: str, end_id: int, capacity: int, shortest: int, waste: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept(("tokens", path), lambda: Tokens(path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = tokens.ids(text or "") + end
                at = 0
                for n in cuts(len(ids) // 4, capacity, shortest, waste):
                    rows.append(k)
                    starts.append(at)
                    lengths.append(n)
                    crcs.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    totals.append(len(ids) // 4)
                    at += n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def pack(
    documents: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    shortest: int = SHORTEST,
    waste: float = WASTE,
) -> DataFrame:
    """Pieces of all ``documents`` with their places in sequences of ``capacity`` tokens.

    ``tokenizer`` is the path of a tokenizer file, the same on all workers. Gives ``doc_id``,
    ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``.
    Each document, a null, empty or repeated one too, is its ids and then ``end_id``; a null
    or empty text is the end id alone. Other columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    cut = docs.mapInArrow(_pieces(tokenizer, end_id, capacity, shortest, waste), schema)
    kind = F.floor(F.lit(capacity) / F.col("length")).cast("int")
    # rows that repeat must spread too, so the key counts rows; written, it stays
    key = F.xxhash64(F.monotonically_increasing_id())
    pieces = materialise(cut.withColumns({"class": kind, "key": key}), "pieces")
    return place(pieces, capacity)


def place(pieces: DataFrame, capacity: int, run: int = RUN) -> DataFrame:
    """Sequences for classed pieces: full ones of each class, then the few pieces left.

    Each class is dealt to as many workers as its size asks for. A worker numbers its pieces
    and closes a sequence after every k. What is over (fewer than k pieces each) is dealt
    again to fewer workers, until one has a class. Then fewer than k pieces a class are over.
    There is a class for each number that a length goes into ``capacity``, about twice its
    root of them, so this is a bounded number however many documents there are (at 4096 no
    more than 25,000); they go largest first into the first sequence with room.
    """
    left, done, level = pieces, [], 0
    while True:
        sizes = {r["class"]: r["count"] for r in left.groupBy("class").count().collect()}
        salts = {k: -(-n // max(run, 4 * k)) for k, n in sizes.items()}
        many = F.element_at(_constants(salts or {1: 1}), F.col("class"))
        dealt = left.withColumn("salt", F.pmod("key", many).cast("int"))
        group = Window.partitionBy("class", "salt")
        order = ["key", "start"]
        numbered = dealt.withColumns(
            {
                "n": F.row_number().over(group.orderBy(*order)) - 1,
                "size": F.count("*").over(group),
            }
        )
        full = F.col("n") < F.col("size") - F.col("size") % F.col("class")
        numbered = materialise(numbered.withColumn("full", full), "placed")
        done.append(
            numbered.filter("full").withColumn(
                "sequence_id",
                _sequence_number(level, F.col("class"), F.col("salt"), F.floor(F.col("n") / F.col("class"))),
            )
        )
        left = numbered.filter("not full").drop("n", "size", "full", "salt")
        level += 1
        if max(salts.values(), default=1) == 1:
            break
    rest = left.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
        _first_fit(capacity, level), left.withColumn("sequence_id", F.lit(0).cast("long")).schema
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "key", "sequence_id"]
    found = functools.reduce(DataFrame.unionByName, (d.select(columns) for d in [*done, rest]))
    within = Window.partitionBy("sequence_id").orderBy("key", "start")
    offset = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("offset", offset - F.col("length")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def _constants(values: dict[int, int]):
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _sequence_number(level: int, kind, salt, number):
    """One number for (level, class, worker, sequence there): 3, 12, 28 and 20 bits."""
    return (
        F.lit(level).cast("bigint") * F.lit(1 << 60)
        + (kind - 1).cast("bigint") * F.lit(1 << 48)
        + salt.cast("bigint") * F.lit(1 << 20)
        + number.cast("bigint")
    )


def _first_fit(capacity: int, level: int):
    def run(pdf):
        pdf = pdf.drop(columns="one").sort_values(
            ["length", "key", "start"], ascending=[False, True, True], kind="stable"
        )
        room = np.empty(0, np.int64)
        places = []
        for length in pdf["length"]:
            fits = np.flatnonzero(room >= length)
            if len(fits):
                at = fits[0]
            else:
                at, room = len(room), np.append(room, capacity)
            room[at] -= length
            places.append(at)
        pdf["sequence_id"] = np.array(places, np.int64) + (level << 60)
        return pdf

    return run
