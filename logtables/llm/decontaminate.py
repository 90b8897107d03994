"""Benchmark passages in documents, by Wu-Manber search for many patterns.

The symbols are words. All windows of an item are patterns; patterns of one length share a
searcher, so that a few short items don't shorten the jumps for the long ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtables.llm.worker import kept

#: Bytes of benchmark text that one search holds. A larger benchmark is cut into parts of
#: about this size, which the documents pass one after the other, without a shuffle.
PART_BYTES = 32 << 20

_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_SPACED = bytes(b if b in _WORD else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of 0-9, a-z and characters beyond ASCII, A-Z lower-cased; null has none."""
    return (text or b"").lower().translate(_SPACED).split()


class WuManber:
    """Finds all of some patterns, each ``length`` words long."""

    def __init__(self, patterns: dict[tuple, set], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            bucket = self.buckets.setdefault(pattern[-self.block :], {})
            bucket.setdefault(pattern[: self.block], []).append((list(pattern), owners))

    def find(self, words: list) -> Iterator[tuple[int, set]]:
        """Start and owners of each occurrence, overlapping ones too."""
        m, b, shift, default = self.length, self.block, self.shift, self.default
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b : end])
            step = shift.get(block, default)
            if step:
                end += step
                continue
            start = end - m
            for pattern, owners in self.buckets[block].get(tuple(words[start : start + b]), ()):
                if words[start:end] == pattern:
                    yield start, owners
            end += 1


def searchers(items: list[tuple], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple, set]] = {}
    for item_id, text in items:
        words = words_of(text)
        width = min(window, len(words))
        for i in range(len(words) - width + 1 if width else 0):
            patterns = by_length.setdefault(width, {})
            patterns.setdefault(tuple(words[i : i + width]), set()).add(item_id)
    return [WuManber(patterns, width) for width, patterns in sorted(by_length.items())]


def _scan(shared, key: str, window: int):
    """Adds the occurrences of one part of the benchmark to those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = kept(("passages", key, window), lambda: searchers(shared.value, window))
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
            items, counts = batch.column("items").to_pylist(), []
            for k, text in enumerate(texts):
                words = words_of(text)
                counts.append(len(words))
                spans, seen = set(zip(starts[k], ends[k])), set(items[k])
                for finder in finders:
                    for at, owners in finder.find(words):
                        spans.add((at, at + finder.length))
                        seen |= owners
                # overlapping spans become one, so a long copied passage stays small
                starts[k], ends[k] = _merged(spans)
                items[k] = sorted(x for x in seen if x is not None)
            rest = batch.drop_columns(["n_words", "starts", "ends", "items"])
            for name, values, kind in (
                ("n_words", counts, pa.int64()),
                ("starts", starts, pa.list_(pa.int64())),
                ("ends", ends, pa.list_(pa.int64())),
                ("items", items, pa.list_(pa.string())),
            ):
                rest = rest.append_column(name, pa.array(values, kind))
            yield rest

    return run


def _merged(spans: set) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for a, b in sorted(spans):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column("items").to_pylist()
        digests = [sha256(",".join(x).encode()).hexdigest() for x in items]
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        hit = [int(np.sum(b) - np.sum(a)) if a else 0 for a, b in zip(starts, ends)]
        yield batch.append_column("n_hit", pa.array(hit, pa.int64())).append_column(
            "items_sha256", pa.array(digests, pa.string())
        )


def clean_only(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``documents``, all their columns, without any benchmark passage."""
    docs = documents.select(F.struct("*").alias("document"), "text")
    found = find_passages(docs, benchmark, window, keep=("document",))
    return found.filter("not contaminated").select("document.*")


def find_passages(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    keep: tuple[str, ...] = ("doc_id",),
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Benchmark windows in each document, one row per row of ``documents``.

    Gives the ``keep`` columns, ``n_words``, ``n_hit`` (words inside occurrences),
    ``starts`` and ``ends`` (word spans, end exclusive, joined where they touch), ``items``
    (sorted ids, as strings, of items found), ``n_items``, ``items_sha256`` and
    ``contaminated``. A window is ``window`` consecutive words of an item; a shorter item is
    one window, one without words none. Null texts have no words. Items that share an id
    count once; windows of an item without id hit words, but name no item. Columns not in
    ``keep`` are ignored.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = 1 + total // part_bytes
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts))
    empty = F.array().cast("array<bigint>")
    names = [f"keep_{i}" for i in range(len(keep))]
    df = documents.select(
        *(F.col(c).alias(k) for c, k in zip(keep, names)),
        F.col("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        empty.alias("starts"),
        empty.alias("ends"),
        F.array().cast("array<string>").alias("items"),
    )
    for number in range(n_parts):
        # at most about part_bytes, whatever the size of the benchmark
        rows = [(i, (t or "").encode()) for i, t in items.filter(part == number).collect()]
        shared = spark.sparkContext.broadcast(rows)
        order = [c for c in df.columns if c not in ("n_words", "starts", "ends", "items")]
        df = df.select(*order, "n_words", "starts", "ends", "items")
        df = df.mapInArrow(_scan(shared, uuid.uuid4().hex, window), df.schema)
    df = df.drop("text")
    more = [T.StructField("n_hit", T.LongType()), T.StructField("items_sha256", T.StringType())]
    df = df.mapInArrow(_sealed, T.StructType([*df.schema.fields, *more]))
    return df.select(
        *(F.col(k).alias(c) for c, k in zip(keep, names)),
        "n_words",
        "n_hit",
        "starts",
        "ends",
        "items",
        F.size("items").cast("bigint").alias("n_items"),
        "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )

