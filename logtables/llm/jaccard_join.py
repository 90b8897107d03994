"""Exact similarity join of word shingles, and the classes its links make.

Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets.

1. Equal sets collapse to one (a digest of the set).
2. Routing. Sets that link differ in few shingles: for sizes up to ``hi`` in at most
   k = floor((100 - percent) * 2 * hi / (100 + percent)). Shingles are dealt into more than
   k parts by the leading bits of their hash, so that more than k parts have two shingles or
   more. Some of these then has no difference, and its digest is a key both sets emit. The
   few sets with too many small parts also emit their leading shingles, of which linked sets
   share one. Whatever links therefore meets under a key; unrelated sets hardly ever do.
3. The sets that meet, directly or over others, form a group. Within a group, cut into
   blocks of bounded size, T-occurrence search by DivideSkip finds the links: short
   inverted lists are merged by a heap, long ones probed by bisection, and a set stays when
   its count reaches the overlap its size asks for. A pair already connected is skipped, so
   a block gives a spanning forest rather than all pairs.
4. Connected components of the links.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtables.llm.links import components
from logtables.scratch import forget, materialise, released

#: Shingles of a block; a search task holds two blocks.
BLOCK_SHINGLES = 400_000
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 200_000
#: Weight of a probe against a merge step, of the DivideSkip heuristic.
MU = 0.0085
#: Sizes are banded from FIRST on, each band BAND times the one before.
FIRST, BAND = 10, 1.5


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = x * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (A-Z lower-cased)."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out + hashes[k : len(words) - width + 1 + k], 0x9E3779B97F4A7C15)
    return np.unique(out)


def _digest(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _bands(n: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """Of all sizes from ``n`` to the largest that links with it: the band's number, the most
    differences there, the parts."""
    number, high = 0, FIRST
    while True:
        if n < high:
            most = (100 - percent) * 2 * (high - 1) // (100 + percent)
            spare = 2 + most * (100 - percent) // 130  # for parts of fewer than two shingles
            yield number, most, most + 1 + (spare if most else 0)
            if n * 100 // percent < high:
                return
        number, high = number + 1, int(high * BAND)


def signatures(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which linked sets share at least one."""
    n = len(tokens)
    out = []
    for number, most, parts in _bands(n, percent):
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        full = np.diff(np.r_[starts, n]) >= (2 if most else 1)
        sums = np.add.reduceat(_mixed(tokens, 0xC2B2AE3D27D4EB4F), starts)
        # the digest of a part: its number, count and shingles
        tag = part[starts] + np.uint64(number * 0x100000000)
        keys = _mixed(_mixed(sums, 0x9E3779B97F4A7C15) + tag, 0xD6E8FEB86659FD93)
        out.append(keys[full])
        # the most that a set of this size can differ in from one it links with
        differ = min(most, (100 - percent) * (n + n * 100 // percent) // (100 + percent))
        if full.sum() <= differ:  # too many small parts: share a leading shingle instead
            lead = tokens[: n - -(-n * percent // 100) + 1]
            out.append(_mixed(lead + np.uint64(number + 1), 0xA0761D6478BD642F))
    return np.unique(np.concatenate(out))


def _sets(size: int, percent: int):
    """Size and digest of each row's set, and the keys under which it meets others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()

        def rows(part: pa.RecordBatch, sets: list, sigs: list) -> pa.RecordBatch:
            keys = [_digest(s) if n else None for n, s in sets]
            ends = np.cumsum([0, *map(len, sigs)])
            flat = pa.array(np.concatenate([*sigs, np.empty(0, np.uint64)]).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array([n for n, _ in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([k and _short(k) for k in keys], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_key", "short_key", "sigs"],
            )

        for batch in batches:
            sets, sigs, held, first = [], [], 0, 0
            for i, text in enumerate(_texts(batch)):
                tokens = shingle_set(text, size, known)
                sigs.append(signatures(tokens, percent) if len(tokens) else tokens)
                sets.append((len(tokens), tokens))
                held += len(tokens) + len(sigs[-1])
                if held > 1_000_000:
                    yield rows(batch.slice(first, i + 1 - first), sets, sigs)
                    sets, sigs, held, first = [], [], 0, i + 1
            if sets:
                yield rows(batch.slice(first), sets, sigs)

    return run


def _members(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _WordHashes(), set()
        for batch in batches:
            wanted = batch.column("set_key").to_pylist()
            # rows that repeat come once
            same = [w not in seen and not seen.add(w) for w in wanted]
            tokens = [
                shingle_set(t, size, known) if s else np.empty(0, np.uint64)
                for t, s in zip(_texts(batch), same)
            ]
            rest = batch.drop_columns(["text"]).append_column(
                "tokens", pa.array([t.tobytes() for t in tokens], pa.binary())
            )
            yield rest.filter(pa.array(same, pa.bool_()))

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def divide_skip(sets: list[np.ndarray], first: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect ``sets`` as all links would, as pairs of positions.

    Positions under ``first`` are indexed, the others only query (0: all do both).
    """
    indexed = first or len(sets)
    flat = np.concatenate(sets[:indexed])
    owner = np.repeat(np.arange(indexed), [len(s) for s in sets[:indexed]])
    order = np.argsort(flat, kind="stable")  # stable: owners ascend within a list
    flat, docs = flat[order], owner[order].tolist()
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    values, ends = flat[starts], np.r_[starts[1:], len(flat)]
    forest = _Forest(len(sets))
    for q in range(first, len(sets)):
        n = len(sets[q])
        at = np.searchsorted(values, sets[q])
        if first:  # not all its shingles need have a list
            here = np.minimum(at, len(values) - 1)
            at = here[values[here] == sets[q]]
        least = -(-n * percent // 100)  # overlap that any partner needs
        if len(at) < least:
            continue
        length = ends[at] - starts[at]
        at = at[np.argsort(length, kind="stable")]
        longest = max(int(length.max()), 2)
        n_long = min(least - 1, int(least / (MU * math.log2(longest) + 1)))
        lows, highs = starts[at].tolist(), ends[at].tolist()
        split = len(lows) - n_long
        short = [docs[a:b] for a, b in zip(lows[:split], highs[:split])]
        long = list(zip(lows[split:], highs[split:]))
        for c, run in groupby(heapq.merge(*short)):
            if not first and c >= q:  # the later set of a pair asks
                break
            count = sum(1 for _ in run)
            both = n + len(sets[c])
            need = -(-percent * both // (100 + percent))  # inter >= percent/100 * union
            if count < need - n_long or forest.root(c) == forest.root(q):
                continue
            left = n_long
            for low, high in long:
                left -= 1
                place = bisect_left(docs, c, low, high)
                count += place < high and docs[place] == c
                if count + left < need:
                    break
            if count >= need:
                forest.up[forest.root(c)] = forest.root(q)
                yield c, q


def _search(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        for (_, i, j), run in groupby(rows(), key=lambda r: (r["grp"], r["bi"], r["bj"])):
            seen = {}
            for r in run:
                seen[r["set_key"]] = (r["block"], np.frombuffer(r["tokens"], np.uint64))
            keys = sorted(seen, key=lambda k: (seen[k][0] != i, k))
            first = 0 if i == j else sum(seen[k][0] == i for k in keys)
            if len(keys) < 2 or i != j and first in (0, len(keys)):
                continue
            found = list(divide_skip([seen[k][1] for k in keys], first, percent))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[a] for a, _ in found], pa.binary()),
                    pa.array([keys[b] for _, b in found], pa.binary()),
                ],
                names=["a", "b"],
            )

    return run


def jaccard_classes(
    documents: DataFrame, size: int = 3, percent: int = 90, block: int = BLOCK_SHINGLES
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and keys for every row of ``documents``.

    ``text_key`` is a hash of the text, ``set_key`` of its shingles, ``class_key`` of its class.
    Words are what stands between ASCII white space, A-Z lower-cased; a text of fewer than
    ``size`` words is one shingle. ``component_id`` is the smallest doc_id that links reach.
    A null or empty text, or one without words, has no shingles, links with nothing and is
    its own class. Every row counts, rows that repeat a doc_id too; a null doc_id belongs to
    its class but never names one unless all are null. Other columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, text_key bigint, n_shingles bigint, set_key binary, short_key bigint,"
        " sigs array<bigint>"
    )
    texts = docs.withColumn("text_key", F.xxhash64("text"))
    signed = texts.mapInArrow(_sets(size, percent), schema)
    with released(documents.sparkSession) as kept:
        signed = materialise(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
        sets = kept(signed.select("doc_id", "text_key", "n_shingles", "set_key"), "sets")
        reps = (
            signed.filter("n_shingles > 0")
            .groupBy("set_key")
            .agg(
                F.min("doc_id").alias("rep"),
                F.min(F.struct("doc_id", "text_key")).alias("home"),
                F.max("n_shingles").alias("n"),
                F.max("short_key").alias("short_key"),
                F.min("row").alias("row"),
            )
        )
        reps = materialise(reps, "reps")
        groups = _groups(signed, reps)
        forget(signed)
        classes = components(links(texts, groups, reps, size, percent, block))
        named = (
            reps.join(classes, reps.set_key == classes.node, "left")
            .select("set_key", "rep", F.coalesce("root", "set_key").alias("root"))
        )
        smallest = named.groupBy("root").agg(F.min("rep").alias("class_id"))
        of_set = named.join(smallest, "root").select(
            "set_key", "class_id", F.col("root").alias("class_key")
        )
        of_set = kept(of_set, "classes")
    found = sets.join(of_set, "set_key", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class_id"))
    return found.select(
        "doc_id", "text_key", "n_shingles", "set_key", "class_key", own.alias("component_id")
    )


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents``, all their columns, with one document of each class.

    The smallest doc_id stays, null last; of rows that repeat it with an equal text, one.
    Rows without words link with nothing and all stay.
    """
    docs = documents.select(
        F.struct("*").alias("document"),
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("text_key"),
    )
    found = jaccard_classes(documents, size, percent).filter("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    several = (
        found.groupBy("class_key")
        .agg(F.min(place).alias("first"), F.count("*").alias("rows"))
        .filter("rows > 1")
    )
    # Only what doesn't simply stay is written: documents pass this small table once.
    marks = (
        found.join(several, "class_key")
        .groupBy("doc_id", "text_key")
        .agg(F.count("*").alias("rows"), F.first(place == F.col("first")).alias("stays"))
        .filter("rows > 1 or not stays")
    )
    marks = materialise(marks.toDF("mark_id", "mark_key", "rows", "stays"), "marks")
    repeated = materialise(marks.filter("stays").select("mark_id", "mark_key"), "repeated")

    def same(marked: DataFrame) -> Column:
        return docs.id.eqNullSafe(marked.mark_id) & (docs.text_key == marked.mark_key)

    rest = docs.join(marks, same(marks), "left_anti").select("document")
    stay = docs.join(repeated, same(repeated), "left_semi")
    one = stay.groupBy("id", "text_key").agg(F.first("document").alias("document"))
    return rest.union(one.select("document")).select("document.*")


def _groups(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """``node`` (the short key of a set) and ``root`` of sets that meet under a key.

    Each distinct set is met under its keys once, however many rows have it.
    """
    firsts = reps.select("set_key", F.col("row").alias("first"))
    copies = sets.select("set_key", "row").join(firsts, "set_key").filter("row <> first")
    copies = materialise(copies.select("row"), "copies")
    postings = sets.join(copies, "row", "left_anti").select(
        "short_key", F.explode("sigs").alias("sig")
    )
    # One shuffle: who meets under a key meets the smallest one there.
    least = F.min("short_key").over(Window.partitionBy("sig"))
    meet = postings.withColumn("a", least).select("short_key", "a").filter("short_key <> a")
    return materialise(components(meet.distinct(), "short_key", "a"), "groups")


def links(
    texts: DataFrame, groups: DataFrame, reps: DataFrame, size: int, percent: int, block: int
) -> DataFrame:
    """Links ``a``, ``b`` between set keys, enough to connect what all links connect."""
    members = reps.join(groups, reps.short_key == groups.node)
    weight = members.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(block)).alias("blocks"))
    placed = members.join(weight, "root").select(
        F.col("root").alias("grp"),
        F.col("home.doc_id").alias("home_id"),
        F.col("home.text_key").alias("home_key"),
        "set_key",
        "blocks",
        F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int").alias("block"),
    )
    same = texts.doc_id.eqNullSafe(placed.home_id) & (texts.text_key == placed.home_key)
    wanted = texts.join(placed, same).select(
        "grp", "set_key", "blocks", "block", "text"
    )
    tokens = wanted.mapInArrow(
        _members(size), "grp bigint, set_key binary, blocks bigint, block int, tokens binary"
    )
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")
    tasks = tokens.select("grp", "set_key", "block", "tokens", other).select(
        "grp",
        "set_key",
        "block",
        "tokens",
        F.least("block", "other").alias("bi"),
        F.greatest("block", "other").alias("bj"),
    )
    dealt = tasks.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj")
    return dealt.mapInArrow(_search(percent), "a binary, b binary")

