"""Phrases that stick together, counted by vertically partitioned suffix trees.

1. Words are counted per language and known by 64-bit digests, which differ by language.
2. Vertical partitioning: the suffixes are dealt by their first words, whose number is known.
   A prefix with more suffixes than the budget is extended by a word, until all fit; the
   prefixes are dealt into as many groups as the suffixes fill budgets.
3. Each place of a text gives the suffix that starts there, cut after ``longest`` words and at
   the end of its piece, unless its first word is known to be rare: a table of bits, of a size
   fixed in advance, tells which words may be frequent, and never denies one that is.
4. Each group builds the subtrees of its prefixes by itself, in sorted order: the runs at each
   depth are the nodes, and the totals of their leaves are the phrases' counts. A node is
   held only while its run lasts, so no group has to fit in memory.
5. Joins with the counts of its parts score each phrase.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtables.scratch import materialise

#: Suffixes that a group is meant for, and the most prefixes that may be extended: a larger
#: corpus has larger groups.
BUDGET, MAX_EXTENDED = 1 << 20, 20_000
#: The table of words that may be frequent has 2 ** FILTER_BITS bits.
FILTER_BITS = 22
#: Bytes of text that a task looks at together; pieces are never cut.
CHUNK_BYTES = 4 << 20
#: Words a task counts or knows before it starts anew.
KNOWN_WORDS = 400_000

def _plain() -> bytes:
    """Byte table: A-Z to a-z, tabs to spaces, ends of pieces to line feeds."""
    table = bytearray(range(256))
    table[65:91] = bytes(range(97, 123))
    table[9] = 32
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        table[c] = 10
    return bytes(table)


def _blobs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """Language and texts in plain form, of about ``size`` bytes unless a piece is longer."""
    plain, held, bytes_held = _plain(), {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            if not text:
                continue
            data = text.encode().translate(plain)
            start = 0
            while len(data) - start > size:
                end = data.rfind(b"\n", start, start + size)
                end = end if end > start else data.find(b"\n", start + size)
                if end < 0:
                    break
                yield lang, data[start:end]
                start = end + 1
            held.setdefault(lang, []).append(data[start:])
            bytes_held += len(data) - start
            if bytes_held >= size:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, bytes_held = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def _hasher(lang: str) -> Callable[[bytes], int]:
    """Digests of the words of a language, as :func:`_digest` has them; 0 is none of them."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return lambda word: xxhash.xxh64_intdigest(word, seed) or 1


def _digest(lang: str, word: str) -> Column:
    h = F.xxhash64(lang, word)
    return F.when(h == 0, F.lit(1).cast("bigint")).otherwise(h)


def _bits(digests: DataFrame) -> np.ndarray:
    """The table for the digests ``h``: a bit for the leading bits of each; at most
    2 ** FILTER_BITS numbers come to the driver, whatever the rows."""
    slots = digests.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("slot")).distinct()
    table = np.zeros(1 << FILTER_BITS, bool)
    table[slots.toArrow().column("slot").to_numpy()] = True
    return np.packbits(table)


def _may(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Whether the table has the bit of each digest."""
    slots = digests >> np.uint64(64 - FILTER_BITS)
    return (bits[slots >> np.uint64(3)] << (slots & np.uint64(7)).astype(np.uint8)) & 128 != 0


def _count_words(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counted in counts.items():
            words = list(counted)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.string()),
                    pa.array([w.decode() for w in words], pa.string()),
                    pa.array(list(counted.values()), pa.int64()),
                ],
                ["lang", "word", "f"],
            )

    counts: dict[str, Counter] = {}
    for lang, blob in _blobs(batches, size):
        counts.setdefault(lang, Counter()).update(blob.split())
        if sum(map(len, counts.values())) > KNOWN_WORDS:
            yield from rows(counts)
            counts = {}
    yield from rows(counts)


def _scanned(
    batches: Iterator[pa.RecordBatch], size: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Digest of each word of a stretch, and whether a phrase can go on from it to the next."""
    known: dict[str, dict[bytes, int]] = {}
    for lang, blob in _blobs(batches, size):
        raw = np.frombuffer(blob, np.uint8)
        ends = raw == 10
        gap = ends | (raw == 32)
        starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        if not len(starts):
            continue
        piece = np.cumsum(ends, dtype=np.int64)[starts]
        words = blob.split()
        if len(known.get(lang, ())) > KNOWN_WORDS:
            del known[lang]
        digests = known.setdefault(lang, {})
        new = list(set(words).difference(digests))
        digests.update(zip(new, map(_hasher(lang), new)))
        link = np.zeros(len(words), bool)
        link[:-1] = piece[1:] == piece[:-1]
        yield np.fromiter(map(digests.__getitem__, words), np.uint64, len(words)), link


def _mixed(key, h):
    """The digest of a prefix and one more word."""
    with np.errstate(over="ignore"):
        key = (key ^ h) * np.uint64(0x9E3779B97F4A7C15)
        return key ^ (key >> np.uint64(31))


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``some``."""
    if not len(some):
        return np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(some, keys), len(some) - 1)
    return some[place] == keys


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``rows``, by leading words, and how often each occurs.

    They are sorted by one number for speed: equal columns have the same, and columns with
    the same first two words lie together, which shuffles well. Runs are told by the words.
    """
    rest = np.zeros(rows.shape[1], np.uint64)
    for row in rows[2:]:
        rest = _mixed(rest, row)
    high, low = np.uint64(40), np.uint64(44)
    key = (rows[0] >> high << high) | (rows[1] >> low << np.uint64(20)) | (rest >> low)
    rows = rows[:, np.argsort(key)]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    firsts = np.flatnonzero(new)
    return rows[:, firsts], np.diff(np.append(firsts, rows.shape[1]))


def _extensions(batches: Iterator, size: int, over: np.ndarray, depth: int) -> Iterator:
    """Prefixes of ``depth`` words among ``over``, each with a next word, and their number."""
    for h, link in _scanned(batches, size):
        start, key = np.arange(len(h)), np.zeros(len(h), np.uint64)
        for k in range(depth):
            key = _mixed(key, h[start + k])
            on = link[start + k]
            start, key = start[on], key[on]
        start = start[_among(key, over)]
        if len(start):
            rows, counts = _distinct(np.stack([h[start + k] for k in range(depth + 1)]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(row.view(np.int64)) for row in rows), pa.array(counts)],
                [*_columns(depth + 1), "f"],
            )


def _suffixes(
    batches: Iterator, size: int, bits: np.ndarray, over: list[np.ndarray], longest: int
) -> Iterator:
    """Distinct cut suffixes of each stretch of text, two words at least; number and prefix.

    ``over[k]`` are the prefixes of k + 1 words that are extended; ``g`` is a digest of the
    first one that isn't.
    """
    for h, link in _scanned(batches, size):
        start = np.flatnonzero(link)
        start = start[_may(bits, h[start])]
        if not len(start):
            continue
        rows = np.zeros((longest, len(start)), np.uint64)
        rows[0] = h[start]
        on = np.ones(len(start), bool)
        for k in range(1, longest):
            on[on] = link[start[on] + k - 1]
            rows[k, on] = h[start[on] + k]
        rows, counts = _distinct(rows)
        key = _mixed(np.zeros(rows.shape[1], np.uint64), rows[0])
        extended = np.ones(len(key), bool)
        for k in range(1, longest):
            extended = extended & _among(key, over[k - 1] if k <= len(over) else key[:0])
            if not extended.any():
                break
            key = np.where(extended, _mixed(key, rows[k]), key)
        # What neighbouring rows have in common stands first, side by side, and packs well.
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((key >> np.uint64(33)).astype(np.int32)),
                pa.array(counts),
                *(pa.array(row.view(np.int64)) for row in rows),
            ],
            ["g", "c", *_columns(longest)],
        )


def _columns(n: int) -> list[str]:
    return [f"w{i}" for i in range(1, n + 1)]


def _subtrees(batches: Iterator, longest: int, least: int) -> Iterator:
    """Counts of the phrases of sorted suffixes: a node's run may go over many batches.

    Of phrases shorter than their group's prefix this counts parts only.
    """
    names = _columns(longest)
    held: list[tuple[list[int], int] | None] = [None] * (longest + 1)

    def table(depth: int, columns: list[np.ndarray], totals: np.ndarray) -> pa.RecordBatch:
        empty = np.zeros(len(totals), np.int64)
        arrays = [columns[i] if i < depth else empty for i in range(longest)]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, arrays), pa.array(np.full(len(totals), depth, np.int64)), pa.array(totals)],
            [*names, "n_words", "f"],
        )

    def last(depth: int) -> Iterator:
        words, total = held[depth]
        if total >= least:
            yield table(depth, [np.array([w]) for w in words], np.array([total]))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(x).to_numpy() for x in names]
        counts = batch.column("c").to_numpy()
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for depth, column in enumerate(columns, 1):
            new[1:] |= column[1:] != column[:-1]
            if depth < 2:
                continue
            starts = np.flatnonzero(new)
            totals = np.add.reduceat(counts, starts)
            phrases = [c[starts] for c in columns[:depth]]
            real = phrases[-1] != 0
            phrases, totals = [c[real] for c in phrases], totals[real]
            if not len(totals):
                continue
            if held[depth] is not None:
                if held[depth][0] == [int(c[0]) for c in phrases]:
                    totals[0] += held[depth][1]
                else:
                    yield from last(depth)
            held[depth] = ([int(c[-1]) for c in phrases], int(totals[-1]))
            phrases, totals = [c[:-1] for c in phrases], totals[:-1]
            often = totals >= least
            if often.any():
                yield table(depth, [c[often] for c in phrases], totals[often])
    for depth in range(2, longest + 1):
        if held[depth] is not None:
            yield from last(depth)


def _extended(
    docs: DataFrame, words: DataFrame, budget: int, longest: int, chunk_bytes: int
) -> tuple[list[np.ndarray], list[DataFrame]]:
    """The prefixes that need a further word, level by level, and the counts met on the way.

    Fewer than words / budget per level, which is at most ``MAX_EXTENDED``.
    """
    over, counted, now = [], [], words.select(F.col("h").alias("w1"), "f")
    for depth in range(1, longest):
        names = _columns(depth)
        many = now.filter(F.col("f") > budget).select(*names).toArrow()
        if not many.num_rows:
            break
        key = np.zeros(many.num_rows, np.uint64)
        for x in names:
            key = _mixed(key, many.column(x).to_numpy().view(np.uint64))
        over.append(np.sort(key))
        if depth == longest - 1:
            break
        keys = docs.sparkSession.sparkContext.broadcast(over[-1])
        schema = ", ".join([*(f"{x} bigint" for x in _columns(depth + 1)), "f bigint"])

        def extend(batches: Iterator, keys=keys, depth=depth) -> Iterator:
            return _extensions(batches, chunk_bytes, keys.value, depth)

        now = docs.mapInArrow(extend, schema)
        now = materialise(now.groupBy(*_columns(depth + 1)).agg(F.sum("f").alias("f")), "prefixes")
        counted.append(now)
    return over, counted


def phrase_counts(
    documents: DataFrame,
    longest: int = 5,
    least: int = 100,
    budget: int = BUDGET,
    chunk_bytes: int = CHUNK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Counts of words (``lang``, ``word``, ``h``, ``f``) and of phrases of two to ``longest``
    words (``w1`` ..., ``n_words``, ``f``) that occur ``least`` times; all other words of a
    language are one row without ``word``.

    Words are known by their ``h`` in the second table, 0 after the phrase's end; digests of
    different languages differ. A null language is ``und``; null and empty texts have no words;
    repeated rows count each time. Texts of any length are cut between pieces only. Other
    columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"
    )
    names = _columns(longest)
    words = docs.mapInArrow(
        lambda batches: _count_words(batches, chunk_bytes), "lang string, word string, f bigint"
    )
    words = words.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    often = F.when(F.col("f") >= least, F.col("word")).alias("word")
    words = words.groupBy("lang", often).agg(F.sum("f").alias("f"))
    words = materialise(words.withColumn("h", _digest("lang", "word")), "words")
    total = words.agg(F.sum("f")).first()[0] or 0
    budget = max(budget, total // MAX_EXTENDED)
    frequent = words.filter("word is not null")
    bits = spark.sparkContext.broadcast(_bits(frequent))
    over, counted = _extended(docs, frequent, budget, longest, chunk_bytes)
    prefixes, groups = spark.sparkContext.broadcast(over), max(1, -(-total // budget))
    suffixes = docs.mapInArrow(
        lambda batches: _suffixes(batches, chunk_bytes, bits.value, prefixes.value, longest),
        ", ".join(["g int, c bigint", *(f"{x} bigint" for x in names)]),
    )
    phrases = (
        suffixes.repartition(groups, "g")
        .sortWithinPartitions(*names)
        .select("c", *names)
        .mapInArrow(
            lambda batches: _subtrees(batches, longest, least),
            ", ".join([*(f"{x} bigint" for x in names), "n_words bigint, f bigint"]),
        )
    )
    # Prefixes that were extended lie in several groups; they were counted before.
    for depth, known in enumerate(counted, 2):
        rest = (F.lit(0).cast("bigint").alias(x) for x in names[depth:])
        known = known.filter(F.col("f") >= least).select(
            *names[:depth], *rest, F.lit(depth).cast("bigint").alias("n_words"), "f"
        )
        phrases = phrases.unionByName(known)
    phrases = phrases.groupBy(*names, "n_words").agg(F.max("f").alias("f"))
    return words, materialise(phrases, "phrases")


def collocations(documents: DataFrame, top: int = 2000, longest: int = 5, least: int = 100, **options) -> DataFrame:
    """The phrases of each language whose words stick together most.

    ``lang``, ``rank`` (from 1), ``phrase``, its count ``a``, the counts ``l`` and ``r`` of the
    parts at its weakest cut, ``n`` (words of the language) and ``score`` =
    floor(1000 * a * n / (l * r)) there; of cuts with equal scores the first counts. A phrase
    that stands within a longer one of the same count is dropped. Ties go by count, then by
    the phrase's bytes. Nulls, empty texts and repeats as in :func:`phrase_counts`; an empty
    table gives no phrase.
    """
    words, phrases = phrase_counts(documents, longest, least, **options)
    names = _columns(longest)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter("word is not null")
    phrases = phrases.select(
        F.slice(F.array(*names), F.lit(1), F.col("n_words").cast("int")).alias("key"),
        "n_words",
        F.col("f").alias("a"),
    )
    # A longer phrase of the same count implies one that is a word longer.
    shorter = F.expr("array(slice(key, 1, int(n_words) - 1), slice(key, 2, int(n_words) - 1))")
    inner = phrases.filter("n_words > 2").select(F.explode(shorter).alias("key"), "a")
    inner = inner.groupBy("key").agg(F.max("a").alias("longer"))
    kept = phrases.join(inner, "key", "left").filter("longer is null or longer < a")
    counts = phrases.select("key", F.col("a").alias("f")).unionByName(
        frequent.select(F.array("h").alias("key"), "f")
    )
    spelled = (
        kept.select("key", F.posexplode("key").alias("i", "h"))
        .join(frequent.select("lang", "h", "word"), "h")
        .groupBy("key")
        .agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("said"))
        .select("key", "lang", F.array_join(F.col("said.word"), " ").alias("phrase"))
    )
    kept = kept.join(spelled, "key").join(sizes, "lang")
    cuts = kept.select(
        "lang", "phrase", "key", "a", "n", F.explode(F.expr("sequence(1, int(n_words) - 1)")).alias("k")
    ).withColumns(
        {"first": F.expr("slice(key, 1, k)"), "rest": F.expr("slice(key, k + 1, size(key) - k)")}
    )
    whole = "decimal(38,0)"
    score = F.expr(
        f"cast((cast(a as {whole}) * cast(n as {whole}) * cast(1000 as {whole}))"
        f" div (cast(l as {whole}) * cast(r as {whole})) as bigint)"
    )
    scored = (
        cuts.join(counts.select(F.col("key").alias("first"), F.col("f").alias("l")), "first")
        .join(counts.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
        .withColumn("score", score)
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )
