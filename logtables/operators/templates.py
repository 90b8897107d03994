"""Mining wildcard templates from messages.

The miner is sequential by nature: what a message does depends on the templates
left by all earlier ones. Three facts let Spark do nearly all of it in parallel:

* Templates of different leaves - token count and first tokens - never meet.
* A message that some template of its leaf already covers changes nothing, now or
  later, because templates only ever gain wildcards. So only distinct masked
  messages matter, and of those only the ones not yet covered.
* Which template a message belongs to is the earliest one covering it at that
  moment. It follows from when each position of each template turned wild, by a
  join, without replaying anything.

Order is a place in the stream, ``at``: epoch, order number, and a hash of the
pattern for equal numbers. The epoch is 0 in batch work and the micro-batch number
in streams.

A book of templates has the columns ``leaf, template_no, pattern, template, steps,
wild``: the founding pattern, the template text by now, the places where it was
founded and generalised, and per position the step at which it turned wild.
"""

from __future__ import annotations

import functools
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtables.functions.text import WILDCARD, message_pattern, pattern_tokens
from logtables.operators.numbering import numbered
from logtables.scratch import forget, materialise, released

# Tree depth, similarity needed to join a template, children per node.
DEPTH = 4
SIM_THRESHOLD = 0.4
MAX_CHILDREN = 100

# Patterns of one leaf replayed by one task before the rest is filtered again.
REPLAY_CHUNK = 100_000

# Sets of wild positions a leaf's patterns are blanked at one by one, and templates of a
# book small enough to be looked up in no other way.
MASKS = 16
SMALL_BOOK = 20_000

# Patterns look into a large book in passes of so many lookups for each of all patterns, or
# of FEW lookups; a pass leaves its result only.
LOOKUPS = 4
FEW = 1_000_000

_AT = "struct<epoch: bigint, ord: bigint, tie: bigint>"
BOOK_SCHEMA = (
    "leaf string, template_no int, pattern string, template string, "
    f"steps array<{_AT}>, wild array<int>"
)


def order_number(column: str, df: DataFrame) -> Column:
    """A time or integer column as a number to order by."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("bigint")


def pattern_counts(
    events: DataFrame, message: str = "message", order: str = "ts", epoch: int = 0
) -> DataFrame:
    """``pattern, count, at``: occurrences and first place of each masked message."""
    return (
        events.select(
            _pattern(message).alias("pattern"),
            order_number(order, events).alias("_ord"),
        )
        .groupBy("pattern")
        .agg(F.count("*").alias("count"), F.min("_ord").alias("_ord"))
        .select("pattern", "count", _at(F.lit(epoch), F.col("_ord")).alias("at"))
    )


def _pattern(message: str) -> Column:
    """The masked message; a null message has the empty pattern."""
    return message_pattern(F.coalesce(F.col(message), F.lit("")))


def pattern_id(pattern: Column) -> Column:
    """128 bits that stand for a pattern where its text needn't move; ``a`` breaks ties of order."""
    return F.struct(
        F.xxhash64(pattern).alias("a"), F.xxhash64(F.lit(1), pattern).alias("b")
    )


def _at(epoch: Column, order: Column, tie: Column | None = None) -> Column:
    return F.struct(
        epoch.cast("bigint").alias("epoch"),
        order.alias("ord"),
        (F.xxhash64("pattern") if tie is None else tie).alias("tie"),
    )


def _descend(
    keyed: DataFrame, level: int, max_children: int, known: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """Extend ``leaf`` by the token at ``level``, or by the wildcard past the child limit."""
    token = F.get("tokens", F.lit(level))
    here = keyed.withColumn("_token", token)
    seen = (
        here.filter(F.col("_token").isNotNull())
        .groupBy("leaf", F.col("_token").alias("token"))
        .agg(F.min("at").alias("first"))
    )
    if known is None:
        places = Window.partitionBy("leaf").orderBy("first")
        children = seen.withColumn("_place", F.row_number().over(places)).filter(
            F.col("_place") <= max_children
        )
    else:
        old = known.filter(F.col("level") == level).select("leaf", "token")
        taken = old.groupBy("leaf").agg(F.count("*").alias("_taken"))
        places = Window.partitionBy("leaf").orderBy("first")
        new = (
            seen.join(old, ["leaf", "token"], "left_anti")
            .withColumn("_place", F.row_number().over(places))
            .filter(F.col("_place") <= max_children)
            .join(taken, "leaf", "left")
            .filter(F.col("_place") + F.coalesce("_taken", F.lit(0)) <= max_children)
        )
        children = new
    children = children.select(F.lit(level).alias("level"), "leaf", "token")
    allowed = children if known is None else children.unionByName(
        known.filter(F.col("level") == level).select("level", "leaf", "token")
    )
    allowed = allowed.select("leaf", F.col("token").alias("_token"), F.lit(True).alias("_kept"))
    branch = (
        F.when(F.col("_token").isNull(), F.col("leaf"))
        .when(F.col("_kept"), F.concat_ws(" ", "leaf", "_token"))
        .otherwise(F.concat_ws(" ", "leaf", F.lit(WILDCARD)))
    )
    deeper = (
        here.join(allowed, ["leaf", "_token"], "left")
        .withColumn("leaf", branch)
        .drop("_token", "_kept")
    )
    return deeper, children


def leaf_keys(
    patterns: DataFrame,
    depth: int = DEPTH,
    max_children: int = MAX_CHILDREN,
    known_children: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Patterns with their ``leaf`` - token count and first ``depth - 2`` tokens.

    Beyond ``max_children`` distinct tokens of a node, in order of first
    appearance, further ones share the wildcard branch. The second frame lists
    the children newly kept, as ``level, leaf, token``.
    """
    tokens, levels = pattern_tokens(F.col("pattern")), max(2, depth) - 2
    placed = patterns.withColumns(
        {"_n": F.size(tokens).cast("string"), "_way": F.slice(tokens, 1, levels)}
    )
    # The way to a leaf takes only leading tokens, so patterns move once, when all are known.
    ways = placed.groupBy("_n", "_way").agg(F.min("at").alias("at"))
    ways = ways.withColumns({"leaf": F.col("_n"), "tokens": F.col("_way")})
    kept = None
    for level in range(levels):
        ways, children = _descend(ways, level, max_children, known_children)
        kept = children if kept is None else kept.unionByName(children)
    if kept is None:
        kept = ways.select(F.lit(0).alias("level"), "leaf", F.lit("").alias("token")).limit(0)
    ways = materialise(ways.select("_n", "_way", "leaf"), "ways")
    keyed = placed.join(ways, ["_n", "_way"])
    return keyed.select(*patterns.columns, "leaf"), kept


class _Leaf:
    """The templates of one leaf while its patterns are replayed in order.

    Templates are found by what stands at each position, so a pattern meets those that
    share a token or are wild there, not all of the leaf.
    """

    def __init__(self, name: str) -> None:
        self.name = name
        self.rows: list[dict] = []
        self.tokens: list[list[str]] = []
        # (position, token or wildcard) -> numbers of the templates that have it there
        self.having: dict[tuple[int, str], array] = {}
        self.filed = 0

    def add(self, row: dict) -> None:
        tokens = [
            token if step is None else WILDCARD
            for token, step in zip(row["pattern"].split(), row["wild"])
        ]
        row["template"] = " ".join(tokens)
        self.rows.append(row)
        self.tokens.append(tokens)

    def _put(self, place: tuple[int, str], no: int) -> None:
        found = self.having.get(place)
        if found is None:
            self.having[place] = array("i", (no,))
        else:
            found.append(no)

    def nearest(self, tokens: list[str]) -> tuple[int, int]:
        """The first template that agrees at most positions, and at how many."""
        for no in range(self.filed, len(self.rows)):
            for place in enumerate(self.tokens[no]):
                self._put(place, no)
        self.filed = len(self.rows)
        places = [(i, t) for i, t in enumerate(tokens) if t != WILDCARD]
        places += [(i, WILDCARD) for i in range(len(tokens))]
        met = [found for found in map(self.having.get, places) if found]
        size = sum(map(len, met))
        if not size:
            return 0, 0
        if size < 200:
            agreeing = Counter(no for found in met for no in found)
            most = max(agreeing.values())
            return min(no for no, n in agreeing.items() if n == most), most
        agreeing = np.bincount(np.concatenate([np.frombuffer(f, np.intc) for f in met]))
        no = int(agreeing.argmax())
        return no, int(agreeing[no])

    def see(self, pattern: str, at: dict, threshold: float) -> None:
        """A pattern: covered, or generalises its nearest template, or founds one."""
        tokens = pattern.split()
        if self.rows:
            if not tokens:
                return  # the one template of this leaf is empty too
            no, agreeing = self.nearest(tokens)
            if agreeing == len(tokens):
                return
            if agreeing / len(tokens) >= threshold:
                self._generalise(no, tokens, at)
                return
        row = {"leaf": self.name, "template_no": len(self.rows), "pattern": pattern}
        self.add({**row, "steps": [at], "wild": [None] * len(tokens)})

    def _generalise(self, no: int, tokens: list[str], at: dict) -> None:
        row, template = self.rows[no], self.tokens[no]
        for i, token in enumerate(tokens):
            if template[i] not in (token, WILDCARD):
                self.having[i, template[i]].remove(no)
                template[i] = WILDCARD
                self._put((i, WILDCARD), no)
                row["wild"][i] = len(row["steps"])
        row["steps"].append(at)
        row["template"] = " ".join(template)


def _replay(batches: Iterator[pa.RecordBatch], threshold: float, schema: pa.Schema):
    """Replay rows sorted by leaf: known templates first, then patterns in order.

    Holds the templates of one leaf at a time, never its patterns.
    """
    leaf, done = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if leaf is None or row["leaf"] != leaf.name:
                done += leaf.rows if leaf else []
                leaf = _Leaf(row["leaf"])
            at = row.pop("at")
            if row["template_no"] is not None:
                leaf.add(row)
            else:
                leaf.see(row["pattern"], at, threshold)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if leaf:
        yield pa.RecordBatch.from_pylist(done + leaf.rows, schema)


def _replayed(book: DataFrame, patterns: DataFrame, threshold: float) -> DataFrame:
    """The books of all leaves in ``patterns`` after replaying them on ``book``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(book.schema)
    known = book.drop("template").withColumn("at", F.get("steps", F.lit(0)))
    rows = known.unionByName(
        patterns.select("leaf", "pattern", "at"), allowMissingColumns=True
    )
    rows = rows.repartition("leaf").sortWithinPartitions(
        "leaf", F.col("template_no").asc_nulls_last(), "at"
    )
    return rows.mapInArrow(lambda batches: _replay(batches, threshold, schema), BOOK_SCHEMA)


def _stored_book(book: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``book`` written once, and the table behind it: a template is its founding pattern but
    for what turned wild, so its text isn't stored."""
    stored = materialise(book.drop("template"), "templates")
    tokens = F.zip_with(
        pattern_tokens(F.col("pattern")),
        "wild",
        lambda token, step: F.when(step.isNull(), token).otherwise(WILDCARD),
    )
    return stored.withColumn("template", F.array_join(tokens, " ")).select(*book.columns), stored


def _blanked(tokens: Column, mask: Column) -> Column:
    return F.zip_with(tokens, mask, lambda t, wild: F.when(wild, WILDCARD).otherwise(t))


def _parts(n: Column) -> Column:
    """``n`` positions as a whole, in halves, in quarters and so on down to single ones."""
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"))

    def cut(level: Column) -> Column:
        pieces = F.pow(F.lit(2), level).cast("int")

        def part(i: Column) -> Column:
            start = F.floor(n * i / pieces).cast("int")
            size = F.floor(n * (i + 1) / pieces).cast("int") - start
            return F.struct((start + 1).alias("start"), size.alias("size"))

        return F.transform(F.sequence(F.lit(0), pieces - 1), part)

    return F.filter(F.flatten(F.transform(levels, cut)), lambda part: part["size"] > 0)


def _fixed_part(mask: Column) -> Column:
    """The first part without a wild position; an empty one if there is none."""
    parts = F.filter(
        _parts(F.size(mask)),
        lambda part: ~F.array_contains(F.slice(mask, part["start"], part["size"]), True),
    )
    none = F.struct(F.lit(1).alias("start"), F.lit(0).alias("size"))
    whole = F.struct(F.lit(1).alias("start"), F.size(mask).alias("size"))
    return F.when(~F.array_contains(mask, True), whole).otherwise(
        F.coalesce(F.get(parts, F.lit(0)), none)
    )


def _part_key(tokens: Column, start: Column, size: Column) -> Column:
    return F.xxhash64("leaf", start, size, F.slice(tokens, start, size))


def _whole_key(tokens: Column, mask: Column) -> Column:
    return F.xxhash64("leaf", mask, _blanked(tokens, mask))


def coverings(patterns: DataFrame, book: DataFrame) -> DataFrame:
    """Pairs of a pattern and a template of its leaf that covers it by now.

    ``leaf, pattern, pattern_id, template_no, since``.
    """
    named = patterns.select("leaf", "pattern", pattern_id(F.col("pattern")).alias("pattern_id"))
    return named.join(_covered(patterns, book), ["leaf", "pattern_id"])


def _covered(patterns: DataFrame, book: DataFrame) -> DataFrame:
    """``leaf, pattern_id, template_no, since`` of the :func:`coverings`.

    In leaves of few templates, the pattern is blanked at every set of wild positions in
    use and looked up among the templates. These sets become more as the leaf grows, so a
    large book is asked for parts instead: a template is filed under its largest half,
    quarter or so that has no wildcard. A leaf has at most two parts for each position.
    Patterns look into the parts in use by digest, and what is found there is compared as
    a whole, by digests of 128 bits, so that the texts of templates never move and those of
    patterns twice. The ``MASKS`` sets whose parts say least are looked up whole as before.
    Patterns go in as many passes as their lookups need.

    A template covers a pattern since the last of the positions they differ in turned wild.
    """
    is_wild = F.transform(pattern_tokens(F.col("template")), lambda t: t == WILDCARD)
    some = F.array_contains("_mask", True)
    founding = pattern_tokens(F.col("pattern"))
    was = F.zip_with(founding, "_mask", lambda t, wild: F.when(wild, t))
    templates = book.withColumn("_mask", is_wild).select(
        "leaf",
        "template_no",
        "template",
        "_mask",
        F.when(some, was).alias("was"),
        "steps",
        F.when(some, F.col("wild")).alias("wild"),
    )
    patterns = patterns.select("leaf", "pattern", pattern_id(F.col("pattern")).alias("pattern_id"))
    masks = templates.groupBy("leaf", "_mask").agg(F.count("*").alias("_n"))
    sizes = masks.groupBy("leaf").agg(F.count("*").alias("masks"), F.sum("_n").alias("n"))
    most = sizes.agg(F.max("masks").alias("masks"), F.sum("n").alias("n")).first()
    tokens = pattern_tokens(F.col("pattern"))
    if (most["masks"] or 0) <= MASKS and (most["n"] or 0) <= SMALL_BOOK:
        probes = patterns.join(masks.select("leaf", "_mask"), "leaf").withColumn(
            "template", F.array_join(_blanked(tokens, F.col("_mask")), " ")
        )
        return _since(probes.join(templates, ["leaf", "_mask", "template"]))

    masks = masks.withColumn("_part", _fixed_part(F.col("_mask")))
    vague = Window.partitionBy("leaf").orderBy("_part.size", F.desc("_n"), "_mask")
    whole = F.when((F.col("_place") <= MASKS) & (F.col("_part.size") < F.size("_mask")), True)
    slot = F.struct(
        F.when(whole, 0).otherwise(F.col("_part.start")).alias("start"),
        F.when(whole, 0).otherwise(F.col("_part.size")).alias("size"),
        F.when(whole, F.col("_mask")).alias("mask"),
    )
    slots = masks.withColumn("_place", F.row_number().over(vague)).select(
        "leaf", "_mask", slot.alias("_slot")
    )
    slots = materialise(slots, "slots")
    own, part = pattern_tokens(F.col("template")), _fixed_part(F.col("_mask"))
    filed = templates.select("leaf", "template_no", "_mask", own.alias("_tokens"), part.alias("_part"))
    filed = filed.select(
        "leaf",
        "template_no",
        "_mask",
        _part_key(F.col("_tokens"), F.col("_part.start"), F.col("_part.size")).alias("_in_part"),
        _whole_key(F.col("_tokens"), F.col("_mask")).alias("_whole"),
    ).join(slots, ["leaf", "_mask"])
    by_part = F.col("_slot.mask").isNull()
    filed = filed.select(
        F.when(by_part, F.col("_in_part")).otherwise(F.col("_whole")).alias("_key"),
        "leaf",
        "template_no",
    )
    in_use = slots.groupBy("leaf").agg(F.collect_set("_slot").alias("_slots"))
    asking = patterns.groupBy("leaf").agg(F.count("*").alias("n")).join(in_use, "leaf")
    asking = asking.agg(F.sum(F.col("n") * F.size("_slots")).alias("asked"), F.sum("n").alias("n"))
    asking = asking.first()
    passes = max(1, -(-(asking["asked"] or 0) // max(FEW, LOOKUPS * (asking["n"] or 0))))
    key = _part_key(F.col("_tokens"), F.col("_slot.start"), F.col("_slot.size"))
    key = F.when(by_part, key).otherwise(_whole_key(F.col("_tokens"), F.col("_slot.mask")))
    blanked = F.array_join(_blanked(tokens, F.col("_mask")), " ")
    covered = []
    with released(patterns.sparkSession) as kept:
        filed = materialise(filed, "filed")
        whole = templates.withColumn("_whole", pattern_id(F.col("template"))).drop("template")
        whole = materialise(whole, "whole")
        for number in range(passes):
            those = patterns.filter(F.pmod("pattern_id.b", F.lit(passes)) == number)
            probes = (
                those.join(in_use, "leaf")
                .select(
                    "leaf",
                    F.col("pattern_id.a").alias("_id"),
                    tokens.alias("_tokens"),
                    F.explode("_slots").alias("_slot"),
                )
                .select(key.alias("_key"), "_id")
            )
            # once each, even if two keys or patterns had one digest
            found = probes.join(filed, "_key").select("leaf", "_id", "template_no").distinct()
            found = materialise(found, "found")
            pairs = found.join(whole, ["leaf", "template_no"])
            pairs = those.withColumn("_id", F.col("pattern_id.a")).join(pairs, ["leaf", "_id"])
            pairs = _since(pairs.filter(pattern_id(blanked) == F.col("_whole")))
            covered.append(kept(pairs, "covered"))
            forget(found)
    return functools.reduce(DataFrame.unionByName, covered)


def _since(pairs: DataFrame) -> DataFrame:
    differs = F.zip_with(
        "was", pattern_tokens(F.col("pattern")), lambda a, b: a.isNotNull() & (a != b)
    )
    step = F.array_max(F.zip_with(differs, "wild", lambda d, w: F.when(d, w)))
    since = F.get("steps", F.coalesce(step, F.lit(0)))
    return pairs.select("leaf", "pattern_id", "template_no", since.alias("since"))


def mine_book(
    keyed: DataFrame,
    known: DataFrame | None = None,
    sim_threshold: float = SIM_THRESHOLD,
    chunk: int = REPLAY_CHUNK,
) -> DataFrame:
    """Book of templates of patterns with ``leaf`` and ``at``, going on from ``known``.

    Leaves are replayed in parallel. A leaf with more than ``chunk`` patterns goes
    in rounds: its first patterns are replayed, all others they cover are dropped
    by a distributed join, and only what is left enters the next round. A task never
    replays more than ``chunk`` patterns of a leaf. The tables of a round go when the next
    one has its own.
    """
    spark = keyed.sparkSession
    pending = keyed.select("leaf", "pattern", "at")
    book = spark.createDataFrame([], BOOK_SCHEMA) if known is None else known
    finished, own = [], []

    def replayed(patterns: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
        return _stored_book(_replayed(of.select(*book.columns), patterns, sim_threshold))

    while True:
        sizes = pending.groupBy("leaf").agg(F.count("*").alias("_n"))
        if known is not None or finished:  # else there is no template yet
            book = book.join(sizes.select("leaf"), "leaf", "left_semi").select(*book.columns)
        largest = sizes.agg(F.max("_n")).first()[0] or 0
        if largest <= chunk:
            finished.append(replayed(pending, book)[0])
            break
        # Leaves that one replay ends are done; of the others, the first patterns are replayed.
        large = materialise(sizes.filter(F.col("_n") > chunk).select("leaf"), "large")
        small = pending.join(large, "leaf", "left_anti")
        finished.append(replayed(small, book.join(large, "leaf", "left_anti"))[0])
        pending = pending.join(large, "leaf", "left_semi")
        with released(spark) as kept:
            places = numbered(pending.select("leaf", "at"), ["leaf"], ["at"], "_n")
            cut = places.filter(F.col("_n") == chunk).select("leaf", F.col("at").alias("_cut"))
            cut = kept(cut, "cut")
        pending = pending.join(cut, "leaf")
        head = pending.filter(F.col("at") < F.col("_cut")).select("leaf", "pattern", "at")
        tail = pending.filter(F.col("at") >= F.col("_cut")).select("leaf", "pattern", "at")
        book, stored = replayed(head, book.join(large, "leaf", "left_semi"))
        with released(spark) as kept:
            covered = _covered(tail.select("leaf", "pattern"), book).select("pattern_id")
            covered = materialise(covered.distinct(), "covered")
            left = tail.withColumn("pattern_id", pattern_id(F.col("pattern")))
            left = left.join(covered, "pattern_id", "left_anti").select(*tail.columns)
            pending = kept(left, "pending")
        through = book.join(pending.select("leaf").distinct(), "leaf", "left_anti")
        finished.append(_stored_book(through.select(*book.columns))[0])
        for table in (*own, large, cut):
            forget(table)
        own = [stored, pending]
    for table in own:
        forget(table)
    return functools.reduce(DataFrame.unionByName, finished)


def mine_templates(
    patterns: DataFrame,
    depth: int = DEPTH,
    sim_threshold: float = SIM_THRESHOLD,
    max_children: int = MAX_CHILDREN,
    chunk: int = REPLAY_CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Mine :func:`pattern_counts`; the patterns with their leaf, and the book."""
    with released(patterns.sparkSession) as kept:
        patterns = materialise(patterns, "patterns")
        keyed = kept(leaf_keys(patterns, depth, max_children)[0], "keyed")
    return keyed, mine_book(keyed, None, sim_threshold, chunk)


def template_key(leaf: Column, pattern: Column) -> Column:
    """Id of a template that is the same in every run over the same stream."""
    return F.sha1(F.concat(leaf, F.lit("|"), pattern))


def describe_templates(book: DataFrame) -> DataFrame:
    """``template_id, template_key, template, tokens``; ids count up in order of creation."""
    home = ["leaf", "template_no"]
    places = book.select(*home, F.get("steps", F.lit(0)).alias("at"))
    ids = numbered(places, [], ["at"], "template_id").select(*home, "template_id")
    return book.join(ids, home).select(
        "template_id",
        template_key(F.col("leaf"), F.col("pattern")).alias("template_key"),
        "template",
        pattern_tokens(F.col("template")).alias("tokens"),
        *home,
    )


def assignment_intervals(keyed: DataFrame, book: DataFrame) -> DataFrame:
    """``pattern_id, leaf, template_no, since, until``: where each pattern belongs, and when.

    A pattern belongs to the earliest template covering it. That changes only
    when an earlier template comes to cover it too.
    """
    covered = _covered(keyed.select("leaf", "pattern"), book)
    by_time = Window.partitionBy("pattern_id").orderBy("since", "template_no")
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    takes_over = covered.withColumn("_best", F.min("template_no").over(earlier)).filter(
        F.col("_best").isNull() | (F.col("template_no") < F.col("_best"))
    )
    until = F.lead("since").over(by_time).alias("until")
    return takes_over.select("pattern_id", "leaf", "template_no", "since", until)


def assign_templates(
    events: DataFrame,
    intervals: DataFrame,
    message: str = "message",
    order: str = "ts",
    epoch: int = 0,
) -> DataFrame:
    """Events with the ``leaf`` and ``template_no`` they belong to at their place."""
    placed = events.drop("pattern").withColumns(
        {"_pattern_id": pattern_id(_pattern(message)), "_ord": order_number(order, events)}
    )
    return _assigned(placed, intervals, epoch)


def _assigned(placed: DataFrame, intervals: DataFrame, epoch: int = 0) -> DataFrame:
    at = _at(F.lit(epoch), F.col("_ord"), F.col("_pattern_id.a"))
    here = (F.col("since") <= at) & (F.col("until").isNull() | (at < F.col("until")))
    same = F.col("_pattern_id") == F.col("pattern_id")
    return placed.join(intervals, same & here).drop(
        "_pattern_id", "pattern_id", "_ord", "since", "until"
    )


def tag_events(
    events: DataFrame, intervals: DataFrame, described: DataFrame, **place
) -> DataFrame:
    """Events with ``template_id`` set.

    The ids go to the intervals, which are few; these are written, so that their size is
    known, and a few of them don't make Spark gather the events of a pattern in one task.
    """
    ids = described.select("leaf", "template_no", "template_id")
    named = materialise(intervals.join(ids, ["leaf", "template_no"]), "named")
    tagged = assign_templates(events.drop("template_id"), named, **place)
    return tagged.drop("leaf", "template_no")


def template_counts(
    events: DataFrame,
    keyed: DataFrame,
    intervals: DataFrame,
    message: str = "message",
    order: str = "ts",
) -> DataFrame:
    """``leaf, template_no, count``: events per template.

    A pattern that stayed with one template brings all its occurrences at once;
    only events of patterns that moved are looked at one by one.
    """
    moved = intervals.filter("until is not null").select("pattern_id").distinct()
    home = ["leaf", "template_no"]
    counts = keyed.select(pattern_id(F.col("pattern")).alias("pattern_id"), "count")
    settled = (
        intervals.join(moved, "pattern_id", "left_anti")
        .select("pattern_id", *home)
        .join(counts, "pattern_id")
    )
    loose = events.select(
        pattern_id(_pattern(message)).alias("pattern_id"), order_number(order, events).alias("_ord")
    ).join(moved, "pattern_id", "left_semi")
    loose = loose.withColumnRenamed("pattern_id", "_pattern_id")
    single = _assigned(loose, intervals).select(*home, F.lit(1).cast("bigint").alias("count"))
    return (
        settled.select(*home, "count")
        .unionByName(single.groupBy(*home).agg(F.sum("count").alias("count")))
        .groupBy(*home)
        .agg(F.sum("count").alias("count"))
    )


def top_templates(counted: DataFrame, text: str = "template", n: int = 10) -> DataFrame:
    """The ``n`` largest by ``count``; their bars are 0 to 4 long, relative to the largest."""
    top = counted.orderBy(F.desc("count"), text).limit(n)
    share = F.col("count") * 4.0 / F.max("count").over(Window.partitionBy(F.lit(0)))
    return top.withColumn("bar", F.bround(share, 0).cast("int"))


def template_table(top: DataFrame, text: str = "template") -> DataFrame:
    """Rows of :func:`top_templates` as text: count, bar, template."""
    return top.select(
        F.format_number("count", 0).alias("count"),
        F.repeat(F.lit("\u2588"), F.col("bar")).alias("bar"),
        F.col(text).alias("template"),
    )
