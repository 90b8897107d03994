"""The trie of conversation prefixes, from distinct whole conversations.

1. Turns are numbered within their conversation; a turn is known by two 64-bit digests of role
   and text. A prefix is known by its length and two running XORs of its turns' digests, each
   salted with the turn's place. No text leaves the first scan.
2. Conversations that are equal as a whole collapse to one weighted sequence with its smallest
   conversation. The list of those that end there is hashed as a sorted stream.
3. Sequences that are proper prefixes of others are found by an anti-join; the rest are leaves.
4. The prefixes of each sequence, weighted, are summed to nodes. Each node is owned by its
   smallest leaf. The nodes a leaf owns are the lower end of its path, so what a subtree holds
   of them is a difference of running sums, and no node is ever spread over its ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtables.operators.numbering import numbered
from logtables.scratch import materialise

#: Places of a conversation that one window task sums.
CHUNK = 4096

_KEY = ["depth", "k1", "k2"]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 0), two digests ``a`` and ``b`` of the turn, its ``words``.

    By turn, null first; equal turns by the digests. A null role or text counts as empty.
    Rows without a conv_id belong to no conversation and are left out. Other columns are
    ignored; rows that repeat are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digests = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit(1), role).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    placed = numbered(digests, ["conv_id"], ["turn", "a", "b"], "place")
    return materialise(placed.select("conv_id", "place", "a", "b", "words"), "turns")


def rebuilt(turns: DataFrame, block: int = 20, choices: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id``) and their turns, the first ones taken from a common opening.

    ``turns`` as :func:`numbered_turns` gives them. Conversation c starts with the first h
    turns of c - c % block (as many as that has, none if there is none), then come its own
    turns after its first h; h = crc32(decimal c) % ``choices``. A conversation may be left
    without turns.
    """
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    conv = F.col("conv_id")
    ids = ids.select(
        "conv_id",
        "n",
        (conv - conv % block).alias("opening"),
        (F.crc32(conv.cast("string").cast("binary")) % choices).alias("h"),
    )
    openings = ids.filter("conv_id = opening").select("opening", F.col("n").alias("there"))
    ids = materialise(
        ids.join(openings, "opening", "left").select(
            "conv_id", "opening", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")
        ),
        "openings",
    )
    heads = turns.filter((conv % block == 0) & (F.col("place") < choices - 1))
    heads = ids.join(heads.withColumnRenamed("conv_id", "opening"), "opening")
    heads = heads.filter("place < h").select("conv_id", "place", "a", "b", "words")
    own = turns.join(ids.filter("h > 0"), "conv_id", "left")
    h, taken = F.coalesce("h", F.lit(0)), F.coalesce("taken", F.lit(0))
    own = own.filter(F.col("place") >= h).select(
        "conv_id", (F.col("place") - h + taken).alias("place"), "a", "b", "words"
    )
    return ids.select("conv_id"), heads.unionByName(own)


def _running(rows: DataFrame, by: str, sums: dict[str, Column]) -> DataFrame:
    """Add running aggregates along ``place`` (from 0, without gaps) within ``by``, in chunks."""
    rows = rows.withColumn("_chunk", F.floor(F.col("place") / CHUNK))
    inside = Window.partitionBy(by, "_chunk").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return rows.withColumns({name: value.over(inside) for name, value in sums.items()})


def _paths(rows: DataFrame) -> DataFrame:
    """Prefix keys and words so far for each turn of each sequence ``s``."""
    lanes = {f"p{i}": F.xxhash64(x, "place") for i, x in ((1, "a"), (2, "b"))}
    rows = rows.select("s", "place", "words", *(v.alias(k) for k, v in lanes.items()))
    totals = {"k1": F.bit_xor("p1"), "k2": F.bit_xor("p2"), "so_far": F.sum("words")}
    rows = _running(rows, "s", totals)
    # What earlier chunks add: only sequences longer than a chunk have rows here.
    ends = rows.filter(F.col("place") % CHUNK == CHUNK - 1).select(
        "s", (F.col("_chunk") + 1).alias("_chunk"), "k1", "k2", "so_far"
    )
    earlier = Window.partitionBy("s").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ends = ends.select(
        "s",
        "_chunk",
        F.bit_xor("k1").over(earlier).alias("e1"),
        F.bit_xor("k2").over(earlier).alias("e2"),
        F.sum("so_far").over(earlier).alias("e3"),
    )
    none = F.lit(0).cast("bigint")
    k1 = F.col("k1").bitwiseXOR(F.coalesce("e1", none))
    k2 = F.col("k2").bitwiseXOR(F.coalesce("e2", none))
    return rows.join(ends, ["s", "_chunk"], "left").select(
        "s",
        (F.col("place") + 1).alias("depth"),
        k1.alias("k1"),
        k2.alias("k2"),
        k1.bitwiseXOR(F.col("p1")).alias("u1"),
        k2.bitwiseXOR(F.col("p2")).alias("u2"),
        F.col("words").alias("w"),
        (F.col("so_far") + F.coalesce("e3", none) - F.col("words")).alias("before"),
    )


_ENDS = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per run of equal keys; a run may go over any number of batches."""
    now, digest = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in _KEY)))
        ids = batch.column("conv_id").to_pylist()
        done, first = [], 0
        while first < len(keys):
            last = first + 1
            while last < len(keys) and keys[last] == keys[first]:
                last += 1
            said = ",".join(map(str, ids[first:last])).encode()
            if keys[first] == now:
                digest.update(b"," + said)
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = keys[first], sha256(said)
            first = last
        if done:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in list(zip(*done))[:3]), pa.array([x[3] for x in done])],
                [*_KEY, "ends_sha256"],
            )
    if now is not None:
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([x], pa.int64()) for x in now), pa.array([digest.hexdigest()])],
            [*_KEY, "ends_sha256"],
        )


def prefix_trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns, from the root (``depth`` 0, no turn).

    ``conversations`` holds each conv_id once, ``turns`` their turns (``conv_id``, ``place``
    from 0 without gaps, digests ``a`` and ``b``, ``words``). Columns: ``conv_id`` (the smallest
    that starts so), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (words that the subtree's nodes spare by
    standing once instead of n_convs times) and ``ends_sha256`` of the conversations that end
    there. Conversations without turns are members of the root alone; without any
    conversation there is no node. Equal conversations share all their nodes.
    """
    zero = F.lit(0).cast("bigint")
    whole = turns.groupBy("conv_id").agg(
        F.count("*").alias("depth"),
        F.bit_xor(F.xxhash64("a", "place")).alias("k1"),
        F.bit_xor(F.xxhash64("b", "place")).alias("k2"),
        F.sum("words").alias("total"),
    )
    columns = [F.coalesce(x, zero).alias(x) for x in (*_KEY, "total")]
    whole = materialise(
        conversations.join(whole, "conv_id", "left").select("conv_id", *columns), "whole"
    )
    sequences = materialise(
        whole.groupBy(*_KEY).agg(
            F.count("*").alias("weight"), F.min("conv_id").alias("s"), F.max("total").alias("total")
        ),
        "sequences",
    )
    ends = (
        whole.select(*_KEY, "conv_id")
        .repartition(*_KEY)
        .sortWithinPartitions(*_KEY, "conv_id")
        .mapInArrow(_hash_ends, _ENDS)
    )
    paths = materialise(
        _paths(turns.withColumnRenamed("conv_id", "s").join(sequences.select("s"), "s", "left_semi")),
        "paths",
    )
    # Proper prefixes: the parents of all nodes.
    inner = paths.select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"))
    leaves = sequences.join(inner.distinct(), _KEY, "left_anti").select("s", F.lit(1).alias("leaf"))
    weighted = sequences.select("s", "weight", "total").join(leaves, "s", "left")
    weighted = materialise(weighted.withColumn("leaf", F.coalesce("leaf", F.lit(0))), "weighted")
    roots = sequences.select(
        "s", *(zero.alias(x) for x in ("depth", "k1", "k2", "u1", "u2", "w", "before"))
    )
    steps = paths.unionByName(roots).join(weighted, "s")
    rest = F.col("total") - F.col("before")
    nodes = materialise(
        steps.groupBy(*_KEY).agg(
            F.sum("weight").alias("n_convs"),
            F.min("s").alias("conv_id"),
            F.max("w").alias("w"),
            F.max("u1").alias("u1"),
            F.max("u2").alias("u2"),
            F.sum("leaf").alias("n_leaves"),
            F.min(F.when(F.col("leaf") == 1, F.col("s"))).alias("owner"),
            F.sum(F.col("weight") * rest).alias("all_words"),
        ),
        "nodes",
    )
    owned = nodes.groupBy(F.col("owner").alias("s")).agg(F.sum("w").alias("owned"))
    once = (
        steps.filter("leaf = 1").join(owned, "s")
        .groupBy(*_KEY).agg(F.sum(F.least(rest, "owned")).alias("once"))
    )
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")
    ).agg(F.count("*").alias("n_children"))
    told = (
        nodes.join(once, _KEY).join(children, _KEY, "left").join(ends, _KEY, "left")
    )
    # The root is the parent of all openings: one row, joined by depth.
    top = nodes.filter("depth = 0").select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("root"))
    parents = nodes.filter("depth > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("k1").alias("u1"),
        F.col("k2").alias("u2"),
        F.col("conv_id").alias("parent"),
    )
    below = told.filter("depth > 1").join(parents, ["depth", "u1", "u2"])
    first = told.filter("depth = 1").join(F.broadcast(top), "depth").withColumnRenamed("root", "parent")
    only = told.filter("depth = 0").withColumn("parent", F.lit(None).cast("bigint"))
    return below.unionByName(first).unionByName(only).select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        F.col("n_leaves").cast("bigint").alias("n_leaves"),
        (F.col("all_words") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
