"""Shards of near equal bytes by a k-d tree over the documents' metadata.

The tree splits a node along its widest dimension, at the weighted median (or the weighted
quantile that its share of shards asks for), until each leaf is one shard. Medians come from
grouped sums over the whole table: every round cuts the interval that holds the median into
bins, for all nodes at once, and only the sums of the bins reach the driver.

Equal texts are one point of the tree, and neighbours where a cut must go through them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtables.operators.numbering import numbered
from logtables.scratch import materialise

#: Bins of an interval in a round, and the part of a shard's bytes that needs no closer cut.
BINS, NEAR = 4096, 0.002
#: Ties are hashes from 0 to this.
_MOST = (1 << 62) - 1


@dataclass
class _Node:
    first: int
    count: int  # shards below
    box: dict = field(default_factory=dict)
    total: int = 0
    axis: str = ""
    goal: float = 0.0
    below: int = 0
    fixed: list = field(default_factory=list)  # leading parts of the cut, found so far
    low: int = 0
    high: int = 0
    left: _Node | None = None
    right: _Node | None = None


def _open(node: _Node) -> list[_Node]:
    if node.left is None:
        return [node]
    return _open(node.left) + _open(node.right)


class _Lookup:
    """Columns that hold, for the row's node, a number of that node."""

    def __init__(self, nodes: list[_Node]):
        self.nodes, self.most = {n.first: n for n in nodes}, max(n.first for n in nodes)

    def __call__(self, value) -> Column:
        got = [value(self.nodes[i]) if i in self.nodes else None for i in range(self.most + 1)]
        return F.get(F.array(*(F.lit(v).cast("bigint") for v in got)), F.col("node"))


def _key(of: _Lookup, axes: list[str], ties: list[str]) -> list[Column]:
    axis = F.get(F.array(*axes), of(lambda n: axes.index(n.axis)).cast("int"))
    return [axis, *(F.col(t) for t in ties)]


def grow(points: DataFrame, axes: list[str], ties: list[str], shards: int) -> DataFrame:
    """``points`` (integer axes and ties, ``weight``) with ``node``, the leaf of each.

    A cut is (axis, ties...): the ties order what is equal on the axis, so a cut falls
    between any two rows that differ in them. At most ``shards`` nodes times BINS sums reach
    the driver at once.
    """
    placed = points.withColumn("node", F.lit(0))
    root = _Node(0, shards)
    while open_ := [n for n in _open(root) if n.count > 1]:
        by_id = {n.first: n for n in open_}
        sums = placed.groupBy("node").agg(
            F.sum("weight").alias("total"),
            *(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))),
        )
        for r in sums.collect():
            if node := by_id.get(r["node"]):
                node.total = int(r["total"])
                node.box = {a: (r[f"lo_{a}"], r[f"hi_{a}"]) for a in axes}
        whole = root.box or {a: (0, 0) for a in axes}
        for node in open_:
            # the widest, as a share of the whole table's width
            width = {
                a: (hi - lo) / max(1, whole[a][1] - whole[a][0]) for a, (lo, hi) in node.box.items()
            }
            node.axis = max(axes, key=lambda a: width.get(a, 0))
            node.goal = node.total * (node.count // 2) / node.count
            node.low, node.high = node.box.get(node.axis, (0, 0))
            node.below, node.fixed = 0, []
        _cut(placed, open_, axes, ties)
        of = _Lookup(open_)
        key = _key(of, axes, ties)
        before = F.lit(False)
        for i in reversed(range(len(key))):
            value = of(lambda n, i=i: n.fixed[i] if i < len(n.fixed) else None)
            # a cut with fewer parts lies before all that equals it
            before = (key[i] < value) | ((key[i] == value) & before)
        half = of(lambda n: n.count // 2)
        side = F.when(F.coalesce(before, F.lit(False)), 0).otherwise(F.coalesce(half, F.lit(0)))
        placed = materialise(placed.withColumn("node", (F.col("node") + side).cast("int")), "nodes")
        for node in open_:
            half = node.count // 2
            node.left = _Node(node.first, half)
            node.right = _Node(node.first + half, node.count - half)
    return placed


def _cut(placed: DataFrame, nodes: list[_Node], axes: list[str], ties: list[str]) -> None:
    """Finds the cut of each node, part by part of its key."""
    active = list(nodes)
    while active:
        of = _Lookup(active)
        key = _key(of, axes, ties)
        at = of(lambda n: len(n.fixed))
        part = F.get(F.array(*key), at.cast("int"))
        inside = part.between(of(lambda n: n.low), of(lambda n: n.high))
        for i in range(len(key) - 1):
            value = of(lambda n, i=i: n.fixed[i] if i < len(n.fixed) else None)
            inside = inside & ((at <= i) | (key[i] == value))
        number = F.call_function(
            "div", part - of(lambda n: n.low), of(lambda n: (n.high - n.low) // BINS + 1)
        )
        found: dict[int, list] = {}
        sums = placed.filter(inside).groupBy("node", number.alias("bin"))
        for r in sums.agg(F.sum("weight").alias("w"), F.count("*").alias("rows")).collect():
            found.setdefault(r["node"], []).append((r["bin"], int(r["w"]), r["rows"]))
        active = [n for n in active if not _narrow(n, sorted(found.get(n.first, [])), len(ties))]


def _narrow(node: _Node, bins: list[tuple[int, int, int]], n_ties: int) -> bool:
    """Goes on to the bin that holds the median; whether the cut is found."""
    step = (node.high - node.low) // BINS + 1
    place, weight, rows = 0, 0, 0
    for place, weight, rows in bins:
        if node.below + weight >= node.goal:
            break
        node.below += weight
    low = node.low + place * step
    high = min(node.high, low + step - 1)
    near = rows == 1 or weight <= NEAR * node.total / node.count
    if low < high and bins and not near:
        node.low, node.high = low, high
        return False
    # one value holds the median: cut inside it by the next part, or at the nearer side
    if bins and len(node.fixed) < n_ties and not near:
        node.fixed.append(low)
        node.low, node.high = 0, _MOST
        return False
    node.fixed.append(high + 1 if node.goal - node.below > weight / 2 else low)
    return True


def shard(documents: DataFrame, shards: int = 40, axes: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` for every row.

    The size is the text's UTF-8 bytes, none for null, plus 16. ``axes`` are integer columns
    of documents, by default what the text itself fixes: its size, and its language by the
    letters it has (so that copies fall together). Shards are 0 to ``shards`` - 1 with near
    equal sizes; within a shard slots are gapless from 0. Rows that repeat get slots of
    their own. An empty table gives none. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text) + 16
    axes = axes or default_axes(text)
    points = materialise(
        documents.select(
            "doc_id",
            size.cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 2).alias("text_key"),
            # rows that repeat are told apart by their place in the table
            F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2).alias("row_key"),
            # a null on an axis counts as 0
            *(F.coalesce(c.cast("bigint"), F.lit(0)).alias(f"axis_{n}") for n, c in axes.items()),
        ).withColumn("weight", F.col("size")),
        "points",
    )
    ties = ["text_key", "row_key"]
    found = grow(points, [f"axis_{n}" for n in axes], ties, shards)
    found = found.withColumnRenamed("node", "shard")
    return numbered(found, ["shard"], ties, "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )


def default_axes(text: Column) -> dict[str, Column]:
    beyond_ascii = F.octet_length(text) - F.length(text)
    return {
        "size": F.octet_length(text),
        "letters": (1000 * beyond_ascii / F.greatest(F.length(text), F.lit(1))).cast("bigint"),
        "words": (1000 * (F.length(text) - F.length(F.translate(text, " ", ""))))
        / F.greatest(F.length(text), F.lit(1)),
    }
