"""Secrets in texts, in DataFrame operations alone.

Known forms are found by pattern. Other secrets show by their disorder: over each candidate
string, a run of one character class, a window slides, and its Shannon entropy is kept up to
date from the counts of the character that enters and the one that leaves. Strings on the
allow-list don't count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"
#: c * log2(c) is kept as a whole number of this fraction, so that sums are exact.
_UNIT = 1_000_000


@dataclass(frozen=True)
class Form:
    """A known form: leftmost matches of ``pattern`` that don't overlap, those whose
    ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


@dataclass(frozen=True)
class Disorder:
    """Runs of ``charset``, longer than the window, whose entropy somewhere reaches ``bits``."""

    kind: str
    charset: str
    bits: float
    unlike: str | None = None  # a class that has runs of its own


FORMS = (
    Form(
        "assign",
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    Form("access", "AKIA[A-Z0-9]+", 0, 18),
    # runs can't overlap, so the least length may stand in the pattern
    Form("hex", "[0-9a-f]{16,}", 0, 16),
)
DISORDERS = (
    Disorder("entropy_hex", "0-9a-fA-F", 3.0),
    Disorder("entropy_base64", "A-Za-z0-9+/_=-", 3.7, unlike="0-9a-fA-F"),
)
WINDOW = 20
#: Longer runs are looked at in pieces of so many characters.
PIECE = 256
#: Strings that look random and are public.
ALLOWED = (
    "(?i)example",
    "(?i)0123456789abcdef",
    "(?i)abcdefghijklmnop",
    "(?i)^d41d8cd98f00b204e9800998ecf8427e$",
    "(?i)^da39a3ee5e6b4b0d3255bfef95601890afd80709$",
    "(?i)^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$",
)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, wanted) -> Column:
    """Array of (start, end, found) for the matches that ``wanted`` accepts.

    Matches are put between two control characters (those of the text give way to a third,
    which no pattern has), and places follow from the lengths of the parts between.
    """
    clean = F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)
    parts = F.split(F.regexp_replace(clean, pattern, _OPEN + "$0" + _CLOSE), _OPEN)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")

    def step(state: Column, part: Column) -> Column:
        found = F.substring_index(part, _CLOSE, 1)
        end = state["at"] + F.length(found)
        span = F.struct(state["at"].alias("start"), end.alias("end"), found.alias("found"))
        spans = F.when(wanted(found), F.concat(state["spans"], F.array(span)))
        return F.struct(
            (state["at"] + F.length(part) - 1).alias("at"),
            spans.otherwise(state["spans"]).alias("spans"),
        )

    def spans(p: Column) -> Column:
        first = F.length(F.get(p, F.lit(0))).cast("bigint").alias("at")
        start = F.struct(first, empty.alias("spans"))
        rest = F.slice(p, F.lit(2), F.size(p) - 1)
        return F.when(F.size(p) == 1, empty).otherwise(
            F.aggregate(rest, start, step, lambda s: s["spans"])
        )

    return _let(parts, spans)


def _of_form(text: Column, form: Form) -> Column:
    def wanted(found: Column) -> Column:
        value = F.regexp_extract(found, form.pattern, form.group) if form.group else found
        return F.length(value) >= form.least

    return matches(text, form.pattern, wanted)


def least_order(string: Column, window: int) -> Column:
    """The least sum of c * log2(c), over the counts c of a window's characters, in units.

    Entropy is log2(window) - sum / window, so this is where entropy is highest. When the
    window moves on, only the counts of two characters change.
    """
    table = F.array(*(F.lit(round(_UNIT * c * math.log2(c)) if c else 0) for c in range(window + 1)))

    def change(rest: Column, char: Column) -> Column:
        """What the sum gains as ``char`` joins ``rest``."""
        count = F.length(rest) - F.length(F.replace(rest, char, F.lit("")))
        return F.get(table, count + 1) - F.get(table, count)

    def step(state: Column, i: Column) -> Column:
        shared = F.substring(string, F.greatest(i - (window - 1), F.lit(1)), F.least(i, F.lit(window)) - 1)
        enters = F.substring(string, i, F.lit(1))
        leaves = F.substring(string, i - window, F.lit(1))
        lost = F.when(i > window, change(shared, leaves)).otherwise(0)
        now = state["sum"] + change(shared, enters) - lost
        best = F.when(i >= window, F.least(state["least"], now)).otherwise(state["least"])
        return F.struct(now.cast("bigint").alias("sum"), best.cast("bigint").alias("least"))

    start = F.struct(
        F.lit(0).cast("bigint").alias("sum"), F.lit(1 << 60).cast("bigint").alias("least")
    )
    return F.aggregate(F.sequence(F.lit(1), F.length(string)), start, step, lambda s: s["least"])


def least_order_of_run(run: Column, window: int, piece: int = PIECE) -> Column:
    """:func:`least_order` of a run of any length, in time linear in it.

    The run is cut into pieces that overlap by a character less than the window, so each
    window lies whole in one of them; places in a string cost time only within its piece.
    """
    ahead = piece - window + 1
    pieces = F.regexp_extract_all(run, F.lit(f"(?=(.{{1,{piece}}})).{{1,{ahead}}}"), F.lit(1))
    return F.array_min(F.transform(pieces, lambda p: least_order(p, window)))


def _of_disorder(text: Column, kind: Disorder, window: int, allowed: tuple[str, ...]) -> Column:
    most = round(_UNIT * window * (math.log2(window) - kind.bits))

    def wanted(found: Column) -> Column:
        mixed = found.rlike("[0-9]") & found.rlike("[A-Za-z]")
        if kind.unlike:
            mixed = mixed & found.rlike(f"[^{kind.unlike}]")
        for pattern in allowed:
            mixed = mixed & ~found.rlike(pattern)
        return F.when(mixed, least_order_of_run(found, window) <= most).otherwise(False)

    return matches(text, f"[{kind.charset}]{{{window},}}", wanted)


def find_secrets(
    documents: DataFrame,
    forms: tuple[Form, ...] = FORMS,
    disorders: tuple[Disorder, ...] = DISORDERS,
    window: int = WINDOW,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """``doc_id`` and ``found``: an array of (start, rank, end, kind) in order, for every row.

    Places are code points, the end exclusive; ``rank`` is the place of the kind among forms
    and disorders. A null or empty text has no secrets. Rows that repeat each have their own
    result; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    kinds = [(f.kind, _of_form(text, f)) for f in forms]
    kinds += [(d.kind, _of_disorder(text, d, window, allowed)) for d in disorders]

    def placed(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(rank).alias("rank"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
            ),
        )

    every = F.concat(*(placed(rank, kind, spans) for rank, (kind, spans) in enumerate(kinds)))
    return documents.select("doc_id", F.sort_array(every).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def digest(secrets: DataFrame, forms: tuple[Form, ...] = FORMS) -> DataFrame:
    """Counts of each form, a hash of the spans of forms, and all spans as text."""
    base = F.filter("found", lambda s: s["rank"] < len(forms))

    def number(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("bigint")

    return secrets.select(
        "doc_id",
        *(number(rank).alias(f"n_{f.kind}") for rank, f in enumerate(forms)),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
