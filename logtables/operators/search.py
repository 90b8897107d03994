"""Searching events: typed terms folded into one filter, newest first."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.functions.levels import level_name, level_number
from logtables.functions.text import search_form
from logtables.functions.times import duration_seconds, epoch_ms, utc, utc_date

SEARCH_TEXT = "search_text"


def _all_of(terms: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, terms, F.lit(True))


def _like(value: Column, pattern: str) -> Column:
    """Case-insensitive LIKE in which only ``%`` and ``_`` are special."""
    return F.ilike(value, F.lit(pattern.replace("\\", "\\\\")))


def at_least(level: str | int) -> Column:
    """Severity ``level`` or worse."""
    return F.col("level") >= level_number(level)


def from_source(source: str) -> Column:
    """Exact, case-sensitive source."""
    return F.col("source") == source


def field_equals(key: str, value: object) -> Column:
    """Extracted field with exactly this text; a missing field counts as empty."""
    return F.coalesce(F.try_element_at("fields", F.lit(key)), F.lit("")) == str(value)


def field_like(key: str, value: object) -> Column:
    """Loose field match on the fields as JSON text, wildcards active."""
    return _like(F.to_json("fields"), f'%"{key}":%{value}%')


def within(
    last: str | int, now: Column | datetime | None = None, dated: bool = True
) -> Column:
    """Event time at most ``last`` before ``now``; prunes partitions if ``dated``."""
    now = F.current_timestamp() if now is None else now
    now = now if isinstance(now, Column) else F.lit(now)
    span = duration_seconds(last)
    fresh = epoch_ms(F.col("ts")) >= epoch_ms(now) - F.lit(span * 1000)
    # plain comparisons, a millisecond wider, that Parquet and partitions can skip by
    cutoff = now - F.expr(f"interval {span} seconds") - F.expr("interval 1 millisecond")
    fresh = fresh & (F.col("ts") >= cutoff)
    return fresh & (F.col("event_date") >= utc_date(cutoff)) if dated else fresh


def add_search_text(events: DataFrame) -> DataFrame:
    """Store the search form of message and source, so searches need not rebuild it."""
    text = F.concat(search_form(F.col("message")), F.lit("|"), search_form(F.col("source")))
    return events.withColumn(SEARCH_TEXT, text)


def has_phrase(phrase: str, stored: bool = False) -> Column:
    """Phrase of whole words in message or source, ignoring case and accents.

    NULL for a phrase without any word: such a term says nothing.
    """
    wanted = search_form(F.lit(phrase))
    if stored:
        found = F.col(SEARCH_TEXT).contains(wanted)
    else:
        found = search_form(F.col("message")).contains(wanted) | search_form(
            F.col("source")
        ).contains(wanted)
    return F.when(wanted != "  ", found)


def has_phrases(phrases: Iterable[str], stored: bool = False) -> Column:
    """Every phrase that has words; nothing if none of them has any."""
    terms = [has_phrase(p, stored) for p in phrases]
    some = functools.reduce(operator.or_, [t.isNotNull() for t in terms])
    return some & _all_of(F.coalesce(t, F.lit(True)) for t in terms)


def has_substring(text: str) -> Column:
    """Case-insensitive substring of the message."""
    return F.lower("message").contains(F.lower(F.lit(text)))


def message_like(text: str) -> Column:
    """Case-insensitive substring of the message, wildcards active."""
    return _like(F.col("message"), f"%{text}%")


def where(
    events: DataFrame,
    *,
    level: str | int | None = None,
    source: str | None = None,
    last: str | int | None = None,
    now: Column | datetime | None = None,
    fields: Mapping[str, object] | None = None,
    text: Iterable[str] = (),
    text_mode: str = "phrase",
    field_mode: str = "exact",
) -> DataFrame:
    """Events meeting every given term; all events if there is none.

    ``text_mode`` is ``phrase``, ``substring`` or ``like``; ``field_mode`` is
    ``exact`` or ``loose``. Works on streams as well as on tables.
    """
    field_term = {"exact": field_equals, "loose": field_like}[field_mode]
    phrases = [text] if isinstance(text, str) else list(text)
    terms = []
    if level is not None:
        terms.append(at_least(level))
    if source is not None:
        terms.append(from_source(source))
    if last is not None:
        terms.append(within(last, now, "event_date" in events.columns))
    terms += [field_term(k, v) for k, v in (fields or {}).items()]
    if phrases and text_mode == "phrase":
        terms.append(has_phrases(phrases, SEARCH_TEXT in events.columns))
    else:
        text_term = {"substring": has_substring, "like": message_like, "phrase": None}[text_mode]
        terms += [text_term(p) for p in phrases]
    return events.filter(_all_of(terms))


def newest(events: DataFrame, limit: int = 100) -> DataFrame:
    """The latest ``limit`` events, newest first; equal times by event id."""
    return events.orderBy(F.desc("ts"), "event_id").limit(limit)


def oldest_first(results: DataFrame) -> DataFrame:
    """Limited results turned round for reading."""
    return results.orderBy("ts", F.desc("event_id"))


def search(events: DataFrame, *, limit: int = 100, **terms) -> DataFrame:
    """The latest ``limit`` events meeting the terms of :func:`where`."""
    return newest(where(events, **terms), limit)


def only_listed(events: DataFrame, hits: DataFrame, key: str = "event_id") -> DataFrame:
    """Events whose key is in a given list of hits."""
    return events.join(hits.select(key), key, "left_semi")


def filter_any(events: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive substring of message or source; an empty one keeps all."""
    if not needle:
        return events
    wanted = F.lower(F.lit(needle))
    return events.filter(
        F.lower("message").contains(wanted) | F.lower("source").contains(wanted)
    )


def format_events(events: DataFrame, out: str = "line") -> DataFrame:
    """Add ``HH:MM:SS LEVEL [source] message`` in UTC."""
    clock = F.date_format(utc(F.col("ts")), "HH:mm:ss")
    line = F.format_string(
        "%s %-5s [%s] %s", clock, level_name(F.col("level")), F.col("source"), F.col("message")
    )
    return events.withColumn(out, line)
