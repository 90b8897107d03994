"""Quality rules as a short-circuit cascade, in DataFrame operations alone.

The time that each rule takes and the share it rejects are estimated on a sample. The rules
then run by rejection per cost, the highest first, and a document that one rejects is not
looked at by those after it. A document stays if no rule rejects it, so the order, and with
it the sample, decides the cost and never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.scratch import materialise

#: Rows at most that costs and rejections are estimated on, and the share they come from.
SAMPLE_ROWS, SAMPLE_SHARE = 2_000, 0.05

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
#: Words of a window whose return counts as repetition.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes a true-or-false column of the text column's measures."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, _SYMBOLS, ""))).cast("bigint")


def _lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")


def n_dup_lines(text: Column) -> Column:
    lines = _lines(text)
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(all_words: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice.

    The windows' hashes are sorted along with their places; equal neighbours, compared word
    by word, are repeats. Most texts have no equal hashes and stop there.
    """

    def of_hashes(w: Column, h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: _covered(F.sort_array(_repeated(w, s))))

    def same(w: Column, x: Column, y: Column) -> Column:
        both = x["h"] == y["h"]
        return both & (F.slice(w, x["i"] + 1, width) == F.slice(w, y["i"] + 1, width))

    def _repeated(w: Column, s: Column) -> Column:
        def neighbours(x: Column, i: Column) -> Column:
            before = (i > 0) & F.coalesce(same(w, x, F.get(s, i - 1)), F.lit(False))
            return before | F.coalesce(same(w, x, F.get(s, i + 1)), F.lit(False))

        return F.transform(F.filter(s, neighbours), lambda x: x["i"])

    def _covered(places: Column) -> Column:
        def steps(p: Column) -> Column:
            ahead = F.transform(
                p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))
            )
            return F.aggregate(ahead, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return _let(places, steps)

    def counted(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        windows = _let(
            hashes,
            lambda v: F.transform(
                F.slice(v, 1, F.greatest(F.size(v) - (width - 1), F.lit(0))),
                lambda x, i: F.xxhash64(x, *(F.get(v, i + k) for k in range(1, width))),
            ),
        )
        return _let(
            windows,
            lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0).cast("bigint"))
            .otherwise(of_hashes(w, h)),
        )

    return _let(all_words, counted)


def _n_bars(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))


def measures(text: Column, all_words: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(all_words).cast("bigint"),
        "word_chars": word_chars(text),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(all_words),
    }


#: What rejects a document in any case.
BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
)
#: Clean prose is far from these bounds: it has next to no such characters, words of about
#: five letters, and few equal lines.
RULES = (
    *BASE_RULES,
    # bars alone are no noise: tables of plain words have one between any two cells
    Rule("symbols", lambda m: 100 * (m["n_symbols"] - _n_bars(m["text"])) > 25 * m["n_words"]),
    Rule("exclamations", lambda m: 2 * F.regexp_count(m["text"], F.lit("!!")) > m["n_words"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > F.size(_lines(m["text"]))),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
)


def estimate(
    documents: DataFrame,
    rules: tuple[Rule, ...],
    rows: int = SAMPLE_ROWS,
    share: float = SAMPLE_SHARE,
) -> list[tuple[float, str, float, float]]:
    """(rejection per second, rule, share rejected, seconds), best first, on a sample."""
    sample = documents.select("text").sample(share, seed=7).limit(rows)
    sample = materialise(sample, "quality_sample")
    text = F.coalesce("text", F.lit(""))

    def timed(column: Column) -> tuple[float, float]:
        start = time.perf_counter()
        got = sample.agg(F.avg(column.cast("int"))).first()[0]
        return time.perf_counter() - start, float(got or 0.0)

    # the fastest of several runs: the first ones compile
    empty, _ = min(timed(F.length(text) < 0) for _ in range(3))
    found = []
    for rule in rules:
        verdict = rule.rejects(measures(text, words(text)) | {"text": text})
        seconds, rejected = min(timed(verdict) for _ in range(3))
        cost = max(seconds - empty, 1e-3)
        found.append((rejected / cost, rule.name, rejected, cost))
    return sorted(found, reverse=True)


def cascade(
    documents: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    order: list[str] | None = None,
    known: dict[str, Column] | None = None,
) -> Column:
    """The name of a rule that rejects the document, or null if it stays.

    A ``when`` chain: a branch is computed only for rows that no earlier one took. ``known``
    gives measures that are columns already. A null text counts as empty, so it has no words.
    """
    order = order or [name for _, name, _, _ in estimate(documents, rules)]
    text = F.coalesce(documents["text"], F.lit(""))
    values = {"text": text} | (known or measures(text, words(text)))
    by_name = {rule.name: rule for rule in rules}
    verdict = None
    for name in order:
        hit = by_name[name].rejects(values)
        verdict = F.when(hit, name) if verdict is None else verdict.when(hit, name)
    return verdict


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``documents``, all their columns, that no rule rejects.

    An empty table stays empty; rows that repeat are judged alike.
    """
    return documents.filter(cascade(documents, rules).isNull())


def measured(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the five measures, ``base_failed`` and ``kept`` for every row.

    Words are what stands between ASCII white space. A null or empty text has none: all
    measures are 0, and it isn't kept. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    # the words are made once: two references keep them in a projection of their own
    docs = documents.select("doc_id", text.alias("text"), words(text).alias("words"))
    found = docs.select("doc_id", "text", *(
        c.alias(n) for n, c in measures(F.col("text"), F.col("words")).items()
    ))
    known = {n: F.col(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.rejects(known)
    order = [name for _, name, _, _ in estimate(documents, rules)]
    return found.withColumns(
        {"base_failed": base, "kept": cascade(found, rules, order, known).isNull()}
    ).drop("text")
