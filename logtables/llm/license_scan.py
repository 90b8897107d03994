"""Licence texts in documents, in DataFrame operations alone.

Each scanned unit (a line, a paragraph, the whole text) and each template is a set of word
bigrams. Their Dice coefficient 2|A & B| / (|A| + |B|) can reach a threshold t only if
|A| lies between t/(2-t) and (2-t)/t times |B|, so most templates are never compared.

A notice may share its unit with other words. Windows of as many words as a template slide
over what no unit took, in texts that have enough of the template's bigrams: t/(2-t) |B|.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient, in percent.
PERCENT = 80

#: Notices of common licences, as their holders publish them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
        "agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific "
        "prior written permission.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
}

#: Stands for a word that a unit took; no template has it.
_TAKEN = "\ue000"

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: str) -> list[str]:
    out, word = [], ""
    for c in text.translate(str.maketrans(*_LOWER)) + " ":
        if c.isascii() and not c.isalnum():
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normalised(text: Column) -> Column:
    """A-Z lower-cased words of letters, digits and what is beyond ASCII, one space between."""
    lower = F.translate(text, *_LOWER)
    return F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words; fewer than two words have none."""
    pairs = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)),
    )
    return F.array_distinct(pairs)


def _bounds(size: int, percent: int) -> tuple[int, int]:
    """Sizes that can reach the threshold against a set of ``size``, both included."""
    return -(-size * percent // (200 - percent)), size * (200 - percent) // percent


def scan_licenses(
    documents: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, percent: int = PERCENT
) -> DataFrame:
    """``doc_id`` and ``licenses`` for every row: one (license, dice, unit, place) for each
    unit that a template fits, the best template of it, ties to the first name.

    Units are the lines, the paragraphs of more than one line, and the whole text if it has
    several paragraphs; ``place`` is the number of the line or paragraph from 0. Windows of
    the words outside these are units too (``place`` is their first word); of those that
    overlap the one with most in common counts. ``dice`` is
    a percentage, rounded down. A null or empty text has none. Templates of fewer than two
    words have no bigrams and fit nothing. Rows that repeat each have their own result; other
    columns are ignored.
    """
    known = [
        (name, grams) for name in sorted(templates) for t in templates[name] if (grams := _bigrams(t))
    ]
    reach = [_bounds(len(g), percent) for _, g in known]
    low = min((a for a, _ in reach), default=1)
    high = max((b for _, b in reach), default=0)
    kind = "array<struct<unit:string,place:int,text:string>>"
    text = F.coalesce("text", F.lit(""))
    paragraphs = F.split(text, r"\n[\x20\x09-\x0D]*\n")

    def units(parts: Column, name: str, wanted) -> Column:
        placed = F.transform(
            parts,
            lambda x, i: F.struct(
                F.lit(name).alias("unit"), i.cast("int").alias("place"), x.alias("text")
            ),
        )
        return F.filter(placed, lambda u: wanted(u["text"]))

    # fewer characters than words and spaces need can't hold the bigrams of any template
    least = 2 * low
    every = F.concat(
        units(F.split(text, "\n"), "line", lambda t: F.length(t) > least),
        units(paragraphs, "paragraph", lambda t: (F.length(t) > least) & t.contains("\n")),
        F.when(F.size(paragraphs) > 1, units(F.array(text), "text", lambda t: F.length(t) > least))
        .otherwise(F.array().cast(kind)),
    ).cast(kind)

    def fit(grams: Column) -> Column:
        """The best (dice, -rank, name) among templates whose size is in reach."""
        size = F.size(grams)
        best = None
        for rank, ((name, own), (a, b)) in enumerate(zip(known, reach)):
            both = F.size(F.array_intersect(grams, F.array(*map(F.lit, own))))
            dice = F.when(size.between(a, b), 200 * both)
            one = F.struct(
                F.floor(dice / (size + len(own))).cast("int").alias("dice"),
                F.lit(-rank).alias("rank"),
                F.lit(name).alias("license"),
            )
            one = F.when(dice >= percent * (size + len(own)), one)
            best = [one] if best is None else [*best, one]
        return F.array_max(F.array(*best))

    def scored(unit: Column) -> Column:
        words = F.split(normalised(unit["text"]), " ")
        # repeated words make sets smaller than texts, never larger: a lower bound only
        grams = _let(
            words, lambda w: F.when(F.size(w) > low, bigrams(w)).otherwise(F.array().cast("array<string>"))
        )
        found = _let(
            grams, lambda g: F.when(F.size(g).between(low, high), fit(g)) if known else F.lit(None)
        )
        return _let(
            found,
            lambda f: F.struct(
                f["license"].alias("license"),
                f["dice"].alias("dice"),
                unit["unit"].alias("unit"),
                unit["place"].alias("place"),
            ),
        )

    if not known:
        none = F.array().cast("array<struct<license:string,dice:int,unit:string,place:int>>")
        return documents.select("doc_id", none.alias("licenses"))
    found = F.filter(F.transform(every, scored), lambda x: x["license"].isNotNull())
    lengths = [len(_words(t)) for name in sorted(templates) for t in templates[name] if _bigrams(t)]
    pool = F.array(*map(F.lit, sorted({g for _, own in known for g in own})))
    spot = "struct<at:int,words:int,dice:int,rank:int>"

    def common(pairs: Column) -> Column:
        """Bigrams of the text that some template has."""
        return F.array_intersect(pairs, pool)

    def enough(shared: Column, own: list[str], least: int) -> Column:
        both = F.size(F.array_intersect(shared, F.array(*map(F.lit, own))))
        return (F.size(shared) >= least) & (both >= least)

    def left_over(f: Column) -> Column:
        """The text with a word of no template for every word that a unit took."""

        def taken(part: Column) -> Column:
            return F.regexp_replace(normalised(part), "[^ ]+", _TAKEN)

        def places(unit: str) -> Column:
            return F.transform(F.filter(f, lambda x: x["unit"] == unit), lambda x: x["place"])

        def without(parts: Column, unit: str) -> Column:
            return F.transform(
                parts,
                lambda x, i: F.when(F.array_contains(places(unit), i), taken(x)).otherwise(x),
            )

        by_line = F.array_join(without(F.split(text, "\n"), "line"), "\n")
        by_paragraph = without(F.split(by_line, r"\n[\x20\x09-\x0D]*\n"), "paragraph")
        return F.array_join(by_paragraph, "\n\n")

    def sliding(pairs: Column) -> Column:
        """Windows that a template fits, by place."""

        def of(rank: int, own: list[str], n: int) -> Column:
            grams = F.array(*map(F.lit, own))

            def at(i: Column) -> Column:
                window = F.slice(pairs, i + 1, n - 1)
                total = _let(
                    window,
                    lambda w: F.struct(
                        F.size(F.array_intersect(w, grams)).alias("both"),
                        (F.size(F.array_distinct(w)) + len(own)).alias("total"),
                    ),
                )
                return _let(
                    total,
                    lambda x: F.struct(
                        i.cast("int").alias("at"),
                        F.lit(n).alias("words"),
                        F.when(200 * x["both"] >= percent * x["total"], 200 * x["both"] / x["total"])
                        .cast("int").alias("dice"),
                        F.lit(-rank).alias("rank"),
                    ),
                )

            starts = F.sequence(F.lit(0), F.size(pairs) - (n - 1))
            fits = F.filter(F.transform(starts, at), lambda x: x["dice"].isNotNull())
            shared = enough(common(pairs), own, _bounds(len(own), percent)[0])
            return F.when(shared & (F.size(pairs) >= n - 1), fits).otherwise(
                F.array().cast(f"array<{spot}>")
            )

        fits = F.concat(*(of(k, own, n) for k, ((_, own), n) in enumerate(zip(known, lengths))))
        return F.array_sort(fits)

    def best_apart(fits: Column) -> Column:
        """Of windows that overlap the one with most in common, so that a notice isn't also
        found as the shorter one that it begins with."""

        def add(kept: Column, x: Column) -> Column:
            last = F.get(kept, F.size(kept) - 1)
            apart = (F.size(kept) == 0) | (x["at"] >= last["at"] + last["words"])
            better = F.struct(x["dice"] * x["words"], x["rank"]) > F.struct(
                last["dice"] * last["words"], last["rank"]
            )
            replaced = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))
            return F.when(apart, F.concat(kept, F.array(x))).when(better, replaced).otherwise(kept)

        return F.aggregate(fits, F.array().cast(f"array<{spot}>"), add)

    def pairs_of(t: Column) -> Column:
        return _let(
            F.split(normalised(t), " "),
            lambda w: F.transform(
                F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
                lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)),
            ),
        )

    names = F.array(*(F.lit(name) for name, _ in known))
    none = F.array().cast("array<struct<license:string,dice:int,unit:string,place:int>>")
    worth = F.lit(False)
    for (_, own), (a, _) in zip(known, reach):
        worth = worth | enough(F.col("shared"), own, a)
    scanned = documents.select(
        "doc_id", text.alias("text"), found.alias("found"), common(pairs_of(text)).alias("shared")
    )
    windows = _let(
        pairs_of(left_over(F.col("found"))),
        lambda p: F.transform(
            best_apart(sliding(p)),
            lambda x: F.struct(
                F.get(names, -x["rank"]).alias("license"),
                x["dice"].alias("dice"),
                F.lit("window").alias("unit"),
                x["at"].alias("place"),
            ),
        ),
    )
    whole = F.exists("found", lambda x: x["unit"] == "text")
    windows = F.when(worth & ~whole, windows).otherwise(none)
    return scanned.select("doc_id", F.concat("found", windows).alias("licenses"))
