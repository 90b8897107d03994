"""Text expressions: trimming, variable masking, template comparison, search folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as characters to trim and as a character class.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The wildcard, and the variable parts it replaces - UUID, IPv4
# address, 0x number, integer - tried in this order.
WILDCARD = "<*>"
MASKS = (
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"\b0x[0-9a-fA-F]+\b",
    r"\b\d+\b",
)


# The masks as ordered alternatives of one expression. Every mask starts and ends
# at a word edge, so none can begin inside the match of another and one scan gives
# what one pass per mask gives. The edges, and a look at the first character, are
# tested once for all of them.
_WORD = r"[\p{L}\p{N}_]"
_ANY_MASK = (
    rf"(?U)(?<!{_WORD})(?=[\da-fA-F])(?:"
    + "|".join(m.removeprefix(r"\b").removesuffix(r"\b") for m in MASKS)
    + rf")(?!{_WORD})"
)


def strip(value: Column) -> Column:
    """Trim all Unicode white space (SQL trim removes blanks only)."""
    return F.btrim(value, F.lit(SPACES))


def mask_variables(message: Column) -> Column:
    """Replace variable parts by the wildcard."""
    return F.regexp_replace(message, _ANY_MASK, F.lit(WILDCARD))


def message_pattern(message: Column) -> Column:
    """Masked message with white space runs folded to one blank."""
    return F.regexp_replace(strip(mask_variables(message)), SPACE_CLASS + "+", " ")


def pattern_tokens(pattern: Column) -> Column:
    """Tokens of a pattern; the empty pattern has none."""
    return F.when(pattern == "", F.array().cast("array<string>")).otherwise(
        F.split(pattern, " ")
    )


def template_similarity(template: Column, message: Column) -> Column:
    """Share of token positions the template matches; 0 if the lengths differ."""
    same = F.filter(
        F.zip_with(template, message, lambda t, m: (t == WILDCARD) | (t == m)), lambda x: x
    )
    return (
        F.when(F.size(template) != F.size(message), 0.0)
        .when(F.size(template) == 0, 1.0)
        .otherwise(F.size(same) / F.size(template))
    )


def merge_templates(template: Column, message: Column) -> Column:
    """Template generalised to cover the message: differing positions become wild."""
    return F.zip_with(template, message, lambda t, m: F.when(t == m, t).otherwise(WILDCARD))


def _accent_table() -> tuple[str, str]:
    """Every accented Latin letter beside its plain letter, by Unicode decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFD", chr(code).lower())[0]
        if plain.isascii() and plain.isalpha():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(p for _, p in pairs)


ACCENTED, PLAIN = _accent_table()


def search_form(text: Column) -> Column:
    """Lower-case letters and digits without accents, words set off by single blanks.

    A phrase occurs in a text exactly if its search form, blanks included, is
    contained in the search form of the text.
    """
    lower = F.lower(text)
    ascii_only = F.length(lower) == F.octet_length(lower)
    # accents may also stand behind their letter, as marks of their own
    bare = F.regexp_replace(F.translate(lower, ACCENTED, PLAIN), r"\p{Mn}+", "")
    plain = F.when(ascii_only, lower).otherwise(bare)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
