"""Severity: spellings to the six ordered levels, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtables.functions.text import strip

# The level names in order, the accepted spellings, the one-letter
# forms, the numeric forms, and the words looked for in free text.
LEVEL_NAMES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
LEVEL_WORDS = {
    "trace": 0,
    "debug": 1,
    "info": 2,
    "information": 2,
    "notice": 2,
    "warn": 3,
    "warning": 3,
    "error": 4,
    "err": 4,
    "fatal": 5,
    "critical": 5,
    "crit": 5,
    "emergency": 5,
}
LEVEL_LETTERS = {"t": 0, "d": 1, "i": 2, "w": 3, "e": 4, "f": 5}
LEVEL_NUMBERS = {"10": 0, "20": 1, "30": 2, "40": 3, "50": 4, "60": 5}
LEVEL_SCAN = r"\b(fatal|critical|error|warn(?:ing)?|debug|trace)\b"

INFO, ERROR, FATAL = 2, 4, 5
_SPELLINGS = {**LEVEL_WORDS, **LEVEL_LETTERS, **LEVEL_NUMBERS}
_SPELLING_MAP = "map(" + ", ".join(f"'{k}', {v}" for k, v in _SPELLINGS.items()) + ")"


def normalize_level(value: Column) -> Column:
    """0..5 for any common spelling of a severity, NULL for anything else."""
    token = F.lower(strip(value))
    spellings = F.expr(_SPELLING_MAP)
    digits = F.regexp_replace(token, "^0+(?=[0-9])", "")
    number = F.when(
        token.rlike("^[0-9]+$"),
        F.coalesce(
            F.try_element_at(spellings, digits),
            # numbers too long for a bigint are far beyond the highest level
            F.least(digits.try_cast("bigint"), F.lit(FATAL)),
            F.lit(FATAL),
        ),
    )
    return F.coalesce(F.try_element_at(spellings, token), number).cast("int")


def scan_level(message: Column) -> Column:
    """Level of the first severity word in free text, NULL if there is none."""
    word = F.regexp_extract(message, "(?iU)" + LEVEL_SCAN, 1)
    return F.try_element_at(F.expr(_SPELLING_MAP), F.lower(word))


def level_name(level: Column) -> Column:
    """Upper-case name of a 0..5 level."""
    return F.get(F.array(*[F.lit(n) for n in LEVEL_NAMES]), level)


def level_number(value: str | int) -> int:
    """Level of a literal search argument; ValueError if it is not one."""
    token = str(value).strip().lower()
    if token in _SPELLINGS:
        return _SPELLINGS[token]
    if token.isdigit():
        return LEVEL_NUMBERS.get(str(int(token)), min(int(token), FATAL))
    raise ValueError(f"unknown level {value!r}")
