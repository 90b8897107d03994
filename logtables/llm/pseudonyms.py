"""Personal numbers, dates and addresses replaced by keyed pseudonyms of the same form.

A value is a sequence of digits with a radix each. A Feistel network over the two halves of
that sequence, keyed and tweaked by the kind and the layout, permutes all values of its form;
where only some values are valid, it is walked until it meets a valid one, which keeps it a
permutation of those. Equal values get equal pseudonyms in every document, and the key
takes them back.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _product(radices: list[int]) -> int:
    out = 1
    for r in radices:
        out *= r
    return out


def _round(key: bytes, tweak: bytes, number: int, half: int, size: int) -> int:
    width = (half.bit_length() + 7) // 8 or 1
    need = (size.bit_length() + 7) // 8 + 8
    out, block = b"", 0
    while len(out) < need:
        seed = b"%d|%d|%s|" % (number, block, tweak) + half.to_bytes(width, "big")
        out += blake2b(seed, key=key, digest_size=64).digest()
        block += 1
    return int.from_bytes(out[:need], "big") % size


def feistel(value: int, left: int, right: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A permutation of the numbers below ``left * right``."""
    a, b = divmod(value, right)
    sign = -1 if back else 1
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2 == 0:
            a = (a + sign * _round(key, tweak, i, b, left)) % left
        else:
            b = (b + sign * _round(key, tweak, i, a, right)) % right
    return a * right + b


def permuted(
    digits: list[int],
    radices: list[int],
    key: bytes,
    tweak: bytes,
    valid: Callable[[list[int]], bool] | None = None,
    back: bool = False,
) -> list[int]:
    """The pseudonym of a digit sequence; ``valid`` sequences go to valid ones."""
    half = len(radices) // 2
    left, right = _product(radices[:half]), _product(radices[half:])
    value = 0
    for d, r in zip(digits, radices):
        value = value * r + d
    while True:
        value = feistel(value, left, right, key, tweak, back)
        out, rest = [], value
        for r in reversed(radices):
            rest, d = divmod(rest, r)
            out.append(d)
        out.reverse()
        if valid is None or valid(out):
            return out


def luhn(digits: list[int]) -> bool:
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _refill(text: str, chars: list[str]) -> str:
    """``text`` with its letters and digits replaced in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in text)


def _digits_of(text: str) -> list[int]:
    return [int(c) for c in text if c in _DIGITS]


def _number(kind: str, text: str, key: bytes, back: bool, check=None, skip: int = 0) -> str:
    digits = _digits_of(text)
    tweak = f"{kind}{len(digits)}".encode()
    free = permuted(digits[skip:], [10] * (len(digits) - skip), key, tweak, check, back)
    return _refill(text, [*map(str, digits[:skip]), *map(str, free)])


def _card(text: str, key: bytes, back: bool) -> str:
    """Numbers that pass the check digit go to such, the others among themselves."""
    passes = luhn(_digits_of(text))
    return _number(
        "card" if passes else "account", text, key, back, lambda d: luhn(d) == passes
    )


def _phone(text: str, key: bytes, back: bool) -> str:
    """The country code stays."""
    code = re.match(r"\+(\d{1,3})[ ().-]", text)
    return _number("phone", text, key, back, skip=len(code[1]) if code else 0)


def _ssn(text: str, key: bytes, back: bool) -> str:
    return _number("ssn", text, key, back, _is_ssn)


def _is_ssn(d: list[int]) -> bool:
    area = d[0] * 100 + d[1] * 10 + d[2]
    return 0 < area < 900 and area != 666 and d[3:5] != [0, 0] and any(d[5:])


def _ip(text: str, key: bytes, back: bool) -> str:
    parts = [int(x) for x in text.split(".")]
    return ".".join(map(str, permuted(parts, [256] * 4, key, b"ip", None, back)))


def _mail(text: str, key: bytes, back: bool) -> str:
    """The part before the @: letters stay letters, digits digits; the host stays."""
    local, _, host = text.rpartition("@")
    at = [i for i, c in enumerate(local) if c.isascii() and c.isalnum()]
    sets = [_DIGITS if local[i].isdigit() else _LOWER for i in at]
    values = [s.index(local[i].lower()) for i, s in zip(at, sets)]
    layout = "".join("9" if s is _DIGITS else "a" for s in sets)
    new = permuted(values, [len(s) for s in sets], key, f"mail{layout}".encode(), None, back)
    chars = list(local)
    for i, s, v in zip(at, sets, new):
        chars[i] = s[v].upper() if local[i].isupper() else s[v]
    return "".join(chars) + "@" + host


_FIRST = datetime.date(1900, 1, 1).toordinal()
_LAST = datetime.date(2099, 12, 31).toordinal()
_END = datetime.date(9999, 12, 31).toordinal()


def _date_parts(text: str) -> tuple[list[int], tuple[int, int, int]] | None:
    """Day ordinal if the date exists, and where year, month and day stand."""
    numbers = [int(x) for x in re.findall(r"\d+", text)]
    order = (0, 1, 2) if len(re.match(r"\d+", text)[0]) == 4 else (2, 1, 0)
    for place in (order, (2, 0, 1)) if order[0] == 2 else (order,):
        try:
            return [datetime.date(*(numbers[i] for i in place)).toordinal()], place
        except ValueError:
            continue
    return None


def _date(text: str, key: bytes, back: bool) -> str:
    """Dates of 1900 to 2099 go to such, others among themselves; the layout stays."""
    ordinals, place = _date_parts(text)
    recent = _FIRST <= ordinals[0] <= _LAST

    def valid(d: list[int]) -> bool:
        day = d[0] * 2048 + d[1]
        if not 0 < day <= _END or (_FIRST <= day <= _LAST) != recent:
            return False
        # read again, the new date must have its parts at the same places
        return _date_parts(_dated(text, day, place)) == ([day], place)

    new = permuted([*divmod(ordinals[0], 2048)], [2048, 2048], key, f"date{place}".encode(), valid, back)
    return _dated(text, new[0] * 2048 + new[1], place)


def _dated(text: str, day: int, place: tuple[int, int, int]) -> str:
    date = datetime.date.fromordinal(day)
    values = dict(zip(place, (date.year, date.month, date.day)))
    it = iter(range(3))
    return re.sub(r"\d+", lambda m: str(values[next(it)]).zfill(len(m[0])), text)


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban(text: str, key: bytes, back: bool) -> str:
    """Country and letters stay; the account's digits are permuted, the check digits follow."""
    plain = text.replace(" ", "")
    tail = plain[4:]
    at = [i for i, c in enumerate(tail) if c.isdigit()]
    layout = plain[:2] + "".join("9" if c.isdigit() else c for c in tail)
    new = permuted([int(tail[i]) for i in at], [10] * len(at), key, f"iban{layout}".encode(), None, back)
    chars = list(tail)
    for i, d in zip(at, new):
        chars[i] = str(d)
    number = "".join(str(int(c, 36)) for c in [*chars, *plain[:2], "0", "0"])
    check = f"{98 - int(number) % 97:02d}"
    return _refill(text, [*plain[:2], *check, *chars])


def _is_card(text: str) -> bool:
    return 13 <= len(_digits_of(text)) <= 19


#: kind, form, what it takes to be one, pseudonym. Earlier kinds win where forms overlap.
KINDS: tuple[tuple[str, str, Callable[[str], bool], Callable[[str, bytes, bool], str]], ...] = (
    (
        "mail",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
        lambda t: True,
        _mail,
    ),
    (
        "ip",
        r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
        lambda t: True,
        _ip,
    ),
    (
        "date",
        r"(?<![\d/.-])(?:\d{4}([/.-])\d{1,2}\1\d{1,2}|\d{1,2}([/.-])\d{1,2}\2\d{4})(?![/.-]?\d)",
        lambda t: _date_parts(t) is not None,
        _date,
    ),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _is_iban, _iban),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", lambda t: _is_ssn(_digits_of(t)), _ssn),
    (
        "phone",
        r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\d)"
        r"|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])"
        r"|(?<![\d+])\+\d{8,15}(?!\d)",
        lambda t: 7 <= len(_digits_of(t)) <= 15,
        _phone,
    ),
    ("card", r"(?<![A-Za-z0-9.-])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9]|[.-]\d)", _is_card, _card),
)
_HINT = re.compile(r"[0-9@]")
_FORMS = [(kind, re.compile(form, re.ASCII), is_one, make) for kind, form, is_one, make in KINDS]


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list]:
    """The text with its values replaced, and (kind, start, end) of each in the new text."""
    if not text or not _HINT.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    for kind, form, is_one, make in _FORMS:
        for m in form.finditer(text):
            if is_one(m[0]) and not any(a < m.end() and m.start() < b for a, b, _, _ in taken):
                taken.append((m.start(), m.end(), kind, make(m[0], key, back)))
    out, spans, at, length = [], [], 0, 0
    for start, end, kind, new in sorted(taken):
        out += [text[at:start], new]
        length += start - at
        spans.append((kind, length, length + len(new)))
        length += len(new)
        at = end
    return "".join([*out, text[at:]]), spans


def _replace(key: bytes, back: bool):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [pseudonymise(t, key, back) for t in batch.column("text").to_pylist()]
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in found] for _, found in done]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([t for t, _ in done], pa.string()),
                    pa.array(spans, kind),
                ],
                names=["doc_id", "text", "spans"],
            )

    return run


def replace_private(documents: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``doc_id``, ``text`` with pseudonyms, and ``spans`` of them, for every row.

    Mail addresses, IPv4 addresses, dates, IBANs, social security, phone and card or account
    numbers; what fails its kind's test (an impossible date) stays. ``back`` undoes it with
    the same key. Null and empty texts stay as they are, without spans; rows that repeat get
    the same pseudonyms. Other columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text string, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.mapInArrow(_replace(key, back), schema)
