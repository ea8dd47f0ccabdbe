"""Personal numbers, dates and mail names under format-preserving pseudonyms.

A value that passes the check of its kind (check digits, calendar, number ranges) is mapped to a whole number below the
number of values its format allows, permuted there by a keyed Feistel network with cycle walking, and written back in the
same format: check digits hold again, separators stay. The permutation depends on key, kind and format alone, so equal
values stay equal in all documents, different ones stay different, and the key reverses it. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "card", "ipv4", "date", "ssn", "phone")
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def permuted(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Keyed permutation of range(size): a Feistel network on a slightly larger product, walked until it is inside."""
    if size < 2:
        return x
    wide = isqrt(size - 1) + 1
    tall = -(-size // wide)

    def pad(number: int, turn: int, modulus: int) -> int:
        text = f"{tweak}|{size}|{turn}|{number}".encode()
        return int.from_bytes(blake2b(text, key=key[:64], digest_size=32).digest()) % modulus

    while True:
        a, b = divmod(x, tall)
        for turn in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                b = (b + sign * pad(a, turn, tall)) % tall
            else:
                a = (a + sign * pad(b, turn, wide)) % wide
        x = a * tall + b
        if x < size:
            return x


def _alphabet(c: str) -> str | None:
    for low, high in (("0", "9"), ("a", "z"), ("A", "Z")):
        if low <= c <= high:
            return "".join(map(chr, range(ord(low), ord(high) + 1)))
    return None


def _masked(text: str, key: bytes, tweak: str, back: bool, alphabets: list[str | None] | None = None) -> str:
    """Permute the ASCII letters and digits of a text together, each within its alphabet; other characters stay."""
    alphabets = [_alphabet(c) for c in text] if alphabets is None else alphabets
    used = [(i, a) for i, a in enumerate(alphabets) if a]
    number = 0
    for i, a in used:
        number = number * len(a) + a.index(text[i])
    form = "".join(a[0] if a else c for a, c in zip(alphabets, text, strict=True))
    number = permuted(number, prod(len(a) for _, a in used), key, f"{tweak}|{form}", back)
    out = list(text)
    for i, a in reversed(used):
        number, rest = divmod(number, len(a))
        out[i] = a[rest]
    return "".join(out)


def _refill(pattern: str, digits: str) -> str:
    """Put digits in the places of the digits of a text."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in pattern)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _luhn(digits: str) -> int:
    """The check digit that makes the digits a valid card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or _luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    own = _masked(digits[:-1], key, "card", back)
    return _refill(text, own + str(_luhn(own)))


def _ipv4(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    number = permuted(int.from_bytes(bytes(parts)), 1 << 32, key, "ipv4", back)
    return ".".join(map(str, number.to_bytes(4)))


#: Places of year, month and day among the groups of the two forms.
_DATES = ((r"(\d{4})([-/.])(\d{2})\2(\d{2})", ((0, 2, 3),)), (r"(\d{2})([-/.])(\d{2})\2(\d{4})", ((3, 2, 0), (3, 0, 2))))


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Year first, or day first; month first only where day first is no date, and then with days over 12 alone."""
    pattern, forms = _DATES[0] if text[:4].isdigit() else _DATES[1]
    groups = list(re.fullmatch(pattern, text).groups())
    for form, (y, m, d) in enumerate(forms):
        try:
            at = date(int(groups[y]), int(groups[m]), int(groups[d])).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= at <= LAST_DAY - FIRST_DAY:
            return None
        while True:
            at = permuted(at, LAST_DAY - FIRST_DAY + 1, key, f"date|{form}", back)
            new = date.fromordinal(FIRST_DAY + at)
            if form == 0 or new.day > 12:
                break
        groups[y], groups[m], groups[d] = f"{new.year:04}", f"{new.month:02}", f"{new.day:02}"
        return "".join(groups[i] for i in (0, 1, 2, 1, 3))
    return None


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(p) for p in text.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    number, serial = divmod(permuted(number, 898 * 99 * 9999, key, "ssn", back), 9999)
    area, group = divmod(number, 99)
    area += 1 + (area >= 665)
    return f"{area:03}-{group + 1:02}-{serial + 1:04}"


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """The last ten digits of a number of the North American plan, or all but the country code of another; the code stays."""
    digits = _digits(text)
    if text[0] == "+" and not (digits[0] == "1" and len(digits) == 11):
        if not 8 <= len(digits) <= 15:
            return None
        first = re.match(r"\+(\d+)", text)[1]
        code = len(first) if len(first) <= 3 else 2
        return _refill(text, digits[:code] + _masked(digits[code:], key, f"phone|{digits[:code]}", back))
    if len(digits) < 10 or digits[-10] < "2" or digits[-7] < "2":
        return None
    alphabets = ["23456789" if i in (0, 3) else "0123456789" for i in range(10)]
    return _refill(text, digits[:-10] + _masked(digits[-10:], key, "phone", back, alphabets))


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02}"


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, account) != check:
        return None
    own = _masked(account, key, f"iban|{country}", back)
    fresh = iter(country + _iban_check(country, own) + own)
    return "".join(c if c == " " else next(fresh) for c in text)


def _email(text: str, key: bytes, back: bool) -> str | None:
    name, _, domain = text.rpartition("@")
    return f"{_masked(name, key, f'email|{domain.lower()}', back)}@{domain}"


_FIND: dict[str, tuple[re.Pattern[str], Callable[[str, bytes, bool], str | None]]] = {
    "email": (re.compile(r"(?<![\w.+-])[^\W_][\w.+-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}"), _email),
    "iban": (re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII), _iban),
    "card": (re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,}(?!\w)", re.ASCII), _card),
    "ipv4": (re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)", re.ASCII), _ipv4),
    "date": (
        re.compile(r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?:(?=T\d{2})|(?![\w/-]))", re.ASCII),
        _date,
    ),
    "ssn": (re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII), _ssn),
    "phone": (
        re.compile(
            r"(?<![\w(])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+[1-9]\d{0,14}(?:[ .-]?\(?\d{1,12}\)?){0,6})(?!\w)",
            re.ASCII,
        ),
        _phone,
    ),
}
#: Sizes of the digit groups that card numbers are written in.
_CARD_GROUPS = frozenset({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), *((n,) for n in range(13, 20))})


def _parts(kind: str, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches of a match that may be a value, best first: a greedy match may hold neighbours of the value too.

    Cards: runs of groups written as cards are, from the left, then the whole match. IBANs: the match without its last
    groups, longest first. Other kinds: the match itself.
    """
    if kind == "card":
        groups = [(m.start() + start, m.end() + start) for m in re.finditer("[0-9]+", text[start:end])]
        for first in range(len(groups)):
            for last in range(min(first + 5, len(groups)), first, -1):
                own = groups[first:last]
                if tuple(b - a for a, b in own) in _CARD_GROUPS and len({text[b] for _, b in own[:-1]}) < 2:
                    yield own[0][0], own[-1][1]
        yield start, end
    elif kind == "iban":
        yield start, end
        for at in range(end - 1, start + 14, -1):
            if text[at] == " ":
                yield start, at
    else:
        yield start, end


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or None if it fails the check of its kind; back: the value of a pseudonym."""
    return _FIND[kind][1](value, key, back)


def replaced(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of what was replaced. Earlier kinds win where matches overlap.

    A pseudonym is reversed by its span: next to other digits, a pseudonym may make another stretch look valid.
    """
    if not re.search("[0-9@]", text):
        return text, []
    spans: list[tuple[int, int, str, str]] = []
    for kind in KINDS:
        if kind == "email" and "@" not in text:
            continue
        at = 0
        while found := _FIND[kind][0].search(text, at):
            at = found.end()
            for a, b in _parts(kind, text, *found.span()):
                if all(b <= c or d <= a for c, d, _, _ in spans) and (new := pseudonym(kind, text[a:b], key, back)) is not None:
                    spans.append((a, b, kind, new))
                    at = b
                    break
    spans.sort()
    out, at = [], 0
    for a, b, _, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [s[:3] for s in spans]


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_found, one count per kind, and spans (kind:start:end of the input, by start) per row of docs.

    Null texts stay null with no finds; texts without personal data are unchanged. Repeated rows give equal rows. An
    empty table gives none.
    """
    if not key:
        raise ValueError("a key is needed")
    names = ["doc_id", "text", "n_found", *[f"n_{k}" for k in KINDS], "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, listed = [], [], []
            for value in batch.column("text"):
                text, spans = (None, []) if value.as_py() is None else replaced(value.as_py(), key)
                texts.append(text)
                kinds = [s[2] for s in spans]
                counts.append([len(spans), *[kinds.count(k) for k in KINDS]])
                listed.append(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
            columns = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * (len(KINDS) + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), *columns, pa.array(listed, pa.string())], names=names
            )

    schema = "doc_id long, text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
