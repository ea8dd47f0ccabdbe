"""Whole texts as flat numpy arrays inside Spark tasks.

Arrow hands a task the texts of a batch as one byte buffer with offsets. The helpers here cut such batches into pieces of
a few megabytes (a longer text makes a piece of its own, never a cut text) and turn a piece into word bounds, word hashes
and hashes of all windows with a fixed number of array operations per piece, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

#: White space between words (0x20 and 0x09 to 0x0D).
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Words made of letters and digits only: ASCII punctuation and controls separate as well.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASES = {"bytes": 0x9E3779B97F4A7C15, "words": 0xD1342543DE82EF95}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Piece:
    """Some whole texts of a batch: rows first to last, their bytes, and the byte offsets of the texts."""

    rows: slice
    bytes: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Word bounds in the bytes of a piece, and the word offsets of the texts."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of an Arrow column as pieces of about `size` bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.binary())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        own = offsets[first : last + 1]
        yield Piece(slice(first, last), whole[own[0] : own[-1]], own - own[0])
        first = last


def words_of(piece: Piece, separators: np.ndarray = SEPARATORS) -> Words:
    """Bounds of all words; a word never reaches over the end of its text."""
    inside = ~separators[piece.bytes]
    n = len(inside)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(len(piece.offsets), dtype=np.int64))
    cuts = piece.offsets[1:-1]
    cuts = cuts[cuts < n]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    before[cuts] = False
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, piece.offsets))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow string column."""
    sizes = ends - starts
    offsets = pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64))
    flat = np.ascontiguousarray(data[ranges(starts, sizes)])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, offsets, pa.py_buffer(flat)])


def single_spaced(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words, one space behind each, and the place of each word in that; one more place behind the last."""
    size = words.ends - words.starts
    offsets = np.append(0, np.cumsum(size + 1))
    joined = np.full(int(offsets[-1]), 0x20, dtype=np.uint8)
    joined[ranges(offsets[:-1], size)] = data[ranges(words.starts, size)]
    return joined, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the information of 64 bits over all of them (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get(kind)
    if held is None or len(held[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        base = _BASES[kind]
        tables = []
        for factor in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, factor, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        held = (tables[0], tables[1])
        if size <= 4 * PIECE_BYTES:
            _powers[kind] = held
    return held


def prefix_hash(values: np.ndarray, kind: str) -> np.ndarray:
    """Running polynomial hash, one longer than the values."""
    powers, _ = _power_tables(kind, len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """64-bit hash of each span, equal for equal contents wherever they lie."""
    _, inverse = _power_tables(kind, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: The prime field of the second hash of words, and the number whose powers weight the bytes there.
PRIME = (1 << 31) - 1
FIELD_BASE = 0x5BD1E995 % PRIME
_BLOCK = 1 << 22


def _field_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get("field")
    if held is None or len(held[0]) < n:
        size, tables = max(n, PIECE_BYTES + 1), []
        for base in (FIELD_BASE, pow(FIELD_BASE, -1, PRIME)):
            table = np.ones(1, dtype=np.uint64)
            while len(table) < size:
                table = np.append(table, table * np.uint64(pow(base, len(table), PRIME)) % np.uint64(PRIME))
            tables.append(table.astype(np.uint32))
        held = (tables[0], tables[1])
        if size <= 4 * PIECE_BYTES:
            _powers["field"] = held
    return held


def field_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash below PRIME of each span of bytes, polynomial in the prime field.

    Modulo 2**64 some texts agree whatever the base is (the Thue-Morse word and its complement); here they do not.
    """
    prime = np.uint64(PRIME)
    powers, inverse = _field_powers(len(data) + 1)
    prefix, carry = np.zeros(len(data) + 1, dtype=np.uint64), np.uint64(0)
    for a in range(0, len(data), _BLOCK):
        part = (data[a : a + _BLOCK] + np.uint64(1)) * powers[a : min(a + _BLOCK, len(data))]
        np.cumsum(part, out=part)
        prefix[a + 1 : a + 1 + len(part)] = part + carry
        carry = prefix[a + len(part)] % prime
    return (prefix[ends] % prime + prime - prefix[starts] % prime) % prime * inverse[starts] % prime


def word_hashes(piece: Piece, words: Words, lower: bool = False) -> np.ndarray:
    """64-bit hash per word, from a hash modulo 2**64 and one in a prime field."""
    data = LOWER[piece.bytes] if lower else piece.bytes
    plain = span_hash(prefix_hash(data, "bytes"), words.starts, words.ends, "bytes")
    return mix(plain + field_hash(data, words.starts, words.ends) * np.uint64(0x9FB21C651E98DF25))


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """First index of every window of `width` items that lies inside one text."""
    lengths = np.maximum(np.diff(offsets) - width + 1, 0)
    return ranges(offsets[:-1], lengths)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] items, then the same for the next."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, lengths)


def owners(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text of a piece in which each position lies."""
    return np.searchsorted(offsets, positions, side="right") - 1


def covered(size: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of `size` positions lie in one of the spans."""
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i : i + width] for every i at which the window is whole."""
    reach, low = 1, values
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[:-rest], low[rest:]) if rest else low


@dataclass
class Runs:
    """Runs of consecutive windows of one text with the same anchor."""

    anchor: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    text: np.ndarray


def anchored_runs(prefix: np.ndarray, kind: str, offsets: np.ndarray, width: int, gram: int, longest: int) -> Runs:
    """Cut all windows of `width` items into runs by their anchor, the least hash of the grams in the window.

    The anchor depends on the content of the window alone, so equal windows have equal anchors wherever they occur. A
    run is cut after `longest` windows, which only bounds its length (texts that repeat themselves have long runs).
    """
    n = int(offsets[-1])
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return Runs(none.astype(np.uint64), none, none, none)
    at = np.arange(n - gram + 1, dtype=np.int64)
    least = sliding_min(span_hash(prefix, at, at + gram, kind), width - gram + 1)
    starts = window_starts(offsets, width)
    if not len(starts):
        return Runs(none.astype(np.uint64), none, none, none)
    lengths = np.maximum(np.diff(offsets) - width + 1, 0)
    anchor, text = least[starts], np.repeat(np.arange(len(lengths)), lengths)
    new = np.empty(len(starts), dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    lengths = np.diff(np.append(head, len(starts)))
    parts = -(-lengths // longest)
    head = np.repeat(head, parts) + longest * ranges(np.zeros(len(parts), dtype=np.int64), parts)
    windows = np.diff(np.append(head, len(starts)))
    return Runs(mix(anchor[head]), starts[head], windows, text[head])  # least hashes are small: spread them again
