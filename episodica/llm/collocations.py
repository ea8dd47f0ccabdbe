"""Phrases whose words keep together, counted by prefix-free parsing.

Every piece of text (between marks of punctuation) is cut by its content: a window of words whose hash is divisible by
`period` is a trigger, and a chunk reaches from one trigger to the next and over it, so that neighbours overlap by one
trigger window. Equal passages therefore fall into equal chunks wherever they lie. The distinct chunks are the dictionary,
their numbers the parse frequencies; phrases are counted inside the distinct chunks only, weighted by these frequencies. A
phrase belongs to the chunk in which it starts before the last trigger, so overlaps are counted once.

Only phrases of at least `least` occurrences matter, and all parts of such a phrase are at least as frequent. Phrases are
first counted as hashes, level by level, where a phrase is looked at only if both phrases of one word less passed; what
passed is kept as a bitmap of fixed size. Hashes and bitmap can only let too much through: the strings that pass are then
counted themselves, so that the counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.llm import arrays
from episodica.llm.bitmaps import bitmap, possible
from episodica.session import durable

LONGEST = 4
#: Words of a trigger window; a phrase that starts before it ends within it.
OVERLAP = LONGEST - 1
PERIOD = 32
#: Bits of the bitmap of frequent phrases (8 MB).
BITS = 26
#: Bytes of chunks whose phrases a task adds up at a time.
UNIT_BYTES = 3 << 20

#: Space and tab separate words; . , ; : ! ? and U+000A to U+000D separate pieces.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09]] = True
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
UNKNOWN = "und"


def dictionary(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """(lang, chunk, own, freq): distinct chunks, words joined by one space; phrases at the first `own` words are its own."""

    def cut(piece: arrays.Piece, langs: pa.Array) -> pa.RecordBatch | None:
        data = arrays.LOWER[piece.bytes]
        words = arrays.words_of(arrays.Piece(piece.rows, data, piece.offsets), SPACES | BREAKS)
        n = len(words.starts)
        if n == 0:
            return None
        text = np.repeat(np.arange(piece.count), np.diff(words.offsets))
        breaks = np.append(0, np.cumsum(BREAKS[data]))[words.starts]
        opens = np.append(True, (text[1:] != text[:-1]) | (breaks[1:] != breaks[:-1]))
        first = np.flatnonzero(opens)
        line = np.cumsum(opens) - 1
        end = np.append(first[1:], n)[line]
        head = opens.copy()
        if n > OVERLAP:
            hashes = arrays.word_hashes(arrays.Piece(piece.rows, data, piece.offsets), words)
            window = hashes[: n - OVERLAP + 1].copy()
            for k in range(1, OVERLAP):
                window = arrays.mix(window) + hashes[k : n - OVERLAP + 1 + k]
            fires = arrays.mix(window) % np.uint64(period) == 0
            at = np.flatnonzero(fires)
            head[at[at + OVERLAP <= end[at]]] = True
        start = np.flatnonzero(head)
        following = np.append(start[1:], n)
        inner = following < end[start]
        last = np.where(inner, following + OVERLAP, end[start])
        joined, offsets = arrays.single_spaced(data, words)
        chunk = arrays.spans(joined, offsets[start], offsets[last] - 1)
        owner = pa.array(text[start] + piece.rows.start)
        columns = [langs.take(owner), chunk, pa.array((np.where(inner, following, end[start]) - start).astype(np.int32))]
        columns.append(pa.array(np.ones(len(start), dtype=np.int64)))
        return pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "own", "freq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.pieces(batch.column("text")):
                found = cut(piece, batch.column("lang"))
                if found is not None:
                    yield found

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(run, "lang string, chunk string, own int, freq long")
    return made.groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq"))


def _lang_keys(langs: pa.Array) -> np.ndarray:
    """A hash per row of its language."""
    coded = langs.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(x.encode()) for x in coded.dictionary.to_pylist()], dtype=np.uint64)
    return known[coded.indices.to_numpy()]


class _Phrases:
    """The phrases that start at the own words of the chunks of a piece, as word positions, and their hashes."""

    def __init__(self, piece: arrays.Piece, own: np.ndarray, langs: np.ndarray):
        self.piece, self.own, self.langs = piece, own, langs
        self.words = arrays.words_of(piece, SPACES)
        self.count = np.diff(self.words.offsets)
        self.prefix = arrays.prefix_hash(piece.bytes, "bytes")

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, row) of every own phrase of `size` words."""
        starts = np.minimum(self.own, np.maximum(self.count - size + 1, 0))
        return arrays.ranges(self.words.offsets[:-1], starts), np.repeat(np.arange(self.piece.count), starts)

    def keys(self, at: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
        content = arrays.span_hash(self.prefix, self.words.starts[at], self.words.ends[at + size - 1], "bytes")
        return arrays.mix(content + np.uint64(size) ^ self.langs[row])

    def likely(self, size: int, table: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Own phrases of `size` words whose sub-phrases of `parts` words may all be frequent."""
        at, row = self.of(size)
        for shift in range(size - parts + 1):
            keep = possible(table, self.keys(at + shift, row, parts))
            at, row = at[keep], row[keep]
        return at, row


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, _Phrases]]:
    """(lang, freq, phrases) of about UNIT_BYTES of chunks at a time."""

    def unit(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, _Phrases]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lang, chunk, own, freq = (rows.column(c).combine_chunks() for c in ("lang", "chunk", "own", "freq"))
        own, freq, langs = own.to_numpy(), freq.to_numpy(), _lang_keys(lang)
        for piece in arrays.pieces(chunk, UNIT_BYTES):
            at = piece.rows
            yield lang[at.start : at.stop], freq[at], _Phrases(piece, own[at], langs[at])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= UNIT_BYTES:
            yield from unit(held)
            held, size = [], 0
    if held:
        yield from unit(held)


def _distinct(codes: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, sum of weights) of every distinct row of the code columns."""
    dense = codes[0]
    for code in codes[1:]:
        dense = np.unique(dense, return_inverse=True)[1] * (int(code.max(initial=0)) + 1) + code
    _, first, place = np.unique(dense, return_index=True, return_inverse=True)
    sums = np.zeros(len(first), dtype=np.int64)
    np.add.at(sums, place, weights)
    return first, sums


def _frequent_keys(chunks: DataFrame, sizes: list[int], least: int, before: Broadcast | None) -> DataFrame:
    """(key): hashes of (language, phrase) with at least `least` occurrences, over phrases whose parts passed `before`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, freq, phrases in _units(batches):
            for size in sizes:
                at, row = phrases.of(size) if before is None else phrases.likely(size, before.value, size - 1)
                keys = phrases.keys(at, row, size)
                first, sums = _distinct([keys], freq[row])
                yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(sums)], names=["key", "f"])

    sums = chunks.mapInArrow(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))
    return sums.filter(F.col("f") >= least).select("key")


def frequent_phrases(chunks: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, f): all phrases of 1 to `longest` words that occur at least `least` times in a language."""
    sizes, passed, keys = [1, 2], None, None
    while sizes[0] <= longest:
        found = durable(_frequent_keys(chunks, sizes, least, passed), "keys")
        keys = found if keys is None else keys.unionByName(found)
        passed = bitmap(keys, "key", BITS)
        sizes = [sizes[-1] + 1]
    table = passed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, freq, phrases in _units(batches):
            data, words = phrases.piece.bytes, phrases.words
            word = arrays.spans(data, words.starts, words.ends).dictionary_encode().indices.to_numpy().astype(np.int64)
            lang = langs.dictionary_encode().indices.to_numpy().astype(np.int64)
            for size in range(1, longest + 1):
                at, row = phrases.likely(size, table.value, size)
                first, sums = _distinct([lang[row], *[word[at + k] for k in range(size)]], freq[row])
                at, row = at[first], row[first]
                text = arrays.spans(data, words.starts[at], words.ends[at + size - 1])
                columns = [langs.take(pa.array(row)), pa.array(np.full(len(at), size, dtype=np.int32)), text, pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "f"])

    counted = chunks.mapInArrow(run, "lang string, words int, phrase string, f long")
    counted = counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return durable(counted.filter(F.col("f") >= least).select("lang", "phrase", "words", "f"), "phrases")


def _wide(column: Column | str) -> Column:
    """A count that may be multiplied without overflow."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(28,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, covered: int = 80, period: int = PERIOD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to 4 words of each language.

    a counts the phrase (at least `least`), l and r the parts before and behind its weakest cut, n all words of the language.
    The score is scale * a / (l + r) rounded down, at the cut where that is least (ties: the earlier cut). Phrases of which a
    longer one keeps at least `covered` per cent are left out. Order: score, a (both falling), phrase. Texts are lower-cased
    (A-Z only) and taken whole; a null text is empty, a null language is `und`. Repeated rows count as often as they occur.
    Empty table, or no phrase often enough: no rows. Other columns are not read.
    """
    chunks = durable(dictionary(docs, period), "dictionary")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
    counts = frequent_phrases(chunks, least)

    longer = counts.filter("words > 2").select("lang", "words", "f", F.split("phrase", " ", -1).alias("w"))
    inner = [F.struct(F.lit(size).alias("size"), F.lit(start).alias("start")) for size in range(2, LONGEST) for start in range(1, LONGEST - size + 2)]
    inside = longer.select("lang", "f", "w", "words", F.explode(F.array(*inner)).alias("part"))
    inside = inside.filter((F.col("part.size") < F.col("words")) & (F.col("part.start") + F.col("part.size") <= F.col("words") + 1))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("part.start"), F.col("part.size")), " ").alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = counts.filter("words > 1").join(inside, ["lang", "phrase"], "left")
    kept = kept.filter(F.col("longer").isNull() | (100 * _wide("longer") < covered * _wide("f")))

    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = [("l", F.slice("w", F.lit(1), F.col("k"))), ("r", F.slice("w", F.col("k") + 1, F.size("w")))]
    for name, part in sides:
        known = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias(name))
        cuts = cuts.withColumn("part", F.array_join(part, " ")).join(known, ["lang", "part"]).drop("part")
    score = F.call_function("div", scale * _wide("a"), _wide("l") + _wide("r")).cast("long")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(order))
    ranked = ranked.filter(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
