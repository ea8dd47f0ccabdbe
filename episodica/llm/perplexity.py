"""Quality rules: text statistics and the perplexity of a modified Kneser-Ney model per language.

Spark counts the n-grams of the bytes of all texts (a task adds up its own texts first), derives continuation counts,
discounts, interpolated probabilities and back-off weights order by order with joins, and keeps their logarithms as whole
millionths. The model goes to the tasks as sorted arrays of keys and values, which are searched for all positions of a
text at once. Languages are taken together as long as their arrays have no more than MODEL_ROWS entries and one after the
other beyond; one language has at most 256**3 trigrams. Sums of whole numbers make any grouping give the same result.

A document is judged by the band of its language. One that is above it is scored again in short segments, each with the
language that suits it best, so that a clean document that quotes another language is not taken for noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.llm import arrays
from episodica.llm.bitmaps import bitmap, with_possible, without
from episodica.session import durable

ORDER = 3
MODEL_ROWS = 4_000_000
UNIT = 1_000_000
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
#: Half width of a band in robust standard deviations, and the deviation (in nats per byte) that texts of any length have.
BAND_WIDTH = 4.0
LEAST_DEVIATION = 0.015
#: N-grams of a segment.
SEGMENT = 48
#: Bits of the map that spares texts inside the bands the shuffle to their second scoring.
HIGH_BITS = 22
#: Resolution of the tables of scores from which medians are taken.
BINS = 10_000

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _language(column: str = "lang") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _grams(piece: arrays.Piece, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of bytes inside the texts of a piece, and the number of them per text."""
    data = piece.bytes.astype(np.uint64)
    n = len(data) - order + 1
    lengths = np.maximum(np.diff(piece.offsets) - order + 1, 0)
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), lengths
    codes = np.zeros(n, dtype=np.uint64)
    for i in range(order):
        codes = (codes << np.uint64(8)) | data[i : i + n]
    return codes[arrays.ranges(piece.offsets[:-1], lengths)], lengths


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each n-gram of bytes occurs in the texts of each language (a null one counts as '')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def table(lang: str) -> pa.RecordBatch:
            grams, counts = held[lang]
            columns = [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            for piece in arrays.pieces(batch.column("text")):
                codes, lengths = _grams(piece, order)
                own = np.repeat(langs[piece.rows], lengths)
                for lang in set(langs[piece.rows].tolist()):
                    grams, counts = np.unique(codes[own == lang], return_counts=True)
                    if lang in held:
                        both = np.concatenate((held[lang][0], grams))
                        added = np.concatenate((held[lang][1], counts))
                        grams, place = np.unique(both, return_inverse=True)
                        counts = np.bincount(place, weights=added, minlength=len(grams)).astype(np.int64)
                    held[lang] = (grams, counts)
                    if len(grams) > MODEL_ROWS:
                        yield table(lang)
                        del held[lang]
        for lang in held:
            yield table(lang)

    texts = docs.select(_language().alias("lang"), F.col("text").cast("string"))
    partial = texts.mapInArrow(run, "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """The three discounts per language from the numbers of n-grams that occur once to four times.

    Where a number is missing (tiny tables), the discount is half of its usual bound, so that no probability is lost.
    """
    n = [F.count(F.when(F.col("n") == k, True)).alias(f"n{k}") for k in range(1, 5)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    of = lambda k: k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
    safe = lambda k: F.when(of(k).between(0.05, k), of(k)).otherwise(F.lit(k / 2.0))
    return counts.groupBy("lang").agg(*n).select("lang", *[safe(k).alias(f"d{k}") for k in range(1, 4)])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, kind, gram, value): the model, in millionths of natural logarithms.

    kind m from 1 to order: the probability of a gram of m bytes given the first m - 1; kind -m: the back-off weight of a
    context of m bytes. An n-gram that is not listed has the weight of its context (1 if that is not listed either) times
    the probability of the n-gram without its first byte; below one byte, 1/256.
    """
    levels = {order: counts}
    for m in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("gram")
        levels[m] = levels[m + 1].select("lang", suffix).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    lower: DataFrame | None = None
    parts = []
    log = lambda c: F.round(F.log(c) * UNIT).cast("long").alias("value")
    for m in range(1, order + 1):
        own = levels[m].withColumn("context", F.shiftright("gram", 8))
        discounted = own.join(_discounts(levels[m]), "lang").withColumn(
            "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        )
        contexts = discounted.groupBy("lang", "context").agg((F.sum("d") / F.sum("n")).alias("weight"), F.sum("n").alias("total"))
        contexts = durable(contexts, "contexts")
        rows = discounted.select("lang", "gram", "context", "n", "d").join(contexts, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / 256))
        else:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1)))
            rows = rows.join(lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("below")), ["lang", "short"])
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("below")
        lower = durable(rows.select("lang", "gram", p.alias("p")), "order")
        parts.append(lower.select("lang", F.lit(m).alias("kind"), "gram", log(F.col("p"))))
        parts.append(contexts.select("lang", F.lit(1 - m).alias("kind"), F.col("context").alias("gram"), log(F.col("weight"))))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Model:
    """Sorted keys and values for some languages. A key holds language, kind and gram."""

    order: int
    langs: list[str]
    keys: np.ndarray
    values: np.ndarray

    def look_up(self, lang: int, kind: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether there is one (else the value is 0)."""
        head = np.uint64(((lang << 5) | (kind + 16)) << (8 * self.order))
        place = np.searchsorted(self.keys, grams | head)
        place[place == len(self.keys)] = 0
        found = self.keys[place] == grams | head
        return np.where(found, self.values[place], 0).astype(np.int64), found

    def scores(self, lang: int, grams: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of the last bytes of the grams, with back-off."""
        result = np.zeros(len(grams), dtype=np.int64)
        left, kind = np.arange(len(grams)), self.order
        while len(left) and kind:
            own = grams[left] & np.uint64((1 << 8 * kind) - 1)
            value, found = self.look_up(lang, kind, own)
            result[left] += value
            left, own = left[~found], own[~found]
            result[left] += self.look_up(lang, 1 - kind, own >> np.uint64(8))[0]
            kind -= 1
        result[left] += round(float(np.log(1 / 256)) * UNIT)
        return result


def _models(model: DataFrame, order: int, model_rows: int) -> list[Broadcast]:
    """The model as arrays: as many languages together as have no more than model_rows entries, at least one each."""
    sizes = sorted((row["lang"], row["n"]) for row in model.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    groups: list[list[str]] = []
    room = 0
    for lang, n in sizes:
        if not groups or n > room:
            groups.append([])
            room = max(model_rows, n)
        groups[-1].append(lang)
        room -= n
    held = []
    for langs in groups:
        rows = model.filter(F.col("lang").isin(langs)).toArrow()
        at = {lang: i for i, lang in enumerate(langs)}
        own = np.asarray([at[x] for x in rows["lang"].to_pylist()], dtype=np.uint64)
        kinds = (rows["kind"].to_numpy() + 16).astype(np.uint64)
        keys = (((own << np.uint64(5)) | kinds) << np.uint64(8 * order)) | rows["gram"].to_numpy().astype(np.uint64)
        turn = np.argsort(keys)
        arrays_ = Model(order, langs, keys[turn], rows["value"].to_numpy()[turn].astype(np.int32))
        held.append(model.sparkSession.sparkContext.broadcast(arrays_))
    return held


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which are not the first of their kind."""
    turn = np.argsort(keys, kind="stable")
    own = keys[turn]
    same = own[1:] == own[:-1]
    later, more = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[turn[1:]] = same
    more[turn[1:]] = same
    more[turn[:-1]] |= same
    return more, later


def _equal_windows(piece: arrays.Piece, words: arrays.Words, at: np.ndarray) -> np.ndarray:
    """A number per window of words that begins at one of the words `at`, equal for equal words only."""
    word = arrays.spans(piece.bytes, words.starts, words.ends).dictionary_encode().indices.to_numpy().astype(np.int64)
    code = word[at]
    for k in range(1, REPEAT_WINDOW):
        code = np.unique(code, return_inverse=True)[1] * len(word) + word[at + k]
    return code


def _statistics(piece: arrays.Piece) -> list[np.ndarray]:
    """Counts per text. Hashes only tell which windows and lines may be equal; their words and bytes decide."""
    words = arrays.words_of(piece)
    inside = ~arrays.SEPARATORS[piece.bytes]
    chars = inside & ((piece.bytes & 0xC0) != 0x80)
    hashes = arrays.word_hashes(piece, words)
    texts = arrays.mix(np.arange(1, piece.count + 1, dtype=np.uint64))

    starts = arrays.window_starts(words.offsets, REPEAT_WINDOW)
    repeat = np.zeros(len(words.starts), dtype=bool)
    if len(starts):
        prefix = arrays.prefix_hash(hashes, "words")
        windows = arrays.span_hash(prefix, starts, starts + REPEAT_WINDOW, "words")
        owner = arrays.owners(words.offsets, starts)
        more, _ = _repeated(windows ^ texts[owner])
        starts, owner = starts[more], owner[more]
        if len(starts):
            codes = np.unique(_equal_windows(piece, words, starts), return_inverse=True)[1]
            starts = starts[_repeated(codes * piece.count + owner)[0]]
        repeat = arrays.covered(len(words.starts), starts, REPEAT_WINDOW)

    breaks = np.flatnonzero(piece.bytes == 0x0A) + 1
    heads = np.unique(np.concatenate((piece.offsets[:-1], breaks)))
    heads = heads[heads < len(piece.bytes)]
    tails = np.append(heads[1:], len(piece.bytes)) if len(heads) else heads
    tails = tails - (piece.bytes[tails - 1] == 0x0A) if len(heads) else tails
    filled = np.searchsorted(words.starts, tails) > np.searchsorted(words.starts, heads)
    heads, tails = heads[filled], tails[filled]
    owner = arrays.owners(piece.offsets, heads)
    lines = arrays.span_hash(arrays.prefix_hash(piece.bytes, "bytes"), heads, tails, "bytes")
    later = np.zeros(len(heads), dtype=bool)
    if len(heads):
        like = np.flatnonzero(_repeated(lines ^ texts[owner])[0])
        codes = arrays.spans(piece.bytes, heads[like], tails[like]).dictionary_encode().indices.to_numpy().astype(np.int64)
        later[like] = _repeated(codes * piece.count + owner[like])[1]
    return [
        np.diff(words.offsets),
        _per_text(chars, piece.offsets),
        _per_text(SYMBOLS[piece.bytes], piece.offsets),
        np.bincount(owner, weights=later, minlength=piece.count).astype(np.int64),
        _per_text(repeat, words.offsets),
    ]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _language().alias("lang"), F.md5(text).alias("text_md5"), text.alias("text"))


def _scored(texts: DataFrame, model: Broadcast | None, order: int) -> DataFrame:
    """Statistics of every row, the number of its n-grams and the sum of their scores in its own language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value if model is not None else None
        known = {lang: i for i, lang in enumerate(held.langs)} if held else {}
        for batch in batches:
            own = np.asarray([known.get(x, -1) for x in batch.column("lang").to_pylist()])
            found: list[list[np.ndarray]] = []
            for piece in arrays.pieces(batch.column("text")):
                codes, lengths = _grams(piece, order)
                lang = np.repeat(own[piece.rows], lengths)
                scores = np.zeros(len(codes), dtype=np.int64)
                for i in np.unique(lang[lang >= 0]).tolist():
                    scores[lang == i] = held.scores(i, codes[lang == i])
                total = np.diff(np.concatenate(([0], np.cumsum(scores)))[np.append(0, np.cumsum(lengths))])
                found.append([*_statistics(piece), lengths, total])
            if found:
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)]
                ids = [batch.column(c) for c in ("doc_id", "lang", "text_md5")]
                names = ["doc_id", "lang", "text_md5", *COUNTS, "grams", "score"]
                yield pa.RecordBatch.from_arrays([*ids, *columns], names=names)

    longs = ", ".join(f"{c} long" for c in (*COUNTS, "grams", "score"))
    return texts.mapInArrow(run, f"doc_id long, lang string, text_md5 string, {longs}")


def _segments(texts: DataFrame, model: Broadcast, order: int) -> DataFrame:
    """(text_md5, best): per segment of a text the largest sum of scores that a language of the model gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        for batch in batches:
            best: list[np.ndarray] = []
            for piece in arrays.pieces(batch.column("text")):
                codes, lengths = _grams(piece, order)
                parts = -(-lengths // SEGMENT)
                first = np.repeat(np.cumsum(lengths) - lengths, parts) + SEGMENT * arrays.ranges(np.zeros_like(parts), parts)
                sums = [np.add.reduceat(held.scores(i, codes), first) for i in range(len(held.langs))] if len(first) else []
                top = np.max(sums, axis=0) if sums else np.zeros(0, dtype=np.int64)
                best += np.split(top, np.cumsum(parts)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("text_md5"), pa.array(best, pa.list_(pa.int64()))], names=["text_md5", "best"])

    return texts.select("text_md5", "text").mapInArrow(run, "text_md5 string, best array<long>")


def _second_scores(texts: DataFrame, models: list[Broadcast], order: int) -> DataFrame:
    """(text_md5, mixed): the sum of the best scores of the segments over all languages."""
    result = durable(_segments(texts, models[0], order), "segments")
    for model in models[1:]:
        more = durable(_segments(texts, model, order).withColumnRenamed("best", "other"), "segments")
        result = result.join(more, "text_md5").select("text_md5", F.zip_with("best", "other", lambda a, b: F.greatest(a, b)).alias("best"))
    return result.select("text_md5", F.aggregate("best", F.lit(0).cast("long"), lambda a, x: a + x).alias("mixed"))


def statistics(docs: DataFrame, models: list[Broadcast], order: int = ORDER) -> DataFrame:
    """doc_id, lang, text_md5, the five counts, base_failed, grams and loss (nats per byte, null below `order` bytes)."""
    texts = _texts(docs)
    parts = [_scored(texts.filter(F.col("lang").isin(m.value.langs)), m, order) for m in models]
    known = [lang for m in models for lang in m.value.langs]
    parts.append(_scored(texts.filter(~F.col("lang").isin(known)) if known else texts, None, order))
    rows = reduce(DataFrame.unionByName, parts)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    loss = F.when(F.col("grams") > 0, -F.try_divide(F.col("score"), F.col("grams") * F.lit(float(UNIT))))
    return rows.select("doc_id", "lang", "text_md5", *COUNTS, failed.alias("base_failed"), "grams", loss.alias("loss"))


def _medians(values: DataFrame, out: str) -> DataFrame:
    """Lower median of the whole number `bin` per language, from a table of its values."""
    counts = values.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    ordered = W.partitionBy("lang").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = counts.select("lang", "bin", F.sum("n").over(ordered).alias("upto"), F.sum("n").over(W.partitionBy("lang")).alias("all"))
    return sums.filter(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.min("bin").alias(out))


def bands(rows: DataFrame) -> DataFrame:
    """(lang, middle, spread): the median loss per language and the robust standard deviation of one n-gram.

    The deviation of a text from the median is taken times the root of its length, as the mean of more n-grams varies
    less. Every distinct text that meets the base rules counts once, so that a text with very many copies does not move
    the band. The tables behind the medians have one row per language and ten-thousandth of a nat at most.
    """
    clean = rows.filter(~F.col("base_failed") & F.col("loss").isNotNull())
    clean = clean.groupBy("lang", "text_md5").agg(F.min("loss").alias("loss"), F.min("grams").alias("grams"))
    clean = durable(clean.select("lang", "loss", "grams"), "losses")
    bin_ = lambda c: F.round(c * BINS).cast("long").alias("bin")
    middle = durable(_medians(clean.select("lang", bin_(F.col("loss"))), "middle"), "middle")
    away = F.abs(F.col("loss") - F.col("middle") / BINS) * F.sqrt("grams")
    spread = _medians(clean.join(middle, "lang").select("lang", bin_(away)), "spread")
    return middle.join(spread, "lang").select("lang", (F.col("middle") / BINS).alias("middle"), (1.4826 * F.col("spread") / BINS).alias("spread"))


def quality(docs: DataFrame, order: int = ORDER, width: float = BAND_WIDTH, model_rows: int = MODEL_ROWS) -> DataFrame:
    """doc_id, the five counts, base_failed, perplexity (per byte) and kept, one row for every row of docs.

    kept: the base rules hold and the perplexity lies inside the band of the language, or is above it only until each
    segment is scored in the language that suits it best. A null or empty text has counts of zero, no perplexity, and
    fails the base rules. A null language is a language of its own. Repeated rows give equal rows; an empty table none.
    """
    model = durable(kneser_ney(durable(gram_counts(docs, order), "grams"), order), "model")
    models = _models(model, order, model_rows)
    rows = durable(statistics(docs, models, order), "quality")
    allowed = width * F.sqrt(F.try_divide(F.col("spread") * F.col("spread"), F.col("grams")) + F.lit(LEAST_DEVIATION**2))
    rows = rows.join(durable(bands(rows), "bands"), "lang", "left").withColumn("allowed", allowed)
    rows = rows.withColumn("over", (F.col("loss") - F.col("middle")) / F.col("allowed"))
    rows = durable(rows, "judged")
    high = durable(rows.filter(~F.col("base_failed") & (F.col("over") > 1)).select("text_md5").distinct(), "high")
    if models:
        table = bitmap(high.select(F.xxhash64("text_md5").alias("key")), "key", HIGH_BITS)
        near = with_possible(_texts(docs), F.xxhash64("text_md5"), table).filter("possible")
        again = near.join(high, "text_md5", "left_semi").dropDuplicates(["text_md5"])
        second = durable(_second_scores(again, models, order), "second")
        rows = rows.join(second, "text_md5", "left")
    else:
        rows = rows.withColumn("mixed", F.lit(None).cast("long"))
    mixed = (-F.try_divide(F.col("mixed"), F.col("grams") * F.lit(float(UNIT))) - F.col("middle")) / F.col("allowed")
    inside = F.when(F.col("over") > 1, mixed <= 1).otherwise(F.col("over") >= -1)
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return rows.select("doc_id", "text_md5", *COUNTS, "base_failed", F.exp("loss").alias("perplexity"), kept.alias("kept"))


def accepted(docs: DataFrame, order: int = ORDER, width: float = BAND_WIDTH) -> DataFrame:
    """The rows of docs that `quality` keeps."""
    rejected = quality(docs, order, width).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_text"))
    rejected = durable(rejected.distinct(), "rejected")
    own, text = F.col("doc_id").cast("long"), F.md5(F.col("text").cast("string"))
    same = lambda d: own.eqNullSafe(d["_id"]) & text.eqNullSafe(d["_text"])
    return without(docs, rejected, F.xxhash64(own, text), F.xxhash64("_id", "_text"), same)
