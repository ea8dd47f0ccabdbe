"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are lower-cased runs of letters and digits, seeds are pairs of neighbouring words. An alignment of an item of n words
that scores t * n has t * n matches more than edits, so at most edits + 1 runs of matches, and at least t * n - 1 of the
item's seeds stay intact, whatever the edits are: any (1 - t) * n + 1 of its seeds hold one of them. The rarest are taken,
by a count of the seeds over all documents, so that no pair over the limit is lost and common seeds meet nothing.

Items are classed by length (powers of two). Per class, the seeds go to all tasks as a bitmap of fixed size, and around every
seed of a document as many words are cut out as an alignment of that class may reach; what passes is settled by a join.
Equal passages are aligned once per item.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm import arrays
from episodica.llm.bitmaps import bitmap, possible, without
from episodica.session import durable

SEED_WORDS = 2
LEAST_WORDS = 4
SIMILARITY = 0.8
BITMAP_BITS = 22


def _texts(df: DataFrame, key: str) -> DataFrame:
    text = F.col("text").cast("string")
    return df.select(F.col(key).cast("long").alias(key), F.md5(text).alias("text_md5"), F.lower(text).alias("text"))


def _seeds(piece: arrays.Piece) -> tuple[arrays.Words, np.ndarray, np.ndarray]:
    """Words of a piece, the first word of every seed and the hashes of the seeds."""
    words = arrays.words_of(piece, arrays.PUNCTUATION)
    prefix = arrays.prefix_hash(arrays.word_hashes(piece, words), "words")
    starts = arrays.window_starts(words.offsets, SEED_WORDS)
    return words, starts, arrays.span_hash(prefix, starts, starts + SEED_WORDS, "words")


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text, n_words, class, seeds) per distinct item of LEAST_WORDS words or more; seeds in their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, seeds = [], []
            for piece in arrays.pieces(batch.column("text")):
                words, starts, hashes = _seeds(piece)
                counts += np.diff(words.offsets).tolist()
                bounds = np.searchsorted(starts, words.offsets)
                seeds += [hashes[a:b].view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [batch.column("item"), batch.column("item_id"), batch.column("text")]
            columns += [pa.array(counts, pa.int64()), pa.array(seeds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "text", "n_words", "seeds"])

    rows = _texts(benchmark, "item_id").filter("text is not null").distinct()
    rows = rows.select(F.xxhash64("item_id", "text_md5").alias("item"), "item_id", "text")
    rows = rows.mapInArrow(run, "item long, item_id long, text string, n_words long, seeds array<long>")
    return rows.filter(F.col("n_words") >= LEAST_WORDS).withColumn("class", F.ceil(F.log2("n_words")).cast("int"))


def _spread(docs: DataFrame, table: Broadcast) -> DataFrame:
    """(seed, documents): rows of docs that hold a seed of the bitmap, added up per batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for piece in arrays.pieces(batch.column("text")):
                words, starts, hashes = _seeds(piece)
                hit = possible(table.value, hashes)
                text, hashes = arrays.owners(words.offsets, starts[hit]), hashes[hit]
                order = np.lexsort((text, hashes))
                text, hashes = text[order], hashes[order]
                new = np.append(True, (np.diff(text) != 0) | (hashes[1:] != hashes[:-1]))[: len(hashes)]
                found.append(hashes[new])
            if found:
                seeds, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(counts, pa.int64())], names=["seed", "n"])

    return _texts(docs, "doc_id").select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("documents"))


def rare_seeds(items: DataFrame, spread: DataFrame, similarity: float) -> DataFrame:
    """(item, class, n_words, seed, documents): so many of an item's rarest seeds that one must be intact."""
    share = 2 * (1 - similarity)
    placed = items.select("item", "class", "n_words", F.posexplode("seeds").alias("at", "seed"))
    placed = placed.join(spread, "seed", "left").fillna(0, ["documents"])
    order = Window.partitionBy("item").orderBy("documents", "seed", "at")
    chosen = placed.withColumn("rank", F.row_number().over(order))
    chosen = chosen.filter(F.col("rank") <= F.floor(F.col("n_words") * F.lit(share) + 1e-6) + 1)
    return chosen.select("item", "class", "n_words", "seed", "documents").distinct()


def _passages(docs: DataFrame, tables: dict[int, Broadcast], similarity: float) -> DataFrame:
    """(doc_id, text_md5, class, passage, seeds): stretches of a document around seeds that may belong to an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, classes, passages, seeds = [], [], [], []
            for piece in arrays.pieces(batch.column("text")):
                words, starts, hashes = _seeds(piece)
                data = piece.bytes.tobytes()
                for kind, table in tables.items():
                    # matched, replaced and added words of an alignment: n and at most the share of n that may be added
                    reach = ceil(2**kind * (1 + 2 * (1 - similarity)))
                    hit = possible(table.value, hashes)
                    at, own_hashes = starts[hit], hashes[hit]
                    if not len(at):
                        continue
                    text = arrays.owners(words.offsets, at)
                    new = np.flatnonzero(np.append(True, (np.diff(at) > reach) | (np.diff(text) > 0)))
                    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
                        own = text[a]
                        first = max(at[a] - reach, words.offsets[own])
                        last = min(at[b - 1] + SEED_WORDS + reach, words.offsets[own + 1])
                        rows.append(piece.rows.start + int(own))
                        classes.append(kind)
                        passages.append(data[words.starts[first] : words.ends[last - 1]].decode("utf-8", "replace"))
                        seeds.append(np.unique(own_hashes[a:b]).view(np.int64))
            if rows:
                columns = [batch.column("doc_id").take(pa.array(rows)), batch.column("text_md5").take(pa.array(rows))]
                columns += [pa.array(classes, pa.int32()), pa.array(passages, pa.string()), pa.array(seeds, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_md5", "class", "passage", "seeds"])

    schema = "doc_id long, text_md5 string, class int, passage string, seeds array<long>"
    return _texts(docs, "doc_id").mapInArrow(run, schema)


def smith_waterman(passage: np.ndarray, item: np.ndarray) -> int:
    """Best local alignment of two word sequences: 1 for a match, -1 for a replaced, left out or added word.

    One array step per word of the item; a gap along the passage is a running maximum.
    """
    at = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best = 0
    for word in item:
        fresh = np.zeros_like(row)
        fresh[1:] = np.maximum(row[:-1] + np.where(passage == word, 1, -1), row[1:] - 1)
        row = np.maximum.accumulate(np.maximum(fresh, 0) + at) - at
        best = max(best, int(row.max()))
    return best


def _words(column: pa.Array) -> list[np.ndarray]:
    found: list[np.ndarray] = []
    for piece in arrays.pieces(column):
        words = arrays.words_of(piece, arrays.PUNCTUATION)
        found += np.split(arrays.word_hashes(piece, words), words.offsets[1:-1])
    return found


def _aligned(pairs: DataFrame, similarity: float) -> DataFrame:
    """(passage_md5, item, score); 0 where too few words of the item occur in the passage at all."""

    def score(passage: np.ndarray, item: np.ndarray) -> int:
        item_there = np.isin(item, passage)
        return smith_waterman(passage, item) if item_there.sum() >= (2 * similarity - 1) * len(item) - 1e-6 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(_words(batch.column("passage")), _words(batch.column("item_text")), strict=True)
            scores = [score(a, b) for a, b in rows]
            columns = [batch.column("passage_md5"), batch.column("item"), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["passage_md5", "item", "score"])

    return pairs.select("passage_md5", "item", "passage", "item_text").mapInArrow(run, "passage_md5 string, item long, score long")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, score, shared_seeds, rarest_seed, text_md5) per document and item at or over the limit.

    similarity is (score / words of the item + 1) / 2: 1 for a full copy, less 1/words for every replaced word and half of
    that for every added one. shared_seeds counts the chosen seeds that are shared, rarest_seed is the number of rows of
    docs that have the rarest of them. Null and empty texts, and items of fewer than LEAST_WORDS words, match nothing.
    Equal rows of documents give one row; a null doc_id or item_id stays null. Empty tables: no rows.
    """
    if LEAST_WORDS * (2 * similarity - 1) <= 1:
        raise ValueError("at this similarity an alignment need not keep a seed")
    items = durable(_items(benchmark), "items")
    every = bitmap(items.select(F.explode("seeds").alias("seed")), "seed", BITMAP_BITS)
    spread = durable(_spread(docs, every), "spread")
    seeds = durable(rare_seeds(items, spread, similarity), "seeds")
    kinds = sorted(r["class"] for r in items.select("class").distinct().collect())
    tables = {kind: bitmap(seeds.filter(F.col("class") == kind), "seed", BITMAP_BITS) for kind in kinds}
    found = durable(_passages(docs, tables, similarity).withColumn("passage_md5", F.md5("passage")), "passages")
    unique = found.groupBy("passage_md5", "class").agg(F.first("seeds").alias("seeds"), F.first("passage").alias("passage"))
    unique = durable(unique, "distinct")
    candidates = (
        unique.select("passage_md5", "class", F.explode("seeds").alias("seed"))
        .join(seeds, ["seed", "class"])
        .groupBy("passage_md5", "class", "item", "n_words")
        .agg(F.count(F.lit(1)).alias("shared_seeds"), F.min("documents").alias("rarest_seed"))
    )
    texts = items.select("item", "item_id", F.col("text").alias("item_text"))
    pairs = candidates.join(unique.select("passage_md5", "class", "passage"), ["passage_md5", "class"]).join(texts, "item")
    pairs = durable(pairs, "pairs")
    scores = _aligned(pairs.repartition("passage_md5", "item"), similarity)
    value = (F.col("score") / F.col("n_words") + 1) / 2
    kept = pairs.drop("passage", "item_text").join(scores, ["passage_md5", "item"]).withColumn("similarity", value)
    kept = durable(kept.filter(F.col("similarity") >= similarity - 1e-9), "kept")
    best = F.max_by(F.struct("score", "shared_seeds", "rarest_seed"), "similarity")
    rows = found.select("doc_id", "text_md5", "passage_md5", "class").join(kept, ["passage_md5", "class"])
    rows = rows.groupBy("doc_id", "text_md5", "item", "item_id").agg(F.max("similarity").alias("similarity"), best.alias("best"))
    return rows.select("doc_id", "item_id", "similarity", "best.score", "best.shared_seeds", "best.rarest_seed", "text_md5")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that match no item of the benchmark."""
    drop = contaminated(docs, benchmark, similarity).select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_text"))
    own, text = F.col("doc_id").cast("long"), F.md5(F.col("text").cast("string"))
    same = lambda d: own.eqNullSafe(d["_id"]) & text.eqNullSafe(d["_text"])
    return without(docs, durable(drop.distinct(), "dropped"), F.xxhash64(own, text), F.xxhash64("_id", "_text"), same)
