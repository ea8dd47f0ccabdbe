"""Near-duplicates by SimHash: fingerprints, links at a small Hamming distance, connected groups.

Links are found on distinct fingerprints, so exact copies cost nothing. With 4 differing bits, at least three of seven
bit blocks are equal, so fingerprints meet under 35 keys of about 27 bits. Inside a key, distances to reference
fingerprints (pivots) are tabulated once per row; by the triangle inequality a pair whose distances to any pivot differ
by more than the limit cannot be linked, and only the survivors have their own distance computed. Rows that are already
in one group are not compared again, and a task emits at most one link per row: a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm import arrays
from episodica.llm.bitmaps import without
from episodica.llm.components import components
from episodica.session import durable

SEED = 42
BITS = 64
PIVOTS = 16
KEY_ROWS = 4096


def _fingerprints(piece: arrays.Piece, shingle: int, seed: int) -> np.ndarray:
    """One fingerprint per text of a piece."""
    words = arrays.words_of(piece)
    inside = ~arrays.SEPARATORS[piece.bytes]
    kept = inside.copy()
    last = np.zeros(len(piece.bytes) + 1, dtype=bool)
    last[piece.offsets] = True
    ends = words.ends[~last[words.ends]]
    kept[ends] = True
    place = np.concatenate(([0], np.cumsum(kept)))
    clean = arrays.LOWER[piece.bytes]
    clean[ends] = 0x20
    joined = clean[kept].tobytes()
    counts = np.diff(words.offsets)
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = arrays.ranges(words.offsets[:-1], shingles)
    final = np.minimum(first + shingle - 1, np.repeat(words.offsets[1:] - 1, shingles))
    spans = zip(place[words.starts[first]].tolist(), place[words.ends[final]].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype=np.uint64, count=len(first))
    result = np.zeros(piece.count, dtype=np.uint64)
    filled = np.flatnonzero(shingles)
    if not len(filled):
        return result
    heads = (np.cumsum(shingles) - shingles)[filled]
    for bit in range(BITS):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), heads)
        result[filled] |= (2 * ones > shingles[filled].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return result


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for every row of docs: the SimHash of the lower-cased word shingles, as a signed long.

    Fewer words than a shingle: the whole sequence is the only shingle. No words or a null text: 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fingerprints(p, shingle, seed) for p in arrays.pieces(batch.column("text"))]
            if found:
                values = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], names=["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def _masks(limit: int) -> list[int]:
    """Masks of which at least one keeps two words equal that differ in at most `limit` bits."""
    blocks = limit + 3
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(single, 3)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        higher = parent[parent]
        if np.array_equal(higher, parent):
            return parent
        parent = higher


def pivot_links(keys: np.ndarray, fps: np.ndarray, limit: int, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Row indices (i, j) of a spanning forest of the links inside each key; rows are sorted by key."""
    n = len(keys)
    references = arrays.mix(np.arange(1, pivots + 1, dtype=np.uint64))
    table = np.stack([np.bitwise_count(fps ^ p).astype(np.int8) for p in references]) if n else np.zeros((pivots, 0))
    bounds = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), n) if n else np.zeros(1, dtype=int)
    end = np.repeat(bounds[1:], np.diff(bounds))
    parent = np.arange(n)
    left, shift = np.arange(n), 1
    while True:
        left = left[left + shift < end[left]]
        if not len(left):
            break
        i, j = left, left + shift
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
        for distances in table:
            if not len(i):
                break
            near = np.abs(distances[i] - distances[j]) <= limit
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= limit
        if near.any():
            for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                if a != b:
                    parent[max(a, b)] = min(a, b)
            parent = _find(parent)
        shift += 1
    j = np.flatnonzero(parent != np.arange(n))
    return parent[j], j


def _bucket_links(keyed: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) between nodes under one key; no key has more than a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
            i, j = pivot_links(rows[0], rows[1].view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(rows[2][i]), pa.array(rows[2][j])], names=["a", "b"])

        for batch in batches:
            rows = [np.asarray(batch.column(c)) for c in ("key", "fp", "node")]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on in the next batch
            if cut:
                yield linked([x[:cut] for x in rows])
            rest = [x[cut:] for x in rows]
        if rest is not None:
            yield linked(rest)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _variant_links(crowded: DataFrame, masks: list[int], limit: int) -> DataFrame:
    """Links under keys with very many rows, without comparing pairs.

    Every row goes to all words that differ from it in at most limit/2 of the bits outside its key. Rows within the limit
    share such a word, and rows that share one are within the limit. For an odd limit, rows also go to the words one bit
    farther; rows that come from there are linked only to rows that are nearer. A word has a bounded number of such rows.
    """
    half = limit // 2
    flips = []
    for mask in masks:
        free = [b for b in range(BITS) if not mask >> b & 1]
        flips.append([_signed(sum(1 << b for b in c)) for k in range(limit - half + 1) for c in combinations(free, k)])
    spread = None
    for at, changes in enumerate(flips):
        own = crowded.filter(F.col("at") == at)
        one = own.select(
            "at", "node", F.explode(F.array(*[F.lit(x) for x in changes])).alias("change"), "fp"
        ).select("at", "node", F.col("fp").bitwiseXOR(F.col("change")).alias("word"), (F.bit_count("change") <= half).alias("near"))
        spread = one if spread is None else spread.unionByName(one)
    met = spread.groupBy("at", "word").agg(F.min(F.when(F.col("near"), F.col("node"))).alias("a"), F.collect_list("node").alias("nodes"))
    return met.filter("a is not null").filter(F.size("nodes") > 1).select("a", F.explode("nodes").alias("b")).filter("a <> b").distinct()


def links(nodes: DataFrame, limit: int = 4, key_rows: int = KEY_ROWS) -> DataFrame:
    """Links (a, b) that connect all rows of nodes (node, fp; both distinct) with at most `limit` differing bits."""
    masks = _masks(limit)
    keys = [F.struct(F.lit(at).alias("at"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for at, m in enumerate(masks)]
    keyed = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select(
        "node", "fp", "k.at", F.xxhash64("k.at", "k.part").alias("key")
    )
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > key_rows).select("key")
    crowded = durable(counts, "crowded")
    if crowded.isEmpty():
        return _bucket_links(keyed.select("key", "fp", "node"), limit)
    plain = _bucket_links(keyed.join(crowded, "key", "left_anti").select("key", "fp", "node"), limit)
    return plain.unionByName(_variant_links(keyed.join(crowded, "key", "left_semi"), masks, limit))


def hex64(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = 4, limit: int = 4, key_rows: int = KEY_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id that can be reached over links of at most `limit` differing bits. Texts without
    words share fingerprint 0 and are linked like any other. Repeated rows give equal rows. A null doc_id is no node: its
    row takes the group of the others with its fingerprint, or null if there is none. Empty table: no rows.
    """
    prints = durable(fingerprints(docs, shingle), "fingerprints")
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"), "nodes")
    groups = components(links(nodes, limit, key_rows))
    labels = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    labels = durable(labels, "labels")
    return prints.join(labels, "fp", "left").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 4, limit: int = 4) -> DataFrame:
    """The rows of docs without those that belong to a group with a smaller doc_id; rows without doc_id stay."""
    drop = near_duplicates(docs, shingle, limit).filter(F.col("doc_id") != F.col("component_id"))
    drop = durable(drop.select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    own = F.col("doc_id").cast("long")
    return without(docs, drop, F.xxhash64(own), F.xxhash64("_id"), lambda d: own == d["_id"])
