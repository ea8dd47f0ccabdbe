"""Shards of nearly equal size whose cuts never divide a group of equal texts.

Groups are ordered by the hash of their text, or by a given place of their rows. The best contiguous partition has the least
possible largest shard: a binary search over the capacity, where a capacity is feasible if filling shard after shard up to
it needs no more than the allowed number. The search runs on sums per range of hashes or places. Such sums give a lower and
an upper bound of the capacity and of every cut; only the ranges between the bounds are summed again more finely, until
every cut lies between two groups. The driver holds one number per range, a few hundred thousand at most, whatever the
number of documents.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.session import durable

SHARDS = 24
#: Bits of the ordering hash, and how many of them the first and each further round of sums resolve.
HASH_BITS = 60
FIRST_BITS = 16
MORE_BITS = 8


class Ranges:
    """Sums over consecutive ranges of the hash; `whole` marks ranges of a single group."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> None:
        self.starts, self.sizes, self.whole = starts, sizes, whole
        self.edges = np.concatenate(([0], np.cumsum(sizes)))

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """Range at which each shard ends, or None if the capacity does not suffice.

        A range that does not fit as a whole goes to the next shard, or, if hopeful and it has several groups, counts as
        fitting: greedy filling of the groups themselves ends somewhere between the two.
        """
        at, found = 0, []
        while at < len(self.sizes):
            if len(found) == shards:
                return None
            end = int(np.searchsorted(self.edges, self.edges[at] + capacity, side="right")) - 1
            if hopeful and end < len(self.sizes) and self.edges[end] < self.edges[at] + capacity and not self.whole[end]:
                end += 1
            if end == at:
                return None
            found.append(end)
            at = end
        return found + [len(self.sizes)] * (shards - len(found))

    def least_capacity(self, shards: int, hopeful: bool) -> int:
        low, high = -(-int(self.edges[-1]) // shards), int(self.edges[-1])
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, hopeful) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def unsettled(self, shards: int) -> np.ndarray:
        """Ranges of several groups that may hold a cut of the best partition."""
        early = self.cuts(self.least_capacity(shards, True), shards, False) or []
        late = self.cuts(self.least_capacity(shards, False), shards, True)
        first = self._pessimistic(self.least_capacity(shards, True), shards) if not early else early
        marked = np.zeros(len(self.sizes) + 1, dtype=bool)
        for a, b in zip(first, late, strict=True):
            marked[min(a, b) : max(a, b) + 1] = True
        return marked[:-1] & ~self.whole

    def _pessimistic(self, capacity: int, shards: int) -> list[int]:
        """The earliest possible ends under a capacity that may be too small for the ranges as wholes."""
        at, found = 0, []
        for _ in range(shards):
            at = max(at, int(np.searchsorted(self.edges, self.edges[at] + capacity, side="right")) - 1)
            found.append(at)
        return found


def _sums(groups: DataFrame, shift: int, wider: int = 0, inside: list[int] | None = None) -> Ranges:
    """Sums per range of 2**shift hashes, of all groups or of those inside some ranges of 2**wider hashes."""
    if inside is not None:
        groups = groups.filter(F.shiftright("hash", wider).isin(inside))
    rows = (
        groups.groupBy(F.shiftright("hash", shift).alias("range"))
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        .toArrow()
    )
    starts = rows["range"].to_numpy().astype(np.int64) << shift
    turn = np.argsort(starts)
    return Ranges(starts[turn], rows["size"].to_numpy()[turn].astype(np.int64), rows["n"].to_numpy()[turn] == 1)


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, bits: int = HASH_BITS) -> list[int]:
    """First hash of each shard but the first, for groups (hash, size) with distinct hashes of that many bits."""
    shift = max(bits - FIRST_BITS, 0)
    held = _sums(groups, shift)
    if not len(held.sizes):
        return []
    while (open_ := held.unsettled(shards)).any() and shift:
        finer = max(shift - MORE_BITS, 0)
        part = _sums(groups, finer, shift, (held.starts[open_] >> shift).tolist())
        starts = np.concatenate((held.starts[~open_], part.starts))
        turn = np.argsort(starts)
        sizes = np.concatenate((held.sizes[~open_], part.sizes))[turn]
        held = Ranges(starts[turn], sizes, np.concatenate((held.whole[~open_], part.whole | (finer == 0)))[turn])
        shift = finer
    ends = held.cuts(held.least_capacity(shards, False), shards, False)
    return [int(held.starts[e]) if e < len(held.starts) else 1 << bits for e in ends[:-1]]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _in_place_order(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with the least place of their text as hash, and its bits. Texts that occur once, mostly all, need no join."""
    several = rows.groupBy("hash").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(durable(several.select("hash", "least"), "several"), "hash", "left")
    rows = durable(rows.withColumn("hash", F.coalesce("least", "place")).drop("least"), "places")
    return rows, int(rows.agg(F.max("place")).first()[0] or 0).bit_length()


def sharded(docs: DataFrame, shards: int = SHARDS, cells: int = 4096, place: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs; law is 'bytes'.

    size is the number of UTF-8 bytes of the text plus 8 (null counts as an empty text). Rows with equal texts share a
    shard. No partition into contiguous groups in the order of the text hash has a smaller largest shard; shards may stay
    empty if there are fewer groups. slot counts the rows of a shard from 0, in the order of a hash of the doc_id; repeated
    rows and rows without doc_id take slots of their own. grown_shard is null. Empty table: no rows.

    place: whole numbers of up to HASH_BITS bits, another for every row, that give an order to keep: groups are cut in the
    order of their least place, and slots follow the places.
    """
    digest = F.conv(F.substring(F.md5(_text()), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(_text()) + 8).cast("long").alias("size"),
        F.crc32(_text()).alias("text_crc32"),
        digest.alias("hash"),
        (F.xxhash64("doc_id") if place is None else place).alias("place"),
    )
    rows, bits = durable(rows, "sizes"), HASH_BITS
    if place is not None:
        rows, bits = _in_place_order(rows)
    groups = durable(rows.groupBy("hash").agg(F.sum("size").alias("size")), "groups")
    cuts = minimax_cuts(groups, shards, bits)
    shard = reduce(lambda a, b: a + b, [(F.col("hash") >= c).cast("int") for c in cuts], F.lit(0))
    cell = F.pmod("place", F.lit(cells)) if place is None else F.floor(F.col("place") / F.lit(cells))
    placed = rows.withColumn("shard", shard).withColumn("cell", cell)
    counts = durable(placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", "cell").orderBy("place", "doc_id", "hash")) - 1
    slotted = placed.withColumn("inside", inside).join(durable(starts, "starts"), ["shard", "cell"])
    return slotted.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
