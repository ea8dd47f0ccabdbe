"""Mixing sources to target weights by Pfair scheduling.

The documents of a source form blocks. In an ideal mixture all sources are served at once, each in proportion to its exact
weight, until it runs out; then the others share its part in proportion. Block j of a source is released in the slot in
which that mixture begins it and is due by the end of the slot in which it ends it; every slot goes to the released block
with the earliest deadline. On one queue that meets every deadline, so before any slot, also behind sources that ran out, a
source has had what the ideal mixture gives it to within less than one block. No document is left out and none is repeated.

Rows are placed by DataFrame operations. The queue itself goes block after block: it runs on the driver, over whole numbers
without rounding, and holds one number per block of block_rows documents, never a document or an id.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from fractions import Fraction
from heapq import heapify, heappop, heappush
from itertools import accumulate
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.session import durable

BLOCK_ROWS = 64
POWER = 0.7


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _cells(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows with their cell: a source is ordered by a hash of the id, in 16,384 cells."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _source().alias("source"), F.xxhash64("doc_id").alias("order"), *more
    )
    return rows.withColumn("cell", F.shiftrightunsigned("order", 50))


def _in_blocks(rows: DataFrame, cells: DataFrame, block_rows: int) -> DataFrame:
    """Rows with block and in_block. A window sees one cell of one source, never a whole source; the start of a cell is
    the sum of the counts before it."""
    before = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select("source", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("source", "cell").orderBy("order", "doc_id")) - 1
    placed = rows.withColumn("inside", inside).join(durable(starts, "starts"), ["source", "cell"])
    rank = F.col("start") + F.col("inside")
    block = F.floor(rank / F.lit(block_rows)).cast("long")
    placed = placed.withColumns({"block": block, "in_block": F.pmod(rank, F.lit(block_rows)).cast("int")})
    return placed.drop("order", "cell", "inside", "start")


def edf_slots(blocks: list[int], weights: list[Fraction]) -> list[array]:
    """The slots of the blocks of every source, by the earliest deadline among the released blocks, in whole numbers.

    fluid(x) = sum over k of min(blocks[k], weights[k] * x) is the slot at which an ideal mixture has served every source
    up to weight * x; block j of a source is released at floor(fluid(j / w)) and due by ceil(fluid((j + 1) / w)).
    """
    scale = lcm(*(w.denominator for w in weights))
    parts = [int(w * scale) for w in weights]
    ends = sorted(range(len(blocks)), key=lambda k: Fraction(blocks[k], parts[k]))
    breaks = [Fraction(blocks[k], parts[k]) for k in ends]
    served = [0, *accumulate(blocks[k] for k in ends)]
    active = [sum(parts) - gone for gone in (0, *accumulate(parts[k] for k in ends))]
    epoch = [0] * len(blocks)

    def fluid(i: int, j: int) -> tuple[int, int]:
        """Numerator and denominator of fluid(j / w) of source i; j must not fall from call to call."""
        e = epoch[i]
        if e < len(ends) and blocks[ends[e]] * parts[i] <= j * parts[ends[e]]:
            e = epoch[i] = bisect_right(breaks, Fraction(j, parts[i]), e)
        return served[e] * parts[i] + active[e] * j, parts[i]

    def window(i: int, j: int) -> tuple[int, int]:
        (a, p), (b, _) = fluid(i, j), fluid(i, j + 1)
        return a // p, -(-b // p)

    slots = [array("q") for _ in blocks]
    waiting, ready = [(*window(i, 0), i) for i, n in enumerate(blocks) if n], []
    heapify(waiting)
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, due, i = heappop(waiting)
            heappush(ready, (due, i))
        _, i = heappop(ready)
        slots[i].append(slot)
        if len(slots[i]) < blocks[i]:
            heappush(waiting, (*window(i, len(slots[i])), i))
    return slots


def _schedule(sources: DataFrame, frame: int | None) -> DataFrame:
    """(source, block, slot), one row per block, from sources (source, blocks, weight), one row per source."""
    rows = sorted(sources.collect())
    weights = [Fraction(r.weight) for r in rows]
    if frame is not None:
        total = sum(weights)
        weights = [Fraction(max(1, round(w * frame / total))) for w in weights]
    slots = edf_slots([r.blocks for r in rows], weights) if rows else []
    names = pa.array([r.source for r in rows], pa.string())
    which = np.repeat(np.arange(len(rows)), [len(s) for s in slots])
    table = pa.table({
        "source": names.take(pa.array(which, pa.int64())),
        "block": pa.array(np.concatenate([np.zeros(0, np.int64), *(np.arange(len(s)) for s in slots)]), pa.int64()),
        "slot": pa.array(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(s, np.int64) for s in slots)]), pa.int64()),
    })
    spark = sources.sparkSession
    return durable(spark.createDataFrame(table, "source string, block long, slot long"), "slots")


def _placed(rows: DataFrame, cells: DataFrame, weights: DataFrame | None, block_rows: int, frame: int | None) -> DataFrame:
    """Rows with block, in_block and slot."""
    counts = cells.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        weights = counts.select("source", F.pow("n", F.lit(POWER)).alias("weight"))
    weights = weights.groupBy(_source().alias("source")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    known = F.coalesce("weight", F.min("weight").over(W.partitionBy()), F.lit(1.0))
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("long").alias("blocks")
    sources = counts.join(weights.filter("weight > 0"), "source", "left").select("source", blocks, known.alias("weight"))
    return _in_blocks(rows, cells, block_rows).join(_schedule(sources, frame), ["source", "block"])


def mixed(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, frame: int | None = None) -> DataFrame:
    """(doc_id, source, block, in_block, slot) for every row of docs: the block slot of a row in the mixed order.

    weights: (source, weight > 0), one row per source; a source without one gets the least weight given (1 if none is).
    Default: row counts to the power POWER, which lifts small sources. Slots count from 0 without gaps, one block of up to
    block_rows rows each; the last block of a source may be shorter. The number of blocks of a source before any slot
    differs from its share by less than one; a source that has run out leaves its part to the others. frame: round weights
    to whole slots of such a frame, one at least; by default they are exact. A null source is a source of its own (shown as
    ''); rows without doc_id and repeated rows take places like any others. Empty table: no rows.
    """
    rows = _cells(docs)
    cells = durable(rows.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    return _placed(rows, cells, weights, block_rows, frame).select("doc_id", "source", "block", "in_block", "slot")


def in_mixed_order(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, frame: int | None = None) -> DataFrame:
    """All rows of docs, range-partitioned and sorted by their place in the mixed order, so that files hold the mixture.

    The documents are shuffled twice: to their cell, which gives them their place, and to the place.
    """
    cells = durable(_cells(docs).groupBy("source", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    rows = _cells(docs, F.struct(*docs.columns).alias("row"))
    placed = _placed(rows, cells, weights, block_rows, frame).select("slot", "in_block", "row")
    return placed.repartitionByRange("slot", "in_block").sortWithinPartitions("slot", "in_block").select("row.*")


def written_place() -> Column:
    """The place of a row in files that in_mixed_order gave, read back: number of the file, its part, row of that part.

    A whole number below 2**60. Spark numbers files by range and sorts rows inside, so it rises along the mixed order.
    """
    def number(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0))

    file, part = number(r"^part-(\d+)"), number(r"-c(\d+)\.")
    return F.shiftleft(file, 40) + F.shiftleft(part, 30) + F.col("_metadata.row_index")
