"""Candidates for long repeats: anchored runs of windows, and which anchors occur more than once.

Every window of a text has an anchor that its content alone decides (arrays.anchored_runs), so equal windows have equal
anchors, and a window whose anchor occurs only once in the corpus repeats nothing. The occurrences of anchors are counted
in a sketch of fixed size: a task sends its anchors as sorted arrays per range of hashes, and each range is counted by one
task in tables whose size does not depend on the number of anchors. A sketch can only take too many anchors for repeated
or for frequent; which windows are equal is settled afterwards, so the results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm import arrays

#: Bits of the sketch; the first of them choose the range of hashes that a task counts.
BITS = 26
RANGE_BITS = 8
#: Counts are held this much finer than the sketch, so that few single anchors are taken for repeated ones.
FINER_BITS = 3
#: From so many runs on, an anchor (or a few anchors that share a cell of the sketch) is taken as frequent.
FREQUENT = 4096
#: Anchors that a task gathers before it sends them.
GATHERED = 4_000_000

Finder = Callable[[arrays.Piece], tuple[np.ndarray, np.ndarray]]


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text) of the rows that have a text; mark tells different texts under one doc_id apart."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.filter(F.col("text").isNotNull())


def anchor_sketch(docs: DataFrame, find: Finder, gathered: int = GATHERED, piece_bytes: int = arrays.PIECE_BYTES) -> Broadcast:
    """Broadcast of two bitmaps: anchors that may occur more than once, and those that may be frequent.

    find gives the anchors of the texts of a piece and how often each counts there. No more than 2 * 2**BITS / 8 bytes
    reach the driver and the tasks.
    """
    low_bits = BITS - RANGE_BITS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            anchors, place = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([n for _, n in held])).astype(np.int64)
            home = anchors >> np.uint64(64 - RANGE_BITS)
            part = ((anchors >> np.uint64(64 - RANGE_BITS - 32)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            bounds = np.searchsorted(home, np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64))
            cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            once = [part[a:b][counts[a:b] == 1].tobytes() for a, b in cuts]
            more = [part[a:b][counts[a:b] > 1].tobytes() for a, b in cuts]
            times = [np.minimum(counts[a:b][counts[a:b] > 1], 1 << 30).astype(np.int32).tobytes() for a, b in cuts]
            columns = [pa.array(range(len(cuts)), pa.int32()), *[pa.array(x, pa.binary()) for x in (once, more, times)]]
            yield pa.RecordBatch.from_arrays(columns, names=["home", "once", "more", "times"])
            held.clear()

        for batch in batches:
            for piece in arrays.pieces(batch.column("text"), piece_bytes):
                anchors, counts = find(piece)
                if len(anchors):
                    held.append((anchors, counts))
            if sum(len(a) for a, _ in held) > gathered:
                yield from sent()
        if held:
            yield from sent()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, total = -1, np.zeros(0, dtype=np.int32)

        def done() -> pa.RecordBatch:
            cells = total.reshape(1 << low_bits, -1)
            repeated, frequent = (cells > 1).any(axis=1), cells.sum(axis=1) >= FREQUENT
            maps = [pa.array([np.packbits(x).tobytes()], pa.binary()) for x in (repeated, frequent)]
            return pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), *maps], names=["home", "repeated", "frequent"])

        shift = np.uint32(32 - low_bits - FINER_BITS)
        for batch in batches:
            for row in batch.to_pylist():
                if row["home"] != home:
                    if home >= 0:
                        yield done()
                    home, total = row["home"], np.zeros(1 << (low_bits + FINER_BITS), dtype=np.int32)
                np.add.at(total, np.frombuffer(row["once"], dtype=np.uint32) >> shift, 1)
                more = np.frombuffer(row["more"], dtype=np.uint32) >> shift
                np.add.at(total, more, np.frombuffer(row["times"], dtype=np.int32))
        if home >= 0:
            yield done()

    parts = docs.select("text").mapInArrow(gather, "home int, once binary, more binary, times binary")
    parts = parts.repartition("home").sortWithinPartitions("home")
    maps = parts.mapInArrow(count, "home int, repeated binary, frequent binary").toArrow()
    tables = np.zeros((2, 1 << RANGE_BITS, 1 << low_bits >> 3), dtype=np.uint8)
    for row in maps.to_pylist():
        tables[0, row["home"]] = np.frombuffer(row["repeated"], dtype=np.uint8)
        tables[1, row["home"]] = np.frombuffer(row["frequent"], dtype=np.uint8)
    return docs.sparkSession.sparkContext.broadcast(tables.reshape(2, -1))


def marked(table: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Which anchors are set in one of the bitmaps."""
    cell = anchors >> np.uint64(64 - BITS)
    return (table[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1


def any_marked(table: np.ndarray) -> bool:
    return bool(table.any())
