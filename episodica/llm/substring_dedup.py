"""Removal of repeated word sequences by compacting the De Bruijn graph of word k-mers.

The edges of the graph are the windows of 13 words, each known by 96 bits of two hashes over its words, which both must
agree (each word by a hash modulo 2**64 and one in a prime field). Runs of windows with one anchor meet in one task, where each distinct edge finds its
first source, the occurrence in the smallest doc_id. An edge of a later document is a repeat of that source. Consecutive
repeats whose sources are consecutive too, so that no branch lies between them, are one path: inside a run they are
compacted where they are found, and across runs by the distance of their coordinates. A path is a long repeated span with
the coordinates of both copies; its words are covered and removed.

Frequent anchors do not meet in one task. Their equal runs are reduced to one first, with its first and last document;
a later occurrence is a copy of that first one as a whole. Only the edges of distinct runs are unfolded, reduced per edge
and compacted, which settles what is repeated in the first occurrences themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.llm import arrays, repeats
from episodica.llm.bitmaps import bitmap, with_possible
from episodica.session import durable

WINDOW = 13
GRAM = 3
RUN_WINDOWS = 16
DOC_BITS = 22
#: Anchors that a task gathers before it sends them to be counted.
GATHERED = 500_000
#: Bytes of text that a task works on at a time.
PIECE_BYTES = 1 << 18
#: Rows of a batch that Spark hands to Python; whole texts are long, and a batch is held on both sides.
BATCH_ROWS = "2000"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _runs(piece: arrays.Piece, window: int) -> tuple[arrays.Words, np.ndarray, np.ndarray, arrays.Runs]:
    words = arrays.words_of(piece)
    hashes = arrays.word_hashes(piece, words)
    prefix = arrays.prefix_hash(hashes, "words")
    gram = min(GRAM, window)
    return words, hashes, prefix, arrays.anchored_runs(prefix, "words", words.offsets, window, gram, RUN_WINDOWS)


def _anchors(window: int):
    def find(piece: arrays.Piece) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors of the runs and how often each occurs."""
        return np.unique(_runs(piece, window)[3].anchor, return_counts=True)

    return find


def _edge_runs(rows: DataFrame, sketch: Broadcast, window: int, frequent: bool) -> DataFrame:
    """(anchor, doc_id, mark, start, edges, checks) of the runs whose anchor may repeat: both hashes of each window."""
    names = ["anchor", "doc_id", "mark", "start", "edges", "checks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.pieces(batch.column("text"), PIECE_BYTES):
                words, hashes, prefix, runs = _runs(piece, window)
                if not len(runs.anchor):
                    continue
                keep = repeats.marked(sketch.value[0], runs.anchor)
                keep &= repeats.marked(sketch.value[1], runs.anchor) == frequent
                start, count, text = runs.start[keep], runs.windows[keep], runs.text[keep]
                if not len(start):
                    continue
                at = arrays.ranges(start, count)
                edges = arrays.span_hash(prefix, at, at + window, "words").view(np.int64)
                second = arrays.prefix_hash(arrays.mix(~hashes), "bytes")
                checks = (arrays.span_hash(second, at, at + window, "bytes") >> np.uint64(32)).astype(np.uint32).view(np.int32)
                cuts = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
                owner = pa.array(text + piece.rows.start)
                columns = [
                    pa.array(runs.anchor[keep].view(np.int64)),
                    batch.column("doc_id").take(owner),
                    batch.column("mark").take(owner),
                    pa.array((start - words.offsets[text]).astype(np.int32)),
                    pa.ListArray.from_arrays(cuts, pa.array(edges)),
                    pa.ListArray.from_arrays(cuts, pa.array(checks)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "anchor long, doc_id long, mark long, start int, edges array<long>, checks array<int>")


def _first_sources(runs: DataFrame) -> DataFrame:
    """(doc_id, mark, start, windows, source_doc, source_start): stretches of edges that a smaller doc_id has, per run.

    All edges of an anchor meet in one task, sorted by anchor; a task works on some thousand runs at a time.
    """
    names = ["doc_id", "mark", "start", "windows", "source_doc", "source_start"]

    def resolved(rows: pa.Table) -> pa.RecordBatch | None:
        edges = rows["edges"].combine_chunks()
        counts = np.diff(edges.offsets.to_numpy())
        values, checks = edges.flatten().to_numpy(), rows["checks"].combine_chunks().flatten().to_numpy()
        if not len(values):
            return None
        doc = np.repeat(rows["doc_id"].to_numpy(), counts)
        inside = arrays.ranges(np.zeros(len(counts), dtype=np.int64), counts)
        at = np.repeat(rows["start"].to_numpy().astype(np.int64), counts) + inside
        order = np.lexsort((at, doc, checks, values))
        new = np.append(True, (values[order][1:] != values[order][:-1]) | (checks[order][1:] != checks[order][:-1]))
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        source = np.empty(len(order), dtype=np.int64)
        source[order] = head
        source_doc, source_at = doc[source], at[source]
        hit = source_doc < doc
        row = np.repeat(np.arange(len(counts)), counts)
        follows = np.zeros(len(hit), dtype=bool)
        follows[1:] = hit[1:] & hit[:-1] & (row[1:] == row[:-1]) & (source_doc[1:] == source_doc[:-1])
        follows[1:] &= source_at[1:] - source_at[:-1] == 1
        first = np.flatnonzero(hit & ~follows)
        if not len(first):
            return None
        length = np.diff(np.append(np.cumsum(hit)[first] - 1, hit.sum()))
        owner = pa.array(row[first])
        columns = [rows["doc_id"].combine_chunks().take(owner), rows["mark"].combine_chunks().take(owner)]
        columns += [pa.array(x.astype(np.int64)) for x in (at[first], length, source_doc[first], source_at[first])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            anchors = held["anchor"].to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1])) if len(anchors) else 0
            if cut:
                out = resolved(held.slice(0, cut))
                if out is not None:
                    yield out
                held = held.slice(cut)
        if held is not None and held.num_rows:
            out = resolved(held)
            if out is not None:
                yield out

    together = runs.repartition("anchor").sortWithinPartitions("anchor")
    return together.mapInArrow(run, "doc_id long, mark long, start long, windows long, source_doc long, source_start long")


def _stretches(parts: Column) -> Column:
    """Edges (i, source) of one run as stretches (i, windows, source_doc, source_start) of consecutive sources."""

    def add(found: Column, x: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        goes_on = (last["i"] + last["windows"] == x["i"]) & (last["source_doc"] == x["source"]["doc_id"])
        goes_on &= last["source_start"] + last["windows"] == x["source"]["start"]
        names = ("i", "windows", "source_doc", "source_start")
        longer = F.struct(*[(last[c] + 1 if c == "windows" else last[c]).alias(c) for c in names])
        values = (x["i"].cast("long"), F.lit(1).cast("long"), x["source"]["doc_id"], x["source"]["start"])
        new = F.struct(*[v.alias(c) for v, c in zip(values, names, strict=True)])
        before = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))
        return F.when(goes_on, F.concat(before, F.array(longer))).otherwise(F.concat(found, F.array(new)))

    none = F.array().cast("array<struct<i:bigint,windows:bigint,source_doc:bigint,source_start:bigint>>")
    return F.aggregate(F.array_sort(parts), none, add)


def _frequent_sources(found: DataFrame) -> DataFrame:
    """The same for frequent anchors: equal runs are reduced first, and the edges of distinct runs on the map side."""
    found = durable(found, "frequent")
    name = ["anchor", "edges", "checks"]
    runs = found.groupBy(*name).agg(F.min(F.struct("doc_id", "mark", "start")).alias("first"), F.max("doc_id").alias("last"))
    runs = durable(runs, "runs")
    each = runs.select("first", "last", F.posexplode(F.arrays_zip("edges", "checks")).alias("i", "edge"))
    place = F.struct("first.doc_id", (F.col("first.start") + F.col("i")).cast("long").alias("start"))
    sources = durable(each.groupBy("edge").agg(F.min(place).alias("source"), F.max("last").alias("last")), "sources")
    sources = sources.filter(F.col("source.doc_id") < F.col("last")).select("edge", "source")
    parts = each.join(sources, "edge").filter(F.col("source.doc_id") < F.col("last"))
    parts = parts.groupBy("first").agg(_stretches(F.collect_list(F.struct("i", "source"))).alias("parts"))
    known = runs.join(parts, "first", "left").filter((F.col("first.doc_id") < F.col("last")) | F.col("parts").isNotNull())
    copy = [F.lit(0), F.size("edges"), F.col("first.doc_id"), F.col("first.start")]
    copy = F.array(F.struct(*[v.cast("long").alias(c) for v, c in zip(copy, ("i", "windows", "source_doc", "source_start"), strict=True)]))
    met = found.join(known, name).withColumn("parts", F.when(F.col("doc_id") > F.col("first.doc_id"), copy).otherwise(F.col("parts")))
    met = met.select("doc_id", "mark", "start", F.explode("parts").alias("part")).filter(F.col("part.source_doc") < F.col("doc_id"))
    at = (F.col("start") + F.col("part.i")).alias("start")
    return met.select("doc_id", "mark", at, "part.windows", "part.source_doc", "part.source_start")


def repeated_paths(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, start, words, source_doc, source_start): maximal paths of repeated edges, in words of the input.

    The words of a path at `start` equal those of source_doc at source_start, an occurrence in a smaller doc_id. Rows without doc_id
    have no place in the order and take no part.
    """
    rows = repeats.texts(docs).filter("doc_id is not null")
    with _small_batches(docs.sparkSession):
        sketch = repeats.anchor_sketch(rows, _anchors(window), GATHERED, PIECE_BYTES)
        pieces = _first_sources(_edge_runs(rows, sketch, window, False))
        if repeats.any_marked(sketch.value[1]):
            pieces = pieces.unionByName(_frequent_sources(_edge_runs(rows, sketch, window, True)))
        pieces = durable(pieces, "pieces")
    line = W.partitionBy("doc_id", "mark", "source_doc", "shift").orderBy("start")
    joined = (
        pieces.withColumn("shift", F.col("start") - F.col("source_start"))
        .withColumn("new", (F.col("start") > F.lag(F.col("start") + F.col("windows")).over(line)).cast("int"))
        .withColumn("path", F.sum(F.coalesce("new", F.lit(1))).over(line))
        .groupBy("doc_id", "mark", "source_doc", "shift", "path")
        .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("windows")).alias("end"))
    )
    return joined.select(
        "doc_id",
        "mark",
        "start",
        (F.col("end") - F.col("start") + window - 1).alias("words"),
        "source_doc",
        (F.col("start") - F.col("shift")).alias("source_start"),
    )


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _kept(rows: DataFrame, spans: bool, keep_text: bool) -> DataFrame:
    """Removes the words of the spans of each row and describes what is left."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("spans").to_pylist() if spans else None
            total, removed, digests, kept_texts = [], [], [], []
            for piece in arrays.pieces(batch.column("text"), PIECE_BYTES):
                words = arrays.words_of(piece)
                drop = np.zeros(len(words.starts), dtype=bool)
                if given is not None:
                    own = [(x["start"] + words.offsets[i], x["words"]) for i, s in enumerate(given[piece.rows]) for x in s or ()]
                    if own:
                        start, size = (np.asarray(x, dtype=np.int64) for x in zip(*own, strict=True))
                        drop = arrays.covered(len(words.starts), start, size)
                data = piece.bytes.tobytes()
                a, b = words.starts.tolist(), words.ends.tolist()
                for i in range(piece.count):
                    at = range(words.offsets[i], words.offsets[i + 1])
                    left = b" ".join([data[a[w] : b[w]] for w in at if not drop[w]])
                    total.append(len(at))
                    removed.append(int(drop[at.start : at.stop].sum()))
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept_texts.append(left.decode("utf-8", "replace") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, t) for x, t in zip((total, removed, digests, kept_texts), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]],
                names=names,
            )

    return rows.mapInArrow(run, _RESULT)


def deduplicated(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row of docs; kept is the text left, words joined by one space.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. A null text is empty. Rows that share a doc_id do not remove each other's words; rows without a
    doc_id keep all words. Fewer words than a window: nothing goes. Empty table: no rows.

    Only documents that have spans are shuffled to meet them; a bitmap of fixed size tells the others.
    """
    paths = durable(repeated_paths(docs, window), "paths")
    spans = paths.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "words")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    table = bitmap(paths.select(F.xxhash64("doc_id", "mark").alias("key")).distinct(), "key", DOC_BITS)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))

    marked = with_possible(rows, F.xxhash64("doc_id", "mark"), table)
    plain = _kept(marked.filter(~F.col("possible")).select("doc_id", "text"), False, keep_text)
    same = (F.col("doc_id") == F.col("_id")) & (F.col("mark") == F.col("_mark"))
    met = marked.filter("possible").join(spans, same, "left").select("doc_id", "text", "spans")
    result = plain.unionByName(_kept(met, True, keep_text))
    return result if keep_text else result.drop("kept")

