"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

Runs of 200-byte windows with one anchor meet in one task. There the distinct runs are joined into one byte string; its
suffixes that are smaller than their successors are sorted directly, all others are induced from them by one scan over
the buckets of first bytes, and common prefixes of neighbours in the array tell which windows occur again. Comparison
needs no more than the window, so all equal windows are neighbours.

Frequent anchors do not meet in one task. Their distinct runs are found by aggregation, dealt into blocks by content, and
every block has a suffix array of its own; windows that are alone in their block are then counted over all blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm import arrays, repeats
from episodica.llm.bitmaps import bitmap, with_possible
from episodica.session import durable

WINDOW = 200
GRAM = 96
RUN_WINDOWS = 128
DOC_BITS = 22
#: Bytes whose suffixes are sorted together, unless one anchor has more.
BLOCK_BYTES = 1 << 20
#: Distinct runs of a frequent anchor that make a block.
BLOCK_RUNS = 2000
#: Fixed value: a byte that no UTF-8 text holds, between the runs.
BETWEEN = 0xFF


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in an order by their first `depth` bytes at least; a suffix sorts before its extensions.

    Two-stage sorting: with the types of suffixes known, those smaller than their successor are sorted by comparison. In
    a bucket of suffixes with one first byte, the larger type comes first, and each of them follows, in the order of its
    successor, from a bucket that is done or from the same one; a scan of the buckets in order places them all.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    changes = np.flatnonzero(np.append(data[1:] != data[:-1], True))
    run_end = changes[np.searchsorted(changes, np.arange(n))]
    following = np.append(data, 0)[run_end + 1].astype(np.int16)
    following[run_end == n - 1] = -1
    smaller = data.astype(np.int16) < following

    direct = _sorted_directly(np.flatnonzero(smaller), data, depth)
    bounds = np.searchsorted(data[direct], np.arange(257))

    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not smaller[n - 1]:
        buckets[data[n - 1]].append(np.asarray([n - 1]))
    done = []
    for byte in range(256):
        fresh = buckets[byte]
        while fresh:  # runs of one byte induce inside their own bucket
            induced = _induce(np.concatenate(fresh), data, smaller, byte, buckets)
            done.append(np.concatenate(fresh))
            fresh = [induced] if len(induced) else []
        own = direct[bounds[byte] : bounds[byte + 1]]
        if len(own):
            done.append(own)
            _induce(own, data, smaller, byte, buckets)
    return np.concatenate(done)


def _sorted_directly(starts: np.ndarray, data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in an order by their first `depth` bytes at least: by 16 bytes as two numbers, then those alike in
    them by comparison. The end of the data reads as zeros there, which sorts before or ties with what is longer."""
    if not len(starts):
        return starts
    words = _words(data, 16)
    starts = starts[np.argsort(words[starts + 8])]
    starts = starts[np.argsort(words[starts], kind="stable")]
    first, second = words[starts], words[starts + 8]
    same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    text, at = data.tobytes().decode("latin-1"), starts[tied]
    keys = [text[i : i + depth] for i in at.tolist()]
    # neighbours are nearly in order already, which sorted() makes use of
    starts[tied] = at[sorted(range(len(keys)), key=keys.__getitem__)] if len(keys) else at
    return starts


def _words(data: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from every place on as a number, first byte highest, up to depth + 8 places behind the data; zeros there."""
    padded = np.append(data, np.zeros(depth + 16, dtype=np.uint8)).astype(np.uint64)
    words = padded[: len(data) + depth + 8]
    for i in range(1, 8):
        words = (words << np.uint64(8)) | padded[i : i + len(words)]
    return words


def _induce(at: np.ndarray, data: np.ndarray, smaller: np.ndarray, byte: int, buckets: list[list[np.ndarray]]) -> np.ndarray:
    """Place the larger-type suffixes one byte before `at` in their buckets; those of the same bucket are returned."""
    before = at[at > 0] - 1
    before = before[~smaller[before]]
    first = data[before]
    for other in np.unique(first[first > byte]).tolist():
        buckets[other].append(before[first == other])
    return before[first == byte]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the order, up to depth; 0 for the first."""
    words = _words(data, depth)
    same = np.zeros(len(order), dtype=np.int64)
    pairs = np.arange(1, len(order))
    for step in range(0, depth, 8):
        differ = words[order[pairs] + step] ^ words[order[pairs - 1] + step]
        ends = differ != 0
        bits = np.log2(differ[ends].astype(np.float64))  # rounding up a power cannot cross a byte but at its very top
        leading = 7 - np.minimum(bits, 63).astype(np.int64) // 8
        leading += (differ[ends] >> (np.uint64(8) * (7 - leading).astype(np.uint64))) == 0
        same[pairs[ends]] = step + leading
        pairs = pairs[~ends]
        if not len(pairs):
            break
    same[pairs] = depth
    reach = len(data) - np.maximum(order[1:], order[:-1]) if len(order) else same
    same[1:] = np.minimum(np.minimum(same[1:], reach), depth)
    return same


def repeated_windows(runs: list[bytes], window: int) -> list[np.ndarray]:
    """For each of several distinct byte strings, which of its windows occur again in any of them."""
    between = np.asarray([BETWEEN], dtype=np.uint8)
    parts = [x for run in runs for x in (np.frombuffer(run, dtype=np.uint8), between)]
    data = np.concatenate(parts)
    order = suffix_array(data, window)
    lengths = np.asarray([len(r) for r in runs])
    heads = np.cumsum(lengths + 1) - lengths - 1
    whole = np.zeros(len(data), dtype=bool)
    whole[arrays.ranges(heads, np.maximum(lengths - window + 1, 0))] = True
    order = order[whole[order]]
    shared = common_prefixes(data, order, window) >= window
    again = np.zeros(len(data), dtype=bool)
    again[order[shared]] = True
    again[order[:-1][shared[1:]]] = True
    return [again[h : h + max(n - window + 1, 0)] for h, n in zip(heads.tolist(), lengths.tolist(), strict=True)]


def _runs(piece: arrays.Piece, window: int) -> tuple[np.ndarray, arrays.Runs]:
    prefix = arrays.prefix_hash(piece.bytes, "bytes")
    gram = min(GRAM, window)
    return prefix, arrays.anchored_runs(prefix, "bytes", piece.offsets, window, gram, RUN_WINDOWS)


def _anchors(window: int):
    gram = min(GRAM, window)

    def find(piece: arrays.Piece) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of all runs; one that lies at several places inside a run counts twice, as the run may repeat itself."""
        prefix, runs = _runs(piece, window)
        if not len(runs.anchor):
            return runs.anchor, runs.start
        at = np.arange(len(prefix) - gram, dtype=np.int64)
        hashes = arrays.span_hash(prefix, at, at + gram, "bytes")
        views = np.lib.stride_tricks.sliding_window_view(hashes, window - gram + 1)
        counts = np.ones(len(runs.start), dtype=np.int64)
        for part in np.array_split(np.arange(len(runs.start)), len(runs.start) // 4096 + 1):
            last = runs.start[part] + runs.windows[part] - 1
            left = runs.start[part] + views[runs.start[part]].argmin(axis=1)
            right = last + (window - gram) - views[last][:, ::-1].argmin(axis=1)
            counts[part] += left != right
        return runs.anchor, counts

    return find


_RUN = "anchor long, content long, doc_id long, mark long, start long, windows long, bytes binary"


def _byte_runs(rows: DataFrame, sketch: Broadcast, window: int, frequent: bool) -> DataFrame:
    """The runs whose anchor may repeat, with a hash of their bytes and the bytes."""
    names = [x.split()[0] for x in _RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.pieces(batch.column("text")):
                prefix, runs = _runs(piece, window)
                if not len(runs.anchor):
                    continue
                keep = repeats.marked(sketch.value[0], runs.anchor)
                keep &= repeats.marked(sketch.value[1], runs.anchor) == frequent
                start, windows, text = runs.start[keep], runs.windows[keep], runs.text[keep]
                if not len(start):
                    continue
                end = start + windows + window - 1
                content = arrays.span_hash(prefix, start, end, "bytes")
                data = piece.bytes.tobytes()
                owner = pa.array(text + piece.rows.start)
                columns = [
                    pa.array(runs.anchor[keep].view(np.int64)),
                    pa.array(content.view(np.int64)),
                    batch.column("doc_id").take(owner),
                    batch.column("mark").take(owner),
                    pa.array(start - piece.offsets[text]),
                    pa.array(windows),
                    pa.array([data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, _RUN)


def _blocks(table: pa.Table, keys: np.ndarray, window: int) -> Iterator[pa.Table]:
    """Parts of a table sorted by key, of about BLOCK_BYTES, cut between keys only."""
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
    sizes = np.append(0, np.cumsum(table["windows"].to_numpy() + window))
    first = 0
    for end in ends.tolist():
        if end == len(keys) or sizes[end] - sizes[first] > BLOCK_BYTES:
            yield table.slice(first, end - first)
            first = end


def _in_blocks(runs: DataFrame, key: str, window: int, solve, schema: str) -> DataFrame:
    """Bring the rows of a key together, gather keys into blocks, and apply solve(table) to each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            keys = held[key].to_numpy()
            cut = int(np.flatnonzero(keys == keys[-1])[0])
            if cut and held["windows"].to_numpy()[:cut].sum() + window * cut > BLOCK_BYTES:
                for part in _blocks(held.slice(0, cut), keys[:cut], window):
                    yield from solve(part)
                held = held.slice(cut)
        if held is not None:
            for part in _blocks(held, held[key].to_numpy(), window):
                yield from solve(part)

    return runs.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _stretches(flags: np.ndarray) -> list[list[int]]:
    """First and last-but-one positions of the stretches of true flags."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).reshape(-1, 2).tolist()


def _flags(table: pa.Table, one: np.ndarray, times: np.ndarray, window: int) -> list[np.ndarray]:
    """Which windows of the distinct runs (rows `one`) occur again, given how often each run occurs."""
    windows = table["windows"].to_numpy()[one]
    again = [np.ones(n, dtype=bool) for n in windows]
    _, group, sizes = np.unique(table["anchor"].to_numpy()[one], return_inverse=True, return_counts=True)
    chosen = np.flatnonzero((sizes[group] > 1) | (times == 1))  # a lone run that occurs twice is all repeats
    if len(chosen):
        data = table["bytes"].take(pa.array(one[chosen])).to_pylist()
        for i, flags in zip(chosen.tolist(), repeated_windows(data, window), strict=True):
            if times[i] == 1:
                again[i] = flags
    return again


_SPAN = "doc_id long, mark long, start long, size long"


def _placed(table: pa.Table, found: list[list[list[int]]], window: int) -> Iterator[pa.RecordBatch]:
    """Spans in the texts for the stretches of repeated windows of each row."""
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    if len(owner):
        edges = np.asarray([edge for x in found for edge in x], dtype=np.int64)
        columns = [table[c].combine_chunks().take(pa.array(owner)) for c in ("doc_id", "mark")]
        columns += [pa.array(table["start"].to_numpy()[owner] + edges[:, 0]), pa.array(edges[:, 1] - edges[:, 0] + window - 1)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "start", "size"])


def _spans(runs: DataFrame, window: int) -> DataFrame:
    """Spans of the repeated windows of every run; all runs of an anchor meet."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        _, one, which, times = np.unique(table["content"].to_numpy(), return_index=True, return_inverse=True, return_counts=True)
        found = [_stretches(flags) for flags in _flags(table, one, times, window)]
        yield from _placed(table, [found[i] for i in which.tolist()], window)

    return _in_blocks(runs, "anchor", window, solve, _SPAN)


def _seen(contents: DataFrame, window: int) -> DataFrame:
    """What the blocks of distinct runs tell: spans of repeated windows of runs that occur once (first is null), and each
    distinct window with two hashes, a place, and whether its block repeats it (size is null)."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, times = table.num_rows, table["times"].to_numpy()
        flags = _flags(table, np.arange(rows), times, window)
        found = [_stretches(f) if n == 1 else [] for f, n in zip(flags, times.tolist(), strict=True)]
        for spans in _placed(table, found, window):
            none = [pa.nulls(spans.num_rows, t) for t in (pa.int64(), pa.int64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*spans.columns, *none], names=names)
        windows = table["windows"].to_numpy()
        closed = np.concatenate(flags)
        owner = np.repeat(np.arange(rows), windows)
        at = table["start"].to_numpy()[owner] + arrays.ranges(np.zeros(rows, dtype=np.int64), windows)
        hashes = [_window_hashes(x, window) for x in table["bytes"].to_pylist()]
        first, second = (np.concatenate(x) for x in zip(*hashes, strict=True))
        keep = ~closed  # and one of each repeated window
        _, lead = np.unique(np.stack((first[closed], second[closed])), axis=1, return_index=True)
        keep[np.flatnonzero(closed)[lead]] = True
        columns = [table[c].combine_chunks().take(pa.array(owner[keep])) for c in ("doc_id", "mark")]
        columns += [pa.array(at[keep]), pa.nulls(int(keep.sum()), pa.int64())]
        columns += [pa.array(x[keep].view(np.int64)) for x in (first, second)] + [pa.array(closed[keep])]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = _SPAN + ", first long, second long, closed boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    return _in_blocks(contents, "block", window, solve, schema)


def _window_hashes(data: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(data, dtype=np.uint8)
    at = np.arange(len(values) - window + 1, dtype=np.int64)
    first = arrays.span_hash(arrays.prefix_hash(values, "bytes"), at, at + window, "bytes")
    second = arrays.span_hash(arrays.prefix_hash(values, "words"), at, at + window, "words")
    return first, second


def _frequent_spans(runs: DataFrame, window: int) -> DataFrame:
    """Spans of the runs of frequent anchors.

    Equal runs are counted first. The distinct runs of an anchor are dealt into blocks of about BLOCK_RUNS. A window that
    its block repeats is known to occur again; those that are alone in their block are counted over all blocks.
    """
    runs = durable(runs, "frequent")
    place = F.min(F.struct("doc_id", "mark", "start")).alias("place")
    contents = runs.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("times"), place, F.first("windows").alias("windows"), F.first("bytes").alias("bytes")
    )
    contents = durable(contents.select("anchor", "content", "times", "place.*", "windows", "bytes"), "contents")
    blocks = contents.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / BLOCK_RUNS).alias("blocks"))
    dealt = contents.join(durable(blocks, "blocks"), "anchor")
    dealt = dealt.withColumn("block", F.xxhash64("anchor", F.pmod("content", "blocks")))
    seen = durable(_seen(dealt, window), "seen")
    listed = seen.filter("first is not null")
    several = listed.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("first", "second")
    single = listed.filter(~F.col("closed")).join(durable(several, "several"), ["first", "second"], "left_semi")
    whole = runs.join(contents.filter("times > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    return (
        seen.filter("first is null")
        .select("doc_id", "mark", "start", "size")
        .unionByName(single.select("doc_id", "mark", "start", F.lit(window).cast("long").alias("size")))
        .unionByName(whole.select("doc_id", "mark", "start", (F.col("windows") + window - 1).alias("size")))
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, start, size): byte spans covered by windows that occur more than once; they may overlap."""
    rows = repeats.texts(docs)
    sketch = repeats.anchor_sketch(rows, _anchors(window))
    spans = _spans(_byte_runs(rows, sketch, window, False), window)
    if repeats.any_marked(sketch.value[1]):
        spans = spans.unionByName(_frequent_spans(_byte_runs(rows, sketch, window, True), window))
    return spans


def _kept(rows: DataFrame, spans: bool, keep_text: bool) -> DataFrame:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("spans").to_pylist() if spans else None
            rows: list[tuple] = []
            for piece in arrays.pieces(batch.column("text")):
                drop = np.zeros(len(piece.bytes), dtype=bool)
                if given is not None:
                    own = [(x["start"] + piece.offsets[i], x["size"]) for i, s in enumerate(given[piece.rows]) for x in s or ()]
                    if own:
                        start, size = (np.asarray(x, dtype=np.int64) for x in zip(*own, strict=True))
                        drop = arrays.covered(len(piece.bytes), start, size)
                for i in range(piece.count):
                    at = slice(piece.offsets[i], piece.offsets[i + 1])
                    gone = drop[at]
                    left = piece.bytes[at][~gone].tobytes()
                    heads = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((len(gone), int(gone.sum()), heads, hashlib.sha256(left).hexdigest(), left if keep_text else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of docs; kept holds the bytes left.

    A byte goes if a string of `window` bytes that covers it also starts anywhere else, the same document included. All
    such strings go, the first occurrence too; strings are judged on the input and never reach over the end of a text. A
    null text is empty. Repeated rows count as occurrences of each other. A cut may fall inside a character, so kept is
    binary. Texts below `window` bytes stay whole. Empty table: no rows.
    """
    spans = durable(repeated_spans(docs, window), "spans")
    table = bitmap(spans.select(F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")), "mark").alias("key")).distinct(), "key", DOC_BITS)
    grouped = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    grouped = grouped.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    marked = with_possible(rows, F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")), "mark"), table)
    plain = _kept(marked.filter(~F.col("possible")).select("doc_id", "text"), False, keep_text)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    met = marked.filter("possible").join(grouped, same, "left").select("doc_id", "text", "spans")
    result = plain.unionByName(_kept(met, True, keep_text))
    return result if keep_text else result.drop("kept")
