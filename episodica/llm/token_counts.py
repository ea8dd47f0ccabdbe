"""Token counts of whole texts, huge texts in overlapping chunks that are spliced where both encodings agree.

A text over `chunk` code points is cut into chunks that reach `overlap` code points into their successor. The chunks of one
text go to different tasks, where each is encoded by itself, with the offsets of its tokens. Two neighbours are spliced at
the first position of their overlap that is a token bound in both encodings and *stable*: there the text alone proves
that the encoding of what lies before does not depend on what follows, and the other way round. Where an overlap has no
such position, it is widened to the whole next chunk, and so on: the chunks of a stretch without one become one chunk.

Texts of one chunk are split at their white space, which is stable by the same proof, and every distinct word is encoded
once per worker process.

What is stable is a property of the tokenizer and therefore an argument. `WORD_SEAMS` holds for tokenizers that split off
white space, single digits and runs of letters before merging, such as the one of the registered query: normal forms do
not reach over ASCII white space or digits, and the punctuation named in the pattern ends a run of (caseless or ASCII)
letters; none of these positions lies inside a special string such as <|endoftext|>.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.llm import arrays
from episodica.session import durable

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Bytes of distinct words whose token counts a worker process remembers, over its tasks.
KNOWN_BYTES = 12 << 20
#: Bytes of short texts whose new words are encoded by one call.
CALL_BYTES = 1 << 18

WORD_SEAMS = r"(?=[\x09-\x0D\x20])|(?=[0-9])|(?<=[A-Za-zぁ-ゖァ-ヺ一-龥])(?=[.,;:!?()、。，！？])"

_loaded: dict[str, object] = {}
_known: dict[str, dict[bytes, int]] = {}


def load_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file (of bounded size, some megabytes) as text for all tasks; only the driver needs the path."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _tokenizer(model: Broadcast):
    """The tokenizer of this worker process, which encodes in one thread and neither cuts nor pads."""
    if model.value not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(model.value)
        made.no_truncation()
        made.no_padding()
        _loaded[model.value] = made
    return _loaded[model.value]


def _counts_of(words: list[bytes], model: Broadcast) -> list[int]:
    """Tokens of each word, from one encoding of all of them with white space between."""
    texts = [x.decode("utf-8") for x in words]
    found = _tokenizer(model).encode(" ".join(texts), add_special_tokens=False)
    starts = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found))
    first = np.append(0, np.cumsum([len(x) + 1 for x in texts]))
    return np.diff(np.searchsorted(starts, first)).tolist()


def _short_counts(rows: DataFrame, model: Broadcast) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts that are not cut into chunks.

    ASCII white space is a stable position too, so words are encoded once per worker, apart from the texts they are in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known.setdefault(model.value, {})
        held = sum(map(len, known))
        for batch in batches:
            raw = [b"" if x.as_buffer() is None else x.as_buffer().to_pybytes() for x in batch.column("text")]
            sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            call = np.cumsum(sizes) // CALL_BYTES
            counts = []
            for at in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(call)) + 1):
                words = [raw[i].split() for i in at]
                new = list(set().union(*words).difference(known))
                known.update(zip(new, _counts_of(new, model), strict=True))
                counts += [sum(map(known.__getitem__, own)) for own in words]
                held += sum(map(len, new))
                if held > KNOWN_BYTES:
                    known.clear()
                    held = 0
            columns = [batch.column("doc_id"), pa.array(sizes), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _chunks(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, first, last, final, core, reach): numbered chunks and the code points that follow them; equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                text = text.as_py()
                n = -(-len(text) // chunk)
                for some in range(0, n, 64):
                    at = range(some, min(some + 64, n))
                    columns = [
                        pa.array([key.as_py()] * len(at), pa.string()),
                        pa.array(at, pa.int32()),
                        pa.array([i == n - 1 for i in at], pa.bool_()),
                        pa.array([text[i * chunk : (i + 1) * chunk] for i in at], pa.string()),
                        pa.array([text[(i + 1) * chunk : (i + 1) * chunk + overlap] for i in at], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "first", "final", "core", "reach"])

    cut = huge.select("key", "text").mapInArrow(run, "key string, first int, final boolean, core string, reach string")
    once = cut.groupBy("key", "first").agg(*[F.first(c).alias(c) for c in ("final", "core", "reach")])
    return once.select("key", "first", F.col("first").alias("last"), "final", "core", "reach")


def _encoded(chunks: DataFrame, model: Broadcast, seams: str, chunk: int, overlap: int) -> DataFrame:
    """(key, first, last, final, total, head, tail) per chunk: its tokens, and (position in the text, tokens before it) of the
    stable token bounds in its first code points, which its predecessor reaches too, and in those behind its core."""
    bounds = "array<struct<at:long,before:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stable = regex.compile(seams)
        for batch in batches:
            for row in batch.to_pylist():
                text, origin, end = row["core"] + row["reach"], row["first"] * chunk, len(row["core"])
                found = _tokenizer(model).encode(text, add_special_tokens=False)
                offsets = np.asarray(found.offsets, dtype=np.int64).reshape(-1, 2)
                starts, ends = offsets[:, 0], offsets[:, 1]

                def stable_bounds(low: int, high: int) -> list[dict]:
                    at = np.array([m.start() for m in stable.finditer(text, low, high)], dtype=np.int64)
                    before = np.searchsorted(starts, at)
                    reached = np.where(before > 0, ends[np.maximum(before - 1, 0)] if len(ends) else 0, 0)
                    clear = reached <= at
                    return [{"at": int(p) + origin, "before": int(b)} for p, b in zip(at[clear], before[clear], strict=True)]

                head = stable_bounds(0, min(overlap, end)) if row["first"] else []
                tail = [] if row["final"] else stable_bounds(end, len(text))
                out = {c: [row[c]] for c in ("key", "first", "last", "final")} | {"total": [len(found)], "head": [head], "tail": [tail]}
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    pair = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
    kinds = [("key", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("final", pa.bool_()), ("total", pa.int64())]
    schema = pa.schema([*kinds, ("head", pair), ("tail", pair)])
    return chunks.mapInArrow(run, f"key string, first int, last int, final boolean, total long, head {bounds}, tail {bounds}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """(key, seam, owned): per seam, named by the chunk behind it, the tokens before the splice in the left encoding less
    those before it in the right one; null where the overlap has no common stable bound."""
    left = encoded.filter(~F.col("final")).select("key", (F.col("last") + 1).alias("seam"), "tail")
    right = encoded.filter("first > 0").select("key", F.col("first").alias("seam"), "head")
    common = F.array_min(F.array_intersect(F.col("tail.at"), F.col("head.at")))
    met = left.join(right, ["key", "seam"]).withColumn("at", common)
    index = [F.get(F.filter(c, lambda x: x["at"] == F.col("at")), F.lit(0))["before"] for c in ("tail", "head")]
    return met.select("key", "seam", (index[0] - index[1]).alias("owned"))


def _widened(chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """The chunks on both sides of failed seams, joined into one chunk per stretch of such seams."""
    glued = failed.select("key", F.col("seam").alias("first"), F.lit(0).alias("opens"))
    touched = failed.select("key", (F.col("seam") - 1).alias("first"), F.lit(1).alias("opens")).unionByName(glued)
    touched = touched.groupBy("key", "first").agg(F.min("opens").alias("opens"))
    stretch = F.sum("opens").over(W.partitionBy("key").orderBy("first"))
    parts = chunks.join(touched.select("key", "first", stretch.alias("stretch")), ["key", "first"])
    part = F.struct("first", "last", "final", "core", "reach")
    joined = parts.groupBy("key", "stretch").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    final = F.element_at("parts", -1)
    return joined.select(
        "key",
        F.col("parts")[0]["first"].alias("first"),
        final["last"].alias("last"),
        final["final"].alias("final"),
        F.array_join("parts.core", "").alias("core"),
        final["reach"].alias("reach"),
    )


def _huge_counts(huge: DataFrame, model: Broadcast, seams: str, chunk: int, overlap: int) -> DataFrame:
    """(key, tokens) for every distinct text."""
    chunks = durable(_chunks(huge, chunk, overlap), "chunks")
    encoded = durable(_encoded(chunks, model, seams, chunk, overlap), "encoded")
    spliced = durable(_spliced(encoded), "seams")
    failed = spliced.filter("owned is null")
    if not failed.isEmpty():
        wide = durable(_encoded(_widened(chunks, failed), model, seams, chunk, overlap), "widened")
        gone = wide.select("key", F.explode(F.sequence("first", "last")).alias("first"))
        encoded = durable(encoded.join(gone, ["key", "first"], "left_anti").unionByName(wide), "encoded")
        spliced = durable(_spliced(encoded), "seams")
        if not spliced.filter("owned is null").isEmpty():
            raise ValueError("seams do not agree with the tokenizer: a stable bound depends on its surroundings")
    parts = spliced.select("key", F.col("owned").alias("tokens"))
    parts = parts.unionByName(encoded.filter("final").select("key", F.col("total").alias("tokens")))
    return parts.groupBy("key").agg(F.sum("tokens").alias("tokens"))


def counted(
    docs: DataFrame, tokenizer: str, seams: str = WORD_SEAMS, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs: tokens of the whole text, none of them added.

    tokenizer is the path of a file of the tokenizers library. Special strings in a text count as the library takes them by
    default; nothing is cut or padded. A null text is empty and has no tokens; repeated rows and null ids come out as they
    came in; equal huge texts are encoded once. Empty table: no rows. The result for texts over `chunk` code points is the
    same as without chunks if `seams` and white space are stable for the tokenizer; without a stable position a text is encoded whole.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must be over 0 and at most the chunk")
    spark = docs.sparkSession
    model = load_tokenizer(spark, tokenizer)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.when(F.char_length("text") > chunk, F.sha2("text", 256)))
    counts = _huge_counts(rows.filter("key is not null"), model, seams, chunk, overlap)
    long = rows.filter("key is not null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key").join(counts, "key")
    result = _short_counts(rows.filter("key is null"), model).unionByName(long.select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens")))
    return result.withColumn("over_limit", F.col("n_tokens") > limit)
