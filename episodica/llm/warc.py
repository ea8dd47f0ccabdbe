"""WARC archives with revisit records in place of repeated payloads.

Headers alone are shuffled by payload digest to find the original of every group of equal payloads; revisits are joined to
their originals by digest. The archives are written by Spark's text writer with a record as a row: a record ends with
CRLF CRLF, which is the writer's line separator, so every file is a plain sequence of WARC/1.1 records. Reading takes
whole files and follows the lengths in the headers. Pages go to files by the length of their payload, and the longer the
payloads, the fewer of them share a file, so a file holds FILE_BYTES and headers, or a single longer payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.session import durable, scratch_path

LEAST_BYTES = 1000
RECORDS = 2000
FILE_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes): SHA-1 in lower-case hex and length of the UTF-8 payload."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.sha1(F.encode(_payload(), "UTF-8")).alias("payload_digest"),
        F.octet_length(_payload()).cast("long").alias("payload_bytes"),
    )


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload, of least_bytes or more, has an original elsewhere.

    The original of equal payloads is the largest page_id. Groups are reduced on the map side before the shuffle, and
    only groups of several pages are joined with the headers again.
    """
    long = headers(pages).filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    groups = long.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    groups = durable(groups.filter("least < refers_to").drop("least"), "originals")
    joined = long.select("page_id", "payload_digest").join(groups, "payload_digest").filter("page_id < refers_to")
    return joined.select("page_id", "payload_digest", "refers_to").distinct()


def _record(kind: Column, refers_to: Column, url: Column, page_id: Column, digest: Column, size: Column, payload: Column) -> Column:
    """One record without its final CRLF CRLF."""

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def identity(of: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(of.cast("string"), F.lit("none")), F.lit(">"))

    answer = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    block = F.when(kind == "response", F.concat(answer, payload)).otherwise(answer)
    profile = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", identity(page_id)),
        field("WARC-Date", F.lit(DATE)),
        F.when(url.isNotNull(), field("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", " "))).otherwise(""),
        F.when(kind == "revisit", F.concat(field("WARC-Refers-To", identity(refers_to)), F.lit(profile))).otherwise(""),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        field("WARC-Payload-Length", size.cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def size_classes(file_bytes: int = FILE_BYTES, records: int = RECORDS) -> list[tuple[int | None, int]]:
    """(longest payload, records per file) from short to long: file_bytes hold that many of the longest payloads."""
    classes = [(file_bytes // records if records > 1 else None, records)]
    while classes[-1][1] > 1:
        fewer = max(1, classes[-1][1] // 16)
        classes.append((file_bytes // fewer if fewer > 1 else None, fewer))
    return classes


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records: int = RECORDS, file_bytes: int = FILE_BYTES
) -> None:
    """Write one record per page to path: a response, or a revisit of the original of its payload.

    Rows that repeat a page_id share its record type. A null page_id is always a response. Every class of payload lengths
    that the pages have is a write of its own.
    """
    known = durable(revisits(pages, least_bytes).withColumnRenamed("page_id", "_id"), "revisits")
    same = (F.col("page_id").cast("long") == F.col("_id")) & (F.sha1(F.encode(_payload(), "UTF-8")) == F.col("payload_digest"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), _payload().alias("html")).join(known, same, "left")
    digest, size = F.sha1(F.encode(F.col("html"), "UTF-8")), F.octet_length("html")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    record = _record(kind, F.col("refers_to"), F.col("url"), F.col("page_id").cast("long"), digest, size, F.col("html"))
    classes = size_classes(file_bytes, records)
    bounds = [(F.octet_length(_payload()) > low) & (F.lit(True) if top is None else F.octet_length(_payload()) <= top)
              for low, (top, _) in zip([-1, *[top for top, _ in classes]], classes)]
    found = pages.agg(*[F.coalesce(F.max(b), F.lit(False)) for b in bounds]).first()
    for i, (bound, (_, per_file)) in enumerate(zip(bounds, classes)):
        if found[i] or not any(found) and i == 0:
            writer = rows.filter(bound).select(record.alias("value")).write.option("lineSep", CRLF + CRLF)
            writer.option("maxRecordsPerFile", per_file).option("compression", "none").mode("append").text(path)


def _parse(data: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record of one archive, by the lengths the headers give."""
    whole, at = data.obj, 0
    while at < len(data):
        end = whole.index(b"\r\n\r\n", at)
        version, *lines = whole[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield fields, data[start:stop]
        if whole[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record without end at byte {stop}")
        at = stop + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, stated_digest, stated_bytes, payload_digest, payload_bytes, payload) per record.

    payload, and the digest and length measured from it, are null for revisits.
    """
    names = "page_id url record_type refers_to stated_digest stated_bytes payload_digest payload_bytes payload".split()

    def number(identity: str | None) -> int | None:
        text = (identity or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "none") else None

    def rows(content: bytes) -> Iterator[tuple]:
        for fields, block in _parse(memoryview(content)):
            kind = fields["WARC-Type"]
            payload = bytes(block).split(b"\r\n\r\n", 1)[1] if kind == "response" else None
            measured = (None, None) if payload is None else (hashlib.sha1(payload).hexdigest(), len(payload))
            stated = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
            yield number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields.get("WARC-Refers-To")), *stated, *measured, payload

    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        + [("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("payload_digest", pa.string())]
        + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held = list(zip(*rows(content.as_py()), strict=True))
                if held:
                    arrays = [pa.array(x, schema.field(n).type) for x, n in zip(held, names, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        run,
        "page_id long, url string, record_type string, refers_to long, stated_digest string, stated_bytes long, "
        "payload_digest string, payload_bytes long, payload binary",
    )


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take what was measured on the original."""
    own = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stated_digest")
    own = durable(own, "records")
    known = own.filter("record_type = 'revisit'").select(F.col("refers_to").alias("original"), F.col("stated_digest").alias("digest")).distinct()
    held = own.filter("record_type = 'response'").select(
        F.col("page_id").alias("original"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("held_bytes")
    )
    originals = durable(held.join(known, ["original", "digest"], "left_semi").distinct(), "held")
    found = (F.col("refers_to") == F.col("original")) & (F.col("stated_digest") == F.col("digest"))
    back = own.filter("record_type = 'revisit'").join(originals, found, "left")
    back = back.select("page_id", F.col("held_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return own.filter("record_type = 'response'").drop("stated_digest").unionByName(back)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archive the pages in the shared folder, read the archives back and resolve the revisits; one row per page.

    Null html is an empty payload. Equal payloads under least_bytes stay responses; so do repeated rows of one page and
    rows without page_id. Empty table: no rows.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return resolved(read_archives(pages.sparkSession, path))
