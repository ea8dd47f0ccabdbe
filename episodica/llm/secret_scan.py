"""Secrets in texts, judged by who else has them. DataFrame operations only.

Candidates are found by patterns. The positions of all matches follow from cutting the text at the matches: a match starts
after the pieces and matches before it. Each candidate value is hashed and counted over the whole corpus by distinct
documents (its repositories) and distinct owners (here the source of a document): a value that several owners have, or that
many documents of one owner have, is a copied example; a value in a few documents of one owner looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from episodica.session import durable

#: The kinds in their order, with pattern, group whose length counts, and its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Looser candidates, which count only if they look live: long tokens of mixed case with digits.
LOOSE = (("token", r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}", 0, 24),)
ORDER = [kind for kind, *_ in BASE + LOOSE]
EXAMPLE_OWNERS = 2
EXAMPLE_DOCUMENTS = 10
BLOCK = 128


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _running(sizes: Column) -> Column:
    """Start and end of matches from an array of (gap, size).

    Appending copies what is there, so it is done within blocks of BLOCK matches; blocks are then moved behind each other.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda i: F.slice(sizes, i * BLOCK + 1, BLOCK)
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    within = F.transform(blocks, lambda block: F.aggregate(
        block,
        F.struct(F.lit(0).alias("end"), empty.alias("spans")),
        lambda s, x: F.struct(
            (s["end"] + x["gap"] + x["size"]).alias("end"),
            F.array_append(
                s["spans"], F.struct((s["end"] + x["gap"]).alias("start"), (s["end"] + x["gap"] + x["size"]).alias("end"))
            ).alias("spans"),
        ),
    ))
    offsets = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
    behind = F.aggregate(
        offsets,
        F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("starts")),
        lambda s, n: F.struct((s["upto"] + n).alias("upto"), F.array_append(s["starts"], s["upto"]).alias("starts")),
        lambda s: s["starts"],
    )
    moved = F.zip_with(within, behind, lambda block, by: F.transform(
        block["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"))))
    return F.flatten(moved)


def _spans(kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, kind, rank, value) of the matches of one kind, in code points.

    hex keeps runs of 24 or more only: a run is matched as a whole, so the length can stand in the pattern.
    """
    if group == 0 and pattern.endswith("+"):
        head = 4 if pattern.startswith("AKIA") else 0
        pattern = f"{pattern[:-1]}{{{least - head},}}"
    text = F.col("text")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(
        F.slice(between, 1, F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"))
    )
    # worked out once, then read block by block
    at = F.get(F.transform(F.array(sizes), _running), F.lit(0))
    spans = F.zip_with(
        at,
        counted,
        lambda s, v: F.struct(s["start"].alias("start"), F.lit(ORDER.index(kind)).alias("rank"), s["end"].alias("end"), v.alias("value")),
    )
    spans = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, source, spans) per row of docs: all candidates of all kinds, by start and kind, with the SHA-256 of the value."""
    found = F.concat(*[_spans(*kind) for kind in BASE + LOOSE])
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        _text().alias("text"),
    )
    hashed = F.transform(F.array_sort(found), lambda s: F.struct(s["start"], s["rank"], s["end"], F.sha2(s["value"], 256).alias("hash")))
    return rows.select("doc_id", "source", hashed.alias("spans"))


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_documents: int = EXAMPLE_DOCUMENTS) -> DataFrame:
    """(hash, documents, owners, example) per candidate value over all documents.

    Repeated rows of a document count once; rows without doc_id count as one document. Equal (value, document) and (value,
    owner) are brought together before they are counted, and counts are added up on the map side first, so a value that a
    third of all documents has is a few rows when it meets. Values are never written, only their SHA-256.
    """
    values = found.select("doc_id", "source", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    counts = values.groupBy("hash").agg(
        F.count_distinct(F.struct("doc_id")).alias("documents"), F.count_distinct("source").alias("owners")
    )
    return counts.withColumn("example", (F.col("owners") >= example_owners) | (F.col("documents") >= example_documents))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    text = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"]))
    return F.array_join(text, ",")


def scanned(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_documents: int = EXAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example per row of docs.

    Base spans always count. A loose candidate is added to spans if its value looks live and no base span overlaps it.
    n_live counts the spans whose value fewer than example_owners owners and fewer than example_documents documents have,
    n_example the others. Null text is empty: no spans. Repeated
    rows give equal rows. Empty table: no rows.
    """
    found = durable(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = found.filter(F.size("spans") > 0)
    owned = durable(ownership(some, example_owners, example_documents).select("hash", "example"), "ownership")
    each = some.select("row", F.inline("spans")).join(owned, "hash")
    is_base = F.col("rank") < len(BASE)
    before = W.partitionBy("row").orderBy("start", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    behind = W.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    each = each.withColumn("base_end", F.max(F.when(is_base, F.col("end"))).over(before))
    each = each.withColumn("base_start", F.min(F.when(is_base, F.col("start"))).over(behind))
    clear = (F.coalesce("base_end", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("base_start") >= F.col("end"), F.lit(True))
    judged = each.filter(is_base | (~F.col("example") & clear)).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "example"))).alias("all")
    )
    rows = found.select("doc_id", "row").join(judged, "row", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,example:boolean>>")
    rows = rows.withColumn("all", F.coalesce("all", none))
    rows = rows.withColumn("base", F.filter("all", lambda s: s["rank"] < len(BASE)))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    counts = [count(rank).alias(f"n_{kind}") for rank, (kind, *_) in enumerate(BASE)]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: ~s["example"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: s["example"])).cast("long").alias("n_example"),
    )
