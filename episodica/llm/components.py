"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.session import durable


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour b of each a, written, so that the join with the edges can split a node with very many."""
    return durable(edges.groupBy("a").agg(F.min("b").alias("m")), "stars")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that can be reached.

    Nodes are longs; loops, repeated edges and either direction are allowed, null ends are ignored. Each round costs a few
    aggregations and joins over the edges, whose number never grows; the number of rounds grows with the logarithm of the
    longest path. Every round is written to the shared folder, which cuts the lineage. Only two numbers per round reach
    the driver. No edges: no rows.
    """
    edges = durable(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_least(both), "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
            .distinct()
        )
        large = durable(large, "edges")
        small = large.join(_least(large), "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        )
        small = small.select("col.a", "col.b").filter(F.col("a") != F.col("b")).distinct()
        edges = durable(small, "edges")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
