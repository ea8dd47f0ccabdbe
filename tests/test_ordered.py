"""Sliced windows must give what plain windows give."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from episodica.functions.hashing import digest
from episodica.operators.ordered import hash_ranked, hot_keys, ordered, range_slices, ranked


def rows(n=600, seed=1):
    rng = random.Random(seed)
    # key 0 holds well over a third of the rows
    return [(0 if rng.random() < 0.45 else rng.choice([None, 1, 2, 3, 4]), rng.randrange(200), i, rng.randrange(-5, 6)) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "k int, t long, id long, v long").cache()


def plain(df):
    w = W.partitionBy("k").orderBy("t", "id")
    return df.select(
        "*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("f"),
        F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"))


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("hot_rows", [1, 100, 10_000])
@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_slices_match_plain_window(spark, frame, hot_rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(frame, hot_rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def compare(frame, hot_rows):
    got = ordered(
        frame, ["k"], ["t", "id"], previous={"p": "v"}, following={"f": "v"},
        running={"s": F.col("v")}, hot_rows=hot_rows)
    assert as_set(got) == as_set(plain(frame))


def test_only_hot_keys_are_sliced(frame):
    hot = hot_keys(frame, ["k"], 200)
    assert [r[0] for r in hot.collect()] == [0]
    assert hot_keys(frame, ["k"], 10_000) is None


def test_two_neighbour_columns(frame):
    got = ordered(frame, ["k"], ["t", "id"], previous={"a": "v", "b": "id"}, hot_rows=1)
    w = W.partitionBy("k").orderBy("t", "id")
    want = frame.select("*", F.lag("v").over(w).alias("a"), F.lag("id").over(w).alias("b"))
    assert as_set(got) == as_set(want)


@pytest.mark.parametrize("by", [["k"], []])
def test_ranked_matches_row_number(frame, by):
    got = ranked(frame, by, ["t", "id"], {"rn": F.lit(1), "s": F.col("v")})
    w = W.partitionBy(*by).orderBy("t", "id")
    want = frame.select("*", F.row_number().over(w).alias("rn"), F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    assert as_set(got) == as_set(want)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_ranked_does_not_depend_on_partitions(spark, frame, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = as_set(ranked(frame.repartition(partitions), ["k"], ["t", "id"], {"rn": F.lit(1)}))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == as_set(ranked(frame, ["k"], ["t", "id"], {"rn": F.lit(1)}))


def test_hash_ranked(frame):
    got = hash_ranked(frame, ["k"], "id", 7)
    want = frame.withColumn("d", digest(F.col("id"), 7)).select(
        "k", "t", "id", "v", F.row_number().over(W.partitionBy("k").orderBy("d")).alias("rank"))
    assert as_set(got) == as_set(want)


def test_a_hot_key_is_cut_into_slices_even_at_one_instant(spark):
    """All rows of the hot key share one time: the unique id still lets the range shuffle cut them."""
    rows = [(0, 5, i, 1) for i in range(4000)] + [(1, i, 10_000 + i, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, t long, id long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in range_slices(df.filter("k = 0"), ["k"], ["t", "id"]).groupBy("_slice").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 1600
    out = ordered(df, ["k"], ["t", "id"], running={"s": F.col("v")}, hot_rows=1000)
    assert out.agg(F.max("s")).first()[0] == 4000 and out.filter("s != id + 1 and k = 0").count() == 0
