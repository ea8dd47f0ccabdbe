"""Joins along time and membership joins.

Every time join carries the number of a fixed-width time bucket as an extra equality key. The pairs that Spark has to
look at are then those of one key *in one bucket*, so a key with a very long history is spread over many tasks and is
never multiplied out against itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.timing import bucket, micros, years_before
from episodica.operators.ordered import HOT_ROWS, ordered
from episodica.session import durable


def _spread(
    spans: DataFrame, lo: str, hi: str, width_hours: int, points: DataFrame | None = None, ts: str | None = None
) -> DataFrame:
    """One row per time bucket that a span touches. With points, only buckets between the first and the last of them
    count, so a span that ends in the year 9999 does not become millions of rows."""
    first, last = F.col(lo), F.col(hi)
    if points is not None:
        ends = points.agg(F.struct(F.min(ts).alias("first"), F.max(ts).alias("last")).alias("_ends")).scalar()
        spans = spans.withColumn("_ends", ends)
        first, last = F.greatest(first, F.col("_ends.first")), F.least(last, F.col("_ends.last"))
    buckets = F.sequence(bucket(first, width_hours), bucket(last, width_hours))
    kept = spans.filter((F.col(lo) <= F.col(hi)) & (first <= last))
    return kept.withColumn("_bucket", F.explode(buckets)).drop("_ends")


def interval_join(
    points: DataFrame, spans: DataFrame, key: str, ts: str, lo: str, hi: str, width_hours: int = 120, clip: bool = True
) -> DataFrame:
    """Pairs with equal key and lo <= ts <= hi (closed at both ends).

    Choose width_hours near the usual span length: a span is copied once per bucket it touches. clip=False saves the
    pass that finds the first and last point, where the length of spans is bounded.
    """
    left = points.withColumn("_bucket", bucket(F.col(ts), width_hours))
    right = _spread(spans, lo, hi, width_hours, points if clip else None, ts)
    pairs = left.join(right, [key, "_bucket"])
    return pairs.filter(F.col(ts).between(F.col(lo), F.col(hi))).drop("_bucket")


def _cell(at: Column, bits: Column) -> Column:
    """Number of the cell of 2 ** bits microseconds that holds a time."""
    return F.call_function("shiftright", micros(at), bits)


def dyadic_join(points: DataFrame, spans: DataFrame, key: str, ts: str, lo: str, hi: str) -> DataFrame:
    """Pairs with equal key and lo <= ts <= hi (closed at both ends), for spans of any mix of lengths.

    No width to choose and no pass over the points: a span lies in the one or two cells of the smallest size (1 second,
    times a power of 4) that is longer than itself, and a point is copied once per size that the spans have, at most
    20 times. A point and a span meet in at most one cell, and about an eighth or more of the pairs that meet are results
    where points are spread evenly.
    """
    bits = F.length(F.bin(micros(F.col(hi)) - micros(F.col(lo))))
    sized = spans.filter(F.col(lo) <= F.col(hi)).withColumn("_bits", F.greatest(F.lit(20), bits + bits % 2).cast("int"))
    cells = sized.withColumn("_cell", F.explode(F.sequence(_cell(F.col(lo), F.col("_bits")), _cell(F.col(hi), F.col("_bits")))))
    sizes = sized.agg(F.array_sort(F.collect_set("_bits")).alias("sizes")).scalar()
    copies = points.withColumn("_sizes", sizes).withColumn("_bits", F.explode("_sizes")).drop("_sizes")
    copies = copies.withColumn("_cell", _cell(F.col(ts), F.col("_bits")))
    pairs = copies.join(cells, [key, "_bits", "_cell"])
    return pairs.filter(F.col(ts).between(F.col(lo), F.col(hi))).drop("_bits", "_cell")


def seen_in_span(
    points: DataFrame,
    spans: DataFrame,
    key: str,
    ts: str,
    lo: str,
    hi: str,
    what: Sequence[str],
    keep: Sequence[str],
    width_hours: int,
    spans_cross_buckets: bool = False,
    clip: bool = True,
) -> DataFrame:
    """Distinct (keep, what) such that some point with equal key has lo <= ts <= hi.

    Points are first reduced to the earliest and latest time per (key, what, bucket). A span that touches two or more
    buckets contains the whole of its inner buckets, everything from lo on in its first and everything up to hi in its
    last, so latest >= lo and earliest <= hi decides exactly. Spans inside one bucket need the points themselves; pass
    spans_cross_buckets=True where every span is known to be longer than a bucket.
    """
    what, keep = list(what), list(keep)
    cells = (
        points.withColumn("_bucket", bucket(F.col(ts), width_hours))
        .groupBy(key, "_bucket", *what)
        .agg(F.min(ts).alias("_earliest"), F.max(ts).alias("_latest"))
    )
    columns = list(dict.fromkeys([*keep, key, lo, hi]))
    narrow = spans.select(*columns)
    inside_one = bucket(F.col(lo), width_hours) == bucket(F.col(hi), width_hours)
    long_spans = narrow if spans_cross_buckets else narrow.filter(~inside_one)
    hits = (
        _spread(long_spans, lo, hi, width_hours, points if clip else None, ts)
        .join(cells, [key, "_bucket"])
        .filter((F.col("_latest") >= F.col(lo)) & (F.col("_earliest") <= F.col(hi)))
        .select(*keep, *what)
    )
    if not spans_cross_buckets:
        direct = interval_join(points.select(key, ts, *what), narrow.filter(inside_one), key, ts, lo, hi, width_hours, False)
        hits = hits.unionByName(direct.select(*keep, *what))
    return hits.distinct()


def seen_in_years(
    events: DataFrame,
    anchors: DataFrame,
    key: str,
    day: str,
    anchor_day: str,
    years: int,
    what: Sequence[str],
    keep: Sequence[str],
) -> DataFrame:
    """Distinct (keep, what) such that some event lies within `years` calendar years up to and including anchor_day.

    As seen_in_span, with calendar years as buckets; a look-back of one year or more always touches two of them.
    """
    if years < 1:
        raise ValueError("years must be at least 1")
    what, keep = list(what), list(keep)
    cells = (
        events.withColumn("_year", F.year(day))
        .groupBy(key, "_year", *what)
        .agg(F.min(day).alias("_earliest"), F.max(day).alias("_latest"))
    )
    spans = (
        anchors.withColumn("_since", years_before(F.col(anchor_day), years))
        .withColumn("_year", F.explode(F.sequence(F.year("_since"), F.year(anchor_day))))
        .select(*dict.fromkeys([*keep, key, anchor_day, "_since", "_year"]))
    )
    hits = spans.join(cells, [key, "_year"]).filter(
        (F.col("_latest") >= F.col("_since")) & (F.col("_earliest") <= F.col(anchor_day))
    )
    return hits.select(*keep, *what).distinct()


def lookback_join(anchors: DataFrame, events: DataFrame, key: str, day: str, anchor_day: str, years: int = 5) -> DataFrame:
    """Pairs of an anchor with each event of the same key within `years` calendar years before it, both ends included.

    The pairs are the result; counts and code sets come cheaper from count_in_range, seen_in_years and seen_before.
    """
    dated = events.withColumn("_year", F.year(day))
    spread = anchors.withColumn("_since", years_before(F.col(anchor_day), years)).withColumn(
        "_year", F.explode(F.sequence(F.year("_since"), F.year(anchor_day)))
    )
    pairs = spread.join(dated, [key, "_year"])
    return pairs.filter(F.col(day).between(F.col("_since"), F.col(anchor_day))).drop("_year", "_since")


def seen_before(
    events: DataFrame, anchors: DataFrame, key: str, day: str, anchor_day: str, what: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Distinct (keep, what) such that some event lies strictly before anchor_day: only the first event per
    (key, what) can decide that, so events shrink to one row each before the join."""
    firsts = events.groupBy(key, *what).agg(F.min(day).alias("_earliest"))
    columns = list(dict.fromkeys([*keep, key, anchor_day]))
    hits = anchors.select(*columns).join(firsts, key).filter(F.col("_earliest") < F.col(anchor_day))
    return hits.select(*keep, *what).distinct()


def count_in_range(
    anchors: DataFrame,
    events: DataFrame,
    key: str,
    anchor_id: str,
    lo: Column,
    hi: Column,
    ts: str,
    out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per anchor, the number of events with equal key and lo <= ts <= hi, without forming the pairs.

    Events and both ends of each anchor's range are put on one time line per key; the running event count at the upper
    end minus the one just before the lower end is the answer. Work is linear in events plus anchors. Events at the
    same time are counted together first.
    """
    moment = events.groupBy(key, F.col(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    moment = moment.select(key, "_t", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_id"), "_n")
    none = F.lit(0).cast("long").alias("_n")
    ends = anchors.select(key, lo.alias("_lo"), hi.alias("_hi"), F.col(anchor_id).cast("long").alias("_id"))
    lower = ends.select(key, F.col("_lo").alias("_t"), F.lit(0).alias("_kind"), "_id", none)
    upper = ends.select(key, F.col("_hi").alias("_t"), F.lit(2).alias("_kind"), "_id", none)
    counted = ordered(
        moment.unionByName(lower).unionByName(upper),
        [key],
        ["_t", "_kind", "_id"],
        running={"_seen": F.col("_n")},
        hot_rows=hot_rows,
        count_on=events.select(key).unionByName(anchors.select(key)).unionByName(anchors.select(key)),
    )
    signed = F.when(F.col("_kind") == 2, F.col("_seen")).otherwise(-F.col("_seen"))
    return (
        counted.filter(F.col("_kind") != 1).groupBy(F.col("_id").alias(anchor_id)).agg(F.sum(signed).alias(out))
    )


def visit_diagnoses(visits: DataFrame, diagnoses: DataFrame, visit: str = "visit_id") -> DataFrame:
    """Register visits with their diagnosis codes (visit -> diagnosis bridge)."""
    return visits.join(diagnoses, visit)


def diagnoses_of(anchors: DataFrame, visits: DataFrame, diagnoses: DataFrame, key: str, visit: str = "visit_id") -> DataFrame:
    """Every anchor with all its visits and their diagnoses; anchors without any keep one row of nulls."""
    return anchors.join(visits, key, "left").join(diagnoses, visit, "left")


def restrict_to(df: DataFrame, cohort: DataFrame, key: str, multiplicity: str = "once") -> DataFrame:
    """Rows whose key occurs in the cohort.

    multiplicity='once' is the intended filter. multiplicity='reference' repeats a row once per cohort row of its key,
    as an inner join on an undeduplicated key column does.
    """
    if multiplicity == "once":
        return df.join(cohort.select(key).distinct(), key, "left_semi")
    if multiplicity == "reference":
        copies = cohort.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
        repeated = df.join(copies, key).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        return repeated.select(*df.columns)
    raise ValueError(multiplicity)


def keep_frequent(df: DataFrame, col: str, at_least: int) -> DataFrame:
    """Rows whose value of col occurs in at least that many rows."""
    frequent = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    return df.join(durable(frequent.select(col), "frequent"), col, "left_semi")


def left_features(base: DataFrame, features: DataFrame, on: str, fill: object = 0) -> DataFrame:
    """Left join of a feature table; rows without features get `fill`."""
    added = [c for c in features.columns if c != on]
    return base.join(features, on, "left").na.fill(fill, added)


def mark_seen(df: DataFrame, person: str, in_dev: Column, out: str = "seen") -> DataFrame:
    """Flag rows whose person has at least one row for which in_dev holds."""
    persons = df.filter(in_dev).select(person).distinct().withColumn(out, F.lit(True))
    return df.join(persons, person, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def label_codes(df: DataFrame, col: str, labels: dict[str, str], out: str) -> DataFrame:
    """Code -> label through a dictionary given in the program text, joined as a small table; null for other codes."""
    table = df.sparkSession.createDataFrame(list(labels.items()), "_code string, _label string")
    joined = df.join(table, F.col(col) == F.col("_code"), "left")
    return joined.withColumn(out, F.col("_label")).drop("_code", "_label")


def settings_grid(spark, base: DataFrame | None = None, **axes: Sequence) -> DataFrame:
    """All combinations of the given settings, in order of the arguments; with `base`, of its rows with the settings."""
    grid = spark.range(1).select() if base is None else base
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid
