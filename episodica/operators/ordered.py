"""Window operations that keep working when one group holds a large part of all rows.

A window over partitionBy(key) puts a whole key into one task. Here the rows of hot keys are range-shuffled by (key,
order) instead, which cuts every hot key into even slices that follow the order; functions run inside (key, slice), and
what crosses a slice border (the row before, the row after, the running total) comes from one summary row per slice.
Keys that are not hot keep the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from episodica.functions.hashing import digest
from episodica.session import durable

HOT_ROWS = 5_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with at least hot_rows rows, or None if there are none.

    One counting pass over the key columns; the driver learns only whether a hot key exists. There can be at most
    rows/hot_rows of them, which is what bounds the broadcasts in `ordered`.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") >= hot_rows).select(*keys)
    return None if hot.isEmpty() else durable(hot, "hot")


def _same_keys(keys: Sequence[str]) -> Column:
    matched = F.lit(True)
    for k in keys:
        matched = matched & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    return matched


def range_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add _slice: the number of the row's partition after a range shuffle by (keys, order).

    Spark samples the data to make the partitions even, whatever the values look like; (keys, order) should be unique,
    so that ties can be cut too. The result is written to the shared folder, because slice numbers must not change
    between the rows and their summary.
    """
    sliced = df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id().cast("long"))
    return durable(sliced, "sliced")


def plain(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, str],
    following: Mapping[str, str],
    running: Mapping[str, Column],
) -> DataFrame:
    """The same functions over one window per key."""
    window = W.partitionBy(*keys).orderBy(*order)
    rows = window.rowsBetween(W.unboundedPreceding, W.currentRow)
    added = {out: F.lag(src).over(window) for out, src in previous.items()}
    added |= {out: F.lead(src).over(window) for out, src in following.items()}
    added |= {out: F.sum(expr).over(rows) for out, expr in running.items()}
    return df.withColumns(added)


def over_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    running: Mapping[str, Column] | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """lag, lead and running sums over `keys` ordered by `order`, for df that already carries _slice.

    previous / following map an output name to the column whose neighbouring value it takes; running maps an output
    name to the expression summed up to and including the row (ROWS semantics). totals maps an output name to the
    running sum whose final value per key it takes; that needs every row to have a slice.

    The keys are packed into one struct, which compares null as equal to null, so the window and the join with the
    slice summary share one hash partitioning: the rows are shuffled once.
    """
    previous, following, running, totals = previous or {}, following or {}, running or {}, totals or {}
    packed = df.withColumn("_key", F.struct(*keys))
    inside = W.partitionBy("_key", "_slice").orderBy(*order)
    up_to_here = inside.rowsBetween(W.unboundedPreceding, W.currentRow)

    position = F.struct(*order)
    summaries = [F.sum(expr).alias(f"_sum_{name}") for name, expr in running.items()]
    if previous:
        summaries.append(F.max_by(F.struct(*dict.fromkeys(previous.values())), position).alias("_tail"))
    if following:
        summaries.append(F.min_by(F.struct(*dict.fromkeys(following.values())), position).alias("_head"))
    per_slice = packed.filter(F.col("_slice").isNotNull()).groupBy("_key", "_slice").agg(*summaries)
    whole = W.partitionBy("_key")
    across = whole.orderBy("_slice")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.sum(f"_sum_{name}").over(before).alias(f"_off_{name}") for name in running]
    carried += [F.sum(f"_sum_{name}").over(whole).alias(f"_tot_{out}") for out, name in totals.items()]
    if previous:
        carried.append(F.lag("_tail").over(across).alias("_tail"))
    if following:
        carried.append(F.lead("_head").over(across).alias("_head"))
    border = per_slice.select("_key", "_slice", *carried)

    inner = {}
    if previous:
        inner["_first"] = F.row_number().over(inside) == 1
        inner |= {f"_p_{out}": F.lag(src).over(inside) for out, src in previous.items()}
    if following:
        inner["_last"] = F.lead(F.lit(True)).over(inside).isNull()
        inner |= {f"_f_{out}": F.lead(src).over(inside) for out, src in following.items()}
    inner |= {f"_r_{out}": F.sum(expr).over(up_to_here) for out, expr in running.items()}
    joined = packed.withColumns(inner).join(border, ["_key", "_slice"], "left")

    result = {
        out: F.when(F.col("_first"), F.col(f"_tail.{src}")).otherwise(F.col(f"_p_{out}"))
        for out, src in previous.items()
    }
    result |= {
        out: F.when(F.col("_last"), F.col(f"_head.{src}")).otherwise(F.col(f"_f_{out}"))
        for out, src in following.items()
    }
    result |= {out: F.col(f"_r_{out}") + F.coalesce(F.col(f"_off_{out}"), F.lit(0)) for out in running}
    result |= {out: F.col(f"_tot_{out}") for out in totals}
    kept = [F.col(c) for c in df.columns if c != "_slice"]
    return joined.select(*kept, *[expr.alias(out) for out, expr in result.items()])


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    running: Mapping[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
    count_on: DataFrame | None = None,
) -> DataFrame:
    """lag / lead / running sum per key; (keys, order) should be unique.

    Without hot keys this is the plain window. count_on names a cheaper frame to look for hot keys in: one with the
    same key columns and at least as many rows per key, such as the table that df was filtered from.
    """
    previous, following, running = previous or {}, following or {}, running or {}
    hot = hot_keys(df if count_on is None else count_on, keys, hot_rows)
    if hot is None:
        return plain(df, keys, order, previous, following, running)
    listed = F.broadcast(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    rest = plain(df.join(listed, _same_keys(keys), "left_anti"), keys, order, previous, following, running)
    sliced = range_slices(df.join(listed, _same_keys(keys), "left_semi"), keys, order)
    return rest.unionByName(over_slices(sliced, keys, order, previous, following, running))


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    running: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running sums over a total order for the few, huge groups of reports (study, data set, feature), and, by name of
    the running sum, their totals per group. Every group is treated as hot."""
    sliced = range_slices(df, by, order)
    if by:
        return over_slices(sliced, by, order, running=running, totals=totals)
    return over_slices(sliced.withColumn("_all", F.lit(0)), ["_all"], order, running=running, totals=totals).drop("_all")


def hash_ranked(df: DataFrame, by: Sequence[str], key: str, seed: object, out: str = "rank") -> DataFrame:
    """Position of each row (from 1) inside `by` in the order of md5(key|seed); key must be unique.

    The leading hex digits of the digest are evenly spread and follow the order, so they serve as slices.
    """
    tagged = df.withColumn("_digest", digest(F.col(key), seed)).withColumn(
        "_slice", F.conv(F.substring("_digest", 1, 5), 16, 10).cast("long")
    )
    if by:
        return over_slices(tagged, by, ["_digest"], running={out: F.lit(1)}).drop("_digest")
    whole = over_slices(tagged.withColumn("_all", F.lit(0)), ["_all"], ["_digest"], running={out: F.lit(1)})
    return whole.drop("_digest", "_all")
