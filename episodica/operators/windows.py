"""Per-key window operators and the group statistics that stand in for windows over huge groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators.joins import interval_join
from episodica.operators.ordered import HOT_ROWS, ordered
from episodica.session import durable


#: Doses are counted in thousandths of their unit.
DOSE_PARTS = 1000


def dose_over_limit(
    admins: DataFrame, eras: DataFrame, limit: float = 5.0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Administrations inside an era at which the running dose of the admission and day exceeds the limit.

    Rows are added one at a time in (time, id) order; equal times do not share a total. Doses are added in whole
    thousandths, so the total does not depend on how the rows of a day are dealt out; a null dose adds nothing.
    """
    spans = eras.select("admission_id", "person_id", "era_start_datetime", "era_end_datetime")
    inside = interval_join(admins, spans, "person_id", "admin_datetime", "era_start_datetime", "era_end_datetime")
    dated = durable(inside.withColumn("admin_date", F.to_date("admin_datetime")), "dated")
    summed = ordered(
        dated,
        ["admission_id", "admin_date"],
        ["admin_datetime", "admin_id"],
        running={"_total": F.coalesce(F.round(F.col("given_dose") * DOSE_PARTS).cast("long"), F.lit(0))},
        hot_rows=hot_rows,
    )
    over = summed.filter(F.col("_total") > F.lit(round(limit * DOSE_PARTS)))
    return over.withColumn("cum_daily_dose", F.col("_total") / F.lit(float(DOSE_PARTS))).drop("_total")


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row with the smallest `order` per group, as an aggregate that is combined before the shuffle."""
    best = F.min_by(F.struct(*keep), F.struct(*order)).alias("_best")
    return df.groupBy(*by).agg(best).select(*by, "_best.*")


def diff_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, out: str = "diff", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Absolute difference from the previous value."""
    linked = ordered(df, keys, order, previous={"_before": col}, hot_rows=hot_rows)
    return linked.withColumn(out, F.abs(F.col(col) - F.col("_before"))).drop("_before")


def zscore(df: DataFrame, col: str, out: str) -> DataFrame:
    """Standardise over the whole column; null where it is constant. The two statistics enter as one scalar subquery."""
    stats = df.agg(F.struct(F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd")).alias("s")).scalar()
    scaled = (F.col(col) - F.col("_s.mean")) / F.nullif(F.col("_s.sd"), F.lit(0.0))
    return df.withColumn("_s", stats).withColumn(out, scaled).drop("_s")


def category_code(df: DataFrame, by: Sequence[str], label: str, out: str = "code") -> DataFrame:
    """Position of a label among the sorted distinct labels of its group, from 1.

    Codes are made on the distinct labels, not on the rows, and joined back.
    """
    from pyspark.sql import Window as W

    labels = df.filter(F.col(label).isNotNull()).select(*by, label).distinct()
    codes = labels.withColumn(out, F.dense_rank().over(W.partitionBy(*by).orderBy(label)))
    return df.join(durable(codes, "codes"), [*by, label], "left")


def min_max_scale(df: DataFrame, by: Sequence[str], col: str, out: str) -> DataFrame:
    """Scale to [0, 1] within each group; null where the group has one value only."""
    ranges = durable(df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")), "ranges")
    width = F.col("_hi") - F.col("_lo")
    scaled = (F.col(col) - F.col("_lo")) / F.when(width != 0, width)
    return df.join(ranges, list(by)).withColumn(out, scaled).drop("_lo", "_hi")


def first_seen(df: DataFrame, by: Sequence[str], scope: Sequence[str], row_id: str, out: str) -> DataFrame:
    """Flag (0/1) the row with the smallest id per (scope, by).

    The smallest ids are found by an aggregate and joined back on (scope, row id), which spreads evenly even when one
    person owns a large share of the rows.
    """
    firsts = df.groupBy(*scope, *by).agg(F.min(row_id).alias(row_id)).select(*scope, row_id).withColumn(out, F.lit(1))
    return df.join(firsts, [*scope, row_id], "left").na.fill(0, [out])


def group_range(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(col).alias("y_min"), F.max(col).alias("y_max"))


def carry_label(df: DataFrame, label: str, seq: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Repeat the last non-null label downwards within `by`. Without `by` all rows go through one task: for finished
    report tables, a few hundred rows in print order."""
    from pyspark.sql import Window as W

    up_to_here = W.partitionBy(*by).orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.last(label, ignorenulls=True).over(up_to_here))
