"""Exact quantiles and equal-count bins of columns of any length."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators.ordered import ranked
from episodica.session import durable


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Quantiles with linear interpolation between order statistics, one row per group.

    Rows are first counted per distinct value; running counts over the values then tell which value holds each wanted
    rank. Nothing but those values leaves the executors, unlike an aggregate that gathers a group's values in a buffer.
    """
    by = list(by)
    counted = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranked(counted, by, ["_v"], {"_upto": F.col("_n")}, {"_total": "_upto"})
    aggregates = []
    for name, q in quantiles.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        low = F.floor(at)
        high = F.least(low + 1, F.col("_total") - 1)

        def value_at(rank):
            here = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))
            return F.max(F.when(here, F.col("_v")))

        aggregates.append(value_at(low).alias(f"_low_{name}"))
        aggregates.append(value_at(high).alias(f"_high_{name}"))
        aggregates.append(F.max(at - low).alias(f"_part_{name}"))
    found = placed.groupBy(*by).agg(*aggregates)
    return found.select(
        *by,
        *[
            (F.col(f"_low_{n}") + F.col(f"_part_{n}") * (F.col(f"_high_{n}") - F.col(f"_low_{n}"))).alias(n)
            for n in quantiles
        ],
    )


def trim_upper(df: DataFrame, by: Sequence[str], col: str, q: float = 0.999) -> DataFrame:
    """Drop values above the q-quantile of their group, or of the whole column without groups. The cut table is written
    first, so the planner sees its true size and broadcasts it only when small."""
    cuts = durable(exact_quantiles(df, by, col, {"_cut": q}), "cuts")
    if not by:
        return df.filter(F.col(col) <= cuts.select("_cut").scalar())
    return df.join(cuts, list(by)).filter(F.col(col) <= F.col("_cut")).drop("_cut")


def distinct_values(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Smallest and largest value and the number of distinct values per group, through one row per value."""
    values = df.select(*by, col).filter(F.col(col).isNotNull()).distinct()
    stats = values.groupBy(*by).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(F.lit(1)).alias("n_values"))
    return durable(stats, "values")


def ntile_by(
    df: DataFrame, by: Sequence[str], col: str, tie: str, n: int, out: str = "bin", cap: str | None = None
) -> DataFrame:
    """Equal-count bins 1..n within `by`, ties in col broken by the unique column `tie`.

    The first (rows mod n) bins get one row more. cap names a column, constant per group, that lowers n; the number of
    distinct values of the group (see distinct_values) makes n depend on the data.

    Ranks are made on one row per distinct value. A value whose rows all fall into one bin takes its rows there by a join;
    only the rows of values on the border of two bins, at most n - 1 values per group, are ranked themselves.
    """
    by = list(by)
    values = df.groupBy(*by, col, *([] if cap is None else [cap])).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranked(values, by, [col], {"_upto": F.col("_n")}, {"_rows": "_upto"})
    bins = F.lit(n).cast("long") if cap is None else F.least(F.col(cap), F.lit(n).cast("long"))
    placed = placed.withColumn("_more", F.col("_rows") % bins)
    placed = placed.withColumn("_size", ((F.col("_rows") - F.col("_more")) / bins).cast("long"))

    def bin_of(rank: Column) -> Column:
        more, size = F.col("_more"), F.col("_size")
        after = more + F.ceil((rank - more * (size + 1)) / F.when(size > 0, size))
        return F.when(rank <= more * (size + 1), F.ceil(rank / (size + 1))).otherwise(after).cast("long")

    before = (F.col("_upto") - F.col("_n")).alias("_before")
    borders = [bin_of(F.col("_upto") - F.col("_n") + 1).alias("_first"), bin_of(F.col("_upto")).alias("_last")]
    table = durable(placed.select(F.struct(*by, col).alias("_value"), before, "_more", "_size", *borders), "bins")
    rows = df.withColumn("_value", F.struct(*by, col)).join(table, "_value")
    inside = rows.filter(F.col("_first") == F.col("_last")).select(*df.columns, F.col("_first").alias(out))
    if table.filter(F.col("_first") < F.col("_last")).isEmpty():
        return inside
    border = ranked(rows.filter(F.col("_first") < F.col("_last")), ["_value"], [tie], {"_at": F.lit(1)})
    return inside.unionByName(border.select(*df.columns, bin_of(F.col("_before") + F.col("_at")).alias(out)))
