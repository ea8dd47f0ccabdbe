"""Unions, one-hot tables, data sets and their normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.text import rate_flag
from episodica.functions.timing import age_years, cyclic_hour, weekday
from episodica.operators.filters import cast_cols, feature_columns
from episodica.operators.joins import left_features

def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_fill(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack by name; a column missing on one side is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def union_with_label(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Stack named frames with a column that tells them apart."""
    return union_all(*[df.withColumn(label, F.lit(name)) for name, df in frames.items()])


def vocabulary(df: DataFrame, col: str) -> list:
    """Sorted distinct values of a category that is to become columns: the names of a table's columns.

    A category with very many values belongs in a long table; pass pinned values to choose the columns.
    """
    return sorted(r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().collect())


def pivot_fill(df: DataFrame, by: str, key: str, value: str, names: Sequence | None = None) -> DataFrame:
    """Long to wide, summing, with 0 where there is nothing."""
    names = vocabulary(df, key) if names is None else list(names)
    return df.groupBy(by).pivot(key, names).agg(F.sum(value)).na.fill(0)


def one_hot(df: DataFrame, by: str, col: str, prefix: str, values: Sequence | None = None) -> DataFrame:
    """One row per `by` with a 0/1 column per category value. Pass the values of the development set to pin columns."""
    values = vocabulary(df, col) if values is None else list(values)
    return df.groupBy(by).agg(
        *[F.max(F.when(F.col(col) == v, 1).otherwise(0)).alias(f"{prefix}{v}") for v in values]
    )


def flags(value: Column, prefix: str, values: Sequence) -> list[Column]:
    """One-hot columns for a category with exactly one value per row: a projection, no grouping."""
    return [F.coalesce((value == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values]


def left_one_hot(
    base: DataFrame, df: DataFrame, col: str, prefix: str, by: str = "admission_id", values: Sequence | None = None
) -> DataFrame:
    return left_features(base, one_hot(df, by, col, prefix, values), by)


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, name="feature", value="feature_value"):
    """Wide to long; columns are read as doubles."""
    values = [c for c in df.columns if c not in set(ids)] if values is None else list(values)
    return cast_cols(df, values, "double").unpivot(list(ids), values, name, value)


def base_features(cohort: DataFrame) -> DataFrame:
    """Features known from the admission itself."""
    admitted = F.col("admission_datetime")
    # fixed values: weekday and sex categories
    return cohort.select(
        "admission_id",
        "person_id",
        "index_datetime",
        age_years(F.col("date_of_birth"), F.to_date(admitted)).alias("age_at_admission"),
        cyclic_hour(admitted).alias("hour_of_admission_cyclical"),
        *flags(weekday(admitted), "admitted_", ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]),
        *flags(F.lower("sex"), "sex_", ["female", "male"]),
    )


def build_dataset(
    outcome: DataFrame,
    cohort: DataFrame,
    single: Sequence[DataFrame],
    categories: Sequence[tuple[DataFrame, str, str, Sequence | None]],
    rates: Sequence[int] = (1, 2, 3, 5),
) -> DataFrame:
    """Outcomes joined with all features, one row per admission.

    single: feature tables with one row per admission; categories: (long table, column, prefix, pinned values or None).
    Everything is keyed by admission_id, so the joins share one partitioning; one projection at the end fills the gaps,
    casts and adds the labels.
    """
    base = base_features(cohort)
    tables = [*single, *[one_hot(t, "admission_id", col, prefix, values) for t, col, prefix, values in categories]]
    drug_counts = [c for c in outcome.columns if c.startswith("r_")]
    df = outcome.drop(*drug_counts).join(base, "admission_id")
    for table in tables:
        df = df.join(table, "admission_id", "left")
    as_they_are = ["admission_id", "person_id", "index_datetime", "time_at_risk", "age_at_admission"]
    added = [c for c in df.columns if c not in as_they_are]
    r, t = F.col("r"), F.col("time_at_risk")
    labels = [(r > 0).cast("int").alias("daily_rate_not_zero"), *[rate_flag(r, t, k).alias(f"daily_rate_geq_{k}") for k in rates]]
    filled = [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in added]
    return df.select(*as_they_are, *filled, *labels)


def temporal_split(df: DataFrame, ts: str, cutoff: str, person: str, out: str = "set") -> DataFrame:
    """'dev' before the cutoff date; later rows are 'test_new' for persons without any dev row, else 'test_seen'."""
    is_dev = F.to_date(ts) < F.lit(cutoff).cast("date")
    dev_persons = df.filter(is_dev).select(person).distinct().withColumn("_in_dev", F.lit(True))
    name = F.when(is_dev, "dev").when(F.col("_in_dev").isNull(), "test_new").otherwise("test_seen")
    return df.join(dev_persons, person, "left").withColumn(out, name).drop("_in_dev")


def data_sets(df: DataFrame) -> dict[str, DataFrame]:
    """dev, test and test_new; test contains test_new."""
    return {
        "dev": df.filter(F.col("set") == "dev").drop("set"),
        "test": df.filter(F.col("set").isin("test_seen", "test_new")).drop("set"),
        "test_new": df.filter(F.col("set") == "test_new").drop("set"),
    }


def fit_norm(dev: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean and sample standard deviation per feature; null for features that are 0/1 throughout.

    One aggregate row over all features, turned into one row per feature afterwards.
    """
    cols = feature_columns(dev) if cols is None else list(cols)
    stats = []
    for c in cols:
        binary = F.bool_and(F.coalesce(F.col(c).isin(0, 1), F.lit(False)))
        x = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("feature_name"),
                F.when(~binary, F.avg(x)).alias("centre"),
                F.when(~binary, F.stddev_samp(x)).alias("scale"),
            )
        )
    return dev.agg(F.array(*stats).alias("f")).select(F.inline("f"))


def norm_factors(factors: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """The fitted factors as a dictionary: one entry per feature column."""
    return {r["feature_name"]: (r["centre"], r["scale"]) for r in factors.collect()}


def normalise(df: DataFrame, factors: DataFrame) -> DataFrame:
    """z-scores with stored factors; features without factors pass through, a constant one becomes null."""
    found = norm_factors(factors)
    return df.withColumns(
        {
            c: (F.col(c) - F.lit(found[c][0])) / F.lit(found[c][1] or None).cast("double")
            for c in df.columns
            if c in found and found[c][0] is not None and found[c][1] is not None
        }
    )


def _denormalised(value: Column, centre: Column, scale: Column) -> Column:
    return F.when(centre.isNull() | scale.isNull(), value).otherwise(F.bround(value * scale + centre, 8))


def denormalise(df: DataFrame, factors: DataFrame) -> DataFrame:
    """Original scale, rounded to 8 places."""
    found = norm_factors(factors)
    return df.withColumns(
        {
            c: _denormalised(F.col(c), F.lit(found[c][0]).cast("double"), F.lit(found[c][1]).cast("double"))
            for c in df.columns
            if c in found
        }
    )


def denormalise_long(df: DataFrame, factors: DataFrame, name: str = "feature", value: str = "feature_value") -> DataFrame:
    """The same for (feature, value) rows. The factor table has one row per feature column and is broadcast."""
    lookup = F.broadcast(factors.withColumnRenamed("feature_name", name))
    joined = df.join(lookup, name, "left")
    return joined.withColumn(value, _denormalised(F.col(value), F.col("centre"), F.col("scale"))).drop("centre", "scale")
