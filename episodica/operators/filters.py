"""Row filters and column selection."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns that are not features, and the reference-model subset of features.
OUTCOMES = [
    "daily_rate_not_zero", "daily_rate_geq_1", "daily_rate_geq_2", "daily_rate_geq_3", "daily_rate_geq_5",
]
NOT_FEATURES = ["set", "admission_id", "person_id", "r", "time_at_risk", *OUTCOMES]
FEATURE_SUBSETS = {
    "refmodel": [
        "atc_level2_A10", "atc_level2_N02", "age_at_admission", "n18_diag_N181", "n18_diag_N182", "n18_diag_N183",
        "n18_diag_N184", "n18_diag_N185", "n18_diag_N189",
    ]
}


def exclude_regex(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Drop rows matching the pattern; a null does not match and stays."""
    return df.filter(~F.coalesce(F.col(col).rlike(pattern), F.lit(False)))


def completed(df: DataFrame, col: str = "admin_status", status: int = 7) -> DataFrame:
    return df.filter(F.col(col) == status)


def starts_with_any(df: DataFrame, col: str, prefixes: Sequence[str]) -> DataFrame:
    """Written as startsWith tests joined by OR, which reach the parquet scan; a regular expression would not."""
    test = F.lit(False)
    for prefix in prefixes:
        test = test | F.col(col).startswith(prefix)
    return df.filter(test)


def positive_dose(df: DataFrame, dose: str = "given_dose", unit: str = "given_dose_unit") -> DataFrame:
    return df.filter(F.col(dose).isNotNull() & F.col(unit).isNotNull() & (F.col(dose) > 0))


def code_like(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.filter(F.col(col).like(pattern))


def categorise(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """First matching condition wins."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def select_like(df: DataFrame, pattern: str, also: Iterable[str] = ()) -> DataFrame:
    return df.select(*also, *[c for c in columns_like(df, pattern) if c not in set(also)])


def drop_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*columns_like(df, pattern))


def feature_columns(df: DataFrame, subset: str | None = None) -> list[str]:
    """Feature columns, or those of a named subset that exist. Unknown subset names mean all features."""
    wanted = FEATURE_SUBSETS.get(subset) if subset else None
    if wanted is not None:
        return [c for c in df.columns if c in set(wanted)]
    return [c for c in df.columns if c not in set(NOT_FEATURES)]


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop columns without any value: one aggregate over the data returns one row of counts."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(0, list(cols) if cols is not None else None)


def rename_with(df: DataFrame, pattern: str, fn: Callable[[str], str]) -> DataFrame:
    return df.withColumnsRenamed({c: fn(c) for c in columns_like(df, pattern)})


def cast_cols(df: DataFrame, cols: Sequence[str], dtype: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(dtype) for c in cols})


def row_max(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """Largest value among columns sharing a prefix."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.withColumn(out, F.greatest(*cols) if len(cols) > 1 else F.col(cols[0]))


def tag(df: DataFrame, source: str, cols: Sequence[str]) -> DataFrame:
    """Add the source name and keep the final columns."""
    return df.withColumn("source", F.lit(source)).select(*cols)


def results_of(
    df: DataFrame, study: str | None = None, dataset: str | None = None, pred_type: str | None = "crude",
    not_study: str | None = None,
) -> DataFrame:
    """Result rows of one study / data set / prediction type; study names matching not_study are left out."""
    for col, value in (("study_name", study), ("dataset", dataset), ("pred_type", pred_type)):
        if value is not None:
            df = df.filter(F.col(col) == value)
    return df if not_study is None else exclude_regex(df, "study_name", not_study)
