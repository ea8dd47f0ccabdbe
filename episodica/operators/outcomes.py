"""Time at risk and counts of inappropriate administrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.functions.timing import days_between
from episodica.operators.joins import interval_join
from episodica.operators.ordered import HOT_ROWS
from episodica.operators.windows import dose_over_limit


def time_at_risk(eras: DataFrame, cap: float = 30.0) -> DataFrame:
    """Days spent in low eras per admission, at most `cap`."""
    days = F.sum(days_between(F.col("era_start_datetime"), F.col("era_end_datetime")))
    return eras.filter("egfr_is_low").groupBy("admission_id").agg(F.least(F.lit(float(cap)), days).alias("time_at_risk"))


def era_counts(admins: DataFrame, eras: DataFrame) -> DataFrame:
    """Administrations per admission and drug that fall inside an era."""
    spans = eras.select("admission_id", "person_id", "era_start_datetime", "era_end_datetime")
    inside = interval_join(admins, spans, "person_id", "admin_datetime", "era_start_datetime", "era_end_datetime")
    return inside.groupBy("admission_id", "atc").agg(F.count(F.lit(1)).alias("r"))


def with_total(counts: DataFrame, label: str = "r") -> DataFrame:
    """Counts per (admission, drug) plus one total row per admission, by grouping sets."""
    both = counts.groupingSets(
        [[F.col("admission_id"), F.col("atc")], [F.col("admission_id")]], F.col("admission_id"), F.col("atc")
    ).agg(F.sum("r").alias("r"), F.grouping("atc").alias("_is_total"))
    name = F.when(F.col("_is_total") == 1, F.lit(label)).otherwise(F.concat(F.lit("r_"), F.lower("atc")))
    return both.select("admission_id", name.alias("atc"), "r")


def inappropriate_counts(
    admins: DataFrame, eras: DataFrame, limited: str, limit: float = 5.0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Counts per (admission, drug) in low eras: for the drug with a daily limit only the administrations above it,
    for all other target drugs every administration."""
    low = eras.filter("egfr_is_low")
    is_limited = F.col("atc").startswith(limited)
    over = dose_over_limit(admins.filter(is_limited), low, limit, hot_rows)
    over = over.groupBy("admission_id", "atc").agg(F.count(F.lit(1)).alias("r"))
    return era_counts(admins.filter(~is_limited), low).unionByName(over)


def outcomes(
    eras: DataFrame, admins: DataFrame, drugs: Sequence[str], limited: str, limit: float = 5.0, cap: float = 30.0
) -> DataFrame:
    """One row per admission with time at risk: r per drug, the total r, and the time. `drugs` fixes the columns."""
    names = ["r", *[f"r_{d.lower()}" for d in drugs]]
    wide = (
        with_total(inappropriate_counts(admins, eras, limited, limit))
        .groupBy("admission_id")
        .pivot("atc", names)
        .agg(F.sum("r"))
    )
    return wide.join(time_at_risk(eras, cap), "admission_id", "right").na.fill(0, names)
