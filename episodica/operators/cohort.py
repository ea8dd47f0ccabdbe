"""Cohort selection: valid measurements, eligible admissions, washout, eras."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.functions.hashing import normal, uniform
from episodica.functions.timing import days_between, hours_between, micros, plus
from episodica.operators.joins import interval_join, seen_in_span
from episodica.operators.ordered import HOT_ROWS, ordered
from episodica.session import durable

DAYS_PER_YEAR = 365.25


def valid_labs(labs: DataFrame, codes: Sequence[str], since: str, until: str) -> DataFrame:
    """Lab rows of the wanted quantities, drawn in the study period, with a value."""
    return labs.filter(
        F.col("code").isin(*codes)
        & F.col("egfr_datetime").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz"))
        & F.col("egfr").isNotNull()
    )


def flag_low(df: DataFrame, col: str, threshold: float = 30.0, out: str = "is_low") -> DataFrame:
    """Flag values at or below the threshold."""
    return df.withColumn(out, F.col(col) <= threshold)


def eligible(
    admissions: DataFrame, persons: DataFrame, since: str, until: str, min_hours: int = 25, min_age: float = 18
) -> DataFrame:
    """Admissions inside the study period, of minimum length, of persons old enough on the admission date."""
    bounded = admissions.filter(
        (F.col("admission_datetime") >= F.lit(since).cast("timestamp_ntz"))
        & (F.col("discharge_datetime") <= F.lit(until).cast("timestamp_ntz"))
        & (F.col("discharge_datetime") >= plus(F.col("admission_datetime"), hours=min_hours))
    )
    age_days = F.datediff(F.to_date("admission_datetime"), F.col("date_of_birth"))
    return bounded.join(persons, "person_id").filter(age_days >= min_age * DAYS_PER_YEAR)


def washout(
    admissions: DataFrame,
    days: float,
    hot_rows: int = HOT_ROWS,
    count_on: DataFrame | None = None,
) -> DataFrame:
    """Keep a person's first admission and those at least `days` after the previous discharge.

    'Previous' is the row before in (admission, discharge, id) order, whether or not that row is kept itself.
    """
    linked = ordered(
        admissions,
        ["person_id"],
        ["admission_datetime", "discharge_datetime", "admission_id"],
        previous={"_left": "discharge_datetime"},
        hot_rows=hot_rows,
        count_on=count_on,
    )
    gap = days_between(F.col("_left"), F.col("admission_datetime"))
    return linked.filter(F.col("_left").isNull() | (gap >= days)).drop("_left")


def hour_distribution(df: DataFrame, ts: str) -> DataFrame:
    """One row describing the hours of valid timestamps: running counts per hour and the kernel bandwidth.

    A timestamp whose second is 1 has no valid hour. Everything is derived from the 24 counts, so nothing larger than
    24 rows meets in one task. The bandwidth is 0.9 * min(sd, IQR / 1.34) * n^(-1/5).
    """
    counts = df.filter(F.second(ts) != 1).groupBy(F.hour(ts).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(
        F.array_sort(F.collect_list(F.struct("h", "n"))).alias("bins"),
        F.sum("n").alias("n"),
        (F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("mean"),
        F.sum(F.col("h") * F.col("h") * F.col("n")).alias("squares"),
    )
    one = one.withColumn(
        "cumulative",
        F.transform(
            "bins",
            lambda b: F.struct(
                b["h"].alias("h"),
                F.aggregate(
                    F.filter("bins", lambda o: o["h"] <= b["h"]), F.lit(0).cast("long"), lambda acc, o: acc + o["n"]
                ).alias("upto"),
            ),
        ),
    )

    def value_at(rank):
        return F.element_at(F.filter("cumulative", lambda c: c["upto"] > rank), 1)["h"]

    def quantile(q):
        at = (F.col("n") - 1) * F.lit(q)
        low = F.floor(at)
        high = F.least(low + 1, F.col("n") - 1)
        return value_at(low) + (at - low) * (value_at(high) - value_at(low))

    sd = F.sqrt((F.col("squares") - F.col("n") * F.col("mean") * F.col("mean")) / F.nullif(F.col("n") - 1, F.lit(0)))
    iqr = (quantile(0.75) - quantile(0.25)) / 1.34
    spread = F.when(F.least(sd, iqr) > 0, F.least(sd, iqr)).when(sd > 0, sd).otherwise(F.lit(1.0))
    return one.select("cumulative", "n", (0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))


def impute_hours(df: DataFrame, ts: str, key: str, seed: int) -> DataFrame:
    """Replace the hour of timestamps whose second is 1 by a draw from the distribution of valid hours plus kernel
    noise, rounded and kept within 0..23. Draws are functions of the row's key."""
    dist = hour_distribution(df, ts).select(F.struct("cumulative", "n", "bw")).scalar()
    with_dist = df.withColumn("_d", dist)
    target = uniform(F.col(key), f"{seed}{ts}h") * F.col("_d.n")
    drawn = F.element_at(F.filter("_d.cumulative", lambda c: c["upto"] > target), 1)["h"]
    noisy = F.bround(drawn + normal(F.col(key), f"{seed}{ts}n") * F.col("_d.bw"))
    hour = F.least(F.lit(23), F.greatest(F.lit(0), noisy.cast("int")))
    moved = plus(F.col(ts), hours=hour - F.hour(ts))
    return with_dist.withColumn(ts, F.when(F.second(ts) == 1, moved).otherwise(F.col(ts))).drop("_d")


def with_low_lab(labs: DataFrame, admissions: DataFrame, threshold: float = 30.0, hours: int = 25) -> DataFrame:
    """Admissions with a low value within the first `hours`."""
    spans = admissions.withColumn("_until", plus(F.col("admission_datetime"), hours=hours))
    low = flag_low(labs, "egfr", threshold).filter("is_low")
    hits = seen_in_span(
        low, spans, "person_id", "egfr_datetime", "admission_datetime", "_until", [], ["admission_id"],
        width_hours=24, spans_cross_buckets=hours >= 24, clip=False,
    )
    return admissions.join(hits, "admission_id", "left_semi")


def cohort(
    labs: DataFrame,
    admissions: DataFrame,
    persons: DataFrame,
    since: str,
    until: str,
    min_hours: int = 25,
    min_age: float = 18,
    washout_days: float = 30,
    threshold: float = 30.0,
    seed: int | None = None,
) -> DataFrame:
    """Eligible admissions after washout with a low value in the first min_hours.

    The index time is fixed before invalid hours are imputed and does not follow them. seed=None leaves hours alone.
    """
    kept = washout(
        eligible(admissions, persons, since, until, min_hours, min_age), washout_days, count_on=admissions
    )
    kept = kept.withColumn("index_datetime", plus(F.col("admission_datetime"), hours=min_hours))
    if seed is not None:
        kept = durable(kept, "eligible")  # read three times: two hour distributions and the rows
        kept = impute_hours(kept, "admission_datetime", "admission_id", seed)
        kept = impute_hours(kept, "discharge_datetime", "admission_id", seed)
    chosen = with_low_lab(labs, kept, threshold, min_hours)
    return chosen.withColumn("los_hours", hours_between(F.col("admission_datetime"), F.col("discharge_datetime")))


def labs_in_follow_up(labs: DataFrame, cohort: DataFrame, fu_days: int = 30) -> DataFrame:
    """Lab rows from admission until fu_days after the index time, one per admission they fall into."""
    spans = cohort.select("admission_id", "person_id", "admission_datetime", "index_datetime", "los_hours").withColumn(
        "_until", plus(F.col("index_datetime"), days=fu_days)
    )
    points = labs.select("person_id", "lab_id", "egfr", "egfr_datetime")
    joined = interval_join(points, spans, "person_id", "egfr_datetime", "admission_datetime", "_until", 240, clip=False)
    return joined.drop("_until")


def run_ids(
    df: DataFrame, by: str, order: Sequence[str], flag: str, out: str = "run_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Number runs of equal flag values within `by`, from 1."""
    linked = ordered(df, [by], order, previous={"_before": flag}, hot_rows=hot_rows)
    starts = F.when(F.col("_before").isNull() | (F.col("_before") != F.col(flag)), 1).otherwise(0)
    return ordered(linked, [by], order, running={out: starts}, hot_rows=hot_rows, count_on=df).drop("_before")


def run_starts(df: DataFrame, by: str, order: Sequence[str], flag: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first row of every run: all that an era needs, found without numbering and regrouping the rows."""
    linked = ordered(df, [by], order, previous={"_before": flag}, hot_rows=hot_rows)
    return linked.filter(F.col("_before").isNull() | (F.col("_before") != F.col(flag))).drop("_before")


def derive_eras(
    labs: DataFrame, cohort: DataFrame, threshold: float = 30.0, fu_days: int = 30, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Eras of equal low / not-low state per admission.

    An era lasts until one second before the next one; the last ends at index + min(stay - 24 h, follow-up). Eras
    starting after index + stay are dropped and all ends are capped at index + min(stay, follow-up).
    Ties in time are ordered by value, then by id.
    """
    seen = durable(flag_low(labs_in_follow_up(labs, cohort, fu_days), "egfr", threshold, "egfr_is_low"), "seen")
    starts = run_starts(
        seen, "admission_id", ["egfr_datetime", "egfr", "lab_id"], "egfr_is_low", hot_rows
    ).select(
        "admission_id", "person_id", "egfr_is_low", "los_hours", "index_datetime", "egfr", "lab_id",
        F.col("egfr_datetime").alias("era_start_datetime"),
    )
    linked = ordered(
        starts,
        ["admission_id"],
        ["era_start_datetime", "egfr", "lab_id"],
        following={"_next": "era_start_datetime"},
        hot_rows=hot_rows,
        count_on=seen,
    )
    return era_bounds(linked, fu_days).drop("_next", "egfr", "lab_id")


def era_bounds(eras: DataFrame, fu_days: int = 30) -> DataFrame:
    """Close eras that carry the start of the following one in _next."""
    index, stay = F.col("index_datetime"), F.col("los_hours").cast("int")
    last_end = plus(index, hours=F.least(stay - 24, F.lit(24 * fu_days)))
    stay_end = plus(index, hours=stay)
    end = F.coalesce(plus(F.col("_next"), seconds=-1), last_end)
    return eras.filter(F.col("era_start_datetime") <= stay_end).withColumn(
        "era_end_datetime", F.least(end, stay_end, plus(index, days=fu_days))
    )


def era_seconds(df: DataFrame) -> DataFrame:
    """Length of each era in microseconds, exact."""
    return df.withColumn("micros", micros(F.col("era_end_datetime")) - micros(F.col("era_start_datetime")))
