"""Summary tables and the tuning report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.functions.text import json_choice, parse_number, prettify
from episodica.operators.quantiles import exact_quantiles
from episodica.operators.windows import carry_label, category_code
from episodica.session import durable

# Which rows belong in the short summary table, and the printed names of studies.
IN_TABLE1 = (
    "^n$|^n_|^daily_rate|time_at_risk|^inapp_dose|^admitted|_N02|_J01|_C03|_B01|_A02|n18_diag_any"
    "|chapter_(4|9|14|18|19)|unique_person|sex_female"
)
STUDY_WORDS = [
    ("binary", "Binary"), ("poisson", "Poisson"), ("zip", "ZIP"), ("refmodel", "Ref. model"), ("mlp", "MLP"),
    ("geq", ">="), ("not_zero", "> 0"), ("_", " "),
]


def table_one(
    df: DataFrame, strata: str, categorical: Sequence[str] = (), nonnormal: Sequence[str] = (), normal: Sequence[str] = ()
) -> DataFrame:
    """Stratified summary: (strata, variable, level, n, percent, median, q1, q3, mean, sd).

    Categories give one row per level with count and percent; skewed measures a median with quartiles; others mean
    and standard deviation. Rows are unfolded into (variable, value) and counted before they are shuffled.
    """
    empty = F.lit(None).cast("double")
    totals = durable(df.groupBy(strata).agg(F.count(F.lit(1)).alias("_total")), "totals")
    columns = ["n", "percent", "median", "q1", "q3", "mean", "sd"]

    def shaped(part: DataFrame, **given) -> DataFrame:
        return part.select(strata, "variable", "level", *[given.get(c, empty).cast("double").alias(c) for c in columns])

    parts = [shaped(totals.select(strata, F.lit("n").alias("variable"), F.lit(None).cast("string").alias("level"), "_total"),
                    n=F.col("_total"))]
    if categorical:
        unfolded = df.select(strata, *[F.col(c).cast("string") for c in categorical]).unpivot(
            [strata], list(categorical), "variable", "level"
        )
        counts = unfolded.filter(F.col("level").isNotNull()).groupBy(strata, "variable", "level").agg(F.count(F.lit(1)).alias("_n"))
        known = counts.groupBy(strata, "variable").agg(F.sum("_n").alias("_known"))
        parts.append(
            shaped(counts.join(known, [strata, "variable"]), n=F.col("_n"), percent=100 * F.col("_n") / F.col("_known"))
        )
    if nonnormal:
        unfolded = df.select(strata, *[F.col(c).cast("double") for c in nonnormal]).unpivot(
            [strata], list(nonnormal), "variable", "value"
        )
        quartiles = exact_quantiles(unfolded, [strata, "variable"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
        parts.append(
            shaped(quartiles.withColumn("level", F.lit(None).cast("string")), median=F.col("median"), q1=F.col("q1"), q3=F.col("q3"))
        )
    if normal:
        stats = [
            F.struct(F.lit(c).alias("variable"), F.avg(F.col(c).cast("double")).alias("_m"), F.stddev_samp(F.col(c).cast("double")).alias("_s"))
            for c in normal
        ]
        moments = df.groupBy(strata).agg(F.array(*stats).alias("f")).select(strata, F.inline("f"))
        parts.append(shaped(moments.withColumn("level", F.lit(None).cast("string")), mean=F.col("_m"), sd=F.col("_s")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def print_table(table: DataFrame, strata: str, values: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The summary as printed: one row per variate, one text column per stratum, the short-table mark and print order.

    order lists the variables as they shall follow each other inside a kind; `place` is the row's number. A variable with several levels is printed as a heading followed by indented levels; levels of 0/1 variables are
    shown for 1 only.
    """
    n = F.col("n").cast("long").cast("string")
    cell = (
        F.when(F.col("percent").isNotNull(), F.format_string("%s (%.1f)", n, F.col("percent")))
        .when(F.col("median").isNotNull(), F.format_string("%.1f [%.1f, %.1f]", F.col("median"), F.col("q1"), F.col("q3")))
        .when(F.col("mean").isNotNull(), F.format_string("%.1f (%.1f)", F.col("mean"), F.col("sd")))
        .otherwise(n)
    )
    levels = table.filter(F.col("level").isNotNull()).groupBy("variable").agg(
        F.bool_and(F.col("level").isin("0", "1")).alias("_binary")
    )
    rows = table.join(levels, "variable", "left").withColumn("_binary", F.coalesce("_binary", F.lit(True)))
    shown = rows.filter(F.col("level").isNull() | ~F.col("_binary") | (F.col("level") == "1"))
    text = F.when(F.col("_binary"), F.col("variable")).otherwise(F.concat(F.lit("   "), "level"))
    lines = shown.withColumns({"_text": text, "_cell": cell}).groupBy("variable", "_binary", "level", "_text").pivot(
        strata, list(values)
    ).agg(F.first("_cell"))
    headings = lines.filter(~F.col("_binary")).select("variable").distinct().withColumn("_text", F.col("variable"))
    sheet = lines.unionByName(headings, allowMissingColumns=True).withColumn(
        "_seq", F.concat_ws("|", "variable", F.coalesce("level", F.lit("")))
    )
    labelled = carry_label(sheet.withColumn("_label", F.when(~F.col("_text").startswith("   "), F.col("_text"))), "_label", "_seq", "_under")
    variate = F.when(
        F.col("_text").startswith("   "), F.concat(F.col("_under"), F.lit(": "), F.trim("_text"))
    ).otherwise(F.col("_text"))
    listed = F.array_position(F.array(*[F.lit(v) for v in order]).cast("array<string>"), F.col("variable"))
    out = labelled.filter(F.coalesce(*[F.col(v) for v in values]).isNotNull()).select(
        variate.alias("variate"), *values, F.when(listed > 0, listed).otherwise(len(order) + 1).alias("_at"), "_seq"
    )
    whole = W.orderBy(F.col("in_table1").desc(), "kind", "_at", "_seq")
    return table_order(out).withColumn("place", F.row_number().over(whole)).drop("_at", "_seq")


def table_order(df: DataFrame) -> DataFrame:
    """Mark the rows of the short table and give every row its place: short table first, then by kind of variable."""
    variate = F.col("variate")
    kind = (
        F.when(variate.rlike("atc_level2"), 3)
        .when(variate.rlike("icd10_chapter"), 2)
        .when(variate.rlike("^n$|^r |^inapp_dose|time_at_risk|daily_rate"), 0)
        .otherwise(1)
    )
    return df.withColumns({"in_table1": F.when(variate.rlike(IN_TABLE1), "yes").otherwise("no"), "kind": kind})


def state_counts(trials: DataFrame) -> DataFrame:
    return trials.groupBy("state").agg(F.count(F.lit(1)).alias("n_trials"))


def pretty_study(name):
    """'binary__mlp__daily_rate_geq_1' -> 'Binary MLP (daily rate >= 1)'."""
    parts = F.split(name, "__")
    words = [prettify(F.get(parts, F.lit(i)), STUDY_WORDS) for i in range(3)]
    return F.concat(words[0], F.lit(" "), words[1], F.lit(" ("), words[2], F.lit(")"))


def trial_report(studies: DataFrame, trials: DataFrame, params: DataFrame, values: DataFrame, best: DataFrame) -> DataFrame:
    """One row per trial and parameter: the trial's number, the decoded value, its plotting position, the loss, whether
    it is missing, whether the trial is the best one of its study and whether its loss lies above the third quartile."""
    joined = (
        params.join(trials, "trial_id").join(values, "trial_id", "left").join(studies, "study_id")
        .withColumn("real_param_value", json_choice(F.col("distribution_json"), F.col("param_value")))
        .withColumn("real_param_value_numeric", parse_number(F.col("real_param_value")))
    )
    joined = joined.withColumn(
        "real_param_value_string", F.when(F.col("real_param_value_numeric").isNull(), F.col("real_param_value"))
    )
    kinds = durable(
        joined.groupBy("study_name", "param_name").agg(F.bool_and(F.col("real_param_value_numeric").isNotNull()).alias("is_number")),
        "kinds",
    )
    quartile = durable(exact_quantiles(joined, ["study_name", "param_name"], "value", {"q75": 0.75}), "quartile")
    latest = best.groupBy("study_name").agg(F.max("trial_id").alias("best_trial_id"))
    keys = ["study_name", "param_name"]
    labelled = joined.join(kinds, keys).join(quartile, keys).join(latest, "study_name", "left")
    coded = category_code(
        labelled.withColumn("label", F.when(~F.col("is_number"), F.regexp_replace("real_param_value_string", "_", " "))),
        keys, "label",
    )
    return coded.select(
        "study_name",
        "param_name",
        "trial_id",
        F.col("number").alias("trial_number"),
        "real_param_value",
        F.when(F.col("is_number"), F.col("real_param_value_numeric")).otherwise(F.col("code").cast("double")).alias("y"),
        F.col("value").alias("metric_value"),
        F.col("value").isNull().alias("loss_missing"),
        F.coalesce(F.col("trial_id") == F.col("best_trial_id"), F.lit(False)).alias("is_best"),
        (F.col("value") > F.col("q75")).alias("above_q75"),
    )
