"""Look-back features of cohort admissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.text import FULL_ATC, atc_level2, ckd_stage, code_part, strip_chars
from episodica.functions.timing import years_before
from episodica.operators.joins import (
    count_in_range,
    keep_frequent,
    seen_before,
    seen_in_span,
    seen_in_years,
    visit_diagnoses,
)
from episodica.session import durable


def _anchors(cohort: DataFrame) -> DataFrame:
    return cohort.select("admission_id", "person_id", F.to_date("admission_datetime").alias("anchor_day"))


def prior_admissions(cohort: DataFrame, admissions: DataFrame, years: int = 5) -> DataFrame:
    """Number of admissions whose discharge lies in the `years` up to and including the admission time."""
    at = F.col("admission_datetime")
    return count_in_range(
        cohort, admissions, "person_id", "admission_id", years_before(at, years), at, "discharge_datetime",
        "n_previous_admissions",
    )


def given_before_index(cohort: DataFrame, admins: DataFrame, what: Column, name: str) -> DataFrame:
    """Distinct (admission, drug group) for valid drug codes given between admission and index time.

    Admission and index are 25 hours apart, or at least on different dates after hours were imputed, so a span always
    touches two days.
    """
    valid = admins.filter(F.col("atc").rlike(FULL_ATC)).select("person_id", "admin_datetime", what.alias(name))
    return seen_in_span(
        valid, cohort, "person_id", "admin_datetime", "admission_datetime", "index_datetime", [name], ["admission_id"],
        width_hours=24, spans_cross_buckets=True, clip=False,
    )


def atc_groups(cohort: DataFrame, admins: DataFrame, min_admissions: int) -> DataFrame:
    """Drug groups (first three characters) given before the index, if given in enough admissions."""
    groups = given_before_index(cohort, admins, atc_level2(F.col("atc")), "atc_level2")
    return keep_frequent(groups, "atc_level2", min_admissions)


def n_distinct_drugs(cohort: DataFrame, admins: DataFrame) -> DataFrame:
    """Number of different drugs given before the index; admissions without any have no row."""
    drugs = given_before_index(cohort, admins, F.col("atc"), "atc")
    return drugs.groupBy("admission_id").agg(F.count(F.lit(1)).alias("n_distinct_drugs_before_index"))


def diagnosis_codes(cohort: DataFrame, visits: DataFrame, diagnoses: DataFrame, years: int = 5) -> DataFrame:
    """Distinct (admission, code without its D) from register visits of the past years."""
    coded = visit_diagnoses(visits, diagnoses).withColumn("diag_code", code_part(F.col("diag_code"), 2))
    return seen_in_years(
        coded, _anchors(cohort), "person_id", "departure_date", "anchor_day", years, ["diag_code"], ["admission_id"]
    )


def icd10_groups(
    cohort: DataFrame, visits: DataFrame, diagnoses: DataFrame, classification: DataFrame, years: int = 5
) -> DataFrame:
    """Distinct (admission, chapter, block) of the past years; see chapters() and blocks().

    Codes are mapped to their group before the look-back, which then handles a few hundred groups, not codes.
    """
    groups = classification.select(
        "diag_code",
        F.col("chapter").alias("icd10_chapter"),
        strip_chars(F.col("block"), "R").cast("int").alias("icd10_block"),
    )
    coded = visit_diagnoses(visits, diagnoses).withColumn("diag_code", code_part(F.col("diag_code"), 2))
    return seen_in_years(
        coded.join(groups, "diag_code"), _anchors(cohort), "person_id", "departure_date", "anchor_day", years,
        ["icd10_chapter", "icd10_block"], ["admission_id"],
    )


def chapters(groups: DataFrame) -> DataFrame:
    return groups.select("admission_id", "icd10_chapter").distinct()


def blocks(groups: DataFrame) -> DataFrame:
    return groups.select("admission_id", "icd10_block").distinct()


def ckd_stages(cohort: DataFrame, visits: DataFrame, diagnoses: DataFrame, years: int = 5) -> DataFrame:
    """Distinct (admission, CKD stage) of the past years."""
    kidney = diagnoses.filter(F.col("diag_code").startswith("DN18"))
    staged = visit_diagnoses(visits, kidney).withColumn("n18_diag", ckd_stage(code_part(F.col("diag_code"), 2, 4)))
    return seen_in_years(
        staged, _anchors(cohort), "person_id", "departure_date", "anchor_day", years, ["n18_diag"], ["admission_id"]
    )


def comorbidity_scores(
    cohort: DataFrame, visits: DataFrame, diagnoses: DataFrame, prefixes: DataFrame, weights: DataFrame,
    out: str = "elixhauser_score_ahrq",
) -> DataFrame:
    """Weighted number of distinct comorbidity categories diagnosed before the admission date; 0 without any.

    prefixes(prefix, category) and weights(category, weight) are the published tables, given as data. Codes are
    matched to categories once per distinct code, by prefixes of each length that occurs in the table. A category without a weight
    counts nothing, several weights of one add up.
    """
    coded = visit_diagnoses(visits, diagnoses).withColumn("diag_code", code_part(F.col("diag_code"), 2))
    codes = coded.select("diag_code").distinct()
    cut = codes.withColumn(
        "prefix",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("diag_code")), lambda n: F.substring("diag_code", F.lit(1), n))),
    )
    # weights go with the codes: a join of what was seen would bring all admissions of a category together
    given = weights.groupBy("category").agg(F.sum("weight").alias("weight"))
    mapped = cut.join(prefixes, "prefix").select("diag_code", "category").distinct().join(given, "category")
    mapped = durable(mapped.select("diag_code", "category", "weight"), "mapped")
    seen = seen_before(
        coded.join(mapped, "diag_code"), _anchors(cohort), "person_id", "departure_date", "anchor_day", ["category", "weight"],
        ["admission_id"],
    )
    scores = seen.groupBy("admission_id").agg(F.sum("weight").alias(out))
    return cohort.select("admission_id").join(scores, "admission_id", "left").na.fill(0, [out])
