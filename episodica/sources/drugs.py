"""The three layouts of drug administrations and their union."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions.text import dose, dose_unit, parse_number, parse_ts, strip_chars
from episodica.operators.filters import completed, exclude_regex, positive_dose, tag
from episodica.operators.joins import restrict_to
from episodica.operators.reshape import union_all
from episodica.sources.tables import read_with_header

FINAL = ["person_id", "admin_datetime", "given_dose", "given_dose_unit", "product_name", "formulation", "atc", "source"]
# Accepted time formats and the pattern of ids that are not persons.
DAY_FIRST = ["dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy H:mm:ss"]
YEAR_FIRST = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS"]
NOT_A_PERSON = "^[TX]"


def _persons(df: DataFrame, cohort: DataFrame, multiplicity: str) -> DataFrame:
    """Numeric person ids, restricted to the cohort."""
    numbered = exclude_regex(df, "person_id", NOT_A_PERSON).withColumn(
        "person_id", parse_number(F.col("person_id")).cast("long")
    )
    return restrict_to(numbered, cohort, "person_id", multiplicity)


def complete_layout(spark: SparkSession, paths: Mapping[str, str], cohort: DataFrame, label: str, multiplicity="once") -> DataFrame:
    """Dose, unit, drug code and a day-first timestamp in one file."""
    raw = read_with_header(
        spark, paths["admins"], paths["admins_header"], types={"given_dose": "double", "admin_status": "int"}
    )
    admins = _persons(completed(raw), cohort, multiplicity).withColumns(
        {
            "given_dose_unit": F.lower("given_dose_unit"),
            "admin_datetime": parse_ts(F.col("admin_datetime"), *DAY_FIRST),
        }
    )
    return tag(admins, label, FINAL)


def prescription_layout(
    spark: SparkSession, paths: Mapping[str, str], cohort: DataFrame, label: str, multiplicity="once"
) -> DataFrame:
    """Date and time apart; the drug code is found through administration -> prescription."""
    raw = read_with_header(
        spark, paths["admins"], paths["admins_header"], types={"given_dose": "double", "admin_status": "int"}
    )
    codes = read_with_header(
        spark, paths["prescriptions"], paths["prescriptions_header"], {"prim_atc": "atc", "ord_id": "prescription_id"}
    )
    links = spark.read.options(sep="\t", header=True).schema("adm_id string, ord_id string").csv(paths["mapping"])
    links = links.withColumnsRenamed({"adm_id": "administration_id", "ord_id": "prescription_id"})
    when = parse_ts(F.concat_ws(" ", "admin_date", "admin_time"), *DAY_FIRST)
    admins = _persons(completed(raw), cohort, multiplicity).withColumn("admin_datetime", when)
    linked = admins.join(links, "administration_id").join(codes, "prescription_id")
    return tag(linked, label, FINAL)


def strength_layout(spark: SparkSession, paths: Mapping[str, str], cohort: DataFrame, label: str, multiplicity="once") -> DataFrame:
    """Strength times volume, year-first timestamps, NULL as missing value, colons in the drug code."""
    raw = read_with_header(
        spark, paths["admins"], paths["admins_header"], types={"adm_strength": "double", "adm_volume": "double"},
        quote='"', null="NULL",
    )
    admins = _persons(raw, cohort, multiplicity).withColumns(
        {
            "admin_datetime": parse_ts(F.col("admin_datetime"), *YEAR_FIRST),
            "atc": strip_chars(F.col("atc"), ":"),
            "given_dose": dose(F.col("adm_strength"), F.col("adm_volume")),
            "given_dose_unit": dose_unit(F.col("adm_strength_unit")),
        }
    )
    return tag(admins, label, FINAL)


LAYOUTS = {"complete": complete_layout, "prescription": prescription_layout, "strength": strength_layout}


def drug_administrations(
    spark: SparkSession, sources: Mapping[str, tuple[str, Mapping[str, str]]], cohort: DataFrame, multiplicity="once"
) -> DataFrame:
    """All sources stacked, without missing or zero doses. sources: label -> (layout name, paths)."""
    parts = [LAYOUTS[layout](spark, paths, cohort, label, multiplicity) for label, (layout, paths) in sources.items()]
    return positive_dose(union_all(*parts))
