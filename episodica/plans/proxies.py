"""Clinical views over the given parquet tables, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The laboratory codes that count as eGFR.
EGFR_CODES = ["DNK35131", "DNK35301", "DNK35302"]
LAB_CODES = [*EGFR_CODES, "OTHER"]
# The target drugs; the first has a dose limit, the others should not be given at all.
TARGET_ATC = ["B01AF02", "B01AE07", "B01AF01", "A10BA02", "M01AE01", "M01AH01", "L04AX03", "N05AN01"]
APIXABAN = "B01AF02"
ATC = [*TARGET_ATC, "N02BE01", "C03"]
DIAGNOSES = ["DN181", "DN182", "DN185", "DN189", "DI109", "DE119", "DC509", "DJ440"]
ICD10 = [  # code, chapter, block
    ("N181", 14, "R300"), ("N182", 14, "R300"), ("N185", 14, "R300"), ("N189", 14, "R300"),
    ("I109", 9, "R200"), ("E119", 4, "R90"), ("C509", 2, "R40"), ("J440", 10, "R240"),
]
SINCE, UNTIL = "2006-01-01 00:00:00", "2024-12-31 23:59:59"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def k_of(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def pick(values: list, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def person(spark: SparkSession, sf: str) -> DataFrame:
    offset = (F.col("c_custkey") * 7919 % 36500).cast("int")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"),
        F.date_add(F.lit("1925-01-01").cast("date"), offset).alias("date_of_birth"),
        F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("sex"),
    )


def _events(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return table(spark, sf, "events").filter(F.col("event_type") == kind)


def stays(spark: SparkSession, sf: str) -> DataFrame:
    minutes = F.floor(F.col("value") * 60).cast("int")
    return _events(spark, sf, "signup").select(
        F.col("event_id").alias("admission_id"),
        F.col("user_id").alias("person_id"),
        F.col("ts").alias("admission_datetime"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("discharge_datetime"),
    )


def stays_long(spark: SparkSession, sf: str) -> DataFrame:
    days = (F.col("o_orderkey") % 20 + 1).cast("int")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("admission_id"),
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderdate").alias("admission_datetime"),
        (F.col("o_orderdate") + F.make_dt_interval(days)).alias("discharge_datetime"),
    )


def labs(spark: SparkSession, sf: str) -> DataFrame:
    return k_of(_events(spark, sf, "view")).select(
        F.col("event_id").alias("lab_id"),
        F.col("user_id").alias("person_id"),
        F.col("value").alias("egfr"),
        F.col("ts").alias("egfr_datetime"),
        pick(LAB_CODES, F.col("k") % 4).alias("code"),
    )


def drug_admins(spark: SparkSession, sf: str) -> DataFrame:
    return k_of(_events(spark, sf, "purchase")).select(
        F.col("event_id").alias("admin_id"),
        F.col("user_id").alias("person_id"),
        F.col("ts").alias("admin_datetime"),
        F.round(F.col("value") / 10, 3).alias("given_dose"),
        pick(ATC, F.col("k") % 10).alias("atc"),
    )


def target_admins(spark: SparkSession, sf: str) -> DataFrame:
    return drug_admins(spark, sf).filter(F.col("atc").isin(*TARGET_ATC) & (F.col("given_dose") > 0))


def visits(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf, "error").select(
        F.col("event_id").alias("visit_id"),
        F.col("user_id").alias("person_id"),
        F.to_date("ts").alias("departure_date"),
    )


def diagnoses(spark: SparkSession, sf: str) -> DataFrame:
    return k_of(_events(spark, sf, "error")).select(
        F.col("event_id").alias("visit_id"), pick(DIAGNOSES, F.col("k") % 8).alias("diag_code")
    )


def visits_long(spark: SparkSession, sf: str) -> DataFrame:
    """Register visits over seven years, so that a five-year look-back has something to cut off."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("visit_id"),
        F.col("o_custkey").alias("person_id"),
        F.to_date("o_orderdate").alias("departure_date"),
    )


def diagnoses_long(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("visit_id"),
        pick(DIAGNOSES, (F.col("o_orderkey") % 8).cast("int")).alias("diag_code"),
    )


def icd10(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ICD10, "diag_code string, chapter int, block string")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    events = k_of(table(spark, sf, "events"))
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("study_"), (F.col("k") % 2).cast("string")).alias("study_name"),
        pick(["dev", "test", "test_new"], (F.col("user_id") % 3).cast("int")).alias("dataset"),
        F.lit("crude").alias("pred_type"),
        F.col("user_id").alias("person_id"),
        (F.col("value") > 50).cast("int").alias("y_true"),
        (F.floor((F.col("k") * 100 + F.least(F.round(F.col("value") * 100), F.lit(10000.0))) / 2) / 10000).alias("y_pred"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") >= 5).cast("int").alias("y"),
    )


def cohort_of(spark: SparkSession, sf: str) -> DataFrame:
    """Short-horizon cohort: two-day washout, hours left alone."""
    from episodica.operators.cohort import cohort, valid_labs

    return cohort(
        valid_labs(labs(spark, sf), EGFR_CODES, SINCE, UNTIL), stays(spark, sf), person(spark, sf), SINCE, UNTIL,
        washout_days=2,
    )


def eras_of(spark: SparkSession, sf: str) -> DataFrame:
    from episodica.operators.cohort import derive_eras, valid_labs
    from episodica.session import durable

    chosen = durable(cohort_of(spark, sf), "cohort")
    return derive_eras(valid_labs(labs(spark, sf), EGFR_CODES, SINCE, UNTIL), chosen)


def _case(column: str, values: list[str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
SQL = {
    "person": """SELECT c_custkey AS person_id, DATE '1925-01-01' + CAST(c_custkey * 7919 % 36500 AS INTEGER) AS date_of_birth,
        CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex FROM customer""",
    "stays": """SELECT event_id AS admission_id, user_id AS person_id, ts AS admission_datetime,
        ts + to_minutes(CAST(floor(value * 60) AS BIGINT)) AS discharge_datetime FROM events WHERE event_type = 'signup'""",
    "stays_long": """SELECT o_orderkey AS admission_id, o_custkey AS person_id, o_orderdate AS admission_datetime,
        o_orderdate + to_days(CAST(o_orderkey % 20 + 1 AS INTEGER)) AS discharge_datetime FROM orders""",
    "labs": f"""SELECT event_id AS lab_id, user_id AS person_id, value AS egfr, ts AS egfr_datetime,
        {_case(f'({K}) % 4', LAB_CODES)} AS code FROM events WHERE event_type = 'view'""",
    "drug_admins": f"""SELECT event_id AS admin_id, user_id AS person_id, ts AS admin_datetime,
        round(value / 10, 3) AS given_dose, {_case(f'({K}) % 10', ATC)} AS atc FROM events WHERE event_type = 'purchase'""",
    "target_admins": "SELECT * FROM drug_admins WHERE atc IN (" + ", ".join(f"'{a}'" for a in TARGET_ATC)
    + ") AND given_dose > 0",
    "visits": """SELECT event_id AS visit_id, user_id AS person_id, CAST(ts AS DATE) AS departure_date
        FROM events WHERE event_type = 'error'""",
    "diagnoses": f"""SELECT event_id AS visit_id, {_case(f'({K}) % 8', DIAGNOSES)} AS diag_code
        FROM events WHERE event_type = 'error'""",
    "visits_long": """SELECT o_orderkey AS visit_id, o_custkey AS person_id, CAST(o_orderdate AS DATE) AS departure_date
        FROM orders""",
    "diagnoses_long": f"SELECT o_orderkey AS visit_id, {_case('o_orderkey % 8', DIAGNOSES)} AS diag_code FROM orders",
    "icd10": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {n}, '{b}')" for c, n, b in ICD10)
    + ") AS t(diag_code, chapter, block)",
    "predictions": f"""SELECT event_id AS id, 'study_' || CAST(({K}) % 2 AS VARCHAR) AS study_name,
        {_case('user_id % 3', ['dev', 'test', 'test_new'])} AS dataset, 'crude' AS pred_type, user_id AS person_id,
        CASE WHEN value > 50 THEN 1 ELSE 0 END AS y_true,
        floor((({K}) * 100 + least(round(value * 100), 10000)) / 2) / 10000 AS y_pred FROM events""",
    "vectors": "SELECT vec_id AS id, embedding AS x, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings",
    "valid_labs": f"""SELECT * FROM labs WHERE code IN ('DNK35131', 'DNK35301', 'DNK35302') AND egfr IS NOT NULL
        AND egfr_datetime BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}'""",
    "eligible": f"""SELECT s.*, p.date_of_birth, p.sex FROM stays s JOIN person p USING (person_id)
        WHERE admission_datetime >= TIMESTAMP '{SINCE}' AND discharge_datetime <= TIMESTAMP '{UNTIL}'
        AND discharge_datetime - admission_datetime >= INTERVAL 25 HOUR
        AND CAST(admission_datetime AS DATE) - date_of_birth >= 18 * 365.25""",
    "washed": """SELECT * EXCLUDE (prev_end), admission_datetime + INTERVAL 25 HOUR AS index_datetime FROM (
        SELECT *, lag(discharge_datetime) OVER (PARTITION BY person_id
            ORDER BY admission_datetime, discharge_datetime, admission_id) AS prev_end FROM eligible) t
        WHERE prev_end IS NULL OR admission_datetime - prev_end >= INTERVAL 2 DAY""",
    "cohort": """SELECT w.*, date_diff('microsecond', admission_datetime, discharge_datetime) // 3600000000 AS los_hours
        FROM washed w WHERE EXISTS (SELECT 1 FROM valid_labs l WHERE l.person_id = w.person_id AND l.egfr <= 30
            AND l.egfr_datetime BETWEEN w.admission_datetime AND w.admission_datetime + INTERVAL 25 HOUR)""",
    "lab_fu": """SELECT l.lab_id, l.egfr, l.egfr_datetime, c.person_id, c.admission_id, c.admission_datetime,
        c.index_datetime, c.los_hours, l.egfr <= 30 AS egfr_is_low FROM valid_labs l JOIN cohort c
        ON c.person_id = l.person_id AND l.egfr_datetime BETWEEN c.admission_datetime
            AND c.index_datetime + INTERVAL 30 DAY""",
    "runs": """SELECT * EXCLUDE (changed), sum(changed) OVER (PARTITION BY admission_id
        ORDER BY egfr_datetime, egfr, lab_id ROWS UNBOUNDED PRECEDING) AS run_id FROM (
        SELECT *, CASE WHEN lag(egfr_is_low) OVER w IS DISTINCT FROM egfr_is_low THEN 1 ELSE 0 END AS changed FROM lab_fu
        WINDOW w AS (PARTITION BY admission_id ORDER BY egfr_datetime, egfr, lab_id)) t""",
    "run_groups": """SELECT admission_id, run_id, any_value(person_id) AS person_id, any_value(egfr_is_low) AS egfr_is_low,
        any_value(los_hours) AS los_hours, any_value(index_datetime) AS index_datetime,
        min(egfr_datetime) AS era_start_datetime FROM runs GROUP BY admission_id, run_id""",
    "eras": """SELECT admission_id, person_id, egfr_is_low, los_hours, index_datetime, era_start_datetime,
        least(coalesce(nxt - INTERVAL 1 SECOND, index_datetime + to_hours(least(los_hours - 24, 720))),
            index_datetime + to_hours(los_hours), index_datetime + INTERVAL 30 DAY) AS era_end_datetime FROM (
        SELECT *, lead(era_start_datetime) OVER (PARTITION BY admission_id ORDER BY run_id) AS nxt FROM run_groups) t
        WHERE era_start_datetime <= index_datetime + to_hours(los_hours)""",
}
NEEDS = {
    "target_admins": ["drug_admins"],
    "valid_labs": ["labs"],
    "eligible": ["stays", "person"],
    "washed": ["eligible"],
    "cohort": ["washed", "valid_labs"],
    "lab_fu": ["valid_labs", "cohort"],
    "runs": ["lab_fu"],
    "run_groups": ["runs"],
    "eras": ["run_groups"],
}


def with_views(body: str, *names: str, **extra: str) -> str:
    """Oracle text: the named views (and what they need) as common table expressions in front of body."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        done.setdefault(name, SQL[name])

    for name in names:
        add(name)
    done |= extra
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in done.items()) + "\n" + body


def with_recursive(body: str, *names: str, **extra: str) -> str:
    """As with_views, where a common table expression may refer to itself."""
    return with_views(body, *names, **extra).replace("WITH ", "WITH RECURSIVE ", 1)
