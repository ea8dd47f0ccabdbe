"""Queries for composite steps: cohort, outcomes, features and data sets."""

from pyspark.sql import functions as F

from episodica.operators import features as ft
from episodica.operators import outcomes as oc
from episodica.plans import proxies as P
from episodica.plans.proxies import TARGET_ATC, with_views
from episodica.plans.registry import query
from episodica.plans.sampling_queries import impute_views
from episodica.session import durable

# A small documented subset of the published comorbidity tables, enough for the diagnoses in the data; the full
# tables are data to be supplied by the user.
PREFIXES = [("I10", "hypunc"), ("E11", "diabunc"), ("N18", "rf"), ("J44", "cpd"), ("C50", "solidtum")]
WEIGHTS = [("hypunc", -1), ("diabunc", 0), ("rf", 6), ("cpd", 3), ("solidtum", 7)]


def _values(rows):
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


@query("cohort", with_views("SELECT * FROM cohort", "cohort"))
def cohort(spark, sf):
    return P.cohort_of(spark, sf)


IMPUTED = with_views("""SELECT admission_id, person_id, admission_datetime, discharge_datetime, index_datetime
    FROM imputed w WHERE EXISTS (SELECT 1 FROM valid_labs l WHERE l.person_id = w.person_id AND l.egfr <= 30
    AND l.egfr_datetime BETWEEN w.admission_datetime AND w.admission_datetime + INTERVAL 25 HOUR)""", "washed", "valid_labs",
    **impute_views("admission_datetime", "washed"), **impute_views("discharge_datetime", "washed"),
    imputed="""SELECT admission_id, person_id, a.admission_datetime, d.discharge_datetime, index_datetime FROM washed w
        JOIN admission_datetime_new a USING (admission_id) JOIN discharge_datetime_new d USING (admission_id)""")


@query("cohort_imputed", IMPUTED)
def cohort_imputed(spark, sf):
    """The cohort with invalid hours replaced; index times stay where they were."""
    from episodica.operators.cohort import cohort as select_cohort
    from episodica.operators.cohort import valid_labs

    out = select_cohort(
        valid_labs(P.labs(spark, sf), P.EGFR_CODES, P.SINCE, P.UNTIL), P.stays(spark, sf), P.person(spark, sf), P.SINCE, P.UNTIL,
        washout_days=2, seed=42)
    return out.select("admission_id", "person_id", "admission_datetime", "discharge_datetime", "index_datetime")


@query("capped_sum", with_views("""SELECT admission_id, round(least(30.0, sum(date_diff('microsecond', era_start_datetime,
    era_end_datetime)) / 86400000000.0::DOUBLE), 6) AS time_at_risk FROM eras WHERE egfr_is_low GROUP BY admission_id""", "eras"))
def capped_sum(spark, sf):
    out = oc.time_at_risk(P.eras_of(spark, sf), 30)
    return out.withColumn("time_at_risk", F.round("time_at_risk", 6))


LOW = "SELECT * FROM eras WHERE egfr_is_low"
COUNTS = """SELECT admission_id, atc, count(*) AS r FROM target_admins d JOIN low e ON d.person_id = e.person_id
    AND d.admin_datetime BETWEEN e.era_start_datetime AND e.era_end_datetime WHERE atc <> 'B01AF02' GROUP BY admission_id, atc
    UNION ALL SELECT admission_id, atc, count(*) FROM (SELECT e.admission_id, d.atc, sum(CAST(round(given_dose * 1000) AS BIGINT)) OVER (
    PARTITION BY e.admission_id, CAST(d.admin_datetime AS DATE) ORDER BY d.admin_datetime, d.admin_id
    ROWS UNBOUNDED PRECEDING) AS total FROM target_admins d JOIN low e ON d.person_id = e.person_id
    AND d.admin_datetime BETWEEN e.era_start_datetime AND e.era_end_datetime WHERE atc = 'B01AF02') t
    WHERE total > 5000 GROUP BY admission_id, atc"""
# The same over every stay as one long low era, so that the counts are not only a handful of rows.
WIDE_LOW = """SELECT admission_id, person_id, admission_datetime AS era_start_datetime,
    discharge_datetime AS era_end_datetime FROM stays"""


def _wide_eras(spark, sf):
    return P.stays(spark, sf).select(
        "admission_id", "person_id", F.lit(True).alias("egfr_is_low"),
        F.col("admission_datetime").alias("era_start_datetime"), F.col("discharge_datetime").alias("era_end_datetime"))


@query("count_by", with_views(f"{COUNTS}", "target_admins", "stays", low=WIDE_LOW))
def count_by(spark, sf):
    return oc.inappropriate_counts(P.target_admins(spark, sf), _wide_eras(spark, sf), P.APIXABAN)


@query("total_row", with_views("""SELECT admission_id, 'r_' || lower(atc) AS atc, r FROM counts
    UNION ALL SELECT admission_id, 'r', sum(r) FROM counts GROUP BY admission_id""",
    "target_admins", "stays", low=WIDE_LOW, counts=COUNTS))
def total_row(spark, sf):
    return oc.with_total(oc.inappropriate_counts(P.target_admins(spark, sf), _wide_eras(spark, sf), P.APIXABAN))


PER_DRUG = ", ".join(f"coalesce(sum(CASE WHEN atc = '{d}' THEN r END), 0) AS r_{d.lower()}" for d in TARGET_ATC)
OUTCOMES = f"""SELECT admission_id, coalesce(sum(r), 0) AS r, {PER_DRUG}, any_value(time_at_risk) AS time_at_risk FROM (
    SELECT admission_id, least(30.0, sum(date_diff('microsecond', era_start_datetime, era_end_datetime))
    / 86400000000.0::DOUBLE) AS time_at_risk FROM low GROUP BY admission_id) t
    LEFT JOIN counts USING (admission_id) GROUP BY admission_id"""


@query("outcomes", with_views("SELECT * REPLACE (round(time_at_risk, 6) AS time_at_risk) FROM outcomes",
    "target_admins", "eras", low=LOW, counts=COUNTS, outcomes=OUTCOMES))
def outcomes(spark, sf):
    eras = durable(P.eras_of(spark, sf), "eras")
    out = oc.outcomes(eras, P.target_admins(spark, sf), TARGET_ATC, P.APIXABAN)
    return out.withColumn("time_at_risk", F.round("time_at_risk", 6))


@query("conditional_count", with_views("""SELECT c.admission_id, sum(CASE WHEN a.person_id IS NOT NULL THEN 1 ELSE 0 END)
    AS n_previous_admissions FROM stays_long c LEFT JOIN stays_long a ON a.person_id = c.person_id
    AND a.discharge_datetime BETWEEN c.admission_datetime - INTERVAL 5 YEAR AND c.admission_datetime
    GROUP BY c.admission_id""", "stays_long"))
def conditional_count(spark, sf):
    stays = P.stays_long(spark, sf)
    return ft.prior_admissions(stays, stays, 5)


@query("feat_prior_admissions", with_views("""SELECT c.admission_id, sum(CASE WHEN a.person_id IS NOT NULL THEN 1 ELSE 0 END)
    AS n_previous_admissions FROM cohort c LEFT JOIN stays a ON a.person_id = c.person_id
    AND a.discharge_datetime BETWEEN c.admission_datetime - INTERVAL 5 YEAR AND c.admission_datetime
    GROUP BY c.admission_id""", "cohort", "stays"))
def feat_prior_admissions(spark, sf):
    return ft.prior_admissions(durable(P.cohort_of(spark, sf), "cohort"), P.stays(spark, sf), 5)


def _all_stays(spark, sf):
    """Eligible stays without the low-eGFR requirement: a wider base for the drug features."""
    from episodica.functions.timing import plus
    from episodica.operators.cohort import eligible

    stays = eligible(P.stays(spark, sf), P.person(spark, sf), P.SINCE, P.UNTIL)
    return stays.withColumn("index_datetime", plus(F.col("admission_datetime"), hours=25))


ATC2 = r"""SELECT DISTINCT c.admission_id, substr(d.atc, 1, 3) AS atc_level2 FROM eligible c JOIN drug_admins d
    ON d.person_id = c.person_id AND d.admin_datetime BETWEEN c.admission_datetime AND c.admission_datetime + INTERVAL 25 HOUR
    WHERE regexp_matches(d.atc, '^\w\d{2}\w{2}\d{2}')"""


@query("feat_atc_level2", with_views("""SELECT * FROM given WHERE atc_level2 IN
    (SELECT atc_level2 FROM given GROUP BY 1 HAVING count(*) >= 40)""", "eligible", "drug_admins", given=ATC2))
def feat_atc_level2(spark, sf):
    return ft.atc_groups(_all_stays(spark, sf), P.drug_admins(spark, sf), 40)


@query("feat_n_drugs", with_views(r"""SELECT c.admission_id, count(DISTINCT d.atc) AS n_distinct_drugs_before_index
    FROM eligible c JOIN drug_admins d ON d.person_id = c.person_id
    AND d.admin_datetime BETWEEN c.admission_datetime AND c.admission_datetime + INTERVAL 25 HOUR
    WHERE regexp_matches(d.atc, '^\w\d{2}\w{2}\d{2}') GROUP BY c.admission_id""", "eligible", "drug_admins"))
def feat_n_drugs(spark, sf):
    return ft.n_distinct_drugs(_all_stays(spark, sf), P.drug_admins(spark, sf))


@query("count_distinct", "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def count_distinct(spark, sf):
    return P.table(spark, sf, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n"))


FIVE_YEARS = """v.departure_date BETWEEN CAST(CAST(c.admission_datetime AS DATE) - INTERVAL 5 YEAR AS DATE)
    AND CAST(c.admission_datetime AS DATE)"""
DX = f"""SELECT DISTINCT c.admission_id, substr(d.diag_code, 2) AS diag_code FROM stays_long c JOIN visits_long v
    ON v.person_id = c.person_id AND {FIVE_YEARS} JOIN diagnoses_long d USING (visit_id)"""


def _long_dx(spark, sf):
    return P.stays_long(spark, sf), P.visits_long(spark, sf), P.diagnoses_long(spark, sf)


@query("distinct_rows", with_views("SELECT * FROM dx", "stays_long", "visits_long", "diagnoses_long", dx=DX))
def distinct_rows(spark, sf):
    return ft.diagnosis_codes(*_long_dx(spark, sf))


@query("feat_icd10", with_views("""SELECT DISTINCT admission_id, chapter AS icd10_chapter FROM dx JOIN icd10 USING (diag_code)""",
    "stays_long", "visits_long", "diagnoses_long", "icd10", dx=DX))
def feat_icd10(spark, sf):
    return ft.chapters(ft.icd10_groups(*_long_dx(spark, sf), P.icd10(spark)))


@query("feat_icd10_blocks", with_views("""SELECT DISTINCT admission_id, CAST(replace(block, 'R', '') AS INTEGER) AS icd10_block
    FROM dx JOIN icd10 USING (diag_code)""", "stays_long", "visits_long", "diagnoses_long", "icd10", dx=DX))
def feat_icd10_blocks(spark, sf):
    return ft.blocks(ft.icd10_groups(*_long_dx(spark, sf), P.icd10(spark)))


@query("feat_ckd", with_views("""SELECT DISTINCT admission_id, CASE WHEN diag_code IN ('N181','N182','N183','N184','N185')
    THEN diag_code ELSE 'N189' END AS n18_diag FROM dx WHERE diag_code LIKE 'N18%'""",
    "stays_long", "visits_long", "diagnoses_long", dx=DX))
def feat_ckd(spark, sf):
    return ft.ckd_stages(*_long_dx(spark, sf))


SCORE = f"""SELECT s.admission_id, coalesce(sum(weight), 0) AS elixhauser_score_ahrq FROM stays_long s LEFT JOIN (
    SELECT DISTINCT c.admission_id, p.category FROM stays_long c JOIN visits_long v ON v.person_id = c.person_id
    AND v.departure_date < CAST(c.admission_datetime AS DATE) JOIN diagnoses_long d USING (visit_id)
    JOIN (VALUES {_values(PREFIXES)}) p(prefix, category) ON starts_with(substr(d.diag_code, 2), p.prefix)) k
    USING (admission_id) LEFT JOIN (VALUES {_values(WEIGHTS)}) w(category, weight) USING (category) GROUP BY s.admission_id"""


def _comorbidity(spark, cohort, visits, diagnoses):
    return ft.comorbidity_scores(
        cohort, visits, diagnoses, spark.createDataFrame(PREFIXES, "prefix string, category string"),
        spark.createDataFrame(WEIGHTS, "category string, weight int"))


@query("weighted_score", with_views(SCORE, "stays_long", "visits_long", "diagnoses_long"))
def weighted_score(spark, sf):
    return _comorbidity(spark, *_long_dx(spark, sf))


@query("feat_elixhauser", with_views(SCORE.replace("stays_long", "cohort").replace("visits_long", "visits")
    .replace("diagnoses_long", "diagnoses"), "cohort", "visits", "diagnoses"))
def feat_elixhauser(spark, sf):
    return _comorbidity(spark, durable(P.cohort_of(spark, sf), "cohort"), P.visits(spark, sf), P.diagnoses(spark, sf))
