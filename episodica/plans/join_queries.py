"""Queries for joins."""

from pyspark.sql import functions as F

from episodica.functions.timing import plus
from episodica.operators import joins as j
from episodica.operators.cohort import valid_labs
from episodica.plans import proxies as P
from episodica.plans.proxies import with_views
from episodica.plans.registry import query


@query("inner_equi", with_views("""SELECT visit_id, diag_code, chapter, block FROM (SELECT visit_id, substr(diag_code, 2)
    AS diag_code FROM diagnoses) d JOIN icd10 USING (diag_code)""", "diagnoses", "icd10"))
def inner_equi(spark, sf):
    codes = P.diagnoses(spark, sf).withColumn("diag_code", F.substring("diag_code", 2, 10))
    return codes.join(P.icd10(spark), "diag_code")


@query("left_equi", with_views("""SELECT person_id, sex, coalesce(n, 0) AS n FROM person LEFT JOIN
    (SELECT user_id AS person_id, count(*) AS n FROM events WHERE value > 100 GROUP BY user_id) e USING (person_id)""",
    "person"))
def left_equi(spark, sf):
    n = P.table(spark, sf, "events").filter("value > 100").groupBy(F.col("user_id").alias("person_id")).agg(
        F.count(F.lit(1)).alias("n"))
    return j.left_features(P.person(spark, sf).select("person_id", "sex"), n, "person_id")


@query("right_equi", with_views("""SELECT admission_id, coalesce(n, 0) AS n FROM (SELECT visit_id AS admission_id,
    count(*) AS n FROM visits_long WHERE departure_date < DATE '1998-01-01' GROUP BY visit_id) v
    RIGHT JOIN (SELECT admission_id FROM stays_long) s USING (admission_id)""", "visits_long", "stays_long"))
def right_equi(spark, sf):
    early = P.visits_long(spark, sf).filter(F.col("departure_date") < "1998-01-01")
    counts = early.groupBy(F.col("visit_id").alias("admission_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(P.stays_long(spark, sf).select("admission_id"), "admission_id", "right").na.fill(0, ["n"])


def _first_day(spark, sf):
    return P.stays(spark, sf).withColumn("until", plus(F.col("admission_datetime"), hours=25))


INTERVAL = """SELECT s.admission_id, s.person_id, d.admin_id, d.admin_datetime FROM stays s JOIN drug_admins d
    ON s.person_id = d.person_id AND d.admin_datetime BETWEEN s.admission_datetime AND s.admission_datetime + INTERVAL 25 HOUR"""


@query("interval_join", with_views(INTERVAL, "stays", "drug_admins"))
def interval_join(spark, sf):
    points = P.drug_admins(spark, sf).select("admin_id", "person_id", "admin_datetime")
    spans = _first_day(spark, sf).select("admission_id", "person_id", "admission_datetime", "until")
    pairs = j.interval_join(points, spans, "person_id", "admin_datetime", "admission_datetime", "until", 24)
    return pairs.select("admission_id", "person_id", "admin_id", "admin_datetime")


MIXED = """SELECT *, CASE admission_id % 4 WHEN 0 THEN admission_datetime + INTERVAL 30 MINUTE WHEN 1 THEN
    admission_datetime + INTERVAL 25 HOUR WHEN 2 THEN discharge_datetime ELSE TIMESTAMP '9999-12-31' END AS until FROM stays"""


@query("interval_join_mixed", with_views("""SELECT s.admission_id, s.person_id, d.admin_id, d.admin_datetime FROM spans s
    JOIN drug_admins d ON s.person_id = d.person_id AND d.admin_datetime BETWEEN s.admission_datetime AND s.until""",
    "stays", "drug_admins", spans=MIXED))
def interval_join_mixed(spark, sf):
    """Spans from half an hour to without an end, in one join."""
    points = P.drug_admins(spark, sf).select("admin_id", "person_id", "admin_datetime")
    start, which = F.col("admission_datetime"), F.col("admission_id") % 4
    until = F.when(which == 0, plus(start, seconds=1800)).when(which == 1, plus(start, hours=25)).when(
        which == 2, F.col("discharge_datetime")).otherwise(F.lit("9999-12-31").cast("timestamp_ntz"))
    spans = P.stays(spark, sf).select("admission_id", "person_id", "admission_datetime", until.alias("until"))
    pairs = j.dyadic_join(points, spans, "person_id", "admin_datetime", "admission_datetime", "until")
    return pairs.select("admission_id", "person_id", "admin_id", "admin_datetime")


@query("right_then_filter", with_views("""SELECT s.admission_id, d.admin_id FROM drug_admins d RIGHT JOIN stays s
    ON s.person_id = d.person_id WHERE d.admin_datetime BETWEEN s.admission_datetime
    AND s.admission_datetime + INTERVAL 25 HOUR""", "stays", "drug_admins"))
def right_then_filter(spark, sf):
    points = P.drug_admins(spark, sf).select("admin_id", "person_id", "admin_datetime")
    spans = _first_day(spark, sf).select("admission_id", "person_id", "admission_datetime", "until")
    pairs = j.interval_join(points, spans, "person_id", "admin_datetime", "admission_datetime", "until", 24)
    return pairs.select("admission_id", "admin_id")


@query("seen_in_span", with_views("""SELECT DISTINCT s.admission_id, d.atc FROM stays s JOIN drug_admins d
    ON s.person_id = d.person_id AND d.admin_datetime BETWEEN s.admission_datetime AND s.discharge_datetime""",
    "stays", "drug_admins"))
def seen_in_span(spark, sf):
    return j.seen_in_span(
        P.drug_admins(spark, sf), P.stays(spark, sf), "person_id", "admin_datetime", "admission_datetime",
        "discharge_datetime", ["atc"], ["admission_id"], width_hours=24)


LOOKBACK = """SELECT s.admission_id, v.visit_id, v.departure_date FROM stays_long s JOIN visits_long v
    ON s.person_id = v.person_id AND v.departure_date BETWEEN CAST(CAST(s.admission_datetime AS DATE) - INTERVAL 5 YEAR AS DATE)
    AND CAST(s.admission_datetime AS DATE)"""


@query("lookback_join", with_views(LOOKBACK, "stays_long", "visits_long"))
def lookback_join(spark, sf):
    anchors = P.stays_long(spark, sf).select("admission_id", "person_id", F.to_date("admission_datetime").alias("day"))
    pairs = j.lookback_join(anchors, P.visits_long(spark, sf), "person_id", "departure_date", "day", 5)
    return pairs.select("admission_id", "visit_id", "departure_date")


@query("before_join", with_views("""SELECT DISTINCT s.admission_id, v.kind FROM stays_long s JOIN (SELECT person_id,
    departure_date, visit_id % 6 AS kind FROM visits_long) v
    ON s.person_id = v.person_id AND v.departure_date < CAST(s.admission_datetime AS DATE)""", "stays_long", "visits_long"))
def before_join(spark, sf):
    anchors = P.stays_long(spark, sf).select("admission_id", "person_id", F.to_date("admission_datetime").alias("day"))
    kinds = P.visits_long(spark, sf).withColumn("kind", F.col("visit_id") % 6)
    return j.seen_before(kinds, anchors, "person_id", "departure_date", "day", ["kind"], ["admission_id"])


@query("chained_left", with_views("""SELECT p.person_id, v.visit_id, d.diag_code FROM person p
    LEFT JOIN visits v USING (person_id) LEFT JOIN diagnoses d USING (visit_id)""", "person", "visits", "diagnoses"))
def chained_left(spark, sf):
    linked = j.diagnoses_of(P.person(spark, sf), P.visits(spark, sf), P.diagnoses(spark, sf), "person_id")
    return linked.select("person_id", "visit_id", "diag_code")


@query("semi_person", with_views("""SELECT admin_id, person_id, atc FROM drug_admins WHERE person_id IN
    (SELECT person_id FROM cohort)""", "drug_admins", "cohort"))
def semi_person(spark, sf):
    kept = j.restrict_to(P.drug_admins(spark, sf), P.cohort_of(spark, sf), "person_id")
    return kept.select("admin_id", "person_id", "atc")


@query("semi_person_repeated", with_views("""SELECT d.admin_id, d.person_id FROM drug_admins d
    JOIN (SELECT person_id FROM eligible) c USING (person_id)""", "drug_admins", "eligible"))
def semi_person_repeated(spark, sf):
    from episodica.operators.cohort import eligible

    chosen = eligible(P.stays(spark, sf), P.person(spark, sf), P.SINCE, P.UNTIL)
    kept = j.restrict_to(P.drug_admins(spark, sf), chosen, "person_id", multiplicity="reference")
    return kept.select("admin_id", "person_id")


@query("semi_frequency", with_views("""SELECT admin_id, atc FROM drug_admins WHERE atc IN (SELECT atc FROM drug_admins
    GROUP BY atc HAVING count(*) >= (SELECT count(*) / 10 FROM drug_admins))""", "drug_admins"))
def semi_frequency(spark, sf):
    admins = P.drug_admins(spark, sf).select("admin_id", "atc")
    return j.keep_frequent(admins, "atc", -(-admins.count() // 10))


@query("anti_membership", with_views("""SELECT admission_id, person_id IN (SELECT person_id FROM stays
    WHERE admission_datetime < TIMESTAMP '2024-01-04') AS seen FROM stays""", "stays"))
def anti_membership(spark, sf):
    early = F.col("admission_datetime") < F.lit("2024-01-04").cast("timestamp_ntz")
    return j.mark_seen(P.stays(spark, sf), "person_id", early).select("admission_id", "seen")


@query("bridge_map", with_views("""SELECT c.admission_id, v.visit_id FROM cohort c JOIN
    (SELECT event_id AS admission_id, event_id * 2 AS visit_id FROM events) v USING (admission_id)""", "cohort"))
def bridge_map(spark, sf):
    bridge = P.table(spark, sf, "events").select(
        F.col("event_id").alias("admission_id"), (F.col("event_id") * 2).alias("visit_id"))
    return P.cohort_of(spark, sf).select("admission_id").join(bridge, "admission_id")


@query("cross_product", """SELECT DISTINCT t.outcome_type || '__' || m.model_type || '__' || e.event_type AS study_name
    FROM (VALUES ('binary'), ('refmodel')) t(outcome_type), (VALUES ('mlp'), ('linear')) m(model_type), events e""")
def cross_product(spark, sf):
    kinds = P.table(spark, sf, "events").select("event_type").distinct()
    grid = j.settings_grid(spark, kinds, outcome_type=["binary", "refmodel"], model_type=["mlp", "linear"])
    return grid.select(F.concat_ws("__", "outcome_type", "model_type", "event_type").alias("study_name"))


@query("map_lookup", with_views("""SELECT visit_id, CASE diag_code WHEN 'DN181' THEN 'Chronic kidney disease, stage 1'
    WHEN 'DI109' THEN 'Hypertension' END AS label FROM diagnoses""", "diagnoses"))
def map_lookup(spark, sf):
    labels = {"DN181": "Chronic kidney disease, stage 1", "DI109": "Hypertension"}
    return j.label_codes(P.diagnoses(spark, sf), "diag_code", labels, "label").select("visit_id", "label")


@query("count_in_range", with_views("""SELECT s.admission_id, count(l.lab_id) AS n FROM stays s LEFT JOIN valid_labs l
    ON l.person_id = s.person_id AND l.egfr_datetime BETWEEN s.admission_datetime AND s.discharge_datetime
    GROUP BY s.admission_id""", "stays", "valid_labs"))
def count_in_range(spark, sf):
    labs = valid_labs(P.labs(spark, sf), P.EGFR_CODES, P.SINCE, P.UNTIL)
    return j.count_in_range(
        P.stays(spark, sf), labs, "person_id", "admission_id", F.col("admission_datetime"), F.col("discharge_datetime"),
        "egfr_datetime", "n")
