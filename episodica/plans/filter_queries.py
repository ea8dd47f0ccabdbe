"""Queries for filters, projections and predicates."""

from pyspark.sql import functions as F

from episodica.functions.text import FULL_ATC, rate_flag
from episodica.operators import filters as fl
from episodica.operators.cohort import eligible, flag_low, valid_labs
from episodica.operators.quantiles import trim_upper
from episodica.plans import proxies as P
from episodica.plans.proxies import K, with_views
from episodica.plans.registry import query


@query("lab_valid", with_views("""SELECT * FROM labs WHERE code IN ('DNK35131', 'DNK35301', 'DNK35302')
    AND egfr_datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND egfr IS NOT NULL""", "labs"))
def lab_valid(spark, sf):
    return valid_labs(P.labs(spark, sf), P.EGFR_CODES, "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query("eligible_admissions", with_views("SELECT * FROM eligible", "eligible"))
def eligible_admissions(spark, sf):
    return eligible(P.stays(spark, sf), P.person(spark, sf), P.SINCE, P.UNTIL)


@query("exclude_prefix", """SELECT event_id, pid FROM (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'T' || user_id
    WHEN 1 THEN 'X' || user_id WHEN 2 THEN 'P' || user_id END AS pid FROM events) t
    WHERE pid IS NULL OR NOT (pid LIKE 'T%' OR pid LIKE 'X%')""")
def exclude_prefix(spark, sf):
    prefix = F.element_at(F.array(F.lit("T"), F.lit("X"), F.lit("P"), F.lit(None)), (F.col("user_id") % 4 + 1).cast("int"))
    ids = P.table(spark, sf, "events").select("event_id", F.concat(prefix, F.col("user_id").cast("string")).alias("pid"))
    return fl.exclude_regex(ids, "pid", "^[TX]")


@query("status_filter", f"SELECT event_id, ({K}) % 10 AS admin_status FROM events WHERE ({K}) % 10 = 7")
def status_filter(spark, sf):
    rows = P.k_of(P.table(spark, sf, "events")).select("event_id", (F.col("k") % 10).alias("admin_status"))
    return fl.completed(rows)


@query("prefix_any", with_views("SELECT * FROM drug_admins WHERE atc LIKE 'B01%' OR atc LIKE 'M01AE%'", "drug_admins"))
def prefix_any(spark, sf):
    return fl.starts_with_any(P.drug_admins(spark, sf), "atc", ["B01", "M01AE"])


@query("valid_code", with_views(
    r"SELECT * FROM drug_admins WHERE regexp_matches(atc, '^\w\d{2}\w{2}\d{2}')", "drug_admins"))
def valid_code(spark, sf):
    return P.drug_admins(spark, sf).filter(F.col("atc").rlike(FULL_ATC))


@query("positive_dose", with_views("""SELECT admin_id, dose, unit FROM (
    SELECT admin_id, CASE WHEN admin_id % 5 = 0 THEN NULL WHEN admin_id % 7 = 0 THEN 0.0 ELSE given_dose END AS dose,
    CASE WHEN admin_id % 11 = 0 THEN NULL ELSE 'mg' END AS unit FROM drug_admins) t
    WHERE dose IS NOT NULL AND unit IS NOT NULL AND dose > 0""", "drug_admins"))
def positive_dose(spark, sf):
    i = F.col("admin_id")
    rows = P.drug_admins(spark, sf).select(
        "admin_id",
        F.when(i % 5 == 0, None).when(i % 7 == 0, 0.0).otherwise(F.col("given_dose")).alias("dose"),
        F.when(i % 11 == 0, None).otherwise("mg").alias("unit"),
    )
    return fl.positive_dose(rows, "dose", "unit")


@query("like_prefix", with_views("SELECT * FROM diagnoses WHERE diag_code LIKE 'DN18%'", "diagnoses"))
def like_prefix(spark, sf):
    return fl.code_like(P.diagnoses(spark, sf), "diag_code", "DN18%")


@query("low_flag", with_views("SELECT lab_id, egfr, egfr <= 30 AS is_low FROM labs", "labs"))
def low_flag(spark, sf):
    return flag_low(P.labs(spark, sf), "egfr").select("lab_id", "egfr", "is_low")


@query("conditional_select", with_views("""SELECT lab_id, CASE WHEN egfr <= 15 THEN 'failure' WHEN egfr <= 30 THEN 'severe'
    WHEN egfr <= 60 THEN 'moderate' ELSE 'other' END AS stage FROM labs""", "labs"))
def conditional_select(spark, sf):
    v = F.col("egfr")
    stage = fl.categorise((v <= 15, "failure"), (v <= 30, "severe"), (v <= 60, "moderate"), otherwise="other")
    return P.labs(spark, sf).select("lab_id", stage.alias("stage"))


@query("column_patterns", """SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity, sum(l_linenumber) AS lines
    FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def column_patterns(spark, sf):
    chosen = fl.drop_like(fl.select_like(P.table(spark, sf, "lineitem"), "^l_(order|line|quant|ship)"), "status$|date$")
    return chosen.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("l_quantity"), F.sum("l_linenumber").alias("lines")
    )


@query("drop_all_null_columns", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS some FROM orders")
def drop_all_null_columns(spark, sf):
    some = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("some")
    never = F.when(F.col("o_orderkey") < -1, F.col("o_custkey")).alias("never")
    return fl.drop_empty(P.table(spark, sf, "orders").select("o_orderkey", some, never))


@query("feature_subset", """SELECT event_id AS admission_id, value AS age_at_admission, CAST(event_type = 'view' AS INTEGER)
    AS "atc_level2_A10", CAST(event_type = 'error' AS INTEGER) AS "n18_diag_N181" FROM events""")
def feature_subset(spark, sf):
    wide = P.table(spark, sf, "events").select(
        F.col("event_id").alias("admission_id"),
        F.col("value").alias("age_at_admission"),
        (F.col("event_type") == "view").cast("int").alias("atc_level2_A10"),
        (F.col("event_type") == "error").cast("int").alias("n18_diag_N181"),
        (F.col("event_type") == "click").cast("int").alias("atc_level2_J01"),
    )
    return wide.select("admission_id", *fl.feature_columns(wide, "refmodel"))


@query("fill_zero", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, 0) AS price,
    coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, 0) AS customer FROM orders""")
def fill_zero(spark, sf):
    i = F.col("o_orderkey")
    return fl.fill_zero(P.table(spark, sf, "orders").select(
        i, F.when(i % 3 == 0, F.col("o_totalprice")).alias("price"), F.when(i % 2 == 0, F.col("o_custkey")).alias("customer")
    ))


@query("rename_pattern", """SELECT p_partkey, p_brand AS "inapp_dose_of_BRAND", p_size AS "inapp_dose_of_SIZE" FROM part""")
def rename_pattern(spark, sf):
    part = P.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("r_brand"), F.col("p_size").alias("r_size"))
    return fl.rename_with(part, "^r_", lambda c: "inapp_dose_of_" + c[2:].upper())


@query("cast_many", """SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice, CAST(o_custkey AS BIGINT) AS o_custkey
    FROM orders""")
def cast_many(spark, sf):
    orders = P.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return fl.cast_cols(orders, ["o_totalprice", "o_custkey"], "bigint")


@query("rowwise_max", f"""SELECT event_id, greatest(({K}) % 2, CAST(user_id % 3 = 0 AS INTEGER), CAST(value > 80 AS INTEGER))
    AS n18_diag_any FROM events""")
def rowwise_max(spark, sf):
    flags = P.k_of(P.table(spark, sf, "events")).select(
        "event_id",
        (F.col("k") % 2).alias("n18_diag_a"),
        (F.col("user_id") % 3 == 0).cast("int").alias("n18_diag_b"),
        (F.col("value") > 80).cast("int").alias("n18_diag_c"),
    )
    return fl.row_max(flags, "n18_diag_", "n18_diag_any").select("event_id", "n18_diag_any")


@query("quantile_cutoff", """SELECT event_id, event_type, value FROM events JOIN (SELECT event_type, quantile_cont(value, 0.999)
    AS cut FROM events GROUP BY event_type) c USING (event_type) WHERE value <= cut""")
def quantile_cutoff(spark, sf):
    return trim_upper(P.table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value", 0.999)


@query("tag_source", with_views("SELECT person_id, atc, 'ward' AS source FROM drug_admins", "drug_admins"))
def tag_source(spark, sf):
    return fl.tag(P.drug_admins(spark, sf), "ward", ["person_id", "atc", "source"])


@query("study_filter", with_views("""SELECT id, study_name, dataset, y_true, y_pred FROM predictions
    WHERE dataset = 'test' AND study_name NOT LIKE '%_1'""", "predictions"))
def study_filter(spark, sf):
    rows = fl.results_of(P.predictions(spark, sf), dataset="test", not_study="_1$")
    return rows.select("id", "study_name", "dataset", "y_true", "y_pred")


@query("rate_threshold", """SELECT o_orderkey, CAST(r > 0 AS INTEGER) AS daily_rate_not_zero,
    CASE WHEN t = 0 THEN CASE WHEN r > 0 THEN 1 END ELSE CAST(r / t >= 1 AS INTEGER) END AS daily_rate_geq_1,
    CASE WHEN t = 0 THEN CASE WHEN r > 0 THEN 1 END ELSE CAST(r / t >= 2 AS INTEGER) END AS daily_rate_geq_2
    FROM (SELECT o_orderkey, o_custkey % 4 AS r, CAST(o_orderkey % 3 AS DOUBLE) AS t FROM orders) x""")
def rate_threshold(spark, sf):
    r, t = F.col("o_custkey") % 4, (F.col("o_orderkey") % 3).cast("double")
    return P.table(spark, sf, "orders").select(
        "o_orderkey",
        (r > 0).cast("int").alias("daily_rate_not_zero"),
        rate_flag(r, t, 1).alias("daily_rate_geq_1"),
        rate_flag(r, t, 2).alias("daily_rate_geq_2"),
    )
