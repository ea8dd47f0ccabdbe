"""Queries for scalar functions."""

from pyspark.sql import functions as F

from episodica.functions import text as x
from episodica.functions import timing as tm
from episodica.plans import proxies as P
from episodica.plans.proxies import with_views
from episodica.plans.registry import query


@query("parse_number", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN -round(o_totalprice, 2)
    WHEN 2 THEN CAST(o_custkey AS DOUBLE) END AS n FROM orders""")
def parse_number(spark, sf):
    k, price = F.col("o_orderkey") % 4, F.format_number("o_totalprice", 2)
    text = (
        F.when(k == 0, F.concat(F.lit("DKK "), price, F.lit(" net")))
        .when(k == 1, F.concat(F.lit("-"), price))
        .when(k == 2, F.concat(F.lit("no "), F.col("o_custkey").cast("string"), F.lit(" of 9")))
        .otherwise("none")
    )
    return P.table(spark, sf, "orders").select("o_orderkey", x.parse_number(text).alias("n"))


@query("parse_ts", """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) END AS at FROM events""")
def parse_ts(spark, sf):
    i = F.col("event_id") % 3
    text = (
        F.when(i == 0, F.date_format("ts", "dd-MM-yyyy HH:mm:ss"))
        .when(i == 1, F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")))
        .otherwise("not a time")
    )
    parsed = x.parse_ts(text, "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    return P.table(spark, sf, "events").select("event_id", parsed.alias("at"))


@query("substr_code", with_views("""SELECT visit_id, substr(diag_code, 2) AS code, substr(diag_code, 2, 4) AS four
    FROM diagnoses""", "diagnoses"))
def substr_code(spark, sf):
    code = F.col("diag_code")
    return P.diagnoses(spark, sf).select(
        "visit_id", x.code_part(code, 2).alias("code"), x.code_part(code, 2, 4).alias("four"))


@query("strip_chars", "SELECT c_custkey, replace(replace(c_name, '#', ''), '0', '') AS name FROM customer")
def strip_chars(spark, sf):
    return P.table(spark, sf, "customer").select("c_custkey", x.strip_chars(F.col("c_name"), "#0").alias("name"))


@query("case_change", """SELECT c_custkey, lower(c_name) AS low, upper(c_name) AS up,
    upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS sentence FROM customer""")
def case_change(spark, sf):
    return P.table(spark, sf, "customer").select(
        "c_custkey", F.lower("c_name").alias("low"), F.upper("c_name").alias("up"),
        x.sentence(F.col("c_mktsegment")).alias("sentence"))


STUDY_NAMES = """CASE k % 2 WHEN 0 THEN 'binary' ELSE 'refmodel' END || '__' || CASE k % 3 WHEN 0 THEN 'mlp' ELSE 'linear' END
    || '__daily_rate_' || CASE WHEN k % 5 = 0 THEN 'not_zero' ELSE 'geq_' || CAST(k % 5 AS VARCHAR) END"""
# Replacements for study names, in order.
STUDY_REPLACEMENTS = [("binary__|__final", ""), ("mlp", "MLP"), ("linear", "Linear"), ("geq", ">="), ("not_zero", ">0"),
                      ("__", ", "), ("_", " ")]


def study_names(spark, sf):
    k = F.col("o_custkey")
    rate = F.when(k % 5 == 0, "not_zero").otherwise(F.concat(F.lit("geq_"), (k % 5).cast("string")))
    name = F.concat_ws(
        "__",
        F.when(k % 2 == 0, "binary").otherwise("refmodel"),
        F.when(k % 3 == 0, "mlp").otherwise("linear"),
        F.concat(F.lit("daily_rate_"), rate),
    )
    return P.table(spark, sf, "orders").select("o_orderkey", name.alias("study_name"))


@query("pretty_names", f"""SELECT o_orderkey, replace(replace(replace(replace(replace(replace(replace(study_name, 'binary__', ''),
    'mlp', 'MLP'), 'linear', 'Linear'), 'geq', '>='), 'not_zero', '>0'), '__', ', '), '_', ' ') AS pretty FROM (
    SELECT o_orderkey, {STUDY_NAMES} AS study_name FROM (SELECT o_orderkey, o_custkey AS k FROM orders) o) s""")
def pretty_names(spark, sf):
    return study_names(spark, sf).select("o_orderkey", x.prettify(F.col("study_name"), STUDY_REPLACEMENTS).alias("pretty"))


@query("split_cols", f"""SELECT o_orderkey, split_part(study_name, '__', 1) AS outcome_type,
    split_part(study_name, '__', 2) AS model_type, split_part(study_name, '__', 3) AS outcome FROM (
    SELECT o_orderkey, {STUDY_NAMES} AS study_name FROM (SELECT o_orderkey, o_custkey AS k FROM orders) o) s""")
def split_cols(spark, sf):
    return x.split_to(study_names(spark, sf), "study_name", "__", ["outcome_type", "model_type", "outcome"]).drop("study_name")


@query("reverse_string", "SELECT c_custkey, reverse(c_name) AS name FROM customer")
def reverse_string(spark, sf):
    return P.table(spark, sf, "customer").select("c_custkey", x.reverse_text(F.col("c_name")).alias("name"))


@query("concat_unique", "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def concat_unique(spark, sf):
    return P.table(spark, sf, "events").groupBy("user_id").agg(x.concat_unique(F.col("event_type")).alias("kinds"))


@query("dose_product", """SELECT event_id, round(value * (event_id % 3 + 1), 6) AS given_dose,
    CASE WHEN event_id % 2 = 0 THEN 'mg' ELSE 'microg' END AS unit FROM events""")
def dose_product(spark, sf):
    unit = F.when(F.col("event_id") % 2 == 0, "mg/ml").otherwise("Microg")
    return P.table(spark, sf, "events").select(
        "event_id", F.round(x.dose(F.col("value"), F.col("event_id") % 3 + 1), 6).alias("given_dose"),
        x.dose_unit(unit).alias("unit"))


@query("ckd_stage", with_views("""SELECT visit_id, CASE WHEN substr(diag_code, 2) IN ('N181', 'N182', 'N183', 'N184', 'N185')
    THEN substr(diag_code, 2) ELSE 'N189' END AS stage FROM diagnoses WHERE diag_code LIKE 'DN18%'""", "diagnoses"))
def ckd_stage(spark, sf):
    kidney = P.diagnoses(spark, sf).filter(F.col("diag_code").startswith("DN18"))
    return kidney.select("visit_id", x.ckd_stage(x.code_part(F.col("diag_code"), 2, 4)).alias("stage"))


WHOLE = """(year(d) - year(b) - CASE WHEN d < CAST(b + to_years(CAST(year(d) - year(b) AS INTEGER)) AS DATE) THEN 1 ELSE 0 END)"""


@query("age_years", with_views(f"""SELECT admission_id, round({WHOLE} + (d - CAST(b + to_years(CAST({WHOLE} AS INTEGER)) AS DATE))::DOUBLE
    / (CAST(b + to_years(CAST({WHOLE} + 1 AS INTEGER)) AS DATE) - CAST(b + to_years(CAST({WHOLE} AS INTEGER)) AS DATE)), 6) AS age
    FROM (SELECT admission_id, date_of_birth AS b, CAST(admission_datetime AS DATE) AS d FROM stays_long
    JOIN person USING (person_id)) x WHERE d >= b""", "stays_long", "person"))
def age_years(spark, sf):
    rows = P.stays_long(spark, sf).join(P.person(spark, sf), "person_id").withColumn("d", F.to_date("admission_datetime"))
    rows = rows.filter(F.col("d") >= F.col("date_of_birth"))
    return rows.select("admission_id", F.round(tm.age_years(F.col("date_of_birth"), F.col("d")), 6).alias("age"))


@query("hours_between", with_views("""SELECT admission_id, date_diff('microsecond', admission_datetime, discharge_datetime)
    // 3600000000 AS hours FROM stays""", "stays"))
def hours_between(spark, sf):
    hours = tm.hours_between(F.col("admission_datetime"), F.col("discharge_datetime"))
    return P.stays(spark, sf).select("admission_id", hours.alias("hours"))


@query("add_time", """SELECT event_id, ts + INTERVAL 30 DAY AS days, ts + to_hours(event_id % 50) AS hours,
    ts - INTERVAL 1 SECOND AS secs FROM events""")
def add_time(spark, sf):
    ts = F.col("ts")
    return P.table(spark, sf, "events").select(
        "event_id", tm.plus(ts, days=30).alias("days"), tm.plus(ts, hours=(F.col("event_id") % 50).cast("int")).alias("hours"),
        tm.plus(ts, seconds=-1).alias("secs"))


@query("cyclic_hour", """SELECT event_id, abs(12 - hour(ts)) AS distance, round(sin(pi() * hour(ts) / 12)
    + cos(pi() * hour(ts) / 12), 6) AS circle FROM events""")
def cyclic_hour(spark, sf):
    return P.table(spark, sf, "events").select(
        "event_id", tm.cyclic_hour(F.col("ts")).alias("distance"), F.round(tm.circle_hour(F.col("ts")), 6).alias("circle"))


@query("weekday_label", "SELECT event_id, lower(substr(dayname(ts), 1, 3)) AS weekday FROM events")
def weekday_label(spark, sf):
    return P.table(spark, sf, "events").select("event_id", tm.weekday(F.col("ts")).alias("weekday"))


@query("date_part", "SELECT event_id, CAST(ts AS DATE) AS day, hour(ts) AS hour, second(ts) AS second FROM events")
def date_part(spark, sf):
    return P.table(spark, sf, "events").select(
        "event_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.second("ts").alias("second"))


# The cut points and labels of count features in the summary table.
COUNT_BREAKS = [float("-inf"), 0, 2, 4, 6, float("inf")]
COUNT_LABELS = ["0", "1-2", "3-4", "5-6", ">6"]


@query("cut_bins", """SELECT p_partkey, CASE WHEN p_size % 9 <= 0 THEN '0' WHEN p_size % 9 <= 2 THEN '1-2' WHEN p_size % 9 <= 4
    THEN '3-4' WHEN p_size % 9 <= 6 THEN '5-6' ELSE '>6' END AS bin FROM part""")
def cut_bins(spark, sf):
    return P.table(spark, sf, "part").select("p_partkey", x.cut(F.col("p_size") % 9, COUNT_BREAKS, COUNT_LABELS).alias("bin"))


@query("coalesce_minmax", """SELECT event_id, least(greatest(coalesce(CASE WHEN event_id % 3 > 0 THEN value END, 10), 5), 60) AS kept
    FROM events""")
def coalesce_minmax(spark, sf):
    value = F.coalesce(F.when(F.col("event_id") % 3 > 0, F.col("value")), F.lit(10.0))
    return P.table(spark, sf, "events").select("event_id", x.clamp(value, 5.0, 60.0).alias("kept"))


@query("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_path(spark, sf):
    return P.table(spark, sf, "events").select("event_id", x.json_num(F.col("props"), "$.k").alias("k"))


@query("json_choice", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE o_custkey % 3 WHEN 0 THEN '32'
    WHEN 1 THEN '64' ELSE '128' END ELSE CAST(o_custkey AS VARCHAR) END AS shown FROM orders""")
def json_choice(spark, sf):
    categorical = '{"name": "CategoricalDistribution", "attributes": {"choices": [32, 64, 128]}}'
    uniform = '{"name": "LogUniformDistribution", "attributes": {"low": 1e-6, "high": 0.1}}'
    k = F.col("o_custkey")
    even = F.col("o_orderkey") % 2 == 0
    shown = x.json_choice(F.when(even, categorical).otherwise(uniform), F.when(even, k % 3).otherwise(k))
    return P.table(spark, sf, "orders").select("o_orderkey", shown.alias("shown"))


@query("json_encode", """SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS json
    FROM orders""")
def json_encode(spark, sf):
    return P.table(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct("o_custkey", "o_orderstatus")).alias("json"))


@query("regex_flag", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|blue)|gear$') THEN 'yes' ELSE 'no' END AS chosen FROM part")
def regex_flag(spark, sf):
    return P.table(spark, sf, "part").select("p_partkey", x.yes_no(F.col("p_name"), "^(red|blue)|gear$").alias("chosen"))


@query("redact_small", """SELECT user_id, CASE WHEN n BETWEEN 1 AND 4 THEN '<5' ELSE CAST(n AS VARCHAR) || ' (x)' END AS cell FROM (
    SELECT user_id, sum(CASE WHEN value > 150 THEN 1 ELSE 0 END) AS n FROM events GROUP BY user_id) t""")
def redact_small(spark, sf):
    counts = P.table(spark, sf, "events").groupBy("user_id").agg(F.sum((F.col("value") > 150).cast("int")).alias("n"))
    cell = F.concat(F.col("n").cast("string"), F.lit(" (x)"))
    return counts.select("user_id", x.redact(cell).alias("cell"))
