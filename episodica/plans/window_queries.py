"""Queries for window operators, sorting, sampling and top-k."""

from pyspark.sql import functions as F

from episodica.operators import cohort as c
from episodica.operators import windows as w
from episodica.operators.quantiles import distinct_values, ntile_by
from episodica.plans import proxies as P
from episodica.plans.proxies import with_views
from episodica.plans.registry import query


@query("washout", with_views("""SELECT admission_id, person_id, admission_datetime, discharge_datetime FROM (
    SELECT *, lag(discharge_datetime) OVER (PARTITION BY person_id ORDER BY admission_datetime, discharge_datetime,
    admission_id) AS prev_end FROM stays_long) t
    WHERE prev_end IS NULL OR admission_datetime - prev_end >= INTERVAL 30 DAY""", "stays_long"))
def washout(spark, sf):
    return c.washout(P.stays_long(spark, sf), 30)


def _seen(spark, sf):
    labs = c.valid_labs(P.labs(spark, sf), P.EGFR_CODES, P.SINCE, P.UNTIL)
    return c.flag_low(c.labs_in_follow_up(labs, P.cohort_of(spark, sf)), "egfr", out="egfr_is_low")


@query("run_id", """SELECT event_id, user_id, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS run_id FROM (SELECT *, CASE WHEN lag(value <= 30) OVER (PARTITION BY user_id
    ORDER BY ts, event_id) IS DISTINCT FROM (value <= 30) THEN 1 ELSE 0 END AS changed FROM events) t""")
def run_id(spark, sf):
    events = P.table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("value") <= 30).alias("low"))
    return c.run_ids(events, "user_id", ["ts", "event_id"], "low").select("event_id", "user_id", "run_id")


@query("era_aggregate", with_views("""SELECT admission_id, person_id, egfr_is_low, los_hours, index_datetime,
    era_start_datetime FROM run_groups""", "run_groups"))
def era_aggregate(spark, sf):
    starts = c.run_starts(
        _seen(spark, sf), "admission_id", ["egfr_datetime", "egfr", "lab_id"], "egfr_is_low")
    return starts.select(
        "admission_id", "person_id", "egfr_is_low", "los_hours", "index_datetime",
        F.col("egfr_datetime").alias("era_start_datetime"))


@query("era_end", """SELECT o_orderkey AS admission_id, o_orderdate AS era_start_datetime, index_datetime, los_hours,
    least(coalesce(nxt - INTERVAL 1 SECOND, index_datetime + to_hours(least(los_hours - 24, 720))),
    index_datetime + to_hours(los_hours), index_datetime + INTERVAL 30 DAY) AS era_end_datetime FROM (
    SELECT *, CAST(25 + o_orderkey % 900 AS BIGINT) AS los_hours, o_orderdate - to_hours(o_orderkey % 48) AS index_datetime,
    lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) t
    WHERE o_orderdate <= index_datetime + to_hours(los_hours)""")
def era_end(spark, sf):
    from episodica.functions.timing import plus
    from episodica.operators.ordered import ordered

    key = F.col("o_orderkey")
    rows = P.table(spark, sf, "orders").select(
        key.alias("admission_id"),
        "o_custkey",
        F.col("o_orderdate").alias("era_start_datetime"),
        plus(F.col("o_orderdate"), hours=-(key % 48).cast("int")).alias("index_datetime"),
        (25 + key % 900).alias("los_hours"),
    )
    linked = ordered(
        rows, ["o_custkey"], ["era_start_datetime", "admission_id"],
        following={"_next": "era_start_datetime"})
    return c.era_bounds(linked).drop("_next", "o_custkey")


@query("egfr_eras", with_views("SELECT * FROM eras", "eras"))
def egfr_eras(spark, sf):
    return P.eras_of(spark, sf)


RUNNING = """SELECT admin_id, admission_id, atc, admin_date, cum_daily_dose FROM (
    SELECT d.admin_id, e.admission_id, d.atc, CAST(d.admin_datetime AS DATE) AS admin_date,
    sum(CAST(round(given_dose * 1000) AS BIGINT)) OVER (PARTITION BY e.admission_id, CAST(d.admin_datetime AS DATE)
    ORDER BY d.admin_datetime, d.admin_id ROWS UNBOUNDED PRECEDING) AS cum_daily_dose
    FROM drug_admins d JOIN spans e ON d.person_id = e.person_id
    AND d.admin_datetime BETWEEN e.era_start_datetime AND e.era_end_datetime) t WHERE cum_daily_dose > 5000"""


@query("running_dose", with_views(RUNNING.replace("cum_daily_dose FROM (", "round(cum_daily_dose / 1000.0::DOUBLE, 6) AS cum_daily_dose FROM (", 1),
    "drug_admins", "stays", spans="""SELECT admission_id, person_id, admission_datetime AS era_start_datetime,
    discharge_datetime AS era_end_datetime FROM stays"""))
def running_dose(spark, sf):
    spans = P.stays(spark, sf).withColumnsRenamed(
        {"admission_datetime": "era_start_datetime", "discharge_datetime": "era_end_datetime"})
    over = w.dose_over_limit(P.drug_admins(spark, sf), spans, 5.0)
    return over.select("admin_id", "admission_id", "atc", "admin_date", F.round("cum_daily_dose", 6).alias("cum_daily_dose"))


@query("ntile_bins", """SELECT event_id, event_type, CASE WHEN rn <= m * (size + 1) THEN ceil(rn / (size + 1.0))
    ELSE m + ceil((rn - m * (size + 1)) / size::DOUBLE) END AS bin FROM (
    SELECT *, n % b AS m, n // b AS size FROM (
    SELECT event_id, event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v, event_id) AS rn,
    count(*) OVER (PARTITION BY event_type) AS n, least(d, 5) AS b FROM (
    SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN event_id % 3 ELSE value END AS v FROM events) e
    JOIN (SELECT event_type, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id % 3 ELSE value END) AS d
    FROM events GROUP BY event_type) s USING (event_type)) x) y""")
def ntile_bins(spark, sf):
    v = F.when(F.col("event_type") == "view", (F.col("event_id") % 3).cast("double")).otherwise(F.col("value"))
    events = P.table(spark, sf, "events").select("event_id", "event_type", v.alias("v"))
    capped = events.join(distinct_values(events, ["event_type"], "v"), "event_type")
    binned = ntile_by(capped, ["event_type"], "v", "event_id", 5, cap="n_values")
    return binned.select("event_id", "event_type", "bin")


@query("top1_per_group", """SELECT study, trial, loss FROM (SELECT o_custkey % 14 AS study, o_orderkey AS trial,
    o_totalprice AS loss, row_number() OVER (PARTITION BY o_custkey % 14 ORDER BY o_totalprice, o_orderkey) AS rn
    FROM orders) t WHERE rn = 1""")
def top1_per_group(spark, sf):
    trials = P.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 14).alias("study"), F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("loss"))
    return w.top_by(trials, ["study"], [F.col("loss"), F.col("trial")], ["trial", "loss"])


@query("diff_lag", """SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6)
    AS diff FROM events""")
def diff_lag(spark, sf):
    events = P.table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = w.diff_lag(events, ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", F.round("diff", 6).alias("diff"))


@query("zscore", """SELECT event_id, round((value - m) / s, 6) AS z FROM events,
    (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) x""")
def zscore(spark, sf):
    out = w.zscore(P.table(spark, sf, "events").select("event_id", "value"), "value", "z")
    return out.select("event_id", F.round("z", 6).alias("z"))


@query("category_code", """SELECT p_partkey, dense_rank() OVER (PARTITION BY p_type ORDER BY p_brand) AS code FROM part""")
def category_code(spark, sf):
    return w.category_code(P.table(spark, sf, "part"), ["p_type"], "p_brand").select("p_partkey", "code")


@query("min_max_scale", """SELECT event_id, round((value - lo) / nullif(hi - lo, 0), 6) AS scaled FROM events JOIN
    (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type) r USING (event_type)""")
def min_max_scale(spark, sf):
    out = w.min_max_scale(P.table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value", "scaled")
    return out.select("event_id", F.round("scaled", 6).alias("scaled"))


@query("first_seen_flag", """SELECT id, dataset, CASE WHEN row_number() OVER (PARTITION BY dataset, person ORDER BY id) = 1
    THEN 1 ELSE 0 END AS n_persons FROM (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test'
    ELSE 'test_new' END AS dataset, o_custkey AS person FROM orders) t""")
def first_seen_flag(spark, sf):
    rows = P.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        P.pick(["dev", "test", "test_new"], (F.col("o_custkey") % 3).cast("int")).alias("dataset"),
        F.col("o_custkey").alias("person"),
    )
    return w.first_seen(rows, ["person"], ["dataset"], "id", "n_persons").select("id", "dataset", "n_persons")


@query("group_range", "SELECT event_type, min(value) AS y_min, max(value) AS y_max FROM events GROUP BY event_type")
def group_range(spark, sf):
    return w.group_range(P.table(spark, sf, "events"), ["event_type"], "value")
