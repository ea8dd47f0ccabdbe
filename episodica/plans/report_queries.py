"""Queries for summary tables, tuning reports and figure data."""

from pyspark.sql import functions as F

from episodica.functions.text import cut, feature_title, redact
from episodica.operators import explain as ex
from episodica.operators import metrics as m
from episodica.operators import models as md
from episodica.operators import report as rp
from episodica.operators.quantiles import exact_quantiles
from episodica.operators.windows import carry_label, first_seen
from episodica.plans import proxies as P
from episodica.plans.metric_queries import BY, rounded
from episodica.plans.proxies import with_views
from episodica.plans.registry import query
from episodica.plans.scalar_queries import COUNT_BREAKS, COUNT_LABELS
from episodica.session import durable

SETS = ["dev", "test", "test_new"]


@query("quantile_by", """SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
    round(quantile_cont(value, 0.999), 6) AS q999 FROM events GROUP BY event_type""")
def quantile_by(spark, sf):
    out = exact_quantiles(P.table(spark, sf, "events"), ["event_type"], "value", {"q25": 0.25, "q50": 0.5, "q999": 0.999})
    return rounded(out, "q25", "q50", "q999")


def summary_rows(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = P.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        P.pick(SETS, (F.col("user_id") % 3).cast("int")).alias("set"),
        F.col("user_id").alias("person_id"),
        F.col("value").alias("time_at_risk"),
        k.cast("double").alias("age_at_admission"),
        (F.col("value") > 100).cast("int").alias("daily_rate_not_zero"),
        cut(k % 9, COUNT_BREAKS, COUNT_LABELS).alias("r"),
    )
    return durable(first_seen(rows, ["person_id"], ["set"], "id", "n_persons"), "summary")


SUMMARY = """SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'test_new' END AS "set",
    value AS time_at_risk, k::DOUBLE AS age_at_admission, CAST(value > 100 AS INTEGER) AS daily_rate_not_zero,
    CASE WHEN k % 9 <= 0 THEN '0' WHEN k % 9 <= 2 THEN '1-2' WHEN k % 9 <= 4 THEN '3-4' WHEN k % 9 <= 6 THEN '5-6' ELSE '>6' END AS r,
    CAST(row_number() OVER (PARTITION BY user_id % 3, user_id ORDER BY event_id) = 1 AS INTEGER) AS n_persons
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e"""
NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("median", "q1", "q3", "mean", "sd"))


def _levels(col):
    return f"""SELECT "set", '{col}' AS variable, CAST({col} AS VARCHAR) AS level, count(*)::DOUBLE AS n,
        round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY "set"), 6) AS percent, {NULLS} FROM summary GROUP BY "set", {col}"""


@query("table_one", with_views(f"""SELECT "set", 'n' AS variable, NULL AS level, count(*)::DOUBLE AS n, NULL AS percent, {NULLS}
    FROM summary GROUP BY "set" UNION ALL {_levels('daily_rate_not_zero')} UNION ALL {_levels('r')} UNION ALL {_levels('n_persons')}
    UNION ALL SELECT "set", 'time_at_risk', NULL, NULL, NULL, round(quantile_cont(time_at_risk, 0.5), 6),
    round(quantile_cont(time_at_risk, 0.25), 6), round(quantile_cont(time_at_risk, 0.75), 6), NULL, NULL FROM summary GROUP BY "set"
    UNION ALL SELECT "set", 'age_at_admission', NULL, NULL, NULL, NULL, NULL, NULL, round(avg(age_at_admission), 6),
    round(stddev_samp(age_at_admission), 6) FROM summary GROUP BY "set" """, summary=SUMMARY))
def table_one(spark, sf):
    out = rp.table_one(summary_rows(spark, sf), "set", ["daily_rate_not_zero", "r", "n_persons"], ["time_at_risk"], ["age_at_admission"])
    return rounded(out, "percent", "median", "q1", "q3", "mean", "sd")


@query("print_table")
def print_table(spark, sf):
    table = durable(rp.table_one(
        summary_rows(spark, sf), "set", ["daily_rate_not_zero", "r", "n_persons"], ["time_at_risk"], ["age_at_admission"]), "table")
    order = ["n", "n_persons", "age_at_admission", "time_at_risk", "r", "daily_rate_not_zero"]
    printed = rp.print_table(table, "set", SETS, order)
    return printed.withColumns({s: redact(F.col(s)) for s in SETS})


@query("carry_label", """SELECT n_nationkey, last_value(CASE WHEN n_nationkey % 5 = 0 THEN n_name END IGNORE NULLS) OVER (ORDER BY n_nationkey
    ROWS UNBOUNDED PRECEDING) AS label FROM nation""")
def carry(spark, sf):
    nations = P.table(spark, sf, "nation").withColumn("head", F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")))
    return carry_label(nations, "head", "n_nationkey", "label").select("n_nationkey", "label")


def trial_tables(spark, sf):
    """Studies, trials, parameters and losses, read off the orders."""
    orders = P.table(spark, sf, "orders")
    name = P.pick(["binary__mlp__daily_rate_geq_1", "binary__linear__daily_rate_not_zero", "refmodel__mlp__daily_rate_geq_1"],
                  F.col("study_id").cast("int"))
    trials = orders.select(
        F.col("o_orderkey").alias("trial_id"), (F.col("o_custkey") % 3).alias("study_id"),
        F.floor(F.col("o_orderkey") / 3).cast("long").alias("number"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "P", "PRUNED").otherwise("FAIL").alias("state"))
    studies = trials.select("study_id").distinct().withColumn("study_name", name)
    categorical = '{"name": "CategoricalDistribution", "attributes": {"choices": [%s]}}'
    params = orders.select(
        F.col("o_orderkey").alias("trial_id"),
        F.inline(F.array(
            F.struct(F.lit("batch_size").alias("param_name"), (F.col("o_orderkey") % 5).cast("double").alias("param_value"),
                     F.lit(categorical % "32, 64, 128, 256, 512").alias("distribution_json")),
            F.struct(F.lit("class_handling").alias("param_name"), (F.col("o_custkey") % 3).cast("double").alias("param_value"),
                     F.lit(categorical % '"random_over", "none", "class_weighting"').alias("distribution_json")),
            F.struct(F.lit("n_hidden_layers").alias("param_name"), (F.col("o_orderkey") % 4 + 1).cast("double").alias("param_value"),
                     F.lit('{"name": "IntUniformDistribution"}').alias("distribution_json")),
        )))
    values = orders.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("trial_id"), F.col("o_totalprice").alias("value"))
    best = trials.join(values, "trial_id").groupBy("study_id").agg(F.min_by("trial_id", F.struct("value", "trial_id")).alias("trial_id"))
    return studies, trials, params, values, best.join(studies, "study_id").select("study_name", "trial_id")


STUDIES = """SELECT o_orderkey AS trial_id, CASE o_custkey % 3 WHEN 0 THEN 'binary__mlp__daily_rate_geq_1'
    WHEN 1 THEN 'binary__linear__daily_rate_not_zero' ELSE 'refmodel__mlp__daily_rate_geq_1' END AS study_name, CASE WHEN o_orderkey % 11 <> 0
    THEN o_totalprice END AS value, o_custkey, o_orderkey, o_orderkey // 3 AS trial_number FROM orders"""


@query("learning_report", with_views("""SELECT study_name, param_name, trial_id, trial_number, real_param_value, value IS NULL AS loss_missing,
    CASE WHEN param_name = 'class_handling' THEN dense_rank() OVER (PARTITION BY study_name, param_name ORDER BY real_param_value)
    ELSE CAST(CASE WHEN param_name = 'class_handling' THEN NULL ELSE real_param_value END AS DOUBLE) END AS y, value AS metric_value,
    trial_id = first_value(trial_id) OVER (PARTITION BY study_name ORDER BY value, trial_id) AS is_best,
    value > quantile_cont(value, 0.75) OVER (PARTITION BY study_name, param_name) AS above_q75 FROM (
    SELECT study_name, 'batch_size' AS param_name, trial_id, trial_number, CASE o_orderkey % 5 WHEN 0 THEN '32' WHEN 1 THEN '64' WHEN 2 THEN '128'
        WHEN 3 THEN '256' ELSE '512' END AS real_param_value, value FROM st
    UNION ALL SELECT study_name, 'class_handling', trial_id, trial_number, CASE o_custkey % 3 WHEN 0 THEN 'random_over' WHEN 1 THEN 'none'
        ELSE 'class_weighting' END, value FROM st
    UNION ALL SELECT study_name, 'n_hidden_layers', trial_id, trial_number, CAST(o_orderkey % 4 + 1 AS VARCHAR) || '.0', value FROM st) t""", st=STUDIES))
def learning_report(spark, sf):
    return rp.trial_report(*trial_tables(spark, sf))


@query("state_counts", """SELECT CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'P' THEN 'PRUNED' ELSE 'FAIL' END AS state,
    count(*) AS n_trials FROM orders GROUP BY 1""")
def state_counts(spark, sf):
    return rp.state_counts(trial_tables(spark, sf)[1])


def training_summaries(spark, sf):
    """Five folds per trial with the loss in JSON text."""
    folds = P.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 14).alias("s"), F.col("o_orderkey").alias("trial_number"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("cv_fold"))
    loss = ((F.col("trial_number") * 31 + F.col("cv_fold") * 17) % 1000) / 1000
    return folds.select(
        F.concat(F.lit("study_"), F.col("s").cast("string")).alias("study_name"), "trial_number", "cv_fold",
        F.lit("{}").alias("hyperparameters"), F.to_json(F.struct(loss.alias("loss"))).alias("eval_val"))


FOLD_LOSS = """SELECT 'study_' || o_custkey % 14 AS study_name, o_orderkey AS trial_number, f AS cv_fold,
    ((o_orderkey * 31 + f * 17) % 1000) / 1000.0::DOUBLE AS loss FROM orders, (VALUES (1), (2), (3), (4), (5)) v(f)"""


@query("cv_mean", with_views("""SELECT study_name, trial_number, round(avg(loss), 6) AS mean_loss FROM fl GROUP BY ALL""", fl=FOLD_LOSS))
def cv_mean(spark, sf):
    return rounded(md.cv_means(training_summaries(spark, sf)), "mean_loss")


@query("best_trial", with_views("""SELECT study_name, trial_number, mean_loss FROM (SELECT *, row_number() OVER (PARTITION BY study_name
    ORDER BY mean_loss, trial_number) AS rn FROM (SELECT study_name, trial_number, round(sum(round(loss * 1000)) / 5000, 6) AS mean_loss FROM fl
    GROUP BY ALL) a) t WHERE rn = 1""", fl=FOLD_LOSS))
def best_trial(spark, sf):
    from episodica.operators.windows import top_by

    means = rounded(md.cv_means(training_summaries(spark, sf)), "mean_loss")
    return top_by(means, ["study_name"], [F.col("mean_loss"), F.col("trial_number")], ["trial_number", "mean_loss"])


FEATURES = ["n_previous_admissions", "age_at_admission", "atc_level2_N02", "n18_diag_N182", "icd10_chapter_14"]
ATC_NAMES = {"N02": "Analgesics", "A10": "Drugs used in diabetes"}
CHAPTER_NAMES = {"14": "Genitourinary"}
KIDNEY_NAMES = {"N182": "Chronic kidney disease, stage 2"}
WEIGHTS = {"n_previous_admissions": 0.02, "age_at_admission": 0.001, "atc_level2_N02": 0.05, "n18_diag_N182": -0.03, "icd10_chapter_14": 0.01}


def shap_tables(spark, sf):
    """Feature values per event and contributions of a fixed linear rule to them."""
    k = F.get_json_object("props", "$.k").cast("int")
    data = P.table(spark, sf, "events").select(
        F.col("event_id").alias("admission_id"), (k % 7).cast("double").alias(FEATURES[0]), F.col("value").alias(FEATURES[1]),
        (k % 2).cast("double").alias(FEATURES[2]), (F.col("user_id") % 2).cast("double").alias(FEATURES[3]),
        (F.col("event_id") % 3 == 0).cast("double").alias(FEATURES[4]))
    wobble = 1 + (F.col("admission_id") % 5) / 10
    shap = data.select("admission_id", *[(F.col(c) * WEIGHTS[c] * wobble).alias(c) for c in FEATURES])
    return shap, data


def shap_rows(spark, sf):
    shap, data = shap_tables(spark, sf)
    long = ex.explain_long(shap, data, FEATURES, [])
    return durable(long.withColumn("feature_pretty", ex.pretty_feature(F.col("feature"), ATC_NAMES, KIDNEY_NAMES, CHAPTER_NAMES)), "long")


PRETTY = ["DEMO/CLIN: No. previous admissions", "DEMO/CLIN: Age at admission", "MED: Analgesics",
          "DX: Chronic kidney disease, stage 2", "DX: Genitourinary"]
EXPR = ["(k % 7)::DOUBLE", "value", "(k % 2)::DOUBLE", "(user_id % 2)::DOUBLE", "(event_id % 3 = 0)::INTEGER::DOUBLE"]
UNFOLDED = " UNION ALL ".join(
    f"""SELECT event_id AS admission_id, '{pretty}' AS feature_pretty, {e} AS v, ({e}) * {WEIGHTS[f]} * (1 + (event_id % 5) / 10.0::DOUBLE)
    AS shap_value FROM ev""" for f, pretty, e in zip(FEATURES, PRETTY, EXPR))


SHAP_BINS = """SELECT admission_id, feature_pretty, shap_value, v, d = 2 AS feature_is_binary,
    CASE WHEN d = 2 THEN v ELSE CASE WHEN rn <= mm * (size + 1) THEN ceil(rn / (size + 1.0))
    ELSE mm + ceil((rn - mm * (size + 1)) / size::DOUBLE) END END AS feature_value_bin FROM (
    SELECT *, n % b AS mm, n // b AS size FROM (SELECT admission_id, feature_pretty, shap_value, (v - lo) / (hi - lo) AS v, d, n, least(d, 5) AS b,
    row_number() OVER (PARTITION BY feature_pretty ORDER BY v, admission_id) AS rn FROM u JOIN (SELECT feature_pretty, count(DISTINCT v) AS d,
    count(*) AS n, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1) s USING (feature_pretty)) x) y"""


@query("shap_long", with_views("""SELECT admission_id, feature_pretty, round(shap_value, 6) AS shap_value, round(v, 6) AS feature_value,
    feature_is_binary, round(feature_value_bin, 6) AS feature_value_bin FROM binned""",
    ev="SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", u=UNFOLDED, binned=SHAP_BINS))
def shap_long(spark, sf):
    binned = ex.binned_features(shap_rows(spark, sf), ["feature_pretty"], "admission_id")
    return rounded(binned, "shap_value", "feature_value", "feature_value_bin").select(
        "admission_id", "feature_pretty", "shap_value", "feature_value", "feature_is_binary", "feature_value_bin")


@query("group_mean", with_views("""SELECT feature_pretty, CAST(floor(v / 10) AS BIGINT) AS bin, round(avg(shap_value), 6) AS shap_value
    FROM u GROUP BY ALL""", ev="SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", u=UNFOLDED))
def group_mean(spark, sf):
    tens = F.floor(F.col("feature_value") / 10).alias("bin")
    return rounded(shap_rows(spark, sf).groupBy("feature_pretty", tens).agg(F.avg("shap_value").alias("shap_value")), "shap_value")


@query("shap_summary", with_views("""SELECT feature_pretty, round(feature_value_bin, 6) AS feature_value_bin, round(s, 6) AS shap_value,
    round(m, 6) AS feature_value, round((m - min(m) OVER g) / nullif(max(m) OVER g - min(m) OVER g, 0), 6) AS colour_var FROM (
    SELECT feature_pretty, feature_value_bin, avg(shap_value) AS s, avg(v) AS m FROM binned GROUP BY ALL) x
    WINDOW g AS (PARTITION BY feature_pretty)""",
    ev="SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", u=UNFOLDED, binned=SHAP_BINS))
def shap_summary(spark, sf):
    binned = ex.binned_features(shap_rows(spark, sf), ["feature_pretty"], "admission_id")
    return rounded(ex.summary_by_bin(binned, ["feature_pretty"]), "feature_value_bin", "shap_value", "feature_value", "colour_var")


@query("bivariate_ranges", with_views("""SELECT feature_pretty, v AS feature_value, round(min(shap_value) - 3 * bw, 5) AS y_min,
    round(max(shap_value) + 3 * bw, 5) AS y_max FROM kept JOIN (SELECT feature_pretty, v, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0
    THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd WHEN lo <> 0 THEN abs(lo) ELSE 1 END * pow(n, -0.2) AS bw FROM (
    SELECT feature_pretty, v, count(*) AS n, stddev_samp(shap_value) AS sd, min(shap_value) AS lo, quantile_cont(shap_value, 0.75)
    - quantile_cont(shap_value, 0.25) AS iqr FROM kept GROUP BY ALL) s) b USING (feature_pretty, v) GROUP BY feature_pretty, v, bw""",
    ev="SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", u=UNFOLDED,
    kept="""SELECT u.* FROM u JOIN (SELECT feature_pretty FROM u GROUP BY 1 HAVING bool_and(v IN (0, 1))) b USING (feature_pretty)"""))
def bivariate_ranges(spark, sf):
    _, ranges, _ = ex.bivariate_data(shap_rows(spark, sf), [], "feature_pretty", "admission_id")
    return rounded(ranges, "y_min", "y_max", places=5)


@query("bivariate_trends")
def bivariate_trends(spark, sf):
    _, _, trends = ex.bivariate_data(shap_rows(spark, sf), [], "feature", "admission_id")
    return rounded(trends.withColumn("feature", feature_title(F.col("feature"))), "x_mid", "y_smooth")


SHAP_POINTS = 1000


@query("shap_density", with_views(f"""SELECT feature_pretty, round(m, 6) AS mean_feature_value, g AS place, round(dens, 5) AS dens FROM (
    SELECT feature_pretty, m, g, raw / max(raw) OVER (PARTITION BY feature_pretty, m) AS dens FROM (
    SELECT feature_pretty, m, g, sum(w * exp(-0.5 * pow((g - i) * step / bw, 2))) AS raw
    FROM weights JOIN bands USING (feature_pretty, m), ends, range({SHAP_POINTS}) t(g) GROUP BY feature_pretty, m, g) r) d
    WHERE dens >= 0.001""",
    ev="SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", u=UNFOLDED, binned=SHAP_BINS,
    means="SELECT feature_pretty, feature_value_bin, avg(v) AS m FROM binned GROUP BY ALL",
    b="SELECT feature_pretty, m, shap_value FROM binned JOIN means USING (feature_pretty, feature_value_bin)",
    ends=f"SELECT min(shap_value) AS lo, (max(shap_value) - min(shap_value)) / {SHAP_POINTS - 1} AS step FROM b",
    bands="""SELECT feature_pretty, m, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd
        WHEN lo <> 0 THEN abs(lo) ELSE 1 END * pow(n, -0.2) AS bw FROM (SELECT feature_pretty, m, count(*) AS n,
        stddev_samp(shap_value) AS sd, min(shap_value) AS lo, quantile_cont(shap_value, 0.75) - quantile_cont(shap_value, 0.25) AS iqr
        FROM b GROUP BY feature_pretty, m) s""",
    spot=f"""SELECT feature_pretty, m, (shap_value - lo) / step AS pos, least(floor((shap_value - lo) / step), {SHAP_POINTS - 2}) AS below
        FROM b, ends""",
    weights="""SELECT feature_pretty, m, i, sum(w) AS w FROM (SELECT feature_pretty, m, below AS i, 1 - (pos - below) AS w FROM spot
        UNION ALL SELECT feature_pretty, m, below + 1, pos - below FROM spot) s GROUP BY feature_pretty, m, i"""))
def shap_density(spark, sf):
    binned = durable(ex.binned_features(shap_rows(spark, sf), ["feature_pretty"], "admission_id"), "binned")
    out = ex.shap_density(binned, n=SHAP_POINTS)
    low = binned.agg(F.min("shap_value")).first()[0]
    place = F.round((F.col("shap_value") - F.lit(low)) / F.col("tile_width")).cast("long")
    kept = out.filter(F.col("dens") >= 0.001)
    return kept.select("feature_pretty", F.round("mean_feature_value", 6).alias("mean_feature_value"), place.alias("place"),
                       F.round("dens", 5).alias("dens"))


@query("report")
def report(spark, sf):
    """Every report table in one long form: (section, item, name, value)."""
    preds = durable(P.predictions(spark, sf), "predictions")
    study = F.concat_ws(" / ", *BY)

    def section(df, title, label, value, item=study):
        return df.select(F.lit(title).alias("section"), item.alias("item"), label.alias("name"), value.cast("double").alias("value"))

    bins = durable(m.with_jeffreys(m.calibration(preds, BY, "id")), "bins")
    limits = durable(m.net_benefit_limits(preds, BY), "limits")
    roc = durable(m.roc(preds, BY).filter("cutoff is not null"), "roc")
    metrics = durable(m.evaluation_metrics(preds), "metrics")
    table = durable(rp.table_one(
        summary_rows(spark, sf), "set", ["daily_rate_not_zero", "r", "n_persons"], ["time_at_risk"], ["age_at_admission"]), "table")
    binned = ex.binned_features(shap_rows(spark, sf), ["feature_pretty"], "admission_id")
    shap = durable(ex.summary_by_bin(binned, ["feature_pretty"]), "shap")
    trials = durable(rp.trial_report(*trial_tables(spark, sf)).filter("is_best"), "trials")

    bin_no = F.concat(F.lit("bin "), F.col("q").cast("string"))
    at = F.concat_ws(" at ", "model", F.col("threshold").cast("string"))
    cutoff = F.concat(F.lit("at "), F.col("cutoff").cast("string"))
    line = F.concat_ws(" ", "variable", "level")
    parts = [section(bins, f"calibration {name}", bin_no, F.col(c)) for name, c in (
        ("predicted", "y_pred"), ("observed", "y_true"), ("lower", "y_true_lo"), ("upper", "y_true_hi"))]
    parts.append(section(m.net_benefit(preds, BY), "decision curve", at, F.col("snb")))
    parts += [section(limits, f"decision curve {c[4:]}", at, F.col(c)) for c in ("snb_lower", "snb_upper")]
    parts += [section(roc, f"roc {c}", cutoff, F.col(c)) for c in ("fpr", "tpr")]
    parts += [section(metrics, "metrics", F.lit(c), F.col(c)) for c in ("threshold", "auroc", "avg_prec_score", "mcc", "precision", "recall")]
    parts += [section(table.filter(F.col(c).isNotNull()), f"table one {c}", line, F.col(c), F.col("set")) for c in (
        "n", "percent", "median", "q1", "q3", "mean", "sd")]
    value_bin = F.concat(F.lit("value bin "), F.col("feature_value_bin").cast("string"))
    parts += [section(shap, f"contributions {name}", value_bin, F.col(c), F.col("feature_pretty")) for name, c in (
        ("mean", "shap_value"), ("colour", "colour_var"))]
    parts.append(section(trials, "tuning best loss", F.col("param_name"), F.col("metric_value"), F.col("study_name")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out, "value")
