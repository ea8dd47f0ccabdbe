"""Queries for evaluation measures over the predictions view."""

from pyspark.sql import functions as F

from episodica.operators import metrics as m
from episodica.plans import proxies as P
from episodica.plans.proxies import with_views
from episodica.plans.registry import query

BY = ["study_name", "dataset"]


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


SCORES = """SELECT study_name, dataset, y_pred AS score, sum(y_true) AS pos, sum(1 - y_true) AS neg
    FROM predictions GROUP BY study_name, dataset, y_pred"""
TABLE = """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS n_pos, sum(neg) OVER g AS n_neg
    FROM scores WINDOW w AS (PARTITION BY study_name, dataset ORDER BY score DESC),
    g AS (PARTITION BY study_name, dataset)"""
AREAS = """SELECT study_name, dataset, sum(pos * (n_neg - fp + neg / 2.0)) / max(n_pos * n_neg) AS auroc,
    sum(pos * tp / (tp + fp)) / max(n_pos) AS avg_prec_score FROM tab GROUP BY study_name, dataset"""
THRESHOLDS = """SELECT study_name, dataset, t.k, t.k * (1.0::DOUBLE / 100) AS threshold,
    sum(CASE WHEN y_pred > t.k * (1.0::DOUBLE / 100) AND y_true = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
    sum(CASE WHEN y_pred > t.k * (1.0::DOUBLE / 100) AND y_true = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
    sum(y_true)::DOUBLE AS n_pos, sum(1 - y_true)::DOUBLE AS n_neg
    FROM predictions, range(100) t(k) WHERE dataset = 'dev' GROUP BY ALL"""
MCC = """SELECT *, CASE WHEN (tp + fp) * n_pos * n_neg * (n_pos + n_neg - tp - fp) = 0 THEN 0 ELSE
    (tp * (n_neg - fp) - fp * (n_pos - tp)) / sqrt((tp + fp) * n_pos * n_neg * (n_pos + n_neg - tp - fp)) END AS mcc
    FROM thresholds"""
BEST = """SELECT study_name, threshold, mcc FROM (SELECT *, row_number() OVER (PARTITION BY study_name
    ORDER BY round(mcc, 9) DESC, threshold) AS rn FROM mccs) x WHERE rn = 1"""


@query("calibration_bins", with_views("""SELECT study_name, dataset, q, round(avg(y_pred), 6) AS y_pred,
    round(avg(y_true), 6) AS y_true, sum(y_true) AS events, sum(1 - y_true) AS non_events FROM (
    SELECT *, ntile(10) OVER (PARTITION BY study_name, dataset ORDER BY y_pred, id) AS q FROM predictions) x
    GROUP BY study_name, dataset, q""", "predictions"))
def calibration_bins(spark, sf):
    return rounded(m.calibration(P.predictions(spark, sf), BY, "id"), "y_pred", "y_true")


# sin^(2 events) cos^(2 non-events) summed over a fine grid of angles is the beta distribution with halves added
JEFFREYS = """SELECT study_name, dataset, q, round(y_pred, 6) AS y_pred, round(y_true, 6) AS y_true, events, non_events,
    round(max(x) FILTER (part = 0.025), 6) AS y_true_lo, round(max(x) FILTER (part = 0.975), 6) AS y_true_hi FROM bins JOIN (
    SELECT study_name, dataset, q, part, pow(sin((j + (part * total - upto + w) / w) * pi() / 2 / 100000), 2) AS x
    FROM upto_angle, (VALUES (0.025::DOUBLE), (0.975::DOUBLE)) p(part) WHERE part * total <= upto AND part * total > upto - w) l
    USING (study_name, dataset, q) GROUP BY ALL"""
BINS = """SELECT study_name, dataset, q, avg(y_pred) AS y_pred, avg(y_true) AS y_true, sum(y_true)::BIGINT AS events,
    sum(1 - y_true)::BIGINT AS non_events FROM (SELECT *, ntile(10) OVER (PARTITION BY study_name, dataset
    ORDER BY y_pred, id) AS q FROM predictions) x GROUP BY study_name, dataset, q"""
ANGLES = """SELECT *, exp(l - max(l) OVER (PARTITION BY study_name, dataset, q)) AS w FROM (SELECT study_name, dataset, q, j,
    2 * events * ln(sin((j + 0.5) * pi() / 2 / 100000)) + 2 * non_events * ln(cos((j + 0.5) * pi() / 2 / 100000)) AS l
    FROM bins, range(100000) g(j)) d"""
UPTO_ANGLE = """SELECT *, sum(w) OVER (PARTITION BY study_name, dataset, q ORDER BY j) AS upto,
    sum(w) OVER (PARTITION BY study_name, dataset, q) AS total FROM angles WHERE w > 1e-30"""


@query("calibration_jeffreys", with_views(JEFFREYS, "predictions", bins=BINS, angles=ANGLES, upto_angle=UPTO_ANGLE))
def calibration_jeffreys(spark, sf):
    bins = m.with_jeffreys(m.calibration(P.predictions(spark, sf), BY, "id"))
    return rounded(bins, "y_pred", "y_true", "y_true_lo", "y_true_hi")


@query("binary_metrics", with_views("""SELECT study_name, dataset, threshold, round(auroc, 6) AS auroc,
    round(avg_prec_score, 6) AS avg_prec_score,
    round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
    round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM areas JOIN (
    SELECT study_name, dataset, round(threshold, 6) AS threshold,
    sum(CASE WHEN y_pred > threshold AND y_true = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
    sum(CASE WHEN y_pred > threshold AND y_true = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
    sum(CASE WHEN y_pred <= threshold AND y_true = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn,
    sum(CASE WHEN y_pred <= threshold AND y_true = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn
    FROM predictions JOIN best USING (study_name) GROUP BY ALL) c USING (study_name, dataset)""",
    "predictions", scores=SCORES, tab=TABLE, areas=AREAS, thresholds=THRESHOLDS, mccs=MCC, best=BEST))
def binary_metrics(spark, sf):
    out = m.evaluation_metrics(P.predictions(spark, sf))
    return rounded(out, "threshold", "auroc", "avg_prec_score", "mcc", "precision", "recall")


@query("mcc_threshold", with_views("SELECT study_name, round(threshold, 6) AS threshold, round(mcc, 6) AS mcc FROM best",
    "predictions", thresholds=THRESHOLDS, mccs=MCC, best=BEST))
def mcc_threshold(spark, sf):
    dev = P.predictions(spark, sf).filter(F.col("dataset") == "dev")
    return rounded(m.best_threshold(m.score_counts(dev, ["study_name"]), ["study_name"]), "threshold", "mcc")


@query("mcc_threshold_last_positive", with_views("""SELECT study_name,
    round(coalesce(max(CASE WHEN mcc > 0 THEN threshold END), 0), 6) AS threshold FROM mccs GROUP BY study_name""",
    "predictions", thresholds=THRESHOLDS, mccs=MCC))
def mcc_threshold_last_positive(spark, sf):
    dev = P.predictions(spark, sf).filter(F.col("dataset") == "dev")
    return rounded(m.best_threshold(m.score_counts(dev, ["study_name"]), ["study_name"], mode="reference"), "threshold")


@query("roc_curve", with_views("""SELECT study_name, dataset, score AS cutoff, round(fp / n_neg, 6) AS fpr,
    round(tp / n_pos, 6) AS tpr FROM tab UNION ALL SELECT DISTINCT study_name, dataset, NULL, 0, 0 FROM tab""",
    "predictions", scores=SCORES, tab=TABLE))
def roc_curve(spark, sf):
    return rounded(m.roc(P.predictions(spark, sf), BY), "fpr", "tpr")


COUNTS = """SELECT study_name, dataset, t.k / 10.0::DOUBLE AS threshold, count(*)::DOUBLE AS n,
    sum(y_true)::DOUBLE AS n_pos, avg(y_true) AS prevalence,
    sum(CASE WHEN y_pred >= t.k / 10.0::DOUBLE THEN y_true ELSE 0 END)::DOUBLE AS tp,
    sum(CASE WHEN y_pred >= t.k / 10.0::DOUBLE THEN 1 - y_true ELSE 0 END)::DOUBLE AS fp
    FROM predictions, range(11) t(k) GROUP BY study_name, dataset, t.k"""


@query("decision_curve", with_views("""SELECT study_name, dataset, threshold, model, round(nb, 6) AS nb,
    round(nb / prevalence, 6) AS snb FROM (
    SELECT study_name, dataset, threshold, prevalence, 'Prediction model' AS model,
        tp / n - fp / n * threshold / nullif(1 - threshold, 0) AS nb FROM counts
    UNION ALL SELECT study_name, dataset, threshold, prevalence, 'All',
        n_pos / n - (n - n_pos) / n * threshold / nullif(1 - threshold, 0) FROM counts
    UNION ALL SELECT study_name, dataset, threshold, prevalence, 'None', 0 FROM counts) x""", "predictions",
    counts=COUNTS))
def decision_curve(spark, sf):
    return rounded(m.net_benefit(P.predictions(spark, sf), BY), "nb", "snb")


REPLICATES = 500
CELLS = """SELECT study_name, dataset, bucket, outcome, count(*) AS n FROM (SELECT study_name, dataset, y_true AS outcome,
    len(list_filter(range(11), lambda t: y_pred >= t / 10.0::DOUBLE)) AS bucket FROM predictions) x GROUP BY ALL"""
POISSON = """SELECT study_name, dataset, bucket, outcome, k, sum(w) OVER c / sum(w) OVER g AS upto FROM (
    SELECT *, exp(l - max(l) OVER (PARTITION BY study_name, dataset, bucket, outcome)) AS w FROM (
    SELECT *, sum(CASE WHEN k = least_k THEN 0 ELSE ln(n::DOUBLE) - ln(k::DOUBLE) END) OVER (
        PARTITION BY study_name, dataset, bucket, outcome ORDER BY k) AS l FROM (
    SELECT *, unnest(range(least_k, ceil(n + 12 * sqrt(n) + 12)::BIGINT + 1)) AS k FROM (
        SELECT *, greatest(0, floor(n - 12 * sqrt(n) - 12))::BIGINT AS least_k FROM cells) a) b) d) e
    WINDOW c AS (PARTITION BY study_name, dataset, bucket, outcome ORDER BY k),
    g AS (PARTITION BY study_name, dataset, bucket, outcome)"""
DRAWS = f"""SELECT d.study_name, d.dataset, d.bucket, d.outcome, replicate, k AS drawn FROM (SELECT *, ('0x' || substr(md5(study_name || '|'
    || dataset || '|' || bucket || '|' || outcome || '|' || replicate || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
    FROM cells, range(1, {REPLICATES + 1}) r(replicate)) d ASOF JOIN poisson p ON d.study_name = p.study_name
    AND d.dataset = p.dataset AND d.bucket = p.bucket AND d.outcome = p.outcome AND d.u < p.upto"""
AGAIN = """SELECT study_name, dataset, replicate, t.k / 10.0::DOUBLE AS threshold, sum(drawn)::DOUBLE AS n,
    sum(drawn * outcome)::DOUBLE AS n_pos, sum(CASE WHEN bucket > t.k THEN drawn * outcome ELSE 0 END)::DOUBLE AS tp,
    sum(CASE WHEN bucket > t.k THEN drawn * (1 - outcome) ELSE 0 END)::DOUBLE AS fp
    FROM draws, range(11) t(k) GROUP BY study_name, dataset, replicate, t.k"""
LIMITS = """SELECT study_name, dataset, threshold, model, quantile_cont(snb, 0.025) AS snb_lower, quantile_cont(snb, 0.975) AS snb_upper
    FROM (SELECT study_name, dataset, threshold, 'Prediction model' AS model,
        (tp / n - fp / n * threshold / nullif(1 - threshold, 0)) / nullif(n_pos / n, 0) AS snb FROM again
    UNION ALL SELECT study_name, dataset, threshold, 'All',
        (n_pos / n - (n - n_pos) / n * threshold / nullif(1 - threshold, 0)) / nullif(n_pos / n, 0) FROM again) s GROUP BY ALL"""


@query("decision_ci", with_views("""SELECT study_name, dataset, threshold, model, round(nb, 6) AS nb, round(nb / prevalence, 6) AS snb,
    round(snb_lower, 6) AS snb_lower, round(snb_upper, 6) AS snb_upper FROM (
    SELECT study_name, dataset, threshold, prevalence, 'Prediction model' AS model,
        tp / n - fp / n * threshold / nullif(1 - threshold, 0) AS nb FROM counts
    UNION ALL SELECT study_name, dataset, threshold, prevalence, 'All',
        n_pos / n - (n - n_pos) / n * threshold / nullif(1 - threshold, 0) FROM counts) x
    JOIN limits USING (study_name, dataset, threshold, model)""", "predictions",
    counts=COUNTS, cells=CELLS, poisson=POISSON, draws=DRAWS, again=AGAIN, limits=LIMITS))
def decision_ci(spark, sf):
    preds = P.predictions(spark, sf)
    limits = m.net_benefit_limits(preds, BY, replicates=REPLICATES)
    return rounded(m.net_benefit(preds, BY).join(limits, [*BY, "threshold", "model"]), "nb", "snb", "snb_lower", "snb_upper")


@query("set_evaluation", with_views("""SELECT study_name, dataset, loss, accuracy, round(auroc, 6) AS auroc,
    round(avg_prec_score, 6) AS auprc FROM areas JOIN (SELECT study_name, dataset,
    round(avg(-(y_true * ln(p) + (1 - y_true) * ln(1 - p))), 6) AS loss,
    round(avg(CASE WHEN (y_pred > 0.5) = (y_true = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (
    SELECT *, least(greatest(y_pred, 1e-7), 1 - 1e-7) AS p FROM predictions) x GROUP BY study_name, dataset) e
    USING (study_name, dataset)""", "predictions", scores=SCORES, tab=TABLE, areas=AREAS))
def set_evaluation(spark, sf):
    return m.set_evaluation(P.predictions(spark, sf), BY).drop("evaluation")
