"""Queries for training, scoring, recalibration and attribution."""

from pyspark.sql import functions as F

from episodica.operators import explain as ex
from episodica.operators import metrics as m
from episodica.operators import models as md
from episodica.operators import reshape as rs
from episodica.plans import dataset_queries as dq
from episodica.plans import proxies as P
from episodica.plans.metric_queries import rounded
from episodica.plans.proxies import with_recursive
from episodica.plans.registry import query
from episodica.session import durable, scratch_path

LINEAR_SPACE = {
    "l2_penalty": ("loguniform", 1e-6, 1e-2),
    "class_handling": ("choice", ["random_over", "class_weighting", "random_under", "none", "smote", "near_miss"]),
}
TRIALS, FOLDS = 100, 5
MLP_SPACE = {
    "n_hidden_layers": ("int", 1, 4),
    "n_hidden_nodes": ("choice", [8, 16, 32, 64, 128, 256]),
    "class_handling": ("choice", ["random_over", "random_under", "none"]),
}


def _vectors(spark, sf):
    return durable(md.as_vector(P.vectors(spark, sf)), "vectors")


def _scored(spark, sf):
    rows = _vectors(spark, sf)
    model = md.fit_logistic(rows, "y", 1e-3)
    sets = {"dev": rows.filter("id % 4 < 3"), "test": rows.filter("id % 4 = 3")}
    return md.score(model, sets, "vectors__linear", "y", "id")


@query("train_linear")
def train_linear(spark, sf):
    rows = _vectors(spark, sf)
    return md.risk(rows, md.fit_logistic(rows, "y", 1e-3)).select("id", "y", F.round("y_pred", 6).alias("y_pred"))


@query("train_mlp")
def train_mlp(spark, sf):
    rows = _vectors(spark, sf)
    return md.risk(rows, md.fit_mlp(rows, "y", [8], max_iter=60)).select("id", "y", F.round("y_pred", 6).alias("y_pred"))


@query("search")
def search(spark, sf):
    from episodica.operators.sampling import assign_folds

    dev = durable(assign_folds(P.vectors(spark, sf).withColumn("person", F.col("id") % 100), "person", "y", FOLDS), "dev")
    return md.search(dev, LINEAR_SPACE, TRIALS, "y", "id", "fold", "vectors__linear")


@query("search_space", """SELECT o_custkey AS number, exp(ln(1e-6) + u * (ln(1e-2) - ln(1e-6))) > 1e-4 AS large_penalty FROM (
    SELECT DISTINCT o_custkey, ('0x' || substr(md5(o_custkey || '|42l2_penalty'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
    FROM orders) t""")
def search_space(spark, sf):
    persons = P.table(spark, sf, "orders").select(F.col("o_custkey").alias("number")).distinct()
    largest = persons.agg(F.max("number")).first()[0]
    drawn = md.draw_params(spark, {"l2_penalty": LINEAR_SPACE["l2_penalty"]}, largest + 1)
    return drawn.join(persons, "number", "left_semi").select("number", (F.col("l2_penalty") > 1e-4).alias("large_penalty"))


@query("score")
def score(spark, sf):
    return rounded(_scored(spark, sf), "y_pred")


DEV_SCORES = """SELECT y_pred AS score, sum(y_true)::DOUBLE AS pos, sum(1 - y_true)::DOUBLE AS neg FROM predictions
    WHERE dataset = 'dev' GROUP BY y_pred"""
TARGETS = """SELECT score, pos + neg AS n, pos * (n1 + 1) / (n1 + 2) + neg / (n0 + 2) AS hits, n1, n0
    FROM dev_scores, (SELECT sum(pos) AS n1, sum(neg) AS n0 FROM dev_scores) s"""
NEWTON = """SELECT 0 AS step, 0.0::DOUBLE AS a, ln((max(n0) + 1) / (max(n1) + 1))::DOUBLE AS b FROM targets
    UNION ALL SELECT step + 1, a + (hab * gb - hbb * ga) / (haa * hbb - hab * hab), b + (hab * ga - haa * gb) / (haa * hbb - hab * hab)
    FROM (SELECT step, a, b, sum(score * (hits - n * risk)) AS ga, sum(hits - n * risk) AS gb,
        sum(score * score * n * risk * (1 - risk)) AS haa, sum(score * n * risk * (1 - risk)) AS hab, sum(n * risk * (1 - risk)) AS hbb
        FROM (SELECT *, 1 / (1 + exp(a * score + b)) AS risk FROM newton, targets WHERE step < 30) r GROUP BY step, a, b) sums"""
PLATT = dict(dev_scores=DEV_SCORES, targets=TARGETS, newton=NEWTON)


@query("platt", with_recursive("""SELECT study_name, dataset, 'platt' AS pred_type,
    round(avg(1 / (1 + exp(a * y_pred + b))), 6) AS y_pred, round(avg(y_true), 6) AS y_true
    FROM predictions, (SELECT a, b FROM newton WHERE step = 30) f GROUP BY study_name, dataset""", "predictions", **PLATT))
def platt(spark, sf):
    preds = P.predictions(spark, sf)
    fitted = md.fit_platt(preds.filter(F.col("dataset") == "dev"))
    out = md.apply_platt(preds, fitted)
    return rounded(out.groupBy("study_name", "dataset", "pred_type").agg(
        F.avg("y_pred").alias("y_pred"), F.avg("y_true").alias("y_true")), "y_pred", "y_true")


@query("platt_coefficients", with_recursive(
    "SELECT n1, n0, round(a, 6) AS a, round(b, 6) AS b FROM newton, (SELECT max(n1) AS n1, max(n0) AS n0 FROM targets) t WHERE step = 30",
    "predictions", **PLATT))
def platt_coefficients(spark, sf):
    dev = P.predictions(spark, sf).filter(F.col("dataset") == "dev")
    a, b = md.fit_platt(dev)
    sizes = dev.agg(F.sum("y_true").cast("double").alias("n1"), F.sum(1 - F.col("y_true")).cast("double").alias("n0"))
    return sizes.withColumns({"a": F.round(F.lit(a), 6), "b": F.round(F.lit(b), 6)})


# running sums of weight and events over the scores; the corners of their greatest convex minorant bound the blocks
SUMS = """SELECT row_number() OVER (ORDER BY score) AS i, score, sum(pos + neg) OVER (ORDER BY score) AS w,
    sum(pos) OVER (ORDER BY score) AS e FROM dev_scores"""
CORNERS = """SELECT 0::BIGINT AS i, 0::DOUBLE AS w, 0::DOUBLE AS e, NULL::DOUBLE AS value
    UNION ALL SELECT i, w, e, value FROM (SELECT s.i, s.w, s.e, (s.e - c.e) / (s.w - c.w) AS value,
        row_number() OVER (ORDER BY (s.e - c.e) / (s.w - c.w), s.i DESC) AS place FROM corners c JOIN sums s ON s.i > c.i) t WHERE place = 1"""
KNOTS = """SELECT DISTINCT score, value FROM (SELECT value, i AS hi, lag(i) OVER (ORDER BY i) + 1 AS lo FROM corners) b
    JOIN sums s ON s.i = b.lo OR s.i = b.hi WHERE value IS NOT NULL"""


@query("isotonic", with_recursive("""SELECT study_name, dataset, 'isotonic' AS pred_type, round(avg(CASE
        WHEN l.score IS NULL THEN h.value WHEN h.score IS NULL OR h.score = l.score THEN l.value
        ELSE l.value + (h.value - l.value) * (y_pred - l.score) / (h.score - l.score) END), 6) AS y_pred, round(avg(y_true), 6) AS y_true
    FROM predictions p ASOF LEFT JOIN knots l ON p.y_pred >= l.score ASOF LEFT JOIN knots h ON p.y_pred <= h.score
    GROUP BY study_name, dataset""", "predictions", dev_scores=DEV_SCORES, sums=SUMS, corners=CORNERS, knots=KNOTS))
def isotonic(spark, sf):
    preds = P.predictions(spark, sf)
    fitted = md.fit_isotonic(preds.filter(F.col("dataset") == "dev"))
    out = md.apply_isotonic(preds, fitted)
    return rounded(out.groupBy("study_name", "dataset", "pred_type").agg(
        F.avg("y_pred").alias("y_pred"), F.avg("y_true").alias("y_true")), "y_pred", "y_true")


FEATURE_NAMES = [f"x{j}" for j in range(64)]
ADDS_UP = "SELECT vec_id AS id, len(embedding) AS n_features, true AS adds_up, true AS is_risk FROM embeddings"


def _linear_contributions(spark, sf):
    rows = _vectors(spark, sf)
    return ex.linear_attribution(md.fit_logistic(rows, "y", 1e-3), rows, rows.filter("id % 4 < 3"))


def _mlp_contributions(spark, sf):
    rows = _vectors(spark, sf)
    return ex.mlp_attribution(md.fit_mlp(rows, "y", [8], max_iter=60), rows, rows, "id")


def _adds_up(explained):
    """Whether all contributions of a row and the base risk add up to the predicted risk."""
    total = F.aggregate("contributions", F.col("base_value"), lambda a, v: a + v)
    return explained.select(
        "id", F.size("contributions").cast("long").alias("n_features"), (F.abs(total - F.col("y_pred")) < 1e-9).alias("adds_up"),
        F.col("y_pred").between(0, 1).alias("is_risk"))


@query("attribution")
def attribution(spark, sf):
    return ex.attribution_table(_linear_contributions(spark, sf), FEATURE_NAMES, ["id", "base_value", "y_pred"])


@query("attribution_adds_up", ADDS_UP)
def attribution_adds_up(spark, sf):
    return _adds_up(_linear_contributions(spark, sf))


@query("attribution_mlp")
def attribution_mlp(spark, sf):
    return ex.attribution_table(_mlp_contributions(spark, sf), FEATURE_NAMES, ["id", "base_value", "y_pred"])


@query("attribution_mlp_adds_up", ADDS_UP)
def attribution_mlp_adds_up(spark, sf):
    return _adds_up(_mlp_contributions(spark, sf))


@query("train_linear_gradient", "SELECT unnest(range(65)) AS weight, true AS at_minimum FROM (SELECT count(*) FROM embeddings) e")
def train_linear_gradient(spark, sf):
    """The penalised loss is flat in every weight (64: the intercept) of the fitted model."""
    rows, penalty = _vectors(spark, sf), 1e-3
    model = md.fit_logistic(rows, "y", penalty)
    residual = F.col("y_pred") - F.col("y")
    weights = [float(w) for w in model.coefficients]
    means = md.risk(rows, model).agg(
        *[F.avg(residual * F.get("x", F.lit(j))).alias(f"g{j}") for j in range(64)], F.avg(residual).alias("g64"))
    slopes = [F.abs(F.col(f"g{j}") + 2 * penalty * w) < 1e-4 for j, w in enumerate([*weights, 0.0])]
    return means.select(F.posexplode(F.array(*slopes)).alias("weight", "at_minimum")).withColumn("weight", F.col("weight").cast("long"))


@query("model_store", "SELECT vec_id AS id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, true AS same FROM embeddings")
def model_store(spark, sf):
    """A loaded model gives the risks of the model that was stored."""
    rows, path = _vectors(spark, sf), scratch_path(spark, "model")
    model = md.fit_logistic(rows, "y", 1e-3)
    md.save_model(model, path)
    kept = md.risk(rows, model).select("id", F.col("y_pred").alias("kept"))
    loaded = md.risk(rows, md.load_model(path)).select("id", "y", "y_pred").join(kept, "id")
    return loaded.select("id", "y", (F.abs(F.col("y_pred") - F.col("kept")) < 1e-12).alias("same"))


@query("train_and_score")
def train_and_score(spark, sf):
    """Data sets -> folds -> search -> final model -> predictions -> metrics."""
    sets, _ = dq.model_sets(spark, sf)
    y = "daily_rate_not_zero"
    features = [c for c in sets["dev"].columns if c not in dq.fl.NOT_FEATURES]
    arrays = {
        name: durable(rs.cast_cols(md.feature_array(df, features), [y], "int").select("admission_id", "person_id", "x", y), name)
        for name, df in sets.items()
    }
    preds, _ = md.train_and_score(arrays, LINEAR_SPACE, TRIALS, y, "binary__linear__daily_rate_not_zero__final", folds=FOLDS)
    out = m.evaluation_metrics(durable(preds, "predictions"))
    return rounded(out, "threshold", "auroc", "avg_prec_score", "mcc", "precision", "recall")
