"""Risk models with Spark ML: fitting, cross-validated search, scoring, recalibration."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions.hashing import uniform
from episodica.operators.metrics import cross_entropy, rated, score_counts
from episodica.operators.reshape import union_with_label
from episodica.operators.sampling import rebalance
from episodica.operators.shared_fits import cross_validated
from episodica.session import durable


def feature_array(df: DataFrame, cols: Sequence[str], out: str = "x") -> DataFrame:
    """Feature columns as one array of doubles."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def as_vector(df: DataFrame, array: str = "x", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array)))


def fit_logistic(df: DataFrame, y: str, l2: float = 0.0, weight: str | None = None, max_iter: int = 100) -> LogisticRegressionModel:
    """L2-penalised logistic model. l2 multiplies the sum of squared weights; Spark's regParam multiplies half of it."""
    est = LogisticRegression(
        featuresCol="features", labelCol=y, regParam=2 * l2, elasticNetParam=0.0, standardization=False, maxIter=max_iter
    )
    return (est.setWeightCol(weight) if weight else est).fit(df)


def fit_mlp(
    df: DataFrame, y: str, hidden: Sequence[int], seed: int = 42, max_iter: int = 100, step: float | None = None
) -> MultilayerPerceptronClassificationModel:
    """Feed-forward network with sigmoid hidden layers. Spark's network has neither an L2 penalty nor row weights:
    balance classes by sampling instead. step switches to gradient descent with that step size."""
    n_inputs = df.select(F.size(vector_to_array("features"))).first()[0]
    est = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=y, layers=[n_inputs, *hidden, 2], seed=seed, maxIter=max_iter
    )
    return (est.setSolver("gd").setStepSize(step) if step else est).fit(df)


def risk(df: DataFrame, model: Model, out: str = "y_pred") -> DataFrame:
    """Add the predicted risk of class 1."""
    scored = model.transform(df).withColumn(out, F.get(vector_to_array("probability"), F.lit(1)))
    return scored.drop("rawPrediction", "probability", "prediction")


def score(
    model: Model, sets: Mapping[str, DataFrame], study: str, y: str, key: str = "admission_id", pred_type: str = "crude"
) -> DataFrame:
    """Predictions of several data sets in one long table."""
    scored = union_with_label({name: risk(df, model).select(key, F.col(y).alias("y_true"), "y_pred") for name, df in sets.items()}, "dataset")
    return scored.select(
        F.lit(study).alias("study_name"), "dataset", key, F.lit(pred_type).alias("pred_type"), "y_true", "y_pred"
    )


def draw_params(spark: SparkSession, space: Mapping[str, tuple], n: int, seed: object = 42) -> DataFrame:
    """n random settings. space: name -> ('choice', values) | ('loguniform', lo, hi) | ('int', lo, hi)."""
    trials = spark.range(n).withColumnRenamed("id", "number")
    for name, (kind, *args) in space.items():
        u = uniform(F.col("number"), f"{seed}{name}")
        if kind == "choice":
            values = F.array(*[F.lit(v) for v in args[0]])
            drawn: Column = F.element_at(values, (F.floor(u * len(args[0])) + 1).cast("int"))
        elif kind == "loguniform":
            drawn = F.exp(math.log(args[0]) + u * (math.log(args[1]) - math.log(args[0])))
        elif kind == "int":
            drawn = (F.floor(u * (args[1] - args[0] + 1)) + args[0]).cast("int")
        else:
            raise ValueError(kind)
        trials = trials.withColumn(name, drawn)
    return trials


def fit_with(train: DataFrame, model_type: str, y: str, hp: Mapping, max_iter: int = 50) -> Model:
    """Fit a linear or network model with one setting."""
    if model_type == "linear":
        return fit_logistic(train, y, hp.get("l2_penalty", 0.0), "weight", max_iter)
    hidden = [int(hp.get("n_hidden_nodes", 8))] * int(hp.get("n_hidden_layers", 1))
    return fit_mlp(train, y, hidden, max_iter=max_iter, step=hp.get("learning_rate"))


def prepare(df: DataFrame, y: str, key: str, how: str, model_type: str) -> DataFrame:
    """Class handling for training. The network takes no weights, so there weighting becomes random oversampling."""
    if how == "class_weighting" and model_type != "linear":
        how = "random_over"
    return as_vector(rebalance(df.select(key, "x", y), y, key, "x", how))


def search(
    dev: DataFrame, space: Mapping[str, tuple], n: int, y: str, key: str, fold: str, study: str, model_type: str = "linear",
    seed: object = 42, parallelism: int = 4, max_iter: int = 50,
) -> DataFrame:
    """Random search: every trial is fitted on all folds but one and evaluated on that one.

    Returns one row per (trial, fold) with the setting and the evaluation as JSON. Linear models are all fitted together
    (`shared_fits`). Networks are fitted one by one, with training sets prepared once per (fold, class handling) and shared
    by the trials. The driver holds the settings, the coefficients of linear models and one loss per fit.
    """
    spark = dev.sparkSession
    trials = [r.asDict() for r in draw_params(spark, space, n, seed).collect()]
    schema = "study_name string, trial_number long, cv_fold int, hyperparameters string, eval_val string"
    if model_type == "linear":
        params = {int(t["number"]): json.dumps({k: v for k, v in t.items() if k != "number"}) for t in trials}
        found, _ = cross_validated(dev, trials, y, key, fold, max_iter=max_iter)
        rows = [(study, t, int(f), params[t], json.dumps({"loss": loss, "accuracy": right})) for t, f, loss, right in found]
        return spark.createDataFrame(rows, schema)
    folds = sorted(r[0] for r in dev.select(fold).distinct().collect())
    ways = sorted({t.get("class_handling", "none") for t in trials})
    train = {
        (f, how): durable(prepare(dev.filter(F.col(fold) != f), y, key, how, model_type), "train") for f in folds for how in ways
    }
    held_out = {f: durable(as_vector(dev.filter(F.col(fold) == f).select(key, "x", y)), "val") for f in folds}

    def run(job: tuple[dict, int]) -> tuple:
        hp, f = job
        model = fit_with(train[f, hp.get("class_handling", "none")], model_type, y, hp, max_iter)
        scored = risk(held_out[f], model)
        hit = ((F.col("y_pred") > 0.5).cast("int") == F.col(y)).cast("double")
        row = scored.agg(F.avg(cross_entropy(F.col(y), F.col("y_pred"))).alias("loss"), F.avg(hit).alias("accuracy")).first()
        params = {k: v for k, v in hp.items() if k != "number"}
        return (study, int(hp["number"]), int(f), json.dumps(params), json.dumps(row.asDict()))

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(run, [(hp, f) for hp in trials for f in folds]))
    return spark.createDataFrame(rows, schema)


def cv_means(summaries: DataFrame) -> DataFrame:
    """Per trial the mean over folds of the smallest loss of the fold."""
    loss = F.get_json_object("eval_val", "$.loss").cast("double")
    per_fold = summaries.groupBy("study_name", "trial_number", "cv_fold").agg(F.min(loss).alias("loss"))
    return per_fold.groupBy("study_name", "trial_number").agg(F.avg("loss").alias("mean_loss"))


def best_trials(summaries: DataFrame) -> DataFrame:
    """Per study the trial with the smallest mean loss and its setting."""
    params = summaries.groupBy("study_name", "trial_number").agg(F.min("hyperparameters").alias("hyperparameters"))
    best = F.min_by(F.struct("trial_number", "hyperparameters", "mean_loss"), F.struct("mean_loss", "trial_number"))
    joined = cv_means(summaries).join(params, ["study_name", "trial_number"])
    return joined.groupBy("study_name").agg(best.alias("b")).select("study_name", "b.*")


def train_and_score(
    sets: Mapping[str, DataFrame], space: Mapping[str, tuple], n: int, y: str, study: str, folds: int = 5, key: str = "admission_id",
    group: str = "person_id", model_type: str = "linear", seed: object = 42, fit_hook: Callable[[Model], None] | None = None,
    max_iter: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """Folds, search, final fit on all development rows and predictions for every set.

    sets hold a feature array x. Returns (predictions, training summaries).
    """
    from episodica.operators.sampling import assign_folds

    dev = durable(assign_folds(sets["dev"].select(key, group, "x", y), group, y, folds, seed), "dev")
    summaries = search(dev, space, n, y, key, "fold", study, model_type, seed, max_iter=max_iter)
    best = json.loads(best_trials(summaries).first()["hyperparameters"])
    train = durable(prepare(dev, y, key, best.get("class_handling", "none"), model_type), "train")
    final = fit_with(train, model_type, y, best, max_iter)
    if fit_hook:
        fit_hook(final)
    return score(final, {name: as_vector(df) for name, df in sets.items()}, study, y, key), summaries


def save_model(model: Model, path: str) -> None:
    """Store a fitted model as a one-stage pipeline, replacing what was there."""
    PipelineModel([model]).write().overwrite().save(path)


def load_model(path: str) -> Model:
    return PipelineModel.load(path).stages[0]


def fit_platt(preds: DataFrame, y: str = "y_true", p: str = "y_pred", max_iter: int = 100) -> tuple[float, float]:
    """(a, b) of the recalibrated risk 1 / (1 + exp(a * score + b)), for the smoothed targets (n1+1)/(n1+2) and 1/(n0+2).

    Newton steps on the counts per score; a step that does not lower the loss is halved. Each step is one aggregate of
    six sums. Rows without score or outcome are left out; without any rows the risk is 1/2.
    """
    cells = durable(score_counts(preds, [], y, p), "cells")
    n1, n0 = (int(v or 0) for v in cells.agg(F.sum("pos"), F.sum("neg")).first())
    hits = F.col("pos") * ((n1 + 1) / (n1 + 2)) + F.col("neg") * (1 / (n0 + 2))
    n, s = F.col("pos") + F.col("neg"), F.col("score")

    def sums(a: float, b: float) -> list[float]:
        z = F.lit(a) * s + F.lit(b)
        risk = 1 / (1 + F.exp(z))
        loss = n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - (n - hits) * z
        slope, bend = hits - n * risk, n * risk * (1 - risk)
        terms = [loss, s * slope, slope, s * s * bend, s * bend, bend]
        return [float(v or 0.0) for v in cells.agg(*[F.sum(t) for t in terms]).first()]

    a, b = 0.0, math.log((n0 + 1) / (n1 + 1))
    loss, ga, gb, haa, hab, hbb = sums(a, b)
    for _ in range(max_iter):
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        da, db = (hab * gb - hbb * ga) / det, (hab * ga - haa * gb) / det
        if max(abs(da), abs(db)) < 1e-10 * (1 + max(abs(a), abs(b))):
            break
        for _ in range(30):
            tried = sums(a + da, b + db)
            if tried[0] <= loss:
                break
            da, db = da / 2, db / 2
        else:
            break
        a, b = a + da, b + db
        loss, ga, gb, haa, hab, hbb = tried
    return a, b


def apply_platt(preds: DataFrame, fitted: tuple[float, float], p: str = "y_pred") -> DataFrame:
    a, b = fitted
    return preds.withColumn(p, 1 / (1 + F.exp(F.lit(a) * F.col(p) + F.lit(b)))).withColumn("pred_type", F.lit("platt"))


def fit_isotonic(preds: DataFrame, y: str = "y_true", p: str = "y_pred") -> IsotonicRegressionModel:
    """Monotone recalibration, fitted on one weighted row per distinct score. Rows without score or outcome are left out."""
    cells = rated(preds, y, p).groupBy(F.col(p).alias("s")).agg(
        F.avg(F.col(y).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    return IsotonicRegression(featuresCol="s", labelCol="label", weightCol="weight").fit(cells)


def apply_isotonic(preds: DataFrame, model: IsotonicRegressionModel, p: str = "y_pred") -> DataFrame:
    """Recalibrated risk, kept within [0, 1]; scores outside the fitted range take the value at its end."""
    scored = model.setFeaturesCol(p).transform(preds)
    kept = F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))
    return scored.withColumn(p, kept).withColumn("pred_type", F.lit("isotonic")).drop("prediction")
