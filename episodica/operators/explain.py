"""Contributions of features to predicted risks, and their long form for figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.text import prettify, sentence
from episodica.operators.density import kde, local_regression
from episodica.operators.ordered import hash_ranked
from episodica.operators.quantiles import distinct_values, ntile_by, trim_upper
from episodica.operators.reshape import denormalise_long
from episodica.operators.sampling import sample_n
from episodica.operators.windows import group_range, min_max_scale
from episodica.session import durable

def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def linear_attribution(model: LogisticRegressionModel, df: DataFrame, background: DataFrame, x: str = "x") -> DataFrame:
    """Exact contributions of a linear model: w_j * (x_j - mean_j) on the logit, rescaled so that the contributions of
    a row add up to its risk minus the base risk. Adds base_value, y_pred and the array `contributions`.

    The means of the background are one aggregate row; weights and means have the length of the feature list.
    """
    weights = [float(w) for w in model.coefficients]
    means = background.agg(*[F.avg(F.get(x, F.lit(j))).alias(f"m{j}") for j in range(len(weights))]).first()
    centre = F.array(*[F.lit(float(m)) for m in means])
    slope = F.array(*[F.lit(w) for w in weights])
    base = float(model.intercept + sum(w * m for w, m in zip(weights, means)))
    on_logit = F.zip_with(F.zip_with(F.col(x), centre, lambda v, m: v - m), slope, lambda d, w: d * w)
    out = df.withColumn("_logit", on_logit).withColumn("_shift", _total(F.col("_logit")))
    base_risk = F.lit(float(1 / (1 + np.exp(-base))))
    pred = 1 / (1 + F.exp(-(F.lit(base) + F.col("_shift"))))
    factor = F.when(F.abs("_shift") > 1e-12, (pred - base_risk) / F.col("_shift")).otherwise(base_risk * (1 - base_risk))
    out = out.withColumns({"base_value": base_risk, "y_pred": pred, "_factor": factor})
    return out.withColumn("contributions", F.transform("_logit", lambda v: v * F.col("_factor"))).drop(
        "_logit", "_shift", "_factor"
    )


def mlp_attribution(
    model: MultilayerPerceptronClassificationModel, df: DataFrame, background: DataFrame, key: str, x: str = "x",
    n_background: int = 50, rounds: int = 8, seed: int = 42,
) -> DataFrame:
    """Sampled contributions of a network: features of a background row are replaced one after the other, in random
    order, by those of the explained row; each change of the risk goes to the replaced feature. Contributions of a row
    add up to its risk minus the mean risk of the background rows drawn for it.

    n_background rows (a parameter, not a share of the data) are shipped with the function; rows are explained
    independently, batch by batch.
    """
    layers = list(model.getLayers())
    flat = np.asarray(model.weights.toArray())
    params, at = [], 0
    for n_in, n_out in zip(layers[:-1], layers[1:]):
        w = flat[at : at + n_in * n_out].reshape(n_out, n_in, order="F")
        at += n_in * n_out
        params.append((w, flat[at : at + n_out]))
        at += n_out
    drawn = sample_n(background.select(key, x), key, n_background, seed)
    base_rows = np.array([r[0] for r in drawn.select(x).collect()])

    def risks(m: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(params):
            z = m @ w.T + b
            m = 1 / (1 + np.exp(-z)) if i < len(params) - 1 else z
        return 1 / (1 + np.exp(m[:, 0] - m[:, 1]))

    n_features = layers[0]

    def explain(batches):
        for pdf in batches:
            out = []
            for row_key, values in zip(pdf[key], pdf[x]):
                rng = np.random.default_rng([seed, abs(int(row_key))])
                values, total, base = np.asarray(values), np.zeros(n_features), 0.0
                for _ in range(rounds):
                    order = rng.permutation(n_features)
                    rows = np.repeat(base_rows[rng.integers(len(base_rows))][None, :], n_features + 1, axis=0)
                    for step, j in enumerate(order, start=1):
                        rows[step:, j] = values[j]
                    steps = risks(rows)
                    total[order] += np.diff(steps)
                    base += steps[0]
                out.append((row_key, base / rounds, float(risks(values[None, :])[0]), (total / rounds).tolist()))
            yield pd.DataFrame(out, columns=[key, "base_value", "y_pred", "contributions"])

    schema = f"{key} long, base_value double, y_pred double, contributions array<double>"
    return df.select(key, x).mapInPandas(explain, schema)


def attribution_table(df: DataFrame, features: Sequence[str], context: Sequence[str]) -> DataFrame:
    """One column per feature, next to the context columns."""
    return df.select(*context, *[F.get("contributions", F.lit(j)).alias(c) for j, c in enumerate(features)])


def explain_long(
    shap: DataFrame, data: DataFrame, features: Sequence[str], context: Sequence[str], key: str = "admission_id",
    factors: DataFrame | None = None,
) -> DataFrame:
    """(row, feature, contribution, feature value): the two wide tables are joined once per row and only then unfolded.

    With factors, feature values are put back on their original scale.
    """
    values = data.select(key, *[F.col(c).cast("double").alias(f"_v_{c}") for c in features])
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("shap_value"), F.col(f"_v_{c}").alias("feature_value"))
        for c in features
    ]
    wide = shap.select(*dict.fromkeys([*context, key]), *features).join(values, key)
    long = wide.select(*dict.fromkeys([*context, key]), F.inline(F.array(*pairs)))
    return long if factors is None else denormalise_long(long, factors)


def pretty_feature(
    feature: Column, atc_names: Mapping[str, str], kidney_names: Mapping[str, str], chapter_names: Mapping[str, str]
) -> Column:
    """Printed names of features; the names of codes and chapters come from the caller's classification tables."""

    def lookup(names: Mapping, code: Column) -> Column:
        if not names:
            return F.lit(None).cast("string")
        return F.element_at(F.create_map(*[F.lit(v) for item in names.items() for v in item]), code)

    plain = prettify(feature, [("^n_", "No. "), ("_", " ")])
    return (
        F.when(feature.contains("atc_level2_"), F.concat(F.lit("MED: "), lookup(atc_names, F.right(feature, F.lit(3)))))
        .when(feature.contains("n18_diag_"), F.concat(F.lit("DX: "), lookup(kidney_names, F.right(feature, F.lit(4)))))
        .when(
            feature.contains("icd10_chapter_"),
            F.concat(F.lit("DX: "), lookup(chapter_names, F.translate(F.right(feature, F.lit(2)), "_", ""))),
        )
        .otherwise(F.concat(F.lit("DEMO/CLIN: "), sentence(plain)))
    )


def summary_by_bin(binned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean contribution and mean feature value per group and bin, with the mean value scaled to [0, 1] per group."""
    means = durable(
        binned.groupBy(*by, "feature_value_bin").agg(
            F.avg("shap_value").alias("shap_value"), F.avg("feature_value").alias("feature_value")
        ),
        "means",
    )
    return min_max_scale(means, by, "feature_value", "colour_var")


def bivariate_data(
    long: DataFrame, by: Sequence[str], feature: str, key: str, sample_size: int | None = None, cutoff: float = 0.999,
    seed: object = 42, n_dens: int = 512, n_trend: int = 50, cutoff_over: str = "feature",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the figure of contribution against feature value shows, per feature and group `by` (model, outcome).

    Values above the cutoff quantile of the feature are left out (cutoff_over='all': of all features taken together, as
    a filter does that is evaluated on the whole table); sample_size, where given, keeps that many (row,
    feature) pairs per feature. Binary features get a density of the contributions per value and its range, all others
    a smooth trend: (densities, ranges, trends).
    """
    kept = trim_upper(long, [feature] if cutoff_over == "feature" else [], "feature_value", cutoff)
    if sample_size is not None:
        ids = kept.select(feature, *by, key).withColumn("_id", F.concat_ws("|", feature, *by, F.col(key).cast("string")))
        chosen = hash_ranked(ids, [feature], "_id", seed, "_rank").filter(F.col("_rank") <= sample_size)
        kept = kept.join(chosen.select(feature, *by, key), [feature, *by, key], "left_semi")
    kinds = kept.groupBy(feature).agg(F.bool_and(F.col("feature_value").isin(0.0, 1.0)).alias("_binary"))
    marked = durable(kept.join(durable(kinds, "kinds"), feature), "bivariate")
    groups = [feature, *by]
    cells = [*groups, "feature_value"]
    densities = with_tile_width(kde(marked.filter("_binary"), cells, "shap_value", n_dens), cells, n_dens)
    densities = durable(densities, "densities")
    ranges = group_range(densities, cells, "shap_value")
    trends = local_regression(marked.filter("not _binary"), groups, "feature_value", "shap_value", n_trend)
    return densities, ranges, trends


def binned_features(long: DataFrame, by: Sequence[str], key: str, n_bins: int = 5) -> DataFrame:
    """Feature values scaled to [0, 1] per group, put into at most n_bins equal-count bins (binary features keep their
    two values), with the mean value of each bin."""
    by = list(by)
    stats = distinct_values(long, by, "feature_value").withColumnsRenamed({"lo": "_lo", "hi": "_hi", "n_values": "_values"})
    width = F.col("_hi") - F.col("_lo")
    scaled = long.join(stats, by).withColumns(
        {
            "feature_is_binary": F.col("_values") == 2,
            "feature_value": (F.col("feature_value") - F.col("_lo")) / F.when(width != 0, width),
        }
    )
    binned = ntile_by(scaled.drop("_lo", "_hi"), by, "feature_value", key, n_bins, "_bin", cap="_values").drop("_values")
    chosen = F.when(F.col("feature_is_binary"), F.col("feature_value")).otherwise(F.col("_bin").cast("double"))
    binned = binned.withColumn("feature_value_bin", chosen).drop("_bin")
    means = durable(
        binned.groupBy(*by, "feature_value_bin").agg(F.avg("feature_value").alias("mean_feature_value")), "means"
    )
    return binned.join(means, [*by, "feature_value_bin"])


def shap_density(binned: DataFrame, feature: str = "feature_pretty", n: int = 1000, min_dens: float = 0.001) -> DataFrame:
    """Density bands of contributions per feature and value bin, all on one grid over the range of all contributions,
    so that the bands of different features can share an axis."""
    ends = binned.agg(F.struct(F.min("shap_value").alias("lo"), F.max("shap_value").alias("hi")).alias("e")).scalar()
    ranged = binned.select(feature, "mean_feature_value", "shap_value").withColumn("_e", ends)
    ranged = ranged.select("*", F.col("_e.lo").alias("_start"), F.col("_e.hi").alias("_end")).drop("_e")
    by = [feature, "mean_feature_value"]
    bands = kde(ranged, by, "shap_value", n, ("_start", "_end"))
    return with_tile_width(bands, by, n).filter(F.col("dens") >= min_dens)


def with_tile_width(bands: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Add the distance between grid points, which is the height of a drawn tile."""
    widths = bands.groupBy(*by).agg(((F.max("shap_value") - F.min("shap_value")) / (n - 1)).alias("tile_width"))
    return bands.join(widths, list(by))
