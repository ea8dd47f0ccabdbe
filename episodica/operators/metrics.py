"""Evaluation of binary risk predictions.

All measures start from counts of events and non-events per distinct score (or per threshold bucket), which Spark
combines before the shuffle. Running totals over scores use `ranked`, so one study may hold any share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from episodica.functions.hashing import uniform
from episodica.operators.ordered import ranked
from episodica.operators.quantiles import ntile_by
from episodica.session import durable

MCC_STEPS = 100
NB_STEPS = 10


def rated(preds: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """The rows that have both a score and an outcome."""
    known = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & F.col(y).isNotNull()
    return preds.filter(known)


def score_counts(preds: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Events and non-events per distinct score: the one pass over the rows that most measures need.

    Rows without a score or an outcome take no part, here and in all other measures.
    """
    event = F.col(y) == 1
    return rated(preds, y, p).groupBy(*by, F.col(p).alias("score")).agg(
        F.sum(F.when(event, 1).otherwise(0)).alias("pos"), F.sum(F.when(event, 0).otherwise(1)).alias("neg")
    )


def score_table(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Score counts with their running totals from the lowest score up, and the totals of the group."""
    running = {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")}
    return ranked(counts, by, ["score"], running, {"n_pos": "pos_upto", "n_neg": "neg_upto"})


def area_metrics(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUROC (ties count half) and average precision from a score table."""
    tp = F.col("n_pos") - F.col("pos_upto") + F.col("pos")
    fp = F.col("n_neg") - F.col("neg_upto") + F.col("neg")
    below = F.col("neg_upto") - F.col("neg")
    wins = F.col("pos") * (below + F.col("neg") / 2)
    return table.groupBy(*by).agg(
        (F.sum(wins) / F.nullif(F.max(F.col("n_pos")) * F.max(F.col("n_neg")).cast("double"), F.lit(0.0))).alias("auroc"),
        (F.sum(F.col("pos") * tp / (tp + fp)) / F.nullif(F.max("n_pos"), F.lit(0))).alias("avg_prec_score"),
    )


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    margins = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(margins == 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(F.when(margins > 0, margins)))


def _steps_below(score: Column, step: float) -> Column:
    """How many of the thresholds 0, step, 2*step, ... lie strictly below the score."""
    k = F.floor(score / F.lit(step))
    return (k + (score > k * F.lit(step)).cast("int") + (score > (k + 1) * F.lit(step)).cast("int")).cast("int")


def threshold_table(counts: DataFrame, by: Sequence[str], steps: int = MCC_STEPS) -> DataFrame:
    """Confusion counts for `score > threshold` at the thresholds 0, 1/steps, ..., (steps-1)/steps, from score counts.

    Scores are summed up per bucket between thresholds; the counts above each threshold are running sums over at most
    steps+1 buckets per group.
    """
    by = list(by)
    bucket = F.least(_steps_below(F.col("score"), 1.0 / steps), F.lit(steps)).alias("_b")
    buckets = counts.groupBy(*by, bucket).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    grid = buckets.select(*by).distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    full = grid.join(buckets, [*by, "_b"], "left").na.fill(0, ["_pos", "_neg"])
    whole = W.partitionBy(*by)
    above = whole.orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    counted = full.select(
        *by,
        "_b",
        F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("fp"),
        F.sum("_pos").over(whole).alias("n_pos"),
        F.sum("_neg").over(whole).alias("n_neg"),
    )
    return counted.filter(F.col("_b") < steps).select(
        *by, (F.col("_b") * F.lit(1.0 / steps)).alias("threshold"), "tp", "fp", "n_pos", "n_neg"
    )


def best_threshold(counts: DataFrame, by: Sequence[str], steps: int = MCC_STEPS, mode: str = "best") -> DataFrame:
    """From score counts, the threshold with the largest Matthews correlation (the lowest one on ties).

    mode='reference' gives the largest threshold with a positive correlation, 0 if there is none.
    """
    table = threshold_table(counts, by, steps).withColumn(
        "mcc", mcc(F.col("tp"), F.col("fp"), F.col("n_pos") - F.col("tp"), F.col("n_neg") - F.col("fp"))
    )
    if mode == "reference":
        chosen = F.coalesce(F.max(F.when(F.col("mcc") > 0, F.col("threshold"))), F.lit(0.0))
        return table.groupBy(*by).agg(chosen.alias("threshold"))
    if mode != "best":
        raise ValueError(mode)
    rounded = F.round("mcc", 9)
    best = F.max_by(F.struct("threshold", "mcc"), F.struct(rounded, -F.col("threshold"))).alias("best")
    return table.groupBy(*by).agg(best).select(*by, "best.threshold", "best.mcc")


def confusion_metrics(counts: DataFrame, by: Sequence[str], threshold: Column) -> DataFrame:
    """MCC, precision and recall for `score > threshold`, from score counts."""
    hit = F.col("score") > threshold
    cells = counts.groupBy(*by).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        *by,
        mcc(tp, fp, fn, tn).alias("mcc"),
        F.when(tp + fp == 0, 0.0).otherwise(tp / F.nullif(tp + fp, F.lit(0))).alias("precision"),
        F.when(tp + fn == 0, 0.0).otherwise(tp / F.nullif(tp + fn, F.lit(0))).alias("recall"),
    )


def evaluation_metrics(preds: DataFrame, study: str = "study_name", dataset: str = "dataset", dev: str = "dev") -> DataFrame:
    """One row per study and data set. The threshold is chosen on the development set of the study."""
    by = [study, dataset]
    counts = durable(score_counts(preds, by), "counts")
    cuts = best_threshold(counts.filter(F.col(dataset) == dev), [study]).select(study, "threshold")
    areas = area_metrics(score_table(counts, by), by)
    confusion = confusion_metrics(counts.join(durable(cuts, "cuts"), study), [*by, "threshold"], F.col("threshold"))
    return areas.join(confusion, by)


def roc(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """(fpr, tpr) at every distinct score used as cut-off, plus the origin."""
    by = list(by)
    table = score_table(score_counts(preds, by), by)
    tpr = (F.col("n_pos") - F.col("pos_upto") + F.col("pos")) / F.col("n_pos")
    fpr = (F.col("n_neg") - F.col("neg_upto") + F.col("neg")) / F.col("n_neg")
    points = table.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(
        *by, F.col("score").alias("cutoff"), fpr.alias("fpr"), tpr.alias("tpr")
    )
    origin = points.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("cutoff"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def calibration(preds: DataFrame, by: Sequence[str], tie: str, n: int = 10, y="y_true", p="y_pred") -> DataFrame:
    """Equal-count bins of the predicted risk: mean prediction, observed share and event counts."""
    binned = ntile_by(rated(preds, y, p).select(*by, p, y, tie), by, p, tie, n, out="q")
    return binned.groupBy(*by, "q").agg(
        F.avg(p).alias("y_pred"),
        F.avg(F.col(y).cast("double")).alias("y_true"),
        F.sum(F.col(y).cast("long")).alias("events"),
        F.sum(1 - F.col(y).cast("long")).alias("non_events"),
    )


def _log_gamma(x: Column) -> Column:
    """Stirling's series, eight steps up from x > 0."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
    tail = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return series + tail - sum((F.log(x + i) for i in range(1, 8)), F.log(x))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function; some sqrt(a + b) terms are enough for x below the mean, where
    no denominator gets zero."""
    terms = F.sequence(F.lit(1), F.floor(60 + 5 * F.sqrt(a + b)).cast("int")).cast("array<double>")
    pairs = F.transform(terms, lambda m: F.array(
        m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))))

    def step(state: Column, numerator: Column) -> Column:
        new = F.struct((1 + numerator / state["c"]).alias("c"), (1 / (1 + numerator * state["d"])).alias("d"))
        return _bound(new, lambda v: F.struct(v["c"], v["d"], (state["total"] * v["c"] * v["d"]).alias("total")))

    first = F.struct((1 / (1 - (a + b) * x / (a + 1))).alias("d"))
    start = _bound(first, lambda v: F.struct(F.lit(1.0).alias("c"), v["d"], v["d"].alias("total")))
    return F.aggregate(F.flatten(pairs), start, step, lambda state: state["total"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function of 0 < x < 1, from the side where the continued fraction settles fast."""
    above = x > (a + 1) / (a + b + 2)
    sides = F.struct(F.when(above, b).otherwise(a).alias("p"), F.when(above, a).otherwise(b).alias("q"),
                     F.when(above, 1 - x).otherwise(x).alias("z"), above.alias("above"))

    def part(v: Column) -> Column:
        p, q, z = v["p"], v["q"], v["z"]
        front = F.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * F.log(z) + q * F.log1p(-z)) / p
        return _bound(front * _beta_fraction(p, q, z), lambda share: F.when(v["above"], 1 - share).otherwise(share))

    return _bound(sides, part)


def beta_quantile(q: Column, a: Column, b: Column, steps: int = 44) -> Column:
    """Inverse of the incomplete beta function by bisection, as a column expression."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        tried = F.struct(((state["lo"] + state["hi"]) / 2).alias("mid"))
        tried = _bound(tried, lambda v: F.struct(v["mid"], (incomplete_beta(a, b, v["mid"]) < q).alias("below")))
        return _bound(tried, lambda v: F.struct(
            F.when(v["below"], v["mid"]).otherwise(state["lo"]).alias("lo"),
            F.when(v["below"], state["hi"]).otherwise(v["mid"]).alias("hi")))

    halves = F.sequence(F.lit(1), F.lit(steps))
    return F.aggregate(halves, start, halve, lambda state: (state["lo"] + state["hi"]) / 2)


def with_jeffreys(bins: DataFrame, level: float = 0.95) -> DataFrame:
    """Jeffreys limits of the observed share. The expression is evaluated on calibration bins, not on rows."""
    tail = (1 - level) / 2
    a, b = F.col("events") + 0.5, F.col("non_events") + 0.5
    return bins.withColumn("y_true_lo", beta_quantile(F.lit(tail), a, b)).withColumn(
        "y_true_hi", beta_quantile(F.lit(1 - tail), a, b)
    )


def benefit_cells(preds: DataFrame, by: Sequence[str], steps: int = NB_STEPS, y="y_true", p="y_pred") -> DataFrame:
    """Counts per (threshold bucket, outcome): bucket b holds scores that reach exactly b of the thresholds 0, 1/steps, ..., 1."""
    k = F.floor(F.col(p) * steps)
    reached = (
        (F.col(p) >= F.lit(0.0)).cast("int")
        + F.when(F.col(p) >= (k + 1) / F.lit(float(steps)), k + 1).when(F.col(p) >= k / F.lit(float(steps)), k).otherwise(k - 1)
    ).cast("int")
    return rated(preds, y, p).groupBy(*by, F.least(reached, F.lit(steps + 1)).alias("bucket")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg")
    )


def _benefit(tp: Column, fp: Column, n: Column, pt: Column) -> Column:
    """tp/n - fp/n * pt/(1-pt); not defined at a threshold of 1."""
    return tp / n - fp / n * pt / F.when(pt < 1, 1 - pt)


def net_benefit(preds: DataFrame, by: Sequence[str], steps: int = NB_STEPS) -> DataFrame:
    """Net benefit and standardised net benefit of the model, of treating all and of treating none.

    A row counts as high risk when its score is at least the threshold.
    """
    by = list(by)
    cells = benefit_cells(preds, by, steps)
    grid = cells.select(*by).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(steps + 1))))
    full = grid.join(cells, [*by, "bucket"], "left").na.fill(0, ["pos", "neg"])
    whole = W.partitionBy(*by)
    reached = whole.orderBy("bucket").rowsBetween(1, W.unboundedFollowing)
    at = full.select(
        *by,
        (F.col("bucket") / F.lit(float(steps))).alias("threshold"),
        F.sum("pos").over(reached).alias("tp"),
        F.sum("neg").over(reached).alias("fp"),
        F.sum("pos").over(whole).alias("n_pos"),
        F.sum(F.col("pos") + F.col("neg")).over(whole).alias("n"),
        F.col("bucket"),
    ).filter(F.col("bucket") <= steps)
    pt, n = F.col("threshold"), F.col("n")
    curves = at.select(
        *by,
        "threshold",
        (F.col("n_pos") / n).alias("_prevalence"),
        F.explode(
            F.array(
                F.struct(F.lit("Prediction model").alias("model"), _benefit(F.col("tp"), F.col("fp"), n, pt).alias("nb")),
                F.struct(F.lit("All").alias("model"), _benefit(F.col("n_pos"), n - F.col("n_pos"), n, pt).alias("nb")),
                F.struct(F.lit("None").alias("model"), F.lit(0.0).alias("nb")),
            )
        ).alias("_curve"),
    )
    standardised = F.col("_curve.nb") / F.nullif(F.col("_prevalence"), F.lit(0.0))
    return curves.select(
        *by, "threshold", F.col("_curve.model").alias("model"), F.col("_curve.nb").alias("nb"), standardised.alias("snb")
    )


def poisson_draws(cells: DataFrame, by: Sequence[str], n: str, key: Column, replicates: int, seed: object) -> DataFrame:
    """For each cell (distinct `by`) with n > 0 rows and each replicate a Poisson(n) number `drawn`.

    That is the number of rows of the cell in a Poisson bootstrap, where every row has a Poisson(1) weight, without a
    draw per row. The distribution is tabulated within 12 standard deviations around n, so a cell costs some
    24 sqrt(n) rows; the draw is the first number whose cumulated share exceeds a hash of key and replicate.
    """
    by = list(by)
    reach = 12 * F.sqrt(n) + 12
    numbers = F.sequence(F.greatest(F.lit(0), F.floor(F.col(n) - reach)).cast("long"), F.ceil(F.col(n) + reach).cast("long"))
    table = cells.filter(F.col(n) > 0).select(*by, F.log(F.col(n).cast("double")).alias("_ln"), F.posexplode(numbers).alias("_at", "_k"))
    whole = W.partitionBy(*by)
    upto = whole.orderBy("_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    table = table.withColumn("_l", F.sum(F.when(F.col("_at") == 0, 0.0).otherwise(F.col("_ln") - F.log("_k"))).over(upto))
    table = table.withColumn("_w", F.exp(F.col("_l") - F.max("_l").over(whole)))
    table = table.select(*by, (F.sum("_w").over(upto) / F.sum("_w").over(whole)).alias("_x"), "_k", F.lit(None).cast("int").alias("replicate"))
    draws = cells.filter(F.col(n) > 0).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    place = uniform(F.concat_ws("|", key, F.col("replicate").cast("string")), seed)
    draws = draws.select(*by, place.alias("_x"), F.lit(None).cast("long").alias("_k"), "replicate")
    # from above: the least number passed so far is the first whose cumulated share is greater
    passed = whole.orderBy(F.desc("_x"), F.desc_nulls_last("replicate")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return table.unionByName(draws).withColumn("drawn", F.min("_k").over(passed)).filter("replicate IS NOT NULL").select(*by, "replicate", "drawn")


def net_benefit_limits(
    preds: DataFrame, by: Sequence[str], steps: int = NB_STEPS, replicates: int = 500, level: float = 0.95, seed: int = 42
) -> DataFrame:
    """Poisson bootstrap limits of the standardised net benefit of the model and of treating all.

    Net benefit depends on the rows only through the counts per (threshold bucket, outcome), so each of these counts is
    drawn instead of the weights of its rows: every replicate costs 2 * (steps + 2) numbers, not one pass over the rows.
    """
    by = list(by)
    cells = durable(benefit_cells(preds, by, steps), "cells")
    counts = cells.select(*by, "bucket", F.explode(F.map_from_arrays(F.array(F.lit(1), F.lit(0)), F.array("pos", "neg"))).alias("outcome", "n"))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, "bucket", "outcome"]])
    drawn = poisson_draws(counts, [*by, "bucket", "outcome"], "n", key, replicates, seed)
    event = F.col("outcome") == 1
    again = drawn.groupBy(*by, "replicate").agg(
        F.sum(F.when(event, F.col("drawn")).otherwise(0)).alias("n_pos"),
        F.sum("drawn").alias("n"),
        *[F.sum(F.when(event & (F.col("bucket") > t), F.col("drawn")).otherwise(0)).alias(f"tp{t}") for t in range(steps + 1)],
        *[F.sum(F.when(~event & (F.col("bucket") > t), F.col("drawn")).otherwise(0)).alias(f"fp{t}") for t in range(steps + 1)],
    )
    n, prevalence = F.nullif(F.col("n"), F.lit(0)), F.nullif(F.col("n_pos") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    points = []
    for t in range(steps + 1):
        pt = F.lit(t / steps)
        model = _benefit(F.col(f"tp{t}"), F.col(f"fp{t}"), n, pt)
        everyone = _benefit(F.col("n_pos"), F.col("n") - F.col("n_pos"), n, pt)
        for name, benefit in (("Prediction model", model), ("All", everyone)):
            points.append(F.struct(pt.alias("threshold"), F.lit(name).alias("model"), (benefit / prevalence).alias("snb")))
    tail = (1 - level) / 2
    return again.select(*by, F.inline(F.array(*points))).groupBy(*by, "threshold", "model").agg(
        F.percentile("snb", tail).alias("snb_lower"), F.percentile("snb", 1 - tail).alias("snb_upper")
    )


def cross_entropy(y: Column, p: Column, eps: float = 1e-7) -> Column:
    """Loss of one prediction, kept away from 0 and 1."""
    kept = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(kept) + (1 - y) * F.log(1 - kept))


def set_evaluation(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Loss, accuracy (at 0.5), AUROC and area under the precision-recall curve per group, also as JSON text."""
    counts = durable(score_counts(preds, by), "counts")
    score, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    loss = pos * cross_entropy(F.lit(1), score) + neg * cross_entropy(F.lit(0), score)
    right = F.when(score > 0.5, pos).otherwise(neg)
    simple = counts.groupBy(*by).agg(
        F.round(F.sum(loss) / F.sum(pos + neg), 6).alias("loss"), F.round(F.sum(right) / F.sum(pos + neg), 6).alias("accuracy")
    )
    areas = area_metrics(score_table(counts, by), by).select(
        *by, F.round("auroc", 6).alias("auroc"), F.round("avg_prec_score", 6).alias("auprc")
    )
    joined = simple.join(areas, list(by))
    return joined.withColumn("evaluation", F.to_json(F.struct("loss", "accuracy", "auroc", "auprc")))
