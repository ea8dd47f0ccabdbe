import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import metrics as m


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    p = np.round(rng.beta(2, 5, size=800), 2)  # many ties
    y = (rng.random(800) < p).astype(int)
    return y, p


@pytest.fixture(scope="module")
def preds(spark, data):
    y, p = data
    rows = [("s", "dev" if i % 2 else "test", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "study_name string, dataset string, id long, y_true int, y_pred double").cache()


def auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def avg_prec(y, p):
    total, seen = 0.0, 0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        tp = y[hit].sum()
        total += (tp - seen) / y.sum() * tp / hit.sum()
        seen = tp
    return total


def test_areas(preds, data):
    row = m.area_metrics(m.score_table(m.score_counts(preds, ["study_name"]), ["study_name"]), ["study_name"]).first()
    assert row.auroc == pytest.approx(auroc(*data))
    assert row.avg_prec_score == pytest.approx(avg_prec(*data))


def test_auroc_does_not_change_under_monotone_maps(preds):
    areas = [
        m.area_metrics(m.score_table(m.score_counts(preds.withColumn("y_pred", f), ["study_name"]), ["study_name"]), ["study_name"]).first().auroc
        for f in (F.col("y_pred"), F.exp("y_pred") * 3, F.col("y_pred") ** 3)]
    assert areas[0] == pytest.approx(areas[1]) == pytest.approx(areas[2])


def test_roc_is_monotone_and_complete(preds):
    pts = m.roc(preds, ["study_name"]).orderBy("fpr", "tpr").collect()
    assert (pts[0].fpr, pts[0].tpr) == (0, 0) and (pts[-1].fpr, pts[-1].tpr) == (1, 1)
    assert all(a.tpr <= b.tpr for a, b in zip(pts, pts[1:]))
    assert len(pts) == preds.select("y_pred").distinct().count() + 1


def mcc_at(y, p, t):
    h = p > t
    tp, fp, fn, tn = ((h & (y == 1)).sum(), (h & (y == 0)).sum(), (~h & (y == 1)).sum(), (~h & (y == 0)).sum())
    d = float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return 0.0 if d == 0 else (float(tp) * tn - float(fp) * fn) / math.sqrt(d)


def test_thresholds(preds, data):
    grid = np.linspace(0, 1, 100, endpoint=False)
    scores = [round(mcc_at(*data, t), 9) for t in grid]
    best = m.best_threshold(m.score_counts(preds, ["study_name"]), ["study_name"]).first()
    assert best.threshold == pytest.approx(grid[int(np.argmax(scores))]) and best.mcc == pytest.approx(max(scores), abs=1e-8)
    last = m.best_threshold(m.score_counts(preds, ["study_name"]), ["study_name"], mode="reference").first()
    assert last.threshold == pytest.approx(max([t for t, s in zip(grid, scores) if s > 0], default=0))


def test_threshold_counts_at_exact_grid_points(spark):
    grid = [float(t) for t in np.linspace(0, 1, 100, endpoint=False)]
    df = spark.createDataFrame([("s", 1, t) for t in [*grid, 1.0]], "s string, y_true int, y_pred double")
    rows = m.threshold_table(m.score_counts(df, ["s"]), ["s"]).orderBy("threshold").collect()
    assert [r.tp for r in rows] == [sum(v > t for v in [*grid, 1.0]) for t in grid]


def test_metrics_of_one_class_only(spark):
    df = spark.createDataFrame([("s", "dev", 0, 0.2), ("s", "dev", 0, 0.9)], "study_name string, dataset string, y_true int, y_pred double")
    row = m.evaluation_metrics(df).first()
    assert (row.auroc, row.mcc, row.precision, row.recall) == (None, 0.0, 0.0, 0.0)


def test_net_benefit(preds, data):
    y, p = data
    rows = {(r.model, round(r.threshold, 1)): r for r in m.net_benefit(preds, ["study_name"]).collect()}
    assert all(rows["None", k / 10].nb == 0 for k in range(11))
    for k in range(10):
        t = k / 10
        h = p >= t
        want = (h & (y == 1)).mean() - (h & (y == 0)).mean() * t / (1 - t)
        assert rows["Prediction model", t].nb == pytest.approx(want)
        assert rows["Prediction model", t].snb == pytest.approx(want / y.mean())
        assert rows["All", t].nb == pytest.approx(y.mean() - (1 - y.mean()) * t / (1 - t))
    assert rows["Prediction model", 1.0].nb is None


def test_bootstrap_limits_agree_with_resampled_rows(preds, data):
    y, p = data
    model = F.col("model") == "Prediction model"
    got = {round(r.threshold, 1): r for r in m.net_benefit_limits(preds, ["study_name"], replicates=400).filter(model).collect()}
    again = {round(r.threshold, 1): r for r in m.net_benefit_limits(
        preds.repartition(3), ["study_name"], replicates=400).filter(model).collect()}
    assert {t: (r.snb_lower, r.snb_upper) for t, r in got.items()} == {t: (r.snb_lower, r.snb_upper) for t, r in again.items()}
    rng, t, draws = np.random.default_rng(0), 0.3, []
    for _ in range(400):
        i = rng.integers(len(y), size=len(y))
        h = p[i] >= t
        draws.append(((h & (y[i] == 1)).mean() - (h & (y[i] == 0)).mean() * t / (1 - t)) / y[i].mean())
    assert got[t].snb_lower == pytest.approx(np.quantile(draws, 0.025), abs=0.05)
    assert got[t].snb_upper == pytest.approx(np.quantile(draws, 0.975), abs=0.05)


def test_beta_quantiles(spark):
    # Beta(a, 1) has quantile q^(1/a); Beta(1/2, 1/2) is the arcsine law
    rows = [(0.3, 4.0, 1.0), (0.975, 0.5, 0.5), (0.025, 50.5, 950.5), (0.975, 950.5, 50.5), (0.5, 2e6 + 0.5, 2e6 + 0.5), (0.025, 0.5, 1e6)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q double, a double, b double")
    got = [r.v for r in df.select("i", m.beta_quantile(F.col("q"), F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got[0] == pytest.approx(0.3 ** 0.25) and got[1] == pytest.approx(math.sin(math.pi * 0.975 / 2) ** 2)
    assert got[2] == pytest.approx(1 - got[3])
    assert got[4] == pytest.approx(0.5, abs=1e-9)
    # b times the value of Beta(1/2, b) tends to a gamma law: half a squared standard normal of probability 0.025
    assert got[5] * 1e6 == pytest.approx(0.0313380 ** 2 / 2, rel=1e-3)


def test_poisson_draws_have_the_moments_of_the_counts(spark):
    cells = spark.createDataFrame([("a", 1), ("b", 40), ("c", 90_000), ("d", 0)], "cell string, n long")
    drawn = m.poisson_draws(cells, ["cell"], "n", F.col("cell"), 4000, 7)
    stats = {r.cell: r for r in drawn.groupBy("cell").agg(
        F.count("*").alias("n"), F.avg("drawn").alias("mean"), F.variance("drawn").alias("var"), F.min("drawn").alias("least")).collect()}
    assert set(stats) == {"a", "b", "c"} and {r.n for r in stats.values()} == {4000}
    for cell, n in (("a", 1), ("b", 40), ("c", 90_000)):
        assert stats[cell].mean == pytest.approx(n, abs=5 * math.sqrt(n / 4000))
        assert stats[cell].var == pytest.approx(n, rel=0.15)
    zero = drawn.filter("cell = 'a' and drawn = 0").count() / 4000
    assert zero == pytest.approx(math.exp(-1), abs=0.04)


def test_limits_of_groups_without_events_or_rows(spark):
    none = spark.createDataFrame([(0, 0.2), (0, 0.7), (None, 0.5), (1, None)], "y_true int, y_pred double").withColumn("study_name", F.lit("s"))
    out = m.net_benefit_limits(none, ["study_name"], replicates=5).collect()
    assert len(out) == 22 and all(r.snb_lower is None and r.snb_upper is None for r in out)
    assert m.net_benefit_limits(none.limit(0), ["study_name"], replicates=5).count() == 0


def test_calibration(preds, data):
    bins = m.with_jeffreys(m.calibration(preds, ["study_name"], "id")).collect()
    assert len(bins) == 10 and sum(b.events + b.non_events for b in bins) == len(data[0])
    assert all(b.y_true_lo <= b.y_true <= b.y_true_hi for b in bins if 0 < b.y_true < 1)


def test_set_evaluation(preds, data):
    y, p = data
    row = m.set_evaluation(preds, ["study_name"]).first()
    kept = np.clip(p, 1e-7, 1 - 1e-7)
    assert row.loss == pytest.approx(-(y * np.log(kept) + (1 - y) * np.log(1 - kept)).mean(), abs=1e-6)
    assert row.accuracy == pytest.approx(((p > 0.5) == (y == 1)).mean(), abs=1e-6)
    assert '"auroc"' in row.evaluation
