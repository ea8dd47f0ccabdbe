import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import models as md
from episodica.operators import shared_fits as sf

WAYS = ["none", "class_weighting", "random_over", "random_under", "smote", "near_miss"]


@pytest.fixture(scope="module")
def dev(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x[:, 3] = 1.0
    y = (rng.random(300) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] - 1)))).astype(int)
    rows = [(i, int(b), a.tolist(), i % 2) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, y int, x array<double>, fold int").repartition(3)


@pytest.mark.parametrize("how", WAYS)
def test_same_as_single_fits(dev, how):
    """Loss of every fold as of a model fitted alone by Spark on the prepared set."""
    trials = [{"number": i, "l2_penalty": p, "class_handling": how} for i, p in enumerate((1e-4, 1e-2))]
    found, _ = sf.cross_validated(dev, trials, "y", "id", "fold")
    assert [(t, f) for t, f, *_ in found] == [(t, f) for t in (0, 1) for f in range(2)]
    for t, f, loss, right in found:
        if f:
            continue
        train = md.prepare(dev.filter(F.col("fold") != f), "y", "id", how, "linear")
        scored = md.risk(md.as_vector(dev.filter(F.col("fold") == f)), md.fit_logistic(train, "y", trials[t]["l2_penalty"], "weight", 500))
        hit = ((F.col("y_pred") > 0.5).cast("int") == F.col("y")).cast("double")
        want = scored.agg(F.avg(md.cross_entropy(F.col("y"), F.col("y_pred"))).alias("loss"), F.avg(hit).alias("right")).first()
        assert loss == pytest.approx(want.loss, abs=2e-5) and right == pytest.approx(want.right)


def test_minimum_in_blocks(dev, monkeypatch):
    """The gradient vanishes, whatever the block, and scans do not grow with the settings."""
    rows = sf.training_rows(dev, "y", "id", "fold", [(0, "none"), (1, "class_weighting")])
    penalty = [1e-6, 1e-3, 1e-2, 0.1] * 2
    cell = [0] * 4 + [1] * 4
    fitted, scans = sf.fit_together(rows, cell, penalty)
    assert scans < 15
    got = rows.toPandas()
    x = np.hstack([np.ones((len(got), 1)), np.stack(got["x"])])
    w = np.stack(got["weights"])
    for s, b in enumerate(fitted):
        own = w[:, cell[s]]
        slope = x.T @ (own * (1 / (1 + np.exp(-x @ b)) - got["y"].to_numpy())) / own.sum() + 2 * penalty[s] * np.append(0, b[1:])
        assert np.abs(slope).max() < 1e-5
    monkeypatch.setattr(sf, "BLOCK_BYTES", 1)
    assert np.allclose(sf.fit_together(rows, cell, penalty)[0], fitted, atol=1e-6)


def test_one_class_sorted_apart_and_no_rows(spark, dev):
    """Separable rows stay finite under a penalty; rows without class or fold take no part; no rows give no trials."""
    apart = [(i, int(i >= 20), [float(i)], i % 2) for i in range(40)] + [(90, None, [1.0], 0), (91, 1, [2.0], None)]
    df = spark.createDataFrame(apart, "id long, y int, x array<double>, fold int")
    found, _ = sf.cross_validated(df, [{"number": 0, "l2_penalty": 1e-4}], "y", "id", "fold")
    assert all(np.isfinite(loss) and right > 0.9 for *_, loss, right in found)
    assert sf.cross_validated(dev.limit(0), [{"number": 0, "l2_penalty": 1e-4}], "y", "id", "fold")[0] == []


def test_search_lists_every_trial(dev):
    space = {"l2_penalty": ("loguniform", 1e-6, 1e-2), "class_handling": ("choice", ["none", "class_weighting"])}
    out = md.search(dev, space, 20, "y", "id", "fold", "study").collect()
    assert len({(r.trial_number, r.cv_fold) for r in out}) == len(out) == 40
    assert all(0 < json.loads(r.eval_val)["loss"] < 1 for r in out)
