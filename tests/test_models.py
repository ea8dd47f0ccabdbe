import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import explain as ex
from episodica.operators import metrics as m
from episodica.operators import models as md
from episodica.operators import report as rp


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, i % 50, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, person long, y int, x array<double>")
    return md.as_vector(df).cache()


def test_logistic(rows):
    model = md.fit_logistic(rows, "y")
    assert model.coefficients[0] > 1 and model.coefficients[1] < -0.5
    assert abs(md.fit_logistic(rows, "y", l2=1.0).coefficients[0]) < abs(model.coefficients[0]) / 2
    preds = md.risk(rows, model).select(F.lit("s").alias("s"), F.col("y").alias("y_true"), "y_pred")
    assert m.area_metrics(m.score_table(m.score_counts(preds, ["s"]), ["s"]), ["s"]).first().auroc > 0.75


def test_linear_contributions_add_up(rows):
    model = md.fit_logistic(rows, "y")
    out = ex.linear_attribution(model, rows, rows).withColumn("total", F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v))
    scored = {r.id: r.y_pred for r in md.risk(rows, model).collect()}
    for r in out.collect():
        assert r.base_value + r.total == pytest.approx(r.y_pred) == pytest.approx(scored[r.id])


def test_network_contributions_add_up(rows):
    model = md.fit_mlp(rows, "y", [4, 3], max_iter=30)
    scored = {r.id: r.y_pred for r in md.risk(rows, model).collect()}
    out = ex.mlp_attribution(model, rows.filter("id < 20"), rows, "id", n_background=10, rounds=3).collect()
    assert len(out) == 20
    for r in out:
        assert r.y_pred == pytest.approx(scored[r.id])
        assert r.base_value + sum(r.contributions) == pytest.approx(r.y_pred)


def test_platt_is_the_maximum(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(500), 3)
    y = (rng.random(500) < p ** 2).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_true int, y_pred double")
    a, b = md.fit_platt(df)
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    fitted = 1 / (1 + np.exp(a * p + b))
    # the gradient of the loss vanishes
    assert (target - fitted).sum() == pytest.approx(0, abs=1e-6)
    assert ((target - fitted) * p).sum() == pytest.approx(0, abs=1e-6)
    assert a < 0


def test_platt_of_separated_constant_and_missing_scores(spark):
    def fit(rows):
        return md.fit_platt(spark.createDataFrame(rows, "y_true int, y_pred double"))

    assert fit([(None, 0.5), (1, None)]) == (0.0, 0.0)
    a, b = fit([(0, 0.1)] * 40 + [(1, 0.9)] * 40)
    assert 1 / (1 + np.exp(a * 0.9 + b)) == pytest.approx(41 / 42, abs=1e-6) and 1 / (1 + np.exp(a * 0.1 + b)) == pytest.approx(1 / 42, abs=1e-6)
    a, b = fit([(0, 0.5)] * 3 + [(1, 0.5)])
    assert 1 / (1 + np.exp(a * 0.5 + b)) == pytest.approx((2 / 3 + 3 / 5) / 4, abs=1e-4)
    wide = fit([(int(i % 7 > 4 or i > 900), float(i)) for i in range(1000)])
    assert all(np.isfinite(wide)) and wide[0] < 0


def test_isotonic_is_monotone(spark):
    df = spark.createDataFrame([(int(i % 3 == 0 or i > 60), i / 100) for i in range(100)], "y_true int, y_pred double")
    model = md.fit_isotonic(df)
    out = md.apply_isotonic(df.withColumn("order", F.col("y_pred")), model).orderBy("order").collect()
    values = [r.y_pred for r in out]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
    assert sum(values) == pytest.approx(sum(r.y_true for r in out))


def test_search_and_best_trial(spark, rows):
    from episodica.operators.sampling import assign_folds

    dev = assign_folds(rows, "person", "y", 2)
    space = {"l2_penalty": ("loguniform", 1e-6, 1e-2), "class_handling": ("choice", ["none", "class_weighting"])}
    out = md.search(dev, space, 2, "y", "id", "fold", "study", max_iter=10)
    assert out.count() == 4
    best = md.best_trials(out).first()
    assert best.mean_loss == min(r.mean_loss for r in md.cv_means(out).collect())


def test_draws_stay_in_range(spark):
    rows = md.draw_params(spark, {"a": ("loguniform", 1e-6, 1e-2), "b": ("int", 1, 4), "c": ("choice", [8, 16])}, 200).collect()
    assert all(1e-6 <= r.a <= 1e-2 and 1 <= r.b <= 4 and r.c in (8, 16) for r in rows)
    assert {r.b for r in rows} == {1, 2, 3, 4}


def test_pretty_names(spark):
    df = spark.createDataFrame([("atc_level2_N02",), ("n18_diag_N185",), ("icd10_chapter_4",), ("icd10_chapter_14",), ("n_previous_admissions",)], "f string")
    got = [r[0] for r in df.select(ex.pretty_feature(F.col("f"), {"N02": "Analgesics"}, {"N185": "CKD, stage 5"}, {"4": "Endocrine", "14": "Genitourinary"})).collect()]
    assert got == ["MED: Analgesics", "DX: CKD, stage 5", "DX: Endocrine", "DX: Genitourinary", "DEMO/CLIN: No. previous admissions"]
    names = spark.createDataFrame([("binary__mlp__daily_rate_geq_1",)], "s string")
    assert names.select(rp.pretty_study(F.col("s"))).first()[0] == "Binary MLP (daily rate >= 1)"


def test_printed_table(spark):
    rows = [("dev", 1, "0", 5.0), ("dev", 0, "1-2", 7.0), ("test", 1, "0", 9.0)]
    df = spark.createDataFrame(rows, "set string, daily_rate_not_zero int, r string, time_at_risk double")
    table = rp.table_one(df, "set", ["daily_rate_not_zero", "r"], ["time_at_risk"])
    out = {r.variate: (r.dev, r.test, r.in_table1, r.kind) for r in rp.print_table(table, "set", ["dev", "test"]).collect()}
    assert out["n"] == ("2", "1", "yes", 0)
    assert out["daily_rate_not_zero"] == ("1 (50.0)", "1 (100.0)", "yes", 0)
    assert out["r: 0"] == ("1 (50.0)", "1 (100.0)", "no", 1)
    assert out["r: 1-2"] == ("1 (50.0)", None, "no", 1)
    assert out["time_at_risk"] == ("6.0 [5.5, 6.5]", "9.0 [9.0, 9.0]", "yes", 0)
