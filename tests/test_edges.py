"""Null, constant, tied and tiny inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica import session
from episodica.functions.text import clamp
from episodica.operators import cohort as co
from episodica.operators import metrics as m
from episodica.operators import reshape as rs
from episodica.operators import sampling as sp
from episodica.operators import windows as w
from episodica.sources import tables as t


def test_neighbours_at_one_distance(spark):
    """100 of 400 points lie on the query; the smallest ids win, whatever the blocks."""
    rng = np.random.default_rng(1)
    ids = rng.permutation(400).tolist()
    rows = [(i, [1.0, 2.0, 3.0] if at < 100 else rng.normal(size=3).tolist()) for at, i in enumerate(ids)]
    points = spark.createDataFrame(rows, "id long, x array<double>")
    query = spark.createDataFrame([(1000, [1.0, 2.0, 3.0])], "id long, x array<double>")
    for block_rows in (37, 20_000):
        got = sp.nearest(query, points, 5, "id", "x", block_rows).orderBy("place").collect()
        assert [r.p_id for r in got] == sorted(ids[:100])[:5]


@pytest.mark.parametrize("hot_rows", [1, 5_000_000])
def test_a_total_that_hits_the_limit_is_not_over_it(spark, hot_rows):
    admins = spark.range(50).select(
        F.col("id").alias("admin_id"), F.lit(1).cast("long").alias("person_id"), F.lit(0.1).alias("given_dose"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("admin_datetime"))
    eras = spark.sql("""SELECT 1L AS admission_id, 1L AS person_id, timestamp_ntz'2024-01-01 00:00:00' AS era_start_datetime,
        timestamp_ntz'2024-01-02 00:00:00' AS era_end_datetime""")
    assert w.dose_over_limit(admins, eras, 5.0, hot_rows).count() == 0
    over = w.dose_over_limit(admins, eras, 4.9, hot_rows).collect()
    assert [(r.admin_id, r.cum_daily_dose) for r in over] == [(49, 5.0)]


def test_rows_without_a_score_take_no_part(spark):
    rows = [("s", "dev", i, i % 2, p) for i, p in enumerate([0.1, 0.8, 0.4, 0.9, 0.2, 0.7])]
    blank = [("s", "dev", 90, 1, None), ("s", "dev", 91, 0, None), ("s", "dev", 92, 0, float("nan")), ("s", "dev", 93, None, 0.5)]
    schema = "study_name string, dataset string, id long, y_true int, y_pred double"
    full, some = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + blank, schema)
    by = ["study_name", "dataset"]
    for measure in (
        lambda d: m.evaluation_metrics(d),
        lambda d: m.net_benefit(d, by),
        lambda d: m.roc(d, by),
        lambda d: m.calibration(d, by, "id", 2),
        lambda d: m.set_evaluation(d, by),
    ):
        assert sorted(map(str, measure(full).collect())) == sorted(map(str, measure(some).collect()))


def test_constants(spark):
    one = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, v double")
    assert [r.z for r in w.zscore(one, "v", "z").collect()] == [None, None]
    factors = spark.createDataFrame([("v", 5.0, 0.0)], "feature_name string, centre double, scale double")
    assert [r.v for r in rs.normalise(one, factors).collect()] == [None, None]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,), (0.5,)], "v double")
    assert [r.c for r in df.select(clamp(F.col("v"), 0.0, 1.0).alias("c")).collect()] == [None, 0.0, 1.0, 0.5]


def test_one_valid_hour(spark):
    df = spark.sql("SELECT 1L AS id, timestamp_ntz'2024-01-01 07:30:00' AS ts UNION ALL SELECT 2L, timestamp_ntz'2024-01-01 12:00:01'")
    assert co.impute_hours(df, "ts", "id", 42).count() == 2


def test_class_weights_without_a_class(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, None)], "id long, y int")
    got = {r.id: r.weight for r in sp.class_weights(df, "y").collect()}
    assert got == {1: 4 / 6, 2: 4 / 6, 3: 4 / 6, 4: 2.0, 5: None}


def test_an_empty_slice_is_emptied(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("007", 1), ("b", 2), ("a b/c", 3)], "s string, v int")
    t.replace_slice(rows, path, "s")
    t.replace_slice(rows.filter("v > 5"), path, "s", ["007", "a b/c"])
    assert [(r.s, r.v) for r in spark.read.schema(rows.schema).parquet(path).collect()] == [("b", 2)]


def test_quoted_signs_are_no_parameters(spark):
    text = "SELECT 'a@b' AS x, \"@c\" AS y, @v AS z -- @d\n/* @e */"
    assert tuple(t.run_sql(spark, text, v=3).first()) == ("a@b", "@c", 3)


def test_a_run_leaves_nothing(spark):
    before = len(session.child_paths(spark, session.shared_dir(spark)))
    with session.run_scope(spark):
        session.durable(spark.range(3)).createOrReplaceTempView("left_by_a_run")
        assert len(session.child_paths(spark, session.shared_dir(spark))) == before + 1
    assert len(session.child_paths(spark, session.shared_dir(spark))) == before
    assert not spark.catalog.tableExists("left_by_a_run")
