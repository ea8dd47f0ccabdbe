from datetime import datetime

import pytest
from pyspark.sql import functions as F

from episodica.operators import quantiles as q
from episodica.operators import reshape as rs
from episodica.operators import windows as w


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, i % 7, datetime(2015, 6 if i < 60 else 8, 1), float(i * i % 31), i % 2, 5) for i in range(100)]
    rows += [(200, 99, datetime(2015, 8, 1), 3.0, 1, 5)]
    return spark.createDataFrame(rows, "admission_id long, person_id long, index_datetime timestamp_ntz, age double, flag int, same int")


def test_split(table):
    out = rs.temporal_split(table, "index_datetime", "2015-07-01", "person_id")
    sets = {r["set"]: r["count"] for r in out.groupBy("set").count().collect()}
    assert sets == {"dev": 60, "test_seen": 40, "test_new": 1}
    parts = rs.data_sets(out)
    assert parts["test"].count() == 41 and parts["test_new"].count() == 1
    dev = {r[0] for r in parts["dev"].select("person_id").collect()}
    assert not dev & {r[0] for r in parts["test_new"].select("person_id").collect()}


def test_normalisation_round_trip(table):
    factors = rs.fit_norm(table, ["age", "flag"])
    found = rs.norm_factors(factors)
    assert found["flag"] == (None, None) and found["age"][1] > 0
    scaled = rs.normalise(table, factors)
    stats = scaled.agg(F.avg("age"), F.stddev_samp("age")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)
    back = {r.admission_id: r.age for r in rs.denormalise(scaled, factors).collect()}
    assert back == {r.admission_id: r.age for r in table.collect()}
    long = rs.denormalise_long(rs.long_form(scaled, ["admission_id"], ["age", "flag"]), factors)
    assert {r.admission_id: r.feature_value for r in long.filter("feature = 'age'").collect()} == back


def test_constant_feature_gives_null_not_an_error(table):
    factors = rs.fit_norm(table, ["same"])
    assert rs.norm_factors(factors)["same"] == (5.0, 0.0)


def test_one_hot_with_pinned_values(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "admission_id int, v string")
    base = spark.createDataFrame([(1,), (2,), (3,)], "admission_id int")
    out = rs.left_one_hot(base, df, "v", "v_", values=["a", "b", "z"]).orderBy("admission_id")
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1, 0), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert rs.one_hot(df, "admission_id", "v", "v_").columns == ["admission_id", "v_a", "v_b", "v_c"]
    assert rs.vocabulary(df.union(spark.createDataFrame([(4, None)], df.schema)), "v") == ["a", "b", "c"]


@pytest.mark.parametrize("qs", [(0.0, 0.25, 0.5), (0.75, 0.999, 1.0)])
def test_exact_quantiles(spark, qs):
    import numpy as np

    rng = np.random.default_rng(1)
    values = {g: np.round(rng.normal(size=n), 1) for g, n in (("a", 1), ("b", 2), ("c", 501))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double").repartition(5)
    names = {f"q{i}": p for i, p in enumerate(qs)}
    for r in q.exact_quantiles(df, ["g"], "v", names).collect():
        assert [r[n] for n in names] == pytest.approx([np.quantile(values[r.g], p) for p in qs])
    whole = np.concatenate(list(values.values()))
    row = q.exact_quantiles(df, [], "v", names).first()
    assert [row[n] for n in names] == pytest.approx([np.quantile(whole, p) for p in qs])


@pytest.mark.parametrize("n", [3, 10, 50])
def test_ntile(spark, n):
    from pyspark.sql import Window as W

    df = spark.createDataFrame([(i % 2, float(i * 7 % 5), i) for i in range(41)], "g int, v double, id long")
    got = q.ntile_by(df, ["g"], "v", "id", n)
    want = df.withColumn("bin", F.ntile(n).over(W.partitionBy("g").orderBy("v", "id")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_trim_upper(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1001)] + [("b", 1.0)], "g string, v double")
    kept = q.trim_upper(df, ["g"], "v", 0.999)
    assert kept.groupBy("g").agg(F.max("v")).orderBy("g").collect()[0][1] == 999.0
    assert kept.filter("g = 'b'").count() == 1
    whole = q.trim_upper(df, [], "v", 0.999)
    assert whole.count() == 1000 and whole.agg(F.max("v")).first()[0] == 998.0


def test_small_windows(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 4.0), (3, "a", 2.0), (4, "a", 8.0)], "id long, g string, v double")
    scaled = {r.id: r.s for r in w.min_max_scale(df, ["g"], "v", "s").collect()}
    assert scaled == {1: 0.0, 2: None, 3: 0.0, 4: 1.0}
    flags = {r.id: r.f for r in w.first_seen(df.withColumn("set", F.lit("x")), ["g"], ["set"], "id", "f").collect()}
    assert flags == {1: 1, 2: 1, 3: 0, 4: 0}
    codes = {r.id: r.code for r in w.category_code(df.withColumn("all", F.lit(1)), ["all"], "g").collect()}
    assert codes == {1: 1, 2: 2, 3: 1, 4: 1}
    best = w.top_by(df, ["g"], [F.col("v"), F.col("id")], ["id", "v"]).orderBy("g").collect()
    assert [tuple(r) for r in best] == [("a", 1, 2.0), ("b", 2, 4.0)]
