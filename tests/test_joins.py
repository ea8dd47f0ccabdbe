import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from episodica import session
from episodica.operators import features as ft
from episodica.operators import joins as j

T0 = datetime(2024, 2, 27, 22, 0)


def at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    data = [(1 if rng.random() < 0.5 else rng.randrange(5), i, at(rng.randrange(0, 400)), rng.choice("abc")) for i in range(300)]
    return spark.createDataFrame(data, "p int, id long, ts timestamp_ntz, code string")


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(4)
    data = []
    for i in range(60):
        start = rng.randrange(0, 400)
        data.append((1 if rng.random() < 0.5 else rng.randrange(5), 1000 + i, at(start), at(start + rng.choice([-3, 0, 1, 5, 25, 90]))))
    return spark.createDataFrame(data, "p int, span long, lo timestamp_ntz, hi timestamp_ntz")


def brute(points, spans):
    ps, ss = points.collect(), spans.collect()
    return [(s, p) for s in ss for p in ps if s.p == p.p and s.lo <= p.ts <= s.hi]


@pytest.mark.parametrize("width", [1, 24, 120])
def test_interval_join(points, spans, width):
    got = j.interval_join(points, spans, "p", "ts", "lo", "hi", width).select("span", "id").collect()
    assert sorted(map(tuple, got)) == sorted((s.span, p.id) for s, p in brute(points, spans))


@pytest.mark.parametrize("width", [1, 24])
def test_seen_in_span(points, spans, width):
    got = j.seen_in_span(points, spans, "p", "ts", "lo", "hi", ["code"], ["span"], width).collect()
    assert sorted(map(tuple, got)) == sorted({(s.span, p.code) for s, p in brute(points, spans)})


def test_seen_in_span_when_all_spans_cross(points, spans):
    long = spans.filter(F.col("hi") >= F.col("lo") + F.expr("INTERVAL 25 HOURS"))
    got = j.seen_in_span(points, long, "p", "ts", "lo", "hi", ["code"], ["span"], 24, True).collect()
    assert sorted(map(tuple, got)) == sorted({(s.span, p.code) for s, p in brute(points, long)})


def test_dyadic_join(spark, points, spans):
    far = spark.createDataFrame(
        [(1, 2000, datetime(1900, 1, 1), datetime(9999, 12, 31)), (1, 2001, at(20), at(20)), (1, 2002, datetime(1969, 12, 31), at(90)),
         (1, 2003, None, at(4)), (1, 2004, at(4), None), (None, 2005, at(0), at(400))],
        "p int, span long, lo timestamp_ntz, hi timestamp_ntz")
    many = spans.unionByName(far)
    early = spark.createDataFrame([(1, 900, datetime(1969, 12, 31, 23, 59, 59, 999999), "a"), (1, 901, None, "a")], points.schema)
    all_points = points.unionByName(early)
    got = j.dyadic_join(all_points, many, "p", "ts", "lo", "hi").select("span", "id").collect()
    known = many.filter("p is not null and lo is not null and hi is not null")
    want = brute(all_points.filter("ts is not null"), known)
    assert len(want) > 500 and sorted(map(tuple, got)) == sorted((s.span, p.id) for s, p in want)
    assert j.dyadic_join(all_points, many.limit(0), "p", "ts", "lo", "hi").count() == 0
    assert j.dyadic_join(points.limit(0), many, "p", "ts", "lo", "hi").count() == 0


def test_spans_without_an_end(spark, points):
    """Placeholder dates far away must not be unfolded bucket by bucket."""
    open_ended = spark.createDataFrame(
        [(1, 1, datetime(1900, 1, 1), datetime(9999, 12, 31)), (2, 2, datetime(9000, 1, 1), datetime(9999, 12, 31))],
        "p int, span long, lo timestamp_ntz, hi timestamp_ntz")
    spread = j._spread(open_ended, "lo", "hi", 1, points, "ts")
    assert spread.count() <= 401
    mine = points.filter("p = 1")
    assert j.interval_join(points, open_ended, "p", "ts", "lo", "hi", 1).count() == mine.count()
    seen = j.seen_in_span(points, open_ended, "p", "ts", "lo", "hi", ["code"], ["span"], 1)
    assert seen.count() == mine.select("code").distinct().count()


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_count_in_range(points, spans, hot_rows):
    usable = spans.filter(F.col("hi") >= F.col("lo"))
    got = j.count_in_range(usable, points, "p", "span", F.col("lo"), F.col("hi"), "ts", "n", hot_rows=hot_rows)
    want = {s.span: 0 for s in usable.collect()}
    for s, _ in brute(points, usable):
        want[s.span] += 1
    assert dict(map(tuple, got.collect())) == want


def test_look_back_is_closed_and_knows_leap_days(spark):
    anchors = spark.createDataFrame([(1, 10, date(2024, 2, 29)), (1, 11, date(2023, 3, 1))], "p int, a int, d date")
    events = spark.createDataFrame(
        [(1, "x", date(2019, 2, 28)), (1, "y", date(2019, 2, 27)), (1, "z", date(2024, 2, 29)), (1, "w", date(2024, 3, 1)),
         (1, "v", date(2018, 3, 1)), (1, "u", date(2018, 2, 28))], "p int, code string, day date")
    want = [(10, "x"), (10, "z"), (11, "v"), (11, "x"), (11, "y")]
    seen = j.seen_in_years(events, anchors, "p", "day", "d", 5, ["code"], ["a"])
    assert sorted(map(tuple, seen.collect())) == want
    pairs = j.lookback_join(anchors, events, "p", "day", "d", 5).select("a", "code")
    assert sorted(map(tuple, pairs.collect())) == want


def test_seen_before_is_strict(spark):
    anchors = spark.createDataFrame([(1, 10, date(2024, 1, 5))], "p int, a int, d date")
    events = spark.createDataFrame([(1, "x", date(2024, 1, 5)), (1, "y", date(1990, 1, 1))], "p int, code string, day date")
    assert [r.code for r in j.seen_before(events, anchors, "p", "day", "d", ["code"], ["a"]).collect()] == ["y"]


def test_multiplicity(spark):
    cohort = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "person_id int, admission_id int")
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "person_id int, x string")
    assert j.restrict_to(facts, cohort, "person_id").count() == 2
    assert sorted(r.x for r in j.restrict_to(facts, cohort, "person_id", "reference").collect()) == ["a", "a", "b"]
    with pytest.raises(ValueError):
        j.restrict_to(facts, cohort, "person_id", "sometimes")


def test_settings_grid(spark):
    grid = j.settings_grid(spark, a=["x", "y"], b=[1, 2, 3])
    assert sorted(map(tuple, grid.collect())) == [(a, b) for a in "xy" for b in (1, 2, 3)]


def test_comorbidity_scores_bring_no_category_together(spark):
    """Weights are met per code, not by a shuffle of all that was seen by category; missing, repeated and null weights."""
    cohort = spark.createDataFrame([(i, i % 3, "2020-01-02") for i in range(6)], "admission_id long, person_id long, at string")
    cohort = cohort.withColumn("admission_datetime", F.to_timestamp("at"))
    visits = spark.createDataFrame([(0, 0, "2020-01-01"), (1, 1, "2020-01-01"), (2, 0, "2019-01-01"), (3, 2, "2020-01-02")],
        "visit_id long, person_id long, at string").select("visit_id", "person_id", F.to_date("at").alias("departure_date"))
    diagnoses = spark.createDataFrame([(0, "DA10"), (0, "DB10"), (1, "DC10"), (2, "DA11"), (2, "DD1"), (3, "DA10")], "visit_id long, diag_code string")
    prefixes = spark.createDataFrame([("A1", "a"), ("A10", "a"), ("B", "b"), ("C", "c"), ("D", "d")], "prefix string, category string")
    weights = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), ("d", None)], "category string, weight int")
    out = ft.comorbidity_scores(cohort, visits, diagnoses, prefixes, weights)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan and "hashpartitioning(category#" not in plan
    assert sorted((r.admission_id, r.elixhauser_score_ahrq) for r in out.collect()) == [(0, 9), (1, 0), (2, 0), (3, 9), (4, 0), (5, 0)]


def test_shuffle_partitions_are_gathered_small_unless_set(spark):
    try:
        for given, want in ((None, "16m"), ("8m", "8m")):
            spark.conf.unset(session.ADVISORY) if given is None else spark.conf.set(session.ADVISORY, given)
            assert session.configure(spark).conf.get(session.ADVISORY) == want
    finally:
        spark.conf.unset(session.ADVISORY)
        session.configure(spark)
