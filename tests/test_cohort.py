from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from episodica.operators import cohort as c
from episodica.operators import outcomes as oc
from episodica.operators.windows import dose_over_limit

D = datetime(2010, 1, 10, 8, 0, 0)
SINCE, UNTIL = "2006-01-01 00:00:00", "2016-06-30 23:59:59"
ADM = "admission_id long, person_id long, admission_datetime timestamp_ntz, discharge_datetime timestamp_ntz"


def hours(n):
    return timedelta(hours=n)


def days(n):
    return timedelta(days=n)


def ids(df, col="admission_id"):
    return sorted(r[col] for r in df.select(col).collect())


def test_eligible_edges(spark):
    adm = spark.createDataFrame(
        [(1, 1, D, D + hours(25)), (2, 1, D, D + hours(25) - timedelta(seconds=1)),
         (3, 2, D, D + days(3)), (4, 3, D, D + days(3)),
         (5, 1, datetime(2005, 12, 31), datetime(2006, 1, 3)), (6, 1, datetime(2016, 6, 28), datetime(2016, 7, 1))], ADM)
    # 18 * 365.25 = 6574.5 days: 6575 days are enough, 6574 are not
    born = D.date()
    persons = spark.createDataFrame(
        [(1, date(1950, 1, 1), "Male"), (2, born - days(6575), "Female"), (3, born - days(6574), "Male")],
        "person_id long, date_of_birth date, sex string")
    assert ids(c.eligible(adm, persons, SINCE, UNTIL)) == [1, 3]


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_washout(spark, hot_rows):
    adm = spark.createDataFrame(
        [(1, 1, D, D + days(2)), (2, 1, D + days(32), D + days(33)),  # gap of exactly 30 days: kept
         (3, 1, D + days(62), D + days(70)),  # 29 days: dropped
         (4, 1, D + days(99), D + days(100)),  # 29 days after 3, which is itself dropped: dropped
         (5, 2, D, D + days(200)), (6, 2, D + days(10), D + days(12)),  # nested: negative gap
         (7, 2, D + days(50), D + days(51))], ADM)  # compared with 6, not with the longer 5: kept
    assert ids(c.washout(adm, 30, hot_rows=hot_rows)) == [1, 2, 5, 7]


def test_every_person_keeps_an_admission(spark, sf):
    from episodica.plans import proxies as P

    stays = P.stays_long(spark, sf)
    kept = c.washout(stays, 30)
    assert kept.select("person_id").distinct().count() == stays.select("person_id").distinct().count()


def test_imputation(spark):
    valid = [(i, datetime(2010, 1, 1 + i % 20, 8 + i % 5, 10, 30)) for i in range(200)]
    broken = [(1000 + i, datetime(2010, 2, 1, 0, 0, 1)) for i in range(200)]
    df = spark.createDataFrame(valid + broken, "id long, ts timestamp_ntz")
    out = {r.id: r.ts for r in c.impute_hours(df, "ts", "id", 42).collect()}
    assert all(out[i] == ts for i, ts in valid)
    drawn = [out[1000 + i] for i in range(200)]
    assert all(t.date() == date(2010, 2, 1) and t.second == 1 for t in drawn)
    assert 7 <= min(t.hour for t in drawn) and max(t.hour for t in drawn) <= 13
    assert len({t.hour for t in drawn}) >= 4
    again = {r.id: r.ts for r in c.impute_hours(df.repartition(7), "ts", "id", 42).collect()}
    assert again == out


def test_bandwidth(spark):
    values = [8, 9, 9, 10, 14, 20, 21, 3]
    df = spark.createDataFrame([(datetime(2010, 1, 1, h, 0, 30),) for h in values], "ts timestamp_ntz")
    import numpy as np

    sd, iqr = np.std(values, ddof=1), np.subtract(*np.percentile(values, [75, 25]))
    want = 0.9 * min(sd, iqr / 1.34) * len(values) ** -0.2
    assert c.hour_distribution(df, "ts").first().bw == pytest.approx(want)


PERSONS = [(1, date(1950, 1, 1), "Male"), (2, date(1950, 1, 1), "Female")]


def make_cohort(spark, labs, adm, **kw):
    persons = spark.createDataFrame(PERSONS, "person_id long, date_of_birth date, sex string")
    return c.cohort(labs, spark.createDataFrame(adm, ADM), persons, SINCE, UNTIL, **kw)


def make_labs(spark, rows):
    return spark.createDataFrame(
        [(i, p, v, t) for i, (p, v, t) in enumerate(rows)], "lab_id long, person_id long, egfr double, egfr_datetime timestamp_ntz")


def test_cohort_needs_a_low_value_in_the_first_hours(spark):
    labs = make_labs(spark, [(1, 30.0, D + hours(25)), (2, 30.1, D), (2, 20.0, D + hours(25) + timedelta(seconds=1))])
    out = make_cohort(spark, labs, [(1, 1, D, D + days(4)), (2, 2, D, D + days(4))]).collect()
    assert [(r.admission_id, r.los_hours, r.index_datetime) for r in out] == [(1, 96, D + hours(25))]


def test_index_does_not_follow_the_imputed_hour(spark):
    start = datetime(2010, 1, 10, 0, 0, 1)
    others = [(i, 2, D + days(60 * i), D + days(60 * i + 3)) for i in range(2, 12)]
    labs = make_labs(spark, [(1, 10.0, start + hours(24))])
    out = make_cohort(spark, labs, [(1, 1, start, start + days(4)), *others], seed=42).collect()
    assert [r.admission_id for r in out] == [1]
    assert out[0].index_datetime == start + hours(25)
    assert out[0].admission_datetime.hour == 8


def eras_of(spark, values, los_days=10, **kw):
    labs = make_labs(spark, [(1, v, t) for v, t in values])
    cohort = make_cohort(spark, labs, [(1, 1, D, D + days(los_days))])
    out = c.derive_eras(labs, cohort, **kw)
    return [tuple(r) for r in out.select("egfr_is_low", "era_start_datetime", "era_end_datetime").orderBy("era_start_datetime", "era_end_datetime").collect()]


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_eras(spark, hot_rows):
    values = [(20.0, D + hours(1)), (25.0, D + hours(5)), (40.0, D + days(2)), (50.0, D + days(3)), (30.0, D + days(4))]
    got = eras_of(spark, values, hot_rows=hot_rows)
    second = timedelta(seconds=1)
    # the last era ends at index + (stay - 24 h), an hour past discharge
    assert got == [
        (True, D + hours(1), D + days(2) - second), (False, D + days(2), D + days(4) - second),
        (True, D + days(4), D + hours(25) + days(10) - hours(24))]


def test_tied_times_are_ordered_by_value(spark):
    got = eras_of(spark, [(40.0, D + hours(2)), (20.0, D + hours(2))])
    assert got == [
        (True, D + hours(2), D + hours(2) - timedelta(seconds=1)), (False, D + hours(2), D + hours(25) + days(10) - hours(24))]


def test_follow_up_cap(spark):
    got = eras_of(spark, [(20.0, D), (50.0, D + hours(25) + days(30)), (20.0, D + hours(26) + days(30))], los_days=100)
    assert got[-1][2] == D + hours(25) + days(30) and len(got) == 2


def test_eras_alternate_and_do_not_overlap(spark):
    from episodica.plans import proxies as P

    eras = P.eras_of(spark, "/root/testdata/sf0.01").orderBy("admission_id", "era_start_datetime").collect()
    assert eras
    for a, b in zip(eras, eras[1:]):
        if a.admission_id == b.admission_id:
            assert a.egfr_is_low != b.egfr_is_low
            assert a.era_end_datetime < b.era_start_datetime


def test_run_ids_number_runs(spark):
    flags = [True, True, False, True, True, False, False]
    df = spark.createDataFrame([(1, D + hours(i), i, f) for i, f in enumerate(flags)], "a int, t timestamp_ntz, id long, low boolean")
    out = c.run_ids(df, "a", ["t", "id"], "low", hot_rows=1).orderBy("id").collect()
    assert [r.run_id for r in out] == [1, 1, 2, 3, 3, 4, 4]


ERAS = "admission_id long, person_id long, egfr_is_low boolean, era_start_datetime timestamp_ntz, era_end_datetime timestamp_ntz"
ADMINS = "admin_id long, person_id long, admin_datetime timestamp_ntz, given_dose double, atc string"


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_running_dose_adds_row_by_row(spark, hot_rows):
    eras = spark.createDataFrame([(1, 1, True, D, D + days(3))], ERAS)
    same = D + hours(2)
    admins = spark.createDataFrame(
        [(1, 1, D, 2.5, "B01AF02"), (2, 1, same, 2.5, "B01AF02"), (3, 1, same, 2.5, "B01AF02"),  # equal times: 5.0, then 7.5
         (4, 1, D + days(1), 5.0, "B01AF02"), (5, 1, D + days(3), 6.0, "B01AF02"), (6, 1, D + days(3, ) + hours(1), 9.0, "B01AF02")], ADMINS)
    assert ids(dose_over_limit(admins, eras, 5.0, hot_rows), "admin_id") == [3, 5]


def test_outcomes(spark):
    eras = spark.createDataFrame(
        [(1, 1, True, D, D + days(3)), (1, 1, False, D + days(4), D + days(5)), (2, 2, True, D, D + days(40)),
         (3, 2, False, D, D + days(4)), (4, 3, True, D, D + hours(12))], ERAS)
    admins = spark.createDataFrame(
        [(1, 1, D, 1.0, "A10BA02"), (2, 1, D + days(3), 1.0, "A10BA02"), (3, 1, D + days(4), 1.0, "A10BA02"),
         (4, 1, D + hours(1), 4.0, "B01AF02"), (5, 1, D + hours(2), 4.0, "B01AF02"), (6, 2, D + days(39), 1.0, "M01AE01")], ADMINS)
    out = {r.admission_id: r for r in oc.outcomes(eras, admins, ["B01AF02", "A10BA02", "M01AE01"], "B01AF02").collect()}
    assert sorted(out) == [1, 2, 4]  # admission 3 has no low era
    assert (out[1].r, out[1].r_a10ba02, out[1].r_b01af02, out[1].time_at_risk) == (3, 2, 1, 3.0)
    assert (out[2].r, out[2].r_m01ae01, out[2].time_at_risk) == (1, 1, 30.0)
    assert (out[4].r, out[4].time_at_risk) == (0, 0.5)


def test_total_is_sum_of_drugs(spark, sf):
    from episodica.plans import feature_queries as fq
    from episodica.plans import proxies as P

    out = oc.outcomes(fq._wide_eras(spark, sf), P.target_admins(spark, sf), P.TARGET_ATC, P.APIXABAN)
    parts = sum((F.col(c) for c in out.columns if c.startswith("r_")), F.lit(0))
    assert out.count() > 0 and out.filter(F.col("r") != parts).count() == 0
