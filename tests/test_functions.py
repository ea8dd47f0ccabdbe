from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from episodica.functions import text as x
from episodica.functions import timing as tm
from episodica.operators import filters as fl


def apply(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parse_number(spark):
    got = apply(spark, ["5 mg", "1,234.5 mg", "x-3", "P007", "none", None, "1e-4"], x.parse_number)
    assert got == [5.0, 1234.5, -3.0, 7.0, None, None, 1e-4]


def test_parse_ts(spark):
    got = apply(spark, ["31-12-2010 23:59:01", "2010-12-31 23:59:01", "31.12.2010"],
                lambda c: x.parse_ts(c, "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"))
    assert got == [datetime(2010, 12, 31, 23, 59, 1)] * 2 + [None]


def test_codes(spark):
    assert apply(spark, ["DN1834"], lambda c: x.code_part(c, 2)) == ["N1834"]
    assert apply(spark, ["N185", "N186", "N18"], x.ckd_stage) == ["N185", "N189", "N189"]
    assert apply(spark, ["B01AF02", "C03", "B01AF0", None], lambda c: c.rlike(x.FULL_ATC)) == [True, False, False, None]
    assert apply(spark, ["N02:BE:01"], lambda c: x.strip_chars(c, ":")) == ["N02BE01"]


def test_text(spark):
    assert apply(spark, ["ABC def", ""], x.sentence) == ["Abc def", ""]
    assert apply(spark, ["abc"], x.reverse_text) == ["cba"]
    assert apply(spark, ["a__b_c"], lambda c: x.prettify(c, [("__", ", "), ("_", " ")])) == ["a, b c"]
    assert apply(spark, ["mg/ml", "MG"], x.dose_unit) == ["mg", "mg"]
    titles = apply(spark, ["n_previous_admissions", "icd10_chapter_4", "age_at_admission"], x.feature_title)
    assert titles == ["No. previous admissions", "ICD10 chapter 4", "Age at admission"]


@pytest.mark.parametrize("cell,want", [("0 (0.0)", "0 (0.0)"), ("1 (2.0)", "<5"), ("4 (2.0)", "<5"), ("5 (2.0)", "5 (2.0)"), ("12.5 [1, 2]", "12.5 [1, 2]"), ("", "")])
def test_redaction(spark, cell, want):
    assert apply(spark, [cell], x.redact) == [want]


def test_cut_is_right_closed(spark):
    inf = float("inf")
    got = apply(spark, [-1.0, 0.0, 0.5, 2.0, 2.1, 7.0, None], lambda c: x.cut(c, [-inf, 0, 2, 4, 6, inf], ["0", "1-2", "3-4", "5-6", ">6"]), "double")
    assert got == ["0", "0", "1-2", "1-2", "3-4", ">6", None]
    # an open lower end: values at or below the first break have no label
    assert apply(spark, [0.0, 0.5], lambda c: x.cut(c, [0, 1], ["a"]), "double") == [None, "a"]


def test_rate_flag_without_time_at_risk(spark):
    df = spark.createDataFrame([(0, 0.0), (3, 0.0), (3, 3.0), (2, 3.0), (None, 3.0)], "r int, t double")
    assert [r[0] for r in df.select(x.rate_flag(F.col("r"), F.col("t"), 1)).collect()] == [None, 1, 1, 0, None]


def test_age(spark):
    cases = [(date(2000, 2, 29), date(2001, 2, 28), 1.0), (date(2000, 2, 29), date(2004, 2, 29), 4.0),
             (date(1990, 6, 15), date(2010, 6, 14), 19 + 364 / 365), (date(1990, 6, 15), date(2010, 6, 15), 20.0),
             (date(1990, 1, 31), date(2010, 2, 28), 20 + 28 / 365)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, dob date, d date")
    got = [r[0] for r in df.orderBy("i").select(tm.age_years(F.col("dob"), F.col("d"))).collect()]
    assert got == pytest.approx([w for _, _, w in cases])


def test_time(spark):
    ts = [datetime(2024, 1, 7, 0, 30), datetime(2024, 1, 8, 12, 0), datetime(2024, 1, 9, 23, 59)]
    assert apply(spark, ts, tm.cyclic_hour, "timestamp_ntz") == [12, 0, 11]
    assert apply(spark, ts, tm.weekday, "timestamp_ntz") == ["sun", "mon", "tue"]
    assert apply(spark, [datetime(2024, 2, 29)], lambda c: tm.years_before(c, 5), "timestamp_ntz") == [datetime(2019, 2, 28)]
    df = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 2, 0, 59))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(tm.hours_between(F.col("a"), F.col("b"))).first()[0] == 24
    assert apply(spark, [0, 6], lambda c: tm.circle_hour(F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), c, F.lit(0), F.lit(0))), "int") == pytest.approx([1.0, 1.0])


def test_json(spark):
    dist = F.lit('{"name": "CategoricalDistribution", "attributes": {"choices": ["a", 64]}}')
    assert apply(spark, [0.0, 1.0], lambda c: x.json_choice(dist, c), "double") == ["a", "64"]
    assert apply(spark, [0.25], lambda c: x.json_choice(F.lit("{}"), c), "double") == ["0.25"]
    assert apply(spark, ['{"loss": 0.5}', "{}"], lambda c: x.json_num(c, "$.loss")) == [0.5, None]


def test_filters(spark):
    df = spark.createDataFrame([("T1",), ("X2",), ("33",), (None,)], "person_id string")
    assert sorted(r[0] or "" for r in fl.exclude_regex(df, "person_id", "^[TX]").collect()) == ["", "33"]
    # nothing matches: everything stays
    assert fl.exclude_regex(df, "person_id", "^Q").count() == 4
    doses = spark.createDataFrame([(1.0, "mg"), (0.0, "mg"), (None, "mg"), (1.0, None)], "given_dose double, given_dose_unit string")
    assert fl.positive_dose(doses).count() == 1
    wide = spark.createDataFrame([(1, None, None, 2), (2, None, 5, 0)], "a int, b int, c int, n18_x int")
    assert fl.drop_empty(wide).columns == ["a", "c", "n18_x"]
    assert fl.feature_columns(wide.withColumn("r", F.lit(1))) == ["a", "b", "c", "n18_x"]
    assert fl.feature_columns(wide.withColumn("age_at_admission", F.lit(1)), "refmodel") == ["age_at_admission"]
    assert fl.feature_columns(wide, "unknown") == wide.columns
    assert [r.m for r in fl.row_max(wide.na.fill(0), "n18_", "m").collect()] == [2, 0]


def test_prefix_filter_reaches_the_scan(spark, sf):
    df = fl.starts_with_any(spark.read.parquet(f"{sf}/events.parquet"), "event_type", ["pur", "sig"]).select("event_id")
    plan = df._jdf.queryExecution().toString()
    assert "StringStartsWith" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


