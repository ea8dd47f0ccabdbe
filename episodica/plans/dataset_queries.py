"""Queries for reshaping, assembling, splitting and normalising data sets."""

from pyspark.sql import functions as F

from episodica.operators import features as ft
from episodica.operators import filters as fl
from episodica.operators import outcomes as oc
from episodica.operators import reshape as rs
from episodica.plans import feature_queries as fq
from episodica.plans import proxies as P
from episodica.plans.proxies import TARGET_ATC, with_views
from episodica.plans.registry import query
from episodica.session import durable

CUTOFF = "2024-01-08"
CODES = sorted(P.DIAGNOSES)
ATC2 = ["A10", "B01", "L04", "M01", "N02", "N05"]
CKD = ["N181", "N182", "N185", "N189"]
CHAPTERS = [2, 4, 9, 10, 14]
WEEK = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]


def _dx_by_person(spark, sf):
    return P.visits(spark, sf).join(P.diagnoses(spark, sf), "visit_id").select("person_id", "diag_code")


DX_BY_PERSON = "SELECT person_id, diag_code FROM visits JOIN diagnoses USING (visit_id)"
HOT = ", ".join(f"""max(CASE WHEN diag_code = '{c}' THEN 1 ELSE 0 END) AS "dx_{c}" """ for c in CODES)


@query("union_by_name", with_views("""SELECT admin_id, atc, 'a' AS source FROM drug_admins WHERE admin_id % 3 = 0
    UNION ALL SELECT admin_id, atc, 'b' FROM drug_admins WHERE admin_id % 3 = 1
    UNION ALL SELECT admin_id, atc, 'c' FROM drug_admins WHERE admin_id % 3 = 2""", "drug_admins"))
def union_by_name(spark, sf):
    admins = P.drug_admins(spark, sf)
    parts = [
        fl.tag(admins.filter(F.col("admin_id") % 3 == i), name, cols)
        for i, (name, cols) in enumerate(
            [("a", ["admin_id", "atc", "source"]), ("b", ["atc", "source", "admin_id"]), ("c", ["source", "admin_id", "atc"])])
    ]
    return rs.union_all(*parts)


@query("union_fill", with_views("""SELECT admission_id AS id, person_id, NULL AS atc FROM stays
    UNION ALL SELECT admin_id, person_id, atc FROM drug_admins""", "stays", "drug_admins"))
def union_fill(spark, sf):
    a = P.stays(spark, sf).select(F.col("admission_id").alias("id"), "person_id")
    return rs.union_fill(a, P.drug_admins(spark, sf).select(F.col("admin_id").alias("id"), "person_id", "atc"))


@query("union_labelled", with_views("""SELECT admission_id, 'short' AS horizon FROM stays
    UNION ALL SELECT admission_id, 'long' FROM stays_long""", "stays", "stays_long"))
def union_labelled(spark, sf):
    frames = {"short": P.stays(spark, sf).select("admission_id"), "long": P.stays_long(spark, sf).select("admission_id")}
    return rs.union_with_label(frames, "horizon")


@query("pivot_counts", "SELECT user_id, " + ", ".join(
    f"coalesce(sum(CASE WHEN event_type = '{e}' THEN 1 END), 0) AS {e}" for e in ("click", "error", "purchase", "signup", "view"))
    + " FROM events GROUP BY user_id")
def pivot_counts(spark, sf):
    counts = P.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rs.pivot_fill(counts, "user_id", "event_type", "n")


@query("one_hot", with_views(f"SELECT person_id, {HOT} FROM ({DX_BY_PERSON}) d GROUP BY person_id", "visits", "diagnoses"))
def one_hot(spark, sf):
    return rs.one_hot(_dx_by_person(spark, sf), "person_id", "diag_code", "dx_")


@query("left_join_one_hot", with_views(
    "SELECT p.person_id, sex, " + ", ".join(f'coalesce("dx_{c}", 0) AS "dx_{c}"' for c in CODES)
    + f" FROM person p LEFT JOIN (SELECT person_id, {HOT} FROM ({DX_BY_PERSON}) d GROUP BY person_id) h USING (person_id)",
    "person", "visits", "diagnoses"))
def left_join_one_hot(spark, sf):
    base = P.person(spark, sf).select("person_id", "sex")
    return rs.left_one_hot(base, _dx_by_person(spark, sf), "diag_code", "dx_", by="person_id", values=CODES)


LONG = """SELECT p_partkey, 'p_size' AS feature, CAST(p_size AS DOUBLE) AS feature_value FROM part
    UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part"""


@query("unpivot", LONG)
def unpivot(spark, sf):
    return rs.long_form(P.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"])


@query("repivot", "SELECT p_partkey, p_size * 2.0 AS p_size, p_retailprice * 2 AS p_retailprice FROM part")
def repivot(spark, sf):
    long = rs.long_form(P.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"])
    doubled = long.withColumn("feature_value", F.col("feature_value") * 2)
    return rs.pivot_fill(doubled, "p_partkey", "feature", "feature_value", ["p_size", "p_retailprice"])


def modelling_table(spark, sf):
    """Eligible stays as cohort, whole stays as periods at risk, all feature tables."""
    cohort = durable(fq._all_stays(spark, sf), "cohort")
    admins = P.drug_admins(spark, sf)
    eras = fq._wide_eras(spark, sf).join(cohort.select("admission_id"), "admission_id", "left_semi")
    outcome = oc.outcomes(eras, P.target_admins(spark, sf), TARGET_ATC, P.APIXABAN)
    visits, dx = P.visits(spark, sf), P.diagnoses(spark, sf)
    return rs.build_dataset(
        outcome,
        cohort,
        single=[
            ft.prior_admissions(cohort, P.stays(spark, sf)),
            ft.n_distinct_drugs(cohort, admins),
            fq._comorbidity(spark, cohort, visits, dx),
        ],
        categories=[
            (ft.ckd_stages(cohort, visits, dx), "n18_diag", "n18_diag_", CKD),
            (ft.atc_groups(cohort, admins, 1), "atc_level2", "atc_level2_", ATC2),
            (ft.chapters(ft.icd10_groups(cohort, visits, dx, P.icd10(spark))), "icd10_chapter", "icd10_chapter_", CHAPTERS),
        ],
    )


def _hot(table, col, prefix, values, quote=True):
    marks = ", ".join(
        f"max(CASE WHEN {col} = {v!r} THEN 1 ELSE 0 END) AS \"{prefix}{v}\"" for v in values)
    return f"SELECT admission_id, {marks} FROM {table} GROUP BY admission_id"


def _zero(prefix, values):
    return ", ".join(f'coalesce("{prefix}{v}", 0) AS "{prefix}{v}"' for v in values)


AGE = """(year(d) - year(b) - CASE WHEN d < CAST(b + to_years(CAST(year(d) - year(b) AS INTEGER)) AS DATE) THEN 1 ELSE 0 END)"""
MODEL_VIEWS = dict(
    co="SELECT *, admission_datetime + INTERVAL 25 HOUR AS index_datetime FROM eligible",
    low="""SELECT admission_id, person_id, admission_datetime AS era_start_datetime,
        discharge_datetime AS era_end_datetime FROM eligible""",
    counts=fq.COUNTS,
    outc=fq.OUTCOMES,
    prev="""SELECT c.admission_id, count(a.admission_id) AS n_previous_admissions FROM eligible c LEFT JOIN stays a
        ON a.person_id = c.person_id AND a.discharge_datetime BETWEEN c.admission_datetime - INTERVAL 5 YEAR
        AND c.admission_datetime GROUP BY c.admission_id""",
    given=r"""SELECT DISTINCT c.admission_id, d.atc FROM eligible c JOIN drug_admins d ON d.person_id = c.person_id
        AND d.admin_datetime BETWEEN c.admission_datetime AND c.admission_datetime + INTERVAL 25 HOUR
        WHERE regexp_matches(d.atc, '^\w\d{2}\w{2}\d{2}')""",
    given2="SELECT DISTINCT admission_id, substr(atc, 1, 3) AS a FROM given",
    ndrugs="SELECT admission_id, count(*) AS n_distinct_drugs_before_index FROM given GROUP BY 1",
    dx=f"""SELECT DISTINCT c.admission_id, substr(d.diag_code, 2) AS diag_code FROM eligible c JOIN visits v
        ON v.person_id = c.person_id AND {fq.FIVE_YEARS} JOIN diagnoses d USING (visit_id)""",
    ckd="SELECT admission_id, diag_code AS c FROM dx WHERE diag_code LIKE 'N18%'",
    chap="SELECT admission_id, chapter AS c FROM dx JOIN icd10 USING (diag_code)",
    elix=fq.SCORE.replace("stays_long", "eligible").replace("visits_long", "visits").replace("diagnoses_long", "diagnoses"),
    h_ckd=_hot("ckd", "c", "n18_diag_", CKD),
    h_atc=_hot("given2", "a", "atc_level2_", ATC2),
    h_chap=_hot("chap", "c", "icd10_chapter_", CHAPTERS),
    modelling=f"""SELECT admission_id, person_id, index_datetime, CAST(r AS INTEGER) AS r, time_at_risk,
        {AGE} + (d - CAST(b + to_years(CAST({AGE} AS INTEGER)) AS DATE))::DOUBLE
            / (CAST(b + to_years(CAST({AGE} + 1 AS INTEGER)) AS DATE) - CAST(b + to_years(CAST({AGE} AS INTEGER)) AS DATE))
            AS age_at_admission,
        abs(12 - hour(admission_datetime)) AS hour_of_admission_cyclical,
        {", ".join(f"CAST(lower(substr(dayname(admission_datetime), 1, 3)) = '{w}' AS INTEGER) AS admitted_{w}" for w in WEEK)},
        CAST(sex = 'Female' AS INTEGER) AS sex_female, CAST(sex = 'Male' AS INTEGER) AS sex_male,
        coalesce(n_previous_admissions, 0) AS n_previous_admissions,
        coalesce(n_distinct_drugs_before_index, 0) AS n_distinct_drugs_before_index,
        coalesce(elixhauser_score_ahrq, 0) AS elixhauser_score_ahrq,
        {_zero('n18_diag_', CKD)}, {_zero('atc_level2_', ATC2)}, {_zero('icd10_chapter_', CHAPTERS)},
        CAST(r > 0 AS INTEGER) AS daily_rate_not_zero,
        {", ".join(f"CAST(r / time_at_risk >= {k} AS INTEGER) AS daily_rate_geq_{k}" for k in (1, 2, 3, 5))}
        FROM (SELECT *, CAST(admission_datetime AS DATE) AS d, date_of_birth AS b FROM co) c JOIN outc USING (admission_id)
        LEFT JOIN prev USING (admission_id) LEFT JOIN ndrugs USING (admission_id) LEFT JOIN elix USING (admission_id)
        LEFT JOIN h_ckd USING (admission_id) LEFT JOIN h_atc USING (admission_id) LEFT JOIN h_chap USING (admission_id)""",
    split=f"""SELECT *, CASE WHEN CAST(index_datetime AS DATE) < DATE '{CUTOFF}' THEN 'dev' WHEN person_id IN (
        SELECT person_id FROM modelling WHERE CAST(index_datetime AS DATE) < DATE '{CUTOFF}') THEN 'test_seen'
        ELSE 'test_new' END AS "set" FROM modelling""",
)
MODEL_NEEDS = ("eligible", "target_admins", "drug_admins", "stays", "visits", "diagnoses", "icd10")
CONTINUOUS = ["age_at_admission", "hour_of_admission_cyclical", "n_previous_admissions", "n_distinct_drugs_before_index",
              "elixhauser_score_ahrq"]


def rounded(df, cols=("time_at_risk", "age_at_admission"), places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("assemble_features", with_views("""SELECT * REPLACE (round(time_at_risk, 6) AS time_at_risk,
    round(age_at_admission, 6) AS age_at_admission) FROM modelling""", *MODEL_NEEDS, **MODEL_VIEWS))
def assemble_features(spark, sf):
    return rounded(modelling_table(spark, sf))


def split_table(spark, sf):
    return durable(rs.temporal_split(modelling_table(spark, sf), "index_datetime", CUTOFF, "person_id"), "split")


@query("split_by_time_and_person", with_views("""SELECT admission_id, person_id, index_datetime, "set" FROM split""",
    *MODEL_NEEDS, **MODEL_VIEWS))
def split_by_time_and_person(spark, sf):
    return split_table(spark, sf).select("admission_id", "person_id", "index_datetime", "set")


FACTORS = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature_name, CASE WHEN NOT bool_and("{c}" IN (0, 1)) THEN avg("{c}") END AS centre,
    CASE WHEN NOT bool_and("{c}" IN (0, 1)) THEN stddev_samp("{c}") END AS scale FROM split WHERE "set" = 'dev'"""
    for c in [*CONTINUOUS, "sex_female", "n18_diag_N181"])


@query("fit_norm", with_views("SELECT feature_name, round(centre, 6) AS centre, round(scale, 6) AS scale FROM factors",
    *MODEL_NEEDS, **MODEL_VIEWS, factors=FACTORS))
def fit_norm(spark, sf):
    dev = rs.data_sets(split_table(spark, sf))["dev"]
    factors = rs.fit_norm(dev, [*CONTINUOUS, "sex_female", "n18_diag_N181"])
    return factors.select("feature_name", F.round("centre", 6).alias("centre"), F.round("scale", 6).alias("scale"))


@query("binary_detect", """SELECT 'p_size' AS feature_name, bool_and(p_size IN (0, 1)) AS is_binary FROM part
    UNION ALL SELECT 'even', bool_and(p_size % 2 IN (0, 1)) FROM part""")
def binary_detect(spark, sf):
    part = P.table(spark, sf, "part").select("p_size", (F.col("p_size") % 2).alias("even"))
    factors = rs.fit_norm(part, ["p_size", "even"])
    return factors.select("feature_name", F.col("centre").isNull().alias("is_binary"))


SCALED = ", ".join(
    f"""round(("{c}" - (SELECT centre FROM factors WHERE feature_name = '{c}'))
    / (SELECT scale FROM factors WHERE feature_name = '{c}'), 6) AS "{c}" """ for c in CONTINUOUS)


@query("apply_norm", with_views(f"""SELECT admission_id, {SCALED}, sex_female FROM split WHERE "set" <> 'dev'""",
    *MODEL_NEEDS, **MODEL_VIEWS, factors=FACTORS))
def apply_norm(spark, sf):
    sets = rs.data_sets(split_table(spark, sf).drop("index_datetime"))
    scaled = rs.normalise(sets["test"], rs.fit_norm(sets["dev"]))
    return rounded(scaled.select("admission_id", *CONTINUOUS, "sex_female"), CONTINUOUS)


@query("denorm", with_views(f"""SELECT admission_id, {", ".join(f'round("{c}", 4) AS "{c}"' for c in CONTINUOUS)}, sex_female
    FROM split WHERE "set" <> 'dev'""", *MODEL_NEEDS, **MODEL_VIEWS))
def denorm(spark, sf):
    sets = rs.data_sets(split_table(spark, sf).drop("index_datetime"))
    factors = rs.fit_norm(sets["dev"])
    back = rs.denormalise(rs.normalise(sets["test"], factors), factors)
    return rounded(back.select("admission_id", *CONTINUOUS, "sex_female"), CONTINUOUS, places=4)


def model_sets(spark, sf):
    """dev, test and test_new with normalised features, and the factors."""
    sets = rs.data_sets(split_table(spark, sf).drop("index_datetime"))
    factors = durable(rs.fit_norm(sets["dev"]), "factors")
    return {name: rs.normalise(df, factors) for name, df in sets.items()}, factors


@query("datasets", with_views(f"""SELECT s.dataset, admission_id, person_id, r, round(time_at_risk, 6) AS time_at_risk,
    {SCALED}, {", ".join(f'"{c}"' for c in ["sex_female", "sex_male", *[f"admitted_{w}" for w in WEEK],
        *[f"n18_diag_{v}" for v in CKD], *[f"atc_level2_{v}" for v in ATC2], *[f"icd10_chapter_{v}" for v in CHAPTERS],
        "daily_rate_not_zero", *[f"daily_rate_geq_{k}" for k in (1, 2, 3, 5)]])}
    FROM split JOIN (VALUES ('dev', 'dev'), ('test', 'test_seen'), ('test', 'test_new'), ('test_new', 'test_new'))
    s(dataset, "set") USING ("set")""", *MODEL_NEEDS, **MODEL_VIEWS, factors=FACTORS))
def datasets(spark, sf):
    sets, _ = model_sets(spark, sf)
    return rounded(rs.union_with_label(sets, "dataset"), [*CONTINUOUS, "time_at_risk"])
