"""Queries for sources and sinks. Files and tables are written below the shared folder from the given tables."""

import uuid

from pyspark.sql import functions as F

from episodica.operators.filters import starts_with_any
from episodica.plans import proxies as P
from episodica.plans.proxies import TARGET_ATC, with_views
from episodica.plans.registry import query
from episodica.session import scratch_path
from episodica.sources import tables as t
from episodica.sources.drugs import drug_administrations

STAY_SCHEMA = (
    "admission_id long, person_id long, admission_datetime timestamp_ntz, discharge_datetime timestamp_ntz"
)


def _name(base):
    return f"{base}_{uuid.uuid4().hex[:12]}"


def _write_plain(df, path, null=""):
    """Headerless tab-separated text without quoting."""
    df.write.options(sep="\t", header=False, quote="", nullValue=null, emptyValue="").csv(path)


def _write_header(spark, names, path):
    spark.range(1).select(F.lit("\t".join(names)).alias("value")).write.text(path)


@query("scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_table(spark, sf):
    name = _name("orders_view")
    P.table(spark, sf, "orders").createOrReplaceTempView(name)
    return t.load(spark, name).select("o_orderkey", "o_custkey", "o_totalprice")


@query("scan_tsv", with_views("SELECT * FROM stays", "stays"))
def scan_tsv(spark, sf):
    path = scratch_path(spark, "stays_tsv")
    t.write_tsv(P.stays(spark, sf), path)
    return t.read_tsv(spark, path, STAY_SCHEMA)


@query("scan_projected", with_views("SELECT admission_id, discharge_datetime FROM stays", "stays"))
def scan_projected(spark, sf):
    path = scratch_path(spark, "stays_tsv")
    t.write_tsv(P.stays(spark, sf), path)
    return t.read_tsv(spark, path, STAY_SCHEMA, cols=["admission_id", "discharge_datetime"])


@query("scan_headerless", with_views("SELECT person_id, atc, given_dose FROM drug_admins", "drug_admins"))
def scan_headerless(spark, sf):
    data, header = scratch_path(spark, "admins"), scratch_path(spark, "admins_header")
    admins = P.drug_admins(spark, sf)
    _write_plain(admins.select("person_id", "admin_id", "atc", "given_dose"), data)
    _write_header(spark, ["CPR", "NOT_USED", "ATC_Code", "ADM_DOSIS"], header)
    return t.read_with_header(spark, data, header, types={"person_id": "long", "given_dose": "double"})


@query("scan_null_token", with_views("""SELECT admin_id AS administration_id, CASE WHEN admin_id % 4 <> 0 THEN given_dose END AS given_dose,
    CASE WHEN admin_id % 3 = 0 THEN '"' || atc ELSE atc END AS atc FROM drug_admins""", "drug_admins"))
def scan_null_token(spark, sf):
    data, header = scratch_path(spark, "admins"), scratch_path(spark, "admins_header")
    i = F.col("admin_id")
    admins = P.drug_admins(spark, sf).select(
        "admin_id",
        F.when(i % 4 != 0, F.col("given_dose")).alias("given_dose"),
        F.when(i % 3 == 0, F.concat(F.lit('"'), "atc")).otherwise(F.col("atc")).alias("atc"),
    )
    _write_plain(admins, data, null="NULL")
    _write_header(spark, ["adm_id", "adm_dosis", "prim_atc"], header)
    return t.read_with_header(
        spark, data, header, types={"administration_id": "long", "given_dose": "double"}, null="NULL")


@query("sql_template", """SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type HAVING count(*) > 10""")
def sql_template(spark, sf):
    name = _name("events_view")
    P.table(spark, sf, "events").createOrReplaceTempView(name)
    text = """SELECT event_type, count(*) AS n FROM @source -- mail to a@few
        WHERE value > @low AND event_type <> 'x@low' GROUP BY event_type HAVING count(*) > @few"""
    return t.run_sql(spark, text, names={"source": name}, low=50, few=10)


@query("sink_tsv", with_views("SELECT admin_id, atc, given_dose, admin_datetime FROM drug_admins", "drug_admins"))
def sink_tsv(spark, sf):
    path = scratch_path(spark, "admins_tsv")
    t.write_tsv(P.drug_admins(spark, sf).select("admin_id", "atc", "given_dose", "admin_datetime"), path)
    return t.read_tsv(spark, path, "admin_id long, atc string, given_dose double, admin_datetime timestamp_ntz")


@query("sink_table_overwrite", with_views("SELECT * FROM stays_long", "stays_long"))
def sink_table_overwrite(spark, sf):
    name, path = _name("stays"), scratch_path(spark, "stays_table")
    t.save(P.stays(spark, sf), name, "overwrite", path)
    t.save(P.stays_long(spark, sf), name, "overwrite", path)
    return t.load(spark, name)


@query("sink_table_append", with_views("SELECT * FROM stays UNION ALL SELECT * FROM stays_long", "stays", "stays_long"))
def sink_table_append(spark, sf):
    name, path = _name("stays"), scratch_path(spark, "stays_table")
    t.save(P.stays(spark, sf), name, "overwrite", path)
    t.save(P.stays_long(spark, sf), name, "append", path)
    return t.load(spark, name)


@query("replace_slice", with_views("""SELECT id, study_name, CASE WHEN study_name = 'study_1' THEN round(y_pred / 2, 6)
    ELSE y_pred END AS y_pred FROM predictions""", "predictions"))
def replace_slice(spark, sf):
    path = scratch_path(spark, "predictions_table")
    preds = P.predictions(spark, sf).select("id", "study_name", "y_pred")
    gone = preds.withColumn("study_name", F.lit("007"))
    again = preds.filter(F.col("study_name") == "study_1").withColumn("y_pred", F.round(F.col("y_pred") / 2, 6))
    t.replace_slice(preds, path, "study_name")
    t.replace_slice(gone, path, "study_name", ["007"])
    t.replace_slice(again, path, "study_name", ["study_1"])
    t.replace_slice(again, path, "study_name", ["study_1"])
    t.replace_slice(gone.filter("id is null"), path, "study_name", ["007"])
    return spark.read.schema(preds.schema).parquet(path)


@query("select_into", with_views("""SELECT admission_id, admission_id * 2 AS visit_id FROM stays""", "stays"))
def select_into(spark, sf):
    name = _name("visit_lookup")
    pairs = P.stays(spark, sf).select("admission_id", (F.col("admission_id") * 2).alias("visit_id"))
    t.select_into(spark, P.stays(spark, sf).select("person_id"), name, scratch_path(spark, "lookup"))
    return t.select_into(spark, pairs, name, scratch_path(spark, "lookup"))


@query("sink_csv_history", """SELECT o_custkey % 14 AS study, count(*) AS n_trials, round(min(o_totalprice), 2) AS best
    FROM orders GROUP BY o_custkey % 14""")
def sink_csv_history(spark, sf):
    path = scratch_path(spark, "history_tsv")
    history = P.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 14).alias("study")).agg(
        F.count(F.lit(1)).alias("n_trials"), F.round(F.min("o_totalprice"), 2).alias("best"))
    t.write_tsv(history, path)
    return t.read_tsv(spark, path, "study long, n_trials long, best double")


def raw_drug_files(spark, sf):
    """The drug administrations dealt out to the three raw layouts as files."""
    rows = P.k_of(P.table(spark, sf, "events")).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("i"),
        F.col("user_id"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"),
        F.round(F.col("value") / 10, 3).alias("d"),
        P.pick(P.ATC, F.col("k") % 10).alias("atc"),
        F.when(F.col("k") % 9 == 0, 5).otherwise(7).alias("status"),
        F.concat(F.when(F.col("k") % 11 == 0, "T").otherwise("P"), F.col("user_id").cast("string")).alias("pid"),
    )
    where = {n: scratch_path(spark, n) for n in ("a", "ah", "b", "bh", "bp", "bph", "bm", "c", "ch")}
    a = rows.filter("i % 3 = 0").select(
        "pid", "i", "status", F.lit("product").alias("p"), F.lit("tablet").alias("f"), "atc",
        F.date_format("ts", "dd-MM-yyyy HH:mm:ss").alias("at"), "d", F.lit("MG").alias("u"))
    _write_plain(a, where["a"])
    _write_header(spark, ["CPR", "adm_ref", "ADM_STATUS", "NAVN", "VAREFORM", "PRIM_ATC", "ADM_START", "ADM_DOSIS",
                          "ADM_DOSIS_ENHED"], where["ah"])
    b = rows.filter("i % 3 = 1")
    _write_plain(b.select(
        "pid", "i", "status", F.lit("product").alias("p"), F.lit("tablet").alias("f"),
        F.date_format("ts", "dd-MM-yyyy").alias("day"), F.date_format("ts", "HH:mm:ss").alias("time"), "d",
        F.lit("mg").alias("u")), where["b"])
    _write_header(spark, ["PID", "ADM_ID", "ADM_STATUS", "DRUG_NAME", "FORM_TEXT", "ADM_DATE", "ADM_TIME", "ADM_DOSIS",
                          "ADM_DOSIS_ENHED"], where["bh"])
    _write_plain(b.select("atc", F.lit("x").alias("x"), (F.col("i") + 1).alias("ord")), where["bp"])
    _write_header(spark, ["PRIM_ATC", "OTHER", "ORD_ID"], where["bph"])
    b.select(F.col("i").alias("adm_id"), (F.col("i") + 1).alias("ord_id")).write.options(sep="\t", header=True).csv(where["bm"])
    c = rows.filter("i % 3 = 2").select(
        "pid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.lit("product").alias("p"), F.lit("fluid").alias("f"),
        F.concat(F.substring("atc", 1, 3), F.lit(":"), F.substring("atc", 4, 10)).alias("atc"),
        F.when(F.col("i") % 5 != 0, F.col("d")).alias("s"), F.lit("mg/ml").alias("u"), F.lit(2).alias("n"))
    _write_plain(c, where["c"], null="NULL")
    _write_header(spark, ["PID", "DATE_GIVEN", "DRUG_NAME", "FORM_TEXT", "ATC_CODE", "STRENGTH", "UNIT",
                          "NUMBER_OF_UNITS_GIVEN"], where["ch"])
    return {
        "ward": ("complete", {"admins": where["a"], "admins_header": where["ah"]}),
        "old_ward": ("prescription", {
            "admins": where["b"], "admins_header": where["bh"], "prescriptions": where["bp"],
            "prescriptions_header": where["bph"], "mapping": where["bm"]}),
        "intensive": ("strength", {"admins": where["c"], "admins_header": where["ch"]}),
    }


RAW = f"""SELECT event_id AS i, user_id AS person_id, date_trunc('second', ts) AS admin_datetime, round(value / 10, 3) AS d,
    {P._case(f'({P.K}) % 10', P.ATC)} AS atc, ({P.K}) % 9 <> 0 AS done FROM events
    WHERE event_type = 'purchase' AND ({P.K}) % 11 <> 0"""
ALL_ADMINS = """SELECT person_id, admin_datetime, round(d, 6) AS given_dose, 'mg' AS given_dose_unit, 'product' AS product_name,
    'tablet' AS formulation, atc, CASE WHEN i % 3 = 0 THEN 'ward' ELSE 'old_ward' END AS source
    FROM raw WHERE i % 3 < 2 AND done AND d > 0
    UNION ALL SELECT person_id, admin_datetime, round(d * 2, 6), 'mg', 'product', 'fluid', atc, 'intensive'
    FROM raw WHERE i % 3 = 2 AND i % 5 <> 0 AND d > 0"""


@query("drug_admins", with_views("SELECT * FROM alladmins WHERE person_id IN (SELECT person_id FROM eligible)",
    "eligible", raw=RAW, alladmins=ALL_ADMINS))
def drug_admins(spark, sf):
    from episodica.operators.cohort import eligible

    chosen = eligible(P.stays(spark, sf), P.person(spark, sf), P.SINCE, P.UNTIL)
    out = drug_administrations(spark, raw_drug_files(spark, sf), chosen)
    return out.withColumn("given_dose", F.round("given_dose", 6))


@query("target_drug_admins", with_views("""SELECT person_id, admin_datetime, given_dose, atc FROM alladmins
    JOIN (SELECT person_id FROM eligible) e USING (person_id)
    WHERE regexp_matches(atc, '^(""" + "|".join(TARGET_ATC) + """)')""", "eligible", raw=RAW, alladmins=ALL_ADMINS))
def target_drug_admins(spark, sf):
    from episodica.operators.cohort import eligible

    chosen = eligible(P.stays(spark, sf), P.person(spark, sf), P.SINCE, P.UNTIL)
    out = drug_administrations(spark, raw_drug_files(spark, sf), chosen, multiplicity="reference")
    return starts_with_any(out, "atc", TARGET_ATC).select(
        "person_id", "admin_datetime", F.round("given_dose", 6).alias("given_dose"), "atc")
