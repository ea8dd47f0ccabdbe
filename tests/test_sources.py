import pytest
from pyspark.sql import functions as F

from episodica import session
from episodica.sources import tables as t


def test_headerless(spark, tmp_path):
    (tmp_path / "h").write_text("CPR\tIGNORED\tADM_DOSIS\tPRIM_ATC")
    (tmp_path / "d").write_text('1\tx\t2.5\t"A10\n2\ty\tNULL\tB"01\n3\tz\tbad\tC03\n')
    df = t.read_with_header(spark, str(tmp_path / "d"), str(tmp_path / "h"), types={"person_id": "long", "given_dose": "double"}, null="NULL")
    assert df.columns == ["person_id", "given_dose", "atc"]
    assert [tuple(r) for r in df.orderBy("person_id").collect()] == [(1, 2.5, '"A10'), (2, None, 'B"01'), (3, None, "C03")]


def test_sql_from_file_with_bound_values(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("nations_for_test")
    path = tmp_path / "q.sql"
    path.write_text("SELECT count(*) AS n FROM @tab\nWHERE n_name = @name")
    assert t.run_sql(spark, str(path), names={"tab": "nations_for_test"}, name="x' OR '1'='1").first().n == 0


def test_replace_slice_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    t.replace_slice(spark.createDataFrame([("a", 1), ("b", 2)], "s string, v int"), path, "s")
    for _ in range(3):
        t.replace_slice(spark.createDataFrame([("a", 10)], "s string, v int"), path, "s")
    assert sorted((r.s, r.v) for r in spark.read.parquet(path).collect()) == [("a", 10), ("b", 2)]


def test_save_and_drop(spark, tmp_path):
    t.save(spark.range(3), "save_test", "overwrite", str(tmp_path / "x"))
    t.save(spark.range(2), "save_test", "append")
    assert t.load(spark, "save_test").count() == 5
    t.drop_tables(spark, "save_test", "never_there")
    assert not spark.catalog.tableExists("save_test")


def test_shared_dir_is_read_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = session.shared_dir(spark)
    if named is not None:
        assert folder == named.rstrip("/")
    kept = session.durable(spark.range(5), "five")
    assert kept.count() == 5
    assert kept.inputFiles()[0].removeprefix("file://").startswith(f"{folder}/five-")


def test_durable_survives_a_changed_source(spark):
    rows = spark.range(10).withColumn("r", F.rand())
    kept = session.durable(rows)
    assert kept.collect() == kept.collect()
    assert kept.schema == rows.schema or [f.name for f in kept.schema] == ["id", "r"]


@pytest.mark.parametrize("layouts", [["complete"], ["complete", "prescription", "strength"]])
def test_three_layouts(spark, sf, layouts):
    from episodica.plans import proxies as P
    from episodica.plans.source_queries import raw_drug_files
    from episodica.sources.drugs import FINAL, drug_administrations

    files = {label: spec for label, spec in raw_drug_files(spark, sf).items() if spec[0] in layouts}
    out = drug_administrations(spark, files, P.person(spark, sf))
    assert out.columns == FINAL
    assert out.select("source").distinct().count() == len(layouts)
    assert out.filter("given_dose <= 0 or given_dose is null or admin_datetime is null").count() == 0
