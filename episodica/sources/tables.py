"""Reading and writing tables and tab-separated files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.session import child_paths, remove_path

# Raw column name -> canonical name.
HEADER_LOOKUP = {
    "cpr": "person_id",
    "pid": "person_id",
    "ord_id": "prescription_id",
    "adm_id": "administration_id",
    "navn": "product_name",
    "drug_name": "product_name",
    "prim_atc": "atc",
    "atc_code": "atc",
    "adm_start": "admin_datetime",
    "adm_date": "admin_date",
    "adm_time": "admin_time",
    "date_given": "admin_datetime",
    "adm_dosis": "given_dose",
    "adm_dosis_enhed": "given_dose_unit",
    "strength": "adm_strength",
    "unit": "adm_strength_unit",
    "number_of_units_given": "adm_volume",
    "dose_unit_code": "adm_volume_unit",
    "vareform": "formulation",
    "form_text": "formulation",
    "adm_status": "admin_status",
}
TSV_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "dateFormat": "yyyy-MM-dd",
}
# Quoted text, quoted names and comments come first, so that an @ inside them is left alone.
IDENTIFIER = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|@(\w+)""", re.DOTALL)


def load(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or view."""
    return spark.table(name)


def load_jdbc(
    spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None,
    partitions: int = 64, **options: str,
) -> DataFrame:
    """A database table. With a numeric key and its bounds, executors read ranges of it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize="10000", **options)
    if key is not None and bounds is not None:
        reader = reader.options(
            partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)
        )
    return reader.load()


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType, cols: Sequence[str] | None = None, **options) -> DataFrame:
    """Tab-separated file with a header. The schema is given, not inferred, so the file is read once; with `cols` only
    these are parsed."""
    df = spark.read.options(sep="\t", header=True, **TSV_FORMATS, **options).schema(schema).csv(path)
    return df if cols is None else df.select(*cols)


def read_with_header(
    spark: SparkSession,
    data: str,
    header: str,
    lookup: Mapping[str, str] = HEADER_LOOKUP,
    types: Mapping[str, str] | None = None,
    quote: str = "",
    null: str = "",
) -> DataFrame:
    """Headerless tab-separated data whose column names are in a file of their own.

    Names are compared in lower case; known columns are renamed, all others dropped. quote='' switches quoting off.
    """
    names = spark.read.text(header).first()[0].lower().split("\t")
    types = types or {}
    fields = [T.StructField(f"c{i}_{n}", T.StringType()) for i, n in enumerate(names)]
    raw = spark.read.options(sep="\t", header=False, quote=quote, nullValue=null).schema(T.StructType(fields)).csv(data)
    known = [(f.name, lookup[n]) for f, n in zip(fields, names) if n in lookup]
    return raw.select(*[F.col(c).try_cast(types.get(name, "string")).alias(name) for c, name in known])


def run_sql(spark: SparkSession, text: str, names: Mapping[str, str] | None = None, **values) -> DataFrame:
    """SQL text, or the path of a file holding it, with @name parameters; an @ in quotes or comments stays as it is.

    Values become bound parameters and table or column names become IDENTIFIER() clauses: nothing is pasted into the
    text, so a value cannot change the statement.
    """
    if len(text) < 1000 and "\n" not in text and text.endswith(".sql"):
        text = Path(text).read_text(encoding="utf-8")
    names = names or {}

    def marker(match: re.Match) -> str:
        key = match.group(1)
        if key is None:
            return match.group(0)
        return f"IDENTIFIER(:{key})" if key in names else f":{key}"

    return spark.sql(IDENTIFIER.sub(marker, text), args={**names, **values})


def write_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Tab-separated files with header, one per task, below `path`."""
    df.write.mode(mode).options(sep="\t", header=True, **TSV_FORMATS).csv(path)


def save(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Create, replace ('overwrite') or extend ('append') a catalog table."""
    writer = df.write.mode(mode).format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def replace_slice(df: DataFrame, path: str, col: str, values: Sequence | None = None) -> None:
    """Replace the rows of some values of `col` and leave the others alone.

    The table is partitioned by `col`. values names the slices to replace (default: those that df contains); a named
    slice of which df has no rows is emptied. Running the same write twice gives the same table. Read it with the schema
    of df: partition names carry no types.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(col).parquet(path)
    if values is None:
        return
    kept = {str(row[0]) for row in df.select(col).distinct().filter(F.col(col).isin(*values)).collect()}
    empty = {str(v) for v in values} - kept
    for folder in child_paths(df.sparkSession, path):
        name, _, value = unquote(folder.rpartition("/")[2]).partition("=")
        if name == col and value in empty:
            remove_path(df.sparkSession, folder)


def select_into(spark: SparkSession, df: DataFrame, name: str, path: str) -> DataFrame:
    """Drop a table and create it anew from a query."""
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})
    save(df, name, "error", path)
    return spark.table(name)


def drop_tables(spark: SparkSession, *names: str) -> None:
    """Remove result tables if they exist."""
    for name in names:
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})
