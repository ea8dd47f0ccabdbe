"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def build_session(app: str = "episodica", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own through spark-submit."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    return configure(session)


def configure(spark: SparkSession) -> SparkSession:
    """Settings every query relies on, also in sessions that others have built.

    Timestamps are zone-free: arithmetic on them is only right where every day has 24 hours. Joins of rows with a
    per-key table must be split at run time when one key owns much of the rows, even if that costs another shuffle.
    Shuffled rows of numbers take some twenty times their compressed size in sorts and hash tables, so shuffle partitions
    are gathered to 16 MB instead of Spark's 64 MB, unless the session has a size of its own.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(ADVISORY, None) is None:
        spark.conf.set(ADVISORY, "16m")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local master without that setting (tests) falls back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="episodica-"))
    return context.getCheckpointDir().removeprefix("file:")


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; `run_scope` removes what was written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def child_paths(spark: SparkSession, path: str) -> list[str]:
    """Paths of the entries of a folder in whatever file system it is; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(entry.getPath()) for entry in system.listStatus(folder)] if system.exists(folder) else []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with what is in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Remove at its end what was written to the shared folder inside the block, and the tables made there.

    A lazy result must be used inside: it reads those files.
    """
    first = len(_made)
    tables = {t.name for t in spark.catalog.listTables()}
    try:
        yield
    finally:
        for table in spark.catalog.listTables():
            if table.name not in tables:
                if table.isTemporary:
                    spark.catalog.dropTempView(table.name)
                else:
                    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": table.name})
        while len(_made) > first:
            remove_path(spark, _made.pop())


def durable(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the true size of the result, so that a
    later join broadcasts it only if it is below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
