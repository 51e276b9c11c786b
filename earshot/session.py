"""Session helpers: shared folder for written tables, a local session for tests and bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset, as in a
    local test, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="earshot-")
    return f"{base.rstrip('/')}/earshot/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "part", **options: str) -> DataFrame:
    """A small derived table, written to the shared folder and read back.

    For tables that rows are about to be joined with: bounds, offsets, priors, examples.
    Derived sides have no size Spark could plan with, so it would shuffle the big side
    before learning that the small one fits a broadcast. The written table has its exact
    size: Catalyst broadcasts it when it is below ``spark.sql.autoBroadcastJoinThreshold``
    and joins by key otherwise. It also cuts the lineage, and is not computed again when
    an executor is lost. This runs the job that makes the table. ``options`` go to the
    Parquet writer.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(app: str = "earshot", cores: str | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
