"""Session settings the library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI casts.

    ``master`` and ``partitions`` are for local runs; on a cluster both come from
    the submit command, and adaptive execution sizes the shuffles.
    """
    builder = (
        SparkSession.builder.appName("cohortlab")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the cluster's setting, else one beside the warehouse.

    The setting is read, never written: Spark refuses to change it in a running session.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder, which goes when the application ends."""
    own = f"{checkpoint_dir(spark)}/cohortlab-{spark.sparkContext.applicationId}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)  # only what is there can be marked
    files.deleteOnExit(hadoop)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly to as many tasks as a shuffle has, before steps that cost far more than their bytes tell.

    A narrow table is a few megabytes of Parquet and thus one or two tasks, however long its rows are worked on. The number is
    explicit, because adaptive execution would put so few bytes together again; all columns decide, so neither null keys nor a sort
    of the whole table (which dealing in turn begins with) get in the way.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that several steps read, and read it back.

    It is computed once, survives the loss of executors, and later steps plan against
    a plain Parquet scan that reads only their columns.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
