"""Shared plumbing: scratch tables in the cluster's shared folder, column names, bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on one machine (tests).
FALLBACK_CHECKPOINT_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = FALLBACK_CHECKPOINT_DIR
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch Parquet table and read back.

    Cuts the lineage with a replicated copy in shared storage, so neither a lost
    executor nor a second consumer makes Spark run the plan behind it again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """The column of that exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> list[Column]:
    """All columns of ``df`` but ``names``: output columns replace inputs of the same name."""
    gone = {n.lower() for n in names}
    return [col(c) for c in df.columns if c.lower() not in gone]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
