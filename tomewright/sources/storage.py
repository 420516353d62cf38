"""Where shared scratch data goes, and sinks: export trees, backups, restores."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or FALLBACK).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def export_workspace(files: DataFrame, notes: DataFrame) -> DataFrame:
    """(workspace, path, content) of an export: notes as Markdown, files as text, by folder."""
    safe = F.regexp_replace(F.coalesce("title", F.lit("untitled")), r'[\\/:*?"<>|\s]+', "-")

    def of(df: DataFrame, root: str, ext: str, content) -> DataFrame:
        path = F.concat(F.lit(f"{root}/"), F.coalesce("folder", F.lit("root")), F.lit("/"), "id", F.lit("-"), safe, F.lit(ext))
        return df.where(~F.col("deleted")).select("workspace", path.alias("path"), content.alias("content"))

    body = F.concat(F.lit("# "), "title", F.lit("\n\n"), "text", F.lit("\n"))
    return of(notes, "notes", ".md", body).unionByName(of(files, "files", ".txt", F.col("text")))


def backup(tables: dict[str, DataFrame], path: str) -> dict:
    """Every table as Parquet below ``path``, and a manifest of row counts and schemas."""
    manifest = {}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        stored = spark.read.parquet(f"{path}/{name}")
        manifest[name] = {"rows": stored.count(), "schema": stored.schema.simpleString()}
    line = [(json.dumps({"version": 1, "tables": manifest}, sort_keys=True),)]
    spark.createDataFrame(line, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def inspect_backup(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The backed-up tables; a table whose rows are not as many as the manifest says is refused."""
    out = {}
    for name, told in inspect_backup(spark, path)["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if df.count() != told["rows"]:
            raise ValueError(f"{name}: the backup is incomplete")
        out[name] = df
    return out
