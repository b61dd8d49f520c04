"""Stages that several later ones read: written once, read again, deleted when the driver ends. Cuts the plan (nested stages would repeat one another's) and survives lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset: one in the warehouse, or, in a single JVM, in the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        alone = master == "local" or master.startswith("local[")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return base.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder(spark)}/book-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
