"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Lets a query's shuffle files go when the query ends, instead of when the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A new path in the cluster's checkpoint folder. Only where driver and tasks run on one machine may it be unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")
    return f"{root}/lodestone-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once and read again: several readers share the work, the plan starts afresh, lost executors lose nothing.
    What the writing shuffled is deleted behind it."""
    spark = df.sparkSession
    path = folder(spark)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)
