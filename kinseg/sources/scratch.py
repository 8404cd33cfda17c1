"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new place below spark.checkpoint.dir, which all executors share; on one machine without that setting, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="kinseg-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/texts-{uuid.uuid4().hex}/{name}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read back: its plan ends there, and it runs once however often it is used."""
    spark = df.sparkSession
    path, schema = folder(spark, name), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
