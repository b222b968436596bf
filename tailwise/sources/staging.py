"""Tables written between the steps of an operator: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_made: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This driver's own folder under spark.checkpoint.dir, deleted when it ends. Where that is unset, one in local mode
    only: executors of a cluster must share it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tailwise.steps", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tailwise-steps-")
        spark.conf.set("spark.tailwise.steps", base)
    path = f"{base.rstrip('/')}/tailwise-steps/{_RUN}"
    if path not in _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _made.add(path)
    return path


def step(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
