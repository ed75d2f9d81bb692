"""Tables written on the way, so that what several plans read is worked out once and survives lost executors."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which ends its lineage."""
    path = f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
