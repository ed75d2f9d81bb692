"""Runs read from the `events` table."""
from pyspark.sql import functions as F


def runs(spark, sf_dir):
    """(job_id, start, end, ord) with whole-second starts, as logs have them."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    start = F.date_trunc("second", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")
    end = F.timestamp_add("MINUTE", F.floor("value").cast("int"), start).cast("timestamp_ntz")
    return ev.select(F.col("user_id").alias("job_id"), start.alias("start"), end.alias("end"), F.col("event_id").alias("ord"))
