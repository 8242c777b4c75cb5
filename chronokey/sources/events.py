"""Logs derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    epoch = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return raw.withColumn("ts_ms", F.floor(epoch / 1000).cast("long"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts_ms, key): one access an event."""
    key = F.concat(F.lit("user:{"), F.col("user_id").cast("string"), F.lit("}:"), F.col("event_type"))
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), "ts_ms", key.alias("key"))


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts_ms, op, key, value, arg_ms): a command an event."""
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.col("event_type")
    op = F.when(t.isin("signup", "purchase"), "SET").when(t == "click", "PEXPIRE").when((t == "view") & (k % 2 == 0), "PERSIST").when((t == "error") & (k % 3 == 0), "DEL").otherwise("GET")
    arg = F.when(t == "purchase", (k + 1) * 3_600_000).when(t == "click", F.when(k % 10 == 0, 0).otherwise((k + 1) * 3_600_000))
    value = F.when(op == "SET", F.concat(F.lit("v"), F.col("event_id").cast("string")))
    key = F.concat(F.lit("user:{"), F.col("user_id").cast("string"), F.lit("}"))
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), "ts_ms", op.alias("op"), key.alias("key"), value.alias("value"), arg.cast("long").alias("arg_ms"))
