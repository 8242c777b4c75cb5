"""Audits of acknowledged writes, crash runs and migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit(acked: DataFrame, held: DataFrame, deleted: DataFrame) -> DataFrame:
    """(problem, key): acknowledged keys missing or wrong, and deleted keys that are back."""
    missing = acked.join(held, "key", "left_anti").select(F.lit("missing").alias("problem"), "key")
    wrong = acked.join(held.withColumnRenamed("value", "_held"), "key").where("NOT value <=> _held").select(F.lit("wrong").alias("problem"), "key")
    back = deleted.join(held, "key", "left_semi").select(F.lit("resurrected").alias("problem"), "key")
    return missing.unionByName(wrong).unionByName(back)


def crash(rows: DataFrame) -> DataFrame:
    """(round, lost, holes, corrupt) of (round, writer, i, acked, present, value_ok): a hole is a
    missing write before a later one that is there."""
    per = rows.groupBy("round", "writer").agg(F.count_if(F.col("acked") & ~F.col("present")).alias("lost"), F.min(F.when(F.col("acked") & ~F.col("present"), F.col("i"))).alias("gap"), F.max(F.when(F.col("present"), F.col("i"))).alias("last"), F.count_if(F.col("present") & ~F.col("value_ok")).alias("corrupt"))
    return per.groupBy("round").agg(F.sum("lost").alias("lost"), F.count_if(F.col("gap") < F.col("last")).alias("holes"), F.sum("corrupt").alias("corrupt"))


def migration(plan: DataFrame) -> DataFrame:
    """One report row: scanned, moved, superseded (destination has it), vanished (source has not)."""
    gone = ~F.col("have")
    return plan.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("have") & ~F.col("dest_has")).alias("moved"), F.count_if(F.col("have") & F.col("dest_has")).alias("superseded"), F.count_if(gone).alias("vanished"))


def bucket_bound(granted: DataFrame, capacity: int, rate: float) -> DataFrame:
    """Buckets that granted more than capacity + rate * elapsed + 1."""
    return granted.where(F.col("granted") > F.lit(capacity) + F.lit(rate) * F.col("elapsed_s") + 1)
