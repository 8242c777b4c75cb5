"""Key-value state as a fold over an ordered command log, all in window functions.

A SET starts a segment of its key. In a segment a key dies for good by DEL, by an expiry of at most
0 ms, or when a command finds its deadline reached; so whether a key lives at a command follows
from running maxima over the commands before it, and one exchange by key serves every query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotate(log: DataFrame) -> DataFrame:
    """``log`` (seq, ts_ms, op, key, value, arg_ms) with ``live`` (before the command), ``effective``
    (it changed something) and the segment's ``set_value``, ``deadline`` and ``dead`` after it."""
    w = Window.partitionBy("key").orderBy("seq")
    seg = log.withColumn("seg", F.sum((F.col("op") == "SET").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy("key", "seg").orderBy("seq")
    upto, before = s.rowsBetween(Window.unboundedPreceding, 0), s.rowsBetween(Window.unboundedPreceding, -1)
    op, arg, ts = F.col("op"), F.col("arg_ms"), F.col("ts_ms")
    put = F.when((op == "SET") | ((op == "PEXPIRE") & (arg > 0)) | (op == "PERSIST"), F.struct(F.when(op != "PERSIST", ts + arg).alias("d")))
    kill = (op == "DEL") | ((op == "PEXPIRE") & (arg <= 0))
    seg = seg.withColumn("prior", F.last(put, ignorenulls=True).over(before)).withColumn("killed", F.coalesce(F.max(kill).over(before), F.lit(False)))
    seg = seg.withColumn("lapsed", F.max(F.coalesce(F.col("prior.d") <= ts, F.lit(False))).over(upto))
    seg = seg.withColumn("live", (F.col("seg") > 0) & (op != "SET") & ~F.col("killed") & ~F.col("lapsed"))
    seg = seg.withColumn("effective", (op == "SET") | (F.col("live") & (op.isin("DEL", "PEXPIRE") | ((op == "PERSIST") & F.col("prior.d").isNotNull()))))
    now = F.coalesce(F.when((op == "SET") | F.col("live"), put), F.col("prior"))
    return seg.select("seq", "ts_ms", "op", "key", "value", "arg_ms", "seg", "live", "effective", F.first("value").over(upto).alias("set_value"), now.getField("d").alias("deadline"), ((op != "SET") & ~F.col("live") | (kill & F.col("live"))).alias("dead"))


def physical(log: DataFrame) -> DataFrame:
    """(key, value, deadline_ms, last_seq) of the keys held after the log, expired ones not yet
    touched included."""
    last = annotate(log).groupBy("key").agg(F.max_by(F.struct("set_value", "deadline", "dead", "seq", "seg"), "seq").alias("s")).select("key", "s.*")
    return last.where("seg > 0 AND NOT dead").select("key", F.col("set_value").alias("value"), F.col("deadline").alias("deadline_ms"), F.col("seq").alias("last_seq"))


def is_live(now_ms: int) -> Column:
    return F.col("deadline_ms").isNull() | (F.col("deadline_ms") > now_ms)


def state(log: DataFrame, now_ms: int) -> DataFrame:
    """The live keys as of a time: commands up to it, deadlines after it."""
    return physical(log.where(F.col("ts_ms") <= now_ms)).where(is_live(now_ms))


def ttl(held: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """(key, ttl, pttl): -2 for missing keys, -1 without deadline, seconds rounded half up."""
    left = F.col("deadline_ms") - now_ms
    both = keys.select("key").distinct().join(held, "key", "left")
    code = lambda v: F.when(F.col("last_seq").isNull() | ~is_live(now_ms), -2).when(F.col("deadline_ms").isNull(), -1).otherwise(v).cast("long")
    return both.select("key", code(F.expr(f"(deadline_ms - {now_ms} + 500) div 1000")).alias("ttl"), code(left).alias("pttl"))


def sweep(held: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Expired keys, soonest deadline first."""
    return held.where(F.col("deadline_ms") <= now_ms).orderBy("deadline_ms", "key").limit(limit).select("key", "deadline_ms")


def effective_log(log: DataFrame) -> DataFrame:
    """(offset, op, key, value, at_ms): mutations that took effect, with absolute deadlines."""
    a = annotate(log).where("effective")
    op = F.when((F.col("op") == "PEXPIRE") & (F.col("arg_ms") <= 0), "DEL").when(F.col("op") == "PEXPIRE", "PEXPIREAT").otherwise(F.col("op"))
    return a.select(F.col("seq").alias("offset"), op.alias("op"), "key", "value", F.when(op.isin("SET", "PEXPIREAT"), F.col("ts_ms") + F.col("arg_ms")).alias("at_ms"))


def replay(records: DataFrame, now_ms: int, strict: bool = False) -> DataFrame:
    """(key, value, deadline_ms) of logical records; FLUSHALL (null key) empties all before it.

    Liveness is judged at the end, or with ``strict`` at every record with the same clock, where
    a record that finds its key expired does nothing.
    """
    flush = records.where("op = 'FLUSHALL'").agg(F.coalesce(F.max("offset"), F.lit(-1)).alias("f"))
    r = records.where("op <> 'FLUSHALL'").join(F.broadcast(flush)).where("offset > f")  # one row
    w = Window.partitionBy("key").orderBy("offset")
    r = r.withColumn("seg", F.sum(F.col("op").isin("SET", "DEL").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    put = F.when(F.col("op").isin("SET", "PEXPIREAT", "PERSIST"), F.struct(F.col("at_ms").alias("d")))
    s = Window.partitionBy("key", "seg").orderBy("offset")
    r = r.withColumn("gone", F.max(F.coalesce(put.getField("d") <= now_ms, F.lit(False))).over(s.rowsBetween(Window.unboundedPreceding, 0))).withColumn("put", put)
    last = r.groupBy("key").agg(F.max("seg").alias("top")).join(r, "key").where("seg = top")
    out = last.groupBy("key").agg(F.min_by("op", "offset").alias("op"), F.min_by("value", "offset").alias("value"), F.max_by(F.col("put"), F.when(F.col("put").isNotNull(), F.col("offset"))).getField("d").alias("deadline_ms"), F.max("gone").alias("gone"))
    alive = ~F.col("gone") if strict else is_live(now_ms)
    return out.where("op = 'SET'").where(alive).select("key", "value", "deadline_ms")
