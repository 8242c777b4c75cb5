"""Replication, quorum and failover decisions as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offset_gate(log: DataFrame) -> DataFrame:
    """``log`` (replid, arrival, offset) with ``verdict``: duplicate, apply, or gap once an offset skips.

    In arrival order a record applies if it is the next offset; one at or below the last applied is
    a duplicate; the first beyond it stops the lineage, and so does all after it.
    """
    w = Window.partitionBy("replid").orderBy("arrival")
    seen = F.coalesce(F.max("offset").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = log.withColumn("last", seen).withColumn("jump", F.col("offset") > F.col("last") + 1)
    stopped = F.max("jump").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("verdict", F.when(stopped, "gap").when(F.col("offset") <= F.col("last"), "duplicate").otherwise("apply")).drop("last", "jump")


def quorum_acked(links: DataFrame, n: int, max_age_ms: int = 1500) -> DataFrame:
    """(shard, synced, acked): the n-th largest of the best acknowledgements of distinct replicas
    in sync; 0 if there are fewer than n, unbounded for n = 0."""
    w = Window.partitionBy("shard").orderBy(F.desc("acked"), "rid")
    best = links.where((F.col("state") == "streaming") & (F.col("ack_age_ms") <= max_age_ms)).groupBy("shard", "rid").agg(F.max("acked").alias("acked")).withColumn("r", F.row_number().over(w))
    per = best.groupBy("shard").agg(F.count(F.lit(1)).alias("synced"), F.max(F.when(F.col("r") == n, F.col("acked"))).alias("a"))
    acked = F.lit(2**63 - 1) if n == 0 else F.coalesce("a", F.lit(0))
    return links.select("shard").distinct().join(per, "shard", "left").select("shard", F.coalesce("synced", F.lit(0)).alias("synced"), acked.cast("long").alias("acked"))


def lag(links: DataFrame, last: DataFrame) -> DataFrame:
    return links.join(last, "shard").select("shard", "rid", (F.col("last_offset") - F.col("acked")).alias("lag"))


def write_gate(members: DataFrame, need: int) -> DataFrame:
    """(shard, name, verdict) in the order role, fence, lease, quorum."""
    v = F.when(F.col("role") != "master", "READONLY replica").when(F.col("fenced"), "READONLY fenced").when(~F.col("lease_valid"), "READONLY lease").when(F.col("synced_replicas") < need, "NOREPLICAS").otherwise("OK")
    return members.select("shard", "name", v.alias("verdict"))


def read_gate(members: DataFrame) -> DataFrame:
    v = F.when((F.col("role") != "master") & ~F.col("synced"), "LOADING").when((F.col("role") == "master") & ~F.col("lease_valid"), "NOLEASE").otherwise("OK")
    return members.select("shard", "name", v.alias("verdict"))


def discover(members: DataFrame, persisted: DataFrame) -> DataFrame:
    """(shard, epoch, primary): the one master at the largest reachable epoch, else the designated
    member if it is there; null if the epoch is below the persisted one, or none qualifies."""
    up = members.where("reachable")
    top = up.groupBy("shard").agg(F.max("epoch").alias("epoch"))
    at = up.join(top, ["shard", "epoch"]).groupBy("shard", "epoch").agg(F.count_if(F.col("role") == "master").alias("m"), F.max(F.when(F.col("role") == "master", F.col("name"))).alias("master"), F.max(F.when(F.col("member") == 0, F.col("name"))).alias("first"))
    ok = F.col("epoch") >= F.coalesce("persisted_epoch", F.lit(0))
    return at.join(persisted, "shard", "left").select("shard", "epoch", F.when(ok & (F.col("m") == 1), F.col("master")).when(ok & (F.col("m") == 0), F.col("first")).alias("primary"))


def failed(probes: DataFrame, fail_after: int) -> DataFrame:
    """(shard, longest, failed): longest run of failed probes."""
    w = Window.partitionBy("shard").orderBy("at_ms")
    run = probes.withColumn("g", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("NOT ok").groupBy("shard", "g").count()
    best = run.groupBy("shard").agg(F.max("count").alias("longest"))
    return probes.select("shard").distinct().join(best, "shard", "left").select("shard", F.coalesce("longest", F.lit(0)).alias("longest"), (F.coalesce("longest", F.lit(0)) >= fail_after).alias("failed"))


def promote(members: DataFrame, replicas: int, acks: int, now_ms: int) -> DataFrame:
    """(shard, name, offset): of enough eligible replicas, the one furthest, then first by name."""
    need = replicas - acks + 1 if acks else 1
    ok = members.where(f"reachable AND role = 'slave' AND synced AND epoch = shard_epoch AND replid = shard_replid AND safe_expiry_ms <= {now_ms}")
    w = Window.partitionBy("shard")
    r = ok.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("offset"), "name")))
    return r.where((F.col("r") == 1) & (F.col("n") >= need)).select("shard", "name", "offset")


def reconcile(members: DataFrame, primaries: DataFrame) -> DataFrame:
    """Members to demote: not the primary, but master or on an older epoch."""
    return members.join(primaries.select("shard", "primary"), "shard").where("name <> primary AND reachable AND (role = 'master' OR epoch < shard_epoch)").select("shard", "name")


def resync(replicas: DataFrame, logs: DataFrame) -> DataFrame:
    """(name, mode): partial if the lineage matches (or the previous one up to its end) and the
    next offset is retained, else full."""
    j = replicas.join(logs, "shard")
    same = (F.col("replid") == F.col("log_replid")) | ((F.col("replid") == F.col("prev_id")) & (F.col("next_offset") - 1 <= F.col("end_offset")))
    kept = (F.col("next_offset") >= F.col("first_offset")) & (F.col("next_offset") <= F.col("last_offset") + 1)
    return j.select("shard", "name", F.when(same & kept, "partial").otherwise("full").alias("mode"))


def released(batches: DataFrame) -> DataFrame:
    """Replies that may go out: in each connection, those before the first that must wait."""
    w = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("durable") & (F.col("offset") <= F.col("acked")) & F.col("lease_valid")
    return batches.withColumn("ok", F.min(ok).over(w)).where("ok").select("conn", "seq")


def trim(log: DataFrame, budget: int, overhead: int = 48) -> DataFrame:
    """Backlog kept under a byte budget: newest first, at least one record."""
    w = Window.partitionBy("replid").orderBy(F.desc("offset")).rowsBetween(Window.unboundedPreceding, 0)
    r = log.withColumn("held", F.sum(F.col("size") + overhead).over(w)).withColumn("r", F.count(F.lit(1)).over(w))
    return r.where((F.col("held") <= budget) | (F.col("r") == 1)).select("replid", "offset", "held")


def read_from(log: DataFrame, start: int, budget: int) -> DataFrame:
    """Records from an offset within a byte budget, at least one."""
    w = Window.partitionBy("replid").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    r = log.where(F.col("offset") >= start).withColumn("sent", F.sum("size").over(w)).withColumn("r", F.count(F.lit(1)).over(w))
    return r.where((F.col("sent") <= budget) | (F.col("r") == 1)).select("replid", "offset", "sent")
