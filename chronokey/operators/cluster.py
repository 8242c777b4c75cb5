"""Tables spread over nodes: sums and unions over them, reads and routes while keys move, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ring import located, owners


def sizes(held: DataFrame) -> DataFrame:
    """(keys, distinct_keys) of all nodes' tables: a key that is being moved counts on both nodes."""
    return held.agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("key").alias("distinct_keys"))


def keys(held: DataFrame, pattern: str) -> DataFrame:
    """The distinct keys of all nodes that match a regular expression."""
    return held.where(F.col("key").rlike(pattern)).select("key").distinct()


def routed(requests: DataFrame, ring: DataFrame, old_ring: DataFrame) -> DataFrame:
    """``requests`` (key, ...) with the owner ``now`` and, while a move is under way, ``before``."""
    now = owners(requests, ring).withColumnRenamed("owner", "now")
    return located(now, old_ring).withColumnRenamed("owner", "before").drop("hash")


def placed(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Routed requests with what the owners now and before hold: two equality joins by node and key."""
    has = lambda side: held.select(F.col("node").alias(side), "key", F.col("value").alias(f"{side}_value"), F.col("deadline_ms").alias(f"{side}_deadline"), F.lit(True).alias(f"{side}_has"))
    out = requests.join(has("now"), ["now", "key"], "left").join(has("before"), ["before", "key"], "left")
    return out.withColumns({f"{s}_has": F.coalesce(f"{s}_has", F.lit(False)) for s in ("now", "before")})


def read(requests: DataFrame, held: DataFrame) -> DataFrame:
    """(key, value, served_by): the new owner's copy, else the old owner's."""
    p = placed(requests, held)
    return p.select("key", F.when(F.col("now_has"), F.col("now_value")).otherwise(F.col("before_value")).alias("value"), F.when(F.col("now_has"), F.col("now")).when(F.col("before_has"), F.col("before")).alias("served_by"))


def route(op: Column) -> Column:
    """Where a placed request goes: GET asks the new owner, then the old; SET deletes on the old first;
    DEL goes to both; limiter calls go to the bucket's holder, and to the new owner if there is none;
    all else to the new owner if it has the key, and to the old one if not."""
    now, before = F.col("now"), F.col("before")
    holder = F.when(F.col("now_has"), now).otherwise(before)
    moving = (F.when(op == "GET", F.when(F.col("now_has"), F.array(now)).otherwise(F.array(now, before))).when(op == "SET", F.array(before, now)).when(op == "DEL", F.array(now, before))
              .when(op.startswith("RL."), F.array(F.when(F.col("now_has") | ~F.col("before_has"), now).otherwise(before))).otherwise(F.array(holder)))
    return F.when(now == before, F.array(now)).otherwise(moving)


def migrate(held: DataFrame, listed: DataFrame, ring: DataFrame) -> DataFrame:
    """(key, source, dest, outcome, deadline_ms) of keys ``listed`` (node, key) on a node that is not
    their owner any more, by joins with the nodes' tables: vanished if the source no longer has it,
    superseded if the destination has one (which wins), else moved with its deadline."""
    plan = owners(listed.select(F.col("node").alias("source"), "key"), ring).withColumnRenamed("owner", "dest").drop("hash").where("source <> dest")
    mine = held.select(F.col("node").alias("source"), "key", "deadline_ms", F.lit(True).alias("have"))
    theirs = held.select(F.col("node").alias("dest"), "key", F.col("deadline_ms").alias("their_deadline"), F.lit(True).alias("dest_has"))
    p = plan.join(mine, ["source", "key"], "left").join(theirs, ["dest", "key"], "left")
    outcome = F.when(F.col("have").isNull(), "vanished").when(F.col("dest_has"), "superseded").otherwise("moved")
    return p.select("key", "source", "dest", outcome.alias("outcome"), F.when(F.col("dest_has"), F.col("their_deadline")).otherwise(F.col("deadline_ms")).alias("deadline_ms"))


def report(moves: DataFrame) -> DataFrame:
    """One row: scanned, moved, superseded, vanished; what moved no more is left to a rerun."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return moves.agg(F.count(F.lit(1)).alias("scanned"), count("moved"), count("superseded"), count("vanished"))


def unknown_members(members: DataFrame, shards: DataFrame) -> DataFrame:
    """Members whose shard isn't declared."""
    return members.join(shards, "shard", "left_anti").select("shard", "name")
