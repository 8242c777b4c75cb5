"""Weighted consistent-hash ring: points, owners, shares, moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_tag, hex64, murmur

#: Points of a node of weight 1.
VNODES = 160
#: Hex digits of a hash that parts points and keys alike.
DIGITS = 3


def nodes(spark: SparkSession, names: list[str], weights: list[int] | None = None) -> DataFrame:
    """Distinct nodes; the first of equal names counts, and a weight below 1 is 1."""
    rows = [(i, n, max(1, w)) for i, (n, w) in enumerate(zip(names, weights or [1] * len(names), strict=True))]
    return spark.createDataFrame(rows, "i int, node string, weight int").groupBy("node").agg(F.min_by("weight", "i").alias("weight"))


def points(node_rows: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(hash, node): weight * vnodes points of each node, hash as 16 hex digits."""
    i = F.explode(F.sequence(F.lit(0), F.col("weight") * max(1, vnodes) - 1))
    label = F.concat_ws("#", "node", F.col("i").cast("string"))
    return node_rows.select("node", i.alias("i")).select(hex64(murmur(label)).alias("hash"), "node")


def key_hash(key: Column) -> Column:
    return hex64(murmur(hash_tag(key)))


def arcs(ring: DataFrame) -> DataFrame:
    """(low, high, node): a key with low < hash <= high is node's; the wrap is cut in two."""
    w = Window.orderBy("hash", "node")  # the ring's points, a few thousand
    p = ring.withColumn("low", F.lag("hash").over(w)).withColumn("top", F.max("hash").over(Window.partitionBy()))
    inner = p.where("low IS NOT NULL").select("low", F.col("hash").alias("high"), "node")
    first = p.where("low IS NULL")
    under = first.select(F.lit("").alias("low"), F.col("hash").alias("high"), "node")
    over = first.where("top < 'ffffffffffffffff'").select(F.col("top").alias("low"), F.lit("ffffffffffffffff").alias("high"), "node")
    return inner.unionByName(under).unionByName(over).where("low < high")


def hashed(keys: DataFrame) -> DataFrame:
    """``keys`` (key, ...) with ``hash``."""
    return keys.withColumn("hash", key_hash(F.col("key")))


def located(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """Hashed keys with ``owner``: an equality join on the first digits of the hash, of which every
    arc lists those it touches, and a range check. The arcs are what is broadcast. Neither condition
    lets Spark infer that the hash isn't null: it would be computed a second time to filter by that,
    in a Python worker more for each task."""
    digit = lambda c: F.conv(F.rpad(F.substring(c, 1, DIGITS), DIGITS, "0"), 16, 10).cast("int")
    a = arcs(ring).withColumn("slot", F.explode(F.sequence(F.when(F.col("low") == "", 0).otherwise(digit(F.col("low"))), digit(F.col("high")))))
    k = keys.withColumn("slot", F.coalesce(digit(F.col("hash")), F.lit(-1)))
    inside = F.coalesce((F.col("hash") > F.col("low")) & (F.col("hash") <= F.col("high")), F.lit(False))
    return k.join(F.broadcast(a), "slot").where(inside).select(*keys.columns, F.col("node").alias("owner"))


def owners(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """``keys`` (key, ...) with ``hash`` and ``owner``."""
    return located(hashed(keys), ring)


def shares(ring: DataFrame) -> DataFrame:
    """(node, share): part of all hashes that a node owns."""
    value = lambda c: F.when(c == "", F.lit(-1.0)).otherwise(F.conv(F.substring(c, 1, 12), 16, 10).cast("double"))
    return arcs(ring).groupBy("node").agg((F.sum(value(F.col("high")) - value(F.col("low"))) / F.lit(float(1 << 48))).alias("share"))


def moves(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, before, after) of all keys."""
    a = owners(keys.select("key"), before).withColumnRenamed("owner", "before")
    return located(a, after).select("key", "before", F.col("owner").alias("after"))


def preferences(ring: DataFrame, n: int) -> DataFrame:
    """(hash, nodes): the first n distinct nodes clockwise from each point.

    Of each node the next point at or after every point is known from a running minimum by node; the
    nodes are then ordered by that: points times nodes rows, no list to the ring's end.
    """
    names = ring.select("node").distinct()
    p = ring.select("hash", "node").withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.concat(F.col("lap").cast("string"), "hash", F.lit(" "), "node"))
    grid = p.crossJoin(F.broadcast(names.withColumnRenamed("node", "other")))  # nodes are a few
    ahead = Window.partitionBy("other").orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    grid = grid.withColumn("next", F.min(F.when(F.col("node") == F.col("other"), F.col("at"))).over(ahead)).where("lap = 0 AND next IS NOT NULL")
    got = grid.groupBy("hash", "node").agg(F.sort_array(F.collect_list(F.struct("next", "other"))).alias("o"))  # a row a node
    return got.select("hash", "node", F.slice(F.transform("o", lambda x: x["other"]), 1, n).alias("nodes"))


def with_node(node_rows: DataFrame, name: str, weight: int = 1) -> DataFrame:
    """The nodes with one more; one of that name is replaced."""
    one = node_rows.sparkSession.createDataFrame([(name, max(1, weight))], "node string, weight int")
    return without_node(node_rows, name).select("node", "weight").unionByName(one)


def without_node(node_rows: DataFrame, name: str) -> DataFrame:
    return node_rows.where(F.col("node") != name)
