"""Operator 9: mix sources to target weights by nested hash thresholds, native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, keep, release, small_side

#: The hash of a document has 60 bits; each round looks at 12 more of them.
HASH_BITS, ROUND_BITS = 60, 12


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, seed: str = "mix") -> Column:
    """60 bits of MD5, which SQL engines share; a null id hashes as the empty string."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, most: float = 3.0, period: int = 3) -> DataFrame:
    """(source, source_size) to the same with ``target``.

    Sources in code point order, null last, weigh 1 .. ``period``, repeating; they share the
    sum of all sizes by weight; none gets over ``most`` times its size, and what is over is
    shared again by weight. That is water filling: target = min(most * size, level * weight),
    and the level follows from the sources in order of most * size / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % period + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    by = Window.orderBy("full_at", F.col("source").isNull(), "source")
    after, before = by.rowsBetween(0, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.try_divide("left", F.sum("weight").over(after)))
    # the first source that isn't full at the level that it and those after it would share
    s = s.withColumn("place", F.row_number().over(by))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return s.select("source", "source_size", "target")


def mix(docs: DataFrame, size: Column | None = None, seed: str = "mix") -> DataFrame:
    """Each row of ``docs`` (doc_id, source and others) with size, source_size, target, taken.

    ``taken``: words of the row that the mix takes. A source that is to give T of S words gives
    each document floor(T / S) times, and once more those whose hash lies below the threshold
    that brings the rest T - floor(T / S) * S; the threshold comes from sums by source and hash
    bucket, of which only the boundary bucket is looked at again, 12 bits a round, until the hash
    has no more bits. The document at the threshold gives what is then left to the target (documents
    of one id share it by size). Nothing is sorted and no source meets in one task.

    Defined results: null or empty texts have size 0 and taken 0; a null source is a source of
    its own, the last; rows with equal doc_id go together; an empty table gives an empty one. A
    source without words has target 0. Columns of ``docs`` named as the four are replaced, all others
    stay as they are, whatever their names.
    """
    size = n_words(F.col("text")) if size is None else size
    own, h, *names = free_name(docs, "_size", "_h", "_of", "_target", "_taken")
    slim = keep(docs.select("doc_id", "source", size.alias("size"), doc_hash(F.col("doc_id"), seed).alias("h")), "sizes")
    out = take(docs.withColumn(own, size).withColumn(h, doc_hash(F.col("doc_id"), seed)), thresholds(slim), own, h, tuple(names))
    release(slim)
    made = dict(zip(("size", "source_size", "target", "taken"), (own, *names), strict=True))
    return out.select(*[c for c in docs.columns if c not in made], *[F.col(c).alias(k) for k, c in made.items()])


def take(rows: DataFrame, plan: DataFrame, size: str, h: str, names: tuple[str, str, str]) -> DataFrame:
    """``rows`` with its source's size and target, and the words taken, under ``names``."""
    source, times, upto, part, edge = free_name(rows, "_source", "_times", "_upto", "_part", "_edge")
    plan = plan.select(F.col("source").alias(source), F.col("source_size").alias(names[0]), F.col("target").alias(names[1]), F.col("times").alias(times), F.col("upto").alias(upto), F.col("part").alias(part), F.col("edge").alias(edge))
    out = rows.join(small_side(plan), F.col("source").eqNullSafe(F.col(source)))
    share = F.expr(f"(`{size}` * `{part}`) div nullif(`{edge}`, 0)")
    once = F.when(F.col(h) < F.col(upto), F.col(size)).when(F.col(h) == F.col(upto), F.coalesce(share, F.lit(0))).otherwise(0).cast("long")
    return out.withColumn(names[2], F.col(size) * F.col(times) + once).drop(source, times, upto, part, edge)


def repeat(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken (a part of a row at the
    threshold counts as one if it is at least half), with its own columns only."""
    size, h, copy, *names = free_name(docs, "_size", "_h", "_copy", "_of", "_target", "_taken")
    slim = keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), seed).alias("h")), "sizes")
    rows = docs.withColumn(size, n_words(F.col("text"))).withColumn(h, doc_hash(F.col("doc_id"), seed))
    mixed = take(rows, thresholds(slim), size, h, tuple(names))
    release(slim)
    copies = F.round(F.coalesce(F.try_divide(F.col(names[2]), F.col(size)), F.lit(0.0))).cast("int")
    out = mixed.where((2 * F.col(names[2]) >= F.col(size)) & (F.col(size) > 0)).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    return out.select(*docs.columns)


def thresholds(slim: DataFrame) -> DataFrame:
    """(source, source_size, target, times, upto) of (source, size, h)."""
    sizes = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = targets(sizes).withColumn("times", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    # [lo, lo + 2^left) is the boundary bucket; below it lie `below` words, all taken
    plan = keep(plan.withColumn("lo", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")).withColumn("edge", F.lit(None).cast("long")), "targets")
    for left in range(HASH_BITS, 0, -ROUND_BITS):
        width = 1 << (left - ROUND_BITS)
        at = plan.select(F.col("source").alias("_s"), "lo", "below", "rest")
        near = slim.join(small_side(at), F.col("source").eqNullSafe(F.col("_s")) & (F.col("h") >= F.col("lo")) & (F.col("h") - F.col("lo") < F.lit(1 << left)))
        sums = near.groupBy("source", "lo", "below", "rest", F.shiftright(F.col("h") - F.col("lo"), left - ROUND_BITS).alias("b")).agg(F.sum("size").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("source").orderBy("b"))
        fits = sums.withColumn("upto", F.col("below") + upto).where("upto <= rest")
        # the boundary is the bucket after the last that fits whole; empty buckets between hold nothing
        last = fits.groupBy("source").agg(F.max("b").alias("b"), F.max("upto").alias("upto")).withColumnRenamed("source", "_s")
        moved = plan.drop("edge").join(last, F.col("source").eqNullSafe(F.col("_s")), "left")
        first = sums.withColumn("upto", F.col("below") + upto).where("upto > rest").groupBy("source").agg(F.min("b").alias("nb"), F.min_by("w", "b").alias("edge")).withColumnRenamed("source", "_f")
        moved = moved.join(first, F.col("source").eqNullSafe(F.col("_f")), "left")
        step = F.coalesce(F.col("nb"), F.when(F.col("b").isNotNull(), F.col("b") + 1), F.lit(0))
        plan = keep(moved.select("source", "source_size", "target", "times", "rest", (F.col("lo") + step * F.lit(width)).alias("lo"), F.coalesce("upto", "below").alias("below"), "edge"), "round")
    part = F.floor(F.col("rest") - F.col("below")).cast("long")
    return plan.select("source", "source_size", "target", "times", F.col("lo").alias("upto"), part.alias("part"), "edge")


def op9_mix(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    slim = keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h")), "sizes")
    return take(slim, thresholds(slim), "size", "h", ("source_size", "target", "taken")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / weight AS full_at,
        (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
        sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum FROM w),
l AS (SELECT min_by(rest / wsum, (full_at, source IS NULL, source)) FILTER (WHERE rest / wsum <= full_at) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM o, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
c AS (SELECT d.*, p.source_size, p.target, p.times,
        sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(size) OVER (PARTITION BY d.source, h) AS edge
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * times + CASE WHEN upto <= target - times * source_size THEN size
          WHEN upto - edge <= target - times * source_size THEN (size * floor(target - times * source_size - (upto - edge))::BIGINT) // edge ELSE 0 END)::BIGINT AS taken, source
FROM c
"""
