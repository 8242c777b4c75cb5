"""What the training-data operators share: written tables, gapless numbers, components."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast up to so many rows (of a few longs each), and joined by shuffle beyond.
BROADCAST_ROWS = 200_000
#: Spark's own setting that deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting of the rows that go to Python at once, and a value that keeps long texts from filling memory.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2048"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Where it is unset a temporary
    one is made, but only if all tasks run in the driver's own process (a local master)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.chronokey.scratch", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="chronokey-")
        spark.conf.set("spark.chronokey.scratch", base)
    return base


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage.

    The files outlive a lost executor, and every later reader gets the same rows. ``release``
    deletes them; the shuffles behind them go as soon as they are written.
    """
    path = f"{shared_dir(df.sparkSession)}/chronokey/{uuid.uuid4().hex}/{name}"
    conf = df.sparkSession.conf
    before = {k: conf.get(k, v) for k, v in ((CLEANUP, "false"), (BATCH, "10000"))}
    conf.set(CLEANUP, "true")
    conf.set(BATCH, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def release(*kept: DataFrame | None) -> None:
    """Delete kept tables whose last reader has been written."""
    for df in kept:
        path = getattr(df, "kept_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted name, one like it that no column of ``df`` has, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in have:
            w += "_"
        have.add(w.lower())
        out.append(w)
    return out


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a kept table of few narrow columns) marked for broadcast if its counted rows
    are at most ``limit``; else to be hashed partition by partition after a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("shuffle_hash")


def gapless(df: DataFrame, group: list[str], order: list[str], name: str, rows_per_task: int = 20_000) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in each group, without a gap.

    Rows go by the first column of ``order`` (a number; null first), those equal in it by a hash of
    all its columns and then by these, at every size. No group meets in one task: rows are
    numbered in slices by ranges of the first column, and each slice starts where the counts of those
    before it end. A value that fills a slice is one of its own, cut by hash. ``df`` must give the same
    rows each time it is read (a kept table); rows equal in all of ``order`` get neighbouring numbers.
    """
    g = [f"_g{i}" for i in range(len(group))]
    lead, hashed, slice_, part, row, at_slice, at_part, start, parts, *g = free_name(df, "_lead", "_hash", "_slice", "_part", "_row", "_s", "_p", "_start", "_parts", *g)
    total = df.count()
    wide = df.withColumn(lead, F.col(order[0]).cast("double")).withColumn(hashed, F.xxhash64(*[F.col(c) for c in order]))
    cuts: list[float] = []
    if total > rows_per_task:
        n = min(4096, -(-total // rows_per_task))
        at = df.agg(F.percentile_approx(F.col(order[0]).cast("double"), [i / n for i in range(1, n)], 10 * n)).first()[0]
        cuts = sorted(set(at or []))
    # 2 i: between the cuts i - 1 and i; 2 i + 1: at cut i
    bounds = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>") if cuts else F.array().cast("array<double>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))]) if cuts else F.array().cast("array<int>")
    below = F.aggregate(steps, F.lit(0), lambda a, x: F.when((a + x <= len(cuts)) & (F.try_element_at(bounds, a + x) < F.col(lead)), a + x).otherwise(a))
    same = F.coalesce(F.try_element_at(bounds, below + 1) == F.col(lead), F.lit(False)).cast("int")
    cut = wide.withColumn(slice_, F.when(F.col(lead).isNull(), F.lit(-1)).otherwise(below * 2 + same))
    named = [F.col(c).alias(x) for c, x in zip(group, g, strict=True)]
    many = cut.groupBy(*group, slice_).count().where((F.col("count") > 2 * rows_per_task) & (F.col(slice_) % 2 != 0))
    many = many.select(*named, F.col(slice_).alias(at_slice), F.ceil(F.col("count") / F.lit(rows_per_task)).cast("int").alias(parts))
    on = lambda slices: functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(group, g, strict=True)], slices)
    if cuts:
        hot = keep(many, "hot")
        high = F.shiftright(hashed, 32) + F.lit(1 << 31)  # 0 .. 2^32 - 1, in the hash's own order
        cut = cut.join(small_side(hot), on(F.col(slice_) == F.col(at_slice)), "left").withColumn(part, F.coalesce(F.shiftright(high * F.col(parts), 32), F.lit(0))).drop(*g, at_slice, parts)
    else:
        cut = cut.withColumn(part, F.lit(0).cast("long"))
    sizes = cut.groupBy(*group, slice_, part).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*group).orderBy(slice_, part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*named, F.col(slice_).alias(at_slice), F.col(part).alias(at_part), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias(start))
    starts = keep(starts, "starts")
    inside = Window.partitionBy(*group, slice_, part).orderBy(lead, hashed, *order)
    numbered = cut.withColumn(row, F.row_number().over(inside))
    joined = numbered.join(small_side(starts), on((F.col(slice_) == F.col(at_slice)) & (F.col(part) == F.col(at_part))))
    return joined.select(*df.columns, (F.col(start) + F.col(row) - 1).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id that each node of ``edges`` (u, v) reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014) on a written edge table;
    each step halves what is left, and minima are combined before each shuffle, so that a node
    with very many edges costs no more than its rows.
    """
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large, "large")
        old = now
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = keep(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        release(large, old)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    out = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node")).distinct().join(out.select("node"), "node", "left_anti")
    whole = keep(out.union(roots.select("node", F.col("node").alias("component"))), "components")
    release(now)
    return whole
