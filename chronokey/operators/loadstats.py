"""Load-test statistics: histograms and quantiles, variation, baselines, rank tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.scalars import bucket, bucket_edge


def histogram(samples: DataFrame, by: list[str], value: str = "ns") -> DataFrame:
    """(by, bucket, n) with the group's max; partial counts merge by sum."""
    return samples.groupBy(*by, bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top"))


def quantiles(hist: DataFrame, by: list[str], qs: list[float]) -> DataFrame:
    """(by, q, value): upper edge, at most the maximum, of the first bucket that reaches ceil(q n)."""
    w = Window.partitionBy(*by)
    run = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(w)).withColumn("most", F.max("top").over(w))
    h = h.withColumn("q", F.explode(F.array(*[F.lit(q) for q in qs]))).where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total"))))
    return h.groupBy(*by, "q").agg(F.least(F.min(bucket_edge(F.col("bucket"))), F.max("most")).alias("value"))


def variants(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median, min, max and sample CV in percent (0 for one sample or a zero mean)."""
    x = F.col(value).cast("double")
    cv = F.when((F.count(x) < 2) | (F.avg(x) == 0), 0.0).otherwise(F.try_divide(F.stddev_samp(x), F.avg(x)) * 100)
    return samples.groupBy(*by).agg(F.count(x).alias("n"), F.expr(f"percentile(cast({value} as double), 0.5)").alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), cv.alias("cv_pct"))


def indexed(samples: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Elements floor(q n) (at most the last) of the sorted samples, and the population CV. Equal
    values are counted before the one window."""
    x = F.col(value).cast("double")
    c = samples.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    r = c.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    at = lambda q: F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))
    pick = [F.min(F.when(F.col("_upto") > at(q), F.col(value))).alias(name) for name, q in qs.items()]
    cv = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.try_divide(F.stddev_pop(x), F.avg(x)) * 100).alias("cv_pop_pct"))
    return cv.join(r.groupBy(*by).agg(*pick), by).select(*by, "n", *qs, "cv_pop_pct")


def intra_run_cv(counts: DataFrame, by: list[str], at: str = "second", n: str = "n") -> DataFrame:
    """Sample CV in percent of a run's counts by time; of more than two buckets the last (it can be
    partial) and empty ones don't count; 0 for fewer than two buckets or values."""
    w = Window.partitionBy(*by)
    r = counts.withColumn("_last", F.max(at).over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
    x = F.when((F.col(n) > 0) & ((F.col("_k") <= 2) | (F.col(at) < F.col("_last"))), F.col(n).cast("double"))
    cv = F.when((F.max("_k") < 2) | (F.count(x) < 2) | (F.avg(x) == 0), 0.0).otherwise(F.try_divide(F.stddev_samp(x), F.avg(x)) * 100)
    return r.groupBy(*by).agg(cv.alias("cv_pct"))


def reproducibility(samples: DataFrame, config: list[str], file: str, value: str) -> DataFrame:
    """One row (configs, median_pct, p90_pct, worst_pct) of the differences (max - min) / mean of each
    configuration's medians by file; the 90th percentile is the element floor(0.9 (n - 1))."""
    medians = samples.groupBy(*config, file).agg(F.expr(f"percentile(cast({value} as double), 0.5)").alias("m"))
    d = medians.groupBy(*config).agg(((F.max("m") - F.min("m")) / F.avg("m") * 100).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("configs"), F.expr("percentile(d, 0.5)").alias("median_pct"), F.element_at(F.sort_array(F.collect_list("d")), F.floor(F.lit(0.9) * (F.count(F.lit(1)) - 1)).cast("int") + 1).alias("p90_pct"), F.max("d").alias("worst_pct"))  # a row a configuration


def across(summary: DataFrame, by: list[str], binary: str, a: str, b: str) -> DataFrame:
    """Change of the median of the same variants from one binary to another, in percent."""
    side = lambda x, name: summary.where(F.col(binary) == x).select(*by, F.col("median").alias(name))
    return side(a, "median_a").join(side(b, "median_b"), by).withColumn("change_pct", (F.col("median_b") - F.col("median_a")) / F.col("median_a") * 100)


def per_fsync(runs: DataFrame, by: list[str]) -> DataFrame:
    """Records a flush of the last repetition (rep, records, fsyncs); counters are cumulative."""
    last = runs.groupBy(*by).agg(F.max_by(F.struct("records", "fsyncs"), "rep").alias("l"))
    return last.select(*by, F.try_divide(F.col("l.records").cast("double"), F.col("l.fsyncs")).alias("records_per_fsync"))


def cores(runs: DataFrame, by: list[str]) -> DataFrame:
    """Median over runs (cpu: seconds by thread, wall_s) of all threads' seconds / wall seconds."""
    used = F.aggregate(F.map_values("cpu"), F.lit(0.0), lambda a, x: a + x)
    return runs.withColumn("_cores", F.try_divide(used, F.col("wall_s"))).groupBy(*by).agg(F.expr("percentile(_cores, 0.5)").alias("cores"))


def thread_medians(runs: DataFrame, by: list[str]) -> DataFrame:
    """Median seconds of each thread name over runs."""
    return runs.select(*by, F.explode("cpu").alias("thread", "s")).groupBy(*by, "thread").agg(F.expr("percentile(s, 0.5)").alias("seconds"))


def totals(threads: DataFrame, by: list[str], counters: list[str], series: str) -> DataFrame:
    """Sums of threads' counters, and of their series element by element (a row for each place)."""
    t = threads.select(*by, F.posexplode(series).alias("place", "n")).groupBy(*by, "place").agg(F.sum("n").alias("n"))
    s = threads.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters])
    return t.join(s, by)


def diagnostics(calls: DataFrame, by: list[str], value: str) -> DataFrame:
    return calls.groupBy(*by).agg(F.count(value).alias("calls"), F.sum(value).alias("total"), F.avg(value).alias("avg"), F.max(value).alias("max"))


def profile(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(tag, name, self, inclusive) of profile lines ``tag n address...``: the first frame is where a
    sample was, each distinct one where it passed; addresses without a symbol keep their name."""
    part = F.split("line", " ")
    s = lines.where(F.size(part) >= 2).select(F.get(part, F.lit(0)).alias("tag"), F.slice(part, F.lit(3), F.get(part, F.lit(1)).cast("int")).alias("frames"))
    s = s.withColumn("top", F.get("frames", F.lit(0))).select("tag", "top", F.explode(F.array_distinct("frames")).alias("address"))
    per = s.groupBy("tag", "address").agg(F.count_if(F.col("address") == F.col("top")).alias("self"), F.count(F.lit(1)).alias("inclusive"))
    return per.join(symbols, "address", "left").groupBy("tag", F.coalesce("symbol", "address").alias("name")).agg(F.sum("self").alias("self"), F.sum("inclusive").alias("inclusive"))


def key_values(lines: DataFrame) -> DataFrame:
    """Lines ``k=v,k=v`` as maps."""
    return lines.select("*", F.str_to_map("line", F.lit(","), F.lit("=")).alias("fields"))


def against(summary: DataFrame, by: list[str], variant: str, baseline: str) -> DataFrame:
    """Change of each variant's median against the baseline's, in percent."""
    base = summary.where(F.col(variant) == baseline).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("median").alias("base"))
    on = [F.col(c) == F.col(f"_{c}") for c in by] or [F.lit(True)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return summary.join(F.broadcast(base), cond).select(*by, variant, "median", "base", ((F.col("median") - F.col("base")) / F.col("base") * 100).alias("change_pct"))


def per_second(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by, F.floor(F.col("ts_ms") / 1000).cast("long").alias("second")).agg(F.count(F.lit(1)).alias("n"))


@pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.nan if v is None or v != v else math.erfc(v))


def mann_whitney(samples: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """(n_a, n_b, rank_sum, u, p): average ranks for ties, tie-corrected variance, continuity
    correction; p is NaN below 3 samples and 1 without variance. Ranks come from counts by value,
    which are summed before the one window."""
    s = samples.where(F.col(group).isin(a, b)).groupBy(F.col(value).alias("x")).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    s = s.withColumn("t", F.col("na") + F.col("nb"))
    s = s.withColumn("rank", F.sum("t").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - (F.col("t") - 1) / 2)
    r = s.agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.col("na") * F.col("rank")).alias("rank_sum"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n_a") + F.col("n_b")
    r = r.withColumn("u", F.col("rank_sum") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    var = F.col("n_a") * F.col("n_b") / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    z = (F.greatest(F.abs(F.col("u") - F.col("n_a") * F.col("n_b") / 2) - 0.5, F.lit(0.0))) / F.sqrt(F.nullif(var, F.lit(0.0)))
    p = F.when((F.col("n_a") < 3) | (F.col("n_b") < 3), F.lit(float("nan"))).when(var <= 0, 1.0).otherwise(_erfc(z / F.sqrt(F.lit(2.0))))
    return r.select("n_a", "n_b", "rank_sum", "u", p.alias("p"))
