"""Operator 2: optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, gapless, keep, table
from .mixing import n_words


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding, smallest bounds first.

    cost[j] after b buckets = min over i of cost[i] after b - 1 + (counts of i..j) * length[j];
    the lengths themselves are a constant, so that padded size stands for padding.
    """
    n, size = len(lengths), [int(x) for x in lengths]
    if not n:
        return []
    c = [0]
    for x in counts:
        c.append(c[-1] + int(x))
    best: list[int | None] = [0, *[None] * n]
    back = []
    for _ in range(min(buckets, n)):
        # line i, best[i] - c[i] * length, gets steeper with i and lengths grow: a lower hull, each step's
        # winner never before the last one's; all numbers are whole, so that nothing is rounded
        new, arg, hull, at = [0, *[None] * n], [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                while len(hull) - at > 1:
                    x, y = hull[-2], hull[-1]
                    if (best[i] - best[x]) * (c[y] - c[x]) > (best[y] - best[x]) * (c[i] - c[x]):
                        break
                    hull.pop()
                hull.append(i)
            long = size[j - 1]
            while len(hull) - at > 1 and best[hull[at + 1]] - c[hull[at + 1]] * long < best[hull[at]] - c[hull[at]] * long:
                at += 1
            if hull:
                arg[j] = hull[at]
                new[j] = best[hull[at]] + (c[j] - c[hull[at]]) * long
        best = new
        back.append(arg)
    bounds, j = [], n
    for arg in reversed(back):
        if j <= 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = arg[j]
    return sorted(set(bounds))


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 16384, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row of ``docs`` with n_tokens, bucket, bucket_len, batch, batch_row, padding.

    The exact histogram of lengths over all rows decides the bounds by dynamic programming; it fits
    the driver, as D distinct lengths take texts of D * D / 2 tokens in all. A bucket of bound L fills batches of
    max(1, budget // L) rows, in the order given; its last batch may be short. Rows of length 0
    (null or empty texts) share the first bucket. A row longer than the budget is a batch of its
    own. Nothing is cut or dropped. Null values of the order columns come first, rows equal in all of
    them (repeated rows) in any order; columns named as the added ones (``ADDED``) are replaced, all
    others stay as they are, whatever their names; an empty table gives an empty one.
    """
    own, = free_name(docs, "_length")
    rows = keep(docs.withColumn(own, (n_words(F.col("text")) if length is None else length).cast("long")), "lengths")  # words are counted once
    return _pack(rows, own, buckets, budget, order)


#: The columns that packing adds.
ADDED = ("n_tokens", "bucket", "bucket_len", "batch", "batch_row", "padding")


def _pack(rows: DataFrame, length: str, buckets: int, budget: int, order: tuple[str, ...]) -> DataFrame:
    """``rows`` without the column ``length``, and what packing adds to them."""
    bucket, row = free_name(rows, "_bucket", "_at")
    hist = rows.groupBy(F.col(length).alias("len")).count().orderBy("len").collect()
    bounds = optimal_bounds(np.array([r["len"] for r in hist]), np.array([r["count"] for r in hist]), buckets)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds or [0]])
    placed = rows.withColumn(bucket, F.size(F.filter(limits, lambda b: b < F.col(length))) if bounds else F.lit(0))
    numbered = gapless(placed, [bucket], list(order), row)
    n, bound, at = F.col(length), F.element_at(limits, F.col(bucket) + 1), F.col(row)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1))))
    batch = F.floor(at / room)
    made = dict(zip(ADDED, (n, F.col(bucket), bound, batch, at - batch * room, bound - n), strict=True))
    return numbered.select(*[c for c in rows.columns if c not in (length, *ADDED)], *[c.alias(k) for k, c in made.items()])


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in batches, by doc_id; rows equal in doc_id, size and text are interchangeable."""
    slim = keep(table(spark, sf_dir, "documents").select("doc_id", n_words(F.col("text")).alias("_length"), F.xxhash64("text").alias("_text")), "lengths")
    return _pack(slim, "_length", 16, 16384, ("doc_id", "_length", "_text")).drop("_text")
