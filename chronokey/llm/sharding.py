"""Operator 1: K-d tree sharding by distributed weighted medians, native."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gapless, keep, table

#: A key holds a value of 31 bits, scaled over the table's range, and 20 bits of hash to cut ties.
VALUE_BITS, TIE_BITS = 31, 20
#: Buckets of one histogram round.
BUCKETS = 4096


@dataclass
class Tree:
    """Split rules in heap order: node n has the children 2n and 2n + 1.

    ``keys`` makes the key array of a row; ``levels`` holds, for each level, the dimension and
    threshold of its nodes; a row goes right if its key is above the threshold.
    """

    keys: Column
    levels: list[tuple[list[int], list[int]]]
    shards: list[int]

    def shard(self) -> Column:
        n = F.lit(1)
        for depth, (dims, cuts) in enumerate(self.levels):
            n = _step(n, depth, dims, cuts, self.keys)
        return F.element_at(_numbers(self.shards), (n - F.lit((1 << len(self.levels)) - 1)).cast("int")).cast("int")


def _numbers(values: list[int]) -> Column:
    """A constant array, folded to one literal however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _step(node: Column, depth: int, dims: list[int], cuts: list[int], keys: Column) -> Column:
    first = (1 << depth) - 1

    def go(n: Column) -> Column:
        at = (n - F.lit(first)).cast("int")
        right = F.element_at(keys, F.element_at(_numbers(dims), at).cast("int")) > F.element_at(_numbers(cuts), at)
        return n * 2 + right.cast("int")

    return F.element_at(F.transform(F.array(node), go), 1)  # the node is computed once


def build(df: DataFrame, dims: dict[str, Column], size: Column, tie: Column, shards: int | None = None, target_bytes: int | None = None, slack: float = 0.002) -> tuple[Tree, DataFrame]:
    """Split ``df`` into ``shards`` leaves, or into as many as reach ``target_bytes``.

    Each level costs two or more passes over a written table of keys and sizes: one finds every
    node's ranges and sums, the others its weighted median along its widest dimension, as a
    histogram whose boundary bucket alone is cut again, until that holds one row or less than
    ``slack`` of a leaf. A node that is to give k leaves is cut at floor(k / 2) / k of its bytes.
    The driver holds the rules, a few numbers a leaf.

    Null values count as below all others. An empty table gets rules too. Rows equal in values
    and tie can't be parted.
    """
    spark = df.sparkSession
    names = list(dims)
    raw = keep(df.select(*[c.cast("double").alias(n) for n, c in dims.items()], size.cast("long").alias("size"), F.pmod(F.xxhash64(tie), F.lit(1 << TIE_BITS)).alias("tie")), "points")
    ends = raw.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))], F.sum("size").alias("size")).first()
    total = ends["size"] or 0
    leaves = shards or max(1, -(-total // (target_bytes or 1)))

    def key(n: str, c: Column, h: Column) -> Column:
        lo, hi = ends[f"lo_{n}"] or 0.0, ends[f"hi_{n}"] or 0.0
        scaled = ((c.cast("double") - F.lit(lo)) * F.lit(((1 << VALUE_BITS) - 1) / (hi - lo) if hi > lo else 0.0)).cast("long")
        return F.coalesce(scaled, F.lit(0).cast("long")) * F.lit(1 << TIE_BITS) + h

    points = keep(raw.select(F.array(*[key(n, F.col(n), F.col("tie")) for n in names]).alias("k"), "size"), "keys")
    rules = F.array(*[key(n, c, F.pmod(F.xxhash64(tie), F.lit(1 << TIE_BITS))) for n, c in dims.items()])
    tree = Tree(rules, [], [])
    want = {1: leaves}
    while max(want.values()) > 1:
        dim, cut = _level(points, tree, want, names, slack * total / leaves)
        depth = len(tree.levels)
        nodes = range(1 << depth, 2 << depth)
        tree.levels.append(([dim.get(n, 1) for n in nodes], [cut.get(n, (1 << 62)) for n in nodes]))
        want = {2 * n + r: (k - k // 2 if r else k // 2) if k > 1 else (0 if r else k) for n, k in want.items() for r in (0, 1)}
        want = {n: k for n, k in want.items() if k}
    first = 1 << len(tree.levels)
    number = {n: i for i, n in enumerate(sorted(want))}
    tree.shards = [number.get(n, 0) for n in range(first, 2 * first)]
    return tree, df


def _level(points: DataFrame, tree: Tree, want: dict[int, int], names: list[str], slack: float) -> tuple[dict, dict]:
    depth, node = len(tree.levels), F.lit(1)
    for d, (dims, cuts) in enumerate(tree.levels):
        node = _step(node, d, dims, cuts, F.col("k"))
    first = 1 << depth
    slot = (F.col("node") - F.lit(first - 1)).cast("int")
    rows = points.select(node.alias("node"), "k", "size")
    ranges = rows.groupBy("node").agg(F.sum("size").alias("size"), *[f(F.element_at("k", i + 1)).alias(f"{t}{i}") for i in range(len(names)) for t, f in (("lo", F.min), ("hi", F.max))])
    dim, lo, hi, goal = {}, {}, {}, {}
    for r in ranges.collect():  # a row for each node
        n = r["node"]
        if want.get(n, 0) > 1:
            wide = max(range(len(names)), key=lambda i: r[f"hi{i}"] - r[f"lo{i}"])
            dim[n], lo[n], hi[n] = wide + 1, r[f"lo{wide}"], r[f"hi{wide}"]
            goal[n] = r["size"] * (want[n] // 2) / want[n]
    cut, below, open_ = {}, dict.fromkeys(dim, 0), set(dim)
    while open_:
        step = {n: (hi[n] - lo[n]) // BUCKETS + 1 for n in open_}
        at = lambda m, none: F.element_at(_numbers([m.get(n, none) if n in open_ else none for n in range(first, 2 * first)]), slot)
        x = F.element_at("k", at(dim, 1).cast("int"))
        near = rows.select("node", x.alias("x"), at(lo, 1).alias("lo"), at(hi, 0).alias("hi"), at(step, 1).alias("step"), at({n: int(goal[n]) - below[n] for n in open_}, 0).alias("goal"), "size").where("x >= lo AND x <= hi")
        sums = near.groupBy("node", "lo", "step", "goal", F.expr("(x - lo) div step").alias("b")).agg(F.sum("size").alias("w"), F.min("x").alias("x0"), F.max("x").alias("x1"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("b"))
        hit = sums.withColumn("upto", upto).where("upto > goal").groupBy("node").agg(F.min(F.struct("b", "upto", "w", "x0", "x1")).alias("m")).select("node", "m.*")
        got = {r["node"]: r for r in hit.collect()}  # a row for each node
        for n in list(open_):
            r = got.get(n)
            if r is None:  # nothing lies above the goal
                cut[n] = hi[n]
                open_.discard(n)
                continue
            under, over = below[n] + r["upto"] - r["w"], below[n] + r["upto"]
            if r["x0"] == r["x1"] or r["w"] <= slack:
                cut[n] = r["x1"] if over - goal[n] <= goal[n] - under else r["x0"] - 1
                open_.discard(n)
            else:
                below[n], lo[n], hi[n] = under, r["x0"], r["x1"]
    return dim, cut


def crc_text(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def metadata() -> dict[str, Column]:
    """Dimensions of ``documents``: id, log of length, language, source (as points of [0, 1))."""
    unit = lambda c: F.crc32(F.coalesce(c, F.lit("")).cast("binary")) / F.lit(float(1 << 32))
    return {"doc_id": F.col("doc_id"), "length": F.log1p(F.coalesce(F.octet_length("text"), F.lit(0))), "lang": unit(F.col("lang")), "source": unit(F.col("source"))}


def op1_kd_shards(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """All ``documents`` in ``shards`` leaves of near equal bytes (law ``bytes``).

    Null and empty texts have size 16 and CRC 0. Slots go by doc_id inside a shard. Repeated rows
    are parted by chance of their tie hash only if their ids differ.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    docs = table(spark, sf_dir, "documents")
    flat = keep(docs.select("doc_id", *[c.cast("double").alias(f"d_{n}") for n, c in metadata().items()], size.alias("size"), crc_text(F.col("text")).alias("text_crc32")), "metadata")
    dims = {n: F.col(f"d_{n}") for n in metadata()}
    tree, _ = build(flat, dims, F.col("size"), F.struct("doc_id", "text_crc32"), shards=shards)
    placed = keep(flat.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), tree.shard().alias("shard")), "placed")
    return gapless(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, target_bytes: int) -> Tree:
    """Write whole ``documents`` rows as one folder a shard of about ``target_bytes``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    tree, _ = build(docs, metadata(), size, F.struct("doc_id", crc_text(F.col("text"))), target_bytes=target_bytes)
    docs.withColumn("shard", tree.shard()).write.partitionBy("shard").parquet(path)
    return tree
