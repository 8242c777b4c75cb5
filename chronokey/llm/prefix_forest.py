"""Operator 8: nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small_side, table
from .vectors import classes, matrix

#: Trees, bits of a hash string, rows of a block of the index, queries that meet it in one task, queries scored at once.
TREES, BITS, ROWS, ASKED, BLOCK = 32, 60, 20_000, 4000, 128
#: Share of a block that, as candidates, is scored by one product for several queries; less is scored query by query.
DENSE = 0.1
#: Queries that set how far the trees are ascended, and the recall asked of them.
PROBES, RECALL = 96, 0.96


def planes(dim: int) -> np.ndarray:
    """Random directions, orthogonal within each run of ``dim`` of a tree."""
    r = np.random.default_rng(11)
    out = []
    for _ in range(TREES):
        runs = [np.linalg.qr(r.normal(size=(dim, dim)))[0] for _ in range(-(-BITS // dim))]
        out.append(np.hstack(runs)[:, :BITS])
    return np.hstack(out)


def strings(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The hash string of each vector in each tree, first bit highest."""
    bits = (v @ p > 0).reshape(len(v), TREES, BITS)
    return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _lcp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of hash strings."""
    x = a ^ b
    high = np.frexp(x.astype(np.float64))[1]  # bit length, at most one too many by rounding
    return BITS - np.minimum(high, BITS)


def bounds(codes: np.ndarray, want: np.ndarray, d) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share the first ``d`` bits of ``want`` begin and end in the sorted ``codes``."""
    d = np.asarray(d, np.int64)
    low = (want >> (BITS - d)) << (BITS - d)
    return np.searchsorted(codes, low), np.searchsorted(codes, low + (np.int64(1) << (BITS - d)))


def tallies(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How many strings of ``h``, in all trees, share 0, 1, ..., BITS bits with each query of ``w``."""
    c = np.zeros((len(w), BITS + 1), np.int64)
    for t in range(TREES):
        codes = np.sort(h[:, t])
        for s in range(0, len(w), 1024):
            lo, hi = bounds(codes, w[s : s + 1024, t, None], np.arange(BITS + 1)[None])
            c[s : s + 1024] += hi - lo
    return c


def candidates(order: np.ndarray, codes: np.ndarray, w: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Boolean matrix (queries, rows): the union over the trees of each query's range at its depth.
    ``codes`` are the trees' sorted strings and ``order`` the rows they belong to, a tree a column."""
    mask = np.zeros((len(w), len(order)), bool)
    for t in range(TREES):
        lo, hi = bounds(codes[:, t], w[:, t], d)
        for i in np.flatnonzero(hi > lo):
            mask[i, order[lo[i] : hi[i], t]] = True
    return mask


def search(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found by inner product.

    ``rows`` and ``queries`` are (vec_id, embedding); a query's own row is no candidate. Vectors are
    set on a sphere (by a coordinate that fills their norm up to the largest), so that angles order
    as inner products do. Every class of equal vectors has a hash string in each of ``TREES``
    trees. The index is cut into blocks of ``ROWS`` by the first tree's prefix (and by hash where one
    prefix has more), and each block holds all trees' sorted arrays of its own rows. A query starts
    at its longest prefix matches and ascends all trees of all blocks together, one bit a step,
    until the arrays hold as many matches as asked; how many is set by ``PROBES`` queries compared with
    all rows, to reach ``RECALL``. Then it goes to the blocks that hold a match, where its ranges are
    united, and every vector in them is scored once: never more products than rows, and few where
    vectors lie in groups. Vectors without structure share so few bits with their nearest that
    the ranges hold most rows. A query that finds fewer than k is compared with all rows. Strings of
    the stated queries meet all blocks, ``ASKED`` queries and one block a task.

    Defined results: invalid vectors (null, zero, null or non-finite components, an odd length) take
    no part; equal scores go by smaller vec_id; equal vectors are all candidates. Rows equal in id and
    vector count once, as query and as candidate. An id with several vectors is a candidate by each of
    them, and each that is asked gets ranks of its own; a query's own is its id with its vector. Other
    columns are ignored.
    """
    members, own, dim = classes(rows)
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = own.count()
    if n < 2 and members.limit(2).count() < 2:
        return empty
    top = own.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    p = planes(dim + 1)

    def lifted(v: np.ndarray) -> np.ndarray:
        v = v / top
        return np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1, keepdims=True)))])

    def flat(v: np.ndarray) -> np.ndarray:
        return np.hstack([v / np.linalg.norm(v / top, axis=1, keepdims=True) / top, np.zeros((len(v), 1))])

    def code(make):
        def run(parts):
            for b in parts:
                for s in range(0, b.num_rows, 1024):
                    x = b.slice(s, 1024)
                    h = strings(make(matrix(x.column(1), dim)), p)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(h.ravel()), TREES).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), lists], ["rep", "v", "h"])

        return run

    shape = "rep long, v array<double>, h array<long>"
    index = keep(own.select("rep", "v").mapInArrow(code(lifted), shape), "index")
    same = [F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("_v")]
    wanted = own.join(queries.select(*same), F.col("v") == F.col("_v")).select("query_id", "rep") if repeated(members) else None
    asked = queries.select(same[0]).distinct().join(members, F.col("query_id") == F.col("vec_id")).select("query_id", "rep")
    asked = keep((asked if wanted is None else wanted).distinct(), "asked")
    q = own.select("rep", "v").join(small_side(asked.select("rep").distinct()), "rep", "left_semi")
    q = keep(q.mapInArrow(code(flat), shape), "queries")

    depth, probes = _depth(index, q, dim, n, k)
    head = max(0, -(-n // ROWS) - 1).bit_length()
    prefix = F.shiftright(F.element_at("h", 1), BITS - head) if head else F.lit(0).cast("long")
    sizes = keep(index.groupBy(prefix.alias("prefix")).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("pieces")), "sizes")
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of some n / ROWS prefixes
    first = keep(sizes.withColumn("first", F.coalesce(F.sum("pieces").over(before), F.lit(0))), "first")
    blocks = first.agg(F.sum("pieces")).first()[0]
    chunks = max(1, -(-q.count() // ASKED))
    index = index.withColumn("prefix", prefix).join(small_side(first), "prefix")
    index = index.withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("pieces"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    q = q.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("int"))
    by = ["block", "chunk"]

    def tally(left, right):
        c = tallies(matrix(left.column("h"), TREES), matrix(right.column("h"), TREES)) if right.num_rows else np.zeros((0, BITS + 1), np.int64)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), BITS + 1).cast(pa.list_(pa.int64()))
        return pa.table({"rep": right.column("rep"), "block": right.column("block"), "c": lists})

    every = q.select("rep", "h", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    seen = index.select("h", *by).groupBy(*by).cogroup(every.groupBy(*by)).applyInArrow(tally, "rep long, block long, c array<long>")
    seen = keep(seen, "tally")
    total = keep(seen.groupBy("rep").agg(F.array(*[F.sum(F.element_at("c", i + 1)) for i in range(BITS + 1)]).alias("c")), "total")
    held = total.where(F.col("rep").isin(probes)).agg(F.avg(F.element_at("c", depth + 1))).first()[0] or 0.0
    level = F.size(F.filter("c", lambda x: x >= F.lit(held)))  # counts fall with depth
    stop = keep(total.select("rep", F.greatest(F.lit(0), level - 1).cast("int").alias("depth")), "depths")

    def best(left, right):
        cols: list[list] = [[np.zeros(0, t)] for t in (np.int64, np.int64, float)]
        if left.num_rows and right.num_rows:
            h, rep, v = matrix(left.column("h"), TREES), left.column("rep").to_numpy(), matrix(left.column("v"), dim)
            order = np.argsort(h, axis=0, kind="stable")
            codes = np.take_along_axis(h, order, 0)
            ask, d, w, name = matrix(right.column("h"), TREES), right.column("depth").to_numpy(), matrix(right.column("v"), dim), right.column("rep").to_numpy()
            for s in range(0, len(w), BLOCK):
                mask = candidates(order, codes, ask[s : s + BLOCK], d[s : s + BLOCK])
                score = np.where(mask, w[s : s + BLOCK] @ v.T, -np.inf) if mask.mean() > DENSE else None
                for i, own_ in enumerate(mask, s):
                    at = np.flatnonzero(own_)
                    near = score[i - s, at] if score is not None else v[at] @ w[i]
                    at = at[_top(near[None], rep[at], k + 1)[0]]
                    cols[0].append(np.full(len(at), name[i]))
                    cols[1].append(rep[at])
                    cols[2].append(np.einsum("nd,d->n", v[at], w[i]))
        c = [np.concatenate(x) for x in cols]
        return pa.table({"query": pa.array(c[0], pa.int64()), "rep": pa.array(c[1], pa.int64()), "score": pa.array(c[2], pa.float64())})

    todo = seen.join(small_side(stop), "rep").where(F.element_at("c", F.col("depth") + 1) > 0).select("rep", "block", "depth")
    found = index.select("rep", "v", "h", *by).groupBy(*by).cogroup(q.join(todo, "rep").groupBy(*by)).applyInArrow(best, "query long, rep long, score double")
    found = keep(found, "found")
    few = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(f"n <= {min(k, n - 1)}").select(F.col("query").alias("rep"))
    some = keep(few.union(q.select("rep").join(found.select(F.col("query").alias("rep")).distinct(), "rep", "left_anti")), "few")
    if n > 1 and some.limit(1).count():
        found = found.union(_against_all(index.where("chunk = 0"), q.join(some, "rep", "left_semi"), dim, k + 1)).groupBy("query", "rep").agg(F.max("score").alias("score"))
    near = found.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(f"_r <= {k + 1}").drop("_r")
    return _expand(near, members, asked, k)


def _top(score: np.ndarray, rep: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each row, the places of the k largest finite scores; equal ones by smaller rep."""
    out = []
    for row in score:
        if len(row) > k:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            a = np.flatnonzero((row >= edge) & (row > -np.inf))
        else:
            a = np.flatnonzero(row > -np.inf)
        out.append(a[np.lexsort((rep[a], -row[a]))][:k])
    return out


def _against_all(index: DataFrame, q: DataFrame, dim: int, k: int) -> DataFrame:
    """The k nearest among all rows, of query vectors taken in blocks: each block meets each piece
    of the rows once."""
    pieces = max(1, -(-index.count() // 20_000))
    blocks = max(1, -(-q.count() // 2_000))
    left = index.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(pieces)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    right = q.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("i"))

    def run(a, b):
        rep, v, w, name = a.column("rep").to_numpy(), matrix(a.column("v"), dim), matrix(b.column("v"), dim), b.column("rep").to_numpy()
        cols: list[list] = [[], [], []]
        for s in range(0, len(w), BLOCK):
            score = w[s : s + BLOCK] @ v.T
            for i, t in enumerate(_top(score, rep, k)):
                cols[0] += [name[s + i]] * len(t)
                cols[1] += rep[t].tolist()
                cols[2] += score[i][t].tolist()
        return pa.table({"query": pa.array(cols[0], pa.int64()), "rep": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "query long, rep long, score double")


def _depth(index: DataFrame, q: DataFrame, dim: int, n: int, k: int) -> tuple[int, list[int]]:
    """The deepest level at which any tree still has ``RECALL`` of the probes' true neighbours."""
    probe = q.orderBy(F.xxhash64("rep")).limit(PROBES)
    rows = probe.toArrow()
    names, w, h = rows.column(0).to_numpy(), matrix(rows.column(1), dim), matrix(rows.column(2), TREES)
    if not len(names):
        return 0, []

    def run(parts):
        for b in parts:
            if b.num_rows:
                rep, v, code = b.column(0).to_numpy(), matrix(b.column(1), dim), matrix(b.column(2), TREES)
                score = w @ v.T
                score[names[:, None] == rep[None]] = -np.inf
                for i, t in enumerate(_top(score, rep, k)):
                    deep = _lcp(code[t], h[i][None]).max(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), names[i])), pa.array(score[i][t]), pa.array(deep.astype(np.int64))], ["rep", "score", "deep"])

    got = index.select("rep", "v", "h").mapInArrow(run, "rep long, score double, deep long")
    best = got.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score")))).where(f"r <= {k}")
    deep = np.array([r["deep"] for r in best.select("deep").collect()])  # PROBES * k numbers
    depth = 0
    while depth < BITS and len(deep) and (deep >= depth + 1).mean() >= RECALL:
        depth += 1
    return depth, [int(x) for x in names]


def repeated(members: DataFrame) -> bool:
    """Whether an id has several vectors."""
    return bool(members.distinct().groupBy("vec_id").count().where("count > 1").limit(1).count())


def _expand(near: DataFrame, members: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Classes as their vectors, of which k + 1 a class are enough; then the k nearest."""
    slot = Window.partitionBy("rep", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    first = members.distinct().withColumn("_r", F.row_number().over(slot)).where(f"_r <= {k + 1}").drop("_r")
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(f"_r <= {k + 1}").drop("_r")
    rows = near.join(asked.select("query_id", F.col("rep").alias("query")), "query").join(first, "rep").where("rep <> query OR vec_id <> query_id")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_prefix_forest(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))
