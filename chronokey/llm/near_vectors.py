"""Operator 5: near-duplicate embeddings by a robust-pruned flat graph."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keep, release, small_side, table
from .vectors import VALID, classes, matrix

#: Rows that fit the clusters, rows aimed at in a shard, most clusters.
SAMPLE, SHARD, CLUSTERS = 20_000, 1500, 4096
#: Neighbours looked at and kept by the pruning, its slack, and the beam of the search.
LOOK, DEGREE, ALPHA, BEAM = 40, 24, 1.2, 24
#: Shards beyond so many own rows are compared exactly, block by block; so are guests with own rows.
LARGE, BLOCK = 8192, 4096
#: Room for rounding in the bounds that say where a guest can have a pair.
SLACK = 1e-6
AUDIT = 200
#: Rows with vectors that are shuffled at once, if the table has fewer; else as many as it has.
ROUND = 200_000
#: Rows aimed at in a bucket of a hashed table; the probability that a pair at the limit meets in
#: none, the pairs that each table's is measured on, and most tables.
BUCKET, MISS, TRIED, TABLES = 3000, 1e-6, 20_000, 200


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; centres nearer than a cosine of 0.8 are merged, so that no tight group
    of vectors is torn among several."""
    r = np.random.default_rng(3)
    c = sample[r.permutation(len(sample))[:k]]
    for _ in range(8):
        of = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, of, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < 0.8:
            kept.append(i)
    return c[kept]


def robust_graph(v: np.ndarray) -> np.ndarray:
    """Adjacency lists, padded with the node itself: of each node's nearest, those that no nearer
    kept one covers by the factor ALPHA, and the edges back to it."""
    n = len(v)
    look = min(LOOK, n - 1)
    keep_ = np.full((n, DEGREE), -1)
    for s in range(0, n, 256):
        sim = v[s : s + 256] @ v.T
        rows = np.arange(len(sim))
        sim[rows, rows + s] = -9
        near = np.argpartition(-sim, look - 1, axis=1)[:, :look]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1), 1)
        far = 2 - 2 * np.take_along_axis(sim, near, 1)
        w = v[near]
        mutual = 2 - 2 * np.einsum("ncd,nkd->nck", w, w)
        alive, used = np.ones(near.shape, bool), np.zeros(len(sim), int)
        for j in range(look):
            take = alive[:, j] & (used < DEGREE)
            keep_[s + rows[take], used[take]] = near[take, j]
            used[take] += 1
            covered = ALPHA**2 * mutual[:, j] <= far
            covered[:, : j + 1] = False
            alive &= ~(covered & take[:, None])
    src = np.repeat(np.arange(n), DEGREE)[keep_.ravel() >= 0]
    dst = keep_.ravel()[keep_.ravel() >= 0]
    order = np.argsort(dst, kind="stable")
    dst, src = dst[order], src[order]
    first = np.searchsorted(dst, np.arange(n))
    place = np.arange(len(dst)) - first[dst]
    back = np.full((n, DEGREE), -1)
    back[dst[place < DEGREE], place[place < DEGREE]] = src[place < DEGREE]
    both = np.hstack([keep_, back])
    return np.where(both < 0, np.arange(n)[:, None], both)


def range_search(v: np.ndarray, graph: np.ndarray, near: float) -> np.ndarray:
    """Boolean matrix of the pairs found within ``near``: a greedy beam from the medoid and the
    query's own edges, which goes on while it finds nodes in range; a query whose range fills
    the beam is compared with the whole shard."""
    n = len(v)
    medoid = int((v @ v.mean(0)).argmax())
    found = np.zeros((n, n), bool)
    beam = min(BEAM, n)
    for s in range(0, n, 512):
        q = v[s : s + 512]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        start = np.hstack([np.full((len(q), 1), medoid), graph[s : s + 512]])
        ids, sims, done = np.full((len(q), beam), -1), np.full((len(q), beam), -9.0), np.ones((len(q), beam), bool)
        cand = start
        live = rows
        for _ in range(n):
            new = ~seen[live[:, None], cand]
            x = np.sort(np.where(new, cand, n), axis=1)  # equal candidates of a row count once
            new = (x < n) & np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], 1)
            cand = np.where(new, x, 0)
            sim = np.where(new, np.einsum("qd,qcd->qc", q[live], v[cand]), -9.0)
            r, c = np.nonzero(new)
            seen[live[r], cand[r, c]] = True
            hit = sim >= near
            hr, hc = np.nonzero(hit)
            found[s + live[hr], cand[hr, hc]] = True
            all_ids = np.hstack([ids[live], np.where(new, cand, -1)])
            all_sims = np.hstack([sims[live], sim])
            all_done = np.hstack([done[live], ~new])
            top = np.argsort(-all_sims, axis=1)[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
            open_ = ~done[live]
            best = open_.argmax(1)
            go = open_.any(1)
            live, best = live[go], best[go]
            if not len(live):
                break
            done[live, best] = True
            cand = graph[ids[live, best]]
        dense = rows[found[s + rows].sum(1) >= beam - 1]
        if len(dense):
            found[s + dense] = q[dense] @ v.T >= near
    found |= found.T
    np.fill_diagonal(found, False)
    # what the search found is verified pair by pair
    x, y = np.nonzero(found)
    for s in range(0, len(x), 1 << 16):
        bad = np.einsum("nd,nd->n", v[x[s : s + (1 << 16)]], v[y[s : s + (1 << 16)]]) < near
        found[x[s : s + (1 << 16)][bad], y[s : s + (1 << 16)][bad]] = False
    return found


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches by the edges x - y."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def guest_of(v: np.ndarray, home: np.ndarray, c: np.ndarray, reach: np.ndarray, near: float) -> np.ndarray:
    """Boolean matrix (vectors, centres): whether the shard of a centre before the vector's home may
    hold a vector within ``near``. Exact: a home is the nearest centre, so a vector w at home in k has
    (c[home] - c[k]) . w <= 0, and one at distance d or less of it has at most d * |c[home] - c[k]|;
    and w lies within the largest angle of its shard, whose sum with that of ``near`` is ``reach``.
    """
    s = v @ c.T
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))
    own = s[np.arange(len(v)), home][:, None]
    inside = s >= np.cos(np.minimum(np.pi, reach))[None] - SLACK
    return inside & (own - s <= np.sqrt(max(0.0, 2 - 2 * near)) * apart + SLACK) & (np.arange(len(c))[None] < home[:, None])


def bucket(v: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bucket of each vector in a table: which of its directions, or their opposites, is the
    nearest, for each of the table's hashes (hash, dimension, direction)."""
    out = np.zeros(len(v), np.int64)
    for w in hashes:
        s = v @ w
        at = np.abs(s).argmax(1)
        out = out * (2 * w.shape[1]) + 2 * at + (s[np.arange(len(v)), at] > 0)
    return out


def hashed_tables(dim: int, k: int, near: float) -> list[np.ndarray] | None:
    """Tables of about ``k`` buckets, so many that a pair with a cosine of ``near`` meets in none with a
    probability of at most ``MISS``: the product of the shares of random pairs that each table parts.
    None if ``TABLES`` are too few. Directions are random and each table has its own, so this holds
    for a pair whatever the other vectors are, and nearer pairs meet more often."""
    r = np.random.default_rng(5)
    tried = min(TRIED, max(1000, (1 << 22) // dim))
    x, y = r.normal(size=(2, tried, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= x * (x * y).sum(1)[:, None]
    y = near * x + math.sqrt(max(0.0, 1 - near**2)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30)
    hashes = max(1, math.ceil(math.log(max(k, 2)) / math.log(128)))
    width = max(1, math.ceil(k ** (1 / hashes) / 2))
    out: list[np.ndarray] = []
    missed = 1.0
    while missed > MISS:
        if len(out) == TABLES:
            return None
        out.append(np.stack([np.hstack([np.linalg.qr(r.normal(size=(dim, dim)))[0] for _ in range(-(-width // dim))])[:, :width] for _ in range(hashes)]))
        missed *= (bucket(x, out[-1]) != bucket(y, out[-1])).mean()
    return out


def dense(v: np.ndarray, near: float, first: np.ndarray | None = None):
    """Index pairs of rows within ``near``, a few rows at a time: all, or those of one row in ``first`` and one not."""
    a, b = (np.arange(len(v)),) * 2 if first is None else (np.flatnonzero(first), np.flatnonzero(~first))
    for s in range(0, len(a), 512):
        if first is None:
            x, y = np.nonzero(np.triu(v[s : s + 512] @ v[s:].T >= near, 1))
            yield x + s, y + s
        else:
            x, y = np.nonzero(v[a[s : s + 512]] @ v[b].T >= near)
            yield a[s + x], b[y]


def near_duplicates(rows: DataFrame, near: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row of (vec_id, embedding).

    Clusters come from a bounded sample (``SAMPLE`` vectors); each class of equal vectors is at home
    in the shard of its nearest centre. Every shard builds a pruned graph of its own vectors and
    searches it for each of them; one of more than ``LARGE``, where very many vectors lie together, is
    compared exactly in blocks. Pairs of different homes are found in one of two ways. Where vectors
    have clusters, a vector is a guest in every earlier shard that can hold a vector in range by
    ``guest_of``, and is compared exactly there; a pair counts in the earlier home of its two. Where
    they have none, guests would be nearly everywhere; so if they are more than the rows (and than
    ``ROUND``), vectors meet in the buckets of ``hashed_tables`` instead, are compared exactly in each, and
    a pair counts in the first table that it meets in. A pair is then lost with a probability of
    about ``MISS`` at the limit, and of less the nearer it is.

    Vectors are shuffled in rounds of as many rows as there are (or ``ROUND``), whose files are deleted
    before the next, so that disk stays in proportion to the input.

    audit_recall is the share of links found of ``AUDIT`` vectors compared with all. Where one of those
    is missed, shards are compared exactly instead of by their graphs, and if one is missed still,
    all pairs are.

    Defined results: invalid vectors (null, zero, null or non-finite components, an odd length)
    have no links and are their own component; so is a null id, which is kept null. Every row
    counts by itself: rows with equal vectors link with each other, whether their ids are equal or
    not, and rows with equal id and different vectors have each their own links and component (both
    are kept if both components start with that id). Other columns are ignored.
    """
    members, own, dim = classes(rows, lean=True)
    n = own.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audit_recall"))
    kind = own.schema["v"].dataType.simpleString()
    sample = own.select("v", "rep").orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow()
    c = centres(unit(matrix(sample.column(0), dim)), min(CLUSTERS, -(-n // SHARD), len(sample)))

    def place(parts):
        for p in parts:
            for a in range(0, p.num_rows, 1024):
                q = p.slice(a, 1024)
                s = unit(matrix(q.column(3), dim)) @ c.T
                yield pa.RecordBatch.from_arrays([*q.columns, pa.array(s.argmax(1), pa.int32()), pa.array(s.max(1))], ["rep", "low", "copies", "v", "home", "sim"])

    homes = keep(own.select("rep", "low", "copies", "v").mapInArrow(place, f"rep long, low long, copies long, v {kind}, home int, sim double"), "homes")
    release(own)
    reach = np.zeros(len(c))
    size = np.zeros(len(c), np.int64)
    for r in homes.groupBy("home").agg(F.min("sim").alias("sim"), F.count(F.lit(1)).alias("n")).collect():  # at most CLUSTERS rows
        reach[r["home"]], size[r["home"]] = np.arccos(np.clip(r["sim"], -1, 1)) + np.arccos(np.clip(near, -1, 1)) + SLACK, r["n"]
    used = size > 0
    room = max(n, ROUND)
    placed = homes.select("rep", "copies", "v", "home")

    def guests(q):
        return guest_of(unit(matrix(q.column(2), dim)), q.column(3).to_numpy(), c, reach, near) & used[None]

    def tally(parts):
        many = np.zeros(len(c), np.int64)
        for p in parts:
            for a in range(0, p.num_rows, 1024):
                many += guests(p.slice(a, 1024)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(many), pa.int32()), pa.array(many[many > 0])], ["shard", "n"])

    def invite(parts):
        for p in parts:
            for a in range(0, p.num_rows, 1024):
                q = p.slice(a, 1024)
                at, shard = np.nonzero(guests(q))
                for x in range(0, len(at), 4096):
                    yield pa.RecordBatch.from_arrays([*[q.column(k).take(pa.array(at[x : x + 4096])) for k in range(4)], pa.array(shard[x : x + 4096], pa.int32())], ["rep", "copies", "v", "home", "part"])

    many = {r["shard"]: r["n"] for r in placed.mapInArrow(tally, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # at most CLUSTERS rows
    clustered = sum(many.values()) <= room
    tables = [] if clustered else hashed_tables(dim, -(-n // BUCKET), near)

    def compared(todo: DataFrame, total: int, exact: bool, hashed: bool = False) -> DataFrame:
        """Links counted in each group of (t, part, i, j), and the lowest vector that each one reaches;
        ``total`` rows, in rounds."""

        def group(key, p):
            t, _, i, j = (k.as_py() for k in key)
            v = unit(matrix(p.column("v"), dim))
            rep, copies, home, block = (p.column(x).to_numpy() for x in ("rep", "copies", "home", "block"))
            order = np.argsort(rep)
            v, rep, copies, home, block = v[order], rep[order], copies[order], home[order], block[order]
            if i != j or exact or hashed or p.column("blocks")[0].as_py() > 1:
                found = dense(v, near, block == i if i != j else None)
            else:
                found = [np.nonzero(np.triu(range_search(v, robust_graph(v), near), 1))] if len(v) > 1 else []
            links, low = np.zeros(len(v)), [np.zeros((2, 0), np.int64)]
            for x, y in found:
                if hashed:
                    x, y = unmet(v, home, x, y, tables[:t])
                if len(x):
                    links += np.bincount(x, copies[y], len(v)) + np.bincount(y, copies[x], len(v))
                    root = _roots(len(v), x, y)
                    low.append(np.stack([at := np.flatnonzero(root != np.arange(len(v))), root[at]]))
            root, some = _roots(len(v), *np.hstack(low)), links > 0
            return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[root][some]})

        rounds, out = max(1, -(-total // room)), []
        for r in range(rounds):
            turn = todo if rounds == 1 else todo.where(F.pmod(F.xxhash64("t", "part", "i", "j"), F.lit(rounds)) == r)
            out.append(keep(turn.groupBy("t", "part", "i", "j").applyInArrow(group, "rep long, links long, root long"), "found"))
            out = _one(out) if len(out) == 32 else out
        return _one(out)[0]

    def in_blocks(dealt: DataFrame) -> DataFrame:
        """``dealt`` (with t, part, own, blocks, more) once for each pair of blocks it is in: own rows are blocks 0 to
        blocks - 1, guests the ``more`` after them; guests don't meet each other."""
        block = F.when(F.col("own"), F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(F.col("blocks") + F.pmod(F.xxhash64("rep"), F.col("more"))).cast("int")
        last = F.col("blocks") - 1 + F.when(F.col("own"), F.col("more")).otherwise(0)
        dealt = dealt.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
        return dealt.select("rep", "copies", "v", "home", "t", "part", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "blocks")

    def in_shards(exact: bool) -> DataFrame:
        dealt = placed.withColumn("part", F.col("home")).withColumn("own", F.lit(True))
        cut = [(k, int(-(-n_ // BLOCK)) if n_ > LARGE else 1, -(-many.get(k, 0) // BLOCK) if clustered else 0) for k, n_ in enumerate(size.tolist()) if n_]
        if clustered:
            dealt = dealt.union(placed.mapInArrow(invite, f"rep long, copies long, v {kind}, home int, part int").withColumn("own", F.lit(False)))
        dealt = dealt.withColumn("t", F.lit(0)).join(F.broadcast(rows.sparkSession.createDataFrame(cut, "part int, blocks int, more int")), "part")
        return compared(in_blocks(dealt), sum(int(size[k]) * (b + m) + (many.get(k, 0) * b if clustered else 0) for k, b, m in cut), exact)

    def in_tables() -> list[DataFrame]:
        def count(parts):
            total = {}
            for p in parts:
                v = unit(matrix(p.column(2), dim)) if p.num_rows else np.zeros((0, dim))
                for t, w in enumerate(tables):
                    for b, k in zip(*np.unique(bucket(v, w), return_counts=True), strict=True):
                        total[t, b] = total.get((t, b), 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in total], pa.int32()), pa.array([x[1] for x in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["t", "part", "n"])

        full = placed.mapInArrow(count, "t int, part long, n long").groupBy("t", "part").agg(F.sum("n").alias("n")).where(F.col("n") > LARGE)
        full = keep(full.select("t", "part", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "full")
        more = {r["t"]: r["rows"] for r in full.groupBy("t").agg(F.sum(F.col("n") * (F.col("blocks") - 1)).alias("rows")).collect()}  # a row a table
        at_once = max(1, room // n)

        def dealt(some):
            def hash_(parts):
                for p in parts:
                    for a in range(0, p.num_rows, 1024):
                        q = p.slice(a, 1024)
                        v = unit(matrix(q.column(2), dim))
                        for t in some:
                            yield pa.RecordBatch.from_arrays([*q.columns, pa.array(np.full(len(v), t), pa.int32()), pa.array(bucket(v, tables[t]))], ["rep", "copies", "v", "home", "t", "part"])

            return placed.mapInArrow(hash_, f"rep long, copies long, v {kind}, home int, t int, part long")

        out = []
        for a in range(0, len(tables), at_once):
            some = range(a, min(a + at_once, len(tables)))
            extra = sum(more.get(t, 0) for t in some)
            todo = dealt(some).withColumn("own", F.lit(True)).withColumn("more", F.lit(0))
            todo = todo.join(small_side(full.drop("n")), ["t", "part"], "left").fillna(1, ["blocks"]) if extra else todo.withColumn("blocks", F.lit(1))
            out.append(compared(in_blocks(todo), n * len(some) + extra, True, True))
        release(full)
        return out

    def everywhere() -> DataFrame:
        blocks = -(-n // BLOCK)
        dealt = placed.select("*", F.lit(0).alias("t"), F.lit(0).alias("part"), F.lit(True).alias("own"), F.lit(blocks).alias("blocks"), F.lit(0).alias("more"))
        return compared(in_blocks(dealt), n * blocks, True)

    apart = in_tables() if tables else []
    for way in ("graphs", "shards", "all") if tables is not None else ("all",):
        found = functools.reduce(DataFrame.union, [everywhere()] if way == "all" else [in_shards(way == "shards"), *apart])
        links = homes.select("rep", "low", "copies").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        links = keep(links.select("rep", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "links")
        recall = _audit(homes, links, dim, near)
        if recall == 1:
            break
    release(homes)
    comps = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    got = keep(links.join(comps, links.rep == comps.node, "left").select("rep", "low", "n_links", F.coalesce("component", "rep").alias("component")), "of")
    lows = got.groupBy("component").agg(F.min("low").alias("component_id"))
    named = members.join(got.join(lows, "component"), "rep").select("vec_id", "n_links", "component_id")
    invalid = rows.where(~F.coalesce(F.expr(f"vec_id IS NOT NULL AND size(embedding) = {dim} AND {VALID}"), F.lit(False)))
    out = named.union(invalid.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), (F.col("vec_id") + F.lit(0)).cast("long").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("audit_recall", F.lit(recall))


def unmet(v: np.ndarray, home: np.ndarray, x: np.ndarray, y: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs x - y those with different homes that share no bucket of ``tables``."""
    of = home
    for w in [None, *tables]:
        if w is not None:
            some = np.zeros(len(v), bool)
            some[x] = some[y] = True
            of = np.full(len(v), -1)
            of[some] = bucket(v[some], w)
        x, y = x[of[x] != of[y]], y[of[x] != of[y]]
        if not len(x):
            break
    return x, y


def _one(kept: list[DataFrame]) -> list[DataFrame]:
    """Kept tables as a single one."""
    if len(kept) == 1:
        return kept
    whole = keep(functools.reduce(DataFrame.union, kept), "found")
    release(*kept)
    return [whole]


def _audit(own: DataFrame, links: DataFrame, dim: int, near: float) -> float:
    """Links found / links there, of a bounded sample of classes compared with all classes."""
    some = own.select("rep", "v", "copies").orderBy(F.xxhash64(F.col("rep"), F.lit(1))).limit(AUDIT).toArrow()
    rep, q, copies = some.column(0).to_numpy(), unit(matrix(some.column(1), dim)), some.column(2).to_numpy()

    def count(parts):
        total = np.zeros(len(rep), np.int64)
        for p in parts:
            if p.num_rows:
                hit = q @ unit(matrix(p.column(1), dim)).T >= near
                hit &= rep[:, None] != p.column(0).to_numpy()[None]
                total += hit @ p.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(total)], ["rep", "n"])

    there = own.select("rep", "v", "copies").mapInArrow(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    rows = there.join(small_side(links), "rep").select("rep", "n", "n_links").collect()  # AUDIT rows
    extra = dict(zip(rep, copies - 1, strict=True))
    true = sum(r["n"] for r in rows)
    return min(1.0, sum(min(r["n"], r["n_links"] - int(extra[r["rep"]])) for r in rows) / true) if true else 1.0


def op5_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
