"""Operator 3: n-gram Jaccard join by parity sketches."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, free_name, keep, release, small_side, table
from .words import U, batches, hashes, spans
from .words import mix as _mix

#: Bits of the sketch that screens pairs of one bucket, and rows of a bucket compared at once.
SKETCH, CHUNK = 1024, 2048
#: Pairs are verified in so many slices at most, one for each so many shingles of their ends.
SLICES, SLICE = 6, 2_000_000


#: Odd multipliers of the words of a shingle, by place.
_PLACE = np.random.default_rng(5).integers(1, 1 << 62, 64, dtype=np.int64).astype(U) * U(2) + U(1)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams.

    Lower-cases A-Z and takes words between white space (space, tab to CR). With fewer than n
    words the whole sequence is the one shingle; without words there is none.
    """
    data, starts, ends, first = spans(texts)
    h = hashes(data, starts, ends)
    whole = np.zeros(max(0, len(h) - n + 1), U)
    for i in range(n if len(whole) else 0):
        whole += h[i : len(h) - n + 1 + i] * _PLACE[i]
    whole = _mix(whole)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            x = np.sort(whole[a : b - n + 1])
            new = np.empty(len(x), bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out.append(x[new])
        elif b > a:
            out.append(_mix(np.sum(h[a:b] * _PLACE[: b - a], dtype=U, keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


class Blocks:
    """The pigeonhole scheme for one threshold num / den.

    Flipping one bit of a wide sketch for each element makes the Hamming distance of two sketches
    a lower bound of the symmetric difference D of their sets. Sets linked at t = num / den have
    D <= (1 - t) / (1 + t) * (a + b), so that, with the sketch cut into more blocks than that, they
    agree in a block. Sizes fall into bands; a set takes part in its own band, and in the next
    one if a partner can be there, with that band's blocks. A block's bits are kept as the XOR of
    its elements' 64-bit hashes, which is a digest of exactly those parities. Blocks without
    elements say little: a set leaves them out if it has fewer than must agree with any partner,
    and bands have a few blocks more so that nearly all sets do.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        #: Sizes of one band differ by this ratio at most.
        self.ratio = (den / num) ** 3.2 if num < den else 2.0
        self.cache: dict[int, tuple[int, int, int]] = {}

    def distance(self, a: int, b: int) -> int:
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def band(self, size: int) -> int:
        i = int(math.log(size) / math.log(self.ratio))
        while self.start(i + 1) <= size:
            i += 1
        while self.start(i) > size:
            i -= 1
        return i

    def start(self, i: int) -> int:
        return math.ceil(self.ratio**i)

    def of(self, i: int) -> tuple[int, int, int]:
        """(blocks, smallest size that takes part, largest) of band i."""
        if i not in self.cache:
            high = self.start(i + 1) - 1
            most = self.distance(high, high)
            empty = (most + 1) * math.exp(-high / (most + 1))
            spare = math.ceil(empty + 3 * math.sqrt(empty) + 1) if most else 0
            self.cache[i] = (most + 1 + spare, -(-self.start(i) * self.num // self.den), high)
        return self.cache[i]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Join keys of a set of sorted hashes: two linked sets have one in common. The lowest bit of
        a key is that of its band."""
        out = []
        for i, which, digest, _ in self._bands(s):
            out.append(_mix(digest + which * U(0xD6E8FEB86659FD93) + U((i + 1) * 0xCA5A826395121157 & 0xFFFFFFFFFFFFFFFF)) & ~U(1) | U(i & 1))
        return np.concatenate(out)

    def spare(self, s: np.ndarray) -> tuple[int, int]:
        """By lowest bit of a key: how many keys a set has in common with any linked one, less one. So
        many of its keys it can leave out, if all sets leave out those that come first in one order:
        of the keys that two linked sets share, the last one is among neither's."""
        out = [0, 0]
        for i, _, _, free in self._bands(s):
            out[i & 1] = free
        return out[0], out[1]

    def _bands(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        own = self.band(len(s))
        for i in (own, own + 1):
            k, low, high = self.of(i)
            if i > own and len(s) < low:
                continue
            block = ((s >> U(32)) * U(k)) >> U(32)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            digest = np.bitwise_xor.reduceat(_mix(s ^ U(0xA5A5A5A5DEADBEEF)), first)
            which = block[first]
            # blocks that must agree with any partner, less one
            sure = k - 1 - self.distance(len(s), min(high, len(s) * self.den // self.num))
            free = sure - (k - len(first))
            if free < 0:
                empty = np.setdiff1d(np.arange(k, dtype=U), which)
                which, digest, free = np.concatenate([which, empty]), np.concatenate([digest, np.zeros(len(empty), U)]), sure
            yield i, which, digest, free


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, U)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _each(docs: DataFrame, n: int, shape: str, make) -> DataFrame:
    """What ``make`` gives for (ids, fingerprints of sets, sets) of some rows at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (p.slice(a, 1024) for p in parts for a in range(0, p.num_rows, 1024)):
            texts = whole.column(1).to_pylist()
            for x, y in batches(texts):
                sets = shingle_sets(texts[x:y], n)
                fp = np.array([int(np.add.reduce(_mix(s + U(0x1234567)), dtype=U)) ^ len(s) for s in sets], U).view(np.int64)
                yield pa.RecordBatch.from_pydict(make(whole.column(0).slice(x, y - x), fp, sets))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)


def _profiles(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, fp, n) of each row; fp is a hash of the set, n its size."""
    return _each(docs, n, "doc_id long, fp long, n long", lambda ids, fp, sets: {"doc_id": ids, "fp": pa.array(fp), "n": pa.array([len(s) for s in sets], pa.int64())})


def _keys(docs: DataFrame, n: int, blocks: Blocks) -> DataFrame:
    """(key, fp) for each join key of each row."""

    def make(ids, fp, sets):
        keys = [blocks.keys(s) if len(s) else s for s in sets]
        return {"key": pa.array(np.concatenate(keys).view(np.int64)), "fp": pa.array(np.repeat(fp, [len(k) for k in keys]))}

    return _each(docs, n, "key long, fp long", make)


def _sketches(docs: DataFrame, n: int, blocks: Blocks) -> DataFrame:
    """(fp, n, free, sketch) of each row; the sketch has the parities of SKETCH bits, free the keys
    that may be left out (``Blocks.spare``)."""

    def make(ids, fp, sets):
        bits = [np.packbits((np.bincount((s & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes() for s in sets]
        free = [list(blocks.spare(s)) if len(s) else [0, 0] for s in sets]
        return {"fp": pa.array(fp), "n": pa.array([len(s) for s in sets], pa.int64()), "free": pa.array(free, pa.list_(pa.int32())), "sketch": pa.array(bits, pa.binary())}

    return _each(docs, n, "fp long, n long, free array<int>, sketch binary", make)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(fp, n, shingles) of each row."""
    return _each(docs, n, "fp long, n long, shingles array<long>", lambda ids, fp, sets: {"fp": pa.array(fp), "n": pa.array([len(s) for s in sets], pa.int64()), "shingles": _lists(sets)})


def _texts_of(docs: DataFrame, first: DataFrame, fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that hold the texts of ``fps`` (a kept table of fp), one row a text but for
    repeated ids, and the kept table behind it."""
    ids = keep(first.join(small_side(fps), "fp", "left_semi").select(F.col("doc_id").alias("_id")).distinct(), "wanted")
    return docs.select("doc_id", "text").join(small_side(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), ids


def _screened(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that sizes and sketches don't part. As the sketches' distance bounds the
    symmetric difference from below, no link is lost, and sets travel for these pairs only."""
    a = sets.select(F.col("fp").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("ku"))
    b = sets.select(F.col("fp").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("kv"))
    both = pairs.join(a, "u").join(b, "v").where(f"least(nu, nv) * {den} >= greatest(nu, nv) * {num}")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            if p.num_rows:
                x, y = (np.frombuffer(b"".join(p.column(k).to_pylist()), U).reshape(p.num_rows, -1) for k in ("ku", "kv"))
                size = p.column("nu").to_numpy() + p.column("nv").to_numpy()
                near = np.bitwise_count(x ^ y).sum(1) <= (den - num) * size // (den + num)
                yield p.select(["u", "v"]).filter(pa.array(near))

    return both.mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of fingerprints whose sets are as near as asked, a kept table; ``pairs`` is
    one too. Shingles are made again from the texts, of the ends of these pairs only, and travel
    slice by slice, so that the shuffle files of one slice are gone before the next."""
    ends = keep(pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct(), "ends")
    texts, ids = _texts_of(docs, first, ends)
    sets = keep(_sets(texts, n).join(small_side(ends), "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    release(ends, ids)
    slices = min(SLICES, 1 + (sets.agg(F.sum("n")).first()[0] or 0) // SLICE)
    found = []
    for i in range(slices):
        some = pairs.where(F.pmod(F.xxhash64("v"), F.lit(slices)) == i)
        of = lambda side: small_side(some.select(F.col(side).alias("fp")).distinct())  # noqa: B023, E731
        a = sets.join(of("u"), "fp", "left_semi").select(F.col("fp").alias("u"), F.col("n").alias("nu"), F.col("shingles").alias("su"))
        b = sets.join(of("v"), "fp", "left_semi").select(F.col("fp").alias("v"), F.col("n").alias("nv"), F.col("shingles").alias("sv"))
        both = some.join(b, "v").join(a, "u").withColumn("i", F.size(F.array_intersect("su", "sv")))
        found.append(keep(both.where(f"i * {den} >= (nu + nv - i) * {num}").select("u", "v"), "links"))
    release(sets)
    out = found[0] if slices == 1 else keep(functools.reduce(DataFrame.union, found), "links")
    release(*found[: 0 if slices == 1 else slices])
    return out


def _across(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """Distinct pairs of one bucket, part and different component whose sketches don't part them."""
    shape = "u long, v long"
    num, den = blocks.num, blocks.den

    def compare(a: dict, b: dict | None) -> tuple[np.ndarray, np.ndarray]:
        us, vs = [], []
        b_ = b or a
        for i in range(0, len(a["fp"]), 64):
            s = slice(i, i + 64)
            ok = a["comp"][s, None] != b_["comp"][None]
            na, nb = a["n"][s, None], b_["n"][None]
            ok &= np.minimum(na, nb) * den >= np.maximum(na, nb) * num
            if b is None:
                ok &= a["fp"][s, None] < a["fp"][None]
            x, y = np.nonzero(ok)
            far = np.bitwise_count(a["bits"][x + i] ^ b_["bits"][y]).sum(1)
            near = far <= (den - num) * (a["n"][x + i] + b_["n"][y]) // (den + num)
            us.append(a["fp"][x[near] + i])
            vs.append(b_["fp"][y[near]])
        return np.concatenate(us), np.concatenate(vs)

    def bucket(g: dict) -> tuple[np.ndarray, np.ndarray]:
        c0, c1, c = g["i"][0], g["j"][0], g["chunk"]
        pick = lambda m: {k: v[m] for k, v in g.items()}
        return compare(g, None) if c0 == c1 else compare(pick(c == c0), pick(c == c1)) if (c == c0).any() and (c == c1).any() else (np.zeros(0, np.int64),) * 2

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict | None = None

        def groups(end: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal rest
            g = rest
            if g is None or not len(g["fp"]):
                return
            new = (g["key"][1:] != g["key"][:-1]) | (g["i"][1:] != g["i"][:-1]) | (g["j"][1:] != g["j"][:-1])
            cuts = [0, *(np.flatnonzero(new) + 1), len(g["fp"])]
            for x, y in zip(cuts[: None if end else -2], cuts[1:] if end else cuts[1:-1], strict=False):
                if y - x > 1:
                    yield bucket({k: v[x:y] for k, v in g.items()})
            rest = None if end else {k: v[cuts[-2] :] for k, v in g.items()}

        def out(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            pairs = list(found)
            u = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
            v = np.concatenate([p[1] for p in pairs]) if pairs else u
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64())], ["u", "v"])

        for p in parts:
            if not p.num_rows:
                continue
            g = {k: p.column(k).to_numpy(zero_copy_only=False) for k in ("key", "i", "j", "chunk", "fp", "comp", "n")}
            g["bits"] = np.frombuffer(b"".join(p.column("sketch").to_pylist()), U).reshape(p.num_rows, -1)
            rest = g if rest is None else {k: np.concatenate([rest[k], g[k]]) for k in g}
            yield from out(groups(False))
        yield from out(groups(True))

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "chunk", "fp", "comp", "n", "sketch").mapInArrow(run, shape).distinct()


def link(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, fp, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two rows link when ``den`` * |A and B| >= ``num`` * |A or B| for their sets of word n-grams;
    component_id is the smallest doc_id reachable by links. Exact, up to collisions of 64-bit hashes
    of shingles and sets: equal sets form one node; of each bucket of equal block digests, every
    node is first compared with the bucket's first node, then with the one before it if these have
    not met; of larger buckets whose nodes are not yet in one component, each node leaves out as many
    as it shares with any linked one but for one, the largest ones first, and all pairs of the others
    are screened by sketch, in chunks, and what passes is verified. No bucket's pairs are all listed,
    and no link is dropped.

    Defined results: null, empty and blank texts have no shingles and link with nothing, not even
    each other (component_id is their own id); rows with equal id count as variants of one text if
    equal, else each as its own node with that id; a null id takes part, and is reported as null
    where no other row of its component has an id. Other columns are ignored.
    """
    return _link(docs, n, num, den).drop("component")


def _link(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """As ``link``, with component: its smallest fp, which tells components apart that share an id;
    null for rows without shingles."""
    blocks = Blocks(num, den)
    rows = keep(_profiles(docs, n), "profiles")
    first = keep(rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    copies = rows.select("doc_id").distinct().join(first.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("_id"))
    single = docs.select("doc_id", "text").join(small_side(keep(copies, "copies")), F.col("doc_id") == F.col("_id"), "left_anti")
    bucket = Window.partitionBy("key").orderBy("fp")
    seen = _keys(single, n, blocks).select(
        "key", "fp", F.first("fp").over(bucket.rowsBetween(Window.unboundedPreceding, 0)).alias("leader"),
        F.lag("fp").over(bucket).alias("before"), F.lead("fp").over(bucket).alias("after"))
    shared = keep(seen.where("(before IS NOT NULL AND before <> fp) OR (after IS NOT NULL AND after <> fp)").select("key", "fp", "leader", "before"), "shared")
    fps = keep(shared.select("fp").distinct(), "bucketed")
    texts, ids = _texts_of(docs, first, fps)
    sketches = keep(_sketches(texts, n, blocks).join(small_side(fps), "fp", "left_semi").dropDuplicates(["fp"]), "sketches")
    release(fps, ids)

    def linked(pairs: DataFrame) -> DataFrame:
        screened = keep(_screened(pairs, sketches, num, den), "screened")
        out = _verified(screened, docs, first, n, num, den)
        release(screened)
        return out

    order = lambda other: (F.least("fp", other).alias("u"), F.greatest("fp", other).alias("v"))
    links = linked(shared.where("leader <> fp").select(*order("leader")).distinct())
    comps = components(links)
    # then those before, if that has not joined them yet
    of = lambda side: small_side(comps.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")))
    apart = shared.where("before <> leader AND before <> fp").select(*order("before")).join(of("u"), "u", "left").join(of("v"), "v", "left")
    more = linked(apart.where("coalesce(c_u, u) <> coalesce(c_v, v)").select("u", "v").distinct())
    if more.limit(1).count():
        release(comps)
        links = links.union(more)
        comps = components(links)

    # of a bucket of three or less, all pairs were those of the first node and of the one before
    named = small_side(comps.withColumnRenamed("node", "fp"))
    inside = lambda rows: rows.select("key", "fp").join(named, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("comp"))
    sides = (F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("rows"))
    open_ = keep(inside(shared).groupBy("key").agg(*sides).where("c0 < c1 AND rows > 3").select("key", "rows"), "open")
    # nodes of two components that have not met share only keys of such buckets; each leaves out the
    # keys of its largest ones, as many as it may
    rest = inside(shared.join(small_side(open_.select("key")), "key", "left_semi")).distinct().join(small_side(open_), "key")
    largest = Window.partitionBy("fp", "bit").orderBy(F.desc("rows"), "key")
    rest = rest.join(sketches.select("fp", "free"), "fp").withColumn("bit", F.col("key").bitwiseAND(F.lit(1).cast("long")).cast("int"))
    rest = rest.withColumn("place", F.row_number().over(largest)).where("place > element_at(free, bit + 1)").select("key", "fp", "comp")
    rest = keep(rest, "rest")
    chunks = keep(rest.groupBy("key").agg(*sides).where("c0 < c1").select("key", F.ceil(F.col("rows") / F.lit(CHUNK)).cast("int").alias("chunks")), "chunks")
    todo = rest.join(small_side(chunks), "key").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    todo = todo.join(sketches.select("fp", "n", "sketch"), "fp")  # a sketch goes once to its bucket's rows, and is copied for its chunks after that
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    todo = todo.withColumn("other", F.explode(other)).select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp", "comp", "n", "sketch")
    across = keep(_across(todo, blocks), "across")
    release(shared, open_, sketches, rest, chunks)
    late = _verified(across, docs, first, n, num, den)
    release(across)
    if late.limit(1).count():
        release(comps)
        comps = components(links.union(late))
    release(links, more, late)

    of = first.join(comps, first.fp == comps.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "doc_id")
    ids = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = keep(of.join(ids, "component").select(F.col("fp").alias("_fp"), "component", "component_id"), "of")
    release(comps, first)
    out = rows.select("doc_id", "fp", "n").join(of, (F.col("fp") == F.col("_fp")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "fp", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest (doc_id, fp); of rows equal
    in both, one. Rows that share an id but not a text are judged each by its own component. Rows
    without shingles, and rows without an id, all stay. An empty table gives an empty one; columns keep
    their values, whatever their names."""
    id_, fp, row, at = free_name(docs, "_id", "_fp", "_row", "_at")
    linked = keep(_link(docs, n, num, den), "linked")
    named = linked.where("doc_id IS NOT NULL")
    own = named.where("n_shingles > 0").groupBy("component", "doc_id", "fp").count()
    best = own.groupBy("component").agg(F.min(F.struct("doc_id", "fp")).alias("best")).select(F.col("component").alias("_c"), "best")
    gone = own.join(best, F.col("component") == F.col("_c")).where(F.struct("doc_id", "fp") > F.col("best"))
    gone = keep(gone.select(F.col("doc_id").alias(id_), F.col("fp").alias(fp)), "gone")
    twice = keep(named.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_)), "twice")
    release(linked)
    same = F.col("doc_id") == F.col(id_)
    if not twice.limit(1).count():
        return docs.join(small_side(gone.select(id_)), same, "left_anti")
    repeated = small_side(twice)
    once = gone.join(repeated, id_, "left_anti").select(id_)
    single = docs.join(repeated, same, "left_anti").join(small_side(keep(once, "once")), same, "left_anti")
    many = keep(docs.join(repeated, same, "left_semi").withColumn(row, F.monotonically_increasing_id()), "many")
    fps = _profiles(many.select(F.col(row).alias("doc_id"), "text"), n).select(F.col("doc_id").alias(at), F.col("fp").alias("fp_"), "n")
    rows = many.select("doc_id", row).join(fps, F.col(row) == F.col(at))
    full = rows.where("n > 0").groupBy("doc_id", "fp_").agg(F.min(row).alias(row))
    full = full.join(small_side(gone), same & (F.col("fp_") == F.col(fp)), "left_anti")
    stay = keep(rows.where("n = 0").select(row).union(full.select(row)).select(F.col(row).alias(at)), "stay")
    return single.unionByName(many.join(small_side(stay), F.col(row) == F.col(at), "left_semi").drop(row))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")
