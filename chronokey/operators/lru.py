"""Least-recently-used caches over an access log."""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accesses of a chunk, of all shards together.
CHUNK_ROWS = 1 << 18


def shard_of(key: Column, shards: int) -> Column:
    """Placement by 32 bits of MD5 (a stable hash of our own)."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def per_shard(capacity: int, shards: int) -> tuple[int, int]:
    """(shards, keys of each): no more shards than keys, sizes rounded up."""
    n = max(1, min(shards, capacity))
    return n, -(-capacity // n)


def clamped_shards(capacity: int, shards: int, least: int = 1024) -> int:
    """Shards, so that each has at least ``least`` keys where there is a capacity."""
    return min(shards, max(1, capacity // least)) if capacity > 0 else shards


def _cut(accesses: DataFrame, rows: int) -> tuple[Column, int]:
    """The chunk of a row, 0 first, by ranges of seq that hold about ``rows`` rows each; how many chunks."""
    n = -(-accesses.count() // rows)
    if n < 2:
        return F.lit(0), 1
    at = accesses.agg(F.percentile_approx("seq", [i / n for i in range(1, n)], 10 * n)).first()[0]
    cuts = sorted(set(at or []))

    def below(lo: int, hi: int) -> str:
        mid = (lo + hi) // 2
        return str(lo) if lo == hi else f"IF(seq <= {cuts[mid]}, {below(lo, mid)}, {below(mid + 1, hi)})"

    return F.expr(f"IF(seq IS NULL, 0, {below(0, len(cuts))})"), len(cuts) + 1


def _latest(rows: DataFrame, room: int) -> DataFrame:
    """(shard, chunk, seq, key): the ``room`` keys accessed last in each chunk, by their last access."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen = None, set()
        for p in parts:
            out = []
            for row in p.itertuples(index=False, name=None):
                if row[:2] != at:
                    at, seen = row[:2], set()
                if len(seen) < room and row[3] not in seen:
                    seen.add(row[3])
                    out.append(row)
            yield pd.DataFrame(out, columns=p.columns)

    down = rows.sortWithinPartitions("shard", "chunk", F.desc("seq"), F.desc("key"))
    return down.mapInPandas(run, "shard int, chunk int, seq long, key string")


def _starts(latest: DataFrame, room: int, chunks: int) -> DataFrame:
    """(shard, chunk, seq, key): what a shard's cache holds at the start of each chunk but the first, by
    last accesses. A shard is one task, of ``room`` rows a chunk."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, chunk, held = None, 0, OrderedDict()

        def until(end: int) -> Iterator[pd.DataFrame]:
            for c in range(chunk + 1, end + 1):
                yield pd.DataFrame({"shard": shard, "chunk": c, "seq": list(held.values()), "key": list(held)})

        for p in parts:
            for s, c, seq, key in p.itertuples(index=False, name=None):
                if s != shard:
                    if shard is not None:
                        yield from until(chunks - 1)
                    shard, chunk, held = s, 0, OrderedDict()
                if c != chunk:
                    yield from until(c)
                    chunk = c
                held[key] = seq
                held.move_to_end(key)
                if len(held) > room:
                    held.popitem(last=False)
        if shard is not None:
            yield from until(chunks - 1)

    up = latest.repartition("shard").sortWithinPartitions("shard", "chunk", "seq", "key")
    return up.mapInPandas(run, "shard int, chunk int, seq long, key string")


def simulate(accesses: DataFrame, capacity: int, shards: int) -> DataFrame:
    """(seq, key, shard, hit, evicted): cache-aside reads in order of seq, then key, exact in each
    shard; a null key is in no cache.

    Accesses are cut into chunks by ranges of seq, each a task's work in order. A cache holds the keys
    accessed last, so what it holds at the start of a chunk follows from the last keys of the chunks
    before, and the chunks run side by side. A chunk has so many rows that those keys are few beside them.
    """
    n, room = per_shard(capacity, shards)
    cut, chunks = _cut(accesses.select("seq"), max(CHUNK_ROWS, 16 * n * room))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, OrderedDict()
        for p in parts:
            hits, out = [], []
            for *here, key, warm in zip(p["shard"], p["chunk"], p["key"], p["warm"], strict=True):
                if here != at:
                    at, held = here, OrderedDict()
                hit, gone = key in held, None
                if hit:
                    held.move_to_end(key)
                else:
                    if len(held) >= room:
                        gone = held.popitem(last=False)[0]
                    held[key] = True
                if not warm:
                    hits.append(hit)
                    out.append(gone)
            yield p.loc[~p["warm"], ["seq", "key", "shard"]].assign(hit=hits, evicted=out)

    rows = accesses.select(shard_of(F.col("key"), n).alias("shard"), cut.cast("int").alias("chunk"), "seq", "key")
    dealt = lambda df: df.repartitionById(chunks, "chunk") if chunks > 1 else df.repartition("shard")
    warm = rows.withColumn("warm", F.lit(False))
    if chunks > 1:
        latest = _latest(dealt(rows.where((F.col("chunk") < chunks - 1) & F.col("key").isNotNull())), room)
        warm = warm.unionByName(_starts(latest, room, chunks).withColumn("warm", F.lit(True)))
    return dealt(warm).sortWithinPartitions("shard", "chunk", "seq", "key").mapInPandas(run, "seq long, key string, shard int, hit boolean, evicted string")


class Store:
    """One shard with deadlines: SET, GET, DEL and PEXPIRE; a new key at capacity first reclaims
    up to 16 expired keys, soonest first, and then evicts the oldest."""

    def __init__(self, capacity: int | None):
        self.capacity, self.map = capacity, OrderedDict()
        self.deadlines: list[tuple[int, str]] = []  # a heap; entries that no longer hold are passed over

    def _live(self, key, now) -> bool:
        if key in self.map and self.map[key][1] is not None and self.map[key][1] <= now:
            del self.map[key]
        return key in self.map

    def _put(self, key, value, deadline) -> None:
        self.map[key] = (value, deadline)
        if deadline is not None:
            heapq.heappush(self.deadlines, (deadline, key))

    def _reclaim(self, now: int, most: int) -> None:
        while most and self.deadlines and self.deadlines[0][0] <= now:
            deadline, key = heapq.heappop(self.deadlines)
            if self.map.get(key, (None, None))[1] == deadline:
                del self.map[key]
                most -= 1

    def apply(self, op: str, key, value, arg, now: int) -> tuple[bool, list]:
        """(hit or effective, evicted keys)."""
        if op == "SET":
            gone = []
            if key not in self.map and self.capacity and len(self.map) >= self.capacity:
                self._reclaim(now, 16)
                while len(self.map) >= self.capacity:
                    gone.append(self.map.popitem(last=False)[0])
            self._put(key, value, None if arg is None else now + arg)
            self.map.move_to_end(key)
            return True, gone
        if not self._live(key, now):
            return False, []
        if op == "GET":
            self.map.move_to_end(key)
        elif op == "DEL" or op == "PEXPIRE" and arg <= 0:
            del self.map[key]
        elif op == "PEXPIRE":
            self._put(key, self.map[key][0], now + arg)
        elif op == "PERSIST":
            had = self.map[key][1] is not None
            self.map[key] = (self.map[key][0], None)
            return had, []
        return True, []


def simulate_store(log: DataFrame, capacity: int, shards: int) -> DataFrame:
    """(seq, key, op, done, evicted) of a command log under eviction."""
    n, room = per_shard(capacity, shards)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, store = None, Store(room)
        for p in parts:
            rows = []
            for s, seq, now, op, key, value, arg in p[["shard", "seq", "ts_ms", "op", "key", "value", "arg_ms"]].itertuples(index=False):
                if s != shard:
                    shard, store = s, Store(room)
                done, gone = store.apply(op, key, value, None if pd.isna(arg) else int(arg), now)
                rows.append((seq, key, op, done, len(gone)))
            yield pd.DataFrame(rows, columns=["seq", "key", "op", "done", "evicted"])

    rows = log.withColumn("shard", shard_of(F.col("key"), n))
    return rows.repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(run, "seq long, key string, op string, done boolean, evicted int")
