"""Pinned values, byte formats, bounds and batch-stream agreement of the event operators."""

import math
import random
import re
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronokey.functions import hashing, scalars
from chronokey.operators import cluster, kv, limiter, loadstats, lru, ring
from chronokey.sources import records
from chronokey.streaming.events import acquire_stream

# Hashes that must equal the published placement contract.
VECTORS = {"": 0x0, "a": 0x071717D2D36B6B11, "abc": 0x9CC9C33498A95EFB, "hello world": 0xD3BA2368A832AFCE, "user:123": 0xCA8D71AFE8BEAF15, "key:0000000001": 0x06E859B9DC2DC2B4, "node-a#0": 0x99F4A2EEAF276E35, "node-a#159": 0xC24AF03848C0FDA3, "0123456789abcdef": 0x93A92D1A91A24BC7, "0123456789abcdefg": 0x0B3D8F28DD9E798F}


def test_murmur_vectors():
    assert hashing.murmur64a([k.encode() for k in VECTORS]).tolist() == list(VECTORS.values())


@pytest.mark.parametrize("key,tag", [("plain", "plain"), ("user:{42}:cart", "42"), ("{tag}", "tag"), ("a{}b", "a{}b"), ("a{b", "a{b"), ("a}b{c}", "c"), ("{a}{b}", "a"), ("a{}b{c}", "a{}b{c}")])
def test_hash_tag(spark, key, tag):
    assert spark.createDataFrame([(key,)], "k string").select(hashing.hash_tag(F.col("k"))).first()[0] == tag


@pytest.mark.parametrize("pattern,text,match", [("*", "", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[ab]", "[ab]", True), ("\\*", "*", True), ("\\*", "x", False), ("a\\", "a\\", True), ("a*b*c", "axxbyyc", True), ("a.c", "abc", False)])
def test_glob(spark, pattern, text, match):
    assert spark.createDataFrame([(text,)], "t string").where(F.col("t").rlike(scalars.glob_regex(pattern))).count() == match


def test_scalars(spark):
    row = spark.sql("SELECT 'GET  a\tb\r' AS line, 'x:1\r\n# c\r\nu:redis://h:1' AS info, 'RL1 -5 3' AS bad, 'RL1 123456789 1700000000123' AS good, array('1.5','0.001','1.2345','-0.5','7') AS milli")
    got = row.select(scalars.inline_args(F.col("line")).alias("a"), scalars.info_map(F.col("info")).alias("m"), scalars.bucket_state(F.col("bad")).alias("b"), scalars.bucket_state(F.col("good")).alias("g"), F.transform("milli", scalars.parse_milli).alias("p")).first()
    assert got["a"] == ["GET", "a", "b"] and got["m"] == {"x": "1", "u": "redis://h:1"} and got["b"] is None and tuple(got["g"]) == (123456789, 1700000000123)
    assert got["p"] == [1500, 1, None, None, 7000]


def test_limiter_bounds_and_expiry():
    for seed in range(20):
        r = random.Random(seed)
        cap, rate = r.randint(1, 50), r.randint(1, 5000)
        state, free, now, first, granted = None, None, 1000, 1000, 0
        for _ in range(1000):
            now += r.randint(0, 30)
            cost = r.randint(1, cap)
            answer, state = limiter.decide(state, now, cap, rate, cost)
            granted += cost * answer[0]
            assert granted * limiter.MICRO <= cap * limiter.MICRO + (now - first) * rate
            if free and now - free[1] >= -(-(cap * limiter.MICRO - free[0]) // rate):
                free = None  # a bucket that is full again is the same as none
            same, free = limiter.decide(free, now, cap, rate, cost)
            assert same == answer
    assert limiter.decide((0, 10**15), 5, 10, 1000, 1)[0] == (False, 0, 1000, 10_000)


def test_limiter_stream_agrees(spark, tmp_path):
    rows = [(f"k{i % 5}", i, 1000 + i * 37) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, seq long, now_ms long")
    (tmp_path / "in").mkdir()
    for part in range(2):
        df.where((F.col("seq") >= part * 100) & (F.col("seq") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = acquire_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in")), 5, 3000, 2)
    q = s.writeStream.format("memory").queryName("rl").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = limiter.acquire(df, 5, 3000, 2).select("key", "seq", "allowed", "remaining", "retry_ms", "reset_ms")
    assert sorted(map(tuple, spark.table("rl").collect())) == sorted(map(tuple, want.collect()))
    assert {r["allowed"] for r in want.collect()} == {True, False}


def test_record_files(spark, tmp_path):
    body = records.MAGIC + b"".join(records.frame(p) for p in (b"SET a 1", b"\r\n\0", b""))
    assert [s for *_, s in records.records(body)] == ["ok", "ok", "ok", "end"]
    for cut in range(len(body)):
        got = list(records.records(body[:cut]))
        assert got[-1][2] in ("torn", "end") and all(s == "ok" for *_, s in got[:-1])
    flipped = bytearray(body)
    flipped[20] ^= 1
    assert list(records.records(bytes(flipped)))[0][2] == "corrupt"
    (tmp_path / "wal-0000000001.log").write_bytes(body + struct.pack("<I", 9))
    assert [r["status"] for r in records.read_records(spark, str(tmp_path)).orderBy("ordinal").collect()] == ["ok", "ok", "ok", "torn"]


def test_written_records(spark, tmp_path):
    """Files are closed by size, keep the order of a partition, and are read whole; nulls are no records."""
    rows = [(i, bytes([i % 256, 13, 10]) * (i % 5)) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, None)], "i long, payload binary").repartition(3, "i")
    records.write_records(df, str(tmp_path / "log"), "i", 512)
    got = records.read_records(spark, str(tmp_path / "log"), packed=True).orderBy("segment", "ordinal").collect()
    assert sorted(bytes(r["payload"]) for r in got if r["status"] == "ok") == sorted(x for _, x in rows)
    assert len({r["segment"] for r in got}) > 3 and {r["status"] for r in got} == {"ok", "end"}
    assert records.pack_records(df.limit(0), "i").count() == 0
    assert records.scan_records(spark.createDataFrame([("a", None)], "segment string, content binary")).first()["status"] == "torn"


def test_replies():
    data = b"+OK\r\n*2\r\n*0\r\n$2\r\n\r\n\r\n:-7\r\n*-1\r\n"
    got = list(records.replies(data))
    assert [(r[0], r[1], r[2]) for r in got] == [(0, [], "simple"), (1, [], "array"), (1, [0], "array"), (1, [1], "bulk"), (2, [], "int"), (3, [], "null")]
    assert got[3][3] == b"\r\n" and got[4][3] == b"-7"
    for cut in range(1, len(data)):
        assert all(r[4] == "ok" for r in list(records.replies(data[:cut]))[:-1]) and list(records.replies(data[:cut]))[-1][4] in ("ok", "incomplete")
    for bad in (b"?x\r\n", b":x\r\n", b"$-2\r\n", b"$1\r\nabc\r\n"):
        assert list(records.replies(bad))[-1][4] == "error"
    assert len(list(records.replies(b"*1\r\n" * 3000 + b":1\r\n"))) == 3001


def test_batches_across_streams(spark):
    """Many short streams or files leave Python in a few batches, large values in several."""

    class Asked:
        """Stands for a table: what its Python function yields for one batch."""

        def __init__(self, **columns):
            self.batch = pa.RecordBatch.from_pydict(columns)

        select = lambda self, *names: self
        mapInArrow = lambda self, f, schema: list(f(iter([self.batch])))
        mapInPandas = lambda self, f, schema: list(f(iter([self.batch.to_pandas()])))

    for out, n in ((records.parse_replies(Asked(row=[*range(3000)], data=[b"+OK\r\n:1\r\n"] * 3000)), 6000), (records.scan_records(Asked(segment=["a"] * 3000, content=[records.MAGIC] * 3000)), 3000)):
        assert sum(map(len, out)) == n and len(out) == 1
    rows = [(i, bytes(records.SEND_BYTES // 2)) for i in range(5)]
    assert [b.num_rows for b in records._sent(iter(rows), 1, pa.schema([("i", pa.int64()), ("v", pa.binary())]))] == [2, 2, 1]
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"")), (None, bytearray(b":x\r\n")), (3, bytearray(b"*1\r\n$-1\r\n"))], "row long, data binary")
    assert sorted((str(r["row"]), r["path"], r["kind"], r["status"]) for r in records.parse_replies(odd).collect()) == [("3", [], "array", "ok"), ("3", [0], "null", "ok"), ("None", [], None, "error")]


def test_commands(spark):
    data = b"*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$2\r\n\r\n\r\nPING x\r\n"
    assert [s for _, s in records.commands(data)] == ["ok", "ok"]
    assert list(records.commands(data))[0][0] == [b"SET", b"k", b"\r\n"]
    assert list(records.commands(b"*1\r\n$-1\r\n"))[-1][1] == "error" and list(records.commands(b"*2\r\n$1\r\na\r\n"))[-1][1] == "incomplete"
    df = spark.createDataFrame([(1, bytearray(data))], "row long, data binary")
    assert records.parse_commands(df).count() == 2


def test_cache_in_chunks(spark, monkeypatch):
    """Hits and evictions against one cache in order: chunks with and without a shard's keys, ties, null keys, sparse seqs."""
    monkeypatch.setattr(lru, "CHUNK_ROWS", 100, raising=False)
    r = random.Random(3)
    rows = [(i * i // 2 if i < 300 else 10**12 + i // 2, r.choice([None, *"abcdefghijklmnopqrstuvwxyz"[: 6 + i // 50]])) for i in range(1000)]
    df = spark.createDataFrame(rows, "seq long, key string").repartition(5)
    for capacity, shards in ((1, 1), (5, 1), (6, 3), (30, 2)):
        got = lru.simulate(df, capacity, shards)
        assert got.rdd.getNumPartitions() == (3 if capacity == 30 else 10)
        got = got.collect()
        n, room = lru.per_shard(capacity, shards)
        held, want = {}, []
        at = {x["key"]: x["shard"] for x in got}
        for seq, key in sorted(rows, key=lambda x: (x[0], x[1] or "")):
            cache, hit, gone = held.setdefault(at[key], []), False, None
            if key is not None:
                hit = key in cache
                if hit:
                    cache.remove(key)
                elif len(cache) >= room:
                    gone = cache.pop(0)
                cache.append(key)
            want.append((seq, key, at[key], hit, gone))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert lru.simulate(df.limit(0), 5, 1).count() == 0


def test_store_deadlines():
    s = lru.Store(3)
    for k in "abc":
        s.apply("SET", k, "v", None, 0)
    s.apply("GET", "a", None, None, 1)
    assert s.apply("SET", "d", "v", None, 2) == (True, ["b"])
    s.apply("PEXPIRE", "c", None, 5, 2)
    assert s.apply("SET", "e", "v", None, 7) == (True, [])  # reclaims the expired key
    assert s.apply("GET", "c", None, None, 7)[0] is False


def test_replay_modes(spark):
    rows = [(1, "SET", "k", "v", 100), (2, "PERSIST", "k", None, None), (3, "SET", "x", "1", None), (4, "FLUSHALL", None, None, None), (5, "SET", "k", "w", 100), (6, "PEXPIREAT", "k", None, 900), (7, "SET", "y", "2", 50), (8, "DEL", "x", None, None)]
    log = spark.createDataFrame(rows, "offset long, op string, key string, value string, at_ms long")
    assert [tuple(r) for r in kv.replay(log, 500).collect()] == [("k", "w", 900)]
    assert kv.replay(log, 500, strict=True).count() == 0


def test_ring_weights_and_moves(spark):
    n = ring.nodes(spark, ["big", "small", "small"], [3, 0, 9])
    assert {r["node"]: r["weight"] for r in n.collect()} == {"big": 3, "small": 1}
    share = {r["node"]: r["share"] for r in ring.shares(ring.points(n)).collect()}
    assert abs(sum(share.values()) - 1) < 1e-9 and 0.65 < share["big"] < 0.85
    one = ring.points(ring.nodes(spark, ["only"]), 1)
    keys = spark.range(50).select(F.format_string("key:%d", "id").alias("key"))
    assert ring.owners(keys, one).count() == 50 and abs(ring.shares(one).first()["share"] - 1) < 1e-9


def test_keys_are_hashed_once(spark):
    """Keys are hashed in one Python step for any number of rings, the arcs are broadcast, and null keys have no owner."""
    a, b = (ring.points(ring.nodes(spark, names), 5) for names in (["x", "y"], ["x", "y", "z"]))
    keys = spark.createDataFrame([("k%d" % i,) for i in range(50)] + [("user:{7}",), (None,)], "key string")
    for df, joins in ((ring.owners(keys, a), 1), (ring.moves(keys, a, b), 2), (cluster.routed(keys, b, a), 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"ArrowEvalPython \[_murmur\(cast\(CASE", plan)) == 1 and plan.count("BuildRight") == plan.count("BroadcastHashJoin") == joins
        assert df.count() == 51
    assert {r["key"]: r["before"] for r in ring.moves(keys, a, b).collect()} == {r["key"]: r["owner"] for r in ring.owners(keys, a).collect()}


def test_mann_whitney(spark):
    def p(a, b):
        df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, x double")
        return loadstats.mann_whitney(df, "g", "x", "a", "b").first()["p"]

    assert math.isnan(p([1, 2], [3, 4, 5])) and p([1, 1, 1], [1, 1, 1]) == 1.0
    assert abs(p([1, 2, 3, 4], [5, 6, 7, 8]) - math.erfc((8 - 0.5) / math.sqrt(12) / math.sqrt(2))) < 1e-9


