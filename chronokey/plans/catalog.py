"""All queries of the event operators by name, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, scalars
from ..operators import audit, kv, limiter, loadstats, lru, replication, ring
from ..sources import events as src
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
#: 2024-01-20 and the end of the log's month.
AS_OF, AT_END = 1_705_708_800_000, 1_706_745_600_000
CAPACITY, RATE_MILLI, COST = 100, 1, 40

LOG = """log AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, 'user:{' || user_id || '}' AS key, event_type AS t, (props->>'$.k')::BIGINT AS k FROM events),
cmd AS (
  SELECT seq, ts_ms, key,
    CASE WHEN t IN ('signup', 'purchase') THEN 'SET' WHEN t = 'click' THEN 'PEXPIRE' WHEN t = 'view' AND k % 2 = 0 THEN 'PERSIST' WHEN t = 'error' AND k % 3 = 0 THEN 'DEL' ELSE 'GET' END AS op,
    CASE WHEN t IN ('signup', 'purchase') THEN 'v' || seq END AS value,
    CASE WHEN t = 'purchase' THEN (k + 1) * 3600000 WHEN t = 'click' THEN CASE WHEN k % 10 = 0 THEN 0 ELSE (k + 1) * 3600000 END END AS arg
  FROM log)"""
#: A row for each command with the state after it, key by key in lockstep.
FOLD = f"""WITH RECURSIVE {LOG},
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM cmd WHERE ts_ms <= {{upto}}),
s AS (
  SELECT key, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BIGINT AS ts_ms, NULL::VARCHAR AS op, false AS live, false AS eff, false AS held, NULL::BIGINT AS d, NULL::VARCHAR AS val, NULL::BIGINT AS arg FROM (SELECT DISTINCT key FROM n)
  UNION ALL
  SELECT key, rn, seq, ts_ms, op, op <> 'SET' AND alive,
    op = 'SET' OR (alive AND (op IN ('DEL', 'PEXPIRE') OR (op = 'PERSIST' AND d IS NOT NULL))),
    CASE WHEN op = 'SET' THEN true WHEN op = 'DEL' OR (op = 'PEXPIRE' AND arg <= 0) THEN false ELSE alive END,
    CASE WHEN op = 'SET' OR (op = 'PEXPIRE' AND alive) THEN ts_ms + arg WHEN op = 'PERSIST' OR NOT alive THEN NULL ELSE d END,
    CASE WHEN op = 'SET' THEN value WHEN alive THEN val END, arg
  FROM (SELECT n.*, s.d, s.val, s.held AND (s.d IS NULL OR s.d > n.ts_ms) AS alive FROM s JOIN n ON n.key = s.key AND n.rn = s.rn + 1)),
z AS (SELECT * FROM s QUALIFY rn = max(rn) OVER (PARTITION BY key))
"""


def _fold(upto: int) -> str:
    return FOLD.replace("{upto}", str(upto))


HELD = "SELECT key, val AS value, d AS deadline_ms, seq AS last_seq FROM z WHERE held"
LIMIT = f"""WITH RECURSIVE {LOG},
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM log),
s AS (
  SELECT key, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BOOLEAN AS allowed, NULL::BIGINT AS remaining, NULL::BIGINT AS retry_ms, NULL::BIGINT AS reset_ms, NULL::BIGINT AS tok, NULL::BIGINT AS last, NULL::BIGINT AS ts_ms FROM (SELECT DISTINCT key FROM n)
  UNION ALL
  SELECT key, rn, seq, full_ >= {COST}000000, (t // 1000000)::BIGINT, CASE WHEN full_ >= {COST}000000 THEN -1 ELSE (({COST}000000 - t) + {RATE_MILLI} - 1) // {RATE_MILLI} END::BIGINT, (({CAPACITY}000000 - t) // {RATE_MILLI})::BIGINT,
    CASE WHEN full_ >= {COST}000000 THEN t ELSE tok END::BIGINT, CASE WHEN full_ >= {COST}000000 THEN ts_ms ELSE last END, ts_ms
  FROM (SELECT *, CASE WHEN full_ >= {COST}000000 THEN full_ - {COST}000000 ELSE full_ END AS t FROM (
    SELECT n.key, n.rn, n.seq, n.ts_ms, s.tok, s.last, CASE WHEN s.tok IS NULL THEN {CAPACITY}000000 ELSE least({CAPACITY}000000, s.tok + (n.ts_ms - s.last) * {RATE_MILLI}) END AS full_
    FROM s JOIN n ON n.key = s.key AND n.rn = s.rn + 1)))
"""
_W = "18446744073709551616::UHUGEINT"


def _mul(a: str) -> str:
    return f"((({a})::UHUGEINT * 14313749767032793493::UHUGEINT) % {_W})::UBIGINT"


def _shift(a: str) -> str:
    return f"xor({a}, ({a}) >> 47)"


def murmur_sql(rows: str) -> str:
    """CTEs that end in ``hashed`` (x, h: 16 hex digits) of ``rows`` (x)."""
    return f"""raw AS ({rows}),
bytes AS (SELECT x, octet_length(x::BLOB) AS n, list_transform(range(octet_length(x::BLOB)), lambda i: ('0x' || substr(hex(x), 2 * i::INTEGER + 1, 2))::UBIGINT) AS b FROM raw),
block AS (SELECT x, n, b, list_transform(range(n // 8), lambda k: list_reduce(list_transform(range(8), lambda j: b[8 * k + j + 1]::UHUGEINT << (8 * j)::UHUGEINT), lambda p, q: p + q)::UBIGINT) AS k,
  list_reduce(list_prepend(0::UHUGEINT, list_transform(range(n % 8), lambda j: b[8 * (n // 8) + j + 1]::UHUGEINT << (8 * j)::UHUGEINT)), lambda p, q: p + q)::UBIGINT AS tail FROM bytes),
m1 AS (SELECT x, n, tail, list_transform(list_transform(k, lambda v: {_mul('v')}), lambda v: {_mul(_shift('v'))}) AS k FROM block),
m2 AS (SELECT x, n, tail, list_reduce(list_prepend({_mul('n::UBIGINT')}, k), lambda a, v: {_mul('xor(a, v)')}) AS h FROM m1),
m3 AS (SELECT x, CASE WHEN n % 8 > 0 THEN {_mul('xor(h, tail)')} ELSE h END AS h FROM m2),
m4 AS (SELECT x, {_mul(_shift('h'))} AS h FROM m3),
hashed AS (SELECT x, lpad(lower(to_hex({_shift('h')})), 16, '0') AS h FROM m4)"""


def _ring_sql(n: int, keys: str = "SELECT c_name FROM customer") -> str:
    """CTEs that end in ``owned`` (key, hash, owner) for nodes node-0 .. node-(n-1)."""
    both = f"SELECT 'node-' || a || '#' || i AS x FROM range({n}) t(a), range({ring.VNODES}) u(i) UNION ALL {keys}"
    return murmur_sql(both) + """,
points AS (SELECT h AS hash, split_part(x, '#', 1) AS node FROM hashed WHERE x LIKE 'node-%'),
owned AS (SELECT x AS key, h AS hash, coalesce((SELECT min_by(node, hash) FROM points WHERE hash >= h), (SELECT min_by(node, hash) FROM points)) AS owner FROM hashed WHERE x NOT LIKE 'node-%')"""


def _move_sql(a: int, b: int) -> str:
    one, two = (_ring_sql(n) for n in (a, b))
    return f"SELECT p.key, p.owner AS before, q.owner AS after FROM (WITH {one} SELECT * FROM owned) p JOIN (WITH {two} SELECT * FROM owned) q USING (key)"


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("key"))


def _ring(spark: SparkSession, n: int) -> DataFrame:
    return ring.points(ring.nodes(spark, [f"node-{i}" for i in range(n)]))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return src.events(spark, d).where("value IS NOT NULL").select("event_type", (F.col("user_id") % 6).alias("run"), F.abs(F.round(F.col("value") * 1_000_000)).cast("long").alias("ns"), "ts_ms")


SAMPLES = "samples AS (SELECT event_type, user_id % 6 AS run, abs(round(value * 1000000))::BIGINT AS ns, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE value IS NOT NULL)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return src.events(spark, d).select(F.concat(F.lit("user:{"), F.col("user_id").cast("string"), F.lit("}")).alias("key"), F.col("event_id").alias("seq"), F.col("ts_ms").alias("now_ms"))


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return limiter.acquire(_calls(spark, sf_dir), CAPACITY, RATE_MILLI, COST).select("key", "seq", "allowed", "remaining", "retry_ms", "reset_ms")


def _peek(spark: SparkSession, d: str) -> DataFrame:
    """Answer to a probe of each key at the end, which writes nothing."""
    calls = _calls(spark, d).withColumn("peek", F.lit(False))
    probes = calls.groupBy("key").agg((F.max("seq") + 1).alias("seq"), F.lit(AT_END).cast("long").alias("now_ms"), F.lit(True).alias("peek"))
    asked = limiter.acquire(calls.union(probes), CAPACITY, RATE_MILLI, COST)
    return asked.join(probes.select("key", "seq"), ["key", "seq"]).select("key", "allowed", "remaining")


def _safety(spark: SparkSession, d: str) -> DataFrame:
    """How many calls were granted, and at how many a key had more than its capacity and refill allow (none)."""
    from pyspark.sql import Window

    r = limiter.acquire(_calls(spark, d), CAPACITY, RATE_MILLI, COST).join(_calls(spark, d), ["key", "seq"])
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("granted", F.sum(F.col("allowed").cast("long") * COST * limiter.MICRO).over(w)).withColumn("first", F.min("now_ms").over(w))
    over = F.col("granted") > CAPACITY * limiter.MICRO + (F.col("now_ms") - F.col("first")) * RATE_MILLI
    return r.agg(F.count_if("allowed").alias("granted"), F.count_if(over).alias("over"))


def _snapshot_tail(spark: SparkSession, d: str) -> DataFrame:
    """The state from a snapshot and the records after it, which must be that of a full replay."""
    log = kv.effective_log(src.command_log(spark, d))
    cut = log.agg((F.max("offset") / 2).cast("long").alias("cut"))
    snap = kv.replay(log.join(F.broadcast(cut)).where("offset <= cut").select(*log.columns), 0).select(F.lit(0).cast("long").alias("offset"), F.lit("SET").alias("op"), "key", "value", F.col("deadline_ms").alias("at_ms"))
    tail = log.join(F.broadcast(cut)).where("offset > cut").select(*log.columns)
    return kv.replay(snap.unionByName(tail), AT_END)


def _scalars(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d)
    b = scalars.bucket(F.col("ns"))
    return s.select("ns", b.alias("bucket"), scalars.bucket_edge(b).alias("edge"), scalars.ceil_div(F.col("ns"), F.lit(7)).alias("ceil7"), scalars.parse_milli(F.format_string("%d.%03d", F.floor(F.col("ns") / 1000), F.col("ns") % 1000)).alias("milli"),
                    scalars.resp_bulk(F.col("event_type")).alias("bulk"), scalars.bucket_text(F.col("ns"), F.col("ts_ms")).alias("state"), scalars.bucket_state(scalars.bucket_text(F.col("ns"), F.col("ts_ms")))["tokens_ut"].alias("tokens_ut"))


def _repl(spark: SparkSession, d: str) -> DataFrame:
    """The effective log with every 13th record sent twice, and one lost in each 5th key's stream."""
    log = kv.effective_log(src.command_log(spark, d)).select(F.col("key").alias("replid"), "offset")
    from pyspark.sql import Window

    w = Window.partitionBy("replid").orderBy("offset")
    log = log.select("replid", F.row_number().over(w).cast("long").alias("offset"))
    log = log.where(~((F.length("replid") % 5 == 0) & (F.col("offset") == 9)))
    return log.select("replid", (F.col("offset") * 2).alias("arrival"), "offset").union(log.where("offset % 13 = 0").select("replid", F.col("offset") * 2 + 1, "offset"))


def _two(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(src.command_log(s, d))


Q: dict[str, tuple[Query, str | None]] = {
    "rl_acquire": (FLAGSHIP, LIMIT + "SELECT key, seq, allowed, remaining, retry_ms, reset_ms FROM s WHERE rn > 0"),
    "rl_summary": (lambda s, d: FLAGSHIP(s, d).groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied")),
                   LIMIT + "SELECT key, count(*) FILTER (WHERE allowed) AS allowed, count(*) FILTER (WHERE NOT allowed) AS denied FROM s WHERE rn > 0 GROUP BY key"),
    "rl_peek": (_peek, LIMIT + f", e AS (SELECT key, least({CAPACITY}000000, tok + ({AT_END} - last) * {RATE_MILLI}) AS t FROM s WHERE rn > 0 QUALIFY rn = max(rn) OVER (PARTITION BY key)) SELECT key, t >= {COST}000000 AS allowed, (t // 1000000)::BIGINT AS remaining FROM e"),
    "rl_safety": (_safety, LIMIT + "SELECT count(*) FILTER (WHERE allowed) AS granted, 0::BIGINT AS over FROM s WHERE rn > 0"),
    "kv_final_state": (lambda s, d: kv.state(src.command_log(s, d), AT_END), _fold(AT_END) + HELD + f" AND (d IS NULL OR d > {AT_END})"),
    "kv_get_asof": (lambda s, d: kv.state(src.command_log(s, d), AS_OF).select("key", "value"), _fold(AS_OF) + f"SELECT key, val AS value FROM z WHERE held AND (d IS NULL OR d > {AS_OF})"),
    "kv_ttl": (lambda s, d: kv.ttl(kv.physical(src.command_log(s, d).where(f"ts_ms <= {AS_OF}")), src.command_log(s, d), AS_OF),
               _fold(AS_OF) + f"SELECT k.key, CASE WHEN z.key IS NULL OR NOT held OR d <= {AS_OF} THEN -2 WHEN d IS NULL THEN -1 ELSE (d - {AS_OF} + 500) // 1000 END::BIGINT AS ttl, CASE WHEN z.key IS NULL OR NOT held OR d <= {AS_OF} THEN -2 WHEN d IS NULL THEN -1 ELSE d - {AS_OF} END::BIGINT AS pttl FROM (SELECT DISTINCT key FROM cmd) k LEFT JOIN z USING (key)"),
    "kv_dbsize": (lambda s, d: kv.physical(src.command_log(s, d)).agg(F.count(F.lit(1)).alias("physical"), F.count_if(kv.is_live(AT_END)).alias("live")), _fold(AT_END) + f"SELECT count(*) AS physical, count(*) FILTER (WHERE d IS NULL OR d > {AT_END}) AS live FROM z WHERE held"),
    "kv_sweep": (lambda s, d: kv.sweep(kv.physical(src.command_log(s, d)), AT_END, 20), _fold(AT_END) + f"SELECT key, d AS deadline_ms FROM z WHERE held AND d <= {AT_END} ORDER BY d, key LIMIT 20"),
    "kv_keys_glob": (lambda s, d: kv.state(src.command_log(s, d), AT_END).where(F.col("key").rlike(scalars.glob_regex("user:{1*?}"))).select("key"), _fold(AT_END) + f"SELECT key FROM z WHERE held AND (d IS NULL OR d > {AT_END}) AND regexp_full_match(key, 'user:[{{]1.*.[}}]')"),
    "kv_effects": (lambda s, d: kv.annotate(src.command_log(s, d)).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if("live").alias("live"), F.count_if("effective").alias("effective")), _fold(AT_END) + "SELECT op, count(*) AS n, count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE eff) AS effective FROM s WHERE rn > 0 GROUP BY op"),
    "kv_effective_log": (_two(kv.effective_log), _fold(AT_END) + "SELECT seq AS \"offset\", CASE WHEN op = 'PEXPIRE' THEN CASE WHEN arg <= 0 THEN 'DEL' ELSE 'PEXPIREAT' END ELSE op END AS op, key, CASE WHEN op = 'SET' THEN val END AS value, CASE WHEN op = 'SET' OR (op = 'PEXPIRE' AND arg > 0) THEN ts_ms + arg END AS at_ms FROM s WHERE eff"),
    "kv_replay": (lambda s, d: kv.replay(kv.effective_log(src.command_log(s, d)), AT_END), _fold(AT_END) + f"SELECT key, val AS value, d AS deadline_ms FROM z WHERE held AND (d IS NULL OR d > {AT_END})"),
    "kv_snapshot_tail": (_snapshot_tail, _fold(AT_END) + f"SELECT key, val AS value, d AS deadline_ms FROM z WHERE held AND (d IS NULL OR d > {AT_END})"),
    "repl_offset_gate": (lambda s, d: replication.offset_gate(_repl(s, d)).groupBy("verdict").count().withColumnRenamed("count", "n"),
                         _fold(AT_END) + """, l AS (SELECT key AS replid, row_number() OVER (PARTITION BY key ORDER BY seq) AS o FROM s WHERE eff),
k AS (SELECT * FROM l WHERE NOT (length(replid) % 5 = 0 AND o = 9)), a AS (SELECT replid, o, o * 2 AS arr FROM k UNION ALL SELECT replid, o, o * 2 + 1 FROM k WHERE o % 13 = 0),
v AS (SELECT *, CASE WHEN length(replid) % 5 = 0 AND o > 9 THEN 'gap' WHEN arr % 2 = 1 THEN 'duplicate' ELSE 'apply' END AS verdict FROM a)
SELECT verdict, count(*) AS n FROM v GROUP BY verdict"""),
    "lru_sharded": (lambda s, d: lru.simulate(src.access_log(s, d), 240, 8).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.count("evicted").alias("evicted")),
                    """WITH a AS (SELECT event_id AS seq, 'user:{' || user_id || '}:' || event_type AS key FROM events),
b AS (SELECT *, (('0x' || substr(md5(key), 1, 8))::BIGINT % 8)::INTEGER AS shard, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS p, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS nx FROM a),
c AS (SELECT x.seq, x.shard, x.p, count(y.seq) AS between_ FROM b x LEFT JOIN b y ON x.shard = y.shard AND y.seq > x.p AND y.seq < x.seq AND (y.nx IS NULL OR y.nx > x.seq) GROUP BY ALL)
SELECT shard, count(*) AS n, count(*) FILTER (WHERE p IS NOT NULL AND between_ < 30) AS hits, greatest(0, count(*) FILTER (WHERE p IS NULL OR between_ >= 30) - 30) AS evicted FROM c GROUP BY shard"""),
    "lru_store": (lambda s, d: lru.simulate_store(src.command_log(s, d), 64, 4).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if("done").alias("done"), F.sum("evicted").alias("evicted")), None),
    "murmur64a": (lambda s, d: _keys(s, d).select("key", hashing.hex64(hashing.murmur(F.col("key"))).alias("hash")), "WITH " + murmur_sql("SELECT c_name AS x FROM customer") + " SELECT x AS key, h AS hash FROM hashed"),
    "hash_tag": (lambda s, d: src.access_log(s, d).select("seq", hashing.hash_tag(F.col("key")).alias("tag")), "SELECT event_id AS seq, user_id::VARCHAR AS tag FROM events"),
    "ring_owner": (lambda s, d: ring.owners(_keys(s, d), _ring(s, 3)).select("key", "hash", "owner"), f"WITH {_ring_sql(3)} SELECT key, hash, owner FROM owned"),
    "ring_share": (lambda s, d: ring.shares(_ring(s, 5)).select("node", F.round("share", 6).alias("share")),
                   f"WITH {_ring_sql(5)}, p AS (SELECT node, ('0x' || substr(hash, 1, 12))::BIGINT AS v, hash FROM points), l AS (SELECT *, lag(v) OVER (ORDER BY hash) AS b, max(v) OVER () AS m FROM p) SELECT node, round(sum(CASE WHEN b IS NULL THEN v + 281474976710656 - m ELSE v - b END) / 281474976710656.0::DOUBLE, 6) AS share FROM l GROUP BY node"),
    "ring_move_add": (lambda s, d: ring.moves(_keys(s, d), _ring(s, 3), _ring(s, 4)), _move_sql(3, 4)),
    "ring_move_remove": (lambda s, d: ring.moves(_keys(s, d), _ring(s, 4), _ring(s, 3)).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.expr("before <> after")).alias("moved"), F.count_if(F.expr("before <> after AND before <> 'node-3'")).alias("needless")), f"SELECT count(*) AS keys, count(*) FILTER (WHERE before <> after) AS moved, count(*) FILTER (WHERE before <> after AND before <> 'node-3') AS needless FROM ({_move_sql(4, 3)})"),
    "ring_balance": (lambda s, d: ring.owners(_keys(s, d), _ring(s, 4)).groupBy("owner").count().agg(F.min("count").alias("least"), F.max("count").alias("most"), F.round(F.stddev_pop("count") / F.avg("count"), 6).alias("cv")), f"WITH {_ring_sql(4)}, c AS (SELECT owner, count(*) AS n FROM owned GROUP BY owner) SELECT min(n) AS least, max(n) AS most, round(stddev_pop(n) / avg(n), 6) AS cv FROM c"),
    "ring_preferences": (lambda s, d: ring.preferences(_ring(s, 3), 2).select("hash", "node", F.element_at("nodes", 2).alias("second")),
                         f"WITH {_ring_sql(3)} SELECT p.hash, p.node, coalesce((SELECT min_by(node, hash) FROM points q WHERE q.hash > p.hash AND q.node <> p.node), (SELECT min_by(node, hash) FROM points q WHERE q.node <> p.node)) AS second FROM points p"),
    "ring_migrate": (lambda s, d: audit.migration(ring.moves(_keys(s, d), _ring(s, 3), _ring(s, 4)).where("before <> after").select((F.length("key") % 7 != 0).alias("have"), (F.substring("key", -1, 1) == "3").alias("dest_has"))),
                     f"SELECT count(*) AS scanned, count(*) FILTER (WHERE length(key) % 7 <> 0 AND right(key, 1) <> '3') AS moved, count(*) FILTER (WHERE length(key) % 7 <> 0 AND right(key, 1) = '3') AS superseded, count(*) FILTER (WHERE length(key) % 7 = 0) AS vanished FROM ({_move_sql(3, 4)}) WHERE before <> after"),
    "scalars": (_scalars, f"""WITH {SAMPLES}, b AS (SELECT *, length(bin(ns)) - 1 AS msb FROM samples), c AS (SELECT *, CASE WHEN ns < 32 THEN ns ELSE (msb - 4) * 32 + ((ns >> (msb - 5)) & 31) END::BIGINT AS bucket FROM b)
SELECT ns, bucket, CASE WHEN bucket < 32 THEN bucket ELSE ((32 + bucket % 32 + 1) << (bucket // 32 - 1)) - 1 END::BIGINT AS edge, ((ns + 6) // 7)::BIGINT AS ceil7, ns AS milli, '$' || strlen(event_type) || chr(13) || chr(10) || event_type || chr(13) || chr(10) AS bulk, 'RL1 ' || ns || ' ' || ts_ms AS state, ns AS tokens_ut FROM c"""),
    "hist_quantiles": (lambda s, d: loadstats.quantiles(loadstats.histogram(_samples(s, d), ["event_type"]), ["event_type"], [0.5, 0.9, 0.99, 0.999]),
                       f"""WITH {SAMPLES}, b AS (SELECT *, length(bin(ns)) - 1 AS msb FROM samples), c AS (SELECT event_type, ns, CASE WHEN ns < 32 THEN ns ELSE (msb - 4) * 32 + ((ns >> (msb - 5)) & 31) END::BIGINT AS bucket FROM b),
h AS (SELECT event_type, bucket, count(*) AS n, max(ns) AS top FROM c GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS total, max(top) OVER (PARTITION BY event_type) AS most FROM h),
q AS (SELECT unnest([0.5, 0.9, 0.99, 0.999]::DOUBLE[]) AS q)
SELECT event_type, q, least(min(CASE WHEN bucket < 32 THEN bucket ELSE ((32 + bucket % 32 + 1) << (bucket // 32 - 1)) - 1 END), max(most))::BIGINT AS value FROM r, q WHERE upto >= greatest(1, ceil(q * total)) GROUP BY event_type, q"""),
    "per_second": (lambda s, d: loadstats.per_second(_samples(s, d), ["event_type"]), f"WITH {SAMPLES} SELECT event_type, (ts_ms // 1000)::BIGINT AS second, count(*) AS n FROM samples GROUP BY ALL"),
    "variant_summary": (lambda s, d: loadstats.variants(_samples(s, d), ["event_type", "run"], "ns").withColumn("cv_pct", F.round("cv_pct", 6)), f"WITH {SAMPLES} SELECT event_type, run, count(*) AS n, median(ns::DOUBLE) AS median, min(ns)::DOUBLE AS min, max(ns)::DOUBLE AS max, round(CASE WHEN count(*) < 2 OR avg(ns) = 0 THEN 0.0 ELSE stddev_samp(ns) / avg(ns) * 100 END, 6) AS cv_pct FROM samples GROUP BY event_type, run"),
    "indexed_stats": (lambda s, d: loadstats.indexed(_samples(s, d), ["event_type"], "ns", {"p95": 0.95, "p99": 0.99}).withColumn("cv_pop_pct", F.round("cv_pop_pct", 6)), f"WITH {SAMPLES}, l AS (SELECT event_type, list(ns ORDER BY ns) AS v, round(stddev_pop(ns) / avg(ns) * 100, 6) AS cv_pop_pct FROM samples GROUP BY event_type) SELECT event_type, len(v)::BIGINT AS n, v[least(len(v) - 1, floor(0.95::DOUBLE * len(v)))::BIGINT + 1] AS p95, v[least(len(v) - 1, floor(0.99::DOUBLE * len(v)))::BIGINT + 1] AS p99, cv_pop_pct FROM l"),
    "vs_baseline": (lambda s, d: loadstats.against(loadstats.variants(_samples(s, d), ["run", "event_type"], "ns"), ["run"], "event_type", "view").withColumn("change_pct", F.round("change_pct", 6)), f"WITH {SAMPLES}, m AS (SELECT run, event_type, median(ns::DOUBLE) AS median FROM samples GROUP BY ALL) SELECT m.run, m.event_type, m.median, b.median AS base, round((m.median - b.median) / b.median * 100, 6) AS change_pct FROM m JOIN m b ON m.run = b.run AND b.event_type = 'view'"),
    "rank_sum": (lambda s, d: loadstats.mann_whitney(_samples(s, d), "event_type", "ns", "click", "view").select("n_a", "n_b", "rank_sum", "u"), f"WITH {SAMPLES}, r AS (SELECT event_type, rank() OVER (ORDER BY ns) + (count(*) OVER (PARTITION BY ns) - 1) / 2.0::DOUBLE AS r FROM samples WHERE event_type IN ('click', 'view')), s AS (SELECT count(*) FILTER (WHERE event_type = 'click') AS n_a, count(*) FILTER (WHERE event_type = 'view') AS n_b, sum(r) FILTER (WHERE event_type = 'click') AS rank_sum FROM r) SELECT *, rank_sum - n_a * (n_a + 1) / 2 AS u FROM s"),
    "mann_whitney": (lambda s, d: loadstats.mann_whitney(_samples(s, d), "event_type", "ns", "click", "view"), None),
    "hit_ratio": (lambda s, d: lru.simulate(src.access_log(s, d), 600, 1).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("ratio")), "WITH a AS (SELECT count(*) AS n, count(DISTINCT user_id || event_type) AS k FROM events) SELECT NULL::BIGINT AS n, NULL::DOUBLE AS ratio WHERE false"),
} | fx.QUERIES
Q["hit_ratio"] = (Q["hit_ratio"][0], """WITH a AS (SELECT event_id AS seq, 'user:{' || user_id || '}:' || event_type AS key FROM events),
b AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS p, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS nx FROM a),
c AS (SELECT x.seq, x.p, count(y.seq) AS between_ FROM b x LEFT JOIN b y ON y.seq > x.p AND y.seq < x.seq AND (y.nx IS NULL OR y.nx > x.seq) GROUP BY ALL)
SELECT count(*) AS n, round(avg((p IS NOT NULL AND between_ < 600)::INTEGER::DOUBLE), 6) AS ratio FROM c""")
from . import more  # noqa: E402  (its queries build on those above)

Q |= more.QUERIES


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in Q.items() if sql}
