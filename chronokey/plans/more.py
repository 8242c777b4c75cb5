"""Queries of commands, clusters, recovery and reports, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cluster, commands, kv, loadstats, ring
from ..sources import events as src
from ..sources import records
from .catalog import AS_OF, AT_END, SAMPLES, _fold, _keys, _ring, _ring_sql, _samples, murmur_sql

#: Command vectors by event_id % 24, in Spark and in SQL alike: e is the id as text.
ARGV = [
    "'PING'", "'ping','hi'", "'PING','a','b'", "'ECHO',e", "'SET','k',e", "'set','k',e,'ex','60'", "'SET','k',e,'PX','0'", "'SET','k',e,'EX','x1'", "'SET','k',e,'EX','2000000000'", "'SET','k',e,'KEEP'", "'SET','k',e,'EX','5','PX','5'", "'SET','k'",
    "'GET','k'", "'Get'", "'DEL','a','b','a'", "'EXPIRE','k',e", "'PEXPIRE','k','+5'", "'TTL','k','z'", "'RL.ACQUIRE','k','10','0.5'", "'rl.peek','k','10','0.0005'", "'RL.ACQUIRE','k','0','1'", "'RL.ACQUIRE','k','10','1','11'", "'RL.ACQUIRE','k','10'", "'FROB',e",
]
_CASE = "CASE " + " ".join(f"WHEN event_id % {len(ARGV)} = {i} THEN {{a}}({a}){{z}}" for i, a in enumerate(ARGV)) + " END"


def _argv(s: SparkSession, d: str) -> DataFrame:
    case = _CASE.replace("{a}", "array").replace("{z}", "").replace(",e", ",cast(event_id AS STRING)")
    return src.events(s, d).select(F.col("event_id").alias("seq"), F.expr(case).alias("args"))


def _replies(s: SparkSession, d: str) -> DataFrame:
    """A status, an error, a number and an array of a string, a null and a nested array, encoded and decoded."""
    e = F.col("event_id")
    text = F.col("event_type")
    nested = scalars.reply_array(F.array(scalars.resp_bulk(text), scalars.resp_bulk(F.lit(None).cast("string")), scalars.reply_array(F.array(scalars.reply_line(":", F.col("user_id"))))))
    data = F.concat(scalars.reply_line("+", F.lit("OK")), scalars.reply_line("-", F.concat(F.lit("ERR "), text)), scalars.reply_line(":", -e), nested)
    got = records.parse_replies(src.events(s, d).select(e.alias("row"), data.cast("binary").alias("data")))
    return got.select("row", "ordinal", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "kind", F.col("value").cast("string").alias("value"), "status")


def _packed(s: SparkSession, d: str) -> DataFrame:
    """Commands written to record files of some records each, and read again."""
    payload = F.concat(F.lit("SET user:"), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"))
    files = records.pack_records(src.events(s, d).select("event_id", payload.cast("binary").alias("payload")), "event_id", 4096)
    got = records.scan_records(files).where("status <> 'end'")
    return got.groupBy(F.col("payload").cast("string").alias("payload"), "status").agg(F.count(F.lit(1)).alias("n"))


def _validate(s: SparkSession, d: str) -> DataFrame:
    a = F.col("args")
    op = F.upper(F.get(a, F.lit(0)))
    return _argv(s, d).select("seq", op.alias("op"), commands.op_class(op).alias("class"), commands.error(a).alias("error"), commands.static_reply(a).alias("reply"))


_ERRORS = {2: "ERR wrong number of arguments for 'ping' command", 6: "ERR invalid expire time in 'set' command", 7: "ERR value is not an integer or out of range", 8: "ERR invalid expire time", 9: "ERR syntax error", 10: "ERR syntax error", 11: "ERR wrong number of arguments for 'set' command", 13: "ERR wrong number of arguments for 'get' command",
           16: "ERR value is not an integer or out of range", 17: "ERR wrong number of arguments for 'ttl' command", 19: "ERR rate must be tokens per second, 0.001 to 1000000, at most 3 decimals", 20: "ERR capacity must be an integer between 1 and 1000000000", 21: "ERR cost exceeds capacity", 22: "ERR wrong number of arguments for 'RL.ACQUIRE' command", 23: "ERR unknown command 'FROB'"}
_OPS = [a.split(",")[0].strip("'").upper() for a in ARGV]
VALIDATE_SQL = f"""WITH c AS (SELECT event_id AS seq, event_id::VARCHAR AS e, event_id % {len(ARGV)} AS v FROM events),
o AS (SELECT v, op, err FROM (VALUES {', '.join("(%d, '%s', %s)" % (i, o, "'" + _ERRORS[i].replace("'", "''") + "'" if i in _ERRORS else 'NULL') for i, o in enumerate(_OPS))}) t(v, op, err))
SELECT seq, op, CASE WHEN op IN ('SET','DEL','EXPIRE','PEXPIRE','PERSIST','RL.ACQUIRE') THEN 'write' WHEN op IN ('GET','TTL','PTTL','DBSIZE','KEYS','RL.PEEK') THEN 'read' ELSE 'other' END AS class, err::VARCHAR AS error,
  CASE WHEN err IS NOT NULL THEN '-' || err || chr(13) || chr(10) WHEN v = 0 THEN '+PONG' || chr(13) || chr(10) WHEN v = 1 THEN '$2' || chr(13) || chr(10) || 'hi' || chr(13) || chr(10) WHEN v = 3 THEN '$' || strlen(e) || chr(13) || chr(10) || e || chr(13) || chr(10) END AS reply
FROM c JOIN o USING (v)"""


def _del_many(s: SparkSession, d: str) -> DataFrame:
    """DEL of three keys, one named twice, for each event up to a time: how many were live."""
    live = kv.state(src.command_log(s, d), AS_OF).select("key", F.lit(1).alias("live"))
    key = lambda n: F.concat(F.lit("user:{"), (F.col("user_id") + n).cast("string"), F.lit("}"))
    asked = src.events(s, d).select(F.col("event_id").alias("seq"), F.explode(F.array_distinct(F.array(key(0), key(1), key(1)))).alias("key"))
    return asked.join(live, "key", "left").groupBy("seq").agg(F.count("live").alias("removed"))


def _wrongtype(s: SparkSession, d: str) -> DataFrame:
    """A limiter's call on keys whose value may be no bucket."""
    value = F.when(F.col("value").endswith("0"), F.concat(F.lit("RL1 5 "), F.substring("value", 2, 20))).otherwise(F.col("value"))
    held = kv.state(src.command_log(s, d), AT_END).select("key", value.alias("value"))
    asked = src.command_log(s, d).select("key").distinct().join(held, "key", "left")
    return asked.select("key", F.when(F.col("value").isNotNull() & scalars.bucket_state(F.col("value")).isNull(), "WRONGTYPE key holds a value that is not a rate limiter bucket").alias("error"))


def _info(s: SparkSession, d: str) -> DataFrame:
    """Counters of a store after the log: keys held, mutations, expired keys met, reads and their hits."""
    a = kv.annotate(src.command_log(s, d))
    return a.agg(F.count(F.lit(1)).alias("commands"), F.count_if(F.col("op") == "GET").alias("gets"), F.count_if((F.col("op") == "GET") & F.col("live")).alias("hits"), F.count_if("effective").alias("mutations"))


def _held(s: SparkSession, d: str) -> DataFrame:
    """Nodes' tables amid a move from three nodes to four: every key on its old owner but for each 7th
    name length, and keys that end in 3 on their new owner too, with another value."""
    keys = _keys(s, d)
    number = F.regexp_extract("key", r"(\d+)$", 1).cast("long")
    old = ring.owners(keys, _ring(s, 3)).where(number % 7 != 0).select(F.col("owner").alias("node"), "key", F.concat(F.lit("old"), number.cast("string")).alias("value"), F.when(number % 2 == 0, number).alias("deadline_ms"))
    new = ring.owners(keys, _ring(s, 4)).where(number % 10 == 3).join(old.select("node", "key"), "key").where("owner <> node").select(F.col("owner").alias("node"), "key", F.concat(F.lit("new"), number.cast("string")).alias("value"), F.lit(None).cast("long").alias("deadline_ms"))
    return old.unionByName(new)


_TWO = f"""three AS (SELECT key, owner AS before FROM (WITH {_ring_sql(3)} SELECT * FROM owned)), four AS (SELECT key, owner AS now FROM (WITH {_ring_sql(4)} SELECT * FROM owned)),
own AS (SELECT key, before, now, regexp_extract(key, '(\\d+)$', 1)::BIGINT AS n FROM three JOIN four USING (key)),
held AS (SELECT before AS node, key, 'old' || n AS value, CASE WHEN n % 2 = 0 THEN n END AS deadline_ms FROM own WHERE n % 7 <> 0
  UNION ALL SELECT now, key, 'new' || n, NULL FROM own WHERE n % 7 <> 0 AND n % 10 = 3 AND now <> before)""".replace("\\\\", "\\")


def _placed(s: SparkSession, d: str) -> DataFrame:
    return cluster.placed(cluster.routed(_keys(s, d), _ring(s, 4), _ring(s, 3)), _held(s, d))


_PLACED = f"WITH {_TWO}, p AS (SELECT o.*, a.value AS nv, b.value AS bv, a.key IS NOT NULL AS nh, b.key IS NOT NULL AS bh FROM own o LEFT JOIN held a ON a.node = o.now AND a.key = o.key LEFT JOIN held b ON b.node = o.before AND b.key = o.key)"


def _routes(s: SparkSession, d: str) -> DataFrame:
    ops = F.explode(F.array(*[F.lit(o) for o in ("GET", "SET", "DEL", "RL.ACQUIRE", "EXPIRE")]))
    return _placed(s, d).withColumn("op", ops).select("key", "op", F.array_join(cluster.route(F.col("op")), ",").alias("targets"))


def _listed(s: SparkSession, d: str) -> DataFrame:
    """What the sources listed before some of it vanished."""
    return ring.owners(_keys(s, d), _ring(s, 3)).select(F.col("owner").alias("node"), "key")


def _migration(s: SparkSession, d: str) -> DataFrame:
    return cluster.migrate(_held(s, d), _listed(s, d), _ring(s, 4))


_MOVES = f"""WITH {_TWO}, m AS (SELECT o.key, o.before AS source, o.now AS dest, CASE WHEN s.key IS NULL THEN 'vanished' WHEN t.key IS NOT NULL THEN 'superseded' ELSE 'moved' END AS outcome, CASE WHEN t.key IS NOT NULL THEN t.deadline_ms ELSE s.deadline_ms END AS deadline_ms
  FROM own o LEFT JOIN held s ON s.node = o.before AND s.key = o.key LEFT JOIN held t ON t.node = o.now AND t.key = o.key WHERE o.before <> o.now)"""


def _modulo(s: SparkSession, d: str) -> DataFrame:
    """Keys that move from three to four nodes by placement modulo their number, against the ring's."""
    k = ring.moves(_keys(s, d), _ring(s, 3), _ring(s, 4)).withColumn("h", ring.key_hash(F.col("key")))
    a, b = scalars.unsigned_mod(F.col("h"), 3), scalars.unsigned_mod(F.col("h"), 4)
    return k.agg(F.count(F.lit(1)).alias("keys"), F.count_if(a != b).alias("modulo_moved"), F.count_if(F.col("before") != F.col("after")).alias("ring_moved"))


def _balance(s: SparkSession, d: str) -> DataFrame:
    """Ring balance over the ideal: nodes without a key don't show."""
    c = ring.owners(_keys(s, d), _ring(s, 4)).groupBy("owner").count().agg(F.min("count").alias("least"), F.max("count").alias("most"), F.sum("count").alias("n"))
    return c.select(F.round(F.col("least") * 4 / F.col("n"), 6).alias("min_over_ideal"), F.round(F.col("most") * 4 / F.col("n"), 6).alias("max_over_ideal"))


def _weights(s: SparkSession, d: str) -> DataFrame:
    """Points by node after node-1 is replaced with three times the weight, and node-0 taken out."""
    nodes = ring.without_node(ring.with_node(ring.nodes(s, ["node-0", "node-1", "node-2"]), "node-1", 3), "node-0")
    return ring.points(nodes).groupBy("node").agg(F.count(F.lit(1)).alias("points"), F.min("hash").alias("first"))


_WEIGHTS_SQL = "WITH " + murmur_sql("SELECT 'node-' || a || '#' || i AS x FROM (VALUES (1), (2)) t(a), range(480) u(i) WHERE a = 1 OR i < 160") + " SELECT split_part(x, '#', 1) AS node, count(*) AS points, min(h) AS first FROM hashed GROUP BY 1"


def _days(s: SparkSession, d: str) -> DataFrame:
    return _samples(s, d).groupBy("event_type", "run", F.floor(F.col("ts_ms") / 86_400_000).cast("long").alias("second")).agg(F.count(F.lit(1)).alias("n"))


def _fsyncs(s: SparkSession, d: str) -> DataFrame:
    rows = _samples(s, d).groupBy("event_type", F.col("run").alias("rep")).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("ns") % 9 == 0).alias("fsyncs"))
    return loadstats.per_fsync(rows, ["event_type"]).withColumn("records_per_fsync", F.round("records_per_fsync", 6))


def _runs(s: SparkSession, d: str) -> DataFrame:
    """CPU seconds by thread (event_type) of each run, over a wall of 10 s more than the run's number."""
    per = _samples(s, d).groupBy("run", "event_type").agg((F.sum(F.col("ns") % 1000) / 1000.0).alias("s"))
    return per.groupBy("run").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "s")))).alias("cpu")).select((F.col("run") % 2).alias("half"), "cpu", (F.col("run") + 10.0).alias("wall_s"))  # five names


def _threads(s: SparkSession, d: str) -> DataFrame:
    t = _samples(s, d).groupBy("event_type", "run").agg(F.count(F.lit(1)).alias("requests"), *[F.count_if(F.col("ns") % 3 == i).alias(f"p{i}") for i in range(3)])
    return loadstats.totals(t.withColumn("series", F.array("p0", "p1", "p2")), ["event_type"], ["requests"], "series")


def _profile(s: SparkSession, d: str) -> DataFrame:
    e = src.events(s, d)
    k = F.get_json_object("props", "$.k").cast("long")
    hexed = lambda c: F.lower(F.hex(c))
    line = F.concat_ws(" ", "event_type", F.lit("3"), hexed(F.col("user_id") % 7 + 256), hexed(k % 5 + 256), hexed(F.col("user_id") % 7 + 256))
    symbols = s.createDataFrame([("100", "main"), ("101", "parse"), ("102", "parse"), ("104", "hash")], "address string, symbol string")
    return loadstats.profile(e.select(line.alias("line")), symbols)


def _lines(s: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("threads="), (F.col("user_id") % 6).cast("string"), F.lit(",type="), F.col("event_type"))
    got = loadstats.key_values(src.events(s, d).select(line.alias("line")))
    return got.groupBy(F.col("fields")["type"].alias("type"), F.col("fields")["threads"].cast("int").alias("threads")).agg(F.count(F.lit(1)).alias("n"))


def _more_scalars(s: SparkSession, d: str) -> DataFrame:
    ns = F.col("ns")
    return _samples(s, d).select("ns", scalars.key_name(ns).alias("key"), scalars.lease_bound(ns % 100_000, 0.01, 50).alias("granter_ms"), scalars.lease_held(ns % 100_000, 0.01).alias("holder_ms"), commands.ttl_ms(ns.cast("string"), ns % 2 == 0).alias("ttl_ms"),
                                 scalars.resp_array(F.array(scalars.resp_integer(ns), scalars.resp_simple(F.col("event_type")))).alias("reply"))


SEGMENT = 100


def _segments(s: SparkSession, d: str) -> DataFrame:
    """The effective log with the name of the segment that holds each record."""
    log = kv.effective_log(src.command_log(s, d))
    return log.withColumn("file", F.format_string("wal-%010d.log", F.floor(F.col("offset") / SEGMENT).cast("long")))


def _recovery(s: SparkSession, d: str) -> DataFrame:
    """Recovery from the snapshot at the middle segment and the segments from there on."""
    log = _segments(s, d).withColumn("id", F.regexp_extract("file", r"^wal-(\d{10})\.log$", 1).cast("long"))
    at = log.agg(F.floor(F.max("id") / 2).alias("at"))
    log = log.join(F.broadcast(at))  # one row
    snapshot = kv.replay(log.where("id < at").drop("id", "at", "file"), 0).select(F.lit(-1).cast("long").alias("offset"), F.lit("SET").alias("op"), "key", "value", F.col("deadline_ms").alias("at_ms"))
    # the manifest's count must be that of the SETs
    good = snapshot.agg(F.count(F.lit(1)).alias("sets"), F.count_if(F.col("op") != "SET").alias("others")).select((F.col("others") == 0).alias("snapshot_loaded"))
    tail = log.where("id >= at")
    keys = kv.replay(snapshot.unionByName(tail.select(*snapshot.columns)), AT_END).agg(F.count(F.lit(1)).alias("keys"))
    stats = tail.agg(F.count_distinct("file").alias("segments"), F.count(F.lit(1)).alias("records"), F.count_if((F.col("op") == "SET") & (F.col("at_ms") <= AT_END)).alias("expired"))
    return stats.join(F.broadcast(keys)).join(F.broadcast(good)).select("snapshot_loaded", "keys", "segments", "records", "expired")


RECOVERY_SQL = _fold(AT_END) + f""", r AS (SELECT *, seq // {SEGMENT} AS id FROM s WHERE eff), t AS (SELECT * FROM r WHERE id >= (SELECT max(id) // 2 FROM r))
SELECT true AS snapshot_loaded, (SELECT count(*) FROM z WHERE held AND (d IS NULL OR d > {AT_END})) AS keys, count(DISTINCT id) AS segments, count(*) AS records, count(*) FILTER (WHERE op = 'SET' AND d <= {AT_END}) AS expired FROM t"""

QUERIES = {
    "cmd_validate": (_validate, VALIDATE_SQL),
    "cmd_del_many": (_del_many, _fold(AS_OF) + f", h AS (SELECT key FROM z WHERE held AND (d IS NULL OR d > {AS_OF})), q AS (SELECT event_id AS seq, 'user:{{' || unnest([user_id, user_id + 1]) || '}}' AS key FROM events) SELECT seq, count(h.key) AS removed FROM q LEFT JOIN h USING (key) GROUP BY seq"),
    "kv_scan": (lambda s, d: kv.state(src.command_log(s, d), AS_OF).select("key", "value", F.coalesce(F.col("deadline_ms") - AS_OF, F.lit(-1)).cast("long").alias("ttl_ms")), _fold(AS_OF) + f"SELECT key, val AS value, coalesce(d - {AS_OF}, -1)::BIGINT AS ttl_ms FROM z WHERE held AND (d IS NULL OR d > {AS_OF})"),
    "rl_wrongtype": (_wrongtype, _fold(AT_END) + f"SELECT key, CASE WHEN held AND (d IS NULL OR d > {AT_END}) AND NOT val LIKE '%0' THEN 'WRONGTYPE key holds a value that is not a rate limiter bucket' END AS error FROM z"),
    "kv_info": (_info, _fold(AT_END) + "SELECT count(*) AS commands, count(*) FILTER (WHERE op = 'GET') AS gets, count(*) FILTER (WHERE op = 'GET' AND live) AS hits, count(*) FILTER (WHERE eff) AS mutations FROM s WHERE rn > 0"),
    "cluster_dbsize": (lambda s, d: cluster.sizes(_held(s, d)), f"WITH {_TWO} SELECT count(*) AS keys, count(DISTINCT key) AS distinct_keys FROM held"),
    "cluster_keys": (lambda s, d: cluster.keys(_held(s, d), scalars.glob_regex("*1?")), f"WITH {_TWO} SELECT DISTINCT key FROM held WHERE regexp_full_match(key, '.*1.')"),
    "cluster_read": (lambda s, d: cluster.read(cluster.routed(_keys(s, d), _ring(s, 4), _ring(s, 3)), _held(s, d)), _PLACED + " SELECT key, CASE WHEN nh THEN nv ELSE bv END AS value, CASE WHEN nh THEN now WHEN bh THEN before END AS served_by FROM p"),
    "cluster_routes": (_routes, _PLACED + """ SELECT key, op, CASE WHEN now = before THEN now WHEN op = 'GET' THEN CASE WHEN nh THEN now ELSE now || ',' || before END WHEN op = 'SET' THEN before || ',' || now WHEN op = 'DEL' THEN now || ',' || before
  WHEN op = 'RL.ACQUIRE' THEN CASE WHEN nh OR NOT bh THEN now ELSE before END ELSE CASE WHEN nh THEN now ELSE before END END AS targets FROM p, (VALUES ('GET'), ('SET'), ('DEL'), ('RL.ACQUIRE'), ('EXPIRE')) t(op)"""),
    "cluster_migrate": (_migration, _MOVES + " SELECT * FROM m"),
    "cluster_migrate_report": (lambda s, d: cluster.report(_migration(s, d)), _MOVES + " SELECT count(*) AS scanned, count(*) FILTER (WHERE outcome = 'moved') AS moved, count(*) FILTER (WHERE outcome = 'superseded') AS superseded, count(*) FILTER (WHERE outcome = 'vanished') AS vanished FROM m"),
    "ring_add_hits": (lambda s, d: ring.moves(_keys(s, d), _ring(s, 3), _ring(s, 4)).groupBy("after").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("before") == F.col("after")).alias("hits")), f"WITH {_TWO} SELECT now AS after, count(*) AS keys, count(*) FILTER (WHERE now = before) AS hits FROM own GROUP BY now"),
    "ring_modulo": (_modulo, f"WITH {_TWO}, h AS (WITH {murmur_sql('SELECT c_name AS x FROM customer')} SELECT x AS key, ('0x' || h)::UBIGINT AS u FROM hashed) SELECT count(*) AS keys, count(*) FILTER (WHERE u % 3 <> u % 4) AS modulo_moved, count(*) FILTER (WHERE now <> before) AS ring_moved FROM own JOIN h USING (key)"),
    "ring_over_ideal": (_balance, f"WITH {_ring_sql(4)}, c AS (SELECT owner, count(*) AS n FROM owned GROUP BY owner) SELECT round(min(n) * 4 / sum(n)::DOUBLE, 6) AS min_over_ideal, round(max(n) * 4 / sum(n)::DOUBLE, 6) AS max_over_ideal FROM c"),
    "ring_info": (lambda s, d: ring.shares(_ring(s, 5)).select("node", F.format_string("%.4f", "share").alias("share")), None),
    "ring_weights": (_weights, _WEIGHTS_SQL),
    "recovery_stats": (_recovery, RECOVERY_SQL),
    "intra_run_cv": (lambda s, d: loadstats.intra_run_cv(_days(s, d), ["event_type", "run"]).withColumn("cv_pct", F.round("cv_pct", 6)),
                     f"WITH {SAMPLES}, c AS (SELECT event_type, run, ts_ms // 86400000 AS day, count(*) AS n FROM samples GROUP BY ALL), w AS (SELECT *, max(day) OVER (PARTITION BY event_type, run) AS l, count(*) OVER (PARTITION BY event_type, run) AS k FROM c) SELECT event_type, run, round(CASE WHEN max(k) < 2 OR count(*) FILTER (WHERE k <= 2 OR day < l) < 2 THEN 0.0 ELSE stddev_samp(n) FILTER (WHERE k <= 2 OR day < l) / avg(n) FILTER (WHERE k <= 2 OR day < l) * 100 END, 6) AS cv_pct FROM w GROUP BY ALL"),
    "reproducibility": (lambda s, d: loadstats.reproducibility(_samples(s, d), ["event_type"], "run", "ns").select("configs", *[F.round(c, 6).alias(c) for c in ("median_pct", "p90_pct", "worst_pct")]),
                        f"WITH {SAMPLES}, m AS (SELECT event_type, run, median(ns::DOUBLE) AS m FROM samples GROUP BY ALL), d AS (SELECT (max(m) - min(m)) / avg(m) * 100 AS d FROM m GROUP BY event_type) SELECT count(*) AS configs, round(median(d), 6) AS median_pct, round(list_sort(list(d))[floor(0.9::DOUBLE * (count(*) - 1))::INTEGER + 1], 6) AS p90_pct, round(max(d), 6) AS worst_pct FROM d"),
    "across_binaries": (lambda s, d: loadstats.across(loadstats.variants(_samples(s, d), ["event_type", "run"], "ns"), ["event_type"], "run", 0, 1).withColumn("change_pct", F.round("change_pct", 6)), f"WITH {SAMPLES}, m AS (SELECT event_type, run, median(ns::DOUBLE) AS m FROM samples GROUP BY ALL) SELECT a.event_type, a.m AS median_a, b.m AS median_b, round((b.m - a.m) / a.m * 100, 6) AS change_pct FROM m a JOIN m b USING (event_type) WHERE a.run = 0 AND b.run = 1"),
    "records_per_fsync": (_fsyncs, f"WITH {SAMPLES}, r AS (SELECT event_type, run, count(*) AS n, count(*) FILTER (WHERE ns % 9 = 0) AS f FROM samples GROUP BY ALL) SELECT event_type, round(n / nullif(f, 0)::DOUBLE, 6) AS records_per_fsync FROM r QUALIFY run = max(run) OVER (PARTITION BY event_type)"),
    "cores": (lambda s, d: loadstats.cores(_runs(s, d), ["half"]).withColumn("cores", F.round("cores", 6)), f"WITH {SAMPLES}, r AS (SELECT run, sum(ns % 1000) / 1000.0::DOUBLE / (run + 10.0) AS c FROM samples GROUP BY run) SELECT run % 2 AS half, round(median(c), 6) AS cores FROM r GROUP BY 1"),
    "thread_medians": (lambda s, d: loadstats.thread_medians(_runs(s, d), ["half"]).withColumn("seconds", F.round("seconds", 6)), f"WITH {SAMPLES}, r AS (SELECT run, event_type, sum(ns % 1000) / 1000.0::DOUBLE AS s FROM samples GROUP BY ALL) SELECT run % 2 AS half, event_type AS thread, round(median(s), 6) AS seconds FROM r GROUP BY ALL"),
    "thread_totals": (_threads, f"WITH {SAMPLES} SELECT event_type, place::INTEGER AS place, (count(*) FILTER (WHERE ns % 3 = place))::BIGINT AS n, count(*) AS requests FROM samples, range(3) t(place) GROUP BY ALL"),
    "diagnostics": (lambda s, d: loadstats.diagnostics(_samples(s, d), ["event_type"], "ns").withColumn("avg", F.round("avg", 4)), f"WITH {SAMPLES} SELECT event_type, count(ns) AS calls, sum(ns)::BIGINT AS total, round(avg(ns), 4) AS avg, max(ns) AS max FROM samples GROUP BY event_type"),
    "profile_symbols": (_profile, """WITH e AS (SELECT event_type AS tag, 256 + user_id % 7 AS a, 256 + (props->>'$.k')::BIGINT % 5 AS b FROM events), f AS (SELECT tag, a AS x, 1 AS top FROM e UNION ALL SELECT tag, b, 0 FROM e WHERE a <> b)
SELECT tag, CASE x WHEN 256 THEN 'main' WHEN 257 THEN 'parse' WHEN 258 THEN 'parse' WHEN 260 THEN 'hash' ELSE lower(to_hex(x)) END AS name, sum(top)::BIGINT AS self, count(*) AS inclusive FROM f GROUP BY ALL"""),
    "key_value_lines": (_lines, "SELECT event_type AS type, (user_id % 6)::INTEGER AS threads, count(*) AS n FROM events GROUP BY ALL"),
    "reply_round_trip": (_replies, """SELECT event_id AS row, o::BIGINT AS ordinal, path, kind, CASE k WHEN 0 THEN 'OK' WHEN 1 THEN 'ERR ' || event_type WHEN 2 THEN (-event_id)::VARCHAR WHEN 3 THEN '3' WHEN 4 THEN event_type WHEN 6 THEN '1' WHEN 7 THEN user_id::VARCHAR END AS value, 'ok' AS status
FROM events, (VALUES (0, 0, '', 'simple'), (1, 1, '', 'error'), (2, 2, '', 'int'), (3, 3, '', 'array'), (4, 3, '0', 'bulk'), (5, 3, '1', 'null'), (6, 3, '2', 'array'), (7, 3, '2.0', 'int')) t(k, o, path, kind)"""),
    "record_segments": (_packed, "SELECT 'SET user:' || user_id || ' ' || event_type AS payload, 'ok' AS status, count(*) AS n FROM events GROUP BY ALL"),
    "more_scalars": (_more_scalars, f"WITH {SAMPLES} SELECT ns, 'key:' || lpad(ns::VARCHAR, greatest(10, length(ns::VARCHAR))::INTEGER, '0') AS key, trunc((ns % 100000) * 1.01::DOUBLE)::BIGINT + 50 AS granter_ms, trunc((ns % 100000) * 0.99::DOUBLE)::BIGINT AS holder_ms, CASE WHEN ns % 2 = 0 THEN CASE WHEN ns <= 1000000000 THEN ns * 1000 END WHEN ns <= 1000000000000 THEN ns END AS ttl_ms, '*2' || chr(13) || chr(10) || ':' || ns || chr(13) || chr(10) || '+' || event_type || chr(13) || chr(10) AS reply FROM samples"),
}
