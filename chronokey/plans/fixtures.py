"""Queries over small literal relations: members, links, probes and audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import audit, replication

#: (columns, rows) of each relation.
LINKS = ("shard INT, rid STRING, state STRING, acked BIGINT, ack_age_ms BIGINT", "(0,'a','streaming',90,10), (0,'a','streaming',95,10), (0,'b','streaming',80,1500), (0,'c','streaming',99,1501), (0,'d','sync',100,1), (1,'a','streaming',7,3), (2,'x','sync',1,1)")
MEMBERS = ("shard INT, member INT, name STRING, role STRING, reachable BOOLEAN, epoch BIGINT, replid STRING, offset BIGINT, fenced BOOLEAN, synced BOOLEAN, lease_valid BOOLEAN, synced_replicas INT, safe_expiry_ms BIGINT, shard_epoch BIGINT, shard_replid STRING",
           "(0,0,'n0','master',true,4,'r1',50,false,true,true,2,100,4,'r1'), (0,1,'n1','slave',true,4,'r1',48,false,true,false,0,100,4,'r1'), (0,2,'n2','slave',true,4,'r1',48,false,true,false,0,100,4,'r1'), (0,3,'n3','slave',true,3,'r1',60,false,true,false,0,100,4,'r1'), (1,0,'m0','master',false,7,'r2',10,false,true,true,1,900,7,'r2'), (1,1,'m1','slave',true,7,'r2',9,false,false,false,0,900,7,'r2'), (1,2,'m2','slave',true,7,'r2',8,false,true,false,0,900,7,'r2'), (2,0,'k0','master',true,2,'r3',5,true,true,true,1,50,2,'r3'), (2,1,'k1','master',true,2,'r3',5,false,true,false,1,50,2,'r3'), (3,0,'j0','master',true,9,'r4',5,false,true,true,0,50,9,'r4')")
PERSISTED = ("shard INT, persisted_epoch BIGINT", "(0,4), (1,8), (2,1)")
PROBES = ("shard INT, at_ms BIGINT, ok BOOLEAN", "(0,1,true),(0,2,false),(0,3,false),(0,4,true),(0,5,false),(1,1,false),(1,2,false),(1,3,false),(1,4,false),(2,1,true)")
LAST = ("shard INT, last_offset BIGINT", "(0,120),(1,9),(2,1)")
REPLICAS = ("shard INT, name STRING, replid STRING, next_offset BIGINT", "(0,'n1','r1',40),(0,'n2','r0',21),(0,'n3','r0',30),(0,'n4','r1',5),(0,'n5','zz',40)")
LOGS = ("shard INT, log_replid STRING, prev_id STRING, end_offset BIGINT, first_offset BIGINT, last_offset BIGINT", "(0,'r1','r0',20,10,60)")
BATCHES = ("conn INT, seq INT, durable BOOLEAN, offset BIGINT, acked BIGINT, lease_valid BOOLEAN", "(1,1,true,5,9,true),(1,2,false,6,9,true),(1,3,true,7,9,true),(2,1,true,9,9,true),(2,2,true,10,9,true),(3,1,true,1,9,false)")
BACKLOG = ("replid STRING, offset BIGINT, size BIGINT", "('r1',1,100),('r1',2,52),('r1',3,30),('r1',4,10),('r2',1,5000)")
CRASH = ("round INT, writer INT, i INT, acked BOOLEAN, present BOOLEAN, value_ok BOOLEAN", "(1,0,1,true,true,true),(1,0,2,true,false,false),(1,0,3,false,true,true),(1,1,1,true,true,false),(2,0,1,true,true,true),(2,0,2,true,false,false),(3,0,1,true,true,true)")
ACKED = ("key STRING, value STRING", "('a','1'),('b','2'),('c','3')")
HELD = ("key STRING, value STRING", "('a','1'),('b','9'),('d','4')")
DELETED = ("key STRING", "('d'),('e')")
GRANTED = ("bucket STRING, granted BIGINT, elapsed_s DOUBLE", "('x',504,3980.0),('y',506,3980.0)")


def _df(spark: SparkSession, t: tuple[str, str]) -> DataFrame:
    names = [c.split()[0] for c in t[0].split(", ")]
    kinds = [c.split()[1] for c in t[0].split(", ")]
    cast = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True))
    return spark.sql(f"SELECT {cast} FROM VALUES {t[1]} AS t({', '.join(names)})")


def _sql(name: str, t: tuple[str, str]) -> str:
    cols = [c.split() for c in t[0].split(", ")]
    cast = ", ".join(f'"{n}"::{k.replace("STRING", "VARCHAR")} AS "{n}"' for n, k in cols)
    heads = ", ".join(f'"{n}"' for n, _ in cols)
    return f"{name} AS (SELECT {cast} FROM (VALUES {t[1]}) t({heads}))"


def _q(f: Callable[..., DataFrame], *tables: tuple[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, _: f(*[_df(spark, t) for t in tables])


_M, _L = "WITH " + _sql("m", MEMBERS), "WITH " + _sql("l", LINKS)
QUERIES = {
    "quorum_acked": (_q(lambda t: replication.quorum_acked(t, 2), LINKS), _L + ", b AS (SELECT shard, rid, max(acked) AS a FROM l WHERE state = 'streaming' AND ack_age_ms <= 1500 GROUP BY ALL), g AS (SELECT shard, count(*) AS n, list(a ORDER BY a DESC) AS v FROM b GROUP BY shard) SELECT s.shard, coalesce(n, 0) AS synced, coalesce(v[2], 0) AS acked FROM (SELECT DISTINCT shard FROM l) s LEFT JOIN g USING (shard)"),
    "replica_lag": (_q(replication.lag, LINKS, LAST), _L + ", " + _sql("e", LAST) + " SELECT shard, rid, last_offset - acked AS lag FROM l JOIN e USING (shard)"),
    "write_gate": (_q(lambda t: replication.write_gate(t, 1), MEMBERS), _M + " SELECT shard, name, CASE WHEN role <> 'master' THEN 'READONLY replica' WHEN fenced THEN 'READONLY fenced' WHEN NOT lease_valid THEN 'READONLY lease' WHEN synced_replicas < 1 THEN 'NOREPLICAS' ELSE 'OK' END AS verdict FROM m"),
    "read_gate": (_q(replication.read_gate, MEMBERS), _M + " SELECT shard, name, CASE WHEN role <> 'master' AND NOT synced THEN 'LOADING' WHEN role = 'master' AND NOT lease_valid THEN 'NOLEASE' ELSE 'OK' END AS verdict FROM m"),
    "discover_primary": (_q(replication.discover, MEMBERS, PERSISTED), _M + ", " + _sql("p", PERSISTED) + ", u AS (SELECT *, max(epoch) OVER (PARTITION BY shard) AS top FROM m WHERE reachable), g AS (SELECT shard, top AS epoch, count(*) FILTER (WHERE role = 'master') AS c, max(name) FILTER (WHERE role = 'master') AS a, max(name) FILTER (WHERE member = 0) AS f FROM u WHERE epoch = top GROUP BY shard, top) SELECT shard, epoch, CASE WHEN epoch < coalesce(persisted_epoch, 0) THEN NULL WHEN c = 1 THEN a WHEN c = 0 THEN f END AS \"primary\" FROM g LEFT JOIN p USING (shard)"),
    "failure_detection": (_q(lambda t: replication.failed(t, 3), PROBES), "WITH " + _sql("p", PROBES) + ", r AS (SELECT shard, at_ms - row_number() OVER (PARTITION BY shard ORDER BY at_ms) AS g FROM p WHERE NOT ok), c AS (SELECT shard, g, count(*) AS n FROM r GROUP BY ALL) SELECT s.shard, coalesce(max(n), 0) AS longest, coalesce(max(n), 0) >= 3 AS failed FROM (SELECT DISTINCT shard FROM p) s LEFT JOIN c USING (shard) GROUP BY s.shard"),
    "promotion_choice": (_q(lambda t: replication.promote(t, 2, 1, 500), MEMBERS), _M + ", e AS (SELECT *, count(*) OVER (PARTITION BY shard) AS n FROM m WHERE reachable AND role = 'slave' AND synced AND epoch = shard_epoch AND replid = shard_replid AND safe_expiry_ms <= 500) SELECT shard, name, \"offset\" FROM e WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY shard ORDER BY \"offset\" DESC, name) = 1"),
    "reconcile": (_q(lambda m, p: replication.reconcile(m, replication.discover(m, p)), MEMBERS, PERSISTED), _M + " SELECT shard, name FROM m WHERE shard IN (0, 3) AND reachable AND name NOT IN ('n0', 'j0') AND (role = 'master' OR epoch < shard_epoch)"),
    "resync_mode": (_q(replication.resync, REPLICAS, LOGS), "WITH " + _sql("r", REPLICAS) + ", " + _sql("l", LOGS) + " SELECT shard, name, CASE WHEN (replid = log_replid OR (replid = prev_id AND next_offset - 1 <= end_offset)) AND next_offset BETWEEN first_offset AND last_offset + 1 THEN 'partial' ELSE 'full' END AS mode FROM r JOIN l USING (shard)"),
    "released_replies": (_q(replication.released, BATCHES), "WITH " + _sql("b", BATCHES) + " SELECT conn, seq FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.conn = x.conn AND y.seq <= x.seq AND NOT (y.durable AND y.\"offset\" <= y.acked AND y.lease_valid))"),
    "backlog_trim": (_q(lambda t: replication.trim(t, 260), BACKLOG), "WITH " + _sql("b", BACKLOG) + ", r AS (SELECT replid, \"offset\", sum(size + 48) OVER (PARTITION BY replid ORDER BY \"offset\" DESC)::BIGINT AS held, row_number() OVER (PARTITION BY replid ORDER BY \"offset\" DESC) AS r FROM b) SELECT replid, \"offset\", held FROM r WHERE held <= 260 OR r = 1"),
    "log_read": (_q(lambda t: replication.read_from(t, 2, 60), BACKLOG), "WITH " + _sql("b", BACKLOG) + ", r AS (SELECT replid, \"offset\", sum(size) OVER (PARTITION BY replid ORDER BY \"offset\")::BIGINT AS sent, row_number() OVER (PARTITION BY replid ORDER BY \"offset\") AS r FROM b WHERE \"offset\" >= 2) SELECT replid, \"offset\", sent FROM r WHERE sent <= 60 OR r = 1"),
    "crash_audit": (_q(audit.crash, CRASH), "WITH " + _sql("c", CRASH) + ", w AS (SELECT round, writer, count(*) FILTER (WHERE acked AND NOT present) AS lost, min(i) FILTER (WHERE acked AND NOT present) AS g, max(i) FILTER (WHERE present) AS l, count(*) FILTER (WHERE present AND NOT value_ok) AS corrupt FROM c GROUP BY ALL) SELECT round, sum(lost)::BIGINT AS lost, count(*) FILTER (WHERE g < l) AS holes, sum(corrupt)::BIGINT AS corrupt FROM w GROUP BY round"),
    "audit_model": (_q(audit.audit, ACKED, HELD, DELETED), "WITH " + _sql("a", ACKED) + ", " + _sql("h", HELD) + ", " + _sql("d", DELETED) + " SELECT 'missing' AS problem, key FROM a WHERE key NOT IN (SELECT key FROM h) UNION ALL SELECT 'wrong', a.key FROM a JOIN h USING (key) WHERE a.value <> h.value UNION ALL SELECT 'resurrected', key FROM d WHERE key IN (SELECT key FROM h)"),
    "bucket_bound": (_q(lambda t: audit.bucket_bound(t, 500, 0.001), GRANTED), "WITH " + _sql("g", GRANTED) + " SELECT * FROM g WHERE granted > 500 + 0.001::DOUBLE * elapsed_s + 1"),
}
