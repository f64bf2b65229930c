"""Replication: gates, arbitration, routing, acknowledgements, closures, chunks and the inbox stream (R*, N*, J15-J18)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import closure as fk
from ..operators import replication as r
from ..functions.hashing import fingerprint
from ..sources.registry import test_catalogue
from ..streaming import inbox
from .common import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Events as changes: the user is the origin, each has contiguous sequences; every 17th event never arrived.
LOG = """SELECT cast(user_id AS {text}) AS origin, cast(1 AS BIGINT) AS epoch, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq, event_id AS local_seq,
    event_type, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS rank, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op,
    cast(event_id % 97 AS {text}) AS pk, cast(length(props) AS BIGINT) AS byte_size, cast(event_id % 3 AS BIGINT) AS schema_ver, props AS payload FROM events"""


def log(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(LOG.format(text="STRING"))


_LOG = f"WITH log AS ({LOG.format(text='VARCHAR')})"
_GATE = _LOG + """, g AS (SELECT * FROM log WHERE local_seq % 17 <> 0), a AS (SELECT origin, seq % 2 * 0 + 3 AS applied FROM log GROUP BY ALL),
f AS (SELECT g.*, 3 AS applied, sum(CASE WHEN seq > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY origin ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM g),
d AS (SELECT *, CASE WHEN seq <= 3 THEN 'noop' WHEN seq = 3 + k THEN 'apply' ELSE 'gap' END AS decision FROM f)"""


def _gated(spark, sf_dir):
    changes = log(spark, sf_dir).filter("local_seq % 17 <> 0")
    vector = changes.select("origin", "epoch").distinct().withColumn("applied_seq", F.lit(3).cast("long"))
    return r.applicable(changes, vector)


@query(_GATE + " SELECT local_seq, origin, seq, decision FROM d")
def seq_gate(spark, sf_dir):
    """Three changes of each origin were applied before; gaps stop what follows."""
    return _gated(spark, sf_dir).select("local_seq", "origin", "seq", "decision")


@query(_LOG + """, g AS (SELECT * FROM log WHERE local_seq % 17 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq) AS k FROM g),
s AS (SELECT origin, coalesce(max(CASE WHEN seq = k THEN seq END), 0) AS applied_seq, count(*) FILTER (WHERE seq <> k) AS waiting FROM k GROUP BY 1)
SELECT origin, applied_seq, waiting, coalesce(CASE WHEN waiting > 0 THEN applied_seq + 1 END, -1) AS missing_seq FROM s""")
def gap_report(spark, sf_dir):
    found = r.gap_report(log(spark, sf_dir).filter("local_seq % 17 <> 0"))
    return found.select("origin", "applied_seq", "waiting", F.coalesce("missing_seq", F.lit(-1).cast("long")).alias("missing_seq"))


_WIN = _LOG + """, w AS (SELECT pk, origin, seq, rank, op, local_seq, row_number() OVER (PARTITION BY pk ORDER BY rank DESC, seq DESC, origin DESC) AS n FROM log)"""


@query(_WIN + " SELECT pk, origin, seq, rank, local_seq FROM w WHERE n = 1 AND op <> 'D'")
def arbitration_winner(spark, sf_dir):
    """Rank, then sequence, then origin decide; a maximum, so the order of arrival does not."""
    return r.winners(log(spark, sf_dir), ["pk"]).select("pk", "origin", "seq", "rank", "local_seq")


@query(_LOG.replace("WHEN 'purchase' THEN 3", "WHEN 'error' THEN 4 WHEN 'purchase' THEN 3") + ", w AS (SELECT pk, origin, seq, op, row_number() OVER (PARTITION BY pk, seq % 10 ORDER BY rank DESC, seq DESC, origin DESC) AS n, seq % 10 AS slot FROM log) SELECT pk, slot, origin, seq, op FROM w WHERE n = 1")
def arbitration_delete(spark, sf_dir):
    """Deletes take part in the fold as tombstones."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    changes = spark.sql(LOG.format(text="STRING").replace("WHEN 'purchase' THEN 3", "WHEN 'error' THEN 4 WHEN 'purchase' THEN 3")).withColumn("slot", F.col("seq") % 10)
    return r.winners(changes, ["pk", "slot"], keep_tombstones=True).select("pk", "slot", "origin", "seq", "op")


_SIDES = _LOG + ", l AS (SELECT pk, max_by(local_seq, seq * 100000 + local_seq) AS mine FROM log WHERE op = 'U' AND local_seq % 2 = 0 GROUP BY 1), i AS (SELECT pk, max_by(local_seq, seq * 100000 + local_seq) AS theirs FROM log WHERE op = 'U' AND local_seq % 3 = 0 GROUP BY 1)"


def _sides(spark, sf_dir):
    changes = log(spark, sf_dir).filter("op = 'U'").select("pk", "origin", "seq", "rank", "op", "local_seq")
    last = lambda df: df.groupBy("pk").agg(F.max_by(F.struct("origin", "seq", "rank", "op", "local_seq"), F.col("seq") * 100000 + F.col("local_seq")).alias("w")).select("pk", "w.*")
    return last(changes.filter("local_seq % 2 = 0")), last(changes.filter("local_seq % 3 = 0"))


@query(_SIDES + " SELECT pk, coalesce(mine, theirs) AS local_seq FROM l FULL JOIN i USING (pk)")
def policy_target_wins(spark, sf_dir):
    return r.resolve(*_sides(spark, sf_dir), ["pk"], "TargetWins").select("pk", "local_seq")


@query(_SIDES + " SELECT pk, coalesce(theirs, mine) AS local_seq FROM l FULL JOIN i USING (pk)")
def policy_authoritative(spark, sf_dir):
    """What the center sends replaces the edge's rows."""
    return r.resolve(*_sides(spark, sf_dir), ["pk"], "SourceWins", authoritative=True).select("pk", "local_seq")


@query(_LOG + " SELECT schema_ver = 2 AND local_seq % 5 <> 0 AS accepted, count(*) AS n, CAST(min(local_seq) AS BIGINT) AS first_seq FROM log GROUP BY 1")
def schema_guard_split(spark, sf_dir):
    """Version and fingerprint must match; a null fingerprint never does."""
    changes = log(spark, sf_dir).withColumn("schema_fp", F.expr("CASE WHEN local_seq % 10 = 0 THEN NULL WHEN local_seq % 5 = 0 THEN 'other' ELSE 'same' END"))
    return r.guard(changes, 2, "same").groupBy("accepted").agg(F.count(F.lit(1)).alias("n"), F.min("local_seq").alias("first_seq"))


@query(_LOG + " SELECT origin, seq, schema_ver FROM log WHERE schema_ver <= 1")
def quarantine_replay(spark, sf_dir):
    """Of what version 2 kept out (twice delivered, kept once), version 1 may replay the older part."""
    changes = log(spark, sf_dir).withColumn("schema_fp", F.lit("same"))
    return r.replayable(r.quarantine(changes.union(changes), 2, "same"), 1).select("origin", "seq", "schema_ver")


_ACKS = """, p AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS peer FROM events WHERE user_id % 40 = 0),
a AS (SELECT peer, origin, CAST(5 + length(peer) AS BIGINT) AS acked FROM p, (SELECT DISTINCT origin FROM log) WHERE (CAST(origin AS INTEGER) + CAST(peer AS INTEGER)) % 3 > 0)"""


def _acks(spark, sf_dir):
    changes = log(spark, sf_dir)
    peers = spark.sql("SELECT DISTINCT cast(user_id AS STRING) AS peer FROM events WHERE user_id % 40 = 0")
    # each origin comes to as many rows as there are peers, which Spark can't see from the origins' own size: all partitions are kept
    origins = changes.select("origin", "epoch").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "origin")
    acks = origins.crossJoin(r.listed(peers)).select("origin", "epoch", F.explode("_everyone").alias("peer")).filter("(cast(origin AS INT) + cast(peer AS INT)) % 3 > 0").withColumn("acked_seq", (5 + F.length("peer")).cast("long"))
    return changes, peers, acks


@query(_LOG + _ACKS + " SELECT p.peer, log.local_seq FROM log JOIN p ON origin <> p.peer LEFT JOIN a ON a.peer = p.peer AND a.origin = log.origin WHERE seq > coalesce(acked, -1)")
def anti_echo_route(spark, sf_dir):
    """Nothing goes back to its origin, nor what a peer has acknowledged."""
    changes, peers, acks = _acks(spark, sf_dir)
    return r.outgoing(changes, peers, acks).select("peer", "local_seq")


@query(_LOG + _ACKS + """, o AS (SELECT a2.peer, log.local_seq FROM log CROSS JOIN (SELECT DISTINCT peer FROM a) a2 LEFT JOIN a ON a.peer = a2.peer AND a.origin = log.origin WHERE seq > coalesce(acked, -1))
SELECT a3.peer, CAST(coalesce(min(local_seq) - 1, (SELECT max(local_seq) FROM log)) AS BIGINT) AS watermark FROM (SELECT DISTINCT peer FROM a) a3 LEFT JOIN o ON o.peer = a3.peer GROUP BY 1""")
def outbound_watermark(spark, sf_dir):
    changes, _, acks = _acks(spark, sf_dir)
    return r.outbound_watermark(changes, acks)


@query("SELECT CAST(user_id % 7 AS VARCHAR) AS peer, event_type AS origin, CAST(1 AS BIGINT) AS epoch, max(event_id % 1000) AS acked_seq, max(event_id) AS last_ack FROM events GROUP BY 1, 2")
def ack_vector(spark, sf_dir):
    """Acknowledgements arrive in any order; the vector is monotone."""
    acks = table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("string").alias("peer"), F.col("event_type").alias("origin"), F.lit(1).cast("long").alias("epoch"), (F.col("event_id") % 1000).alias("acked_seq"), F.col("event_id").alias("ts"))
    return r.ack_vector(acks)


@query("WITH v AS (SELECT user_id % 7 AS p, event_type AS o, max(event_id % 1000) AS acked FROM events GROUP BY 1, 2) SELECT CAST(p AS VARCHAR) AS peer, bool_and(acked >= 990 + p) AS done FROM v GROUP BY 1")
def ack_wait(spark, sf_dir):
    """A peer is done when it acknowledged every target."""
    vector = ack_vector(spark, sf_dir)
    targets = vector.select("peer", "origin", "epoch", (990 + F.col("peer").cast("long")).alias("target_seq"))
    return r.ack_wait(targets, vector)


@query(_LOG + _ACKS + " SELECT a2.peer, count(*) AS lag_seq, CAST(sum(byte_size) AS BIGINT) AS lag_bytes FROM log JOIN (SELECT DISTINCT peer FROM a) a2 ON origin <> a2.peer LEFT JOIN a ON a.peer = a2.peer AND a.origin = log.origin WHERE seq > coalesce(acked, -1) GROUP BY 1")
def lag_bytes(spark, sf_dir):
    changes, _, acks = _acks(spark, sf_dir)
    return r.lag(changes, acks)


@query("""WITH s AS (SELECT user_id, count(*) AS lag_seq, CAST(sum(length(props)) AS BIGINT) AS lag_bytes, CASE WHEN user_id % 3 > 0 THEN max(event_id) END AS lag_ms FROM events GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 50 = 0 OR lag_seq >= 80 OR lag_bytes >= 2000000 OR coalesce(lag_ms >= 9990, false) THEN 'Dead' WHEN lag_seq >= 68 OR lag_bytes >= 1500000 OR coalesce(lag_ms >= 9950, false) THEN 'Lagging' ELSE 'Healthy' END AS health FROM s""")
def peer_health(spark, sf_dir):
    lags = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("lag_seq"), F.sum(F.length("props")).alias("lag_bytes"), F.max(F.expr("CASE WHEN user_id % 3 > 0 THEN event_id END")).alias("lag_ms"))
    lags = lags.withColumn("evicted", F.col("user_id") % 50 == 0)
    return r.peer_health(lags, {"seq": 68, "bytes": 1_500_000, "ms": 9950}, {"seq": 80, "bytes": 2_000_000, "ms": 9990}).select("user_id", "health")


_STEPS = """s AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 300 = 7), o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM s)), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)),
u AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM s)), p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM s)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM u)), g AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))"""
_CLOSURE = f"WITH {_STEPS} SELECT 'orders' AS table_name, CAST(o_orderkey AS VARCHAR) AS pk, 3 AS depth FROM o UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 2 FROM c UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 2 FROM u UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 0 FROM p UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 1 FROM n UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 0 FROM g"


def _closure(spark, sf_dir, known=None):
    cat = test_catalogue(spark, sf_dir)
    selected = cat.frame("lineitem").filter("l_orderkey % 300 = 7")
    return cat, fk.closure(cat, "lineitem", selected, known)


@query(_CLOSURE)
def fk_closure(spark, sf_dir):
    """Everything that chosen order lines need, found up the foreign keys."""
    cat, rows = _closure(spark, sf_dir)
    return fk.closure_rows(cat, "lineitem", {t: f for t, f in rows.items() if t != "lineitem"}).select("table_name", "pk", "depth")


@query("WITH " + _STEPS.replace("c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o))", "c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o) AND c_custkey % 2 = 1)").replace("IN (SELECT l_suppkey FROM s)", "IN (SELECT l_suppkey FROM s) AND s_suppkey < 0") + _CLOSURE.partition(_STEPS)[2])
def fk_closure_pruned(spark, sf_dir):
    """Rows that the receiver has unchanged are left out, and so is what only they need."""
    cat = test_catalogue(spark, sf_dir)
    c, s = cat.frame("customer"), cat.frame("supplier")
    have = lambda df, name, key, fp: df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("pk"), fp.alias("fingerprint"))
    even = have(c.filter("c_custkey % 2 = 0"), "customer", "c_custkey", fingerprint(c))
    stale = have(c.filter("c_custkey % 2 = 1"), "customer", "c_custkey", F.lit("old"))
    cat, rows = _closure(spark, sf_dir, even.union(stale).union(have(s, "supplier", "s_suppkey", fingerprint(s))))
    return fk.closure_rows(cat, "lineitem", {t: f for t, f in rows.items() if t != "lineitem"}).select("table_name", "pk", "depth")


@query(f"WITH c AS ({_CLOSURE}) SELECT table_name, depth, count(*) AS n, CAST(min(i) AS BIGINT) AS first_index, CAST(max(i) AS BIGINT) AS last_index FROM (SELECT *, row_number() OVER (ORDER BY depth, table_name, pk) AS i FROM c) GROUP BY 1, 2")
def topo_levels(spark, sf_dir):
    """Parents before children in the order of a push."""
    rows = fk_closure(spark, sf_dir).withColumn("push_id", F.lit("p1"))
    return fk.topo_index(rows).groupBy("table_name", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("topo_index").alias("first_index"), F.max("topo_index").alias("last_index"))


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS i, CAST(length(props) * 3 AS BIGINT) AS b FROM events),
f(user_id, i, chunk_seq, used) AS (SELECT user_id, i, CAST(0 AS BIGINT), b FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, chunk_seq + CASE WHEN used + b > 400 THEN 1 ELSE 0 END, CASE WHEN used + b > 400 THEN b ELSE used + b END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, chunk_seq, count(*) AS n FROM f GROUP BY 1, 2""")
def chunk_greedy(spark, sf_dir):
    """Rows of each push in order, a new chunk where the byte budget would be passed."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    rows = spark.sql("SELECT user_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS i, cast(length(props) * 3 AS BIGINT) AS b FROM events")
    return fk.chunk(rows, 400, "user_id", "i", "b").groupBy("user_id", "chunk_seq").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT user_id AS push_id, event_id % 20 AS chunk_seq, min(CASE WHEN user_id % 25 = 0 THEN event_type ELSE 'same' END) AS lo, max(CASE WHEN user_id % 25 = 0 THEN event_type ELSE 'same' END) AS hi FROM events GROUP BY 1, 2)
SELECT push_id, count(*) AS applied, CAST(20 AS BIGINT) AS total_chunks, CASE WHEN count(*) FILTER (WHERE lo <> hi) > 0 THEN 'corrupt' WHEN count(*) >= 20 THEN 'complete' ELSE 'partial' END AS status FROM c GROUP BY 1""")
def push_progress(spark, sf_dir):
    """Repeated chunks are idempotent, one with two checksums is corrupt."""
    chunks = table(spark, sf_dir, "events").select(F.col("user_id").alias("push_id"), (F.col("event_id") % 20).alias("chunk_seq"), F.expr("CASE WHEN user_id % 25 = 0 THEN event_type ELSE 'same' END").alias("checksum"), F.lit(20).cast("long").alias("total_chunks"))
    return r.push_progress(chunks)


@query("""WITH a AS (SELECT DISTINCT 'art-' || (event_id % 3000) AS artifact_name FROM events), l AS (SELECT DISTINCT 'art-' || (event_id % 3000) AS artifact_name FROM events WHERE event_id % 3000 % 4 IN (1, 2))
SELECT artifact_name FROM a WHERE artifact_name NOT IN (SELECT artifact_name FROM l)""")
def ledger_exactly_once(spark, sf_dir):
    """Artifacts consumed or corrupt never come again, repeated deliveries count once; seen ones do."""
    e = table(spark, sf_dir, "events")
    artifacts = e.select(F.concat(F.lit("art-"), (F.col("event_id") % 3000).cast("string")).alias("artifact_name"), "event_id")
    ledger = artifacts.select("artifact_name", F.expr("CASE event_id % 3000 % 4 WHEN 1 THEN 'consumed' WHEN 2 THEN 'corrupt' ELSE 'seen' END").alias("status"))
    return r.fresh(artifacts, ledger).select("artifact_name")


@query("SELECT CAST(event_id % 5000 AS VARCHAR) AS artifact_name, min(event_id) AS first_seen, 'E_SYNC_GAP' AS code FROM events GROUP BY 1 HAVING bool_and(event_type NOT IN ('click', 'purchase')) AND 10000 - min(event_id) > 7000")
def gap_timeout(spark, sf_dir):
    """Artifacts that waited too long behind a gap: a baseline is asked for."""
    status = F.expr("CASE event_type WHEN 'click' THEN 'consumed' WHEN 'purchase' THEN 'corrupt' ELSE 'seen' END")
    entries = table(spark, sf_dir, "events").select((F.col("event_id") % 5000).cast("string").alias("artifact_name"), status.alias("status"), F.col("event_id").alias("ts"))
    return r.stale_gaps(entries, 10_000, 7_000).select("artifact_name", "first_seen", "code")


@query(_LOG + ", g AS (SELECT * FROM log WHERE local_seq % 17 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq) AS k FROM g) SELECT origin, seq, pk FROM k WHERE seq = k")
def inbox_stream_gate(spark, sf_dir):
    """The gate as a stream: artifacts arrive in three out-of-order micro-batches, some twice."""
    base = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='sheetflow-')}/inbox-{uuid.uuid4().hex}"
    changes = log(spark, sf_dir).filter("local_seq % 17 <> 0").select("origin", "epoch", "seq", F.col("rank").cast("int").alias("rank"), F.lit("events").alias("table_name"), "op", "pk", "payload", "schema_ver", F.lit("fp").alias("schema_fp"))
    changes.filter("seq % 3 = 1").coalesce(1).write.mode("overwrite").parquet(f"{base}/in")
    changes.filter("seq % 3 <> 2").coalesce(1).write.mode("append").parquet(f"{base}/in")
    changes.filter("seq % 3 = 2").coalesce(1).write.mode("append").parquet(f"{base}/in")
    inbox.run_available(inbox.read_inbox(spark, f"{base}/in", per_batch=1), f"{base}/checkpoint", inbox.parquet_sink(f"{base}/out"))
    return spark.read.schema(inbox.RELEASED).parquet(f"{base}/out/batch=*").select("origin", "seq", "pk")
