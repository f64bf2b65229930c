"""Sessions, pushes, captured writes, payloads, eligibility and the replica."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..api import Replica
from ..functions import hashing, payload
from ..operators import push
from ..operators import replication as r
from ..operators.session import ComparisonSession
from ..plans.sync import eligible
from ..sources.registry import TEST_TABLES, Catalogue, ColumnDef, TableDef, test_catalogue
from ..sources.snapshots import SnapshotStore
from .common import table
from .comparing import _encoded
from .replicating import _LOG, log

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark, name: str) -> str:
    """A new folder of the shared storage; a temporary one only where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='sheetflow-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def sync_table_filter(spark, sf_dir):
    """Changes of the replicated tables; a metadata table is none, even where it is named."""
    e = table(spark, sf_dir, "events").withColumn("table_name", F.expr("CASE event_type WHEN 'error' THEN '__sync_state' ELSE event_type END"))
    return r.sync_tables(e, ["click", "purchase", "__sync_state"]).select("event_id", "event_type")


@query("WITH c AS (SELECT DISTINCT user_id AS push_id, event_id % 20 AS chunk_seq FROM events) SELECT push_id, chunk_seq, row_number() OVER (PARTITION BY push_id ORDER BY chunk_seq) = chunk_seq + 1 AS ready FROM c")
def chunk_predecessors(spark, sf_dir):
    """A chunk is ready once all before it are there; repeated ones count once."""
    chunks = table(spark, sf_dir, "events").select(F.col("user_id").alias("push_id"), (F.col("event_id") % 20).alias("chunk_seq"))
    return r.chunk_gate(chunks).select("push_id", "chunk_seq", "ready")


@query("SELECT CAST(max(event_id) AS BIGINT) AS head FROM events")
def log_head(spark, sf_dir):
    return r.head(log(spark, sf_dir))


@query("WITH v AS (SELECT user_id % 7 AS p, event_type AS origin, max(event_id % 1000) AS acked FROM events GROUP BY 1, 2) SELECT origin, CAST(1 AS BIGINT) AS epoch, min(acked) AS acked_seq FROM v WHERE p % 3 <> 0 GROUP BY 1")
def min_acked(spark, sf_dir):
    """What all peers have, but for those that await a baseline."""
    acks = table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("string").alias("peer"), F.col("event_type").alias("origin"), F.lit(1).cast("long").alias("epoch"), (F.col("event_id") % 1000).alias("acked_seq"), F.col("event_id").alias("ts"))
    return r.min_acked(r.ack_vector(acks).withColumn("pending_baseline", F.col("peer").cast("int") % 3 == 0))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('click', 'signup') AND event_id % 2 <> 0")
def table_gate(spark, sf_dir):
    """Payloads wait that touch a table under comparison."""
    p = table(spark, sf_dir, "events").select("event_id", F.expr("array(event_type, CASE WHEN event_id % 2 = 0 THEN 'signup' ELSE 'other' END)").alias("tables"))
    return r.ungated(p, ["click", "signup"]).select("event_id")


@query(_LOG + " SELECT seq, local_seq FROM log WHERE origin = '7' AND seq > 3 ORDER BY seq LIMIT 5")
def changelog_range(spark, sf_dir):
    return r.read_range(log(spark, sf_dir), origin="7", after=3, limit=5).select("seq", "local_seq")


@query(_LOG + " SELECT origin, local_seq FROM log WHERE origin <> '7' AND local_seq > 100 ORDER BY local_seq LIMIT 50")
def changelog_others(spark, sf_dir):
    return r.read_range(log(spark, sf_dir), not_origin="7", after=100, limit=50).select("origin", "local_seq")


@query("""SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN coalesce(props, '') END AS body, CASE WHEN event_id % 10 <> 0 THEN '{"seq":' || event_id || '}' END AS header,
    CASE WHEN event_id % 10 <> 0 THEN 'changeset' END AS kind, CASE WHEN event_id % 10 = 0 THEN 'E_SYNC_PAYLOAD_CORRUPT' END AS code FROM events""")
def payload_roundtrip(spark, sf_dir):
    """Payloads are packed and unpacked; every tenth was cut short on the way."""
    e = table(spark, sf_dir, "events")
    packed = payload.encode("changeset", F.concat(F.lit('{"seq":'), F.col("event_id").cast("string"), F.lit("}")), F.coalesce("props", F.lit("")))
    sent = e.select("event_id", packed.alias("p")).withColumn("p", F.expr("CASE WHEN event_id % 10 = 0 THEN substring(p, 1, length(p) - 3) ELSE p END"))
    return payload.decode(sent, "p").select("event_id", "body", "header", "kind", "code")


@query("SELECT event_id, coalesce(props, '') AS text FROM events WHERE NOT (event_id % 11 = 0 AND length(coalesce(props, '')) > 7) AND NOT (event_id % 13 = 0)")
def fragments_reassembled(spark, sf_dir):
    """Texts in parts that arrive twice; without a part, or with a part that differs, there is no text."""
    e = table(spark, sf_dir, "events").select("event_id", F.coalesce("props", F.lit("")).alias("text"))
    parts = payload.fragments(e, ["event_id"], "text", 7)
    odd = parts.filter("event_id % 13 = 0 and idx = 0").withColumn("part", F.concat("part", F.lit("?")))
    return payload.reassembled(parts.union(parts).filter("not (event_id % 11 = 0 and idx = 1)").union(odd), ["event_id"])


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, substr(sha256({_encoded('lineitem', tuple(c.name for c in TEST_TABLES['lineitem'].columns if c.name not in ('l_orderkey', 'l_linenumber')))}), 1, 32) AS pk_hash FROM lineitem")
def pk_hash(spark, sf_dir):
    """A key of several columns as one hash; no text of a key is ever cut or joined by commas."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", hashing.row_hash(li, ["l_orderkey", "l_linenumber"]).alias("pk_hash"))


_SOME = {
    "v": TableDef("v", (ColumnDef("id", "INTEGER"),), ("id",), kind="view"), "two": TableDef("two", (ColumnDef("a", "TEXT", True), ColumnDef("b", "TEXT", True)), ("a", "b")),
    "text_key": TableDef("text_key", (ColumnDef("a", "TEXT"),), ("a",)), "good": TableDef("good", (ColumnDef("a", "TEXT", True),), ("a",)), "rowid": TableDef("rowid", (ColumnDef("a", "INTEGER"),), ("a",)),
    "made": TableDef("made", (ColumnDef("a", "TEXT", True, generated=True),), ("a",)),
}


@query("""SELECT * FROM (VALUES ('lineitem', 'E_SYNC_UNSUPPORTED_SCHEMA', 'no primary key'), ('v', 'E_SYNC_UNSUPPORTED_SCHEMA', 'a view is no base table'), ('two', 'E_SYNC_COMPOSITE_PK_NOT_SUPPORTED', 'a key of several columns'),
    ('text_key', 'E_SYNC_UNSUPPORTED_SCHEMA', 'the key may be null'), ('made', 'E_SYNC_UNSUPPORTED_SCHEMA', 'the key cannot be written'), ('nobody', 'E_SYNC_UNSUPPORTED_SCHEMA', 'no such table')) t(table_name, code, reason)""")
def schema_eligibility(spark, sf_dir):
    found = eligible(Catalogue({**TEST_TABLES, **_SOME}), [*TEST_TABLES, *_SOME, "nobody"])
    return spark.createDataFrame(found, "table_name string, code string, reason string")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, CASE column_type WHEN 'BIGINT' THEN 'INTEGER' WHEN 'INTEGER' THEN 'INTEGER' WHEN 'DOUBLE' THEN 'REAL' WHEN 'VARCHAR' THEN 'TEXT' ELSE 'DATETIME' END AS declared_type FROM (DESCRIBE SELECT * FROM {t})" for t in TEST_TABLES))
def catalogue_scan(spark, sf_dir):
    """Tables and columns as they are found in the files."""
    found = Catalogue.scan({t: table(spark, sf_dir, t) for t in TEST_TABLES})
    return found.describe(spark).select("table_name", "column_name", "declared_type")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 30")
def table_page(spark, sf_dir):
    """One page of a table in key order."""
    return test_catalogue(spark, sf_dir).page("customer", 30, 20).select("c_custkey", "c_name")


@query(_LOG + """, g AS (SELECT * FROM log WHERE local_seq % 17 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq) AS k FROM g),
w AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY rank DESC, seq DESC, origin DESC) AS n FROM k WHERE seq = k) SELECT pk, origin, seq FROM w WHERE n = 1 AND op <> 'D'""")
def replica_gap_fill(spark, sf_dir):
    """A replica gets a log in three parts out of order; what lies behind a gap waits until it is filled."""
    changes = log(spark, sf_dir).filter("local_seq % 17 <> 0").select(
        "origin", "epoch", "seq", F.col("rank").cast("int").alias("rank"), F.lit("events").alias("table_name"), "op", "pk", "payload", F.lit(2).cast("long").alias("schema_ver"), F.lit("fp").alias("schema_fp")
    )
    node = Replica(spark, SnapshotStore(spark, _folder(spark, "replica")), 2, "fp")
    for part in (1, 0, 2):
        node.receive(changes.filter(F.col("seq") % 3 == part))
    return node.live().select("pk", "origin", "seq")


_REMOTE = """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0
    UNION ALL SELECT c_custkey + 1000000, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 = 0"""


@query(f"""WITH r AS ({_REMOTE}), l AS (SELECT c_custkey, c_name, c_mktsegment FROM customer)
SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey,
    CASE WHEN l.c_custkey IS NULL OR (r.c_custkey IS NOT NULL AND l.c_custkey % 10 <> 0) THEN r.c_name ELSE l.c_name END AS c_name,
    CASE WHEN l.c_custkey IS NULL OR (r.c_custkey IS NOT NULL AND l.c_custkey % 2 = 0 AND l.c_custkey % 10 <> 0) THEN r.c_mktsegment ELSE l.c_mktsegment END AS c_mktsegment
FROM l FULL JOIN r ON l.c_custkey = r.c_custkey WHERE l.c_custkey IS NOT NULL OR (r.c_custkey % 2 = 0 AND r.c_custkey % 10 <> 0)""")
def diff_session(spark, sf_dir):
    """Even rows are taken whole, of odd ones the name alone, those of key % 10 = 0 are unstaged; deletions cannot be staged."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    store = SnapshotStore(spark, _folder(spark, "session"))
    store.commit({"customer": table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")})
    s = ComparisonSession(store, {"customer": spark.sql(_REMOTE)}, {"customer": ["c_custkey"]})
    changed = s.rows("customer").filter("kind <> 'Same'")
    s.accept_rows("customer", changed.filter("c_custkey % 2 = 0"))
    s.accept_cells("customer", s.cells("customer").filter("c_custkey % 2 = 1 and column = 'c_name'"))
    s.unstage("customer", changed.filter("c_custkey % 10 = 0"))
    s.save()
    return store.read("customer")


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)),
a AS (SELECT 'orders' AS table_name, CAST(o_orderkey AS VARCHAR) AS pk, 3 AS depth, 'selected' AS record_kind FROM o UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 2, 'dependency' FROM c
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 1, 'dependency' FROM n UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 0, 'dependency' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))
SELECT *, (SELECT count(*) FROM a) AS in_manifest FROM a""")
def selection_push(spark, sf_dir):
    """Chosen orders and what they need, as a push under a manifest that accounts for every row."""
    cat = test_catalogue(spark, sf_dir)
    p = push.selection_push(cat, "orders", cat.frame("orders").filter("o_orderstatus = 'P'"), "p1", "node", cap=10_000_000)
    total = p.manifest.agg(F.sum("rows").alias("in_manifest"))
    return p.rows.select("table_name", "pk", "depth", "record_kind").join(total)


@query("""WITH s AS (SELECT c_custkey AS k, upper(c_name) AS n FROM customer WHERE c_custkey % 3 = 0), d AS (SELECT c_custkey + 7 * (c_custkey % 2) AS k, 'given' AS n FROM customer WHERE c_custkey % 5 = 0), l AS (SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey % 2 = 0),
x AS (SELECT k, max(n) AS n FROM d GROUP BY k) SELECT coalesce(s.k, l.k, x.k) AS c_custkey, coalesce(s.n, l.n, x.n) AS c_name FROM l FULL JOIN x ON l.k = x.k FULL JOIN s ON s.k = coalesce(l.k, x.k)""")
def push_receipt(spark, sf_dir):
    """Selected rows replace what the receiver has, dependencies only fill what it lacks."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    chosen = c.filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"))
    needed = c.filter("c_custkey % 5 = 0").select(F.expr("c_custkey + 7 * (c_custkey % 2)").alias("c_custkey"), F.lit("given").alias("c_name")).distinct()
    return push.receive_push(c.filter("c_custkey % 2 = 0"), chosen, needed, ["c_custkey"])


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '!' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey + 1000000, c_name FROM customer WHERE c_custkey % 4 = 0),
x AS (SELECT CAST(coalesce(b.c_custkey, a.c_custkey) AS VARCHAR) AS pk, CASE WHEN b.c_custkey IS NULL THEN 'I' WHEN a.c_custkey IS NULL THEN 'D' ELSE 'U' END AS op FROM customer b FULL JOIN a ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_name <> b.c_name)
SELECT pk, op, true AS contiguous, CAST(500 + (SELECT count(*) FROM x) AS BIGINT) AS last_seq FROM x""")
def captured_write(spark, sf_dir):
    """A local write as change log entries that continue the node's sequences without a gap."""
    before = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    after = before.filter("c_custkey % 5 <> 0").withColumn("c_name", F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat(upper(c_name), '!') ELSE c_name END"))
    after = after.union(before.filter("c_custkey % 4 = 0").select((F.col("c_custkey") + 1_000_000), "c_name"))
    entries = push.captured_write(before, after, "customer", ["c_custkey"], "node", 1, 500, 9000)
    whole = entries.agg(F.max("seq").alias("last_seq"), (F.count_distinct("seq") == F.max("seq") - 500).alias("a"), (F.max("local_seq") - F.max("seq") == 8500).alias("b"), (F.min("seq") == 501).alias("c"))
    return entries.select("pk", "op").join(whole.select("last_seq", F.expr("a and b and c").alias("contiguous")))


@query(_LOG + """, b AS (SELECT pk, max(CASE WHEN op = 'D' THEN struct_pack(r := rank, s := seq, o := origin) END) AS d, max(CASE WHEN op <> 'D' THEN struct_pack(r := rank, s := seq, o := origin) END) AS w FROM log GROUP BY pk)
SELECT b.pk, log.origin, log.seq, log.local_seq FROM b JOIN log ON log.pk = b.pk AND log.op <> 'D' AND struct_pack(r := log.rank, s := log.seq, o := log.origin) = w WHERE d IS NULL OR w > d""")
def winner_restore(spark, sf_dir):
    """A deletion of lower precedence gives way to the best write."""
    return push.restored(log(spark, sf_dir), ["pk"]).select("pk", "origin", "seq", "local_seq")


@query("""SELECT event_id, CASE WHEN c_custkey IS NULL AND event_type = 'view' THEN 'insert' WHEN c_custkey IS NULL THEN 'omit' WHEN event_type = 'error' THEN 'delete' ELSE 'replace' END AS action
FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id""")
def conflict_cases(spark, sf_dir):
    """Changes of rows that are not there are omitted, but for inserts."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    e = table(spark, sf_dir, "events").withColumn("op", F.expr("CASE event_type WHEN 'view' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END"))
    return push.applied_cases(c, e, ["user_id"], "SourceWins").select("event_id", "action")


@query("SELECT event_id, CASE WHEN event_type <> 'click' AND 10000 - event_id > 4000 THEN 'E_SYNC_ACK_TIMEOUT' END AS code FROM events")
def ack_timeout(spark, sf_dir):
    """Waits that are not done fail once their time is over."""
    waits = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("since"), (F.col("event_type") == "click").alias("done"))
    return r.ack_deadline(waits, 10_000, 4_000).select("event_id", "code")


@query("""WITH p AS (SELECT user_id AS peer, event_type AS origin, event_id AS ts, event_id % 100 AS acked FROM events WHERE event_id % 3 <> 0), d AS (SELECT peer FROM p GROUP BY 1 HAVING 1000 - min(ts) >= 600)
SELECT CAST(peer AS VARCHAR) AS peer, origin, max(acked) AS acked_seq FROM p WHERE peer IN (SELECT peer FROM d) GROUP BY 1, 2""")
def ack_batches(spark, sf_dir):
    """Acknowledgements go out together once one of a peer has waited long enough; those that failed are tried again."""
    sent = F.expr("CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END")
    pending = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("peer"), F.col("event_type").alias("origin"), F.lit(1).alias("epoch"), (F.col("event_id") % 100).alias("acked_seq"), F.col("event_id").alias("ts"), sent.alias("sent"))
    return r.due_acks(pending, 1_000, 600).select("peer", "origin", "acked_seq")
