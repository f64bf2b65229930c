"""Replication as folds and joins over change logs.

A change row is (origin, epoch, seq, table_name, op, pk, payload, ...). Sequences are contiguous for each
(origin, epoch); ranks order origins in conflicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def applicable(changes: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Adds ``decision``: apply (contiguous after the applied sequence), noop (already applied or below 1) or gap.

    The contiguous prefix ends before the least sequence whose predecessor is missing. That is a minimum for
    each origin, found by a self-join on (origin, epoch, seq), so a busy origin is never sorted in one task.
    """
    key = ["origin", "epoch"]
    have = applied.select(*key, "applied_seq") if applied is not None else changes.select(*key).distinct().withColumn("applied_seq", F.lit(0).cast("long"))
    rows = changes.join(have, key, "left").withColumn("applied_seq", F.coalesce("applied_seq", F.lit(0).cast("long")))
    new = rows.filter("seq > applied_seq").select(*key, "seq", "applied_seq").distinct()
    before = new.select(F.col("origin").alias("o"), F.col("epoch").alias("e"), (F.col("seq") + 1).alias("s"))
    lone = new.join(before, (F.col("origin") == F.col("o")) & (F.col("epoch") == F.col("e")) & (F.col("seq") == F.col("s")), "left_anti").filter("seq > applied_seq + 1")
    first_gap = lone.groupBy(*key).agg(F.min("seq").alias("gap_at"))
    marked = rows.join(first_gap, key, "left")
    decision = F.when(F.col("seq") <= F.col("applied_seq"), "noop").when(F.col("gap_at").isNull() | (F.col("seq") < F.col("gap_at")), "apply").otherwise("gap")
    return marked.withColumn("decision", decision)


def gap_report(changes: DataFrame) -> DataFrame:
    """For each origin the applied sequence, the first missing one and how many changes wait behind it."""
    d = applicable(changes)
    return d.groupBy("origin", "epoch").agg(
        F.coalesce(F.max(F.when(F.col("decision") == "apply", F.col("seq"))), F.lit(0)).alias("applied_seq"),
        F.count_if(F.col("decision") == "gap").alias("waiting"),
    ).withColumn("missing_seq", F.when(F.col("waiting") > 0, F.col("applied_seq") + 1))


def precedence() -> Column:
    """Higher rank, then higher sequence, then the larger origin text."""
    return F.struct(F.coalesce(F.col("rank"), F.lit(0)).alias("rank"), F.col("seq"), F.col("origin"))


def winners(changes: DataFrame, keys: list[str], keep_tombstones: bool = False) -> DataFrame:
    """The winning change of each row, whatever the order of arrival (an associative maximum)."""
    rest = [c for c in changes.columns if c not in keys]
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), precedence()).alias("w")).select(*keys, "w.*")
    return best if keep_tombstones else best.filter("op <> 'D'")


def resolve(local: DataFrame, incoming: DataFrame, keys: list[str], policy: str, authoritative: bool = False) -> DataFrame:
    """Rows after conflicts: source wins by precedence, target wins keeps local rows, an authoritative sender replaces."""
    a, b = local.withColumn("side", F.lit(0)), incoming.withColumn("side", F.lit(1))
    both = a.unionByName(b)
    rest = [c for c in both.columns if c not in keys]
    if authoritative:
        order = F.struct("side", *precedence_fields())
    elif policy in ("TargetWins", "Manual"):
        order = F.struct((-F.col("side")).alias("side"), *precedence_fields())
    else:
        order = precedence()
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("w")).select(*keys, "w.*").filter("op <> 'D'")


def precedence_fields() -> list[Column]:
    return [F.coalesce(F.col("rank"), F.lit(0)).alias("rank"), F.col("seq"), F.col("origin")]


def guard(changes: DataFrame, version: int, fingerprint: str) -> DataFrame:
    """Adds ``accepted``; what is not accepted is quarantined, once for each (origin, epoch, seq)."""
    ok = F.coalesce((F.col("schema_ver") == version) & (F.col("schema_fp") == fingerprint), F.lit(False))
    return changes.withColumn("accepted", ok)


def quarantine(changes: DataFrame, version: int, fingerprint: str) -> DataFrame:
    return guard(changes, version, fingerprint).filter("not accepted").drop("accepted").dropDuplicates(["origin", "epoch", "seq"])


def replayable(quarantined: DataFrame, version: int) -> DataFrame:
    """Quarantined changes that the current schema version may take."""
    return quarantined.filter(F.col("schema_ver") <= version)


def unacked(peer: Column) -> Column:
    return F.struct(peer.alias("peer"), F.lit(-1).cast("long").alias("acked"))


def listed(peers: DataFrame) -> DataFrame:
    """One row: the peers as an array, each once (``_everyone``), and with nothing acknowledged (``_fresh``).

    Peers are the configured nodes of a star, a short list, not data.
    """
    return peers.select("peer").distinct().agg(F.collect_set("peer").alias("_everyone")).withColumn("_fresh", F.transform("_everyone", unacked))


def targets(acks: DataFrame, everyone: DataFrame) -> DataFrame:
    """For each (origin, epoch) with acknowledgements ``_goals``: all peers with the sequence each has acknowledged (or -1).

    Changes meet their peers as elements of this array, so (peer, change) pairs are made where the changes lie and never shuffled.
    """
    key = ["origin", "epoch"]
    known = acks.join(everyone.select(F.explode("_everyone").alias("peer")), "peer", "left_semi").dropna(subset=key)
    pair = F.struct("peer", F.coalesce(F.col("acked_seq").cast("long"), F.lit(-1)).alias("acked"))
    some = known.groupBy(*key).agg(F.collect_list(pair).alias("some")).crossJoin(everyone.select("_everyone"))
    return some.select(*key, F.concat("some", F.transform(F.array_except("_everyone", F.col("some.peer")), unacked)).alias("_goals"))


def routed(rows: DataFrame, peers: DataFrame, acks: DataFrame) -> DataFrame:
    """Rows with an origin and an epoch, once for each other peer (``_goal``: the peer and what it has acknowledged)."""
    everyone = listed(peers)
    met = rows.join(targets(acks, everyone), ["origin", "epoch"], "left").crossJoin(everyone.select("_fresh"))
    each = F.explode(F.coalesce("_goals", "_fresh")).alias("_goal")
    return met.select(*rows.columns, each).filter(F.col("origin") != F.col("_goal.peer"))


def outgoing(changelog: DataFrame, peers: DataFrame, acks: DataFrame) -> DataFrame:
    """(peer, change) pairs to send: never back to the origin, only above the acknowledged sequence."""
    pairs = routed(changelog, peers, acks).filter(F.col("seq") > F.col("_goal.acked")).select(*changelog.columns, "_goal.peer")
    return pairs.join(peers, "peer").select(*changelog.columns, *peers.columns) if len(peers.columns) > 1 else pairs


def capped(outbox: DataFrame, most_bytes: int) -> DataFrame:
    """Changes of each peer in local order while their bytes fit."""
    w = W.partitionBy("peer").orderBy("local_seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return outbox.withColumn("upto", F.sum("byte_size").over(w)).filter(F.col("upto") <= most_bytes).drop("upto")


def outbound_watermark(changelog: DataFrame, acks: DataFrame, block: int = 1024) -> DataFrame:
    """For each peer: one below the least local sequence it has not acknowledged (or the head).

    The log is reduced to the least local sequence of each block of sequences; only the block in which a peer's
    acknowledgement ends is looked at change by change, so the log never meets all peers.
    """
    key = ["origin", "epoch"]
    log = changelog.select(*key, "seq", "local_seq", F.floor(F.col("seq") / block).alias("block"))
    least = log.groupBy(*key, "block").agg(F.min("local_seq").alias("least"))
    peers = acks.select("peer").distinct()
    # peers and origins are nodes: two short lists
    goals = peers.join(log.select(*key).distinct()).join(acks.select("peer", *key, "acked_seq"), ["peer", *key], "left")
    goals = goals.select("peer", *key, F.coalesce("acked_seq", F.lit(-1)).alias("acked")).withColumn("last", F.floor(F.col("acked") / block))
    beyond = goals.join(least, key).filter("block > last").select("peer", "least")
    within = goals.join(log.withColumnRenamed("block", "last"), [*key, "last"]).filter("seq > acked").select("peer", F.col("local_seq").alias("least"))
    open_ = beyond.unionByName(within).groupBy("peer").agg(F.min("least").alias("least"))
    top = changelog.agg(F.coalesce(F.max("local_seq"), F.lit(-1)).alias("head"))
    return peers.join(open_, "peer", "left").join(top).select("peer", F.coalesce(F.col("least") - 1, F.col("head")).alias("watermark"))


def ack_vector(acks: DataFrame) -> DataFrame:
    """Acknowledged sequence of each (peer, origin, epoch): never falls."""
    return acks.groupBy("peer", "origin", "epoch").agg(F.max("acked_seq").alias("acked_seq"), F.max("ts").alias("last_ack"))


def min_acked(vector: DataFrame) -> DataFrame:
    """Least acknowledged sequence of each origin over peers that await no baseline."""
    return vector.filter("not pending_baseline").groupBy("origin", "epoch").agg(F.min("acked_seq").alias("acked_seq"))


def ack_wait(targets: DataFrame, vector: DataFrame) -> DataFrame:
    """For each peer whether all its targets (peer, origin, epoch, target_seq) are acknowledged."""
    t = targets.groupBy("peer", "origin", "epoch").agg(F.max("target_seq").alias("target_seq"))
    return t.join(vector, ["peer", "origin", "epoch"], "left").groupBy("peer").agg(F.every(F.coalesce(F.col("acked_seq"), F.lit(-1)) >= F.col("target_seq")).alias("done"))


def lag(changelog: DataFrame, acks: DataFrame) -> DataFrame:
    """Unacknowledged changes and bytes of each peer.

    For each origin the changes above every sequence that some peer has acknowledged are counted once, by running sums from its
    head; peers only look their sequence up, so no peer meets the changes themselves.
    """
    key = ["origin", "epoch"]
    changes = changelog.select(*key, F.col("seq").alias("at"), F.lit(1).alias("n"), "byte_size").dropna(subset=["origin", "at"])
    marks = acks.select(*key, F.coalesce(F.col("acked_seq").cast("long"), F.lit(-1)).alias("at")).dropna(subset=key).unionByName(changelog.select(*key).withColumn("at", F.lit(-1).cast("long"))).distinct()
    w = W.partitionBy(*key).orderBy(F.desc("at"), "n").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = changes.unionByName(marks.select(*key, "at", F.lit(0).alias("n")), allowMissingColumns=True)
    above = both.select(*key, "at", "n", F.struct(F.sum("n").over(w).alias("n"), F.sum("byte_size").over(w).alias("bytes")).alias("open")).filter("n = 0")
    sums = above.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("at", "open"))).alias("sums"))
    out = routed(sums, acks, acks).select("_goal.peer", F.element_at("sums", F.col("_goal.acked")).alias("open"))
    total = out.groupBy("peer").agg(F.sum("open.n").alias("lag_seq"), F.coalesce(F.sum("open.bytes"), F.lit(0)).cast("long").alias("lag_bytes"))
    return total.filter("lag_seq > 0")


def peer_health(lags: DataFrame, soft: dict[str, int], hard: dict[str, int]) -> DataFrame:
    """Dead above any hard limit (or evicted before), Lagging above a soft one, else Healthy; unknown times don't count."""
    over = lambda limits: F.coalesce((F.col("lag_seq") >= limits["seq"]) | (F.col("lag_bytes") >= limits["bytes"]) | F.coalesce(F.col("lag_ms") >= limits["ms"], F.lit(False)), F.lit(False))
    return lags.withColumn("health", F.when(F.coalesce(F.col("evicted"), F.lit(False)), "Dead").when(over(hard), "Dead").when(over(soft), "Lagging").otherwise("Healthy"))


def ack_deadline(waiting: DataFrame, now: int, timeout_ms: int) -> DataFrame:
    """Adds ``code`` to waits (peer, since, done): E_SYNC_ACK_TIMEOUT once a wait that is not done is over its time."""
    late = ~F.col("done") & (F.lit(now) - F.col("since") > timeout_ms)
    return waiting.withColumn("code", F.when(late, "E_SYNC_ACK_TIMEOUT"))


def due_acks(pending: DataFrame, now: int, delay_ms: int) -> DataFrame:
    """Acknowledgements (peer, origin, epoch, acked_seq, ts, sent) that go out now: the highest of each origin, for
    peers of which one has waited for the delay. What was sent and failed (``sent`` false) waits on and counts again."""
    open_ = pending.filter(~F.coalesce(F.col("sent"), F.lit(False)))
    ready = open_.groupBy("peer").agg(F.min("ts").alias("oldest")).filter(F.lit(now) - F.col("oldest") >= delay_ms).select(F.col("peer").alias("r_peer"))
    met = open_.join(ready, F.col("peer") == F.col("r_peer"), "left_semi")
    return met.groupBy("peer", "origin", "epoch").agg(F.max("acked_seq").alias("acked_seq"))


def push_progress(chunks: DataFrame) -> DataFrame:
    """Complete, corrupt (one chunk with two checksums) or partial, for each push."""
    each = chunks.groupBy("push_id", "chunk_seq").agg(F.min("checksum").alias("lo"), F.max("checksum").alias("hi"), F.max("total_chunks").alias("total"))
    out = each.groupBy("push_id").agg(F.count(F.lit(1)).alias("applied"), F.max("total").alias("total_chunks"), F.count_if(F.col("lo") != F.col("hi")).alias("bad"))
    return out.select("push_id", "applied", "total_chunks", F.when(F.col("bad") > 0, "corrupt").when(F.col("applied") >= F.col("total_chunks"), "complete").otherwise("partial").alias("status"))


def chunk_gate(chunks: DataFrame) -> DataFrame:
    """A chunk may be applied once all its predecessors are there."""
    w = W.partitionBy("push_id").orderBy("chunk_seq")
    once = chunks.dropDuplicates(["push_id", "chunk_seq"])
    return once.withColumn("ready", F.row_number().over(w) == F.col("chunk_seq") + 1)


def fresh(artifacts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Artifacts not yet consumed or found corrupt, one row for each name."""
    done = ledger.filter("status in ('consumed', 'corrupt')").select("artifact_name").distinct()
    return artifacts.dropDuplicates(["artifact_name"]).join(done, "artifact_name", "left_anti")


def ledger_state(entries: DataFrame) -> DataFrame:
    """Current state of each artifact: consumed and corrupt are final, seen is not."""
    level = F.when(F.col("status") == "seen", 0).when(F.col("status") == "corrupt", 1).otherwise(2)
    return entries.groupBy("artifact_name").agg(F.max_by("status", level).alias("status"), F.min("ts").alias("first_seen"))


def stale_gaps(entries: DataFrame, now, timeout_ms: int) -> DataFrame:
    """Artifacts that were seen longer ago than the timeout and still wait: a baseline is asked for."""
    return ledger_state(entries).filter((F.col("status") == "seen") & (F.lit(now) - F.col("first_seen") > timeout_ms)).withColumn("code", F.lit("E_SYNC_GAP"))


def ungated(payloads: DataFrame, held: list[str]) -> DataFrame:
    """Payloads that touch no table under comparison."""
    return payloads.filter(~F.arrays_overlap(F.col("tables"), F.array(*[F.lit(t) for t in held]))) if held else payloads


def sync_tables(changes: DataFrame, tables: list[str]) -> DataFrame:
    """Changes of the replicated tables; metadata tables never are."""
    return changes.filter(F.col("table_name").isin(tables) & ~F.col("table_name").startswith("__sync_"))


def read_range(changelog: DataFrame, origin: str | None = None, after: int = -1, limit: int = 1000, not_origin: str | None = None) -> DataFrame:
    """Part of a change log: of one origin by its sequence, or of all but one by the local sequence."""
    if origin is not None:
        return changelog.filter((F.col("origin") == origin) & (F.col("seq") > after)).orderBy("seq").limit(limit)
    return changelog.filter((F.col("origin") != not_origin) & (F.col("local_seq") > after)).orderBy("local_seq").limit(limit)


def head(changelog: DataFrame) -> DataFrame:
    return changelog.agg(F.coalesce(F.max("local_seq"), F.lit(-1)).alias("head"))
