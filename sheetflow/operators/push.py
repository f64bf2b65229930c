"""Captured writes and selection pushes: what a node sends, and what it does with what it gets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import as_number, modulo
from ..sources.registry import Catalogue
from .closure import ClosureError, chunk, closure, closure_rows, missing_parents, topo_index
from .diff import capture
from .merge import upsert


@dataclass
class Push:
    #: push_id, table_name, pk, depth, record_kind, fingerprint, bytes, topo_index, chunk_seq, too_large
    rows: DataFrame
    #: A row for each chunk: push_id, origin, chunk_seq, total_chunks, rows, bytes, checksum
    manifest: DataFrame
    #: The rows of each table themselves.
    tables: dict[str, DataFrame]


def selection_push(catalogue: Catalogue, table: str, selected: DataFrame, push_id: str, origin: str, cap: int = 100_000, chunk_bytes: int = 2 << 20, known: DataFrame | None = None, key: list[str] | None = None) -> Push:
    """A selection with all it needs, in topological order, cut into chunks under a manifest.

    ``cap`` bounds the rows of a push (checked by a count), and so what ``topo_index`` and ``chunk`` hold together.
    """
    if selected.isEmpty():
        raise ClosureError("E_SYNC_SELECTION_EMPTY", table)
    tables = closure(catalogue, table, selected, known)
    if known is None:
        lost = missing_parents(catalogue, tables)
        first = lost.first() if lost is not None else None
        if first is not None:
            raise ClosureError("E_SYNC_FK_CLOSURE_MISSING", f"{first.table_name} needs {first.ref_table} {first.key}")
    flat = closure_rows(catalogue, table, tables, key)
    n = flat.limit(cap + 1).count()
    if n > cap:
        raise ClosureError("E_SYNC_SELECTION_TOO_LARGE", f"more than {cap} rows")
    rows = chunk(topo_index(flat.withColumn("push_id", F.lit(push_id))), chunk_bytes)
    return Push(rows, manifest(rows, origin), tables)


def manifest(rows: DataFrame, origin: str) -> DataFrame:
    """One row for each chunk; the checksum does not depend on the order of its rows."""
    marks = F.sum(as_number(F.md5(F.concat_ws("|", "table_name", "pk", "fingerprint"))).cast("decimal(38,0)"))
    each = rows.groupBy("push_id", "chunk_seq").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"), modulo(marks).alias("checksum"))
    total = rows.groupBy(F.col("push_id").alias("t_push")).agg((F.max("chunk_seq") + 1).alias("total_chunks"))
    return each.join(total, F.col("push_id") == F.col("t_push")).select("push_id", F.lit(origin).alias("origin"), "chunk_seq", "total_chunks", "rows", "bytes", "checksum")


def receive_push(local: DataFrame, selected: DataFrame | None, dependency: DataFrame | None, keys: list[str]) -> DataFrame:
    """A table after a push: selected rows replace, rows that come along as dependencies are only added."""
    out = local
    if dependency is not None:
        out = upsert(out, dependency, keys, "nothing")
    return upsert(out, selected, keys) if selected is not None else out


def captured_write(before: DataFrame, after: DataFrame, table: str, keys: list[str], origin: str, epoch: int, last_seq: int, last_local: int, rank: int = 0) -> DataFrame:
    """The changes of a local write as change log entries that continue the node's sequences.

    Sequences follow the order of the keys. They are counted by ranges of a hash of the key first, so no write is put
    in order in one task.
    """
    changed = capture(before, after, keys)
    pk = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    rows = changed.select(pk.alias("pk"), "op", F.coalesce("after", "before").alias("payload")).withColumn("at", F.shiftrightunsigned(F.xxhash64("pk"), 52))
    counts = rows.groupBy(F.col("at").alias("c_at")).agg(F.count(F.lit(1)).alias("n"))  # 4,096 ranges at most
    counts = counts.withColumn("before", F.expr("sum(n) OVER (ORDER BY c_at) - n"))
    placed = rows.join(counts, F.col("at") == F.col("c_at")).withColumn("k", F.expr("before + row_number() OVER (PARTITION BY at ORDER BY pk)"))
    entry = lambda c, name: c.cast("long").alias(name)
    return placed.select(
        F.lit(origin).alias("origin"), entry(F.lit(epoch), "epoch"), entry(F.col("k") + last_seq, "seq"), entry(F.col("k") + last_local, "local_seq"), F.lit(table).alias("table_name"), "op", "pk",
        F.lit(rank).alias("rank"), "payload", F.sha2("payload", 256).alias("payload_checksum"), entry(F.octet_length("payload"), "byte_size"),
    )


def restored(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose winner is a deletion give way to the best write that the deletion does not dominate.

    A deletion clears a row only if it has precedence over every write of it; otherwise the best write stays. ``op`` tells.
    """
    best = F.struct(F.coalesce(F.col("rank"), F.lit(0)).alias("rank"), F.col("seq"), F.col("origin"))
    rest = [c for c in changes.columns if c not in keys]
    sides = changes.groupBy(*keys).agg(
        F.max(F.when(F.col("op") == "D", best)).alias("d"), F.max(F.when(F.col("op") != "D", best)).alias("w"),
        F.max_by(F.struct(*rest), F.when(F.col("op") != "D", best)).alias("row"),
    )
    return sides.filter("w is not null and (d is null or w > d)").select(*keys, "row.*")


def applied_cases(local: DataFrame, changes: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """What a change does to its row: insert, replace, keep, omit (the row to update or delete is not there) or delete."""
    mine = local.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.lit(True).alias("there"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"m_{k}"))
    met = changes.join(mine, on, "left").drop(*[f"m_{k}" for k in keys])
    there = F.col("there").isNotNull()
    case = F.when(~there & (F.col("op") == "I"), "insert").when(~there, "omit").when(F.lit(policy in ("TargetWins", "Manual")), "keep").when(F.col("op") == "D", "delete").otherwise("replace")
    return met.withColumn("action", case).drop("there")
