"""Differences of tables, rows and cells, change capture, and merges of staged choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import as_number, modulo, row_hash
from .merge import upsert


def _union_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the columns of either; what a table lacks is null in it."""
    def widened(mine: DataFrame, other: DataFrame) -> DataFrame:
        return mine.withColumns({c: F.lit(None).cast(other.schema[c].dataType) for c in other.columns if c not in mine.columns})

    a = widened(a, b)
    return a, widened(b, a).select(a.columns)


def _side(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], F.struct(*df.columns).alias(tag))


def paired(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides by key: structs ``l`` and ``r``, null where a side has none."""
    on = None
    for k in keys:
        term = F.col(f"l_{k}") == F.col(f"r_{k}")
        on = term if on is None else on & term
    both = _side(local, keys, "l").join(_side(remote, keys, "r"), on, "full_outer")
    return both.select(*[F.coalesce(F.col(f"l_{k}"), F.col(f"r_{k}")).alias(k) for k in keys], "l", "r")


def _differ(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return out


def row_kind(columns: list[str], added="Added", deleted="Deleted", modified="Modified", same="Same") -> Column:
    return F.when(F.col("l").isNull(), added).when(F.col("r").isNull(), deleted).when(_differ(columns), modified).otherwise(same)


def row_diff(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind: Added (remote only), Deleted (local only), Modified or Same; a column of one side only is null on the other."""
    local, remote = _union_columns(local, remote)
    columns = [c for c in local.columns if c not in keys]
    return paired(local, remote, keys).withColumn("kind", row_kind(columns))


def diff_page(local: DataFrame, remote: DataFrame, keys: list[str], offset: int, size: int) -> DataFrame:
    """One page of changed rows in key order; both sides are joined before the page is cut."""
    changed = row_diff(local, remote, keys).filter("kind <> 'Same'")
    return changed.orderBy(*keys).offset(offset).limit(size)


def cell_diff(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each changed cell of modified rows: keys, column, local, remote; the columns of both sides count."""
    local, remote = _union_columns(local, remote)
    columns = [c for c in local.columns if c not in keys]
    changed = lambda c: (~F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))).alias("changed")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"l.`{c}`").cast("string").alias("local"), F.col(f"r.`{c}`").cast("string").alias("remote"), changed(c)) for c in columns])
    both = paired(local, remote, keys).filter("l is not null and r is not null")
    return both.select(*keys, F.explode(F.filter(cells, lambda x: x["changed"])).alias("cell")).select(*keys, "cell.column", "cell.local", "cell.remote")


def table_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Status of each table of two tables of (table_name, schema_fingerprint, content_checksum, row_count)."""
    a = local.select(F.col("table_name").alias("a_name"), F.struct("schema_fingerprint", "content_checksum", "row_count").alias("a"))
    b = remote.select(F.col("table_name").alias("b_name"), F.struct("schema_fingerprint", "content_checksum", "row_count").alias("b"))
    status = F.when(F.col("b_name").isNull(), "OnlyLocal").when(F.col("a_name").isNull(), "OnlyRemote").when(F.col("a") == F.col("b"), "Identical").otherwise("Different")
    return a.join(b, F.col("a_name") == F.col("b_name"), "full_outer").select(
        F.coalesce("a_name", "b_name").alias("table_name"), status.alias("status"), F.col("a.row_count").alias("local_rows"), F.col("b.row_count").alias("remote_rows")
    )


def merge_staged(local: DataFrame, remote: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """The local table after the staged keys took the remote's rows. Deletions cannot be staged."""
    chosen = remote.join(staged.select(*keys).distinct(), keys, "left_semi")
    return upsert(local, chosen, keys)


def stale(snapshot_version: int, current_version: int) -> str | None:
    """A staged merge is refused once the local tables have moved on."""
    return None if snapshot_version == current_version else "E_SYNC_STAGE_STALE"


def capture(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Changes between two snapshots: keys, op (I, U, D), before and after as JSON, over the columns of both."""
    before, after = _union_columns(before, after)
    columns = [c for c in before.columns if c not in keys]
    both = paired(before, after, keys).withColumn("op", row_kind(columns, "I", "D", "U", "-")).filter("op <> '-'")
    js = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return both.select(*keys, "op", F.when(F.col("l").isNotNull(), js("l")).alias("before"), F.when(F.col("r").isNotNull(), js("r")).alias("after"))


def checksum_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What a change set adds to a table's checksum and row count, from changed rows alone."""
    side = lambda df, tag: df.select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], row_hash(df).alias(f"{tag}_hash"))
    on = None
    for k in keys:
        term = F.col(f"b_{k}") == F.col(f"a_{k}")
        on = term if on is None else on & term
    both = side(before, "b").join(side(after, "a"), on, "full_outer").filter(~F.col("b_hash").eqNullSafe(F.col("a_hash")))
    zero = F.lit(0).cast("decimal(38,0)")
    add = F.sum(F.coalesce(as_number(F.col("a_hash")).cast("decimal(38,0)"), zero) - F.coalesce(as_number(F.col("b_hash")).cast("decimal(38,0)"), zero))
    rows = F.sum(F.col("a_hash").isNotNull().cast("long") - F.col("b_hash").isNotNull().cast("long"))
    return both.agg(F.coalesce(add, zero).alias("delta"), F.coalesce(rows, F.lit(0)).alias("row_delta")).select(modulo(F.col("delta")).alias("delta"), "row_delta")
