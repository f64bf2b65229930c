"""Foreign key closure of selected rows, topological order and chunks by byte budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import fingerprint
from ..sources.registry import Catalogue


class ClosureError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def table_depths(catalogue: Catalogue, tables: list[str]) -> dict[str, int]:
    """Depth of each table in the foreign key graph: parents have smaller depths. Cycles are refused."""
    depth: dict[str, int] = {}

    def visit(t: str, path: tuple[str, ...]) -> int:
        if t in path:
            raise ClosureError("E_SYNC_FK_CYCLE_UNSUPPORTED", " -> ".join((*path, t)))
        if t not in depth:
            depth[t] = 1 + max((visit(f.ref_table, (*path, t)) for f in catalogue.tables[t].foreign_keys), default=-1)
        return depth[t]

    for t in tables:
        visit(t, ())
    return depth


def reachable(catalogue: Catalogue, table: str) -> list[str]:
    """The table and all its ancestors, children first."""
    out: list[str] = []

    def visit(t: str) -> None:
        if t not in out:
            out.append(t)
            for f in catalogue.tables[t].foreign_keys:
                visit(f.ref_table)

    visit(table)
    depths = table_depths(catalogue, out)
    return sorted(out, key=lambda t: (-depths[t], t))


def closure(catalogue: Catalogue, table: str, selected: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows of each table that the selected rows need, by one semi-join for each foreign key.

    ``known`` (table_name, pk, fingerprint) are rows the receiver has: an equal fingerprint prunes a dependency, and
    what only it needs is not visited. The selected rows themselves always go.
    """
    needed: dict[str, list[DataFrame]] = {table: [selected]}
    out: dict[str, DataFrame] = {}
    for t in reachable(catalogue, table):
        if t not in needed:
            continue
        frame = catalogue.frame(t)
        if t == table:
            rows = selected.dropDuplicates(list(catalogue.tables[t].primary_key)) if catalogue.tables[t].primary_key else selected
        else:
            keys = needed[t][0]
            for k in needed[t][1:]:
                keys = keys.union(k)
            pk = catalogue.tables[t].primary_key
            rows = frame.join(keys.distinct(), list(pk), "left_semi")
            if known is not None:
                own = known.filter(F.col("table_name") == t).select(F.col("pk").alias("k_pk"), F.col("fingerprint").alias("k_fp"))
                rows = rows.withColumn("pk_", F.concat_ws(",", *[F.col(c).cast("string") for c in pk])).withColumn("fp_", fingerprint(frame))
                rows = rows.join(own, (F.col("pk_") == F.col("k_pk")) & (F.col("fp_") == F.col("k_fp")), "left_anti").drop("pk_", "fp_")
        out[t] = rows
        for f in catalogue.tables[t].foreign_keys:
            wanted = rows.select(*[F.col(a).alias(b) for a, b in zip(f.columns, f.ref_columns, strict=True)]).dropna()
            needed.setdefault(f.ref_table, []).append(wanted)
    return out


def missing_parents(catalogue: Catalogue, rows: dict[str, DataFrame]) -> DataFrame:
    """Foreign keys of the closure without a row: table_name, ref_table, key; each fails a push."""
    out = None
    for t, frame in rows.items():
        for f in catalogue.tables[t].foreign_keys:
            keys = frame.select(*[F.col(a).alias(b) for a, b in zip(f.columns, f.ref_columns, strict=True)]).dropna().distinct()
            lost = keys.join(catalogue.frame(f.ref_table), list(f.ref_columns), "left_anti")
            part = lost.select(F.lit(t).alias("table_name"), F.lit(f.ref_table).alias("ref_table"), F.concat_ws(",", *[F.col(c).cast("string") for c in f.ref_columns]).alias("key"), F.lit("E_SYNC_FK_CLOSURE_MISSING").alias("code"))
            out = part if out is None else out.unionByName(part)
    return out


def closure_rows(catalogue: Catalogue, table: str, rows: dict[str, DataFrame], key: list[str] | None = None) -> DataFrame:
    """The closure as one table: table_name, pk, depth, record_kind, fingerprint, bytes."""
    depths = table_depths(catalogue, list(rows))
    out = None
    for t, frame in rows.items():
        pk = list(catalogue.tables[t].primary_key) or key or frame.columns
        part = frame.select(
            F.lit(t).alias("table_name"), F.concat_ws(",", *[F.col(c).cast("string") for c in pk]).alias("pk"), F.lit(depths[t]).alias("depth"),
            F.lit("selected" if t == table else "dependency").alias("record_kind"), fingerprint(frame).alias("fingerprint"), estimate(frame).alias("bytes"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def estimate(frame: DataFrame):
    """Estimated bytes of a row: two bytes a character of names and values and eight for each, 64 at least."""
    total = F.lit(0)
    for f in frame.schema:
        c = F.col(f.name)
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss") if isinstance(f.dataType, T.TimestampType) else F.format_string("%.6f", c) if isinstance(f.dataType, T.DoubleType) else c.cast("string")
        total = total + F.lit(2 * len(f.name) + 8) + 2 * F.when(c.isNull(), 0).otherwise(F.length(text))
    return F.greatest(total, F.lit(64)).cast("long")


def topo_index(rows: DataFrame, group: str = "push_id") -> DataFrame:
    """A position of each row of a push with parents before children; a push is bounded by its selection cap."""
    w = W.partitionBy(group).orderBy("depth", "table_name", "pk")
    return rows.withColumn("topo_index", F.row_number().over(w).cast("long"))


def chunk(rows: DataFrame, budget: int, group: str = "push_id", order: str = "topo_index", size: str = "bytes") -> DataFrame:
    """Rows of each push dealt to chunks in order, a new chunk where the budget would be passed.

    The fold is sequential by nature, so a push is one ordered array; it is bounded by the cap on the size of a
    selection. A row over the budget has ``too_large``.
    """
    rest = [c for c in rows.columns if c != group]
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o_"), F.col(size).cast("long").alias("b_"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("starts"))

    def step(acc, x):
        opens = (acc["used"] > 0) & (acc["used"] + x["b_"] > budget)
        # only the places where a chunk opens are kept: a fold over n rows of c chunks copies no more than c of them
        return F.struct(F.when(opens, x["b_"]).otherwise(acc["used"] + x["b_"]).alias("used"), F.when(opens, F.concat(acc["starts"], F.array(x["o_"].cast("long")))).otherwise(acc["starts"]).alias("starts"))

    starts = rows.groupBy(F.col(group).alias("g_")).agg(F.aggregate(items, start, step)["starts"].alias("starts"))
    each = starts.select("g_", F.posexplode(F.concat(F.array(F.lit(None).cast("bigint")), "starts")).alias("chunk_", "from_"), F.concat("starts", F.array(F.lit(None).cast("bigint"))).alias("ends"))
    each = each.select("g_", F.col("chunk_").cast("long").alias("chunk_seq"), "from_", F.expr("ends[chunk_]").alias("to_"))
    inside = (F.col("from_").isNull() | (F.col(order) >= F.col("from_"))) & (F.col("to_").isNull() | (F.col(order) < F.col("to_")))
    dealt = rows.join(each, F.col(group).eqNullSafe(F.col("g_")) & inside)
    return dealt.select(group, *rest, "chunk_seq", (F.col(size) > budget).alias("too_large"))
