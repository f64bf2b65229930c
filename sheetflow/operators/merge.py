"""UPSERT on snapshots: keyed rows merged into a table by one outer join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key the row of the greatest ``order`` (a map-side maximum, not a window)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("best"))
    return best.select(*keys, *[F.col(f"best.`{c}`").alias(c) for c in rest])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """The target after ``source`` (one row for each key) is written.

    ``update`` replaces the columns that the source has, nulls included, and keeps the others;
    ``nothing`` only adds rows of new keys. With no column besides the keys both are the same.
    """
    names = [c for c in source.columns if c not in keys]
    mine = source.select(*[F.col(k).alias(f"s_{k}") for k in keys], *[F.col(c).alias(f"s_{c}") for c in names], F.lit(True).alias("s_here"))
    on = F.col(keys[0]) == F.col(f"s_{keys[0]}")
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"s_{k}"))
    here, there = F.col("s_here").isNotNull(), F.col("t_here").isNotNull()
    joined = target.withColumn("t_here", F.lit(True)).join(mine, on, "full_outer")
    wins = here if mode == "update" else here & ~there
    out = []
    for c in target.columns:
        kind = target.schema[c].dataType
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"s_{c}").cast(kind)).alias(c))
        elif c in names:
            out.append(F.when(wins, F.col(f"s_{c}").cast(kind)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def apply_mutations(target: DataFrame, mutations: DataFrame, keys: list[str]) -> DataFrame:
    """Mutations with a ``mode`` (update or nothing) and an ``ordinal``; for one key the last counts."""
    once = last_by_key(mutations, keys, "ordinal")
    after = upsert(target, once.filter("mode = 'update'").drop("mode", "ordinal"), keys)
    return upsert(after, once.filter("mode = 'nothing'").drop("mode", "ordinal"), keys, "nothing")
