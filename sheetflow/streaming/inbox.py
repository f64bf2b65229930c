"""The replication inbox as a structured stream.

Artifacts are files of change rows, moved into the inbox folder by an atomic rename. Each origin's sequence
is gated by keyed state that holds the applied sequence and the changes waiting behind a gap; the changes let
through are folded into the snapshot by ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "origin string, epoch long, seq long, rank int, table_name string, op string, pk string, payload string, schema_ver long, schema_fp string"
RELEASED = "origin string, epoch long, seq long, pk string, op string, payload string"
STATE = "applied long, waiting array<struct<seq:long,pk:string,op:string,payload:string>>"


def read_inbox(spark: SparkSession, path: str, schema: str = CHANGE, per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


FIELDS = ["seq", "pk", "op", "payload"]
#: ``op`` of the row that asks for a baseline; its ``seq`` is the first one missing.
GAP = "E_SYNC_GAP"


def release(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, gap_timeout_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """Let the contiguous continuation of the applied sequence through; keep the rest.

    With ``gap_timeout_ms`` an origin whose changes have waited so long gives one row ``GAP`` instead of changes.
    """
    applied, kept = state.get if state.exists else (0, [])
    if state.hasTimedOut:
        state.update((applied, kept))
        yield pd.DataFrame([(key[0], key[1], applied + 1, None, GAP, None)], columns=["origin", "epoch", *FIELDS])
        return
    waiting = pd.DataFrame([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in kept], columns=FIELDS)
    parts = [x for x in (waiting, *(f[FIELDS] for f in frames)) if len(x)]
    every = pd.concat(parts, ignore_index=True) if parts else waiting
    every = every[every["seq"] > applied].drop_duplicates("seq").sort_values("seq")
    n = int((every["seq"].to_numpy(dtype="int64") == applied + 1 + np.arange(len(every))).cumprod().sum())
    out, rest = every.iloc[:n], every.iloc[n:]
    state.update((applied + n, list(rest.itertuples(index=False, name=None))))
    if gap_timeout_ms is not None and len(rest):
        state.setTimeoutDuration(gap_timeout_ms)
    out = out.copy()
    out.insert(0, "origin", key[0])
    out.insert(1, "epoch", key[1])
    yield out


def gated(changes: DataFrame, gap_timeout_ms: int | None = None) -> DataFrame:
    """Changes in sequence for each (origin, epoch); repeated ones are dropped, those behind a gap wait."""
    timeout = GroupStateTimeout.NoTimeout if gap_timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return changes.groupBy("origin", "epoch").applyInPandasWithState(lambda k, f, s: release(k, f, s, gap_timeout_ms), RELEASED, STATE, "append", timeout)


def run_available(changes: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Drain what is in the inbox through ``sink``, exactly once by the checkpoint."""
    query = gated(changes).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, so a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def applied_vector(released: DataFrame) -> DataFrame:
    return released.groupBy("origin", "epoch").agg(F.max("seq").alias("applied_seq"))
