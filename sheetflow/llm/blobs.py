"""Fixed-size tables (bit sets, counters) gathered from all partitions.

Each task folds its rows into one table of a size that is a parameter, and sends it in chunks; the
chunks are folded again by chunk number, so neither a task nor the driver ever holds more than a
few tables, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordhash import BASE, M64, mix

CHUNKS = 16


def gather(rows: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], size: int, dtype: str, fold: np.ufunc) -> np.ndarray:
    """The table of ``size`` entries (a multiple of 16) that ``fill`` builds from all rows."""
    part = size // CHUNKS

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype)
        for batch in batches:
            fill(table, batch)
        some = [k for k in range(CHUNKS) if table[k * part : (k + 1) * part].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([table[k * part : (k + 1) * part].tobytes() for k in some], pa.binary())], ["chunk", "blob"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(blob.as_buffer(), dtype)
                have[k] = fold(have[k], new) if k in have else new.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([v.tobytes() for v in have.values()], pa.binary())], ["chunk", "blob"])

    schema = "chunk int, blob binary"
    out = np.zeros(size, dtype)
    for row in rows.mapInArrow(send, schema).repartition(CHUNKS, "chunk").mapInArrow(join, schema).collect():
        out[row.chunk * part : (row.chunk + 1) * part] = np.frombuffer(row.blob, dtype)
    return out


def bloom_size(entries: int, most: int = 1 << 30) -> int:
    """Bits for so many entries: about 12 each, a power of two, at most ``most``."""
    bits = 1 << 15
    while bits < 12 * entries and bits < most:
        bits *= 2
    return bits


def _bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(keys + np.uint64(BASE * 7 & M64))
    return [h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]


def bloom_add(table: np.ndarray, keys: np.ndarray) -> None:
    for at in _bits(keys, len(table) * 8):
        np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def bloom_has(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """May be true for keys that were not added, never false for those that were."""
    found = np.ones(len(keys), bool)
    for at in _bits(keys, len(table) * 8):
        found &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def bloom(rows: DataFrame, entries: int, key: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """A Bloom filter over the keys of all rows."""
    return gather(rows, lambda table, batch: bloom_add(table, key(batch)), bloom_size(entries) // 8, "uint8", np.bitwise_or)


def nested_blooms(rows: DataFrame, entries: list[int], key: Callable[[pa.RecordBatch], np.ndarray], level: Callable[[pa.RecordBatch], np.ndarray]) -> list[np.ndarray]:
    """Bloom filters gathered in one pass: the k-th over the keys whose level is above k."""
    ends = np.cumsum([bloom_size(n) // 8 for n in entries])
    cuts = list(zip([0, *ends[:-1]], ends, strict=True))

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        keys, above = key(batch), level(batch)
        for k, (lo, hi) in enumerate(cuts):
            bloom_add(table[lo:hi], keys[above > k])

    every = gather(rows, fill, int(ends[-1]), "uint8", np.bitwise_or)
    return [every[lo:hi] for lo, hi in cuts]
