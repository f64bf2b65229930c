"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut at line ends and, as one paragraph may be a whole text, at sentence ends; each distinct
part is a 64-bit digest. A sketch has ``cells`` cells in three bands; each digest is added to one cell
of each band: a counter, the sum of digests and the sum of check values. The difference of two sketches
holds just the digests that differ: cells with a counter of one and a fitting check value are *peeled*,
their digest taken out everywhere, until nothing is left. If peeling stalls, both texts are sketched
again four times larger; if ``attempts`` sizes fail, the digests themselves are compared. The likeness is
common / all digests. All documents of a batch are sketched and peeled at once in numpy.

``fingerprint`` is the sketch of the first size, with the number of digests, in hexadecimal.

Neighbours: texts move once, into ranges of the identifier, and each task walks its sorted range. The
ranges' bounds come from a quantile sketch; the first row of each range is dealt to the range before as
well, so the walk finds every neighbour and nothing has to be stored in between.

Defined results: a null text is empty; an empty text has no digests, two texts without digests are
alike (1.0), one without and one with are not (0.0); rows with equal identifiers are ordered by text;
a single row is its own neighbour; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_bytes
from .wordhash import M64, mix, words


@dataclass(frozen=True)
class Sketch:
    cells: int = 24  # a multiple of 3
    growth: int = 4
    attempts: int = 6
    #: Characters of text sketched at once.
    slice_chars: int = 1 << 20


_cut = np.zeros(256, bool)
_cut[[10, 13, 33, 46, 63]] = True  # line ends ! . ?
_CHECK = np.uint64(0xC2B2AE3D27D4EB4F)


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct part digests of all texts, and the n + 1 places of the texts among them."""
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    found, _, _, rows = words(data, offsets, space=_cut)
    owner = np.repeat(np.arange(len(texts)), np.diff(rows))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key in each of three bands."""
    band = cells // 3
    h = mix(keys + np.uint64(cells * 0x165667B19E3779F9 & M64))
    return np.stack([((h >> np.uint64(21 * i)) & np.uint64((1 << 21) - 1)).astype(np.int64) * band // (1 << 21) + i * band for i in range(3)], 1)


def sketches(keys: np.ndarray, owner: np.ndarray, n: int, cells: int, sign=1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counters, digest sums and check sums of n sketches, flat."""
    count, total, check = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    add(count, total, check, keys, owner, cells, np.full(len(keys), sign, np.int64))
    return count, total, check


def add(count, total, check, keys, owner, cells, signs) -> None:
    at = (_cells(keys, cells) + owner[:, None] * cells).ravel()
    signs = np.repeat(signs, 3)
    factor = signs.astype(np.uint64)  # -1 is 2**64 - 1
    np.add.at(count, at, signs)
    np.add.at(total, at, np.repeat(keys, 3) * factor)
    np.add.at(check, at, np.repeat(mix(keys ^ _CHECK), 3) * factor)


def peel(count, total, check, n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of recovered digests of n difference sketches, and which were recovered whole."""
    got = np.zeros(n, np.int64)
    while True:
        one = np.flatnonzero(np.abs(count) == 1)
        signs = count[one]
        keys = total[one] * signs.astype(np.uint64)
        good = check[one] * signs.astype(np.uint64) == mix(keys ^ _CHECK)
        one, signs, keys = one[good], signs[good], keys[good]
        if not len(one):
            break
        owner = one // cells
        order = np.lexsort((keys, owner))
        owner, keys, signs = owner[order], keys[order], signs[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        owner, keys, signs = owner[new], keys[new], signs[new]
        got += np.bincount(owner, minlength=n)
        add(count, total, check, keys, owner, cells, -signs)
    left = (count != 0) | (total != 0) | (check != 0)
    return got, ~left.reshape(n, cells).any(1)


def _gather(keys: np.ndarray, at: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of chosen texts, and for each its place in the choice."""
    sizes = at[texts + 1] - at[texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.repeat(at[texts] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(texts) else np.zeros(0, np.int64)
    return keys[np.arange(len(owner)) + first], owner


def likeness(keys: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, s: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """Share of common digests of text pairs, and the attempts that each took."""
    differ, tries, open_ = np.zeros(len(left), np.int64), np.zeros(len(left), np.int32), np.arange(len(left))
    cells = s.cells
    for k in range(s.attempts):
        if not len(open_):
            break
        tables = [np.zeros(0)] * 3
        a, a_owner = _gather(keys, at, left[open_])
        b, b_owner = _gather(keys, at, right[open_])
        tables = sketches(a, a_owner, len(open_), cells)
        for mine, theirs in zip(tables, sketches(b, b_owner, len(open_), cells), strict=True):
            np.subtract(mine, theirs, out=mine)
        got, whole = peel(*tables, len(open_), cells)
        tries[open_] = k + 1
        differ[open_[whole]] = got[whole]
        open_, cells = open_[~whole], cells * s.growth
    for k in open_:
        differ[k] = len(np.setxor1d(keys[at[left[k]] : at[left[k] + 1]], keys[at[right[k]] : at[right[k] + 1]], assume_unique=True))
        tries[k] = s.attempts + 1
    sizes = np.diff(at)
    both = sizes[left] + sizes[right]
    every = (both + differ) // 2
    return np.where(every == 0, 1.0, (every - differ) / np.maximum(every, 1)), tries


def fingerprints(keys: np.ndarray, at: np.ndarray, s: Sketch) -> list[str]:
    n = len(at) - 1
    count, total, check = sketches(keys, np.repeat(np.arange(n), np.diff(at)), n, s.cells)
    cell = np.empty((n, s.cells), np.dtype([("count", "<i4"), ("total", "<u8"), ("check", "<u4")]))
    cell["count"], cell["total"], cell["check"] = (x.reshape(n, s.cells) for x in (count, total, (check >> np.uint64(32)).astype(np.uint32)))
    sizes = np.diff(at)
    return [f"{sizes[k]:08x}{cell[k].tobytes().hex()}" for k in range(n)]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, attempts_edited int, attempts_next int"


def compare(texts: list[str], following: list[str], s: Sketch) -> list[pa.Array]:
    """The result columns for texts and the texts that follow them."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    n = len(texts)
    keys, at = digests([*texts, *changed, *following])
    own = np.arange(n)
    near_edited, tries_edited = likeness(keys, at, own, own + n, s)
    near_next, tries_next = likeness(keys, at, own, own + 2 * n, s)
    prints = fingerprints(keys[: at[2 * n]], at[: 2 * n + 1], s)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(prints[:n], pa.string()),
        pa.array(prints[n:], pa.string()),
        pa.array(near_edited),
        pa.array(near_next),
        pa.array(tries_edited, pa.int32()),
        pa.array(tries_next, pa.int32()),
    ]


NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _ranges(rows: DataFrame, n: int) -> tuple[list[int], list[tuple[int, int | None, int]]]:
    """Bounds of about n ranges of ``id``, and for each range that has rows (range, least id, range before)."""
    cuts = rows.approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = sorted({int(c) for c in cuts})
    # one row for each range
    least = rows.groupBy(_range(bounds).alias("part")).agg(F.min("id").alias("low"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()
    order = sorted(((r.part, None if r.nulls else r.low) for r in least), key=lambda r: r[0])
    return bounds, [(part, low, order[k - 1][0]) for k, (part, low) in enumerate(order)]


def _range(bounds: list[int]):
    """Number of bounds below ``id``; nulls come first."""
    if not bounds:
        return F.lit(0)
    at = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.coalesce(F.size(F.filter(at, lambda b: b < F.col("id"))), F.lit(0)) if len(bounds) < 64 else F.when(F.col("id").isNull(), 0).otherwise(F.expr(_tree(bounds, 0, len(bounds))))


def _tree(bounds: list[int], lo: int, hi: int) -> str:
    """A balanced tree of comparisons."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    return f"if(id <= {bounds[mid]}L, {_tree(bounds, lo, mid)}, {_tree(bounds, mid + 1, hi)})"


def fingerprint_documents(docs: DataFrame, s: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, firsts = _ranges(rows.select("id"), n)
    heads = spark.createDataFrame([(low, before) for _, low, before in firsts], "h_id long, before int")
    # as many rows as there are ranges; a repeated first identifier is dealt to the range before as a whole
    dealt = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("h_id")), "left").select(
        "id", "text", F.explode(F.filter(F.array(F.struct(_range(bounds).alias("part"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(True).alias("extra"))), lambda x: x["part"].isNotNull())).alias("to")
    )
    ranged = dealt.select("id", "text", "to.part", "to.extra").repartitionByRange(n, "part").sortWithinPartitions("part", "extra", F.col("id").asc_nulls_first(), "text")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, at, closed = 0, None, False

        def out() -> Iterator[pa.RecordBatch]:
            """All rows under way but the last, which is the neighbour of the one before."""
            if len(ids) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], pa.int64()), *compare(texts[:-1], texts[1:], s)], ["id", *NAMES])

        for batch in batches:
            for i, t, part, extra in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part != at:
                    yield from out()
                    ids, texts, size, at, closed = [], [], 0, part, False
                if closed:
                    continue  # a repeat of the next range's first identifier
                closed = extra
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= s.slice_chars and len(ids) > 1 and not closed:
                    yield from out()
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        yield from out()

    return ranged.mapInArrow(walk, f"id long, {RESULT}").withColumnRenamed("id", id_col)


def op5_fingerprint(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op5_fingerprint": op5_fingerprint}
ORACLES: dict[str, str] = {}
