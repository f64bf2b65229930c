"""N-gram Jaccard join in the metric space of word-shingle sets.

The Jaccard distance ``1 - |A & B| / |A | B|`` is a metric; documents link when it is at most
``eps = 1 - similarity``.

1. *Sets.* A text's shingles become 64-bit codes; documents with equal sets are collapsed to the one
   with the smallest identifier, so copies by the thousand are one point of the space.
2. *Territories.* In most text the distance of two documents is 1, so pivots drawn at random from all documents
   could not split this space. The first pivots are taken where documents are: for each code in a set's prefix (the
   codes that any linked partner must share one of) the document with the smallest share of codes of its own is the
   pivot, and a document enters the territory of the pivot of each code of its prefix. Two documents that link share a
   prefix code, so both lie in its pivot's territory. The prefix may follow any one order of all codes: first come the
   codes of a zone (the lowest ``zone`` of the hash range) that stand in one document only, then the others of the zone
   by classes of frequency, then the rest. Most documents have a prefix of codes that nobody shares: they can link with
   none and enter no territory. The count is repeated among the documents that are left, over the whole hash range,
   which leaves those whose text is shared for four fifths. Bloom filters of bounded size say which codes are shared by
   how many; their errors move a code in the order, for all documents alike, and change no result.
3. *Voronoi regions and windows, recursively.* A territory of more than a block of documents is split: its pivot and
   up to ``sub_pivots`` of its documents are pivots, each document belongs to the region of the nearest, and it is
   replicated to a region of lower number only if its distance to that pivot is at most 2 eps more than to its own (by
   the triangle inequality it can link with no document of the region otherwise). Regions that are still larger are
   split again by new pivots among their own documents. A pair counts in one region only: that of lower number of its
   two, and of all territories that both are in, the one with the smallest pivot.
4. *Dense regions.* Where a split would not help, as in a group of near copies within 2 eps of each other, the
   region's documents are laid out in rings by their distance to its pivot and cut into blocks; two blocks meet in
   one task if their rings are at most eps apart. A document is sent once for each such block, so the rows grow
   with documents times blocks, never with pairs. Where only components are wanted (the pipeline stage), documents
   within eps of the pivot are linked through it and their blocks do not meet.
5. *Blocks.* Within a block, or two that meet, all intersections are counted at once (a matrix product for frequent
   codes, runs for the others). A row for each document comes out: its number of links there and the smallest document
   it is connected to, never a pair.
6. *Components* of these connections, then back from sets to documents.

The join is exact: a pair is left out only where a prefix or the triangle inequality excludes a link. Joins
are sort-merge joins over stored tables that Spark splits where they are skewed.

Defined results: a null text or one without words has an empty set and is linked with nothing; a text of
fewer words than a shingle is one shingle; a row without an identifier keeps its set size, links with nothing and has
a null component; rows of one identifier are expected to have equal texts (else links of any hold for all);
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import fresh, shared_dir, stored, table, text_bytes, text_slices
from .components import components
from .wordhash import SLICE, mix, runs, sequence, words


@dataclass(frozen=True)
class Join:
    words: int = 5
    #: Similarity from which documents link, as a fraction.
    num: int = 4
    den: int = 5
    #: Part of the hash range whose codes are counted, for each narrowing of the candidates.
    zones: tuple[float, ...] = (0.4, 1.0, 1.0)
    #: Numbers of documents from which a code stands later in the order of codes; six at most.
    frequent: tuple[int, ...] = (2, 6, 20, 64, 256, 1024)
    #: Documents and codes of a block; two blocks at most meet in a task.
    block_docs: int = 256
    block_codes: int = 1 << 19
    #: New pivots inside a region that is split, beside its own.
    sub_pivots: int = 7
    most_levels: int = 6
    #: A split helps if it makes at most so many rows of each document, and no region of more than this share.
    most_rows: float = 1.5
    most_share: float = 0.75

    @property
    def eps(self) -> float:
        return 1 - self.num / self.den

    def prefix(self, n: int) -> int:
        """How many first codes a linked partner must share one of."""
        return n - -(-self.num * n // self.den) + 1 if n else 0

    def linked(self, inter, a, b):
        return self.den * inter >= self.num * (a + b - inter)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Shingle hashes of each text, with repeats."""
    h, _, _, rows = words(*text_bytes(texts), lower=True)
    every = runs(h, k)
    for lo, hi in zip(rows[:-1], rows[1:], strict=True):
        if hi - lo >= k:
            yield every[lo : hi - k + 1]
        elif hi > lo:
            yield np.array([sequence(h[lo:hi])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def codes(texts: pa.Array, j: Join) -> Iterator[np.ndarray]:
    """The distinct shingle codes of each text in order; three bits are left for the class."""
    for h in shingles(texts, j.words):
        yield np.unique(h >> np.uint64(3))


def _edge(zone: float) -> np.uint64:
    """First code beyond the zone."""
    return np.uint64(int(zone * (1 << 61)))


def signatures(rows: DataFrame, j: Join) -> DataFrame:
    """id, n (set size) and a 128-bit hash of the set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), SLICE):
                n, h1, h2 = [], [], []
                for u in codes(texts, j):
                    mixed = mix(u + np.uint64(77))
                    n.append(len(u))
                    h1.append(mixed.sum(dtype=np.uint64) if len(u) else np.uint64(0))
                    h2.append(np.bitwise_xor.reduce(mix(mixed)) if len(u) else np.uint64(0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int32()), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64))], ["id", "n", "h1", "h2"])

    return rows.mapInArrow(run, "id long, n int, h1 long, h2 long")


def _passing(batches: Iterable[pa.RecordBatch], narrowed) -> Iterator[pa.RecordBatch]:
    """The rows (id first) whose identifier passes a shared Bloom filter, where there is one.

    Called in the function that reads the rows: an operator of its own would be a second Python process for each task.
    """
    for batch in batches:
        if narrowed is not None:
            batch = batch.filter(pa.array(blobs.bloom_has(narrowed.value, _ids(batch))))
        if batch.num_rows:
            yield batch


def shared_codes(rows: DataFrame, narrowed, j: Join, zone: float, where: str) -> list[np.ndarray]:
    """Bloom filters of the zone's codes that stand in two documents or more, then in ever more."""
    edge = _edge(zone)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _passing(batches, narrowed):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, texts in text_slices(batch.column(1), SLICE):
                found = [u[: np.searchsorted(u, edge)] for u in codes(texts, j)]
                flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(ids[a:b], [len(f) for f in found]))], ["code", "id"])

    each = rows.mapInArrow(run, "code long, id long").groupBy("code").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("docs"))
    shared = stored(each.filter("low < high").select("code", "docs"), f"{where}/shared")
    limits = j.frequent if zone >= 1 else j.frequent[:1]
    counts = shared.agg(*[F.count_if(F.col("docs") >= least).alias(f"c{k}") for k, least in enumerate(limits)]).first()
    counts = [n for n in counts if n]
    if not counts:
        return []
    level = lambda batch: np.searchsorted(limits, batch.column(1).to_numpy(zero_copy_only=False), "right")
    return blobs.nested_blooms(shared.select("code", "docs"), counts, _ids, level)


def candidates(rows: DataFrame, narrowed, shared, j: Join, zone: float) -> DataFrame:
    """id, n, rank, codes of the prefix that others may have, and all codes, of documents that can link with any.

    The rank is the share of codes that no other document has, in thousandths: of a text and its altered
    copies the text itself has the least, and as a pivot it links with most of them.
    """
    edge = _edge(zone)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _passing(batches, narrowed):
            for a, _, texts in text_slices(batch.column(1), SLICE):
                at, sizes, ranks, keys, sets = [], [], [], [], []
                for k, u in enumerate(codes(texts, j), a):
                    inner = np.searchsorted(u, edge)
                    need = j.prefix(len(u))
                    level = np.zeros(inner, np.uint64)
                    for filt in shared.value:
                        level += blobs.bloom_has(filt, u[:inner])
                    own = int((level == 0).sum())
                    if need <= own:
                        continue  # the prefix holds codes of this document alone
                    order = np.concatenate([np.sort(u[:inner] | level << np.uint64(61)), u[inner:need] | np.uint64(7 << 61)])[:need]
                    at.append(k)
                    sizes.append(len(u))
                    ranks.append(1000 * own // max(int(inner), 1))
                    keys.append((order[own:] & np.uint64((1 << 61) - 1)).view(np.int64))
                    sets.append(u.tobytes() if zone >= 1 else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int32()), pa.array(ranks, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["id", "n", "rank", "keys", "codes"])

    return rows.mapInArrow(run, "id long, n int, rank int, keys array<long>, codes binary")


def _ids(batch: pa.RecordBatch, k: int = 0) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def territories(points: DataFrame, where: str) -> DataFrame:
    """A row (region, id) for each document in the territory of a pivot, the pivot too."""
    each = stored(points.select("id", "rank", F.explode("keys").alias("code")), f"{where}/keys")
    multi = each.groupBy("code").agg(F.min(F.struct("rank", "id")).alias("p"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    multi = stored(multi.select(F.col("code").alias("m_code"), F.col("p.id").alias("region")), f"{where}/pivots")
    met = each.join(multi.hint("merge"), F.col("code") == F.col("m_code")).groupBy("region", "id").agg(F.lit(1).alias("one"))
    return stored(met.select("region", "id"), f"{where}/territories")


def intersections(sets: list[np.ndarray], frequent: int = 16) -> np.ndarray:
    """Sizes of the intersections of all sets: frequent codes by a matrix product, the others along runs of equal codes."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(u) for u in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(flat)))
    each = np.repeat(count, count)
    some = (each > 1) & (each < frequent)
    run, mine = np.repeat(head, count)[some], owner[some]
    inter = np.zeros(m * m, np.int64)
    for step in range(1, min(frequent - 1, m)):
        same = run[step:] == run[:-step]
        if not same.any():
            break
        inter += np.bincount(mine[:-step][same] * m + mine[step:][same], minlength=m * m)
    inter = inter.reshape(m, m)
    many = each >= frequent
    if many.any():
        column, mine = np.repeat(np.arange(len(head)), count)[many], owner[many]
        column = np.cumsum(np.append(0, column[1:] != column[:-1]))
        wide = 1 << 12
        for lo in range(0, int(column[-1]) + 1, wide):
            a, b = np.searchsorted(column, [lo, lo + wide])
            has = np.zeros((m, int(column[b - 1]) - lo + 1), np.float32)
            has[mine[a:b], column[a:b] - lo] = 1
            inter += np.triu(has @ has.T, 1).astype(np.int64)
    return inter


def _compared(unit: dict[str, list], region: int, apart: bool, j: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of documents with a link, place of the smallest connected document, number of linked rows)."""
    n, copies, alien, side = (np.array(unit[c], np.int64) for c in ("n", "copies", "alien", "side"))
    inter = intersections(unit["codes"])
    link = (inter > 0) & (j.den * inter >= j.num * (n[:, None] + n[None, :] - inter)) & ((alien[:, None] & alien[None, :]) == 0)
    if apart:
        link &= side[:, None] != side[None, :]
    # a pair that several territories hold counts in the one with the smallest pivot
    lower = [p[p < region] for p in unit["pivots"]]
    sizes = [len(p) for p in lower]
    if sum(sizes) and link.any():
        values, column = np.unique(np.concatenate(lower), return_inverse=True)
        owner, shared = np.repeat(np.arange(len(n)), sizes), np.zeros((len(n), len(n)), np.float32)
        for lo in range(0, len(values), 1 << 12):
            cut = (column >= lo) & (column < lo + (1 << 12))
            has = np.zeros((len(n), min(len(values) - lo, 1 << 12)), np.float32)
            has[owner[cut], column[cut] - lo] = 1
            shared += has @ has.T
        link &= shared == 0
    link |= link.T
    label = np.arange(len(n))
    while True:
        least = np.minimum(label, np.where(link, label[None, :], len(n)).min(1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    at = np.flatnonzero(link.any(1))
    return at, label[at], (link @ copies)[at]


UNIT = ["unit", "region", "apart", "id", "n", "copies", "alien", "side", "pivots", "codes"]


def compared(units: DataFrame, j: Join) -> DataFrame:
    """A row (id, low, others) for each document of a unit with links: the smallest document it is connected to there, and its links.

    The rows of a unit come together, in order; one unit is held at a time.
    """

    def found(key, unit: dict[str, list]) -> Iterator[pa.RecordBatch]:
        if len(unit["id"]) > 1:
            order = sorted(range(len(unit["id"])), key=unit["id"].__getitem__)
            unit = {c: [v[k] for k in order] for c, v in unit.items()}
            at, low, others = _compared(unit, key[1], key[2], j)
            if len(at):
                ids = np.array(unit["id"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[low]), pa.array(others)], ["id", "low", "others"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit = None, {c: [] for c in UNIT[3:]}
        for batch in batches:
            plain = {c: batch.column(k).to_pylist() for k, c in enumerate(UNIT[:8])}
            pivots, sets = batch.column(8), batch.column(9)
            for k in range(batch.num_rows):
                key = (plain["unit"][k], plain["region"][k], plain["apart"][k])
                if key != now:
                    if now is not None:
                        yield from found(now, unit)
                    now, unit = key, {c: [] for c in UNIT[3:]}
                for c in UNIT[3:8]:
                    unit[c].append(plain[c][k])
                unit["pivots"].append(np.array(pivots[k].as_py(), np.int64))
                unit["codes"].append(np.frombuffer(sets[k].as_py(), np.uint64))
        if now is not None:
            yield from found(now, unit)

    return units.select(*UNIT).repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "id long, low long, others long")


CELL = ["region", "path"]


def _same_cell(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined with a table by cell (null-free); the other table's names stay, its cell goes."""
    named = other.withColumnsRenamed({c: f"c_{c}" for c in CELL})
    met = rows.join(named.hint("merge"), (F.col("region") == F.col("c_region")) & (F.col("path") == F.col("c_path")), how)
    return met.drop("c_region", "c_path") if how != "left_anti" else met


def _to_pivots(cells: DataFrame, sets: DataFrame, j: Join, level: int, where: str) -> DataFrame:
    """For each document of each cell its row in every Voronoi region that it belongs to or is replicated to.

    Region 0 is that of the cell's own centre. ``d`` is the distance to the region's pivot, ``d0`` to the centre.
    """
    drawn = cells.groupBy(*CELL, F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(j.sub_pivots)).alias("part")).agg(F.min(F.struct(F.xxhash64(F.lit(level + 99), "id").alias("h"), "id")).alias("p"))
    drawn = drawn.select(*CELL, (F.col("part") + 1).cast("int").alias("idx"), F.col("p.id").alias("p_id"))
    centre = cells.groupBy(*CELL).agg(F.min("centre").alias("p_id")).select(*CELL, F.lit(0).alias("idx"), "p_id")
    pivots = centre.unionByName(drawn).join(sets.select(F.col("id").alias("s_id"), F.col("n").alias("p_n"), F.col("codes").alias("p_codes")).hint("merge"), F.col("p_id") == F.col("s_id"))
    # at most sub_pivots + 1 sets for each cell
    pivots = stored(pivots.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("idx", "p_id", "p_codes"))).alias("pivots")), f"{where}/pivots-{level}")
    own = cells.select(*CELL, "id", "alien").join(sets.select(F.col("id").alias("s_id"), "n", "codes").hint("merge"), F.col("id") == F.col("s_id")).drop("s_id")
    slack, bit = 2 * j.eps + 1e-9, 1 << level

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("region", "path", "id", "alien", "idx", "centre", "d", "d0", "home")}
            for region, path, one, alien, _, mine, pivots in zip(*(batch.column(k) for k in range(7)), strict=True):
                mine, path = np.frombuffer(mine.as_py(), np.uint64), path.as_py()
                d, ids = [], []
                for p in pivots.as_py():
                    other = np.frombuffer(p["p_codes"], np.uint64)
                    inter = len(np.intersect1d(mine, other, assume_unique=True))
                    d.append(1 - inter / max(len(mine) + len(other) - inter, 1))
                    ids.append(p["p_id"])
                home = int(np.argmin(d))
                for k in range(home + 1):
                    if k == home or d[k] <= d[home] + slack:
                        for c, v in zip(out, (region.as_py(), path, one.as_py(), alien.as_py() | (0 if k == home else bit), k, ids[k], d[k], d[0], k == home), strict=True):
                            out[c].append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    met = _same_cell(own, pivots).select(*CELL, "id", "alien", "n", "codes", "pivots")
    return stored(met.mapInArrow(run, "region long, path string, id long, alien long, idx int, centre long, d double, d0 double, home boolean"), f"{where}/regions-{level}")


def _sizes(cells: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    sized = cells.select(*keys, "id").join(sets.select(F.col("id").alias("s_id"), "n").hint("merge"), F.col("id") == F.col("s_id"))
    return sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("codes"))


def _dense_units(cells: DataFrame, sets: DataFrame, j: Join, every: bool, where: str) -> tuple[DataFrame, DataFrame]:
    """Units of two blocks each of the dense cells (rows with d0), and links with their centres."""
    ring = F.floor(F.col("d0") * (2 / j.eps) + 1e-9).cast("int").alias("ring")
    rows = stored(cells.select(*CELL, "id", "alien", "centre", "d0", ring), f"{where}/dense")
    parts = F.greatest(F.ceil(F.col("docs") / j.block_docs), F.ceil(F.col("codes") / j.block_codes)).cast("int")
    sizes = stored(_sizes(rows, sets, [*CELL, "ring"]).select(*CELL, "ring", parts.alias("parts")), f"{where}/rings")
    blocks = sizes.select(*CELL, F.col("ring").alias("ring"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = blocks.select("region", "path", F.col("ring").alias("o_ring"), F.col("part").alias("o_part"))
    # documents in rings three apart are further than eps from each other
    meet = _same_cell(blocks, other).filter("o_ring - ring between 0 and 2 and (o_ring > ring or o_part >= part)")
    if not every:
        meet = meet.filter("o_ring > 1")  # documents in rings 0 and 1 are linked to the centre
    unit = F.concat_ws("/", "region", "path", "ring", "part", "o_ring", "o_part").alias("unit")
    apart = ((F.col("ring") != F.col("o_ring")) | (F.col("part") != F.col("o_part"))).alias("apart")
    both = meet.select(*CELL, unit, apart, F.explode(F.array(F.struct("ring", "part", F.lit(0).alias("side")), F.struct(F.col("o_ring").alias("ring"), F.col("o_part").alias("part"), F.lit(1).alias("side")))).alias("b"))
    both = both.select(*CELL, "unit", "apart", F.col("b.ring").alias("b_ring"), F.col("b.part").alias("b_part"), F.col("b.side").alias("side")).filter("apart or side = 0")
    dealt = rows.join(sizes.select(*[F.col(c).alias(f"z_{c}") for c in [*CELL, "ring"]], "parts").hint("merge"), (F.col("region") == F.col("z_region")) & (F.col("path") == F.col("z_path")) & (F.col("ring") == F.col("z_ring")))
    dealt = dealt.select(*CELL, "id", "alien", "ring", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    units = stored(_same_cell_block(dealt, both).select("unit", "region", "apart", "id", "alien", "side"), f"{where}/dense-units")
    near = rows.filter("ring < 2 and id <> centre").select("id", F.col("centre").alias("low"))
    return units, near


def _same_cell_block(dealt: DataFrame, both: DataFrame) -> DataFrame:
    named = both.withColumnsRenamed({c: f"c_{c}" for c in CELL})
    on = (F.col("region") == F.col("c_region")) & (F.col("path") == F.col("c_path")) & (F.col("ring") == F.col("b_ring")) & (F.col("part") == F.col("b_part"))
    return dealt.join(named.hint("merge"), on)


def links(points: DataFrame, j: Join, where: str, every: bool) -> tuple[DataFrame, DataFrame]:
    """(id, low): connections that have the components of all links; (id, others): rows linked with, complete where ``every``."""
    sets = points.select("id", "n", "copies", "codes")
    met = territories(points, where)
    pivots = stored(met.groupBy(F.col("id").alias("v_id")).agg(F.sort_array(F.collect_list("region")).alias("pivots")), f"{where}/pivot-lists")
    cells = met.select("region", F.lit("").alias("path"), "id", F.lit(0).cast("long").alias("alien"), F.col("region").alias("centre"))
    units, dense = [], []
    for level in range(j.most_levels + 1):
        sizes = stored(_sizes(cells, points, CELL), f"{where}/sizes-{level}")
        large = (F.col("docs") > j.block_docs) | (F.col("codes") > j.block_codes)
        big = sizes.filter(large & (F.col("docs") > 1)).select(*CELL)
        if big.isEmpty():
            units.append(cells)
            break
        units.append(_same_cell(cells, big, "left_anti"))
        split = _to_pivots(_same_cell(cells, big), points, j, level, where)
        parts = split.groupBy(*CELL, "idx").agg(F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("own"))
        whole = parts.groupBy(*CELL).agg(F.sum("rows").alias("rows"), F.sum("own").alias("own"), F.max("rows").alias("most"))
        useful = (F.col("rows") <= j.most_rows * F.col("own")) & (F.col("most") <= j.most_share * F.col("own")) if level < j.most_levels else F.lit(False)
        judged = stored(whole.select(*CELL, useful.alias("useful")), f"{where}/judged-{level}")
        split = _same_cell(split, judged)
        dense.append(split.filter("home and not useful").select(*CELL, "id", F.col("alien").alias("alien"), "d0"))
        dense[-1] = _same_cell(dense[-1], cells.groupBy(*CELL).agg(F.min("centre").alias("centre")))
        cells = stored(split.filter("useful").select("region", F.concat_ws(".", "path", F.col("idx").cast("string")).alias("path"), "id", "alien", "centre"), f"{where}/cells-{level + 1}")
    small = _all(units).select(F.concat_ws("/", "region", "path").alias("unit"), "region", F.lit(False).alias("apart"), "id", "alien", F.lit(0).alias("side"))
    near = None
    if dense:
        more, near = _dense_units(_all(dense), points, j, every, f"{where}/dense")
        small = small.unionByName(more)
    # codes are joined by document, once for each unit it is in
    whole = small.join(pivots.hint("merge"), F.col("id") == F.col("v_id")).join(sets.withColumnRenamed("id", "s_id").hint("merge"), F.col("id") == F.col("s_id"))
    found = stored(compared(whole, j), f"{where}/found")
    low = found.filter("id <> low").select("id", "low")
    return (low if near is None else low.union(near)), found.groupBy("id").agg(F.sum("others").alias("others"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _points(rows: DataFrame, sets: DataFrame, j: Join, where: str) -> DataFrame:
    """id, n, copies, rank, keys and codes of one document of each set that can link with another."""
    spark = rows.sparkSession
    firsts = sets.select(F.col("first").alias("f_id"), F.col("n").alias("f_n"), "copies")
    points, named, narrowed = None, rows.filter("id is not null"), None
    for k, zone in enumerate(j.zones):
        if points is not None:
            ids = points.select("id")
            narrowed = spark.sparkContext.broadcast(blobs.bloom(ids, ids.count(), _ids))
        shared = spark.sparkContext.broadcast(shared_codes(named, narrowed, j, zone, f"{where}/narrow-{k}"))
        able = candidates(named, narrowed, shared, j, zone).join(firsts.hint("merge"), (F.col("id") == F.col("f_id")) & (F.col("n") == F.col("f_n")))
        # rows that repeat an identifier are one point
        points = stored(able.select("id", "n", "copies", "rank", "keys", "codes").dropDuplicates(["id", "n"]), f"{where}/narrow-{k}/points")
        for sent in (shared, narrowed):
            if sent is not None:
                sent.destroy()
    return points


def join_documents(docs: DataFrame, j: Join = Join(), id_col: str = "doc_id", text_col: str = "text", every: bool = True) -> DataFrame:
    """id, n_shingles, component_id and n_links of each row.

    ``n_links`` counts the other rows a row links with, copies too. Without ``every`` it is left out, and only as
    many links are looked for as the components need.
    """
    spark = docs.sparkSession
    where, rows = shared_dir(spark), _rows(docs, id_col, text_col)
    signed = stored(signatures(rows, j), f"{where}/signatures")
    sets = stored(signed.filter("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), f"{where}/sets")
    near, degree = links(_points(rows, sets, j, where), j, where, every)
    label = components(near.select(F.col("id").alias("a"), F.col("low").alias("b")), f"{where}/components")
    named = sets.join(label.hint("merge"), F.col("first") == F.col("node"), "left").drop("node")
    if every:
        named = named.join(degree.hint("merge"), F.col("first") == F.col("id"), "left").drop("id")
    n_links = [(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")] if every else []
    named = stored(named.select("h1", "h2", F.col("n").alias("s_n"), F.coalesce("label", "first").alias("component_id"), *n_links), f"{where}/named")
    out = signed.select("id", F.col("n").alias("n"), F.col("h1").alias("d1"), F.col("h2").alias("d2")).join(
        named.hint("merge"), F.col("id").isNotNull() & (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2")) & (F.col("n") == F.col("s_n")), "left"
    )
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if every else []))


def op1_ngram_join(spark, sf_dir):
    return join_documents(table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark, docs, sf_dir):
    """Pipeline stage: of each component the document with the smallest identifier stays, and rows without an identifier."""
    found = join_documents(docs, every=False).filter("doc_id <> component_id").select("doc_id").distinct()
    gone = found.withColumnRenamed("doc_id", fresh("gone", docs.columns))
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLES: dict[str, str] = {}
