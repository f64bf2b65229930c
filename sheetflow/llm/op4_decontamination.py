"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in a plain form (lower case, runs of anything but letters and digits
become one blank) between two blanks, so an item begins and ends where words do, up to its errors ("cat" is not
found in "concatenation"). An item of n characters has an error budget ``k = floor(error_rate * n)``; it is
cut into k + 1 pieces, and wherever it occurs with at most k edits one piece occurs unchanged. One
Aho-Corasick automaton finds all pieces of all items in one walk over a whole text. A hit is verified
up a binary tree over the pieces: where the whole has at most k errors, some path from the root to a
piece has at most m - 1 errors in each node of m pieces, so a chance hit fails at a pair of pieces already.
Myers' bit-parallel algorithm (one big integer per column) decides each node and gives the distance.

Items are held by the tasks in blocks of at most ``block_chars`` characters, so what is broadcast
is bounded and a larger benchmark means more passes, not a larger automaton. Documents are handled
row by row without a shuffle, so copies and hot sources are no skew.

Defined results: null or blank texts and items match nothing; repeated items and rows are each
matched; item identifiers may have any type and be null; an item shorter than 1 / error_rate must occur unchanged; empty tables give an empty
result; other columns of the inputs are not read (in the stage they are passed on).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import table


@dataclass(frozen=True)
class Budget:
    error_rate: float = 0.1
    block_chars: int = 1_000_000


_other = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return _other.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def char_masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(pattern: str, text: str, k: int, masks: dict[str, int] | None = None) -> int | None:
    """Least distance of the pattern to a substring of the text, if at most k."""
    n = len(pattern)
    masks = char_masks(pattern) if masks is None else masks
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in text:
        eq = masks.get(c, 0)
        d0 = ((((eq | down) & up) + up) ^ up) | eq | down
        h_up = down | (full & ~(d0 | up))
        h_down = up & d0
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
            if score < best:
                best = score
                if not score:
                    break
        h_up = (h_up << 1) & full  # row 0 is free: a match may start anywhere
        h_down = (h_down << 1) & full
        up = h_down | (full & ~(d0 | h_up))
        down = h_up & d0
    return best if best <= k else None


class Finder:
    def __init__(self, items: list[tuple[object, str]], budget: Budget):
        self.items = [(i, f" {t} ", pieces(f" {t} ", int(budget.error_rate * len(t)))) for i, t in ((i, plain(t)) for i, t in items) if t]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, _, cuts) in enumerate(self.items):
            for k, (_, piece) in enumerate(cuts):
                places[piece].append((at, k))
        self.find = ahocorasick.Automaton()
        for piece, where in places.items():
            self.find.add_word(piece, (len(piece), where))
        self.ready = bool(places)
        if self.ready:
            self.find.make_automaton()
        self.nodes: dict[tuple[int, int, int], tuple] = {}

    def _node(self, at: int, first: int, last: int) -> tuple:
        """Offset, pattern and masks of the pieces first to last - 1 of an item."""
        if (at, first, last) not in self.nodes:
            _, text, cuts = self.items[at]
            pattern = text[cuts[first][0] : cuts[last][0] if last < len(cuts) else len(text)]
            self.nodes[at, first, last] = cuts[first][0], pattern, char_masks(pattern)
        return self.nodes[at, first, last]

    def _verify(self, text: str, start: int, at: int, piece: int) -> int | None:
        """Distance of the item to the text around a piece that was found at ``start``."""
        cuts, width, distance = self.items[at][2], 1, 0
        while width < len(cuts):
            width *= 2
            first = piece // width * width
            last = min(first + width, len(cuts))
            offset, pattern, masks = self._node(at, first, last)
            k = last - first - 1
            begin = start - (cuts[piece][0] - offset)
            distance = best_match(pattern, text[max(0, begin - k) : max(0, begin + len(pattern) + k)], k, masks)
            if distance is None:
                return None
        return distance

    def __call__(self, text: str | None) -> list[tuple[object, int]]:
        """(item identifier, distance) of all items that the text contains."""
        text = plain(text)
        if not text or not self.ready:
            return []
        text = f" {text} "
        best: dict[int, int] = {}
        for end, (n, where) in self.find.iter(text):
            for at, piece in where:
                if best.get(at) != 0:
                    distance = self._verify(text, end + 1 - n, at, piece)
                    if distance is not None:
                        best[at] = min(distance, best.get(at, distance))
        return [(self.items[at][0], distance) for at, distance in sorted(best.items())]


def blocks(benchmark: DataFrame, budget: Budget, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, read through an iterator."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col).cast("string")).toLocalIterator():
        n = len(row[1] or "")
        if block and size + n > budget.block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1] or ""))
        size += n
    if block:
        yield block


def _matches(docs: DataFrame, block, budget: Budget, id_col: str, text_col: str, item_kind: DataType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(item_kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, budget)
        for batch in batches:
            at, items, distances = [], [], []
            for k, text in enumerate(batch.column(1)):
                for item, distance in finder(text.as_py()):
                    at.append(k)
                    items.append(item)
                    distances.append(distance)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, item_type), pa.array(distances, pa.int32())], ["id", "item_id", "distance"])

    return rows.mapInArrow(run, f"id {kind}, item_id {item_kind.simpleString()}, distance int").withColumnRenamed("id", id_col)


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """A row (id, item_id, distance) for each document and item that occurs in it within its budget."""
    out, kind = None, benchmark.schema[item_col].dataType
    for block in blocks(benchmark, budget, item_col, item_text):
        found = _matches(docs, block, budget, id_col, text_col, kind)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else _matches(docs.limit(0), [], budget, id_col, text_col, kind)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """The documents that contain no item, all columns kept; no shuffle."""
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, budget, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, budget)
            for batch in batches:
                yield batch.filter(pa.array([not finder(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark, docs, sf_dir):
    """Pipeline stage: documents with a benchmark passage go; the others keep their columns."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES: dict[str, str] = {}
