"""Substring dedup with a log-structured fingerprint index over windows of 50 words.

A window is judged by all its words, yet no row is made for each window. Inside a window the least
hash of its 8-word runs is its *anchor*, which equal windows share wherever they stand. Neighbouring
windows with the same anchor form a *segment*; the index holds a row (anchor, segment hash, second segment hash, first
document) for each distinct segment, about one for 22 words.

The index is log-structured. A batch of documents (ascending identifiers) becomes one immutable run, bucketed and
sorted by anchor, of the segments that no run before it has. A batch is merge-joined with the runs of history bucket
by bucket, so history is neither shuffled nor rewritten:

* a segment that starts in an earlier document, with both hashes equal, covers all its words;
* where an anchor of the batch stands in several different segments, single windows may still agree. Only the first
  document of each such segment lists its windows, and they are verified one by one by an independent hash
  (64 bits of the window, 64 of its anchor). Of history only the documents of such segments are read again: a window
  for each word kept in the runs would be larger than the texts.

``fanout`` runs of one level are compacted into one of the next, so a row is rewritten once for each level. A manifest
names the runs after each batch; an index is opened again from its folder, and what a broken batch left behind is
not in it. Bloom filters of bounded size tell the scan which documents and segments to list; a false positive
costs a few rows, never a wrong result.

Hot passages: minima are taken map-side, and a passage is one row of a run however many documents have it.

Defined results: null or empty texts have no words (the digest is that of the empty string); texts of
fewer than 50 words lose nothing; repetition inside one document is no reason to remove; rows with
the same identifier never remove each other's words, and ranges found in one apply to all of them; rows without an
identifier lose nothing and take nothing from others; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs
from .common import shared_dir, stored, table, text_bytes, text_slices
from .wordhash import BASE, INVERSE, SLICE, mix, polynomial_runs, powers, runs, words

WINDOW, GRAM = 50, 8


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _spans(h: np.ndarray, place: np.ndarray, span: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the ``span`` words from each place on."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(salt)) * powers(BASE, len(h)), out=sums[1:])
    return mix((sums[place + span] - sums[place]) * powers(INVERSE, len(h) + 1)[place] + span.astype(np.uint64))


def segments(data: np.ndarray, offsets: np.ndarray):
    """All segments of a batch.

    Returns word hashes, window anchors, and for each segment: row, first word in the row, number of
    windows, place of its first window among the words, two hashes.
    """
    h, _, _, rows = words(data, offsets)
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return h, np.zeros(0, np.uint64), none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    anchor = _least(runs(h, GRAM), WINDOW - GRAM + 1)
    counts = np.diff(rows)
    at = np.repeat(np.arange(len(counts)), np.maximum(counts - WINDOW + 1, 0))
    first = np.cumsum(np.maximum(counts - WINDOW + 1, 0)) - np.maximum(counts - WINDOW + 1, 0)
    window = np.arange(len(at)) - first[at] + rows[at]
    mine = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (at[1:] != at[:-1])
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(window)))
    place = window[head]
    span = length + WINDOW - 1
    code, check = (_spans(h, place, span, salt) for salt in (0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7))
    row = at[head]
    return h, anchor, row, place - rows[row], length, place, code, check


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def scan(docs: DataFrame) -> DataFrame:
    """A row (doc_id, anchor, segment, check, start, windows) for each segment of (doc_id, text) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in text_slices(batch.column(1), SLICE):
                _, anchor, row, start, length, place, code, check = segments(*text_bytes(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(row)), _signed(anchor[place]), _signed(code), _signed(check), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))],
                    ["doc_id", "anchor", "segment", "check", "start", "windows"],
                )

    return docs.mapInArrow(run, "doc_id long, anchor long, segment long, check long, start int, windows int")


def _pair(segment: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(segment.view(np.uint64) ^ mix(doc.view(np.uint64) + np.uint64(11)))


def list_windows(docs: DataFrame, wanted) -> DataFrame:
    """A row (anchor, window, doc_id, start) for each window of the documents and segments that the shared filters let pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_docs, of_pairs = wanted.value
        for batch in batches:
            batch = batch.filter(pa.array(blobs.bloom_has(of_docs, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, texts in text_slices(batch.column(1), SLICE):
                h, anchor, row, start, length, place, code, _ = segments(*text_bytes(texts))
                doc = ids[a:b][row]
                keep = np.flatnonzero(blobs.bloom_has(of_pairs, _pair(code, doc)))
                n = length[keep]
                own = np.repeat(keep, n)
                inner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                window = polynomial_runs(h, WINDOW)[place[own] + inner] if len(own) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [_signed(anchor[place[own]]), _signed(window), pa.array(doc[own]), pa.array((start[own] + inner).astype(np.int32))],
                    ["anchor", "window", "doc_id", "start"],
                )

    return docs.mapInArrow(run, "anchor long, window long, doc_id long, start int")


KEY = ["anchor", "segment", "check"]


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A merge join on columns without nulls; the right table's keys go."""
    named = right.withColumnsRenamed({k: f"j_{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & (F.col(k) == F.col(f"j_{k}"))
    out = left.join(named.hint("merge"), met, how)
    return out.drop(*[f"j_{k}" for k in keys]) if how in ("inner", "left") else out


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Joins planned here may use buckets by fewer columns than they compare (a setting of the session meanwhile).

    Left alone, Spark shuffles both sides of a join on (anchor, segment, check), history among them, and the rows come out by
    all three: each task would then write a file for every bucket.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class WindowIndex:
    """Immutable sorted runs of (anchor, segment, check, first) under ``where``, a folder of the shared storage.

    An index that is there already is opened again. ``buckets`` is fixed when it is made, the shuffle partitions of the
    session by default.
    """

    def __init__(self, spark: SparkSession, where: str, fanout: int = 4, buckets: int | None = None):
        self.spark, self.where, self.fanout = spark, where, fanout
        self.batches, self.runs = 0, []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        last = self._manifest()
        if last:
            self.batches, self.buckets = last[0].batch + 1, last[0].buckets
            self.runs = [(r.name, r.level, self._open(r.name)) for r in sorted(last, key=lambda r: r.place) if r.name]

    def _manifest(self) -> list:
        """Rows of the last batch: batch, buckets, place, name, level."""
        try:
            every = self.spark.read.parquet(f"{self.where}/manifest")
        except AnalysisException:
            return []
        rows = every.collect()  # a few rows for each batch
        newest = max((r.batch for r in rows), default=None)
        return [r for r in rows if r.batch == newest]

    def _publish(self) -> None:
        rows = [(self.buckets, k, name, level) for k, (name, level, _) in enumerate(self.runs)] or [(self.buckets, 0, None, 0)]
        self.spark.createDataFrame(rows, "buckets int, place int, name string, level int").coalesce(1).write.mode("overwrite").parquet(f"{self.where}/manifest/batch={self.batches - 1}")

    def _open(self, name: str) -> DataFrame:
        table = f"run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} (anchor BIGINT, segment BIGINT, `check` BIGINT, first BIGINT, old BOOLEAN) USING parquet "
            f"CLUSTERED BY (anchor) SORTED BY (anchor, segment) INTO {self.buckets} BUCKETS LOCATION '{self.where}/{name}'"
        )
        return self.spark.table(table).filter("not old").select(*KEY, "first")

    def _bucketed(self, rows: DataFrame, name: str) -> DataFrame:
        """Store rows bucketed and sorted by anchor: joins on anchor with other such tables need no shuffle."""
        table = f"run_{uuid.uuid4().hex}"
        sort = [c for c in ("anchor", "segment") if c in rows.columns]
        rows.write.bucketBy(self.buckets, "anchor").sortBy(*sort).format("parquet").option("path", f"{self.where}/{name}").mode("overwrite").saveAsTable(table)
        return self.spark.table(table)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "anchor")

    def _merged(self, found: DataFrame) -> DataFrame:
        """KEY, first, old of the segments of a batch, old if a run of history has them; to be planned ``in_place``."""
        mine = self._dealt(found.groupBy(*KEY).agg(F.min("doc_id").alias("own")))
        for i, (_, _, run) in enumerate(self.runs):
            mine = _on(mine, run.withColumnRenamed("first", f"first_{i}"), KEY, "left")
        known = [F.col(f"first_{i}") for i in range(len(self.runs))]
        known = F.coalesce(*known) if known else F.lit(None).cast("long")  # runs hold different segments
        return mine.select(*KEY, F.coalesce(known, "own").alias("first"), known.isNotNull().alias("old"))

    def add(self, batch: DataFrame, history: DataFrame | None = None, above: int | None = None) -> DataFrame:
        """Index a batch of (doc_id, text); returns its repeated ranges (doc_id, start, length).

        ``history`` are the documents indexed before; their identifiers end at ``above`` and those of
        ``batch`` are greater.
        """
        k, self.batches = self.batches, self.batches + 1
        at = f"{self.where}/batch{k}-{uuid.uuid4().hex}"
        found = stored(scan(batch), f"{at}/segments")
        name = f"runs/{k}-{uuid.uuid4().hex}"
        with in_place(self.spark):
            merged = self._bucketed(self._merged(found), name)
        whole = _on(found, merged.select(*KEY, "first"), KEY).filter("first < doc_id")
        whole = whole.select("doc_id", "start", (F.col("windows") + (WINDOW - 1)).alias("length"))

        # anchors of the batch with several segments, here or in history
        pair = F.struct("segment", "check")
        ends = merged.groupBy("anchor").agg(F.min(pair).alias("a"), F.max(pair).alias("b"))
        for i, (_, _, run) in enumerate(self.runs):
            there = run.groupBy("anchor").agg(F.min(pair).alias(f"a{i}"), F.max(pair).alias(f"b{i}"))
            ends = _on(ends, there, ["anchor"], "left").select("anchor", F.least("a", f"a{i}").alias("a"), F.greatest("b", f"b{i}").alias("b"))
        contested = self._bucketed(ends.filter("a <> b").select("anchor"), f"batch{k}-contested-{uuid.uuid4().hex}")
        new = merged.filter("not old").select(*KEY, "first")
        firsts = [_on(run, contested, ["anchor"]).select("segment", "first") for run in (*[r for _, _, r in self.runs], new)]
        listed = self._listed(firsts, batch if history is None else history.unionByName(batch), at)
        owners = stored(
            listed.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
            .select("anchor", "window", "first"), f"{at}/owners",
        )
        single = _on(listed, owners, ["anchor", "window"]).filter("first < doc_id")
        if above is not None:  # windows of history were judged in their own batch
            single = single.filter(F.col("doc_id") > above)
        self.runs.append((name, 0, new))
        self._compact()
        self._publish()
        return whole.unionByName(single.select("doc_id", "start", F.lit(WINDOW).alias("length")))

    def _listed(self, firsts: list[DataFrame], docs: DataFrame, at: str) -> DataFrame:
        every = firsts[0]
        for part in firsts[1:]:
            every = every.unionByName(part)
        every = stored(every, f"{at}/firsts")
        column = lambda b, i: b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
        size = blobs.bloom_size(every.count()) // 8

        def fill(table: np.ndarray, b: pa.RecordBatch) -> None:
            blobs.bloom_add(table[:size], column(b, 1).view(np.uint64))
            blobs.bloom_add(table[size:], _pair(column(b, 0), column(b, 1)))

        both = blobs.gather(every, fill, 2 * size, "uint8", np.bitwise_or)
        filters = both[:size], both[size:]
        wanted = self.spark.sparkContext.broadcast(filters)
        out = stored(list_windows(docs, wanted), f"{at}/windows")
        wanted.destroy()
        return out

    def _compact(self) -> None:
        """While a level has ``fanout`` runs, make them one of the next; runs never share a segment."""
        level = 0
        while any(x[1] >= level for x in self.runs):
            these = [x for x in self.runs if x[1] == level]
            if len(these) >= self.fanout:
                every = these[0][2]
                for x in these[1:]:
                    every = every.unionByName(x[2])
                name = f"runs/level{level + 1}-{uuid.uuid4().hex}"
                whole = self._bucketed(self._dealt(every).withColumn("old", F.lit(False)), name)
                self.runs = [x for x in self.runs if x[1] != level] + [(name, level + 1, whole.filter("not old").select(*KEY, "first"))]
            level += 1


def remove_repeats(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of each row, indexed batch by batch."""
    spark = docs.sparkSession
    where = shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = rows.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.05) if batches > 1 else []
    bounds = sorted({int(c) for c in cuts})
    index, ranges, low = WindowIndex(spark, where), None, None
    known = rows.filter("doc_id is not null")
    for k in range(len(bounds) + 1):
        batch = known if low is None else known.filter(F.col("doc_id") > low)
        batch = batch.filter(F.col("doc_id") <= bounds[k]) if k < len(bounds) else batch
        found = index.add(batch, None if low is None else known.filter(F.col("doc_id") <= low), low)
        ranges = found if ranges is None else ranges.unionByName(found)
        low = bounds[k] if k < len(bounds) else low
    # the ranges of a document are no more than its words
    by_doc = ranges.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths")).withColumnRenamed("doc_id", "r_doc")
    joined = rows.join(by_doc, F.col("doc_id") == F.col("r_doc"), "left").select("doc_id", "text", "starts", "lengths")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, kept_texts = [], [], [], []
            for text, starts, lengths in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                found = text.as_py().encode().split()
                total.append(len(found))
                if starts.is_valid:
                    edge = np.zeros(len(found) + 1, np.int64)
                    begin = starts.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, np.minimum(begin, len(found)), 1)
                    np.add.at(edge, np.minimum(begin + lengths.values.to_numpy(zero_copy_only=False), len(found)), -1)
                    found = [found[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                kept = b" ".join(found)
                removed.append(total[-1] - len(found))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return (out if keep_text else out.drop("kept")).withColumnRenamed("doc_id", id_col)


def op8_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES: dict[str, str] = {}
