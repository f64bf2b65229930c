"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every document's size is counted, and sizes are summed by source and *block* (a hash of the
   identifier deals each source's documents into blocks, so a source of any size is never in one
   task).
2. Targets: the total size is shared by weight, no source above ``cap`` times its own size; what is
   above goes to the others by weight until none is above.
3. A source's blocks stand in a random permuted order. Its target is so many whole passes over all
   blocks, then whole blocks of a further pass, then a part of one *boundary* block, whose documents
   are taken in hashed order while they fit (hash ranges are summed first, so that only one range of a block needs its
   rows in order); the boundary draw is one more draw of the tree.
4. The block draws of all sources are dealt to the output shards by a binary tree: at each node the
   draws that go left are a multivariate-hypergeometric sample of the node's quotas, so every shard
   has an exact quota of blocks of each source and the shards' draws are disjoint. Leaves take their
   quotas in permuted order.
5. ``draws`` gives a row for each draw of a document: its shard and its local position there, in the order of
   a hash of the draw. Positions are counted in hash ranges of a shard, so no shard is sorted in one task.

The driver holds block sums only: at most ``max_blocks`` for each source and about ``most_blocks`` in all, and no more than
``max_sources`` sources (checked; more is an error, not a cut). With more documents blocks are larger, not more.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own,
ordered last; an empty source name sorts first; a source without words has target 0; rows of one source
with one identifier share a block and are taken alike (in other sources the identifier is another document); a null
identifier is one like any other; an empty table gives an empty table. Column names
of the input never clash, as only the three named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    cap: float = 3.0
    shards: int = 64
    seed: int = 17
    docs_per_block: int = 64
    max_blocks: int = 4096
    most_blocks: int = 1 << 18
    #: Hash ranges of a boundary block, a power of two.
    ranges: int = 256
    max_sources: int = 100_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), words.alias("size"), F.col(source_col).cast("string").alias("source"))


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / whole > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = cap * float(sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def split_tree(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact block quotas, one row for each shard and one column for each source."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    total = int(quota.sum())
    draw = min(total, round(total * left / shards))
    # numpy's marginal method is exact for any totals below 1e9
    mine = rng.multivariate_hypergeometric(quota, draw, method="marginals") if total else quota * 0
    return np.concatenate([split_tree(mine, left, rng), split_tree(quota - mine, shards - left, rng)])


def _plan(blocks: list, p: Mix) -> tuple[list, list]:
    """From (source, block, words): per source (source, size, target), and per block its draws."""
    by: dict = {}
    for source, block, words in blocks:
        by.setdefault(source, {})[block] = words
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    sizes = [sum(by[s].values()) for s in names]
    goal = targets(sizes, [p.weights[i % len(p.weights)] for i in range(len(names))], p.cap)
    rng = np.random.default_rng(p.seed)
    orders, draws, parts = [], [], []
    for s, size, want in zip(names, sizes, goal, strict=True):
        order = [int(b) for b in rng.permutation(sorted(by[s]))]
        passes = min(int(want // size), int(p.cap)) if size else 0
        rest = want - passes * size
        take = 0
        while take < len(order) and by[s][order[take]] <= rest:
            rest -= by[s][order[take]]
            take += 1
        orders.append(order)
        parts.append((order[take], int(rest)) if take < len(order) and rest >= 1 and passes < p.cap else (None, 0))
        draws.append(passes * len(order) + take + (parts[-1][0] is not None))
    quotas = split_tree(np.array(draws, np.int64), p.shards, rng) if names else np.zeros((p.shards, 0), np.int64)
    plan = []
    for i, s in enumerate(names):
        shard_of = np.repeat(np.arange(p.shards), quotas[:, i])
        n = len(orders[i])
        for k, block in enumerate(orders[i]):
            mine = [int(x) for x in shard_of[k::n]] if n else []
            part = parts[i][0] == block
            last = mine.pop() if part else None  # the boundary draw is the source's last
            plan.append((s, block, len(mine), mine, parts[i][1] if part else 0, last))
    return [(s, a, float(t)) for s, a, t in zip(names, sizes, goal, strict=True)], plan


def _boundary(rows: DataFrame, order_key, p: Mix) -> DataFrame:
    """(p_source, p_doc, part_copy) of the documents of boundary blocks (source, doc_id, size, part) that fit in hashed order."""
    each = rows.groupBy("source", "doc_id").agg(F.sum("size").alias("words"), F.min("part").alias("part"))
    each = each.withColumn("at", order_key).withColumn("range", F.shiftrightunsigned("at", 64 - (p.ranges.bit_length() - 1)))
    sums = each.groupBy(F.col("source").alias("z_source"), F.col("range").alias("z_range")).agg(F.sum("words").alias("words_in"))
    # a row for each range of a source
    sums = sums.withColumn("before", F.expr("sum(words_in) OVER (PARTITION BY z_source ORDER BY z_range) - words_in"))
    placed = each.join(sums, F.col("source").eqNullSafe(F.col("z_source")) & (F.col("range") == F.col("z_range"))).filter("before <= part")
    whole = placed.filter("before + words_in <= part").select("source", "doc_id")
    last = placed.filter("before + words_in > part").withColumn("upto", F.expr("before + sum(words) OVER (PARTITION BY source, range ORDER BY at, doc_id ROWS UNBOUNDED PRECEDING)"))
    fits = whole.unionByName(last.filter("upto <= part").select("source", "doc_id"))
    return fits.select(F.col("source").alias("p_source"), F.col("doc_id").alias("p_doc"), F.lit(1).alias("part_copy"))


def mix(docs: DataFrame, p: Mix = Mix(), id_col="doc_id", text_col="text", source_col="source", weights_of=None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, part_copy, shards, order_key, part_shard."""
    spark = docs.sparkSession
    where = shared_dir(spark)
    rows = stored(sized(docs, id_col, text_col, source_col), f"{where}/sizes")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs")).limit(p.max_sources + 1).collect()
    if len(counts) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources; raise Mix.max_sources")
    fans = [min(p.max_blocks, -(-c.docs // p.docs_per_block)) for c in counts]
    share = min(1.0, p.most_blocks / max(sum(fans), 1))
    fan = spark.createDataFrame([(c.source, max(1, int(n * share))) for c, n in zip(counts, fans, strict=True)], "source string, fan int")
    hashed = F.xxhash64(F.lit(p.seed), F.col("doc_id"))
    dealt = (
        rows.join(F.broadcast(fan.withColumnRenamed("source", "fan_source")), F.col("source").eqNullSafe(F.col("fan_source")))
        .select("doc_id", "size", "source", F.pmod(hashed, F.col("fan")).cast("int").alias("block"))
    )
    sums = dealt.groupBy("source", "block").agg(F.sum("size").alias("words")).collect()
    of_source, plan = _plan([(r.source, r.block, int(r.words)) for r in sums], p)
    sources = spark.createDataFrame(of_source, "s_source string, source_size long, target double")
    blocks = spark.createDataFrame(plan, "b_source string, b_block int, copies int, shards array<int>, part long, part_shard int")
    # both tables are bounded by max_sources and max_blocks; Spark broadcasts them only under its own size limit
    joined = dealt.join(blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))).join(
        F.broadcast(sources), F.col("source").eqNullSafe(F.col("s_source"))
    )
    order_key = F.xxhash64(F.lit(p.seed + 1), F.col("doc_id"))
    fits = _boundary(joined.filter("part > 0").select("source", "doc_id", "size", "part"), order_key, p)
    extra = F.coalesce(F.col("part_copy"), F.lit(0))
    return joined.join(fits, F.col("doc_id").eqNullSafe(F.col("p_doc")) & F.col("source").eqNullSafe(F.col("p_source")), "left").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("copies") + extra)).cast("long").alias("taken"),
        "copies", extra.alias("part_copy"),
        F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"),
        order_key.alias("order_key"),
        F.when(extra > 0, F.col("part_shard")).alias("part_shard"),
    )


def draws(mixed: DataFrame, p: Mix = Mix(), ranges: int = 64) -> DataFrame:
    """One row per draw of a document of ``mix``: shard, position (from 0, shuffled), doc_id, source, size, draw."""
    whole = F.filter(F.split("shards", ","), lambda x: x != "").cast("array<int>")
    every = F.concat(whole, F.when(F.col("part_shard").isNull(), F.array().cast("array<int>")).otherwise(F.array("part_shard")))
    rows = mixed.select("doc_id", "source", "size", F.posexplode(every).alias("draw", "shard"))
    rows = rows.withColumn("at", F.xxhash64(F.lit(p.seed + 2), "doc_id", "source", "draw")).withColumn("range", F.shiftrightunsigned("at", 32) * ranges / F.lit(1 << 32))
    rows = stored(rows.withColumn("range", F.floor("range").cast("int")), f"{shared_dir(mixed.sparkSession)}/draws")
    # at most shards x ranges counts
    before = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("shard").alias("b_shard"), F.col("range").alias("b_range"), F.expr("sum(n) OVER (PARTITION BY shard ORDER BY range) - n").alias("before")
    )
    placed = rows.withColumn("place", F.expr("row_number() OVER (PARTITION BY shard, range ORDER BY shiftrightunsigned(at, 32), at, doc_id, source, draw)"))
    placed = placed.join(F.broadcast(before), (F.col("shard") == F.col("b_shard")) & (F.col("range") == F.col("b_range")))
    return placed.select("shard", (F.col("before") + F.col("place") - 1).cast("long").alias("position"), "doc_id", "source", "size", "draw")


def op6_mixing(spark, sf_dir):
    """``mix`` with the shard:position of each document's draws."""
    mixed = stored(mix(table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/mixed")
    # rows that repeat an identifier have the draws of all of them
    placed = draws(mixed).groupBy(F.col("doc_id").alias("d_doc"), F.col("source").alias("d_source")).agg(F.array_sort(F.collect_list(F.struct("shard", "position"))).alias("places"))
    text = F.array_join(F.transform("places", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["position"].cast("string"))), ",")
    on = F.col("doc_id").eqNullSafe(F.col("d_doc")) & F.col("source").eqNullSafe(F.col("d_source"))
    return mixed.join(placed, on, "left").select(*mixed.columns, F.coalesce(text, F.lit("")).alias("draws"))


def mixing_stage(spark, docs, sf_dir):
    """Pipeline stage, the last: how many words the mix takes of each document that is left."""
    return mix(docs)


QUERIES = {"op6_mixing": op6_mixing}
ORACLES: dict[str, str] = {}
