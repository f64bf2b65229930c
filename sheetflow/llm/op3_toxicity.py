"""Toxicity by multiple-instance learning with a noisy-or.

A document is a bag of sentences; only documents have labels. Each sentence has a probability
``p = sigmoid(b + sum of its features' weights)`` and the document's is the noisy-or
``1 - prod(1 - p)``. The weights are fitted to the document labels through that noisy-or, so they
end up telling *which* sentences offend; those are located in the result.

Features are hashed: each word and its first 4, 5 and 6 bytes (stems of inflected insults). Labels,
language, source and identifiers are no features. Training uses at most ``max_toxic`` +
``max_clean`` labelled documents in a fixed hash order (a documented bound), of those alone whose
crc32 of the identifier modulo ``folds`` is not ``held_fold``. The sample is stored once; its feature counts by class are
folded by the tasks into a table of fixed size, and the driver gets only the features that speak for toxicity, a few bytes for
each sentence. Scoring covers all rows and whole texts in one narrow pass.

Defined results: a null text or one without words has score 0.0 (an empty product); rows without a label are scored
like all others; null labels are no labels; without toxic training documents no
sentence offends (scores near 0), without clean ones all do; repeated rows score alike; an empty
table gives an empty table; other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import shared_dir, stored, table, text_bytes, text_slices
from .wordhash import BASE, INVERSE, _lower, mix, powers, spans


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    prefixes: tuple[int, ...] = (4, 5, 6)
    max_toxic: int = 3000
    max_clean: int = 5000
    rounds: int = 60
    rate: float = 0.3
    min_docs: int = 8
    #: Features count from this log likelihood ratio between toxic and clean documents on.
    min_ratio: float = 1.5
    start: float = -5.0
    folds: int = 4
    held_fold: int = 2
    threshold: float = 0.3
    #: A sentence of this probability or more is reported as offending.
    offending: float = 0.3


#: Bytes of text handled at once: each takes about 80 bytes of arrays.
SLICE = 1 << 18

_separator = np.ones(256, bool)
_separator[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _separator[_a:_b] = False
_stop = np.zeros(256, bool)
_stop[[10, 13, 33, 46, 63]] = True  # line ends ! . ?


def features(data: np.ndarray, offsets: np.ndarray, s: Settings):
    """(features by word and kind, sentence starts among the words, places of rows among the sentences, word starts, word ends)."""
    starts, ends, rows = spans(data, offsets, _separator)
    value = _lower[data] * powers(BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    scale = powers(INVERSE, len(data) + 1)[starts]
    kinds = []
    for k, n in enumerate((None, *s.prefixes)):
        to = ends if n is None else np.minimum(starts + n, ends)
        h = mix((sums[to] - sums[starts]) * scale + np.uint64(k + 1))
        kinds.append((h >> np.uint64(64 - s.bits)).astype(np.int32))
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_stop[data], out=stops[1:])
    part = stops[starts]
    new = np.ones(len(starts), bool)
    new[1:] = part[1:] != part[:-1]
    inner = rows[:-1][rows[:-1] < len(starts)]
    new[inner] = True
    sentence = np.flatnonzero(new)
    return np.stack(kinds, 1) if len(starts) else np.zeros((0, 1 + len(s.prefixes)), np.int32), sentence, np.searchsorted(sentence, rows), starts, ends


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges between the n + 1 places ``at``; empty ranges give 0."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def ratios(seen: np.ndarray, docs: np.ndarray, s: Settings) -> np.ndarray:
    """By feature, how far its log likelihood ratio between the classes is above ``min_ratio``, else 0.

    ``seen``: in how many clean and toxic documents each feature is; ``docs``: how many clean and toxic ones there are.
    """
    clean, toxic = seen.astype(np.float64)
    ratio = np.log(((toxic + 0.5) / (docs[1] + 1)) / ((clean + 0.5) / (docs[0] + 1)))
    return np.where(toxic + clean >= s.min_docs, np.maximum(ratio - s.min_ratio, 0.0), 0.0)


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], scale: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, identifiers of features of scale above 0, number of these in each sentence).

    Only features seen in ``min_docs`` documents that speak for toxicity can have a weight, never
    below 0: words that a single document has would otherwise explain its label.
    """
    weights, bias = np.zeros(1 << s.bits, np.float32), s.start
    labels = np.array([y for y, _, _ in bags], bool)
    if not labels.any() or labels.all():
        share = float(labels.mean()) if len(labels) else 0.0
        return weights, -700.0 if share == 0 else 700.0
    docs = np.concatenate([[0], np.cumsum([len(n) for _, _, n in bags])])
    ids, sizes = np.concatenate([c for _, c, _ in bags]), np.concatenate([n for _, _, n in bags])
    cells = np.concatenate([[0], np.cumsum(sizes)])
    raw, seen, seen_bias = np.zeros(1 << s.bits), np.zeros(1 << s.bits), 1e-6
    for _ in range(s.rounds):
        x = _sums((raw * scale)[ids], cells) + bias
        total = _sums(_softplus(x), docs)
        alive = np.exp(-total)
        push = np.where(labels, np.maximum(-alive / np.maximum(1 - alive, 1e-9), -50.0), 1.0) / len(bags)
        slope = np.repeat(push, np.diff(docs)) / (1 + np.exp(-x))
        grad = np.bincount(ids, weights=np.repeat(slope, sizes), minlength=1 << s.bits) * scale
        seen += grad * grad
        raw = np.maximum(raw - s.rate * grad / np.sqrt(seen + 1e-8), 0.0)
        g = float(slope.sum())
        seen_bias += g * g
        bias -= 0.5 * g / seen_bias**0.5
    return (raw * scale).astype(np.float32), float(bias)


def held_out(id_col: str, s: Settings):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % s.folds == s.held_fold


def _training(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str, label_col: str) -> tuple[list, np.ndarray]:
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and l_id is not null")
    known = known.filter(~held_out("l_id", s)).groupBy("l_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(5), F.col("l_id"))
    chosen = known.filter("y = 1").orderBy(order, "l_id").limit(s.max_toxic).union(known.filter("y = 0").orderBy(order, "l_id").limit(s.max_clean))
    # at most max_toxic + max_clean identifiers: a proven bound for the broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("l_id"))

    rows = stored(rows.select("text", "y"), f"{shared_dir(docs.sparkSession)}/sample")

    def count(table: np.ndarray, batch: pa.RecordBatch) -> None:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, texts in text_slices(batch.column(0), SLICE):
            ids, sentence, at, starts, _ = features(*text_bytes(texts), s)
            places = np.append(sentence, len(starts))
            for k in range(b - a):
                table[(int(y[a + k]) << s.bits) + np.unique(ids[places[at[k]] : places[at[k + 1]]])] += 1

    seen = blobs.gather(rows, count, 2 << s.bits, "int32", np.add).reshape(2, -1)
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = ratios(seen, np.array([sizes.get(0, 0), sizes.get(1, 0)]), s)
    shared = docs.sparkSession.sparkContext.broadcast(scale > 0)  # 2**bits flags, a fixed size

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(0), SLICE):
                ids, sentence, at, starts, _ = features(*text_bytes(texts), s)
                places = np.append(sentence, len(starts))
                kept = shared.value[ids]
                inside = np.concatenate([[0], np.cumsum(kept.sum(1))])[places]
                cells, each = [], []
                for k in range(b - a):
                    lo, hi = places[at[k]], places[at[k + 1]]
                    cells.append(ids[lo:hi][kept[lo:hi]].tobytes())
                    each.append(np.diff(inside[at[k] : at[k + 1] + 1]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(cells, pa.binary()), pa.array(each, pa.binary())], ["y", "ids", "sizes"])

    # at most max_toxic + max_clean rows; a fixed order: sums of floats, and so the weights, do not depend on the partitions
    found = sorted((r.y, bytes(r.ids), bytes(r.sizes)) for r in rows.mapInArrow(bags, "y int, ids binary, sizes binary").collect())
    shared.destroy()
    return [(y, np.frombuffer(ids, np.int32), np.frombuffer(n, np.int32)) for y, ids, n in found], scale


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    return Model(*fit(*_training(docs, labels, s, id_col, text_col, label_col), s), s)


SCORED = "score double, n_sentences int, offending array<struct<sentence:int,start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the identifier), score, number of sentences and located sentences (character ranges)."""
    s, spark = model.settings, docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # 2**bits floats, a fixed size
    keep = [id_col] if keep is None else keep
    # a text that is kept anyway is sent once
    at_hand = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"
    rows = docs.select(*[F.col(c) for c in keep], *([] if at_hand else [F.col(text_col).cast("string").alias("__scored_text")]))
    place = keep.index(text_col) if at_hand else len(keep)
    spot = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for a, b, texts in text_slices(batch.column(place), SLICE):
                data, offsets = text_bytes(texts)
                ids, sentence, at, starts, ends = features(data, offsets, s)
                x = _sums(weights[ids].sum(1, dtype=np.float64), np.append(sentence, len(starts))) + bias
                total = _sums(_softplus(x), at)
                p = 1 / (1 + np.exp(-np.clip(x, -700, 700)))
                bad = np.flatnonzero(p >= s.offending)
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                last = np.append(sentence[1:], len(starts))[bad] - 1
                row = np.searchsorted(at, bad, "right") - 1
                base = chars[offsets[row]]
                spots: list[list[dict]] = [[] for _ in range(b - a)]
                for r, k, lo, hi, q in zip(row, bad - at[row], chars[starts[sentence[bad]]] - base, chars[ends[last]] - base, p[bad], strict=True):
                    spots[r].append({"sentence": int(k), "start": int(lo), "end": int(hi), "score": float(q)})
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in range(len(keep))), pa.array(np.clip(-np.expm1(-total), 0.0, 1.0)), pa.array(np.diff(at).astype(np.int32)), pa.array(spots, spot)],
                    [*keep, "score", "n_sentences", "offending"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{kept}, {SCORED}" if kept else SCORED)


def op3_toxicity(spark, sf_dir):
    s = Settings()
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels"), s))
    return out.select("doc_id", held_out("doc_id", s).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"), "n_sentences", "offending")


def toxicity_stage(spark, docs, sf_dir):
    """Pipeline stage: documents of score ``threshold`` or more go; the others keep their columns."""
    s = Settings()
    model = train(docs, table(spark, sf_dir, "labels"), s)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # columns of any names
    kept = score(plain, model, text_col=f"c{docs.columns.index('text')}", keep=plain.columns).filter(F.col("score") < s.threshold)
    return kept.select(*plain.columns).toDF(*docs.columns)


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
