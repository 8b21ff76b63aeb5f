"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words in lower case and the beginnings of longer ones, hashed into a fixed
number of buckets.  Buckets whose presence is tied to the label by a likelihood ratio test are kept.  The machine
has a weight and a vector for each of them, so that a pair of terms, such as an insult and the mention of a group,
counts for more or less than its two weights.  Each partition of the training rows takes some passes
of adaptive gradient steps from the same point, and the points that they reach are averaged; a few such
rounds make the model.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, text_of

BUCKETS = 1 << 20
FACTORS = 4
#: Lengths of the beginnings of longer words that are terms too.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Labelled rows that the model is fitted to, at most; of more, those with the least hashes of their ids.
SAMPLE = 20_000
#: A bucket is kept from this many standard deviations on, if so many rows have it.
DEVIATIONS, MIN_ROWS = 3.5, 3
ROUNDS, PASSES, STEP, PENALTY, BATCH = 3, 5, 0.1, 1e-4, 64
#: Rows of a partition in training; so many partitions at most.
PART_ROWS, PARTS = 2_500, 8
SEED = 20240229
FLAG_AT = 0.7
#: Words whose buckets a task remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def buckets_of(word: str) -> list[int]:
    """The buckets of a word and of its beginnings."""
    beginnings = [b"^" + word[:n].encode("utf-8", "surrogatepass") for n in BEGINNINGS if len(word) > n]
    return [zlib.crc32(x) % BUCKETS for x in (word.encode("utf-8", "surrogatepass"), *beginnings)]


def terms(text: str) -> list[int]:
    """The distinct buckets of a text, in order."""
    return sorted({b for word in set(_WORD.findall(text.lower())) for b in buckets_of(word)})


@dataclass(frozen=True)
class ToxicityModel:
    """Bias, and a weight and a vector for each kept bucket; no larger than the number of buckets."""

    kept: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of texts whose places in kept lie one after the other."""
        return _forward(self, slots, np.diff(starts))[0]

    def scorer(self):
        """A function from a text to its probability of label 1."""
        place = {int(b): k for k, b in enumerate(self.kept)}
        known: dict[str, tuple[int, ...]] = {}

        def slots_of(word: str) -> tuple[int, ...]:
            found = known.get(word)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[word] = tuple(place[b] for b in buckets_of(word) if b in place)
            return found

        def score(text: str) -> float:
            slots = sorted({k for word in set(_WORD.findall(text.lower())) for k in slots_of(word)})
            v = self.vectors[slots]
            pairs = ((v.sum(axis=0) ** 2).sum() - (v**2).sum()) / 2 if slots else 0.0
            return _sigmoid(self.bias + self.weights[slots].sum() + pairs)

        return score


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(model: ToxicityModel, slots: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of each text, the sum of its vectors, and the text of each slot."""
    n = len(sizes)
    text = np.repeat(np.arange(n), sizes)
    v = model.vectors[slots]
    sums = np.stack([np.bincount(text, v[:, f], minlength=n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(text, (v**2).sum(axis=1), minlength=n)
    linear = np.bincount(text, model.weights[slots], minlength=n)
    return model.bias + linear + ((sums**2).sum(axis=1) - squares) / 2, sums, text


def trained(model: ToxicityModel, slots: np.ndarray, sizes: np.ndarray, y: np.ndarray, seed: int) -> ToxicityModel:
    """The model after some passes over these texts, from where it stands."""
    bias, weights, vectors = model.bias, model.weights.copy(), model.vectors.copy()
    bias_seen, weights_seen, vectors_seen = 1e-6, np.full_like(weights, 1e-6), np.full_like(vectors, 1e-6)
    draw = np.random.default_rng(seed)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(PASSES):
        order = draw.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            size = sizes[rows]
            first = np.cumsum(size) - size
            own = slots[np.repeat(starts[rows] - first, size) + np.arange(size.sum())]
            z, sums, text = _forward(replace(model, bias=bias, weights=weights, vectors=vectors), own, size)
            error = (_sigmoid(z) - y[rows]) / len(rows)
            used, where = np.unique(own, return_inverse=True)
            slope = np.bincount(where, error[text], minlength=len(used)) + PENALTY * weights[used]
            # Of the pairs' sum the slope by a term's vector is the sum of the other terms' vectors.
            others = error[text][:, None] * (sums[text] - vectors[own])
            bend = np.stack([np.bincount(where, others[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1)
            bend = bend + PENALTY * vectors[used]
            weights_seen[used] += slope**2
            weights[used] -= STEP * slope / np.sqrt(weights_seen[used])
            vectors_seen[used] += bend**2
            vectors[used] -= STEP * bend / np.sqrt(vectors_seen[used])
            bias_seen += error.sum() ** 2
            bias -= STEP * error.sum() / math.sqrt(bias_seen)
    return replace(model, bias=bias, weights=weights, vectors=vectors)


def _deviations(rows: float, toxic: float) -> Column:
    """Standard deviations that n rows with y toxic ones among them are away from chance."""
    n, y = F.col("n"), F.col("y")
    share = toxic / rows
    cells = ((y, n * share), (n - y, n * (1 - share)), (toxic - y, (rows - n) * share), (rows - toxic - n + y, (rows - n) * (1 - share)))
    parts = [F.when(seen > 0, seen * F.log(seen / meant)).otherwise(0.0) for seen, meant in cells]
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (parts[0] + parts[1] + parts[2] + parts[3])))


def held_out(id_col: str | Column = "doc_id") -> Column:
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(id, y): at most sample labels that may be learned; of several labels of an id the highest counts, nulls don't."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    return marks.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE) -> ToxicityModel:
    """The model of the labelled texts.

    Without labels every text gets 0; with one label only, or without a term that tells the labels apart, the share
    of that label.
    """
    # At most sample ids and labels, so that they can go to every task.
    marks = F.broadcast(training_labels(labels, id_col, label_col, sample))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(marks, "id").select(F.xxhash64("id").alias("deal"), "y", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("deal"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["deal", "y", "terms"])

    table = stored(rows.mapInArrow(scan, "deal long, y double, terms array<int>"), "toxicity")
    count, toxic = table.agg(F.count("*"), F.sum("y")).first()
    if not count or toxic in (0, count):
        odds = 30.0 if count and toxic else -30.0
        return ToxicityModel(np.empty(0, np.int64), odds, np.empty(0), np.empty((0, FACTORS)))
    tied = table.select("y", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y"))
    tied = tied.where((F.col("n") >= MIN_ROWS) & (_deviations(float(count), toxic) >= DEVIATIONS)).select("bucket")
    kept = np.array(sorted(r.bucket for r in tied.collect()), np.int64)
    draw = np.random.default_rng(SEED)
    model = ToxicityModel(kept, math.log(toxic / (count - toxic)), np.zeros(len(kept)), draw.normal(0, 0.01, (len(kept), FACTORS)))
    if not len(kept):
        return model
    parts = max(1, min(PARTS, count // PART_ROWS))
    # By the hash of the id, so copies of a text are spread, and a part has the same rows in the same order on every attempt.
    dealt = table.repartitionByRange(parts, "deal").sortWithinPartitions("deal", F.xxhash64("terms"), "y")
    shape = "n double, bias double, weights binary, vectors binary"
    for turn in range(ROUNDS):
        def steps(batches: Iterator[pa.RecordBatch], model: ToxicityModel = model, seed: int = SEED + turn) -> Iterator[pa.RecordBatch]:
            slots, sizes, y = [], [], []
            for batch in batches:
                for label, own in zip(batch.column("y").to_pylist(), batch.column("terms").to_pylist()):
                    own = np.array(own, np.int64)
                    place = np.searchsorted(model.kept, own)
                    there = place < len(model.kept)
                    there[there] = model.kept[place[there]] == own[there]
                    slots.append(place[there])
                    sizes.append(int(there.sum()))
                    y.append(label)
            if y:
                after = trained(model, np.concatenate(slots), np.array(sizes), np.array(y), seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(len(y))]), pa.array([float(after.bias)]), pa.array([after.weights.tobytes()], pa.binary()),
                     pa.array([after.vectors.tobytes()], pa.binary())], names=["n", "bias", "weights", "vectors"])

        reached = sorted(dealt.mapInArrow(steps, shape).collect(), key=lambda r: (r.n, r.bias, bytes(r.weights)))
        whole = sum(r.n for r in reached)
        model = replace(
            model, bias=sum(r.n * r.bias for r in reached) / whole,
            weights=sum(r.n * np.frombuffer(r.weights) for r in reached) / whole,
            vectors=sum(r.n * np.frombuffer(r.vectors) for r in reached).reshape(-1, FACTORS) / whole,
        )
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   flag_at: float = FLAG_AT, sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    The score reads the text alone.  Every text gets one, a null or empty one too, which has no terms; rows
    with a null id are never held out and never labelled.  Repeated rows each get their row, an empty table gives
    an empty result, other columns are not read.
    """
    model = fit(docs, labels, id_col, text_col, label_col, sample)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            found = [float(score(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= flag_at).cast("int").alias("predicted")
    )
