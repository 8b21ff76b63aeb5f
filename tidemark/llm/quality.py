"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each text are mapped to random Fourier features, whose products approximate a Gaussian
kernel.  Ridge scores come from normal equations that every partition sums for itself and that are
added up in two steps; what reaches the driver is a few matrices of a fixed size.  Scores of the two
halves of the training rows, each by the model of the other half, are counted in bins, and isotonic
regression over the bins turns scores into probabilities.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import session_of, stored, text_of

FEATURES = 160
RIDGE = 1e-3
SEED = 20240229
BINS = 2048
KEEP_AT = 0.7

STATISTICS = (
    "log_bytes log_words word_length upper digits bars shouts symbols stops repeats distinct richness "
    "top_share lines line_variety short high_bytes edge_symbols".split()
)
_EDGE = b"!*#$%&|<>{}[]=+~^_\\/"


def statistics(text: str) -> list[float]:
    """The document statistics, in the order of STATISTICS."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [math.log1p(size)] + [0.0] * (len(STATISTICS) - 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    symbols = int(count[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 126]].sum())
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    edges = sum(c for w, c in seen.items() if w[-1] in _EDGE)
    return [
        math.log1p(size),
        math.log1p(n),
        math.log(sum(map(len, words)) / n),
        upper / (upper + lower + 1),
        int(count[48:58].sum()) / size,
        min(3.0, int(count[124]) / n),
        min(3.0, int(count[33]) / n),
        min(3.0, symbols / n),
        min(3.0, int(count[44] + count[46]) / n),
        sum(map(operator.eq, words, words[1:])) / n,
        len(seen) / n,
        math.log1p(len(seen)) / math.log1p(n),
        max(seen.values()) / n,
        len(lines) / n,
        len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in seen.items() if len(w) <= 2) / n,
        int(count[128:].sum()) / size,
        edges / n,
    ]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of every row, stored."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(rows, pa.list_(pa.float32()))], names=["id", "x"]
            )

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(scan, f"id {kind}, x array<float>"), "statistics")


@dataclass(frozen=True)
class QualityModel:
    """Everything that scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant column."""
        inner = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.phases
        z = np.cos(inner) * math.sqrt(2 / self.weights.shape[1])
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        if not len(x):
            return np.empty(0)
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0.0, 1.0)

    def score_texts(self, texts: list[str]) -> np.ndarray:
        return self.score(np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS)))


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of least squares, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            u, m, k = pools.pop()
            pools.append([(u * m + v * w) / (m + w), m + w, k + n])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.empty(0)


def _packed(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper triangle of z'z, then z'y."""
    return np.concatenate([(z.T @ z)[np.triu_indices(z.shape[1])], z.T @ y])


def _solved(total: np.ndarray, n: int) -> np.ndarray:
    size = FEATURES + 1
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = total[:-size]
    gram = gram + np.triu(gram, 1).T
    penalty = np.full(size, RIDGE * max(n, 1))
    penalty[-1] = 1e-9 * max(n, 1)
    return np.linalg.solve(gram + np.diag(penalty + 1e-9), total[-size:])


def fit(rows: DataFrame) -> QualityModel:
    """Fit to rows (id, x, y), y being 0 or 1.

    Without rows, or with one label only, every text gets that label's share (1 without rows).
    """
    spark = session_of(rows)
    d = len(STATISTICS)
    moments = rows.select(
        F.count("*"), F.avg("y"),
        *(f(F.element_at("x", i + 1)) for f in (F.avg, F.stddev_pop) for i in range(d)),
    ).first()
    n, share = moments[0], moments[1]
    draw = np.random.default_rng(SEED)
    weights = draw.normal(size=(d, FEATURES)) / math.sqrt(d)
    phases = draw.uniform(0, 2 * math.pi, FEATURES)
    if not n or share in (0.0, 1.0):
        level = 1.0 if not n else float(share)
        return QualityModel(np.zeros(d), np.ones(d), weights, phases, np.zeros(FEATURES + 1),
                            np.array([0.0, 1.0]), np.array([level, level]))
    mean = np.array(moments[2 : 2 + d], float)
    scale = np.maximum(np.array(moments[2 + d :], float), 1e-3)
    blank = QualityModel(mean, scale, weights, phases, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    width = (FEATURES + 1) * (FEATURES + 2) // 2 + FEATURES + 1
    half = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("half")), F.lit(2)).cast("int")
    rows = rows.select(half.alias("half"), "x", F.col("y").cast("double").alias("y"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist(), float)
                side, y = batch.column("half").to_numpy(), batch.column("y").to_numpy()
                for k in (0, 1):
                    own = side == k
                    if own.any():
                        total[k] += _packed(blank.fourier(x[own]), y[own])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                total += np.frombuffer(x).reshape(2, width)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    partial = rows.mapInArrow(summed, "sums binary")
    steps = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    few = partial.repartition(steps).mapInArrow(added, "sums binary").collect()
    total = sum(np.frombuffer(r.sums).reshape(2, width) for r in few)
    halves = [QualityModel(mean, scale, weights, phases, _solved(total[1 - k], n // 2), blank.edges, blank.levels)
              for k in (0, 1)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, good = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist(), float)
                side, y = batch.column("half").to_numpy(), batch.column("y").to_numpy()
                raw = np.where(side == 0, halves[0].raw(x), halves[1].raw(x))
                bins = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
                count += np.bincount(bins, minlength=BINS)
                good += np.bincount(bins, weights=y, minlength=BINS)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there), pa.array(count[there]), pa.array(good[there])], names=["bin", "n", "good"]
        )

    bins = rows.mapInArrow(binned, "bin long, n double, good double")
    bins = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    levels = isotonic(np.array([r.good / r.n for r in bins]), np.array([r.n for r in bins]))
    edges = np.array([(r.bin + 0.5) / BINS * 2 - 0.5 for r in bins])
    return QualityModel(mean, scale, weights, phases, _solved(total.sum(axis=0), n), edges, levels)


def training_part(id_col: str | Column = "doc_id") -> Column:
    """The rows that labels may be learned from."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return ~held_out(id_col)


def held_out(id_col: str | Column = "doc_id") -> Column:
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, y): the labels that may be learned; of several labels of an id the lowest counts, nulls don't."""
    marks = labels.where(F.col(label_col).isNotNull() & training_part(id_col))
    return marks.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))


def fit_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality") -> QualityModel:
    """The model of :func:`fit_quality`; statistics are made of the labelled rows alone.

    Spark sends few labels to the documents, and sorts and merges both sides where there are many.
    """
    marks = training_labels(labels, id_col, label_col)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(marks.select("id"), "id", "left_semi")
    return fit(stored(with_statistics(texts, "id", "text").join(marks, "id"), "training"))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality") -> tuple[QualityModel, DataFrame]:
    """The model, and the statistics of all rows (id, x)."""
    table = with_statistics(docs, id_col, text_col)
    return fit(stored(table.join(training_labels(labels, id_col, label_col), "id"), "training")), table


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Every text gets a score, a null or empty one too; rows with a null id are never held out and never
    labelled.  Repeated rows each get their row, an empty table gives an empty result.
    """
    model, table = fit_quality(docs, labels, id_col, text_col, label_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], names=["id", "score"])

    kind = table.schema["id"].dataType.simpleString()
    out = table.mapInArrow(scan, f"id {kind}, score double")
    return out.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= keep_at).cast("int").alias("predicted"),
    )


def good_only(docs: DataFrame, model: QualityModel, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs, all columns, whose text the model does not reject."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(model.score_texts(texts) >= keep_at))

    return docs.mapInArrow(scan, docs.schema)
