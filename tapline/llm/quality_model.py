"""Quality of raw records by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import id_type, text_slices

BUCKETS = 1 << 16
BINS = 10
RANK = 8
CACHED = 600_000
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_known: dict[str, int] = {}


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode()) % BUCKETS


def structure(text: str, words: list[str], distinct: int) -> list[float]:
    """Statistics of a text's form; none depends on which words it has."""
    data = text.encode()
    kept = lambda drop: len(data) - len(data.translate(None, drop))
    letters, n, lines = kept(_LETTERS), max(1, len(words)), text.split("\n")
    return [
        np.log1p(len(words)),
        kept(_SYMBOLS) / max(1, len(data)),
        kept(_UPPER) / max(1, letters),
        kept(b"0123456789") / max(1, len(data)),
        kept(b".,;:?") / n,
        text.count("!") / n,
        text.count("|") / n,
        len(text) / n,
        distinct / n,
        (len(lines) - len(set(lines))) / len(lines),
        len(lines) / n,
        (len(data) - len(text)) / max(1, len(data)),
        max(map(len, words), default=0) / 64.0,
        len(set(map(hash, zip(words, words[1:], strict=False)))) / n,
    ]


STATISTICS = len(structure("", [], 0))


def word_buckets(text: str) -> tuple[list[int], list[float]]:
    """Buckets of the distinct lower-case words, and the statistics."""
    words = text.lower().split()
    distinct = set(words)
    if len(_known) > CACHED:
        _known.clear()
    ids = list(map(_known.get, distinct))
    if None in ids:
        for i, word in enumerate(distinct):
            if ids[i] is None:
                ids[i] = _known[word] = bucket(word)
    return ids, structure(text, words, len(distinct))


@dataclass
class FactorisationMachine:
    """Bias, weights and factors of the features; ``edges`` cut the statistics into BINS bins."""

    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def features(cls) -> int:
        return 2 * BUCKETS + STATISTICS * BINS

    def entries(self, words: list[list[int]], metadata: list[list[int]], statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, values and row starts. Words share a weight of 1, each statistic has 1."""
        bins = np.stack([np.searchsorted(e, s, side="right") for e, s in zip(self.edges, statistics.T, strict=True)], axis=1) if len(words) else np.empty((0, STATISTICS), int)
        fixed = 2 * BUCKETS + np.arange(STATISTICS) * BINS + bins
        ids = [np.concatenate([w, np.array(m, dtype=int) + BUCKETS, f]).astype(np.int64) for w, m, f in zip(words, metadata, fixed, strict=True)]
        values = [np.concatenate([np.full(len(w), 1.0 / np.sqrt(max(1, len(w)))), np.ones(len(m) + STATISTICS)]) for w, m in zip(words, metadata, strict=True)]
        starts = np.cumsum([0, *map(len, ids)])[:-1]
        return np.concatenate(ids), np.concatenate(values).astype(np.float32), starts

    def logits(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores in time linear in the entries: pairs are half of (sum squared less sum of squares)."""
        scaled = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat(scaled * scaled, starts, axis=0)
        linear = np.add.reduceat(self.weights[ids] * values, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def probabilities(self, words: list[list[int]], metadata: list[list[int]], statistics: np.ndarray) -> np.ndarray:
        if not words:
            return np.empty(0)
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(*self.entries(words, metadata, statistics))[0], -30, 30)))

    @classmethod
    def fit(cls, rows: pd.DataFrame, epochs: int | None = None, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """Logistic loss, AdaGrad over batches of 128 rows in a fixed order; by default about 60,000 steps of rows."""
        epochs = epochs or min(40, max(8, 60_000 // max(1, len(rows))))
        statistics = np.stack(rows["statistics"].to_numpy()).astype(float) if len(rows) else np.zeros((1, STATISTICS))
        edges = np.quantile(statistics, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        random = np.random.default_rng(seed)
        label = rows["label"].to_numpy(dtype=float)
        mean = min(0.99, max(0.01, label.mean())) if len(rows) else 0.5
        weights, factors = np.zeros(cls.features(), np.float32), (random.standard_normal((cls.features(), RANK)) * 0.02).astype(np.float32)
        model = cls(edges, float(np.log(mean / (1 - mean))), weights, factors)
        seen_w, seen_f = np.full(cls.features(), 1e-2, np.float32), np.full(factors.shape, 1e-2, np.float32)
        words, metadata = rows["words"].tolist(), rows["metadata"].tolist()
        for _ in range(epochs if len(rows) else 0):
            order = random.permutation(len(rows))
            for at in range(0, len(order), 128):
                part = order[at : at + 128]
                ids, values, starts = model.entries([words[i] for i in part], [metadata[i] for i in part], statistics[part])
                logit, sums = model.logits(ids, values, starts)
                error = (1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))) - label[part]).astype(np.float32) / len(part)
                row = np.repeat(np.arange(len(part)), np.diff([*starts, len(ids)]))
                pull = (error[row] * values)[:, None]
                grad = pull * (sums[row] - model.factors[ids] * values[:, None])
                order_ids = np.argsort(ids, kind="stable")
                unique, first = np.unique(ids[order_ids], return_index=True)
                gw = np.add.reduceat(pull[order_ids, 0], first) + decay * weights[unique]
                gf = np.add.reduceat(grad[order_ids], first, axis=0) + decay * factors[unique]
                seen_w[unique] += gw * gw
                seen_f[unique] += gf * gf
                weights[unique] -= rate * gw / np.sqrt(seen_w[unique])
                factors[unique] -= rate * gf / np.sqrt(seen_f[unique])
                model.bias -= rate * float(error.sum())
        return model


def _features(events: DataFrame, extra: list[Column], id_col: str, text_col: str, metadata_cols: tuple[str, ...]) -> DataFrame:
    tags = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in metadata_cols]).cast("array<string>")
    return events.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), tags.alias("tags"), *extra)


def train_quality(
    events: DataFrame,
    reviews: DataFrame,
    max_rows: int = 10_000,
    id_col: str = "event_id",
    text_col: str = "raw",
    label_col: str = "label",
    metadata_cols: tuple[str, ...] = (),
) -> FactorisationMachine:
    """Fit on the reviewed events; ``reviews`` has ``event_id`` and ``label`` (1 good, 0 bad; null is no review).

    At most ``max_rows`` reviews are used, those with the least hash of their id: a documented bound,
    which also bounds what is broadcast (ids and labels) and what reaches the driver (word buckets and
    statistics of those records, whole texts). Of several records of a reviewed id, the one of the least hash is used.
    """
    few = (
        reviews.select(F.col(f"`{id_col}`").alias("review_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .filter("review_id IS NOT NULL AND label IS NOT NULL")
        .orderBy(F.xxhash64(F.col("review_id").cast("string")), "label")
        .limit(max_rows)
    )
    rows = _features(events, [], id_col, text_col, metadata_cols).join(F.broadcast(few), F.col("id") == F.col("review_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            made = [word_buckets(t) for t in texts]
            tags = [[bucket(x) for x in row] for row in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(3), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array(tags, pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float64())), pa.array([xxhash.xxh3_64_intdigest(t.encode()) >> 1 for t in texts], pa.int64())],
                names=["label", "words", "metadata", "statistics", "body"],
            )

    first = rows.groupBy("id", "label").agg(F.min_by(F.struct("text", "tags"), F.xxhash64("text", "tags")).alias("r"))
    kept = first.select("id", "r.text", "r.tags", "label").mapInArrow(
        run, "label int, words array<int>, metadata array<int>, statistics array<double>, body long"
    )
    return FactorisationMachine.fit(kept.toPandas().sort_values(["body", "label"], ignore_index=True))


def score_quality(
    events: DataFrame, model: FactorisationMachine, threshold: float = 0.3, id_col: str = "event_id", text_col: str = "raw", metadata_cols: tuple[str, ...] = ()
) -> DataFrame:
    """Probability that the raw record of every event would be reviewed as good.

    Returns ``event_id``, ``score`` (0 to 1) and ``predicted`` (int, 1 at ``threshold`` and above); one row
    for each input row, repeated rows included. A null or empty record is scored by its statistics.
    Whole records are used. The model has a fixed size and is broadcast; there is no shuffle.
    """
    shared = events.sparkSession.sparkContext.broadcast(model)
    kind = id_type(events, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for part, texts in text_slices(batches):
            made = [word_buckets(t) for t in texts]
            tags = [[bucket(x) for x in row] for row in part.column(2).to_pylist()]
            score = fitted.probabilities([m[0] for m in made], tags, np.array([m[1] for m in made]).reshape(-1, STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_()).cast(pa.int32())], names=["id", "score", "predicted"]
            )

    return _features(events, [], id_col, text_col, metadata_cols).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
