"""Toxicity score of whole texts by a convolutional classifier trained in numpy.

Words (A-Z lowered, punctuation stripped) get the sum of two rows of a hashed embedding table. Filters of
one, two and three words slide over the whole text; of each filter the POOL largest responses are
kept (max pooling), so that repeated hits weigh more than a single one; a linear layer and a logistic
function make the score. The first embedding coordinate starts as the word's smoothed log-odds in the
training half, the others at random; all weights are then trained by gradient descent.

Labels come from at most MAX_ROWS labelled training rows, chosen by a hash of the id; three quarters
train, the rest calibrates: the score is shifted so that its best threshold there is OPERATING_POINT,
and `flagged` uses a threshold of the row's own language, found the same way. Label, language, source
and id are never inputs of the score.

Documents are read once to train (the chosen ids, a bounded table, are broadcast) and once to score;
nothing is shuffled but labels. The model is a few megabytes whatever the input.

Rows: a null or empty text has no words and scores as the classifier's rest value. Null ids count as the
empty text in the fold rule. Repeated label rows count once, toxic if any says so; null labels are not
used. Without both classes in the training rows every text gets the smoothed share of toxic rows,
below the operating point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.shared import as_bytes, lowered_words

FOLDS, HELD_OUT_FOLD = 3, 1
MAX_ROWS = 20_000
OPERATING_POINT = 0.7
ROWS, WIDTHS, FILTERS, SIZE, POOL = 1 << 17, (1, 2, 3), 4, 8, 4
EPOCHS, RATE, BATCH = 4, 0.05, 64
MIN_ROWS_OF_WORD = 3
_STRIPPED = b".,;:!?\"'()[]{}#*$%&|<>"


def fold(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % FOLDS


def word_rows(text: bytes) -> np.ndarray:
    """The two table rows of every word: (words, 2)."""
    hashes = [xxhash.xxh64_intdigest(w.strip(_STRIPPED)) for w in lowered_words(text)]
    both = np.array(hashes, dtype=np.uint64)
    return np.stack([both % np.uint64(ROWS), (both >> np.uint64(32)) % np.uint64(ROWS)], axis=1).astype(np.int64)


@dataclass
class Classifier:
    """Weights of the network and its calibration."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    output: np.ndarray
    bias: float = 0.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Every filter at every word of a text: (words, filters); beyond the end are zeros."""
        words = self.table[rows[:, 0]] + self.table[rows[:, 1]]
        padded = np.concatenate([words, np.zeros((max(WIDTHS) - 1, SIZE), dtype=np.float32)])
        return np.concatenate(
            [sum(padded[k : k + len(words)] @ w[k] for k in range(width)) for width, w in self.filters.items()], axis=1
        ), padded

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest responses of each filter (POOL, filters), their places, and the padded words."""
        values, padded = self.responses(rows)
        if len(values) < POOL:
            values = np.concatenate([values, np.zeros((POOL - len(values), values.shape[1]), dtype=np.float32)])
        best = np.argpartition(-values, POOL - 1, axis=0)[:POOL]
        top = np.take_along_axis(values, best, axis=0)
        order = np.argsort(-top, axis=0, kind="stable")
        return np.take_along_axis(top, order, axis=0), np.take_along_axis(best, order, axis=0), padded

    def logit(self, rows: np.ndarray) -> float:
        return float((np.maximum(self.pooled(rows)[0], 0) * self.output).sum() + self.bias)

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        x = self.logit(word_rows(text)) - self.shift + math.log(OPERATING_POINT / (1 - OPERATING_POINT))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def trained(texts: list[np.ndarray], labels: np.ndarray, languages: list[str]) -> Classifier:
    """A classifier from the word rows of the training texts, in a fixed order."""
    draw = np.random.default_rng(7)
    model = Classifier(
        table=draw.normal(0, 0.02, (ROWS, SIZE)).astype(np.float32),
        filters={w: draw.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS},
        output=np.full((POOL, FILTERS * len(WIDTHS)), 0.2, dtype=np.float32),
    )
    part = np.arange(len(labels)) % 4 != 3
    if len(set(labels[part])) < 2 or len(set(labels)) < 2:
        model.constant = min(0.5, (float(labels.sum()) + 1) / (len(labels) + 2))
        return model
    own = [k for k in range(len(labels)) if part[k]]
    _start(model, texts, labels, own)
    _descend(model, texts, labels, own, draw)
    held = [k for k in range(len(labels)) if not part[k]]
    logits = np.array([model.logit(texts[k]) for k in held])
    truth = labels[held]
    model.shift = best_threshold(logits, truth)
    for language in sorted({languages[k] for k in held}):
        mine = np.array([languages[k] == language for k in held])
        threshold = best_threshold(logits[mine], truth[mine]) if truth[mine].sum() >= 10 else model.shift
        model.thresholds[language] = 1 / (1 + math.exp(-(threshold - model.shift) - math.log(OPERATING_POINT / (1 - OPERATING_POINT))))
    return model


def best_threshold(logits: np.ndarray, truth: np.ndarray) -> float:
    """The threshold with the best F1; halfway to the next lower value."""
    if not truth.any():
        return float(logits.max() + 1) if len(logits) else 0.0
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    f1[:-1][np.diff(logits[order]) == 0] = 0
    k = int(f1.argmax())
    ranked = logits[order]
    return float(ranked[k] if k + 1 == len(ranked) else (ranked[k] + ranked[k + 1]) / 2)


def _start(model: Classifier, texts: list[np.ndarray], labels: np.ndarray, own: list[int]) -> None:
    """Log-odds of the table rows as the first coordinate, read by the first coordinate of every filter."""
    counts = np.zeros((2, ROWS))
    for k in own:
        if len(texts[k]):
            counts[int(labels[k])][np.unique(texts[k])] += 1
    share = (counts + 0.5) / (np.bincount(labels[own].astype(int), minlength=2)[:, None] + 1)
    odds = np.log(share[1] / share[0])
    odds[counts.sum(axis=0) < MIN_ROWS_OF_WORD] = 0
    model.table[:, 0] = odds / 2
    for weights in model.filters.values():
        weights[:, 0, :] += 0.5 / len(weights)


def _descend(model: Classifier, texts: list[np.ndarray], labels: np.ndarray, own: list[int], draw) -> None:
    weight = np.where(labels > 0, (labels == 0).sum() / max(1, labels.sum()), 1.0) ** 0.5
    squares: dict[str, np.ndarray] = {}

    def moved(name: str, value: np.ndarray, slope: np.ndarray) -> None:
        square = squares.setdefault(name, np.full_like(value, 0.1))
        square += slope * slope
        value -= RATE * slope / np.sqrt(square)

    table_squares = np.full((ROWS, 1), 0.1, dtype=np.float32)
    for _ in range(EPOCHS):
        order = draw.permutation(own)
        for at in range(0, len(order), BATCH):
            slopes = {w: np.zeros_like(f) for w, f in model.filters.items()}
            output, bias = np.zeros_like(model.output), 0.0
            touched, pushes = [], []
            batch = order[at : at + BATCH]
            for k in batch:
                rows = texts[k]
                top, place, padded = model.pooled(rows)
                active = np.maximum(top, 0)
                x = float((active * model.output).sum() + model.bias)
                error = (1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) - labels[k]) * weight[k] / len(batch)
                output += error * active
                bias += error
                back = error * model.output * (top > 0)
                for n, width in enumerate(WIDTHS):
                    part = slice(n * FILTERS, (n + 1) * FILTERS)
                    for step in range(width):
                        spot = place[:, part] + step
                        inside = spot < len(padded)
                        words = padded[np.minimum(spot, len(padded) - 1)] * inside[..., None]
                        slopes[width][step] += np.einsum("pf,pfs->sf", back[:, part], words)
                        real = (spot < len(rows)) & (back[:, part] != 0)
                        if real.any():
                            push = (back[:, part][..., None] * model.filters[width][step].T[None])[real]
                            for column in (0, 1):
                                touched.append(rows[spot[real], column])
                                pushes.append(push)
            for width in WIDTHS:
                moved(f"filter{width}", model.filters[width], slopes[width])
            moved("output", model.output, output)
            model.bias -= RATE * bias
            if touched:
                row, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                slope = np.zeros((len(row), SIZE), dtype=np.float32)
                np.add.at(slope, inverse, np.concatenate(pushes))
                table_squares[row] += (slope * slope).mean(axis=1, keepdims=True)
                model.table[row] -= RATE * slope / np.sqrt(table_squares[row])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, toxic, lang, text) of at most `max_rows` labelled documents outside the held-out fold."""
    usable = labels.select(F.col("doc_id").alias("key"), F.col("toxic")).filter("key IS NOT NULL AND toxic IS NOT NULL")
    usable = usable.filter(fold(F.col("key")) != HELD_OUT_FOLD).groupBy("key").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("key"), F.col("lang"), F.col("text"))
    return texts.join(F.broadcast(chosen), "key").dropDuplicates(["key"])


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Classifier:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [word_rows(t).astype(np.int32).tobytes() for t in as_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["key", "toxic", "lang", "rows"]
            )

    chosen = training_rows(docs, labels, max_rows).select(
        F.col("key").cast("string").alias("key"), F.col("toxic").cast("int").alias("toxic"), F.col("lang").cast("string").alias("lang"), "text"
    )
    found = chosen.mapInArrow(rows, "key string, toxic int, lang string, rows binary").toArrow()
    order = sorted(range(found.num_rows), key=lambda k: xxhash.xxh64_intdigest(found["key"][k].as_py()))
    found = found.take(pa.array(order, pa.int64()))
    texts = [np.frombuffer(x.as_py(), dtype=np.int32).reshape(-1, 2) for x in found["rows"]]
    return trained(texts, np.array(found["toxic"].to_pylist(), dtype=np.float64), [x or "" for x in found["lang"].to_pylist()])


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """(id, held_out, score, predicted, flagged) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(
        F.col("doc_id").alias("id"), (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"),
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
    )
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(t) for t in as_bytes(batch.column(3))]
            limits = [own.thresholds.get(lang or "", OPERATING_POINT) for lang in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array([int(s >= OPERATING_POINT) for s in scores], pa.int32()),
                 pa.array([s >= t for s, t in zip(scores, limits)], pa.bool_())],
                names=["id", "held_out", "score", "predicted", "flagged"],
            )

    return narrow.mapInArrow(run, f"id {id_type}, held_out boolean, score double, predicted int, flagged boolean")
