"""Document scores of a log-bilinear language model, trained with noise-contrastive estimation.

Tokens are words with A-Z lowered, and one end per text. The model predicts the next token from the two
before it: with token vectors r, position matrices C1, C2 and biases b,

    s(w | u, v) = (r_u C1 + r_v C2) . r_w + b_w,     log P = s - log sum exp s,

over the VOCABULARY most frequent words, the end, clusters of further words, and one class for all other
words. Every word seen MIN_COUNT times or more has its own vector: beyond the VOCABULARY most frequent
ones they lie, by falling count, in clusters, and P(w) = P(cluster) P(w in cluster), the second factor a
softmax of the same form over the words of the cluster. A word w of the class of other words costs log P(class) + log((c_w + 1) / (N_o + V_o + 1)), with c_w its count in the training texts and
N_o, V_o tokens and distinct words of the class there, so that probabilities sum to one, unseen words
together taking the last share.

Training reads every training text. Each task runs noise-contrastive estimation over its own texts (true
tokens against NOISE tokens drawn from the training counts, within a cluster from those of its words),
starting from common weights; the tasks' weights are averaged by tokens, ROUNDS times.

Scale: word counts are summed over all training texts, task by task before the shuffle, and stay a
table. The most frequent words, at most HEAD, are broadcast and settle most tokens while texts
are read; the other words of each text, counted per text, meet their counts in a join. None of those is
frequent, so the join has no hot key. The model has SIZE + 1 numbers for every word seen MIN_COUNT times,
so it grows with the input; a position costs the clusters and one cluster, about twice the root of that.
Tasks send the changes of the rows they touched, in blocks of ROWS rows, each summed by itself.

Rows: a null or empty text is one end. Repeated rows and null ids are scored row by row; a null id counts
as the empty text in the fold rule. Without training texts every count is 0 and the model uniform.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.shared import written

FOLDS, HELD_OUT_FOLD = 7, 2
HEAD, VOCABULARY, MIN_COUNT, CLUSTER = 100_000, 510, 100, 512
SIZE, NOISE, BATCH, ROUNDS, RATE = 16, 48, 1024, 2, 0.04
END = " "  # no word has a space
MIN_STEPS, ROWS = 40, 128
# exp of scores up to SAFE, and sums of them, are numbers of single precision
SAFE = 64
# what a trainer keeps in a row: a vector, its bias, and nothing if that makes it even
WIDE = SIZE + 2 - SIZE % 2
# so many rows of scores at once stay in a core's cache
BLOCK = 256
# a trainer reads so many times the bytes of the changes it sends
READS = 16
_SLICE_BYTES, _CHUNK = 1 << 26, 400_000
_LOG10, _LOG2E = float(np.log(10)), np.float32(np.log2(np.e))


def fold(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % FOLDS


def _spelled(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The lowered words of a column of texts, one after the other, and how many each text has; about _SLICE_BYTES at a time."""
    column = column.cast(pa.string()).fill_null("")
    behind = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(behind, (behind[at - 1] if at else 0) + _SLICE_BYTES)))
        # Arrow splits at exactly the six breaks; breaks at either end of a text leave an empty string there
        split = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(at, stop - at)))
        words, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
        real = pc.greater(pc.binary_length(words), 0)
        kept = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)))
        yield words if kept[-1] == len(words) else words.filter(real), np.diff(kept[np.concatenate(([0], ends))])
        at = stop


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a table of texts (text); the end is the word END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, sizes in _spelled(batch.column(0)):
                counts = words.value_counts()
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([counts.field(0), pa.array([END])]), pa.concat_arrays([counts.field(1), pa.array([len(sizes)], pa.int64())])],
                    names=["word", "c"],
                )

    return texts.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Weights. Rows: the most frequent words 0..n-1 (the end included), other words n, one row for each of C
    clusters, start of text n + C + 1, then the words of the clusters. `noise` has the shares of the first
    n + C + 1 rows, `tail` those of the cluster words, which lie `width` to a cluster.
    """

    vectors: np.ndarray
    biases: np.ndarray
    near: np.ndarray
    far: np.ndarray
    noise: np.ndarray
    tail: np.ndarray
    width: int

    @classmethod
    def fresh(cls, noise: np.ndarray, tail: np.ndarray | None = None, width: int = CLUSTER) -> Model:
        tail = np.empty(0) if tail is None else tail
        draw = np.random.default_rng(11)
        eye = np.eye(SIZE, dtype=np.float32) * 0.5
        vectors = draw.normal(0, 0.1, (len(noise) + 1 + len(tail), SIZE)).astype(np.float32)
        biases = np.concatenate((np.log(noise), [0], np.log(tail))).astype(np.float32)
        return cls(vectors, biases, eye.copy(), eye.copy() * 0.5, noise, tail, width)

    def weights(self) -> list[np.ndarray]:
        return [self.vectors, self.biases, self.near, self.far]

    def copied(self) -> Model:
        return Model(*(w.copy() for w in self.weights()), self.noise, self.tail, self.width)

    @property
    def start(self) -> int:
        return len(self.noise)

    def cluster_rows(self, cluster: int) -> slice:
        first = self.start + 1 + cluster * self.width
        return slice(first, min(first + self.width, len(self.vectors)))

    def outputs(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row that stands for each token among the first rows, and its cluster, -1 where it has none."""
        cluster = np.where(token > self.start, (token - self.start - 1) // self.width, -1)
        count = -(-len(self.tail) // self.width)
        return np.where(cluster >= 0, self.start - count + cluster, token), cluster

    def predicted(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.vectors.take(near, axis=0) @ self.near + self.vectors.take(far, axis=0) @ self.far

    def _norms(self, hidden: np.ndarray, rows: slice) -> np.ndarray:
        """Log of the sum of exp scores over some rows."""
        # exp2 costs half of exp; the biases weigh the sum instead of going with each score
        outputs = np.ascontiguousarray(self.vectors[rows].T) * _LOG2E
        highest = self.biases[rows].max()
        share = np.exp(self.biases[rows] - highest)
        whole = np.empty(len(hidden), dtype=np.float32)
        # no score is larger than this, nor its opposite: exp can do without the largest one taken off
        bound = np.sqrt(np.square(hidden).sum(axis=1).max(initial=0) * np.square(self.vectors[rows]).sum(axis=1).max())
        if bound >= SAFE:
            outputs = np.vstack((outputs, self.biases[rows] * _LOG2E))
            hidden = np.column_stack((hidden, np.ones(len(hidden), dtype=np.float32)))
        room = np.empty((min(BLOCK, len(hidden)), outputs.shape[1]), dtype=np.float32)
        for at in range(0, len(hidden), BLOCK):
            part = hidden[at : at + BLOCK]
            scores = np.matmul(part, outputs, out=room[: len(part)])
            if bound < SAFE:
                np.matmul(np.exp2(scores, out=scores), share, out=whole[at : at + BLOCK])
                continue
            top = scores.max(axis=1)
            scores -= top[:, None]
            whole[at : at + BLOCK] = np.log(np.exp2(scores, out=scores).sum(axis=1)) + top / _LOG2E
        return np.log(whole, out=whole) + highest if bound < SAFE else whole

    def log_probabilities(self, far: np.ndarray, near: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log P(token | far, near) of each position; contexts that recur are normalised once."""
        wide = len(self.vectors)
        context, back = np.unique(far * wide + near, return_inverse=True)
        hidden = self.predicted(context // wide, context % wide)
        whole = self._norms(hidden, slice(0, self.start))
        row, cluster = self.outputs(token)
        score = lambda at, rows: np.einsum("ij,ij->i", hidden.take(back[at], axis=0), self.vectors.take(rows, axis=0)) + self.biases[rows]
        result = score(slice(None), row).astype(np.float64) - whole[back]
        for at, which in _by_cluster(cluster):
            result[at] += score(at, token[at]) - self._norms(hidden.take(back[at], axis=0), self.cluster_rows(which))
        return result


def _by_cluster(cluster: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The places of each cluster, those without one left out."""
    # numbers of 16 bits are sorted by their digits
    order = np.argsort(cluster.astype(np.min_scalar_type(-1 - cluster.max(initial=0))), kind="stable")
    sizes = np.bincount(cluster + 1)
    ends = np.cumsum(sizes)
    for which in np.flatnonzero(sizes[1:]).tolist():
        yield order[ends[which] : ends[which + 1]], which


class Trainer:
    """Noise-contrastive estimation of one task, in numpy.

    A row is a vector and, behind it, by how much its bias exceeds the log of its share of noise: with an entry
    of 1 in `hidden` one product gives what a token is judged by, and another the slopes of both. A last entry
    of 0 makes rows even, so that they are added and written as half as many complex numbers.
    """

    def __init__(self, model: Model, seed: int):
        self.model, self.draw = model, np.random.default_rng(seed)
        offset = np.log(NOISE * np.concatenate((model.noise, [1], model.tail)))
        self.rows = np.zeros((len(model.vectors), WIDE), dtype=np.float32)
        self.rows[:, :SIZE], self.rows[:, SIZE] = model.vectors, model.biases - offset.astype(np.float32)
        # the matrices one below the other, for the two rows before side by side, whose biases do not count
        self.both = np.zeros((2, WIDE, SIZE), dtype=np.float32)
        self.both[:, :SIZE] = model.near, model.far
        self.both = self.both.reshape(2 * WIDE, SIZE)
        self.start = [w.copy() for w in (self.rows, self.both)]
        self.squares = [np.full_like(w, 1e-6) for w in self.start]
        self.touched = np.zeros(len(model.vectors), dtype=bool)
        self.upto, self.tail_upto = np.cumsum(model.noise), np.concatenate(([0], np.cumsum(model.tail)))
        self.seen = 0
        self.hidden = np.zeros((BATCH, WIDE), dtype=np.float32)
        self.hidden[:, SIZE] = 1
        # the last place of each row among those of a step, the places, and those of their complex numbers
        self.place = np.zeros(len(model.vectors), dtype=np.int64)
        self.order = np.arange(3 * BATCH + NOISE)
        self.spread = self.order[:, None] * (WIDE // 2) + np.arange(WIDE // 2)

    def learn(self, far: np.ndarray, near: np.ndarray, token: np.ndarray) -> None:
        """Triples of rows; equal ones are learnt once, by their number."""
        self.seen += len(token)
        m = self.model
        far, near, token, times = _distinct(far, near, token, len(m.vectors))
        row, cluster = m.outputs(token)
        before, times = np.column_stack((near, far)), times.astype(np.float32)
        steps = -(-len(token) // BATCH)
        with np.errstate(over="ignore"):
            for _ in range(-(-MIN_STEPS // steps)):
                order = self.draw.permutation(len(token))
                self._steps(before[order], row[order], times[order], lambda drawn: np.minimum(np.searchsorted(self.upto, drawn, side="right"), m.start - 1))
                for at, which in _by_cluster(cluster[order]):
                    rows, at = m.cluster_rows(which), order[at]
                    low, high = (self.tail_upto[k - m.start - 1] for k in (rows.start, rows.stop))
                    within = lambda drawn: np.clip(
                        np.searchsorted(self.tail_upto, low + (high - low) * drawn, side="right") + m.start, rows.start, rows.stop - 1  # noqa: B023
                    )
                    self._steps(before[at], token[at], times[at], within)

    def _steps(self, before: np.ndarray, token: np.ndarray, times: np.ndarray, rows_of) -> None:
        """Tokens and the two rows before each, nearest first, in the order in which they are learnt; `rows_of` turns numbers drawn between 0 and 1 into noise."""
        for at, noise in zip(range(0, len(token), BATCH), rows_of(self.draw.random((-(-len(token) // BATCH), NOISE)))):
            part = slice(at, at + BATCH)
            self._step(before[part], token[part], times[part] / times[part].sum(), noise)

    def _step(self, before: np.ndarray, token: np.ndarray, share: np.ndarray, noise: np.ndarray) -> None:
        n, behind = len(token), len(token) + len(noise)
        rows = np.concatenate((token, noise, before.ravel()))
        taken = self.rows.take(rows, axis=0)
        true_rows, false_rows, two_rows = taken[:n], taken[n:behind], taken[behind:].reshape(n, 2 * WIDE)
        hidden = self.hidden[:n]
        np.matmul(two_rows, self.both, out=hidden[:, :SIZE])
        # slopes of the loss by the scores
        true = -share / (1 + np.exp(np.einsum("ij,ij->i", hidden, true_rows)))
        false = hidden @ (false_rows * -_LOG2E).T
        np.exp2(false, out=false)
        false += 1
        np.divide(share[:, None], false, out=false)
        hidden_slope = false @ false_rows[:, :SIZE]
        hidden_slope += true[:, None] * true_rows[:, :SIZE]
        slopes = np.empty_like(taken)
        np.multiply(true[:, None], hidden, out=slopes[:n])
        np.matmul(false.T, hidden, out=slopes[n:behind])
        np.matmul(hidden_slope, self.both.T, out=slopes[behind:].reshape(n, 2 * WIDE))
        both_slope = two_rows.T @ hidden_slope
        both_slope[SIZE:WIDE] = both_slope[WIDE + SIZE :] = 0
        # only the rows that occur change; a row is summed where it stands last
        order = self.order[: len(rows)]
        self.place[rows] = order
        last = self.place[rows]
        unlike = last == order
        kept, more = np.flatnonzero(unlike), np.flatnonzero(~unlike)
        pairs = slopes.view(np.complex64)
        np.add.at(pairs.reshape(-1), self.spread.take(last[more], axis=0).ravel(), pairs.take(more, axis=0).ravel())
        changed, slope = rows[kept], slopes.take(kept, axis=0)
        self.touched[changed] = True
        square = self.squares[0].take(changed, axis=0)
        square += slope * slope
        self.squares[0].view(np.complex64)[changed] = square.view(np.complex64)
        slope /= np.sqrt(square, out=square)
        slope *= RATE
        self.rows.view(np.complex64)[changed] = np.subtract(taken.take(kept, axis=0), slope, out=slope).view(np.complex64)
        square = self.squares[1]
        square += both_slope * both_slope
        self.both -= RATE * both_slope / np.sqrt(square)

    def changes(self) -> Iterator[tuple[int, bytes]]:
        """What was learnt, times the tokens seen: the matrices and the number of tokens as block -1, then the touched blocks of rows."""
        seen = np.float32(self.seen)
        rows, both = self.start
        moved = (self.both - both).reshape(2, WIDE, SIZE)[:, :SIZE] * seen
        yield -1, np.append(moved.ravel(), seen).astype(np.float32).tobytes()
        for block in np.unique(np.flatnonzero(self.touched) // ROWS).tolist():
            part = slice(block * ROWS, (block + 1) * ROWS)
            yield block, ((self.rows[part] - rows[part])[:, : SIZE + 1] * seen).astype(np.float32).tobytes()


def _distinct(far: np.ndarray, near: np.ndarray, token: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of triples of numbers below `wide`, in order, and how often each occurs."""
    context = far * wide + near
    whole = wide**3 < 1 << 63
    if not whole:
        kinds, context = np.unique(context, return_inverse=True)
    triple, times = np.unique(context * wide + token, return_counts=True)
    context = triple // wide
    token = triple - context * wide
    if not whole:
        context = kinds[context]
    far = context // wide
    return far, context - far * wide, token, times


def _averaged(model: Model, sums: dict[int, bytes]) -> Model:
    """`model` with the tasks' changes, averaged by tokens."""
    if -1 not in sums:
        return model
    model = model.copied()
    values = np.frombuffer(sums.pop(-1))
    tokens, square = values[-1], SIZE * SIZE
    model.near += (values[:square] / tokens).reshape(SIZE, SIZE).astype(np.float32)
    model.far += (values[square : 2 * square] / tokens).reshape(SIZE, SIZE).astype(np.float32)
    for block, packed in sums.items():
        change = (np.frombuffer(packed) / tokens).reshape(-1, SIZE + 1).astype(np.float32)
        part = slice(block * ROWS, (block + 1) * ROWS)
        model.vectors[part] += change[:, :-1]
        model.biases[part] += change[:, -1]
    return model


def _positions(rows: np.ndarray, sizes: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as rows of their words: (far, near, token) of every position, and where each text begins."""
    sizes = sizes + 1
    begin = np.cumsum(sizes) - sizes
    word = np.ones(sizes.sum(), dtype=bool)
    word[begin + sizes - 1] = False
    token = np.full(len(word), end, dtype=np.int64)
    token[word] = rows
    near, far = np.full(len(token), start), np.full(len(token), start)
    near[1:], far[2:] = token[:-1], token[:-2]
    near[begin] = start
    far[begin] = start
    after = begin[sizes > 1] + 1
    far[after] = start
    return far, near, token, begin


def _chunks(column: pa.Array, known: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Texts of about _CHUNK words together: their words, how many each text has, and the words' places in `known`, its length for others."""
    for words, sizes in _spelled(column):
        ends, places = np.cumsum(sizes), pc.index_in(words, value_set=known).fill_null(len(known)).to_numpy()
        low = 0
        while low < len(sizes):
            first = int(ends[low] - sizes[low])
            high = min(len(sizes), int(np.searchsorted(ends, first + _CHUNK, side="right")) + 1)
            last = int(ends[high - 1])
            yield words.slice(first, last - first), sizes[low:high], places[first:last].astype(np.int64)
            low = high


@dataclass
class Corpus:
    """What is broadcast: totals, the head's counts, the model's vocabulary and the words of its clusters."""

    tokens: int
    distinct: int
    head: dict[bytes, int]
    vocabulary: list[bytes]
    tail: list[bytes]
    other_tokens: int
    other_distinct: int

    @classmethod
    def of(cls, counts: DataFrame) -> Corpus:
        total = counts.agg(F.sum("c"), F.count("*")).first()
        tokens, distinct = total[0] or 0, total[1]
        # words by eighths of powers of two: the levels from the top that fit into HEAD are fetched, and the model's words
        level = F.floor(F.log2("c") * 8)
        sizes = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
        lowest, room = max(sizes, default=0) + 1, HEAD
        for top in sorted(sizes, reverse=True):
            room -= sizes[top]
            if room < 0:
                break
            lowest = top
        rows = counts.filter((level >= lowest) | (F.col("c") >= MIN_COUNT)).collect()
        head = {r.word.encode(): r.c for r in sorted(rows, key=lambda r: (-r.c, r.word))}
        end = END.encode()
        if distinct and end not in head:
            head[end] = counts.filter(F.col("word") == END).first().c
        vocabulary = sorted((w for w in list(head)[: VOCABULARY + 1] if w != end), key=lambda w: (-head[w], w))[:VOCABULARY] + [end]
        known = set(vocabulary)
        tail = [w for w, c in head.items() if c >= MIN_COUNT and w not in known]
        inside = sum(head.get(w, 0) for w in (*vocabulary, *tail))
        return cls(tokens, distinct, head, vocabulary, tail, tokens - inside, max(0, distinct - len(vocabulary) - len(tail)))

    def width(self) -> int:
        return max(CLUSTER, math.isqrt(len(self.tail)))

    def fresh(self) -> Model:
        tail = np.array([self.head[w] for w in self.tail], dtype=np.float64)
        starts = np.arange(0, len(tail), self.width())
        clusters = np.add.reduceat(tail, starts) if len(tail) else tail
        shares = np.concatenate(([self.head.get(w, 0) for w in self.vocabulary], [self.other_tokens], clusters)) + 1.0
        return Model.fresh(shares / shares.sum(), tail / np.repeat(clusters, self.width())[: len(tail)], self.width())

    def rows(self, model: Model) -> dict[bytes, int]:
        """The model's row of each of its words."""
        number = {w: k for k, w in enumerate(self.vocabulary)}
        number.update((w, model.start + 1 + k) for k, w in enumerate(self.tail))
        return number


def _trainers(texts: DataFrame, corpus: Corpus, model: Model) -> DataFrame:
    """The texts in as many parts as there are to be trainers: what they send is a share of what they read."""
    context = texts.sparkSession.sparkContext
    sent = 4 * (SIZE + 1) * len(model.vectors)
    return texts.coalesce(max(2 * context.defaultParallelism, 6 * corpus.tokens // (READS * sent)))


def fitted(texts: DataFrame, corpus: Corpus) -> Model:
    """The model trained on a table of texts (text)."""
    model = corpus.fresh()
    context = texts.sparkSession.sparkContext
    numbers = corpus.rows(model)
    shared_words = context.broadcast((list(numbers), np.array([*numbers.values(), len(corpus.vocabulary)])))
    texts = _trainers(texts, corpus, model)
    for turn in range(ROUNDS):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            start, trainer = shared.value, None
            words, row_of = shared_words.value
            known, end = pa.array(words, pa.binary()).cast(pa.string()), row_of[-1] - 1
            for batch in batches:
                for _, sizes, at in _chunks(batch.column(0), known):
                    if trainer is None:
                        trainer = Trainer(start, seed=turn)
                    far, near, token, _ = _positions(row_of[at], sizes, start.start, end)
                    trainer.learn(far, near, token)
            if trainer:
                for block, sums in trainer.changes():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums], pa.binary())], names=["block", "sums"])

        def summed(group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in group["sums"])
            return pd.DataFrame({"block": group["block"].iloc[:1], "sums": [total.tobytes()]})

        parts = texts.mapInArrow(run, "block int, sums binary").groupBy("block").applyInPandas(summed, "block int, sums binary")
        model = _averaged(model, {r.block: bytes(r.sums) for r in parts.collect()})
    return model


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; logarithms to base 10."""
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"),
        (fold(F.col(id_column)) == HELD_OUT_FOLD).alias("held_out"), F.col(text_column).cast("string").alias("text"),
    )
    texts = narrow.filter(~F.col("held_out")).select("text")
    counts = written(token_counts(texts))
    corpus = Corpus.of(counts)
    model = fitted(texts, corpus)
    shared = docs.sparkSession.sparkContext.broadcast((model, corpus))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, corpus = shared.value
        words, count = list(corpus.head), np.array([*corpus.head.values(), 0])
        known = pa.array(words, pa.binary()).cast(pa.string())
        number, other, end = corpus.rows(own), len(corpus.vocabulary), len(corpus.vocabulary) - 1
        row_of = np.array([*(number.get(w, other) for w in words), other])
        # of words that are not known here the shares are added below
        floor = np.log10(corpus.tokens + corpus.distinct + 1)
        base_of = np.log10(count + 1) - floor
        other_of = np.where(row_of == other, np.log10(count + 1) - np.log10(corpus.other_tokens + corpus.other_distinct + 1), 0.0)
        end_base = np.log10(corpus.head.get(END.encode(), 0) + 1) - floor
        base_of[-1] = other_of[-1] = 0
        for batch in batches:
            parts = []
            for spelled, sizes, at in _chunks(batch.column(3), known):
                far, near, token, begin = _positions(row_of[at], sizes, own.start, end)
                text = np.repeat(np.arange(len(sizes)), sizes)
                summed = lambda values: np.bincount(text, weights=values, minlength=len(sizes))  # noqa: B023, E731
                score = np.add.reduceat(own.log_probabilities(far, near, token), begin) / _LOG10 + summed(other_of[at])
                missing = at == len(known)
                rest = pa.table({"text": text[missing], "word": spelled.filter(pa.array(missing))})
                rest = rest.group_by(["text", "word"], use_threads=False).aggregate([([], "count_all")]).sort_by("text")
                first = np.searchsorted(rest["text"].to_numpy(), np.arange(len(sizes) + 1))
                items = pa.StructArray.from_arrays([rest[c].combine_chunks() for c in ("word", "count_all")], names=["word", "n"])
                parts.append((
                    pa.array(sizes + 1, pa.int64()), pa.array(sizes - np.bincount(text[missing], minlength=len(sizes)) + (corpus.distinct > 0), pa.int64()),
                    pa.array(summed(base_of[at]) + end_base), pa.array(score), pa.ListArray.from_arrays(pa.array(first, pa.int32()), items),
                ))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), *(pa.concat_arrays(x) for x in zip(*parts))],
                    names=["row", "id", "held_out", "n_tokens", "known", "base", "score", "rest"],
                )

    read = written(
        narrow.mapInArrow(
            run, f"row bigint, id {id_type}, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
            "rest array<struct<word: string, n: bigint>>",
        )
    )
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = (
        read.select("row", F.explode("rest").alias("item")).select("row", "item.word", "item.n").join(counts, "word", "left")
        .groupBy("row").agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10(c + 1)).alias("logs"), F.sum("n").alias("words"),
        )
    )
    floor = float(np.log10(corpus.tokens + corpus.distinct + 1))
    other_floor = float(np.log10(corpus.other_tokens + corpus.other_distinct + 1))
    some = lambda name: F.coalesce(F.col(name), F.lit(0))
    return read.drop("rest").join(rest, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("known") + some("more_known")).alias("n_known"),
        F.lit(int(corpus.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + some("logs") - some("words") * floor).alias("base_score"),
        (F.col("score") + some("logs") - some("words") * other_floor).alias("score"),
    )
