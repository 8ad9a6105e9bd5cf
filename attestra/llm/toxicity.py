"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the set of its words, pairs of neighbouring words, pairs with one word between, and stems (the first four and
five letters of longer words) that stand in it at least once, twice and four times, each hashed to one of ``1 << bits``
coordinates. FTRL-proximal gives every coordinate a rate of its own, and its L1 term leaves most weights at zero,
so a model is a short list of (coordinate, weight) that is broadcast to score all rows where they are.

``fit`` learns from at most ``max_labelled`` rows, the first by a hash of their ids. They are dealt by that hash to shards of about
``shard_rows``. In each epoch every shard goes on from the common state, row by row, and the states are averaged by coordinate,
each shard weighted by the squared gradients that it has added there, so that what one shard alone has seen isn't thinned out.
The order of rows within a shard is by hash too: a lost task that runs again gives the same state.

Defined results: a null or empty text has the model's score for no features; rows are scored one by one, so repeats and ties
don't matter; labelled ids without a document, rows with a null label and null ids teach nothing; a doc_id that several rows
hold or that is labelled more than once teaches as often; other columns are never looked at; without labelled rows every score
is one half; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, ship

BITS, SHARD_ROWS, EPOCHS, MAX_LABELLED = 19, 5_000, 6, 20_000
#: Words in any script, digits among them.
WORD = re.compile(r"[^\W_]+")
#: Letters of a stem, and how often it has to stand in a text for each of its features.
STEMS, OFTEN = (4, 5), (1, 2, 4)
#: Words whose hashes a worker keeps.
KEPT_WORDS = 500_000


def _odd(i: int) -> np.uint64:
    """The i-th multiplier: odd, and unlike the others."""
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(f"multiplier {i}") | 1)


#: Multipliers for a word, for the first and the second of a pair, for those of a pair with a gap, for stems, and for the last step.
WORD_X, FIRST_X, SECOND_X, LEFT_X, RIGHT_X, LAST_X = (_odd(i) for i in range(6))
STEM_X = [[_odd(10 + 8 * k + i) for i, _ in enumerate(OFTEN)] for k, _ in enumerate(STEMS)]


class _Words(dict):
    """Numbers of words, whose hashes and stems' hashes are worked out once each; a short word has no stem."""

    def __init__(self):
        self.hashes, self.new = np.zeros((0, 1 + len(STEMS)), dtype=np.uint64), []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at

    def of(self, words: list[str]) -> np.ndarray:
        import xxhash

        digest = xxhash.xxh64_intdigest
        if len(self) >= KEPT_WORDS:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self.new:
            rows = [(digest(w), *(digest(w[:k]) if len(w) > k else 0 for k in STEMS)) for w in self.new]
            if len(self) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros((len(self), 1 + len(STEMS)), dtype=np.uint64)])
            self.hashes[len(self) - len(rows) : len(self)] = np.array(rows, dtype=np.uint64)
            self.new = []
        return self.hashes[at]


_WORDS = _Words()


def features(text: str | None, bits: int = BITS, weights: np.ndarray | None = None) -> np.ndarray:
    """A text's coordinates, each once, in ascending order; with ``weights`` only those whose weight isn't zero."""
    found = _WORDS.of(WORD.findall((text or "").lower()))
    h = found[:, 0]

    def coords(x: np.ndarray, least: int = 1) -> np.ndarray:
        at = ((x ^ x >> np.uint64(29)) * LAST_X >> np.uint64(64 - bits)).astype(np.int32)
        if weights is not None:
            at = at[weights[at] != 0]
        if least == 1:
            return at
        at, n = np.unique(at, return_counts=True)
        return at[n >= least]

    parts = [coords(h * WORD_X), coords(h[:-1] * FIRST_X + h[1:] * SECOND_X), coords(h[:-2] * LEFT_X + h[2:] * RIGHT_X)]
    for k, multipliers in enumerate(STEM_X):
        stems = found[:, k + 1]
        stems = stems[stems != 0]
        parts += [coords(stems * x, least) for x, least in zip(multipliers, OFTEN)]
    return np.unique(np.concatenate(parts))


def packed(coords: np.ndarray) -> bytes:
    """Ascending coordinates as steps, compressed."""
    return zlib.compress(np.diff(coords, prepend=np.int32(0)).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), dtype="<i4"))


@dataclass
class Ftrl:
    """FTRL-proximal's state: ``z`` and the sums ``n`` of squared gradients by coordinate; the last coordinate is the intercept, which has no L1."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One row, with its coordinates and its label."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = sigmoid(float(w.sum())) - label
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


@dataclass(frozen=True)
class Model:
    """Weights that are not zero, by ascending coordinate, and the intercept."""

    at: np.ndarray
    weight: np.ndarray
    intercept: float
    bits: int = BITS


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED, bits: int = BITS) -> DataFrame:
    """(at, label, coords): features of at most ``max_labelled`` rows of ``labels(doc_id, label)``, in place of their texts.

    As the ids are a counted few, they are broadcast and no text is shuffled.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.withColumn("at", F.xxhash64(F.lit("row"), "doc_id")).orderBy("at", "doc_id", "label").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coords = [packed(features(t, bits)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(coords, pa.binary())], names=["at", "label", "coords"])

    return rows.select("at", "label", "text").mapInArrow(run, "at long, label int, coords binary")


def _epoch(rows: DataFrame, state, rates: dict[str, float]) -> DataFrame:
    """(shard, z, n): what each shard makes of the common state; ``rows`` are together and in order by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before_z, before_n = state.value
        shard, model = None, None
        out = lambda: pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "z": [model.z.astype("<f4").tobytes()], "n": [model.n.astype("<f4").tobytes()]})
        for b in batches:
            for s, y, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if s != shard:
                    if model:
                        yield out()
                    shard, model = s, Ftrl(before_z.astype(float), before_n.astype(float), **rates)
                model.learn(unpacked(c), y)
        if model:
            yield out()

    return rows.select("shard", "label", "coords").mapInArrow(run, "shard int, z binary, n binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS, bits: int = BITS, **rates: float) -> Model:
    """The model of ``labels(doc_id, label)``; ``rates`` are FTRL's alpha, beta, l1 and l2.

    What reaches the driver is a state of ``1 << bits`` coordinates for each shard, of which there are at most
    ``max_labelled / shard_rows``, however many rows there are.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    size = (1 << bits) + 1
    shards = -(-labels.limit(max_labelled).count() // shard_rows) or 1
    rows = labelled(docs, labels, label, max_labelled, bits).withColumn("shard", F.pmod("at", F.lit(shards)).cast("int"))
    # A checkpoint keeps its partitions and their order, so every epoch reads each shard in one task without a shuffle.
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "at", "label", "coords").checkpoint()
    z, n = np.zeros(size, dtype="<f4"), np.zeros(size, dtype="<f4")
    for _ in range(epochs):
        state = spark.sparkContext.broadcast((z, n))
        z_sum, n_sum, gains = (np.zeros(size) for _ in range(3))
        for row in sorted(_epoch(rows, state, rates).collect(), key=lambda r: r.shard):
            z_new, n_new = np.frombuffer(row.z, "<f4"), np.frombuffer(row.n, "<f4")
            gain = np.maximum(n_new - n, 0)
            z_sum += gain * z_new
            n_sum += gain * n_new
            gains += gain
        met = gains > 0
        z[met], n[met] = z_sum[met] / gains[met], n_sum[met] / gains[met]
        state.destroy()
    weights = Ftrl(z.astype(float), n.astype(float), **rates).weights(np.arange(size))
    at = np.flatnonzero(weights[:-1])
    return Model(at, weights[at], float(weights[-1]), bits)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, by the whole of its text; the model's list of weights is broadcast."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = np.zeros(1 << m.bits)
        dense[m.at] = m.weight
        for b in batches:
            scores = np.array([sigmoid(m.intercept + float(dense[features(t, m.bits, dense)].sum())) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
