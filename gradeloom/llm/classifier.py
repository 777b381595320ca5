"""Quality classifier: random-indexing vectors, pooled per document, and a small network.

Every word and every word shape has a sparse random index vector, given by its
hash. Its own vector is the sum of the index vectors around it in the whole
corpus. A document is the mean of its words' vectors and the mean of its shapes'
vectors. A network of two layers, trained with numpy on a bounded sample of
labelled rows, gives a probability, whose temperature is fitted on rows of that
sample that the network hasn't seen.

Null and empty texts have the zero vector and a score like any other. Rows with
the same id stay apart. Labels without a value don't count, and several labels
of a document are several examples. Without labels of both kinds every score is
the share of ones, or 0.5 without any. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import Blocks, keyed, mapped, packed, remainder, table, texts, unpacked, written

#: Hash buckets of words and of shapes, numbers in a vector, and those that aren't zero in an index vector.
WORDS, SHAPES, SIZE, ENTRIES = 1 << 15, 1 << 11, 64, 2
#: Neighbours on each side that a vector sums up.
REACH = 2
#: Tokens that are counted at a time, and distinct words a task remembers the buckets of.
AT_ONCE, REMEMBERED = 1 << 20, 400_000


@dataclass(frozen=True)
class Training:
    #: At most so many labelled rows are used, those with the least hash of the id.
    sample: int = 20_000
    hidden: int = 32
    epochs: int = 30
    batch: int = 256
    rate: float = 3e-3
    decay: float = 1e-4
    #: One row of so many is kept back for the temperature.
    held_back: int = 5
    seed: int = 7


def index_vectors(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector."""
    rng = np.random.default_rng(buckets)
    return rng.integers(0, SIZE, (ENTRIES, buckets)), rng.choice(np.array([-1, 1]), (ENTRIES, buckets))


def shape(word: str) -> str:
    """Runs of capitals, other letters, digits, and each other character as it is."""
    out = ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(kind):
            out += kind
    return out


class Buckets:
    """Texts to buckets of words and shapes. A word that equals the one before has a shape of its own."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def bucket(self, word: bytes) -> int:
        text = word.decode()
        w = zlib.crc32(text.lower().encode()) % WORDS
        s = zlib.crc32(shape(text).encode()) % (SHAPES // 2)
        return w * SHAPES + s

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode().split()
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self.bucket(w)
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        shapes = both % SHAPES
        if len(both) > 1:
            shapes[1:] += (both[1:] == both[:-1]) * (SHAPES // 2)
        return both // SHAPES, shapes


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (text) to sums of the index vectors around each word and each shape."""
    buckets = Buckets()
    sums = [np.zeros(n * SIZE, np.int64) for n in (WORDS, SHAPES)]
    indexes = [index_vectors(n) for n in (WORDS, SHAPES)]
    held: list[list[np.ndarray]] = [[], []]
    # Tokens that belong to no text, between texts.
    gap = np.full(REACH, -1)

    def add() -> None:
        for total, (places, signs), parts in zip(sums, indexes, held, strict=True):
            tokens = np.concatenate([gap, *parts])
            for step in range(1, REACH + 1):
                a, b = tokens[:-step], tokens[step:]
                real = (a >= 0) & (b >= 0)
                for one, other in ((a[real], b[real]), (b[real], a[real])):
                    for place, sign in zip(places, signs, strict=True):
                        at = one * SIZE + place[other]
                        total += np.bincount(at, sign[other], len(total)).astype(np.int64)
            parts.clear()

    n = 0
    for batch in batches:
        for text in texts(batch):
            found = buckets(text)
            for parts, tokens in zip(held, found, strict=True):
                parts += [tokens, gap]
            n += len(found[0])
            if n >= AT_ONCE:
                add()
                n = 0
    if held[0]:
        add()
    yield from Blocks.emit(sums)


def unit(sums: np.ndarray, buckets: int) -> np.ndarray:
    vectors = sums.reshape(buckets, SIZE).astype(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)


def pooling(shared) -> Callable:
    """Batches (..., text) with the text replaced by the document's vector, as bytes."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, vectors = Buckets(), shared.value
        for batch in batches:
            out = []
            for text in texts(batch):
                parts = []
                for tokens, known in zip(buckets(text), vectors, strict=True):
                    distinct, counts = np.unique(tokens, return_counts=True)
                    parts.append(counts.astype(np.float32) @ known[distinct] / max(1, len(tokens)))
                out.append(np.concatenate(parts).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "vector"]
            )

    return pool


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Two layers over standardised inputs; probabilities are divided in the logit by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, how: Training):
        self.constant = float(y.mean()) if len(y) else 0.5
        self.trained = len(set(y.tolist())) == 2
        if not self.trained:
            return
        back = np.arange(len(y)) % how.held_back == how.held_back - 1
        if len(set(y[back].tolist())) < 2:
            back[:] = False
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.fit(self.standard(x[~back]), y[~back], how)
        seen = back if back.any() else ~back
        logits = self.logits(self.standard(x[seen]))
        loss = [np.mean(np.logaddexp(0, np.where(y[seen] > 0, -1, 1) * logits / t)) for t in self.temperatures()]
        self.temperature = float(self.temperatures()[int(np.argmin(loss))])

    @staticmethod
    def temperatures() -> np.ndarray:
        return np.exp(np.linspace(np.log(0.5), np.log(10), 100))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(x @ a + b, 0) @ c + d[0]

    def fit(self, x: np.ndarray, y: np.ndarray, how: Training) -> None:
        rng = np.random.default_rng(how.seed)
        self.weights = [
            rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], how.hidden)),
            np.zeros(how.hidden),
            rng.normal(0, np.sqrt(1 / how.hidden), how.hidden),
            np.zeros(1),
        ]
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        step = 0
        for _ in range(how.epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), how.batch):
                rows = order[at : at + how.batch]
                inputs = x[rows]
                a, b, c, d = self.weights
                h = np.maximum(inputs @ a + b, 0)
                err = (sigmoid(h @ c + d[0]) - y[rows]) / len(rows)
                back = np.outer(err, c) * (h > 0)
                grads = [inputs.T @ back + how.decay * a, back.sum(axis=0), h.T @ err + how.decay * c, err.sum(keepdims=True)]
                step += 1
                for w, g, m, v in zip(self.weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.constant)
        return sigmoid(self.logits(self.standard(x)) / self.temperature)


def scoring(network: Network) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<f4").reshape(batch.num_rows, -1)
            found = network(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.float64())], ["id", "_k1", "_k2", "score"])

    return score


def scored(
    documents: DataFrame, labels: DataFrame, how: Training = Training(), doc_id: str = "doc_id", text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """Documents as (id, _k1, _k2, score). `labels` are the rows (doc_id, quality) that may be learned from."""
    spark = documents.sparkSession
    rows = keyed(documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")), ["id", "text"])
    sums = Blocks.gathered(mapped(rows.select("text"), contexts, Blocks.SCHEMA), [WORDS * SIZE, SHAPES * SIZE])
    vectors = spark.sparkContext.broadcast([unit(s, n) for s, n in zip(sums, (WORDS, SHAPES), strict=True)])
    pooled = written(
        mapped(rows.select("id", "_k1", "_k2", "text"), pooling(vectors), "id long, _k1 long, _k2 long, vector binary"),
        "document-vectors",
    )
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1)
    )
    # Labels that have a document are drawn before they meet the vectors: a bounded number of narrow rows, so they
    # can be broadcast.
    known = known.distinct().join(pooled.select("id"), "id", "left_semi")
    drawn = known.orderBy(F.xxhash64("id"), "id", "label").limit(how.sample)
    order = [F.xxhash64("id"), "id", "_k1", "_k2", "label"]
    sample = pooled.join(F.broadcast(drawn), "id").orderBy(*order).limit(how.sample).select("vector", "label").toArrow()
    data = b"".join(sample.column("vector").to_pylist())
    x = np.frombuffer(data, "<f4").reshape(-1, 2 * SIZE).astype(np.float64)
    network = Network(x, np.array(sample.column("label").to_pylist(), np.float64), how)
    return mapped(pooled, scoring(network), "id long, _k1 long, _k2 long, score double")


#: One of so many ids is never learned from.
FOLDS = 5
#: Scores from which a document counts as good.
GOOD = 0.3


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(remainder("doc_id", FOLDS) != 0)


def good_documents(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier doesn't reject."""
    rejected = scored(documents, learnable(labels), doc_id=doc_id, text=text).where(F.col("score") < GOOD)
    rows = packed(documents.withColumn(doc_id, F.col(doc_id).cast("long")), [doc_id, text])
    return unpacked(rows.join(rejected.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_anti"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), learnable(table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"),
        (remainder("id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
