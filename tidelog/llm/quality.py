"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its features: a hashed vector for each word, for each character
n-gram of a word and for each word bigram, and one end mark, so that empty texts have a vector too. Bigrams that repeat
their word share one vector, whatever the word, as words that never occurred in training may be repeated too. A softmax
layer over the average gives the classes. Vectors and layer are learned by plain numpy stochastic gradient descent on the
cross entropy (one document a step, one rate for the vectors and one for the layer, both falling to zero) over at most
``rows`` labelled documents and ``SAMPLE_BYTES`` of text outside the held-out fold (a bounded, documented sample); scoring
reads every whole text. As softmax and average are linear in the vectors up to the last step, each bucket is folded to one
number for scoring. Features are hashed as numpy arrays over whole stretches of a text.

Null texts count as empty. Null labels and labels without document teach nothing; without any labelled
row, or with one class only, every score is the share of label 1 (0.5 if there is none). Repeated rows
and ids get equal scores; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import held_out, labelled_sample, map_rows, remove, whole_text
from .substring import Words, mix

BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4)
ROWS, EPOCHS, RATE, VECTOR_RATE, SEED = 4000, 6, 0.5, 20.0, 7
END, SAME = 0, 1  # buckets of the end mark and of bigrams that repeat their word
STRETCH = 1 << 13  # words looked at together


def bucket(hashes: np.ndarray) -> np.ndarray:
    return 2 + ((hashes >> np.uint64(20)) % np.uint64(BUCKETS - 2)).astype(np.int64)


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the word bigrams of consecutive words."""
    a, b = hashes[:-1], hashes[1:]
    out = bucket(mix(a * np.uint64(0x9E3779B97F4A7C15) + b))
    out[a == b] = SAME
    return out


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Buckets of the character n-grams of words, from their bytes with a space before and after each word: the spaces
    mark both ends, and what holds one inside lies in no word."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h, inside = data[:n].astype(np.uint64), np.ones(n, bool)
    for k in range(1, size):
        part = data[k : k + n]
        h = h << np.uint64(8) | part
        if k < size - 1:
            inside &= part != 32
    return bucket(mix(h[inside] + np.uint64(size << 56)))


def stretches(text: str) -> Iterator[np.ndarray]:
    """The buckets of all features of a text, a bounded stretch of words at a time."""
    yield np.array([END])
    words = text.split()
    for at in range(0, len(words), STRETCH):
        first = max(0, at - 1)  # stretches share a word for the bigrams
        data = " ".join(words[first : at + STRETCH]).encode()
        hashes = Words(data + b"\n").runs(1)
        own = data if first == at else data[data.index(b" ") + 1 :]
        marked = np.frombuffer(b" " + own + b" ", np.uint8)
        yield np.concatenate([bucket(hashes[at - first :]), *(grams(marked, n) for n in GRAMS), bigrams(hashes)])


def feature_counts(text: str) -> tuple[bytes, bytes]:
    found, n = np.unique(np.concatenate(list(stretches(text))), return_counts=True)
    return found.astype(np.uint32).tobytes(), n.astype(np.float32).tobytes()


def collect_features(sample: DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The bounded sample's features, in the order of ids."""

    def make():
        def step(b):
            got = [feature_counts(t) for t in b["text"]]
            return {"doc_id": b["doc_id"], "label": b["label"], "f": [x for x, _ in got], "n": [x for _, x in got]}

        return step

    rows = map_rows(sample, ["doc_id", "label", "text"], "doc_id long, label int, f binary, n binary", make).collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.f)))
    return [(np.frombuffer(r.f, np.uint32), np.frombuffer(r.n, np.float32), int(r.label)) for r in rows]


def loss_and_gradients(mine: np.ndarray, part: np.ndarray, layer: np.ndarray, y: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Cross entropy of one document and its gradients by the vectors of its features and by the layer."""
    mean = part @ mine
    logits = mean @ layer
    p = np.exp(logits - logits.max())
    p /= p.sum()
    loss = -math.log(max(float(p[y]), 1e-30))
    p[y] -= 1
    return loss, part[:, None] * (layer @ p), np.outer(mean, p)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, vector_rate: float = VECTOR_RATE, seed: int = SEED) -> np.ndarray:
    """Folded weights, one for each bucket: the class-1 minus class-0 logit of its vector."""
    random = np.random.default_rng(seed)
    ones = sum(y for _, _, y in rows)
    if not rows or ones in (0, len(rows)):
        share = ones / len(rows) if rows else 0.5
        return np.full(BUCKETS, math.log((share + 1e-3) / (1 - share + 1e-3)), np.float32)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            f, n, y = rows[k]
            mine = vectors[f]
            _, by_vectors, by_layer = loss_and_gradients(mine, n / n.sum(), layer, y)
            left = 1 - done / steps
            layer -= rate * left * by_layer
            vectors[f] = mine - vector_rate * left * by_vectors
            done += 1
    return vectors @ (layer[:, 1] - layer[:, 0])


def fit(spark: SparkSession, docs: DataFrame, sf_dir: str, rows: int = ROWS) -> np.ndarray:
    sample = labelled_sample(spark, docs, sf_dir, "quality", rows)
    found = collect_features(sample)
    remove(sample)
    return train(found)


def scorer(weights: np.ndarray):
    def score(text: str) -> float:
        total = n = 0.0
        for found in stretches(text):
            total += float(weights[found].sum(dtype=np.float64))
            n += len(found)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total / n))))

    return score


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def make():
        of = scorer(weights)

        def step(b):
            s = [of(t) for t in b["text"]]
            return {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": [int(x >= threshold) for x in s]}

        return step

    return map_rows(docs, ["doc_id", held_out().alias("held_out"), whole_text().alias("text")], "doc_id long, held_out boolean, score double, predicted int", make)


def keep(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches ``threshold``, with all columns; only texts travel to Python, and answers back."""
    ship(docs.sparkSession)

    def passes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = scorer(weights)
        for part in texts:
            yield pa.array([of(t) >= threshold for t in part.to_pylist()], pa.bool_())

    passes.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.filter(F.arrow_udf(passes, "boolean")(whole_text()))
