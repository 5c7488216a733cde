"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, of a repeat
token beside each word that equals the one before it, and of its hashed
character 3- and 4-grams (bytes, within words and across spaces); a linear
layer and a softmax over the two classes follow.  Vectors and layer are
trained together by minibatch gradient descent (AdaGrad) in numpy, in one task,
on at most MAX_TRAIN labelled rows (those with the smallest id hash).  Scoring
covers every whole text: as the layer is linear, each bucket's vector is
projected to one number first, and a document's score needs only their mean.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, hash_words, slices, text_buffers, word_bounds

BUCKETS = 1 << 16
#: The bucket of the token that stands beside a word equal to the one before it.
AGAIN = 0
DIM = 12
EPOCHS = 6
MINIBATCH = 64
RATE = 0.25
MAX_TRAIN = 8192
THRESHOLD = 0.3


def fold(doc_id: int | None, k: int) -> int:
    """crc32 of the id as text, modulo k; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % k


def features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays: words, repeat tokens, then character 3-grams and 4-grams."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    starts, ends, first = word_bounds(data, off)
    rows = np.arange(len(off) - 1)
    word, word_row = hash_words(data, starts, ends), np.repeat(rows, np.diff(first))
    again = np.flatnonzero((word[1:] == word[:-1]) & (word_row[1:] == word_row[:-1])) + 1
    out = [(word_row, (word >> shift).astype(np.int32)), (word_row[again], np.full(len(again), AGAIN, np.int32))]
    byte_row = np.repeat(rows.astype(np.int32), np.diff(off))
    d = data.astype(np.uint32)
    gram = d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA77) ^ d[2:] * np.uint32(0xC2B2AE3D) if len(d) > 2 else np.zeros(0, np.uint32)
    for n in (3, 4):
        if n == 4:
            gram = gram[:-1] * np.uint32(0x27D4EB2F) ^ d[3:] * np.uint32(0x165667B1) if len(d) > 3 else np.zeros(0, np.uint32)
        whole = byte_row[: len(gram)] == byte_row[n - 1 :] if len(gram) else np.zeros(0, bool)
        g = gram ^ (gram >> np.uint32(15))
        g = (g * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
        out.append((byte_row[: len(gram)][whole], g[whole].astype(np.int32)))
    return out


def counted(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their shares."""
    result = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        ids = np.concatenate([b for _, b in features(data, np.array([0, len(data)]))])
        u, n = np.unique(ids, return_counts=True)
        result.append((u, (n / max(1, n.sum())).astype(np.float32)))
    return result


def train(texts, labels, seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's projected weight (class 1 minus class 0), and the bias."""
    docs, y = counted(texts), np.asarray(labels, dtype=np.int64)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_l, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), MINIBATCH):
            pick = order[k : k + MINIBATCH]
            ids = np.concatenate([docs[i][0] for i in pick])
            share = np.concatenate([docs[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(docs[i][0]) for i in pick])
            e = vectors[ids] * share[:, None]
            mean = np.stack([np.bincount(row, e[:, j], len(pick)) for j in range(DIM)], 1).astype(np.float32)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            g_layer, g_bias, g_mean = mean.T @ p, p.sum(0), p @ layer.T
            seen_l += g_layer**2
            seen_b += g_bias**2
            layer -= RATE * g_layer / np.sqrt(seen_l)
            bias -= RATE * g_bias / np.sqrt(seen_b)
            u, inverse = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(inverse, g_mean[row, j] * share, len(u)) for j in range(DIM)], 1).astype(np.float32)
            seen_v[u] += (g**2).mean(1)
            vectors[u] -= RATE * g / np.sqrt(seen_v[u])[:, None]
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Train on labelled rows outside fold 0, at most `max_train` texts; without any, all scores are 0.5."""
    fold_of = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    chosen = labels.where((fold_of != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One text an id: repeated rows of a labelled id must not swell the fit, which runs in one task.
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality")

    def run(batches):
        texts, ys = [], []
        for batch in batches:
            texts += col(batch, "text").to_pylist()
            ys += col(batch, "quality").to_pylist()
        if len(set(ys)) == 2:
            weights, bias = train(texts, ys)
        else:
            weights, bias = np.zeros(BUCKETS, np.float32), 0.0
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    model = sample.repartition(1).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, "weights binary, bias double").first()
    if model is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(bytes(model["weights"]), np.float32), model["bias"]


def score_batch(column, weights: np.ndarray, bias: float) -> np.ndarray:
    data, off = text_buffers(column)
    n = len(off) - 1
    total, count = np.zeros(n), np.zeros(n)
    for row, bucket in features(data, off):
        total += np.bincount(row, weights[bucket], n)
        count += np.bincount(row, minlength=n)
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of every row with held_out, score and predicted (score >= 0.3).

    Null and empty texts get the score of the bias alone; null ids are scored
    too (fold of an empty text); repeated rows are scored alike; labels other
    than 0 and 1 are not learnt from, of repeated labels the larger counts; an
    empty table gives no rows.
    """
    weights, bias = fit(docs, labels, folds)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))  # BUCKETS numbers

    def run(batches):
        w, b = shared.value
        for batch in slices(batches, "text", 4 << 20):
            score = score_batch(col(batch, "text"), w, b)
            held = [fold(i, folds) == 0 for i in col(batch, "doc_id").to_pylist()]
            kept = [col(batch, c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(held), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*columns, "held_out", "score", "predicted"])

    kinds = dict(docs.dtypes)
    wanted = list(dict.fromkeys([*columns, "doc_id", "text"]))
    return docs.select(*wanted).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Only the rows predicted 1, all columns kept; null cases as in `classify`."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds))

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            yield batch.filter(pa.array(score_batch(col(batch, "text"), *model.value) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
