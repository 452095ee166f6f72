"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are hashes of single words, word pairs, and of one, two and three neighbouring word shapes (which
kinds of characters a word holds, and its length in steps); each kind is averaged over its occurrences in
the text. Training is on a sample of labelled rows, those with the least hashes of their ids,
TRAIN_ROWS at most; it runs in one task, in order of the hash, so that reruns agree. Scoring is a sparse
dot product over the whole text.

Defined results: a text that is null or has no word has no features and scores the model's bias. Without
any labelled row the model is all zeros and every score is 0.5. A doc_id with several labels gives a
training row for each. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordscan
from .common import crc_bucket, map_batches, runs, small_batches, texts_of

BITS = 18
TRAIN_ROWS = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.0005, 0.0005
SCALE = 8.0
THRESHOLD = 0.3

_KINDS = np.zeros(256, np.uint64)
for _c in range(33, 256):
    _b = 0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c >= 128 else 4 + (_c * 7 + _c // 13) % 60
    _KINDS[_c] = np.uint64(1) << np.uint64(_b)
_TAGS = np.random.default_rng(5).integers(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


Streams = list[tuple[np.ndarray, np.ndarray]]


def words_and_shapes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words, hashes of their shapes, words of each text) of texts together of about wordscan.PIECE bytes."""
    w = wordscan.scan(texts)
    if not len(w.starts):
        return w.hashes, np.zeros(0, np.uint64), w.counts
    shape = np.bitwise_or.reduceat(_KINDS[w.buf], w.starts)
    return w.hashes, wordscan.mix(shape * _TAGS[6] + np.minimum((w.ends - w.starts) // 3, 7).astype(np.uint64)), w.counts


def grams(hashes: np.ndarray, shape: np.ndarray, counts: np.ndarray, bits: int, before: int = 0) -> Streams:
    """For each kind of feature: bucket numbers in order of the texts, and how many each text has.

    before: so many words at the start of a single text were seen already, and n-grams of these alone don't count.
    """
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(shape))  # words from here to the text's end
    out = []
    for k, (base, n) in enumerate(((hashes, 1), (hashes, 2), (shape, 1), (shape, 2), (shape, 3))):
        h = base * _TAGS[k]
        for j in range(1, n):
            h[:-j] += base[j:] * _TAGS[j + k]
        seen = max(before - n + 1, 0)
        h = h[left >= n][seen:]
        out.append(((wordscan.mix(h) >> np.uint64(64 - bits)).astype(np.int64), np.maximum(counts - n + 1 - seen, 0)))
    return out


def long_grams(text: bytes, bits: int) -> Iterator[Streams]:
    """`grams` of a text of any length, a piece at a time; the last two words go on into the next piece."""
    last = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    for piece in wordscan.split_long(text):
        hashes, shape, _ = words_and_shapes([piece])
        before = len(last[0])
        hashes, shape = np.concatenate([last[0], hashes]), np.concatenate([last[1], shape])
        yield grams(hashes, shape, np.array([len(hashes)]), bits, before)
        last = hashes[-2:], shape[-2:]


def averages(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The dot product of each text's features with the weights."""
    bits = int(len(weights)).bit_length() - 1
    out = np.zeros(len(texts))
    sums, sizes = np.zeros((5, len(texts))), np.zeros((5, len(texts)))
    for lo, hi in runs([len(t) for t in texts], wordscan.PIECE):
        long = len(texts[lo]) > wordscan.PIECE
        for streams in long_grams(texts[lo], bits) if long else [grams(*words_and_shapes(texts[lo:hi]), bits)]:
            for k, (idx, n) in enumerate(streams):
                full = np.flatnonzero(n)
                if len(full):
                    sums[k, lo + full] += np.add.reduceat(weights[idx], np.cumsum(n)[full] - n[full])
                    sizes[k, lo:hi] += n
    for k in range(5):
        out += SCALE * sums[k] / np.maximum(sizes[k], 1)
    return out


def _sparse(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    idx_all, val_all = [], []
    for parts in zip(*long_grams(text, bits), strict=True):
        idx = np.concatenate([i for i, _ in parts])
        if len(idx):
            u, c = np.unique(idx, return_counts=True)
            idx_all.append(u)
            val_all.append(SCALE * c / len(idx))
    if not idx_all:
        return np.zeros(0, np.int64), np.zeros(0)
    u, inv = np.unique(np.concatenate(idx_all), return_inverse=True)
    return u, np.bincount(inv, weights=np.concatenate(val_all))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) by FTRL-proximal over rows of (buckets, values, label)."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        s = z[i]
        w = -(s - np.sign(s) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(s) <= L1] = 0
        return w

    bias = np.array([1 << bits])
    for _ in range(epochs):
        for idx, val, y in rows:
            i, x = np.concatenate([idx, bias]), np.concatenate([val, [1.0]])
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange((1 << bits) + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, where, label: str = "quality", rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Fits on at most `rows` labelled rows for which `where` (over doc_id) holds.

    The sample is bounded, so its ids may be broadcast to the texts. Each text becomes a sparse vector of
    2**bits parts at most where it lies; `rows` of these at most, with repeated ids, meet in one task. The
    driver gets the weights that are not zero, 2**bits + 1 at most.
    """
    small_batches(docs.sparkSession)
    picked = labels.where(where & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    picked = picked.orderBy("h", "doc_id", "y").limit(rows)
    texts = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(picked), "doc_id").select("h", "doc_id", "y", "t")

    def shrink(b: pa.RecordBatch) -> pa.RecordBatch:
        sparse = [_sparse(t, bits) for t in texts_of(b.column(3))]
        lists = [pa.array([s[0] for s in sparse], pa.list_(pa.int64())), pa.array([s[1] for s in sparse], pa.list_(pa.float64()))]
        return pa.record_batch([*b.columns[:3], *lists], ["h", "doc_id", "y", "i", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            for y, i, x in zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                got.append((i.values.to_numpy(), x.values.to_numpy(), y))
        w, bias = fit(got, bits)
        i = np.flatnonzero(w)
        yield pa.record_batch([pa.array(np.append(i, 1 << bits)), pa.array(np.append(w[i].astype(float), bias))], ["i", "w"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sparse = map_batches(texts, shrink, f"h long, doc_id {id_type}, y int, i array<long>, x array<double>")
    model = sparse.orderBy("h", "doc_id", "y", F.xxhash64("i", "x")).limit(rows).mapInArrow(train, "i long, w double").toPandas()
    w = np.zeros((1 << bits) + 1, np.float32)
    bias = 0.0
    if len(model):
        w[model["i"].to_numpy()] = model["w"].to_numpy()
        bias = float(model["w"].iloc[-1])
    return w[:-1], bias


def scores(texts: list[bytes], model: tuple[np.ndarray, float]) -> np.ndarray:
    w, bias = model
    return 1 / (1 + np.exp(-np.clip(averages(texts, w) + bias, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = scores(texts_of(b.column(1)), shared.value)
        return pa.record_batch([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", "text")
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def passing(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, whole, that score `threshold` at least.

    A null or empty text has the score of the model's bias. Repeated rows stay or go together.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(scores(texts_of(b.column(at)), shared.value) >= threshold))

    return map_batches(docs, run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from rows whose crc32(doc_id) mod 5 is not 0, for every row."""
    model = learn(docs, labels, crc_bucket("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
