"""Language-model scoring with a log-bilinear model, trained in numpy by noise-contrastive estimation.

Counts. Every training token is counted: words are hashed to 64 bits, counted in each task first, and
summed by word. N, V and all counts cover the whole corpus. Words whose count is at or above a threshold,
FREQUENT at most, go to every task; counts of other words are joined to the tokens by hash, a shuffle whose
keys are all rare.

Model. The WORDS most frequent tokens stand for themselves; any other word has one of 256 classes, by a
hash of its last three bytes. The next token's representation is predicted from the two before it, each
through a matrix of its position (r = R[c1] C1 + R[c2] C2), and scores are s(w) = r . Q[w] + b[w]. Products
of those matrices give tables of s by context and a normaliser for each pair of contexts, so that a token's
normalised log-probability is four look-ups. A word inside a class has the probability
(c + 1) / (N_class + V_class + 1). The model starts from a bounded sample: of WARM_ROWS training texts, cut
into runs of WARM_TOKENS tokens, the WARM_ROWS runs with the least hashes. Then every task trains on all its training texts, and
the tasks' parameters are averaged by their tokens, in levels of 16.

Defined results: a null text is empty and has one token, the end. Without any training text N and V are 0,
base_score is n_tokens * log10(1), and score is finite. Rows are scored one by one, so that repeated rows
agree; a row without doc_id is scored but never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordscan
from .common import crc_bucket, map_batches, runs, small_batches, stored, texts_of

FREQUENT = 1 << 18
WORDS = 512
CLASSES = 256
DIMS = 24
NOISE = 32
BATCH = 4096
RATE = 0.08
WARM_ROWS = 1200
WARM_TOKENS = 20_000
WARM_EPOCHS = 4
GROUP = 16
END = np.uint64(0x1F0E2D3C4B5A6978)


def token_runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, hashes, classes, tokens of each text) of runs of texts; the last token of each is END."""
    for lo, hi in runs([len(t) for t in texts], wordscan.PIECE):
        parts, counts = [], []
        group = [t.lower() for t in texts[lo:hi]]
        for piece in [group] if hi - lo > 1 or len(group[0]) <= wordscan.PIECE else [[p] for p in wordscan.split_long(group[0])]:
            w = wordscan.scan(piece)
            counts.append(w.counts)
            tail = np.zeros(len(w.starts), np.uint64)
            for back in (1, 2, 3):
                at = w.ends - back
                tail = tail << np.uint64(8) | np.where(at >= w.starts, w.buf[at], 0).astype(np.uint64)
            parts.append((w.hashes, (wordscan.mix(tail) >> np.uint64(56)).astype(np.int16)))
        n = counts[0] if hi - lo > 1 else np.array([sum(int(c.sum()) for c in counts)])
        ends = np.cumsum(n)
        yield lo, np.insert(np.concatenate([p[0] for p in parts]), ends, END), np.insert(np.concatenate([p[1] for p in parts]), ends, 0), n + 1


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, c, k = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, first, inv = np.unique(h, return_index=True, return_inverse=True)
    return u, np.bincount(inv, weights=c, minlength=len(u)).astype(np.int64), k[first]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text): (h, c, k) of each task's distinct tokens."""
    parts: list[tuple] = []

    def out() -> pa.RecordBatch:
        h, c, k = _merge(parts)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(c), pa.array(k.astype(np.int32))], ["h", "c", "k"])

    for b in batches:
        for _, h, k, _ in token_runs(texts_of(b.column(0))):
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            parts.append((u, n, k[first]))
        if sum(len(p[0]) for p in parts) > 1 << 20:
            parts[:] = [_merge(parts)]
            if len(parts[0][0]) > 1 << 20:
                yield out()
                parts.clear()
    if parts:
        yield out()


@dataclass
class Lexicon:
    """What a task knows of the corpus: frequent words and their counts, model words, classes, totals."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    model: np.ndarray  # model id of each of `hashes`, or -1
    class_log: np.ndarray  # log10(N_class + V_class + 1)
    unigram: np.ndarray  # of model ids
    total: int
    distinct: int

    def place(self, h: np.ndarray) -> np.ndarray:
        """Index into `hashes`, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def ids(self, h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model ids of tokens, and their places."""
        at = self.place(h)
        m = np.where(at >= 0, self.model[at] if len(self.model) else -1, -1)
        return np.where(m >= 0, m, WORDS + k.astype(np.int64)), at


def lexicon(counts: DataFrame, most: int = FREQUENT) -> Lexicon:
    """From the table of counts (h, c, k): the driver gets `most` words at most, and sums by class."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    held, least = 0, 1 << 30
    for r in sorted(counts.groupBy(level.alias("l")).count().collect(), key=lambda r: -r["l"]):
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r["l"]
    rows = counts.where(level >= least).select("h", "c").toArrow()
    h, c = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    model = np.full(len(h), -1)
    top = np.lexsort((h, -c, h != END))[:WORDS]  # the end is always a model word, the first
    model[top] = np.arange(len(top))
    chosen = counts.sparkSession.createDataFrame(pa.table({"h": pa.array(h[top].view(np.int64)), "m": pa.array(np.arange(len(top)))}))
    rest = counts.join(F.broadcast(chosen), "h", "left_anti").groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    size = np.ones(CLASSES)
    mass = np.zeros(WORDS + CLASSES)
    mass[: len(top)] = c[top]
    for r in rest:
        size[r["k"]] += r["n"] + r["v"]
        mass[WORDS + r["k"]] = r["n"]
    return Lexicon(h, c, model, np.log10(size), (mass + 0.5) / (mass + 0.5).sum(), int(total[0]), int(total[1]))


SHAPES = ((WORDS + CLASSES, DIMS), (DIMS, DIMS), (DIMS, DIMS), (WORDS + CLASSES, DIMS), (WORDS + CLASSES,))


def start(lex: Lexicon) -> list[np.ndarray]:
    """R, C1, C2, Q, b."""
    rng = np.random.default_rng(5)
    near = np.eye(DIMS, dtype=np.float32)
    r, q = (rng.normal(0, 0.1, SHAPES[0]).astype(np.float32) for _ in range(2))
    return [r, near.copy(), near * np.float32(0.5), q, np.log(lex.unigram).astype(np.float32)]


class Trainer:
    """Noise-contrastive estimation by Adagrad, a batch at a time; noise is drawn for a batch at once."""

    def __init__(self, params: list[np.ndarray], unigram: np.ndarray, seed: int) -> None:
        self.p = [x.copy() for x in params]
        self.g = [np.full(x.shape, 1e-2, np.float32) for x in params]
        self.rng = np.random.default_rng([31, seed])
        self.cum = np.cumsum(unigram)
        self.log_kq = np.log(NOISE * unigram).astype(np.float32)
        self.wait: list[np.ndarray] = []
        self.tokens = 0

    def feed(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        self.wait.append(np.stack([c1, c2, w]))
        if sum(x.shape[1] for x in self.wait) >= 16 * BATCH:
            self.flush()

    def flush(self) -> None:
        if self.wait:
            x = np.concatenate(self.wait, axis=1)
            self.wait = []
            x = x[:, self.rng.permutation(x.shape[1])]
            for a in range(0, x.shape[1], BATCH):
                self.step(*x[:, a : a + BATCH])

    def _rows(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        flat = (at[:, None] * DIMS + np.arange(DIMS)).ravel()
        return np.bincount(flat, weights=x.ravel(), minlength=len(self.p[0]) * DIMS).reshape(-1, DIMS).astype(np.float32)

    def step(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        r, m1, m2, q, b = self.p
        n = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1]), len(b) - 1)
        x1, x2 = r[c1], r[c2]
        h = x1 @ m1 + x2 @ m2
        qw, qn = q[w], q[n]
        pos = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, qw) + b[w] - self.log_kq[w], -30, 30)))
        neg = 1 / (1 + np.exp(-np.clip(h @ qn.T + (b[n] - self.log_kq[n])[None, :], -30, 30)))
        dh = pos[:, None] * qw - neg @ qn
        dq = self._rows(w, pos[:, None] * h)
        np.add.at(dq, n, -(neg.T @ h))
        db = np.bincount(w, weights=pos, minlength=len(b)).astype(np.float32)
        np.add.at(db, n, -neg.sum(axis=0))
        d1, d2 = x1.T @ dh, x2.T @ dh
        dr = self._rows(c1, dh @ m1.T) + self._rows(c2, dh @ m2.T)
        scale = np.float32(1 / len(w))
        for p, g, d in zip(self.p, self.g, (dr, d1, d2, dq, db), strict=True):
            d *= scale
            g += d * d * 100
            p += np.float32(RATE) * d * 10 / np.sqrt(g)
        self.tokens += len(w)


def contexts(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids before each token and before that; ends (id 0) stand before a text."""
    c1 = np.concatenate([[0], ids[:-1]])
    c2 = np.concatenate([[0, 0], ids[:-2]])[: len(ids)]
    c2[np.cumsum(counts) - counts] = 0
    return c1, c2


def tables(params: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T1, T2, log Z): log P(w | c1, c2) = T1[c1, w] + T2[c2, w] - log Z[c1, c2]."""
    r, m1, m2, q, b = params
    t1, t2 = (r @ m1) @ q.T + b, (r @ m2) @ q.T
    z = np.empty((len(r), len(r)), np.float32)
    for c in range(len(r)):
        s = t2 + t1[c]
        top = s.max(axis=1)
        z[c] = np.log(np.exp(s - top[:, None]).sum(axis=1)) + top
    return t1.astype(np.float32), t2.astype(np.float32), z


def learn(train: DataFrame, lex: Lexicon) -> list[np.ndarray]:
    """Parameters from the rows (doc_id, text) of `train`."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(lex)

    def ids(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, owner, part, sizes = [], [], [], []
        for lo, h, k, n in token_runs(texts_of(b.column(1))):
            flat.append(shared.value.ids(h, k)[0].astype(np.int16))
            cuts = -(-n // WARM_TOKENS)
            owner.append(lo + np.repeat(np.arange(len(n)), cuts))
            part.append(np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
            sizes.append(np.minimum(np.repeat(n, cuts) - part[-1] * WARM_TOKENS, WARM_TOKENS))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
        return pa.record_batch([b.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(part).astype(np.int32)), lists], ["doc_id", "part", "ids"])

    some = train.select("doc_id", F.xxhash64("doc_id", F.lit("warm")).alias("o")).orderBy("o", "doc_id").limit(WARM_ROWS).select("doc_id").distinct()
    texts = train.join(F.broadcast(some), "doc_id").select("doc_id", "text")
    id_type = train.schema["doc_id"].dataType.simpleString()
    warm = map_batches(texts, ids, f"doc_id {id_type}, part int, ids array<short>")
    warm = warm.orderBy(F.xxhash64("doc_id", "part", F.lit("warm")), "doc_id", "part", F.xxhash64("ids")).limit(WARM_ROWS).select("ids").toArrow()
    t = Trainer(start(lex), lex.unigram, 0)
    for _ in range(WARM_EPOCHS):
        for x in warm.column("ids"):
            w = x.values.to_numpy().astype(np.int64)
            t.feed(*contexts(w, np.array([len(w)])), w)
        t.flush()
    first = spark.sparkContext.broadcast(t.p)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own = Trainer(first.value, shared.value.unigram, part + 1)
        for b in batches:
            for _, h, k, n in token_runs(texts_of(b.column(0))):
                w = shared.value.ids(h, k)[0]
                own.feed(*contexts(w, n), w)
        own.flush()
        if own.tokens:
            flat = np.concatenate([x.ravel() for x in own.p]) * np.float32(own.tokens)
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([own.tokens], pa.int64()), pa.array([flat], pa.list_(pa.float32()))], ["part", "n", "x"])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        x = sum(np.asarray(c.values, np.float64) for c in t.column("x")).astype(np.float32)
        return pa.table({"part": pa.array([t.column("part")[0].as_py() // GROUP], pa.int64()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "x": pa.array([x], pa.list_(pa.float32()))})

    schema = "part long, n long, x array<float>"
    level = train.select("text").mapInArrow(local, schema)
    tasks = train._jdf.queryExecution().toRdd().getNumPartitions()
    while tasks > GROUP:  # sums of GROUP tasks at a time, until a group's worth is left for the driver
        level = level.groupBy(F.floor(F.col("part") / GROUP).alias("g")).applyInArrow(lambda t: add(t), schema)
        tasks = -(-tasks // GROUP)
    total, n = np.zeros(sum(int(np.prod(s)) for s in SHAPES)), 0
    for r in sorted(level.collect(), key=lambda r: r["part"]):
        total += np.array(r["x"])
        n += r["n"]
    if not n:
        return t.p
    cuts = np.cumsum([int(np.prod(s)) for s in SHAPES])[:-1]
    return [x.reshape(s).astype(np.float32) for x, s in zip(np.split(total / n, cuts), SHAPES, strict=True)]


def score(docs: DataFrame, train) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row; learns from rows where `train` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    corpus = docs.where(train).select("doc_id", "text")
    counts = corpus.select("text").mapInArrow(_count, "h long, c long, k int").groupBy("h").agg(F.sum("c").alias("c"), F.min("k").alias("k"))
    counts = stored(counts, "counts")
    lex = lexicon(counts)
    model = spark.sparkContext.broadcast((lex, *tables(learn(corpus, lex))))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        own, t1, t2, z = model.value
        log_c = np.log10(own.counts + 1.0)
        log_all = np.log10(own.total + own.distinct + 1.0)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for _, h, k, n in token_runs(texts_of(b.column(1))):
                w, at = own.ids(h, k)
                c1, c2 = contexts(w, n)
                first = np.cumsum(n) - n
                lp = (t1[c1, w] + t2[c2, w] - z[c1, c2]).astype(np.float64) / np.log(10)
                count = np.where(at >= 0, log_c[at] if len(log_c) else 0.0, 0.0)
                in_class = np.where(w >= WORDS, count - own.class_log[np.maximum(w - WORDS, 0)], 0.0)
                cols[0].append(n)
                cols[1].append(np.add.reduceat((at >= 0).astype(np.int64), first))
                cols[2].append(np.add.reduceat(count, first) - n * log_all)
                cols[3].append(np.add.reduceat(lp + in_class, first))
                words, text = h[at < 0].view(np.int64), np.repeat(np.arange(len(n)), n)[at < 0]
                order = np.lexsort((words, text))
                words, text = words[order], text[order]
                new = np.flatnonzero(np.diff(words, prepend=0).astype(bool) | np.diff(text, prepend=-1).astype(bool)) if len(words) else np.zeros(0, np.int64)
                cols[4].append(words[new])
                cols[5].append(np.diff(new, append=len(words)).astype(np.int32))
                cols[6].append(np.bincount(text[new], minlength=len(n)))
            ids = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            x = [np.concatenate(c) for c in cols]
            ends = pa.array(np.concatenate([[0], np.cumsum(x[6])]).astype(np.int32))
            rare = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in x[4:6]]
            yield pa.record_batch([ids, b.column(0), *map(pa.array, x[:4]), *rare], ["row", "doc_id", "n", "known", "base", "score", "rare", "tf"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {id_type}, n long, known long, base double, score double, rare array<long>, tf array<int>")
    scored = stored(scored, "scored")
    # words below the threshold: their counts join by hash, and come back as sums by row
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "tf")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.tf").alias("tf"))
    rare = rare.join(counts.select("h", "c"), "h").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("log"))
    out = scored.select("row", "doc_id", "n", "known", "base", "score").join(rare, "row", "left")
    more = F.coalesce("log", F.lit(0.0))
    return out.select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def evaluate(docs: DataFrame) -> DataFrame:
    """`score` with held_out: learned from rows whose crc32(doc_id) mod 7 is not 2."""
    out = score(docs, crc_bucket("doc_id", 7) != 2)
    return out.select("doc_id", F.coalesce(crc_bucket("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
