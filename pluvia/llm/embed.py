"""Embedding near-duplicates by p-stable hashing, with exact cosines for what it finds.

Vectors are normalised; a table's key is the quantised values of several random projections
(floor((a . x + b) / WIDTH)). Vectors with the same label that share a key in a table are candidates. By one
rule a key has so many projections that unrelated vectors of the largest label share it in groups of about
BUCKET, and there are so many tables that a pair at the threshold misses all with a probability below MISS.

1. Equal vectors of a label are one class with a count, named by a hash.
2. Tables are joined by light rows: a key, the class, and SIGNS signs of random projections. Classes that share a key
   and differ in FAR signs at most are joined; at the threshold a linked pair differs in more with a
   probability below 1e-7, and unrelated vectors pass about once in 10**6 pairs. Only a spanning forest
   leaves a task. A bucket of more than PIECE classes is dealt into pieces, and each pair of pieces is a task.
3. Components of these are small groups of near vectors. Vectors go to the tasks of their groups, once as a rule:
   a group of more than BLOCK classes is dealt into pieces, and each pair of pieces is a task. There all
   cosines are computed in double precision, and those of LINK or more are links. Only sums by class and a
   spanning forest leave the task: pairs are never listed.
4. n_links adds the counts of linked classes and the other members of one's own class; component_id is
   the least id of the links' components.

Defined results: vectors that are null, zero, or hold null or non-finite components, or whose label is
null, link with nothing: n_links 0, component_id their own vec_id. Vectors of different lengths never link.
Vectors are scaled by their largest part first, so that very small and very large ones count. Rows that
repeat a vec_id are links of each other if their vectors link; a row without vec_id is counted by others,
belongs to its class's component (null if no member has an id), and is not kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, give_back, small_batches, stored
from .vectors import lengths
from .wordscan import mix

LINK = 0.93
WIDTH = 1.9
BUCKET = 64
MISS = 0.002
SIGNS = 128
FAR = 36
PIECE = 8192  # classes of a bucket in a task
BLOCK = 1024  # classes of a group in a task
SEED = 33
_ROWS = 1 << 16


def collision(cosine: float, width: float = WIDTH) -> float:
    """The probability that a projection of two unit vectors falls into one interval."""
    c = math.sqrt(max(2 - 2 * cosine, 1e-12)) / width
    return math.erf(1 / c / math.sqrt(2)) - 2 * c / math.sqrt(2 * math.pi) * (1 - math.exp(-1 / (2 * c * c)))


def shape_for(classes: int, link: float = LINK) -> tuple[int, int]:
    """(projections of a key, tables) where the largest label has this many classes."""
    hashes = max(1, math.ceil(math.log(max(1, classes) / BUCKET) / -math.log(collision(0.0)))) if classes > BUCKET else 1
    return hashes, math.ceil(math.log(MISS) / math.log(1 - collision(link) ** hashes))


def keys_of(unit: np.ndarray, labels: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """`tables` keys for each normalised vector; labels, lengths and tables don't share any."""
    rng = np.random.default_rng([SEED, unit.shape[1]])
    own = mix(labels.astype(np.int64).view(np.uint64) + np.uint64(unit.shape[1]) * np.uint64(1 << 40))
    odd = rng.integers(0, 1 << 62, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(unit), tables), np.uint64)
    for t in range(tables):
        a = rng.standard_normal((unit.shape[1], hashes))
        h = np.floor((unit @ a + rng.uniform(0, WIDTH, hashes)) / WIDTH).astype(np.int64).view(np.uint64)
        out[:, t] = mix(mix((h * odd).sum(axis=1, dtype=np.uint64) + own) + np.uint64(t) * np.uint64(0x9E3779B97F4A7C15 >> 8))
    return out


def signs_of(unit: np.ndarray) -> np.ndarray:
    """SIGNS signs of random projections, as two numbers of 64 bits."""
    a = np.random.default_rng([SEED, 1, unit.shape[1]]).standard_normal((unit.shape[1], SIGNS))
    return np.packbits(unit @ a > 0, axis=1).view(np.uint64)


def normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, normalised vectors) of each length of a column of proper vectors."""
    sizes = lengths(column)
    values, starts = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, normalised(values[starts[rows].astype(np.int64)[:, None] + np.arange(d)])


def _light(hashes: int, tables: int):
    """Rows (id, label, v): a row (bucket, id, x, y) for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
            keys, signs = np.zeros((len(ids), tables), np.uint64), np.zeros((len(ids), 2), np.uint64)
            for rows, unit in by_length(b.column(2)):
                keys[rows], signs[rows] = keys_of(unit, labels[rows], hashes, tables), signs_of(unit)
            cols = [keys.ravel().view(np.int64), *(np.repeat(c, tables) for c in (ids, signs[:, 0].view(np.int64), signs[:, 1].view(np.int64)))]
            yield pa.record_batch([pa.array(c) for c in cols], ["bucket", "id", "x", "y"])
        give_back()

    return run


def _roots(n: int, u: np.ndarray, v: np.ndarray, comp: np.ndarray | None = None) -> np.ndarray:
    """The least number that each of n nodes reaches by edges (u, v), and from where `comp` has it."""
    comp = np.arange(n) if comp is None else comp
    while len(u):
        low = np.minimum(comp[u], comp[v])
        new = comp.copy()
        np.minimum.at(new, comp[u], low)
        np.minimum.at(new, comp[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == comp).all():
            break
        comp = new
    return comp


def spanned(task: np.ndarray, piece: np.ndarray, crossing: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows in order of their tasks, the first row that each is joined to by pairs that differ in FAR signs at most.

    crossing: whether only rows of different pieces are compared.
    """
    n = len(task)
    comp = np.arange(n)
    end = np.searchsorted(task, task, "right")
    at, step = np.arange(n), 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            return comp
        u = at[comp[at] != comp[at + step]]
        u = u[~crossing[u] | (piece[u] != piece[u + step])]
        near = np.bitwise_count(x[u] ^ x[u + step]) + np.bitwise_count(y[u] ^ y[u + step]) <= FAR
        if near.any():
            comp = _roots(n, u[near], u[near] + step, comp)
        step += 1


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, a, b, piece, id, x, y), those of a task (bucket, a, b) together: a spanning forest (u, v)."""
    held: list[np.ndarray] = []

    def out(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        first = spanned(np.cumsum(new), rows[:, 3], rows[:, 1] != rows[:, 2], rows[:, 5].view(np.uint64), rows[:, 6].view(np.uint64))
        u = np.flatnonzero(first != np.arange(len(rows)))
        two = np.unique(np.stack([rows[u, 4], rows[first[u], 4]], axis=1), axis=0)
        return pa.record_batch([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["u", "v"])

    for b in batches:
        held.append(np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1))
        if sum(map(len, held)) >= _ROWS:
            rows = np.ascontiguousarray(np.concatenate(held))
            last = int(np.flatnonzero((rows[:, :3] == rows[-1, :3]).all(axis=1))[0])  # the last task may go on
            if last:
                yield out(rows[:last])
            held = [rows[last:]]
    if held:
        rows = np.ascontiguousarray(np.concatenate(held))
        if len(rows):
            yield out(rows)
    give_back()


def linked(piece: np.ndarray, crossing: bool, count: np.ndarray, unit: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray]:
    """(links gained by each class, the first class that each is joined to) in one task."""
    hit = np.triu(np.einsum("ij,kj->ik", unit, unit, optimize=True) >= link, 1)
    if crossing:
        hit &= piece[:, None] != piece[None, :]
    u, v = np.nonzero(hit)
    gained = np.bincount(u, weights=count[v], minlength=len(count)) + np.bincount(v, weights=count[u], minlength=len(count))
    return gained.astype(np.int64), _roots(len(count), u, v)


def _confirmed(link: float):
    """Rows (component, a, b, piece, id, count, v), those of a task together: (u, null, gained) and edges (u, v, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[np.ndarray | None]]] = []

        def out() -> pa.RecordBatch | None:
            rows = np.concatenate([h[0] for h in held])
            unit = [x for h in held for x in h[1]]
            held.clear()
            if len(rows) < 2 or len({len(x) for x in unit}) > 1:
                return None
            gained, first = linked(rows[:, 3], rows[0, 1] != rows[0, 2], rows[:, 5], np.stack(unit), link)
            g, u = np.flatnonzero(gained), np.flatnonzero(first != np.arange(len(rows)))
            other = pa.array(np.concatenate([np.zeros(len(g), np.int64), rows[first[u], 4]]), mask=np.arange(len(g) + len(u)) < len(g))
            return pa.record_batch([pa.array(np.concatenate([rows[g, 4], rows[u, 4]])), other, pa.array(np.concatenate([gained[g], np.zeros(len(u), np.int64)]))], ["u", "v", "gained"])

        for b in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in b.columns[:6]], axis=1)
            unit: list[np.ndarray | None] = [None] * len(rows)
            for at, x in by_length(b.column(6)):
                for i, one in zip(at.tolist(), x, strict=True):
                    unit[i] = one
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                if lo == hi:
                    continue
                if held and (held[-1][0][-1, :3] != rows[lo, :3]).any() and (done := out()):
                    yield done
                held.append((rows[lo:hi], unit[lo:hi]))
        if held and (done := out()):
            yield done
        give_back()

    return run


def in_pairs(rows: DataFrame, key: str, pieces: str, seed: int) -> DataFrame:
    """`rows` with piece, a and b: each once for every pair of pieces (a <= b) that holds its own."""
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(seed)), F.col(pieces)).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(pieces) - 1)))
    rows = rows.withColumns({"a": F.least("piece", "_other"), "b": F.greatest("piece", "_other")}).drop("_other", pieces)
    return rows.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b")


def dealt(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows (key, id, ...) of keys with more than one row, with `pieces`: how many pieces of about `most` rows the key has."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.ceil(F.col("_n") / most).cast("int").alias("pieces"))
    return attach(rows, key, sizes, "id").where("pieces IS NOT NULL")


def near_duplicates(vectors: DataFrame, link: float = LINK, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors`."""
    small_batches(vectors.sparkSession)
    v = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & ~zero, F.lit(False))
    rows = rows.withColumn("t", F.when(good, F.struct(F.xxhash64("label", "v").alias("p"), F.xxhash64(F.lit(1), "v", "label").alias("q"))))
    whole = rows.where("t IS NOT NULL").groupBy("t").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("count"), F.first("label").alias("label"), F.first("v").alias("v"))
    # classes are named by a hash, since rows may repeat an id or have none
    classes = stored(whole.withColumn("id", F.xxhash64("t")), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    light = classes.select("id", "label", "v").mapInArrow(_light(*shape_for(largest, link)), "bucket long, id long, x long, y long")
    meet = in_pairs(dealt(stored(light, "light"), "bucket", piece), "bucket", "pieces", 5)
    near = components(meet.select("bucket", "a", "b", "piece", "id", "x", "y").mapInArrow(_joined, "u long, v long"))
    groups = in_pairs(dealt(stored(near, "near"), "component", block).join(classes.select("id", "count", "v"), "id"), "component", "pieces", 6)
    found = stored(groups.select("component", "a", "b", "piece", "id", "count", "v").mapInArrow(_confirmed(link), "u long, v long, gained long"), "found")
    gained = found.where("v IS NULL").groupBy("u").agg(F.sum("gained").alias("gained"))
    comps = components(found.where("v IS NOT NULL").select("u", "v"))
    of = classes.select("t", "id", "least", "count").join(gained.withColumnRenamed("u", "id"), "id", "left").join(comps, "id", "left")
    of = of.withColumn("_c", F.coalesce("component", "id"))
    of = stored(of.select("t", "least", "_c", (F.coalesce("gained", F.lit(0)) + F.col("count") - 1).alias("links")), "classes")
    named = of.groupBy("_c").agg(F.min("least").alias("first"))
    of = attach(of, "_c", named, "t").select("t", "links", "first")
    out = attach(rows.select("vec_id", "t"), "t", of, "vec_id")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("t").isNull(), F.col("vec_id")).otherwise(F.col("first")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
