"""Approximate nearest neighbours by largest inner product, with an inverted multi-index.

Both halves of the vectors are quantised on their own, by centroids of a bounded sample: PER_ROOT * sqrt(n) of
them for n vectors, CENTROIDS at most. A query walks its cells (pairs of centroids) in order of summed distance,
here the negative inner product of its halves with the centroids: a heap holds the frontier of runs of cells, which
have one first centroid and neighbours among the second ones, until no cell is left that comes before the
DEPTH-th entry of those that it has given. The sum at which that entry lies is the query's reach, and the
entries of all cells within its reach are reranked by the exact inner product.

DEPTH is TOP and the query's own rows at least, so that every query gets TOP entries if there are as many. It
is measured, by one rule at every size: PROBES queries are compared with all vectors, and it is the
number of entries within which RECALL of their true neighbours lie. On vectors without any structure that is
near a sixth of all entries at 50,000 vectors of 64 parts, and falls as they become more.

Only entries of cells within a query's reach are multiplied with it; a cell beyond it costs one sum. On small tables, and on
vectors without structure, a query reaches nearly all pieces, but not all of their cells.

Entries are kept in pieces, by first centroids that lie near one another; a first centroid with many entries has pieces
of its own. Every entry goes to one task, once. A query goes to the pieces in which it reaches a cell, and a task
streams queries past the entries of its piece, keeps the best TOP for each, and those are ranked once more.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as queries
or as candidates; nor do vectors of another length than most, which have no inner product with the others.
Scores are sums over components in order, so that equal vectors have equal scores; ties go to the smaller
vec_id. With fewer candidates than TOP all are returned. Rows without vec_id are candidates, and come last among ties. Rows that
repeat a vec_id are candidates each, but not for the query with the same id; if that id is a query's, the row
with the least vector asks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import give_back, map_batches, small_batches, stored
from .vectors import matrix

CENTROIDS = 2048
PER_ROOT = 12
SAMPLE = 1 << 15
PROBES = 256
RECALL = 0.93
TOP = 20
PIECE = 1 << 16
LEAST_PIECE = 1 << 12
RUNS = 4  # runs of cells for each first centroid
EVERY = 20
_CELLS = 1 << 21  # of a matrix of scores
_NONE = np.int64(2**63 - 1)  # stands for a vec_id that is null


def usual_length(vectors: DataFrame) -> int:
    """The commonest length; the shorter of two."""
    r = vectors.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    return r["d"] if r else 0


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(half[None, :] - x[a : a + 4096] @ c.T).argmin(1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    x = x.astype(np.float32)
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest_centroid(x, c)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0)
        c = c.copy()
        c[full] = sums / n[full][:, None]
    return c


@dataclass
class Index:
    """Centroids of both halves, and the cells that have entries: their numbers and how many entries."""

    c1: np.ndarray
    c2: np.ndarray
    i: np.ndarray
    j: np.ndarray
    n: np.ndarray

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries to all centroids of either half."""
        half = self.c1.shape[1]
        return -(q[:, :half] @ self.c1.T.astype(np.float64)), -(q[:, half:] @ self.c2.T.astype(np.float64))

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.c1.shape[1]
        x = x.astype(np.float32)
        return nearest_centroid(x[:, :half], self.c1), nearest_centroid(x[:, half:], self.c2)

    def reach(self, d1: np.ndarray, d2: np.ndarray, depth: int) -> float:
        """A sum within which the cells of a query hold `depth` entries at least, all if there are fewer."""
        size = -(-len(d2) // RUNS)
        o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
        place = np.empty(len(o1), np.int64)
        place[o1] = np.arange(len(o1))
        run = np.empty(len(o2), np.int64)
        run[o2] = np.arange(len(o2)) // size
        at = place[self.i] * RUNS + run[self.j]
        entries = np.bincount(at, weights=self.n, minlength=len(o1) * RUNS).tolist()
        s1, s2 = d1[o1].tolist(), d2[o2][::size].tolist()
        heap, given, held = [(s1[0] + s2[0], 0, 0)], np.zeros(len(entries), bool), 0
        reach, wanted = np.inf, depth
        while True:
            while heap and held < wanted and heap[0][0] <= reach:
                _, a, b = heapq.heappop(heap)
                given[a * RUNS + b] = True
                held += entries[a * RUNS + b]
                if b + 1 < len(s2):
                    heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
                if b == 0 and a + 1 < len(s1):
                    heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
            pick = given[at]
            sums = d1[self.i[pick]] + d2[self.j[pick]]
            order = sums.argsort()
            enough = int(np.searchsorted(np.cumsum(self.n[pick][order]), depth))
            if enough == len(order):  # fewer entries than that
                return float(sums[order[-1]]) if len(order) else -np.inf
            reach = float(sums[order[enough]])  # too far, unless runs that begin before it have all been given
            if not heap or heap[0][0] > reach:
                return reach
            wanted = held + held // 3 + 1


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, entry's place, score) of the best `top` entries for each query; not the query's own id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, _CELLS // max(1, len(x)))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        rough = part @ x.T
        rough[q_ids[lo : lo + step][:, None] == ids[None, :]] = -np.inf
        if rough.shape[1] > top:
            cut = np.partition(rough, rough.shape[1] - top, axis=1)[:, -top]
            cut = np.where(np.isfinite(cut), cut - 1e-9 * (1 + np.abs(cut)), np.finfo(float).min)
        else:
            cut = np.full(len(rough), np.finfo(float).min)
        r, e = np.nonzero(rough >= cut[:, None])
        exact = np.cumsum(x[e] * part[r], axis=1)[:, -1] if len(r) else np.zeros(0)
        order = np.lexsort((ids[e], -exact, r))
        r, e, exact = r[order], e[order], exact[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < top
        out.append((lo + r[first], e[first], exact[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Piece:
    """The entries of a piece, those of a cell together."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray):
        order = np.lexsort((j, i))
        self.ids, self.x, i, j = ids[order], x[order], i[order], j[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0)])
        self.i, self.j, self.n = i[starts], j[starts], np.diff(np.r_[starts, len(i)])

    def within(self, d1: np.ndarray, d2: np.ndarray, reach: float) -> np.ndarray:
        """Places of the entries whose cells a query reaches."""
        return np.flatnonzero(np.repeat(d1[self.i] + d2[self.j] <= reach, self.n))

    def best(self, q_ids: np.ndarray, q: np.ndarray, d1: np.ndarray, d2: np.ndarray, reach: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, vec_id, score) of the best `top` entries within each query's reach."""
        out = []
        for k in range(len(q)):
            at = self.within(d1[k], d2[k], reach[k])
            r, e, s = _best(q_ids[k : k + 1], q[k : k + 1], self.ids[at], self.x[at], top)
            out.append((r + k, self.ids[at[e]], s))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(_NONE)).to_numpy(zero_copy_only=False)


def measured_depth(index: DataFrame, own: Index, probes: tuple[np.ndarray, np.ndarray], top: int, recall: float) -> int:
    """Entries within whose reach `recall` of the probes' true neighbours lie, by comparison with all vectors."""
    q_ids, q = probes
    if not len(q):
        return 1
    shared = index.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask_ids, ask = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            _, x = matrix(b.column(3), ask.shape[1])
            r, e, s = _best(ask_ids, ask, ids_of(b.column(0)), x, top)
            held.append((r, s, b.column(1).to_numpy()[e], b.column(2).to_numpy()[e]))
            r, s, i, j = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((-s, r))
            first = order[np.arange(len(r)) - np.searchsorted(r[order], r[order]) < top]
            held = [(r[first], s[first], i[first], j[first])]
        if held:
            yield pa.record_batch([pa.array(c) for c in held[0]], ["q", "score", "i", "j"])

    found = index.select("vec_id", "i", "j", "embedding").mapInArrow(run, "q long, score double, i int, j int")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "i", "j"))
    true = found.withColumn("_r", rank).where(F.col("_r") <= top).select("q", "i", "j").toArrow()
    of, i, j = (true.column(c).to_numpy() for c in range(3))
    d1, d2 = own.distances(q)
    depths = []
    for k in np.unique(of):
        mine = np.sort(d1[k, i[of == k]] + d2[k, j[of == k]])
        before = np.searchsorted(mine, d1[k, own.i] + d2[k, own.j])  # a cell counts for neighbours from there on
        depths.append(np.cumsum(np.bincount(before, weights=own.n, minlength=len(mine) + 1)[:-1]))
    depths = np.sort(np.concatenate(depths)) if depths else np.ones(1)
    return max(1, int(depths[int(np.ceil(recall * len(depths))) - 1]))


def _pieces(own: Index, parallel: int, piece: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first piece, number of pieces) of each first centroid; near ones share a piece."""
    k = len(own.c1)
    entries = np.bincount(own.i, weights=own.n, minlength=k).astype(np.int64)
    total = int(entries.sum())
    size = -(-total // max(-(-total // piece), min(parallel, -(-total // least)), 1))
    coarse = kmeans(own.c1, max(1, k // 32))
    first, many, now, held = np.zeros(k, np.int64), np.ones(k, np.int64), 0, 0
    for i in np.argsort(nearest_centroid(own.c1, coarse), kind="stable").tolist():
        if held and held + entries[i] > size:
            now, held = now + 1, 0
        first[i] = now
        held += int(entries[i])
        if held > size:  # one centroid alone
            many[i] = -(-held // size)
            now, held = now + int(many[i]), 0
    return first, many


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP, recall: float = RECALL, per_root: float = PER_ROOT, piece: int = PIECE, least_piece: int = LEAST_PIECE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by `every`, its `top` nearest found.

    The centroids are fitted on SAMPLE vectors, those with the least hashes of their ids; every vector is
    indexed. The driver gets the sample, PROBES queries with their neighbours, and the numbers of entries of
    CENTROIDS**2 cells at most.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where("embedding IS NOT NULL")
    dims = usual_length(rows)
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks() if dims else None
    sample = matrix(picked, dims)[1] if dims else np.zeros((0, 0))
    if not len(sample):
        return spark.createDataFrame([], schema)
    k = min(CENTROIDS, int(np.ceil(per_root * np.sqrt(rows.count()))))
    half = dims // 2
    own = Index(kmeans(sample[:, :half], k), kmeans(sample[:, half:], k), *np.zeros((3, 0), np.int64))
    shared = spark.sparkContext.broadcast(own)

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        good, x = matrix(b.column(1), dims)
        i, j = shared.value.codes(x)
        at = pa.array(good)
        return pa.record_batch([b.column(0).take(at), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), b.column(1).take(at)], ["vec_id", "i", "j", "embedding"])

    kind = rows.schema["embedding"].dataType.simpleString()
    index = stored(map_batches(rows, code, f"vec_id long, i int, j int, embedding {kind}"), "index")
    cells = index.groupBy("i", "j").count().toArrow()
    own.i, own.j, own.n = (cells.column(c).to_numpy().astype(np.int64) for c in range(3))
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"))
    queries = stored(queries, "queries")
    probes = queries.orderBy(F.xxhash64("vec_id", F.lit("probe")), "vec_id").limit(PROBES).toArrow()
    if not probes.num_rows:
        return spark.createDataFrame([], schema)
    probes = probes.column(0).to_numpy(), matrix(probes.column(1).combine_chunks(), dims)[1]
    depth = measured_depth(index, own, probes, top, recall)
    first, many = _pieces(own, spark.sparkContext.defaultParallelism, piece, least_piece)
    told = spark.sparkContext.broadcast((own, first, many))

    def visits(b: pa.RecordBatch) -> pa.RecordBatch:
        own, first, many = told.value
        x = matrix(b.column(1), dims)[1]
        d1, d2 = own.distances(x)
        least = top + b.column(2).to_numpy()  # entries to give `top` others, beside the query's own
        reach = np.array([own.reach(a, c, max(depth, int(n))) for a, c, n in zip(d1, d2, least, strict=True)])
        reach += 1e-9 * (1 + np.abs(reach))  # sums are made once more, in matrices of another shape
        r, i = np.nonzero(d1 + d2.min(axis=1)[:, None] <= reach[:, None])
        n = many[i]
        at = np.unique(np.stack([np.repeat(r, n), np.repeat(first[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())], axis=1), axis=0)
        r, p = at[:, 0], at[:, 1]
        return pa.record_batch([pa.array(p.astype(np.int32)), b.column(0).take(pa.array(r)), pa.array(reach[r]), b.column(1).take(pa.array(r))], ["piece", "id", "reach", "v"])

    walks = max(2 * spark.sparkContext.defaultParallelism, -(-queries.count() // 2048))
    asked = map_batches(queries.repartition(walks), visits, f"piece int, id long, reach double, v {kind}").withColumn("cell", F.lit(None).cast("int"))
    places = spark.createDataFrame(pa.table({"i": pa.array(np.arange(len(first), dtype=np.int32)), "first": pa.array(first), "many": pa.array(many)}))
    # a row for each first centroid, CENTROIDS at most
    entries = index.join(F.broadcast(places), "i").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id", "j", F.lit(7)), F.col("many"))).cast("int").alias("piece"), F.col("vec_id").alias("id"), F.lit(None).cast("double").alias("reach"),
        F.col("embedding").alias("v"), (F.col("i") * len(own.c2) + F.col("j")).alias("cell"),
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value[0]
        now, held, entry = None, [], None

        def answered(b: pa.RecordBatch) -> pa.RecordBatch:
            q_ids, q, reach = b.column(1).to_numpy(), matrix(b.column(3), dims)[1], b.column(2).to_numpy()
            r, named, s = entry.best(q_ids, q, *own.distances(q), reach, top)
            return pa.record_batch([pa.array(q_ids[r]), pa.array(named, mask=named == _NONE), pa.array(s)], ["query_id", "vec_id", "score"])

        for b in batches:  # of each piece: its entries, then the queries
            piece, cell = b.column(0).to_numpy(), b.column(4)
            is_query = cell.is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(piece) | np.diff(is_query)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(piece)], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if piece[lo] != now:
                    now, held, entry = piece[lo], [], None
                if not is_query[lo]:
                    held.append((ids_of(part.column(1)), matrix(part.column(3), dims)[1], part.column(4).to_numpy()))
                    continue
                if entry is None and held:
                    ids, x, c = (np.concatenate(y) for y in zip(*held, strict=True))
                    entry, held = Piece(ids, x, c // len(own.c2), c % len(own.c2)), []
                if entry is not None:
                    yield answered(part)
        give_back()

    tasks = 3 * int((first + many).max())
    meet = entries.unionByName(asked).select("piece", "id", "reach", "v", "cell").repartition(tasks, "piece").sortWithinPartitions("piece", F.col("cell").isNull())
    best = meet.mapInArrow(rank, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


