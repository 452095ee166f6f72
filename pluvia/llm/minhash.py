"""MinHash near-duplicates by tensored banding, with every link confirmed on full shingle sets.

Two collections of sub-keys are made, each sub-key from HALF minhashes of its own. A table's key combines
one sub-key of either collection, so that c sub-keys in each give c**2 tables from 2 * c * HALF minhashes.
A pair at similarity s misses every table with a probability of 2 * (1 - s**HALF)**c at most; c is the least
number that holds this below MISS at the similarity asked for (8 at 0.85, 11 at 0.8).

1. Each text becomes the set of its distinct k-word shingles; texts with equal sets are one class, whatever
   their doc_ids, and are represented by one text. Copies take no part in what follows.
2. Classes that share a table key are candidates. Within a map task they are linked to a local member
   first, so that a key sends one row for each 16,384 classes at most; then to the key's least member.
3. Components of candidates are blocks of work. In a task a class is compared with those that share a
   table with it, unless links have joined the two already, members that agree with the most others
   first; a comparison counts the exact intersection. Only a spanning forest of the confirmed links leaves
   the task. A large component is dealt into pieces of BLOCK classes. Each piece also gets PIVOTS classes,
   those that agree with the most others of their own pieces, which as a rule joins copies of one text in
   a pass over them. What is not in the component's largest part then is compared with all the rest,
   by pairs of pieces, so that no link is lost where pivots do not do. Texts leave the documents once:
   the texts of that pass are written, and the pairs of pieces take theirs from there.
4. Components of confirmed links, over classes, give component_id: the least doc_id of their rows.

Defined results: a null text, or one without a word, has an empty set and is linked with nothing. A text
of fewer than k words is one shingle. Rows that repeat a doc_id are taken one by one, each with its own
text: unrelated texts under one doc_id stay unlinked, and each row gets the component of its own text. A
row without doc_id has its set's size, belongs to the component of its copies' least doc_id (else null), and
is not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import wordscan
from .common import attach, components, give_back, map_batches, runs, small_batches, spare, stored, texts_of

WORDS = 5
LINK = 85  # percent
HALF = 3
MISS = 0.001
BLOCK = 512  # classes in a piece of a large component
PIVOTS = 16
LOCAL = 1 << 14  # classes whose shared keys a map task joins before it sends them

_RNG = np.random.default_rng(1010)
_XOR = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def collections_for(link: int) -> int:
    """Sub-keys in each collection for a similarity of `link` percent."""
    c = 1
    while 2 * (1 - (link / 100) ** HALF) ** c >= MISS:
        c += 1
    if 2 * c * HALF > len(_XOR) or c > 24:
        raise ValueError(f"{link} % is too low a similarity for {HALF} minhashes in a sub-key")
    return c


def shingle_sets(texts: list[bytes], k: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, sorted shingles concatenated, sizes) of runs of neighbouring texts."""
    for lo, hi in runs([len(t) for t in texts], wordscan.PIECE):
        w = wordscan.hash_words([t.lower() for t in texts[lo:hi]])
        values, sizes = wordscan.shingles(w.hashes, w.counts, k)
        yield lo, values, sizes


def sub_keys(values: np.ndarray, sizes: np.ndarray, c: int) -> np.ndarray:
    """2 * c sub-keys of each set (uint64; sets must not be empty)."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), 2 * c), np.uint64)
    for i in range(2 * c * HALF):
        h = values ^ _XOR[i]
        h *= _MUL[i]
        out[:, i // HALF] += np.minimum.reduceat(h, starts) * _ODD[i % HALF]
    return wordscan.mix(out)


def table_keys(sub: np.ndarray) -> np.ndarray:
    """Keys of each row, one of each pair of sub-keys of the two collections; no two tables share a key."""
    c = sub.shape[1] // 2
    a, b = sub[:, :c], sub[:, c:]
    keys = a[:, :, None] * _ODD[:c][None, :, None] + b[:, None, :] * _ODD[32 : 32 + c][None, None, :]
    return wordscan.mix(keys.reshape(len(sub), -1))


def signatures(docs: DataFrame, k: int = WORDS, link: int = LINK, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, h (a hash of the text), the columns `keep`, t (the set's identity, 16 bytes), n (its size), sub
    (sub-keys; empty for an empty set)."""
    c = collections_for(link)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(0))
        distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        n, ident, sub = [], [], []
        for _, values, sizes in shingle_sets(list(distinct), k):
            full = np.flatnonzero(sizes)
            two = np.zeros((len(sizes), 2), np.uint64)
            keys = np.zeros((len(sizes), 2 * c), np.uint64)
            if len(full):
                starts = (np.cumsum(sizes) - sizes)[full]
                two[full, 0] = np.add.reduceat(values * _ODD[60], starts)
                two[full, 1] = np.add.reduceat(wordscan.mix(values ^ _ODD[61]), starts)
                keys[full] = sub_keys(values, sizes[full], c)
            n.append(sizes)
            ident.append(two)
            sub.append(keys)
        at = np.array([distinct[t] for t in texts])
        size, two, keys = np.concatenate(n)[at], np.concatenate(ident)[at], np.concatenate(sub)[at]
        width = np.where(size > 0, keys.shape[1], 0)
        flat = pa.array(keys[size > 0].ravel().view(np.int64))
        subs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), flat)
        idents = pa.Array.from_buffers(pa.binary(16), len(two), [None, pa.py_buffer(np.ascontiguousarray(two))]).cast(pa.binary())
        return pa.record_batch([*b.columns[1:], idents, pa.array(size), subs], [*b.schema.names[1:], "t", "n", "sub"])

    small_batches(docs.sparkSession)
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), *keep)
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in rows.columns[1:])
    return map_batches(rows, run, f"{kinds}, t binary, n long, sub array<long>")


def subs_of(column: pa.Array) -> np.ndarray:
    """Sub-keys by row, of a column without nulls or empty lists."""
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def _local(ids: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, id) that span the given classes by the keys they share.

    Each key has one row, with the least id that has it. An id that is not the least of a key gets a key of
    its own with that one, which no table shares.
    """
    order = np.argsort(ids, kind="stable")
    ids, keys = ids[order], table_keys(sub[order])
    owner = np.repeat(ids, keys.shape[1])
    flat, first, inv = np.unique(keys.ravel(), return_index=True, return_inverse=True)
    least = owner[first]
    pair = owner != least[inv]
    two = np.unique(np.stack([owner[pair], least[inv][pair]], axis=1), axis=0)
    own = wordscan.mix(two[:, 1].astype(np.uint64) ^ _ODD[62])
    return np.concatenate([flat, own, own]).view(np.int64), np.concatenate([least, two[:, 0], two[:, 1]])


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[np.ndarray] = []
    subs: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        key, one = _local(np.concatenate(ids), np.concatenate(subs))
        ids.clear()
        subs.clear()
        return pa.record_batch([pa.array(key), pa.array(one)], ["key", "id"])

    for b in batches:
        ids.append(b.column(0).to_numpy())
        subs.append(subs_of(b.column(1)))
        if sum(map(len, ids)) >= LOCAL:
            yield out()
    if sum(map(len, ids)):
        yield out()
    give_back()


def candidates(classes: DataFrame) -> DataFrame:
    """(u, v): each class and the least one that it shares a key with, in each table; enough to span them.

    A key's rows are one for each LOCAL classes at most: some ten thousand of 16 bytes at 10**8 classes.
    """
    rows = classes.select("id", "sub").mapInArrow(_spanning, "key long, id long")
    least = F.min("id").over(W.partitionBy("key"))
    return rows.select(F.col("id").alias("u"), least.alias("v")).where("u <> v").distinct()


def popularity(sub: np.ndarray) -> np.ndarray:
    """How many sub-keys the others share with each row."""
    out = np.zeros(len(sub), np.int64)
    for c in range(sub.shape[1]):
        _, inv, count = np.unique(sub[:, c], return_inverse=True, return_counts=True)
        out += count[inv]
    return out


def confirmed(ids: np.ndarray, known: np.ndarray, piece: np.ndarray, sets: list[np.ndarray], link: int = LINK) -> list[tuple[int, int]]:
    """Edges (part, least part) of the links among sets that share a table, between pieces if there are two.

    known: the part that each set is known to belong to; at first its own id.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    c = collections_for(link)
    sub = np.concatenate([sub_keys(np.concatenate(sets[a:b]), sizes[a:b], c) for a, b in runs(sizes.tolist(), wordscan.PIECE)])
    a, b = sub[:, :c], sub[:, c:]
    parts, comp = np.unique(known, return_inverse=True)
    later = np.ones(n, bool)
    cross = len(np.unique(piece)) > 1
    left = len(parts)
    for p in np.lexsort((ids, -popularity(sub))).tolist():
        if left == 1:
            break
        later[p] = False
        m = later & (comp != comp[p])
        if cross:
            m &= piece != piece[p]
        q = np.flatnonzero(m)
        q = q[(a[q] == a[p]).any(axis=1) & (b[q] == b[p]).any(axis=1)]
        low, high = np.minimum(sizes[q], sizes[p]), np.maximum(sizes[q], sizes[p])
        for x in q[100 * low >= link * high].tolist():
            if comp[x] == comp[p]:
                continue
            small, large = (sets[x], sets[p]) if sizes[x] <= sizes[p] else (sets[p], sets[x])
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int((large[at] == small).sum())
            if 100 * common >= link * (len(small) + len(large) - common):
                comp[comp == comp[x]] = comp[p]
                left -= 1
    least: dict[int, int] = {}
    pairs = sorted(set(zip(known.tolist(), comp.tolist(), strict=True)))
    for k, c in pairs:
        least.setdefault(c, k)
    return [(k, least[c]) for k, c in pairs if k != least[c]]


def _tasks(k: int, link: int):
    """Rows (task, id, known, piece, text), those of a task together: confirmed links of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, known, pieces, sets = None, [], [], [], []

        def done() -> list[tuple[int, int]]:
            return confirmed(np.array(ids), np.array(known), np.array(pieces), sets, link) if len(ids) > 1 else []

        for b in batches:
            edges: list[tuple[int, int]] = []
            tasks, own, of, part = (b.column(i).to_pylist() for i in range(4))
            for lo, values, sizes in shingle_sets(texts_of(b.column(4)), k):
                for i, s in enumerate(np.split(values, np.cumsum(sizes)[:-1])):
                    if tasks[lo + i] != now:
                        edges += done()
                        now, ids, known, pieces, sets = tasks[lo + i], [], [], [], []
                    if len(s):
                        ids.append(own[lo + i])
                        known.append(of[lo + i])
                        pieces.append(part[lo + i])
                        sets.append(s.copy())
            yield _edges(edges)
        yield _edges(done())
        give_back()

    return run


def _edges(e: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[0] for x in e], pa.int64()), pa.array([x[1] for x in e], pa.int64())], ["u", "v"])


@dataclass(frozen=True)
class Texts:
    """Where the text of a class is found: its row of `docs` by doc_id and the text's hash (`again`: more rows have both)."""

    docs: DataFrame
    classes: DataFrame  # id, doc_id, h, sub
    again: bool
    k: int
    link: int

    def of(self, rows: DataFrame) -> DataFrame:
        """Rows (id, ...) with their texts, by a shuffle of texts by doc_id at every size."""
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
        located = rows.join(self.classes.select("id", "doc_id", "h"), "id").hint("merge")
        found = texts.join(located, ["doc_id", "h"]).select(*rows.columns, "text")
        return found.groupBy(*rows.columns).agg(F.first("text").alias("text")) if self.again else found

    def compared(self, rows: DataFrame) -> DataFrame:
        """Links of rows (task, id, known, piece, text)."""
        rows = rows.select("task", "id", "known", "piece", "text")
        return rows.repartition("task").sortWithinPartitions("task").mapInArrow(_tasks(self.k, self.link), "u long, v long")


def _elected(t: pa.Table) -> pa.Table:
    """The class of a piece that agrees with the most others."""
    ids = t.column("id").to_numpy()
    score = popularity(subs_of(t.column("sub").combine_chunks()))
    k = np.lexsort((ids, -score))[0]
    return pa.table({"component": t.column("component")[:1], "id": pa.array([ids[k]]), "score": pa.array([score[k]])})


def links(texts: Texts, clusters: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, component) of the confirmed links within clusters (id, component) of candidates."""
    piece = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    pieces_of = lambda n: F.ceil(n / block).cast("int")
    sizes = clusters.groupBy("component").agg(pieces_of(F.count(F.lit(1))).alias("pieces"))
    dealt = stored(attach(clusters, "component", sizes, "id").withColumn("piece", piece(F.col("pieces"), 3)), "dealt")
    large = dealt.where("pieces > 1")
    some = not large.isEmpty()
    own = dealt.select("component", "id", "piece", (F.col("pieces") > 1).alias("home"))
    if some:
        best = large.join(texts.classes.select("id", "sub"), "id").groupBy("component", "piece").applyInArrow(_elected, "component long, id long, score long")
        rank = F.row_number().over(W.partitionBy("component").orderBy(F.desc("score"), "id"))
        guests = best.withColumn("_r", rank).where(F.col("_r") <= PIVOTS).join(sizes.where("pieces > 1"), "component")
        others = F.array_remove(F.sequence(F.lit(0), F.col("pieces") - 1), piece(F.col("pieces"), 3))
        own = own.unionByName(guests.select("component", "id", F.explode(others).alias("piece"), F.lit(False).alias("home")))
    own = texts.of(own.select(F.concat_ws(":", "component", "piece").alias("task"), "id", F.col("id").alias("known"), F.lit(0).alias("piece"), "home"))
    if not some:
        return components(texts.compared(own))
    own = stored(own, "members")
    part = components(texts.compared(own))
    part = stored(part, "parts").withColumnRenamed("component", "known")
    rows = large.select("component", "id").join(part, "id", "left").withColumn("known", F.coalesce("known", "id"))
    counts = rows.groupBy("component", "known").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("component").agg(F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("known")).alias("k"))).alias("m"))
    whole = whole.select("component", (-F.col("m.k")).alias("main"), pieces_of(F.col("m.n")).alias("many"), pieces_of(F.col("n") - F.col("m.n")).alias("few")).where("few > 0")
    rows = attach(rows, "component", whole, "id").where("few IS NOT NULL")
    at = F.when(F.col("known") == F.col("main"), -1 - piece(F.col("many"), 5)).otherwise(piece(F.col("few"), 5))
    rows = rows.withColumn("piece", at)
    name = lambda *x: F.concat_ws(":", "component", *x)
    others = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda o: F.when(F.col("piece") < 0, name(o, "piece")).otherwise(name(F.least("piece", o), F.greatest("piece", o))))
    with_main = F.when(F.col("piece") >= 0, F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda o: name("piece", -1 - o))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(F.explode(F.concat(others, with_main)).alias("task"), "id", "known", "piece")
    rows = stored(rows, "rest")
    more = components(texts.compared(own.where("home").select("id", "text").join(rows, "id"))).withColumnRenamed("id", "known")
    # what pairs of pieces have joined are parts; a part alone in a cluster is new as such
    alone = rows.select("known").distinct().select(F.col("known").alias("id"), "known")
    named = part.unionByName(alone.join(part.select("id"), "id", "left_anti"))
    return named.join(more, "known", "left").select("id", F.coalesce("component", "known").alias("component"))


def grouped(docs: DataFrame, k: int = WORDS, link: int = LINK, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, h, the columns `keep`, n, root (a component's number; null for an empty set or where no copy has a
    doc_id), component_id, for every row of `docs`."""
    rows = stored(signatures(docs, k, link, keep), "sets")
    whole = rows.where("n > 0 AND doc_id IS NOT NULL")
    again = not whole.groupBy("doc_id", "h").count().where("count > 1").isEmpty()
    classes = whole.groupBy("t").agg(F.min(F.struct("doc_id", "h")).alias("_r"), F.first("sub").alias("sub"))
    classes = stored(classes.select("t", F.monotonically_increasing_id().alias("id"), "_r.doc_id", "_r.h", "sub"), "classes")
    clusters = stored(components(candidates(classes)), "clusters")
    found = stored(links(Texts(docs, classes, again, k, link), clusters), "links").select("id", F.col("component").alias("root"))
    of = classes.select("t", "id", "doc_id").join(found, "id", "left").select("t", F.coalesce("root", "id").alias("root"), "doc_id")
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = attach(of.drop("doc_id"), "root", least, "t")
    out = attach(rows.drop("sub"), "t", of, "doc_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", *keep, "n", "root", component.alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = WORDS, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`; sets are linked from `link` percent on."""
    out = grouped(docs, k, link).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, k: int = WORDS, link: int = LINK) -> DataFrame:
    """The rows of `docs` that stay, whole: one of each group of linked texts.

    The first row of a group stays, in order of doc_id, then the smaller set, then hashes of the text and of
    the whole row, so that reruns agree; of rows that are equal in every column one stays. Rows without a
    word stay, one for each doc_id (a null text before an empty one). Rows without doc_id stay.
    """
    key, text_hash, row_hash = spare(docs, "_key", "_text", "_row")
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), text_hash: F.xxhash64("text"), row_hash: F.xxhash64(*docs.columns)})
    rows = grouped(marked.withColumn("doc_id", F.col(key)), k, link, (row_hash,)).where("doc_id IS NOT NULL")
    rows = stored(rows.drop("component_id"), "rows")
    name = F.struct(F.col("doc_id").alias(key), F.col("h").alias(text_hash), row_hash).alias("_row")
    some = F.col("h") != F.xxhash64(F.lit(None).cast("string"))
    first = rows.where("n > 0").groupBy("root").agg(F.min_by(name, F.struct("doc_id", "n", "h", row_hash)).alias("_r"))
    empty = rows.where("n = 0").groupBy("doc_id").agg(F.min_by(name, F.struct(some, "h", row_hash)).alias("_r"))
    stay = first.select("_r.*").unionByName(empty.select("_r.*"))
    out = marked.join(stay, [key, text_hash, row_hash], "left_semi")
    equal = rows.groupBy("doc_id", "h", row_hash).count().where("count > 1")
    if not equal.isEmpty():
        at = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole")
        out = out.groupBy(key, text_hash, row_hash).agg(F.first(at).alias("_whole")).select("_whole.*")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where("doc_id IS NULL"))
