"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into the phrases of LZ78: each is the longest one met before, and one more character. The
distinct phrases' hashes are the text's set, and its fingerprint is the K least of them (all, if there are
fewer). Two sets' similarity (intersection over union) is estimated from the K least hashes of their union,
all of which the two fingerprints hold. Texts that compress one another share phrases.

An edited text begins like its own one, whose parse is taken back to the end of what both share and goes on from there.

A text is parsed in pieces of PIECE characters that begin where a phrase begins. The dictionary starts anew
after DICTIONARY phrases, so that a task's memory is bounded for texts of any length; what was found before stays
in the set. Both are fixed, so that a fingerprint depends on the text alone.

`neighbours` compares each document with the next one of a total order, without ordering them in one
task: bounds are keys of existing rows, from a bounded sample, so that each range of keys begins with a
known row; that row also goes, as a look ahead, to the range before its own. Whole texts are shuffled once.

Defined results: a null text is empty. Without a character the fingerprint is empty; two empty ones
have likeness 1, an empty and another one 0. Documents are ordered by falling doc_id, null last, then by a hash
of the text; rows with the same of both are equal, and follow one another. The only document is its own next one.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches, small_batches
from .wordscan import _up_to, mix

K = 128
PIECE = 1 << 20
DICTIONARY = 1 << 17
SAMPLE = 1 << 15
RANGE_CHARS = 1 << 24
RANGES = 20_000

Sketch = np.ndarray


def phrase_ends(text: str, root: dict, left: int, last: bool, log: list[tuple[dict, str]] | None = None) -> tuple[list[int], dict, int]:
    """(ends of the phrases, the dictionary, how many more phrases it takes), from a phrase's beginning on.

    Without `last` the text goes on, and a phrase that it breaks is left for the next piece. log: takes what the
    dictionary gets, so that it can be taken back.
    """
    node, ends = root, []
    add = ends.append
    for i, ch in enumerate(text, 1):
        deeper = node.get(ch)
        if deeper is not None:
            node = deeper
            continue
        node[ch] = {}
        if log is not None:
            log.append((node, ch))
        add(i)
        left -= 1
        if not left:
            root, left = {}, DICTIONARY
        node = root
    if last and text and (not ends or ends[-1] < len(text)):
        add(len(text))
    return ends, root, left


def _hashes(text: str, ends: list[int]) -> np.ndarray:
    """32 bits for each phrase."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = _up_to(max(len(codes) + 1, PIECE + 4096))
    run = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[: len(codes)], out=run[1:])
    e = np.array(ends, np.int64)
    s = np.concatenate([[0], e[:-1]])
    return (mix((run[e] - run[s]) * down[s]) >> np.uint64(32)).astype(np.uint32)


def sketch(text: str, k: int = K) -> Sketch:
    """The k least hashes of the text's phrases, in order."""
    out, at, root, left = np.zeros(0, np.uint32), 0, {}, DICTIONARY
    while at < len(text):
        part = text[at : at + PIECE]
        last = at + len(part) == len(text)
        ends, root, left = phrase_ends(part, root, left, last)
        out = _least(np.concatenate([out, _hashes(part, ends)]), k)
        at += ends[-1]
    return out


def _least(hashes: np.ndarray, k: int) -> Sketch:
    """The k least of the hashes, each once, in order."""
    h = np.sort(hashes)
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new][:k]


@dataclass
class Parsed:
    """A text's sketch, and what a text with the same beginning need not parse again; without `root` that is nothing."""

    sketch: Sketch
    root: dict | None = None
    left: int = 0
    at: int = 0  # where the first phrase that is not in `root` begins
    hashes: np.ndarray | None = None  # of the phrases before


def parsed(text: str, begin: int, k: int = K) -> Parsed:
    """The text's sketch, with its phrases within the first `begin` characters kept.

    A text that may fill a dictionary, or that has several pieces, keeps none.
    """
    if not text or len(text) > min(PIECE, DICTIONARY - 1):
        return Parsed(sketch(text, k))
    ends, root, left = phrase_ends(text[:begin], {}, DICTIONARY, False)
    at = ends[-1] if ends else 0
    log: list[tuple[dict, str]] = []
    more = phrase_ends(text[at:], root, left, True, log)[0]
    hashes = _hashes(text, ends + [at + e for e in more])
    for node, ch in reversed(log):
        del node[ch]
    return Parsed(_least(hashes, k), root, left, at, hashes[: len(ends)])


def sketch_from(p: Parsed, text: str, k: int = K) -> Sketch:
    """The sketch of a text that begins like that of `p`, which is used up."""
    if p.root is None or len(text) > min(PIECE, DICTIONARY - 1):
        return sketch(text, k)
    rest = text[p.at :]
    ends = phrase_ends(rest, p.root, p.left, True)[0]
    p.root = None
    return _least(np.concatenate([p.hashes, _hashes(rest, ends)]) if rest else p.hashes, k)


def likeness(a: Sketch, b: Sketch, k: int = K) -> float:
    """Estimated similarity of two sets of phrases: of the k least hashes of their union, the share that both have."""
    h = np.sort(np.concatenate([a, b]))
    if not len(h):
        return 1.0
    both = h[1:] == h[:-1]  # a sketch has each hash once
    union = min(k, len(h) - int(both.sum()))
    # the union's i-th hash stands i places and as many as have come twice before it from the start
    rank = np.arange(len(h) - 1) - np.cumsum(both) + both
    return float((both & (rank < union)).sum()) / union


def written(s: Sketch) -> str:
    """A fingerprint: eight hexadecimal digits for each hash."""
    return s.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> Sketch:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def _quietly(fn):
    """fn without the collector of cycles: a dictionary of phrases has many objects and no cycles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = gc.isenabled()
        gc.disable()
        try:
            yield from fn(batches)
        finally:
            if on:
                gc.enable()
            give_back()

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column(0), pa.array([written(sketch(t or "", k)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def spliced(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one, as many characters or all there are."""
    return text[: _kept(text)] + following[: len(text) // 2]


def _kept(text: str) -> int:
    """Characters at the beginning of a text that `spliced` keeps."""
    return len(text) - len(text) // 2


def _bounds(rows: DataFrame, parallel: int, range_chars: int) -> list[tuple[bool, int, int]]:
    """Keys (null, ~doc_id, hash) at which ranges begin, in order, all of them keys of rows; the first is the first of all.

    The driver gets SAMPLE keys or so, and RANGES bounds at most; they decide where a row is worked on, not its result.
    """
    total = rows.count()
    if not total:
        return []
    top = rows.agg(F.max("doc_id")).first()[0]
    first = rows.where(F.col("doc_id").isNull() if top is None else F.col("doc_id") == top).agg(F.min("h")).first()[0]
    some = rows.sample(fraction=min(1.0, SAMPLE / total), seed=12).select("doc_id", "h", F.coalesce(F.length("text"), F.lit(0)).cast("long")).toArrow()
    keys = sorted((d is None, ~(d or 0), h, n) for d, h, n in zip(*(c.to_pylist() for c in some.columns), strict=True))
    chars = np.cumsum([n + 1 for *_, n in keys])
    ranges = min(RANGES, max(2 * parallel, int(chars[-1] / len(keys) * total) // range_chars)) if keys else 1
    at = np.unique(np.searchsorted(chars, chars[-1] * np.arange(1, ranges) / ranges)) if keys else []
    return sorted({(top is None, ~(top or 0), first), *(keys[i][:3] for i in at)})


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, k: int = K, range_chars: int = RANGE_CHARS) -> DataFrame:
    """For every document: fingerprints of its text and of the text spliced with the next document's, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    bounds = _bounds(rows, spark.sparkContext.defaultParallelism, range_chars)
    if not bounds:
        return spark.createDataFrame([], OUT)
    shared = spark.sparkContext.broadcast(bounds)
    names = ["range", "ahead", "doc_id", "h", "text"]

    def deal(b: pa.RecordBatch) -> pa.Table:
        bounds = shared.value
        keys = [(d is None, ~(d or 0), h) for d, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
        at = [bisect.bisect_right(bounds, x) - 1 for x in keys]
        begins = [i for i, (x, r) in enumerate(zip(keys, at, strict=True)) if bounds[r] == x]
        own = pa.table([pa.array(at, pa.int32()), pa.array([False] * len(at)), b.column(0), b.column(2), b.column(1)], names)
        some = own.take(pa.array(begins, pa.int64()))
        before = pa.array([(at[i] - 1) % len(bounds) for i in begins], pa.int32())
        return pa.concat_tables([own, pa.table([before, pa.array([True] * len(begins), pa.bool_()), *some.columns[2:]], names)])

    dealt = map_batches(rows.select("doc_id", "text", "h"), deal, "range int, ahead boolean, doc_id long, h long, text string")
    meet = dealt.repartitionById(len(bounds), "range").sortWithinPartitions("range", "ahead", F.col("doc_id").desc_nulls_last(), "h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str, Parsed] | None = None
        now = copies = None
        for b in batches:
            out: list[tuple] = []
            for r, ahead, doc_id, text in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True):
                if r != now:
                    now, held = r, None
                elif held is None:  # a further copy of the look ahead
                    continue
                same = held is not None and held[1] == text
                new = held[2] if same else parsed(text, _kept(text), k)
                if held:
                    mine, whole, own = held
                    if not same:
                        copies = None
                    if copies is None:
                        edited = spliced(whole, text)
                        # what a copy was parsed for may be used up; the sketch is there
                        other = own.sketch if edited == whole else sketch_from(own, edited, k)
                        result = (len(whole), hashlib.sha256(edited.encode()).hexdigest(), written(own.sketch), written(other), likeness(own.sketch, other, k), likeness(own.sketch, new.sketch, k))
                        copies = result if same else None
                    else:
                        result = copies
                    out.append((mine, *result))
                held = None if ahead else (doc_id, text, new)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], _NAMES)

    return meet.mapInArrow(_quietly(compare), OUT)


_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [f.split()[0] for f in OUT.split(", ")]
