"""Words `[^\\x20\\x09-\\x0D]+` of many texts at once, and 64-bit hashes of them, in numpy.

A text's words are found from a mask of white space, and hashed by differences of a running polynomial
over random byte values, so that no word becomes a Python object. Whole texts are scanned, in pieces of
PIECE bytes that end at white space.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np

PIECE = 1 << 20
_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, PIECE + 4096)
        for i, r in enumerate((_R, _R_INV)):
            p = np.full(n, r, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


@dataclass
class Words:
    """hashes: of all words, in order. counts: words of each text. buf, starts, ends: only of a single piece."""

    hashes: np.ndarray
    counts: np.ndarray
    buf: np.ndarray | None = None
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def scan(texts: list[bytes]) -> Words:
    """Words of texts that together are about PIECE bytes."""
    buf = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    word = ~SPACE[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, at))
    if not len(starts):
        return Words(np.zeros(0, np.uint64), counts, buf, starts, ends)
    up, down = _up_to(len(buf) + 1)
    run = np.empty(len(buf) + 1, np.uint64)
    run[0] = 0
    np.cumsum(VALUES[buf] * up[: len(buf)], out=run[1:])
    h = mix((run[ends] - run[starts]) * down[starts])
    return Words(h, counts, buf, starts, ends)


def split_long(text: bytes, size: int = PIECE) -> list[bytes]:
    """Pieces of a text that end before white space, of `size` bytes where white space allows it."""
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        space = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8, size, at)])
        if len(space) and space[-1] > 0:
            cut = at + int(space[-1])
        else:
            more = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8, -1, cut)])
            if not len(more):
                break
            cut += int(more[0])
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def hash_words(texts: list[bytes]) -> Words:
    """Hashes and counts for any texts."""
    hashes, counts = [], []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            w = scan(group)
            hashes.append(w.hashes)
            counts.append(w.counts)
            group.clear()
            size = 0

    for t in texts:
        if len(t) > PIECE:
            flush()
            parts = [scan([p]) for p in split_long(t)]
            hashes += [p.hashes for p in parts]
            counts.append(np.array([sum(int(p.counts[0]) for p in parts)]))
            continue
        if size + len(t) > PIECE:
            flush()
        group.append(t)
        size += len(t) + 1
    flush()
    return Words(np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(counts or [np.zeros(0, np.int64)]).astype(np.int64))


_WEIGHTS = np.random.default_rng(77).integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, concatenated, and their number by text.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    n = len(hashes)
    ends = np.cumsum(counts)
    text_of = np.repeat(np.arange(len(counts)), counts)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        full += hashes[j : j + len(full)] * _WEIGHTS[j]
    at = np.arange(len(full))
    inside = at + k <= ends[text_of[: len(full)]] if len(full) else np.zeros(0, bool)
    values, owners = mix(full[inside]), text_of[: len(full)][inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, t in enumerate(short):
            own = hashes[ends[t] - counts[t] : ends[t]]
            extra[i] = (own * _WEIGHTS[: len(own)]).sum(dtype=np.uint64) ^ _WEIGHTS[-len(own)]
        owners = np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        values, owners = np.concatenate([values, mix(extra)])[order], owners[order]
    for a, b in itertools.pairwise(np.searchsorted(owners, np.arange(len(counts) + 1)).tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[new], np.bincount(owners[new], minlength=len(counts)).astype(np.int64)
