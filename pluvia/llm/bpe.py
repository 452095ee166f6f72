"""BPE encoding and decoding for a word-level tokenizer file, with contiguous rank arrays.

A text is cut at white space; each piece is normalised, cut by the file's pattern and mapped to byte
symbols. Short words are merged many at a time: a row holds the parts of a word next to each other and a
second array the rank of each neighbouring pair. The least rank of each row is found by a scan, the
boundary is deleted by closing the gap, and only the two neighbouring ranks are looked up again. Words of
more than SHORT parts are merged one at a time by the same ranks. Pieces are cached with their ids in two
generations of CACHE / 2 bytes: when the younger one is full it becomes the older one, and what is used
again moves back. A task drops its cache when it ends. The tokenizer file is read on the driver and goes to
the tasks as bytes.

Defined results: a null text is empty and gives no tokens, and the digest of the empty string. Special
tokens that stand in a text become their ids, as the file says. Repeated rows get equal results.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import give_back, runs, small_batches

SHORT = 48  # parts; longer words go one at a time
CACHE = 48 << 20  # bytes, about
ENTRY = 180  # bytes of a cached piece beside its text and ids
GROUP = 1 << 19  # characters encoded at once
NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


# Letters and numbers of Unicode 16, and lower case of Unicode 16 and 17, that the tokenizers
# library knows and unicodedata (15.1) does not.
LETTERS_16 = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
NUMBERS_16 = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
LOWER_17 = "1c89>1c8a a7cb>264 a7cc>a7cd a7ce>a7cf a7d2>a7d3 a7d4>a7d5 a7da>a7db a7dc>19b"
LOWER_17_RUNS = "10d50-10d65>10d70 16ea0-16eb8>16ebb"


def _ranges(text: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b, 16)) for a, b in (x.split("-") for x in text.split())]


def _lower_17() -> dict[int, int]:
    out = {int(a, 16): int(b, 16) for a, b in (x.split(">") for x in LOWER_17.split())}
    for x in LOWER_17_RUNS.split():
        span, to = x.split(">")
        ((a, b),) = _ranges(span)
        out |= {c: int(to, 16) + c - a for c in range(a, b + 1)}
    return out | {ord("Σ"): ord("σ")}  # no final form


def _listed(chars: Iterable[int]) -> str:
    """Code points as ranges of a character class."""
    ranges: list[list[int]] = []
    for c in sorted(chars):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def plain_pattern(pattern: str) -> str:
    """The file's pattern for the re module: letters, numbers and white space inside its classes are listed.

    They are those of Unicode 16, the library's version; letters and numbers of later ones don't count.
    """
    if re.search(r"\\[pPsSdDwW]", re.sub(r"\[[^\]]*\]", "", pattern)):
        raise ValueError(f"classes are expected in brackets: {pattern}")
    known = {c for a, b in _ranges(LETTERS_16 + " " + NUMBERS_16) for c in range(a, b + 1)}
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        chars = map(ord, regex.findall(name, everything))
        listed = _listed(c for c in chars if name == r"\s" or c in known or unicodedata.category(chr(c)) != "Cn")
        pattern = pattern.replace(name, listed)
    return pattern


def _table(names: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all names, each with a space after it; starts; lengths) by id."""
    parts = [names.get(i, "").encode("utf-8") + b" " for i in range(max(names) + 1)]
    lens = np.array(list(map(len, parts)))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens


class Vocabulary:
    """Ids, merges and pattern of a tokenizer file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.digits, self.shown = (_table({i: f(i) for i in self.names}) for f in (str, self.names.__getitem__))
        self.suffix = model["end_of_word_suffix"] or ""
        # words of many pieces at once; a line end, which no word holds, stands between pieces
        self.pattern = re.compile(plain_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) + r"|\n")
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        symbols = byte_symbols()
        self.inner = np.array([self.ids[s] for s in symbols], np.int32)
        self.last = np.array([self.ids[s + self.suffix] for s in symbols], np.int32)
        pairs, merged = [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.append(self.ids[a] << 32 | self.ids[b])
            merged.append(self.ids[a + b])
        # open addressing: twice the pairs' number of places at least, linear probing
        self.bits = int(4 * len(pairs)).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        self.into = np.array(merged, np.int32)
        self.probes = 1
        for r, key in enumerate(pairs):
            at, n = int(self._place(np.array([key], np.int64))[0]), 1
            while self.keys[at] not in (-1, key):
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            if self.keys[at] != key:
                self.keys[at], self.rank[at] = key, r
            self.probes = max(self.probes, n)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where there is no such merge."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = self._place(keys)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.arange(keys.size)
        for _ in range(self.probes):
            here = self.keys[at]
            same = here == keys
            out[todo[same]] = self.rank[at[same]]
            go = ~same & (here != -1)
            if not go.any():
                break
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


@functools.lru_cache(maxsize=2)
def of_content(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def vocabulary(path: str) -> Vocabulary:
    return of_content(Path(path).read_bytes())


def merge_block(v: Vocabulary, parts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges rows of parts (n of each row count) as far as ranks allow: the same, merged."""
    rows, width = parts.shape
    parts, n = parts.copy(), n.copy()
    rank = np.full((rows, max(1, width - 1)), NONE, np.int32)
    pair = np.arange(width - 1)[None, :] < (n - 1)[:, None]
    if width > 1 and pair.any():
        rank[pair] = v.ranks(parts[:, :-1][pair], parts[:, 1:][pair])
    live = np.arange(rows)
    while len(live) and width > 1:
        sub = rank[live]
        at = sub.argmin(axis=1)
        best = sub[np.arange(len(live)), at]
        keep = best != NONE
        live, at, best = live[keep], at[keep], best[keep]
        if not len(live):
            break
        top = int(n[live].max())
        p, r = parts[live, :top], rank[live, : top - 1]
        i = np.arange(len(live))
        p[i, at] = v.into[best]
        cols = np.arange(top - 1)[None, :]
        p[:, :-1] = np.where(cols > at[:, None], p[:, 1:], p[:, :-1])
        if top > 2:
            r[:, :-1] = np.where(cols[:, :-1] >= at[:, None], r[:, 1:], r[:, :-1])
        r[:, -1] = NONE
        m = n[live] - 1
        n[live] = m
        r[i[at >= m - 1], at[at >= m - 1]] = NONE
        left, right = at > 0, at < m - 1
        if left.any():
            r[i[left], at[left] - 1] = v.ranks(p[i[left], at[left] - 1], p[i[left], at[left]])
        if right.any():
            r[i[right], at[right]] = v.ranks(p[i[right], at[right]], p[i[right], at[right] + 1])
        parts[live, :top], rank[live, : top - 1] = p, r
    return parts, n


def merge_long(v: Vocabulary, parts: np.ndarray) -> list[int]:
    """One long word: the same merges, all places of the least rank that do not overlap at once."""
    p = parts.astype(np.int32)
    while len(p) > 1:
        r = v.ranks(p[:-1], p[1:])
        best = r.min()
        if best == NONE:
            break
        hit = np.flatnonzero(r == best)
        if len(hit) > 1 and (np.diff(hit) == 1).any():  # a run of equal neighbours merges from its left
            taken, prev = [], -2
            for h in hit.tolist():
                if h - prev > 1:
                    taken.append(h)
                    prev = h
            hit = np.array(taken)
        p[hit] = v.into[best]
        p = np.delete(p, hit + 1)
    return p.tolist()


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each of many runs, one after another."""
    ends = np.cumsum(lens)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(starts - (ends - lens), lens)
    return out


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, number of ids of each) of words (one match of the pattern each)."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    buf = np.frombuffer("\n".join(words).encode("utf-8") + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    sizes = np.diff(ends, prepend=-1) - 1
    at = ends - sizes
    parts_of: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo, hi in ((1, 8), (9, 16), (17, 32), (33, SHORT)):
        pick = np.flatnonzero((sizes >= lo) & (sizes <= hi))
        for s in range(0, len(pick), 20_000):
            some = pick[s : s + 20_000]
            n = sizes[some]
            raw = buf[np.minimum(at[some][:, None] + np.arange(int(n.max())), len(buf) - 1)]
            parts = v.inner[raw]
            rows = np.arange(len(some))
            parts[rows, n - 1] = v.last[raw[rows, n - 1]]
            merged, n = merge_block(v, parts, n)
            parts_of.append((some, merged[np.arange(merged.shape[1]) < n[:, None]], n))
    for i in np.flatnonzero(sizes > SHORT).tolist():
        raw = buf[at[i] : ends[i]]
        parts = v.inner[raw]
        parts[-1] = v.last[raw[-1]]
        ids = merge_long(v, parts)
        parts_of.append((np.array([i]), np.array(ids, np.int32), np.array([len(ids)])))
    lens = np.zeros(len(words), np.int64)
    for some, _, n in parts_of:
        lens[some] = n
    starts = np.cumsum(lens) - lens
    out = np.empty(int(lens.sum()), np.int32)
    for some, ids, n in parts_of:
        out[spread(starts[some], n)] = ids
    return out, lens


#: Control characters that str.split() cuts at though the file's white space leaves them out.
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile("[" + _listed(c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F) + "]+")


_LOWER = _lower_17()
_IN_LOWER = re.compile("[" + "".join(map(chr, sorted(_LOWER))) + "]")


def normal(text: str) -> str:
    """Composed and in lower case, as the file says."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.translate(_LOWER) if _IN_LOWER.search(text) else text).lower()


class Store:
    """Ids of pieces, one after another, and where those of each piece lie."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def add(self, pieces: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.lens), len(self.lens) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
        self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])
        self.held += ENTRY * len(pieces) + sum(map(len, pieces)) + 4 * len(ids)

    def find(self, pieces: Iterable[str], count: int) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, count)

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of each)."""
        lens = self.lens[places]
        return self.ids[spread(self.starts[places], lens)], lens


class Encoder:
    """Encodes texts, and keeps the ids of pieces of text, which white space bounds."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.young, self.old = Store(), Store()

    def forget(self) -> None:
        self.young, self.old = Store(), Store()

    def split(self, text: str) -> list[str]:
        """Pieces without white space; a special token that stands in the text is a piece after a line end."""
        if "<|" in text:
            out, at = [], 0
            for m in self.v.specials.finditer(text):
                out += [*self.split_plain(text[at : m.start()]), "\n" + m[0]]
                at = m.end()
            return out + self.split_plain(text[at:])
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        return [p for p in _SPACE.split(text) if p] if _ODD_SPACE.search(text) else text.split()

    def _learn(self, pieces: list[str]) -> None:
        """Adds pieces to the young store, and the words they consist of."""
        marks = [p for p in pieces if p[0] == "\n"]
        if marks:
            self.young.add(marks, np.array([self.v.special[p[1:]] for p in marks], np.int32), np.ones(len(marks), np.int64))
            pieces = [p for p in pieces if p[0] != "\n"]
        place = self.young.place
        plain, other = [p for p in pieces if p.isascii()], [p for p in pieces if not p.isascii()]
        for some in (plain, other):
            if not some:
                continue
            found = self.v.pattern.findall(normal("\n".join(some)) + "\n")
            words = list(set(found) - place.keys() - {"\n"})
            self.young.add(words, *encode_words(self.v, words))
            end = np.array([w == "\n" for w in found])
            ids, lens = self.young.take(self.young.find([w for w in found if w != "\n"], int((~end).sum())))
            owner = (np.cumsum(end) - end)[~end]
            n = np.bincount(owner, weights=lens, minlength=len(some)).astype(np.int64)
            new = np.array([p not in place for p in some])
            if new.all():
                self.young.add(some, ids, n)
            elif new.any():
                self.young.add([p for p, x in zip(some, new.tolist(), strict=True) if x], ids[np.repeat(new, n)], n[new])

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of each text's) of texts of about GROUP characters together."""
        if self.young.held > CACHE // 2:
            self.young, self.old = Store(), self.young
        cut = [self.split(t) for t in texts]
        rest = set().union(*cut) - self.young.place.keys()
        again = list(rest & self.old.place.keys())
        if again:
            self.young.add(again, *self.old.take(self.old.find(again, len(again))))
        rest.difference_update(again)
        if rest:
            self._learn(list(rest))
        n = np.array(list(map(len, cut)))
        ids, lens = self.young.take(self.young.find(itertools.chain.from_iterable(cut), int(n.sum())))
        return ids, np.bincount(np.repeat(np.arange(len(n)), n), weights=lens, minlength=len(n)).astype(np.int64)

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As `_tokens`, of runs of neighbouring texts."""
        for lo, hi in runs([len(t) for t in texts], GROUP):
            yield self._tokens(texts[lo:hi])

    def encode(self, texts: list[str]) -> list[tuple[bytes, int, bytes]]:
        """(ids joined by spaces, number of ids, the decoded text) of each text."""
        out = []
        for ids, n in self.tokens(texts):
            cuts = np.cumsum(n)
            joined = []
            for flat, starts, lens in (self.v.digits, self.v.shown):
                size = lens[ids]
                ends = np.concatenate([[0], np.cumsum(size)])
                joined.append((flat[spread(starts[ids], size)].tobytes(), ends[cuts - n].tolist(), ends[cuts].tolist()))
            (d, d0, d1), (t, t0, t1) = joined
            out += [(d[a : b - 1] if k else b"", k, t[x : y - 1] if k else b"") for k, a, b, x, y in zip(n.tolist(), d0, d1, t0, t1, strict=True)]
        return out


def decode(path: str, ids: list[int]) -> str:
    """The tokens' own strings, joined by spaces: the file names no decoder."""
    v = vocabulary(path)
    return " ".join(v.names[i] for i in ids)


def _encoded(docs: DataFrame, path: str, columns: Callable[[Encoder, list[str]], list[pa.Array]], names: list[str], schema: str) -> DataFrame:
    """doc_id and columns made from the texts of each batch."""
    small_batches(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = None
        for b in batches:
            if b.num_rows:
                e = e or Encoder(of_content(content.value))
                yield pa.record_batch([b.column(0), *columns(e, [t or "" for t in b.column(1).to_pylist()])], ["doc_id", *names])
        if e:
            e.forget()
        give_back()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of each row; the operator's output for training."""

    def columns(e: Encoder, texts: list[str]) -> list[pa.Array]:
        found = list(e.tokens(texts))
        ids, n = (np.concatenate(x) for x in zip(*found, strict=True))
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))]

    return _encoded(docs, path, columns, ["ids"], "ids array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""

    def columns(e: Encoder, texts: list[str]) -> list[pa.Array]:
        got = e.encode(texts)
        sha = [pa.array([hashlib.sha256(g[k]).hexdigest() for g in got], pa.string()) for k in (0, 2)]
        return [pa.array([g[1] for g in got], pa.int64()), *sha]

    return _encoded(docs, path, columns, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string")
