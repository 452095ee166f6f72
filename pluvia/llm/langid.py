"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from its letters' vectors, permuted by
position (rolled by two, one and no places) and multiplied; a text is the bundle (sum) of its trigrams; a
language's prototype is the bundle of its training texts. A text gets the language whose prototype has the
highest cosine with it.

Defined results: a text that is null or without a letter is ``und`` with score 0, as is every text if
nothing can be learned from. Texts of any length are bundled whole, in pieces whose borders do not show. Ties go to the language that sorts first. Rows are scored one by one, so
repeated rows get equal results, and a row without doc_id is scored but never learned from. Columns other
than the named ones are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_batches, runs, small_batches

DIMS = 512
SEED = 11
UNDETERMINED = "und"
LANGUAGES = 4096
_GROUP = 1 << 20  # characters counted at once
_CELLS = 1 << 23  # cells of a table of counts


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=1 << 16)
def _letter_vector(code: int, dims: int, seed: int) -> np.ndarray:
    return (np.random.default_rng([seed, code]).integers(0, 2, dims, dtype=np.int8) * 2 - 1).astype(np.float32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters' code points by row, text index, trigram's row) of all trigrams; runs of other characters count as one space."""
    codes = np.frombuffer((" " + " ".join(texts) + " ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    lowered = [len(t) if t.isascii() else len(t.lower()) for t in texts]
    at = np.cumsum([1, *(n + 1 for n in lowered)])
    codes = np.where(_letters()[codes], codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    place = np.flatnonzero(keep)
    codes = codes[place]
    alphabet = np.flatnonzero(np.bincount(codes))
    a = len(alphabet)
    index = np.zeros(alphabet[-1] + 1, np.int64)
    index[alphabet] = np.arange(a)
    sym = index[codes]
    code = (sym[:-2] * a + sym[1:-1]) * a + sym[2:]
    mid = codes[1:-1] != 0
    code, where = code[mid], place[1:-1][mid]
    if a**3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(code, minlength=a**3))
        index = np.zeros(a**3, np.int64)
        index[used] = np.arange(len(used))
        rows = index[code]
    else:
        used, rows = np.unique(code, return_inverse=True)
    parts = np.stack([alphabet[used // (a * a)], alphabet[used // a % a], alphabet[used % a]], axis=1) if len(used) else np.zeros((0, 3), np.uint32)
    return parts, np.searchsorted(at, where, "right") - 1, rows


def ngram_vectors(parts: np.ndarray, dims: int, seed: int) -> np.ndarray:
    alphabet, inv = np.unique(parts, return_inverse=True)
    v = np.stack([_letter_vector(int(c), dims, seed) for c in alphabet])
    inv = inv.reshape(parts.shape)
    return np.roll(v, 2, axis=1)[inv[:, 0]] * np.roll(v, 1, axis=1)[inv[:, 1]] * v[inv[:, 2]]


def _pieces(text: str) -> list[tuple[str, int]]:
    """Pieces of a text with signs, whose trigrams sum to the text's.

    Where a text is cut, each side takes the border for a space. The four characters around it add the trigrams
    over the border, and its two halves, with a negative sign, take away those with that space.
    """
    if len(text) <= _GROUP:
        return [(text, 1)]
    text = text.lower()  # before it is cut: a final sigma depends on what follows
    out = [(text[a : a + _GROUP], 1) for a in range(0, len(text), _GROUP)]
    for c in range(_GROUP, len(text), _GROUP):
        out += [(text[c - 2 : c + 2], 1), (text[c - 2 : c], -1), (text[c : c + 2], -1)]
    return out


def bundle(texts: list[str], dims: int, seed: int, groups: np.ndarray | None = None) -> np.ndarray:
    """A vector for each text, or for each group of texts if `groups` gives their numbers from 0."""
    n = len(texts) if groups is None else int(groups.max()) + 1
    out = np.zeros((n, dims), np.float64)
    pieces = [(i, *x) for i, t in enumerate(texts) for x in _pieces(t)]
    for lo, hi in runs([len(t) for _, t, _ in pieces], _GROUP):
        owner = np.array([i for i, *_ in pieces[lo:hi]])
        owner = owner if groups is None else groups[owner]
        sign = np.array([x for *_, x in pieces[lo:hi]])
        parts, text, row = trigrams([t for _, t, _ in pieces[lo:hi]])
        if not len(parts):
            continue
        step = max(1, _CELLS // max(dims, n))
        targets = np.unique(owner)
        who = np.searchsorted(targets, owner)[text]
        for s in range(0, len(parts), step):
            m = (row >= s) & (row < s + step) if len(parts) > step else slice(None)
            vec = ngram_vectors(parts[s : s + step], dims, seed)
            weights = None if (sign > 0).all() else sign[text[m]]
            counts = np.bincount(who[m] * len(vec) + row[m] - s, weights, minlength=len(targets) * len(vec)).reshape(len(targets), -1)
            out[targets] += counts.astype(np.float32) @ vec
    return out


def learn(docs: DataFrame, where, text: str = "text", lang: str = "lang", dims: int = DIMS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes by language, from the rows for which `where` holds.

    What comes to the driver is one vector for each language; more than LANGUAGES of them are an error.
    Vectors have whole-number parts, so that the order of summation does not matter.
    """
    if docs.where(where & F.col(lang).isNotNull()).select(lang).distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in {lang}")

    def sums(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, groups = np.unique(np.array(b.column(1).to_pylist(), object).astype(str), return_inverse=True)
        v = bundle(b.column(0).to_pylist(), dims, seed, groups)
        return pa.record_batch([pa.array(langs.tolist()), pa.array(v.tolist(), pa.list_(pa.float64()))], ["l", "v"])

    small_batches(docs.sparkSession)
    rows = docs.where(where & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    parts = map_batches(rows, sums, "l string, v array<double>").select("l", F.posexplode("v").alias("i", "x"))
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("l", "i").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["l"], np.zeros(dims))[r["i"]] = r["x"]
    return {k: v for k, v in found.items() if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 at least)."""
    names = sorted(prototypes)
    unit = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, 1))

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in b.column(1).to_pylist()]
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if names:
            v = bundle(texts, unit.shape[1], seed)
            norm = np.linalg.norm(v, axis=1)
            lettered = np.array([any(map(str.isalpha, t)) for t in texts])
            cos = v @ unit.T / np.maximum(norm, 1e-300)[:, None]
            best = cos.argmax(axis=1)
            langs = [names[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)]
            scores = np.where(lettered, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0)
        return pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return map_batches(rows, score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows whose crc32(doc_id) mod 4 is not 2, for every row."""
    model = learn(docs, crc_bucket("doc_id", 4) != 2)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
