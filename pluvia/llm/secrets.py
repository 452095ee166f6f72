"""Secret scans: an Aho-Corasick prefilter, anchored patterns at its hits, checksums of what they find.

One automaton over all keywords runs through the lower-cased bytes of each whole text; a pattern is tried
only where its keyword ends up. Kinds:

* assign, access and hex are the base: assignments to a secret's name, cloud access ids, long runs of
  hexadecimal digits (those are found from a mask, since no keyword leads to them);
* github and npm tokens count only if their last six characters are the CRC-32 of what stands before
  them, in base 62; jwt only if its first part decodes to a JSON object with ``alg``; key for a private
  key in PEM, from its BEGIN line over the body to the END line with the same label. Without one before
  the next BEGIN line, the key is what follows in PEM's form: header lines, lines of base64 alone, and runs
  of 24 such characters or more wherever they stand.

Defined results: a null text is empty and has no spans. Offsets count code points; ends are exclusive.
Base kinds are leftmost and do not overlap among their own kind; a match that is too short is dropped
but still covers its characters, as in a regular expression's scan. A scan is linear in the text: where a pattern fails
only behind a run of characters, it is not tried again inside that run. Repeated rows get equal results.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, texts_of

# Kinds in their order, keywords of each, patterns.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "key")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "key": ("-----begin",),
}
PATTERNS = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"),
    "key": re.compile(rb"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----"),
}
JWT_RUN = re.compile(rb"eyJ[A-Za-z0-9_-]*")
# Line ends may be written as in a string; a line may be quoted or indented.
_EOL = rb"(?:\r\n?|\n|\\r\\n|\\n)"
_LINE = rb"(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*|[A-Za-z0-9+/]+={0,2})"
KEY_LINES = re.compile(rb"(?:(?:[\x20\t>]|" + _EOL + rb")*+[A-Za-z0-9+/]{24,}+={0,2}|(?:[\x20\t]*+" + _EOL + rb"[\x20\t>]*+)++" + _LINE + rb"(?=[\x20\t]*+(?:" + _EOL + rb"|\Z)))*+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_HEX_RUN = b"\x01" * LEAST["hex"]


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def checksum62(body: bytes) -> bytes:
    """CRC-32 in six digits of base 62."""
    n, out = zlib.crc32(body), bytearray()
    for _ in range(6):
        n, d = divmod(n, 62)
        out.append(BASE62[d])
    return bytes(reversed(out))


def _holds(kind: str, m: re.Match[bytes]) -> bool:
    if kind == "assign":
        return len(m[1]) >= LEAST["assign"]
    if kind == "access":
        return len(m[0]) >= LEAST["access"]
    if kind in ("github", "npm"):
        return checksum62(m[1]) == m[2]
    if kind == "jwt":
        try:
            head = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
        except (ValueError, binascii.Error, RecursionError):
            return False
        return isinstance(head, dict) and "alg" in head
    return True


def _end(kind: str, text: bytes, m: re.Match[bytes]) -> int:
    """Where the secret ends that `m` is, or begins."""
    if kind != "key":
        return m.end()
    last = b"-----END " + m[1] + b"-----"
    after = text.find(b"-----BEGIN", m.end())
    at = text.find(last, m.end(), after if after >= 0 else len(text))
    return at + len(last) if at >= 0 else KEY_LINES.match(text, m.end()).end()


def byte_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in bytes, sorted."""
    found: list[tuple[int, int, int]] = []
    covered = dict.fromkeys(KEYWORDS, 0)
    hits = [(end - n + 1, kind) for end, (kind, n) in _automaton().iter(text.lower().decode("latin-1"))]
    hits.sort()
    for start, kind in hits:
        if start < covered[kind]:
            continue
        m = PATTERNS[kind].match(text, start)
        if m:
            covered[kind] = end = _end(kind, text, m)
            if _holds(kind, m):
                found.append((start, KINDS.index(kind), end))
        elif kind == "jwt" and (run := JWT_RUN.match(text, start)):
            covered[kind] = run.end()  # what follows the run decides, for every start inside it
    digits = text.translate(_HEX)
    at = digits.find(_HEX_RUN)
    while at >= 0:
        end = digits.find(b"\x00", at)
        end = len(text) if end < 0 else end
        found.append((at, KINDS.index("hex"), end))
        at = digits.find(_HEX_RUN, end)
    return sorted(found)


def spans(text: bytes) -> list[tuple[int, int, int]]:
    """As `byte_spans`, in code points."""
    found = byte_spans(text)
    if not found or text.isascii():
        return found
    before = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    place = lambda b: int(before[b - 1]) if b else 0
    return [(place(a), k, place(b)) for a, k, b in found]


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of `docs`."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans(t) for t in texts_of(b.column(1))]
        counts = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(3)]
        base = [hashlib.sha256(_joined([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
        return pa.record_batch([b.column(0), *counts, pa.array(base, pa.string()), pa.array([_joined(f) for f in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: bytes) -> bytes:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    out, at, open_end, kind = [], 0, -1, 0
    for a, k, b in byte_spans(text):
        if a < open_end:
            open_end = max(open_end, b)
            continue
        if open_end >= 0:
            out.append(b"[" + KINDS[kind].upper().encode() + b"]")
            at = open_end
        out.append(text[at:a])
        open_end, kind, at = b, k, b
    if open_end >= 0:
        out.append(b"[" + KINDS[kind].upper().encode() + b"]")
        at = open_end
    out.append(text[at:])
    return b"".join(out)


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with secrets in `text` replaced, and `n_chars`, where there is such a column, counted anew.

    A null text, and a null n_chars, stay null. Rows are taken one by one, so that repeated rows stay equal.
    """
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(at).cast(pa.binary()).to_pylist()
        new = pa.array([t if t is None else redact(t) for t in texts], pa.binary()).cast(pa.string())
        return pa.record_batch([new if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    small_batches(docs.sparkSession)
    out = map_batches(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
