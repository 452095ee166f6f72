"""WARC archives, and an external merge of their indexes into capture histories.

Writing: each page becomes a WARC record, made by DataFrame operations. Tasks write them to archives in the
shared folder, each record a gzip member of its own, so that any can be read from its offset alone; an archive
ends at ARCHIVE_BYTES or ARCHIVE_RECORDS. A task names its archives by its attempt and returns their names, and
only archives that finished tasks have named are read, so that a lost executor leaves nothing behind that
counts. Of equal payloads of REVISIT_BYTES at least, the one with the largest page_id is a response and others are
revisits of it; the largest ids are found by a pre-aggregated group and come back by salted keys.

Reading: each archive is streamed, a record at a time; payloads are checked against their digests, and its
captures become a run sorted by URL key, time and page_id, which is written to the shared folder. Runs are
cut at common range boundaries, into ranges of about RANGE captures; for each range a loser tree merges the
pieces of all runs, so that ranges in order hold the captures of all archives in order, each URL's
history together. What a task holds is bounded: a record, an archive's captures, or a range.

Archives are opened by pyarrow's file systems, so the shared folder must be one that they reach (a local or
mounted path, HDFS, S3, GCS).

Defined results: null html is an empty payload. Payloads below REVISIT_BYTES are always responses. Rows
that repeat the largest page_id of equal payloads are all responses; a row without page_id is a revisit if
an equal payload has one, else a response. Line ends in a URL are written as %0A and %0D; a null URL leaves
the header out and has the empty key. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, give_back, keep_until_end, shared_dir, small_batches, stored

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
ARCHIVE_RECORDS = 50_000
RANGE = 50_000
_READ = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
END = b"\r\n\r\n"
RUN_SCHEMA = "url_key string, captured string, page_id long, url string, archive string, offset long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def capture_time(page_id: Column) -> Column:
    """A made-up time for pages that have none: a second for each id from 2024 on."""
    return F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(100_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, top: the page_id to refer to, null for a response."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("digest"))
    light = stored(rows.select("page_id", "payload_bytes", "digest"), "digests")
    equal = light.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    rows = attach(rows, "digest", equal.where("_n > 1").select("digest", "_top"), "page_id", light)
    revisit = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return rows.withColumn("top", F.when(revisit, F.col("_top"))).drop("_top")


def records(pages: DataFrame) -> DataFrame:
    """One column `record`: WARC records without the two line ends after them."""
    r = with_types(pages)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes"), F.lit(CRLF * 2))
    is_revisit = F.col("top").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", capture_time(F.col("page_id"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("top")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
        F.lit(CRLF),
    )
    return r.select(F.concat(head, http, F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))).alias("record"))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write(pages: DataFrame, path: str, most_bytes: int = ARCHIVE_BYTES, most_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Archives of all pages below `path`; archive, records, bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = file_system(path)
        out, made = None, []
        for b in batches:
            for record in b.column(0):
                if out is None:
                    if not made:
                        system.create_dir(folder, recursive=True)
                    made.append([f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):05d}.warc.gz", 0, 0])
                    out = system.open_output_stream(f"{folder}/{made[-1][0]}", compression=None)
                z = zlib.compressobj(wbits=31)
                one = z.compress(record.as_buffer()) + z.compress(END) + z.flush()
                out.write(one)
                made[-1][1] += 1
                made[-1][2] += len(one)
                if made[-1][1] >= most_records or made[-1][2] >= most_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        names, n, size = zip(*made, strict=True) if made else ((), (), ())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["archive", "records", "bytes"])

    small_batches(pages.sparkSession)
    return stored(records(pages).mapInArrow(run, "archive string, records long, bytes long"), "archives")


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each member of a gzip stream, which is read in small parts."""
    at, rest = 0, stream.read(_READ)
    while rest:
        z, parts, size = zlib.decompressobj(wbits=31), [], 0
        while not z.eof:
            if not rest and not (rest := stream.read(_READ)):
                raise ValueError(f"the member at {at} has no end")
            parts.append(z.decompress(rest))
            size += len(rest) - len(z.unused_data)
            rest = z.unused_data
        yield at, b"".join(parts)
        at += size
        rest = rest or stream.read(_READ)


def parse(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive, or a part of one, that is not compressed."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].decode("utf-8").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(headers["Content-Length"])
        if archive[stop : stop + 4] != END:
            raise ValueError(f"the record at {at} has no end at {stop}")
        yield at, headers, archive[end + 4 : stop]
        at = stop + 4


def record_at(path: str, offset: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record at an offset of an archive."""
    system, inner = file_system(path)
    with system.open_input_file(inner) as f:
        f.seek(offset)
        _, content = next(members(f))
    return next(parse(content))[1:]


def url_key(url: str) -> str:
    """The host's parts from the right, then the path and query: pages of a site sort together."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url)
    if not m:
        return url.split("#")[0]
    host = m[1].rpartition("@")[2].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def run_of(stream, name: str) -> list[tuple]:
    """The sorted captures of one archive, as rows of RUN_SCHEMA."""
    rows = []
    for offset, content in members(stream):
        for _, h, block in parse(content):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
            if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"the payload at {offset} of {name} does not match its digest")
            url = h.get("WARC-Target-URI")
            rows.append((url_key(url or ""), h["WARC-Date"], _page(h["WARC-Record-ID"]), url, name, offset, h["WARC-Type"], size, digest, _page(h.get("WARC-Refers-To"))))
    rows.sort(key=order_of)
    return rows


def order_of(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def read(archives: DataFrame, path: str) -> DataFrame:
    """Sorted runs of captures, one for each of the archives (rows with `archive`) below `path`, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split(" ") for c in RUN_SCHEMA.split(", "))])
        system, folder = file_system(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    rows = run_of(stream, name)
                for lo in range(0, len(rows), 4096):
                    cols = zip(*rows[lo : lo + 4096], strict=True)
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        give_back()

    n = archives.count()
    spread = archives.select("archive").repartition(max(1, n), "archive")
    return stored(spread.mapInArrow(run, RUN_SCHEMA), "runs")


class LoserTree:
    """Merges k sorted lists: inner nodes hold losers, so that each row costs one path of comparisons."""

    def __init__(self, lists: list[list], key) -> None:
        self.lists = [x for x in lists if x]
        self.key = key
        self.at = [0] * len(self.lists)
        self.keys = [key(x[0]) for x in self.lists]
        k = len(self.lists)
        self.tree = [-1] * max(1, k)
        for leaf in range(k - 1, -1, -1):
            self._play(leaf, first=True)

    def _beats(self, a: int, b: int) -> bool:
        """Whether a's row comes first; a list that has ended loses; ties go to the earlier list."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _play(self, leaf: int, first: bool = False) -> None:
        k, winner = len(self.lists), leaf
        node = (leaf + k) // 2
        while node > 0:
            held = self.tree[node]
            if held < 0 and first:
                self.tree[node] = winner
                return
            if held >= 0 and self._beats(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.lists:
            w = self.tree[0]
            if self.keys[w] is None:
                return
            yield self.lists[w][self.at[w]]
            self.at[w] += 1
            self.keys[w] = self.key(self.lists[w][self.at[w]]) if self.at[w] < len(self.lists[w]) else None
            self._play(w)


def merged(runs: DataFrame, most: int = RANGE) -> DataFrame:
    """The captures of all runs in global order: columns of RUN_SCHEMA, `part` and `place` in it.

    Rows with a smaller part, or with the same part and a smaller place, come first. A task holds one
    range of the keys, of about `most` captures; bounds go down to a record's place in its archive, so that a
    URL, or any key, with any share of all captures is cut too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = list(map(order_of, zip(*(table.column(c).to_pylist() for c in range(3)), strict=True)))
        archive = table.column("archive").to_pylist()
        pieces: list[list[int]] = []
        for i, key in enumerate(keys):  # a run's rows come in order
            if not i or archive[i] != archive[i - 1] or key < keys[i - 1]:
                pieces.append([])
            pieces[-1].append(i)
        order = list(LoserTree(pieces, keys.__getitem__))
        part = pa.array([TaskContext.get().partitionId()] * len(order), pa.int32())
        table = table.take(pa.array(order)).append_column("part", part).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from table.to_batches(4096)
        give_back()

    small_batches(runs.sparkSession)
    ranges = max(1, -(-runs.count() // most))
    ranged = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "offset")
    return ranged.mapInArrow(run, f"{RUN_SCHEMA}, part int, place long")


def histories(pages: DataFrame) -> DataFrame:
    """Writes archives of all pages to the shared folder, reads them back, and merges their indexes."""
    spark = pages.sparkSession
    path = keep_until_end(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return merged(read(write(pages, path), path))
