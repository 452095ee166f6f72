"""What the operators share: tables in the shared folder, salted group minima, connected components.

Nothing here keeps state on an executor's own disk: intermediate tables are written as Parquet to the
folder in ``spark.checkpoint.dir`` (shared by all executors), which also cuts the lineage, so that a lost
executor costs the tasks it ran and no more.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..session import ship

#: Salts that a hot key is dealt over: a key with a third of all rows leaves 1/192 of them to a task.
SALTS = 64

#: Edges, of 16 bytes, up to which a round of `components` need not spread those of a node.
FEW_EDGES = 1 << 18

_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder stands in if the application is one local process; on a cluster,
    whose executors would not share it, that is an error.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        own = sc.getConf().get("spark.checkpoint.dir")
        if not own and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="pluvia-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def keep_until_end(spark: SparkSession, path: str) -> str:
    """`path`, noted to be deleted when the driver ends."""
    if not _written:
        atexit.register(discard_stored)
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """`df`, written once to the shared folder and read back. Deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_until_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard_stored() -> None:
    """Deletes the tables of `stored`; for use when no result that reads them is needed any more."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


#: What a Python worker gets at once, at most: rows, and bytes for long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Sends the package to the executors, and lowers the session's bounds of Arrow batches to the above.

    Bounds are read when a plan runs, which may be after an operator has returned, so they stay; a smaller
    bound that the session has is kept.
    """
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = (spark.conf.get(key) or "").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column of `df` has them, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def crc_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


def give_back() -> None:
    """Returns what a Python worker has freed to the system, since workers are kept between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | StructType) -> DataFrame:
    """fn applied to every Arrow batch of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                elif out is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of neighbours whose sizes sum to `most` at most; a larger one stands alone."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def salt_of(*cols: Column | str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), *cols), F.lit(salts)).cast("int")


def attach(rows: DataFrame, key: str, values: DataFrame, spread: str, among: DataFrame | None = None) -> DataFrame:
    """`rows` left-joined to `values`, which is unique by `key`, without ever gathering the rows of a key.

    Rows get a salt from the column `spread`; values go to each (key, salt) there is, SALTS for a key at
    most, and from there to the rows. A key with any share of all rows is so dealt over SALTS tasks.
    among: a lighter table with the same pairs of `key` and `spread`.
    """
    salted = rows.withColumn("_s", salt_of(spread))
    mid = (rows if among is None else among).select(key, salt_of(spread).alias("_s")).distinct().join(values, key)
    return salted.join(mid, [key, "_s"], "left").drop("_s")


def group_min(df: DataFrame, key: str, value: str, spread: str, out: str) -> DataFrame:
    """`df` with the least `value` of each `key`; minima are combined before they are shuffled."""
    return attach(df, key, df.groupBy(key).agg(F.min(value).alias(out)), spread)


def components(edges: DataFrame, src: str = "u", dst: str = "v", rounds: int = 60) -> DataFrame:
    """(id, component): for each end of an edge, the least id that it reaches.

    Large-star and small-star steps alternate until no edge changes. A step is a salted `group_min`, so that
    a node with a third of all edges stays spread; with FEW_EDGES at most, which one task can hold, it is a
    window, since there a round costs its stages and not its rows. Every round is written to the shared folder, and only its
    row count and a checksum come to the driver. The number of rounds is logarithmic in practice; if
    `rounds` should not do, it raises and returns nothing wrong.
    """
    e = stored(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct(), "edges")
    state = _digest(e)
    for _ in range(rounds if state[0] else 0):
        few = state[0] <= FEW_EDGES
        least = lambda df, out, few=few: df.withColumn(out, F.min("v").over(W.partitionBy("u"))) if few else group_min(df, "u", "v", "v", out)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = least(both, "_n").where("v > u").select(F.col("v").alias("u"), F.least("u", "_n").alias("v")).where("u <> v")
        small = least(big if few else big.distinct(), "_m")
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct("u", F.col("_m").alias("v")))
        small = small.select(F.explode(ends).alias("x")).select("x.*")
        e = stored(small.where("u <> v").distinct(), "edges")
        new = _digest(e)
        if new == state:
            break
        state = new
    else:
        if state[0]:
            raise RuntimeError(f"connected components did not settle in {rounds} rounds")
    # every node is now a leaf of its component's least id, or is that id
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _digest(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return r[0], r[1] or 0
