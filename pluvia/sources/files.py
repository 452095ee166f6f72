"""Sources and sinks: tracks, fields, annual tables, reports, digests."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import closing
from datetime import UTC, datetime, timedelta
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions.scalars import FILE_NAME, checked_units
from ..session import ship

# The track archive's columns.
TRACK_COLUMNS = ("SID", "SEASON", "BASIN", "NAME", "ISO_TIME", "LAT", "LON", "TRACK_TYPE", "USA_STATUS", "USA_WIND", "USA_PRES", "IFLAG")


def raw_tracks(spark: SparkSession, path: str) -> DataFrame:
    """The track archive's columns as text. Its second line holds units and goes; NA is a basin; blanks stay blank."""
    rows = spark.read.csv(path, header=True, inferSchema=False, nullValue="\u0000", emptyValue="")
    rows = rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in TRACK_COLUMNS if c in rows.columns))
    return rows.where(~((F.trim("SID") == "") & (F.try_to_timestamp("ISO_TIME").isNull())))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; empty is null, NA is text."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="", enforceSchema=False)


def json_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document: an object, or an array of them."""
    return spark.read.json(path, multiLine=True)


def listing(spark: SparkSession, path: str, pattern: str = "*.nc") -> DataFrame:
    """NAME, PATH, SIZE of files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("NAME"), F.col("path").alias("PATH"), F.col("length").alias("SIZE"))


def headers(spark: SparkSession, paths: list[str], variable: str = "precipitation") -> DataFrame:
    """What NetCDF files say of themselves, by file and axis; see `HeaderSource`."""
    ship(spark)
    spark.dataSource.register(HeaderSource)
    return spark.read.format(HeaderSource.name()).option("variable", variable).option("paths", "\n".join(paths)).load()


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """NAME, PATH, SHA256 of files below a folder; files without content are not listed."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("NAME"), F.col("path").alias("PATH"), F.sha2("content", 256).alias("SHA256"))


def years(spark: SparkSession, path: str) -> list[int]:
    """The years of a table partitioned by YEAR, in order; none if there is no table."""
    try:
        t = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []
    return sorted(r["YEAR"] for r in t.select(F.col("YEAR").cast("int").alias("YEAR")).distinct().collect())


def annual(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """A table partitioned by YEAR, for the years; a year without rows, or outside its partition, is an error.

    Only the years' folders are read.
    """
    t = spark.read.parquet(path).where(F.col("YEAR").between(first, last))
    have = {r["YEAR"] for r in t.select(F.col("YEAR").cast("int").alias("YEAR")).distinct().collect()}
    gone = sorted(set(range(first, last + 1)) - have)
    if gone:
        raise FileNotFoundError(f"no rows for the years {gone}")
    if "TIME" in t.columns:
        t = t.withColumn("YEAR", F.when(F.year("TIME") == F.col("YEAR"), F.col("YEAR")).otherwise(F.raise_error(F.lit("a row outside its year's partition")).cast(t.schema["YEAR"].dataType)))
    return t


def write_annual(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Snappy Parquet by YEAR, whole years at a time: replaced if `overwrite`, else an error where there are any.

    Rows of a time step lie together. The commit protocol makes a failed write leave nothing behind.
    """
    spark = df.sparkSession
    if not overwrite:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            old = spark.read.parquet(path).select(F.col("YEAR").cast("int").alias("YEAR")).distinct()
            if not old.join(df.select(F.col("YEAR").cast("int").alias("YEAR")).distinct(), "YEAR", "left_semi").isEmpty():
                raise FileExistsError(f"{path} has rows for these years")
    order = [c for c in ("TIME", "SID", "ROW") if c in df.columns]
    out = df.repartition("YEAR", *order[:1]).sortWithinPartitions("YEAR", *order)
    out.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy("YEAR").parquet(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header; doubles are printed so that they read back the same."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """PATH, SIZE, rows of a table's files, from their metadata and a count."""
    m = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
    return m.groupBy(F.col("file_path").alias("PATH"), F.col("file_size").alias("SIZE")).agg(F.count(F.lit(1)).alias("rows"))


def parquet_footers(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """PATH, SIZE, rows, row_groups, columns of Parquet files, from their footers, read where the files are.

    Only names and lengths come from Spark; each task opens its files by pyarrow, so the path must be one
    that pyarrow's file systems reach.
    """
    names = listing(spark, path, pattern).select("PATH", "SIZE")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs, parquet

        for b in batches:
            meta = []
            for p in b.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(p)
                with system.open_input_file(inner) as f:
                    meta.append(parquet.ParquetFile(f).metadata)
            cols = [[m.num_rows for m in meta], [m.num_row_groups for m in meta], [m.schema.names for m in meta]]
            yield pa.record_batch([*b.columns, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string()))], ["PATH", "SIZE", "rows", "row_groups", "columns"])

    ship(spark)
    return names.mapInArrow(read, "PATH string, SIZE long, rows long, row_groups long, columns array<string>")


# How a file may write that its field is interpolated.
FLAGS = {"true": True, "1": True, "1.0": True, "false": False, "0": False, "0.0": False, "": False}
# The grid's axes as files hold them: size, first and last degree.
GRID, GRID_TOLERANCE = {"lat": (1800, 89.95, -89.95), "lon": (3600, -179.95, 179.95)}, 2e-3
HEADER_SCHEMA = "NAME string, PATH string, TIME timestamp, UNIT string, IS_INTERPOLATED boolean, AXIS string, SIZE int, FIRST double, LAST double, RISING int, FALLING int"
FIELD_SCHEMA = "TIME timestamp, ROW int, PRECIP_3H_MM float, IS_INTERPOLATED boolean"


class FieldSource(DataSource):
    """Gridded NetCDF files as rows: spark.dataSource.register(FieldSource); spark.read.format("pluvia_field").

    Options: paths (separated by a line end), variable, filesPerPartition, and grid: `full` checks each file's axes
    against the grid, `any` takes a part of it. Filters on TIME leave out files by their names, and filters on
    ROW latitudes, before anything is read of them; that takes spark.sql.python.filterPushdown.enabled, which
    `session` sets. Needs the netCDF4 library on the executors.
    """

    @classmethod
    def name(cls) -> str:
        return "pluvia_field"

    def schema(self) -> str:
        return FIELD_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FieldReader(self.options)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class Wanted:
    """Least and greatest value that filters on a column allow, and the values if they are listed."""

    def __init__(self) -> None:
        self.low = self.high = self.among = None

    def take(self, f: Filter) -> None:
        if isinstance(f, EqualTo | In):
            values = {_plain(v) for v in (f.value if isinstance(f, In) else (f.value,))}
            self.among = values if self.among is None else self.among & values
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.low = max(_plain(f.value), self.low or _plain(f.value))
        elif isinstance(f, LessThan | LessThanOrEqual):
            self.high = min(_plain(f.value), self.high or _plain(f.value))

    def range(self, least, greatest) -> bool:
        """Whether any value from `least` to `greatest` may be wanted."""
        inside = (self.low is None or greatest >= self.low) and (self.high is None or least <= self.high)
        return inside and (self.among is None or any(least <= v <= greatest for v in self.among))


def _plain(value):
    """Times without their zone, in UTC."""
    return value.astimezone(UTC).replace(tzinfo=None) if isinstance(value, datetime) else value


class FileReader(DataSourceReader):
    """Several files to a partition; files outside the wanted times are left out by their names."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.variable = options.get("variable", "precipitation")
        self.size = int(options.get("filesPerPartition", 8))
        self.full = options.get("grid", "full") == "full"
        self.times, self.rows = Wanted(), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column in (("TIME",), ("ROW",)):
                (self.times if column == ("TIME",) else self.rows).take(f)
            yield f  # bounds are a superset: Spark filters what is read

    def partitions(self) -> list[InputPartition]:
        kept = [p for p in self.paths if self.times.range(field_time(p), field_time(p))]
        return [Files(kept[i : i + self.size]) for i in range(0, len(kept), self.size)] or [Files([])]


class FieldReader(FileReader):
    def read(self, partition: Files) -> Iterator:
        for path in partition.paths:
            with closing(opened(path)) as data:
                if self.full:
                    checked_axes(data, path)
                yield from field_batches(data, path, self.variable, self.rows)


class HeaderSource(DataSource):
    """What files say about themselves, without their values: a row for each file and axis. Options as for `FieldSource`."""

    @classmethod
    def name(cls) -> str:
        return "pluvia_field_header"

    def schema(self) -> str:
        return HEADER_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(self.options)


class HeaderReader(FileReader):
    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with closing(opened(path)) as data:
                variable = data.variables.get(self.variable)
                unit = None if variable is None else str(getattr(variable, "units", "")) or None
                marked = flag(getattr(data, "is_interpolated", False))
                for axis in ("lat", "lon"):
                    yield (re.split(r"[/\\]", path)[-1], path, field_time(path), unit, marked, axis, *axis_summary(data, axis))


def opened(path: str):
    """A NetCDF data set, from a local path, or from the bytes of a file that pyarrow's file systems reach."""
    try:
        from netCDF4 import Dataset
    except ImportError as e:
        raise ImportError("reading NetCDF fields needs the netCDF4 library; use long Parquet fields without it") from e
    where = urlparse(path)
    if where.scheme in ("", "file"):
        return Dataset(unquote(where.path))
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner) as f:
        return Dataset(path, memory=f.read())


def axis_summary(data, axis: str) -> tuple[int, float | None, float | None, int, int]:
    """(size, first, last, rising steps, falling steps) of an axis; size 0 if it is not there."""
    import numpy as np

    if axis not in data.variables:
        return 0, None, None, 0, 0
    x = np.asarray(data.variables[axis][:], float)
    steps = np.diff(x)
    return len(x), float(x[0]) if len(x) else None, float(x[-1]) if len(x) else None, int((steps > 0).sum()), int((steps < 0).sum())


def checked_axes(data, name: str) -> None:
    """An error if the axes are not the grid's."""
    for axis, (size, first, last) in GRID.items():
        n, a, z, *_ = axis_summary(data, axis)
        if n != size or abs(a - first) > GRID_TOLERANCE or abs(z - last) > GRID_TOLERANCE:
            raise ValueError(f"{axis} of {name} has {n} values from {a} to {z}, not {size} from {first} to {last}")


def field_time(name: str):
    """The time step that a file's name stands for."""
    m = FILE_NAME.fullmatch(re.split(r"[/\\]", name)[-1])
    if not m:
        raise ValueError(f"{name} is not the name of a field")
    return datetime(int(m[1]), 1, 1) + timedelta(days=int(m[2]) - 1, hours=int(m[3]))


def flag(value) -> bool:
    """A flag that is written as a text, a number or a boolean."""
    text = str(value).strip().lower()
    if text not in FLAGS:
        raise ValueError(f"{value!r} is no flag")
    return FLAGS[text]


def field_batches(data, name: str, variable: str, wanted: Wanted | None = None) -> Iterator:
    """Arrow batches of a data set with variables lat, lon and `variable` (two-dimensional beside axes of one value, in any order).

    Only latitudes with wanted rows are read, neighbours at once.
    """
    import numpy as np
    import pyarrow as pa

    var = data.variables[variable]
    checked_units(getattr(var, "units", None))
    lat, lon = (np.asarray(data.variables[k][:], float) for k in ("lat", "lon"))
    shape = [n for n in var.shape if n != 1] or [1]
    if sorted(shape) != sorted(n for n in (len(lat), len(lon)) if n != 1) and shape != [1]:
        raise ValueError(f"{variable} of {name} has the shape {var.shape}")
    turned = len(lat) != len(lon) and tuple(shape) == (len(lon), len(lat))
    if not (np.diff(lat) < 0).all():
        raise ValueError(f"latitudes of {name} do not fall")
    order = np.argsort(lon % 360, kind="stable")
    if not (np.diff((lon % 360)[order]) > 0).all():
        raise ValueError(f"longitudes of {name} repeat")
    first = (np.rint((89.95 - lat) / 0.1) * 3600).astype(np.int64)
    columns = np.rint(((lon % 360)[order] - 0.05) / 0.1).astype(np.int64)
    kept = np.array([wanted is None or wanted.range(r, r + 3599) for r in first.tolist()], bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]])))
    when, marked = field_time(name), flag(getattr(data, "is_interpolated", False))
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        lead = (0,) * (len(var.shape) - 2)
        part = var[(*lead, slice(None), slice(a, z)) if turned else (*lead, slice(a, z), slice(None))]
        x = np.ma.filled(np.ma.asarray(part, np.float32), np.nan)
        x = x.T if turned else x
        for i in range(a, z):
            v = x[i - a, order]
            n = len(v)
            yield pa.record_batch([pa.array([when] * n, pa.timestamp("us", "UTC")), pa.array((first[i] + columns).astype(np.int32)), pa.array(v, pa.float32(), mask=~np.isfinite(v)), pa.array([marked] * n)], ["TIME", "ROW", "PRECIP_3H_MM", "IS_INTERPOLATED"])
