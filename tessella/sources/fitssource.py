"""The Spark data source `fits`: images read by ranges, a task for about as many bytes as a task should fetch.

    register(spark)
    spark.read.format("fits").option("bounds", "100,200,64,64").load("s3://bucket/frames")

A schema given to the reader says which columns are wanted: without `pixels` only header blocks are fetched. Filters on
`path` drop files before they are opened. Paths are opened with Arrow's file systems: local and shared folders, S3, GCS,
HDFS, Azure; for a store that only Spark reads there is `fits.read`.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import fits

#: Header blocks that are fetched at once; bytes that a task fetches; bytes of pixels in a batch.
BLOCKS_AT_ONCE = 4
BYTES_PER_TASK = 128 << 20
BYTES_PER_BATCH = 16 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("s3a://"):
        path = "s3://" + path[6:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Ranged:
    """Ranges of an open file; counts the bytes that it fetches. Headers are fetched BLOCKS_AT_ONCE blocks ahead."""

    def __init__(self, handle: pa.NativeFile, size: int):
        self.handle, self.size, self.fetched = handle, size, 0
        self.held: tuple[int, bytes] = (0, b"")

    def __call__(self, at: int, n: int) -> bytes:
        start, data = self.held
        if start <= at and at + n <= start + len(data):
            return data[at - start : at - start + n]
        ahead = max(n, fits.BLOCK * BLOCKS_AT_ONCE) if n == fits.BLOCK else n
        self.handle.seek(at)
        data = self.handle.read(min(ahead, max(self.size - at, 0)))
        self.fetched += len(data)
        if n == fits.BLOCK:
            self.held = at, data
        return data[:n]


@dataclass
class Files(InputPartition):
    """The files of one task: path and size of each."""

    files: list[tuple[str, int]]


class FitsReader(DataSourceReader):
    """Plans tasks over the files below a path and reads each file's row."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.path, self.pattern, self.exclude = options["path"], options.get("pattern", "*"), options.get("exclude")
        self.recursive, self.limit = options.get("recursive", "true").lower() == "true", int(options.get("limit", 0))
        self.hdu = int(options["hdu"]) if "hdu" in options else None
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.bounds = tuple(int(x) for x in options["bounds"].split(",")) if options.get("bounds") else None
        if self.bounds and len(self.bounds) != 4:
            raise ValueError("bounds are x0,y0,w,h")
        self.header_only = "pixels" not in schema.names or options.get("header_only", "false").lower() == "true"
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters on `path`; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("path",):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        for f in self.tests:
            fits_in = (
                path == f.value if isinstance(f, EqualTo) else path in f.value if isinstance(f, In) else path.startswith(f.value) if isinstance(f, StringStartsWith)
                else path.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in path
            )
            if not fits_in:
                return False
        return True

    def _listing(self) -> list[tuple[str, int]]:
        store, inner = open_store(self.path)
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=self.recursive))
        out = []
        for f in found:
            path = prefix + f.path
            if f.type == fs.FileType.File and f.path.lower().endswith(fits.EXTENSIONS) and fnmatch.fnmatch(f.base_name, self.pattern) and not (self.exclude and self.exclude.rstrip("/") + "/" in path) and self._wanted(path):
                out.append((path, f.size))
        out.sort()
        return out[: self.limit] if self.limit else out

    def partitions(self) -> list[InputPartition]:
        """Files in order of path, cut into tasks by what each will fetch."""
        tasks: list[InputPartition] = []
        group: list[tuple[str, int]] = []
        due = 0
        for path, size in self._listing():
            cost = min(size, 4 * fits.BLOCK * BLOCKS_AT_ONCE) + (1 << 16) if self.header_only else size + (1 << 16)  # opening a file costs too
            if group and due + cost > BYTES_PER_TASK:
                tasks.append(Files(group))
                group, due = [], 0
            group.append((path, size))
            due += cost
        return [*tasks, Files(group)] if group else tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """One row per file, in batches of about BYTES_PER_BATCH of pixels."""
        arrow = to_arrow_schema(self.schema)
        rows, held = [], 0
        for path, size in partition.files:
            row = self._row(path, size)
            rows.append({f.name: row.get(f.name) for f in arrow})
            held += 4 * len(row["pixels"]) if row.get("pixels") is not None else 512
            if held >= BYTES_PER_BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def _row(self, path: str, size: int) -> dict:
        store, inner = open_store(path)
        with store.open_input_file(inner) as handle:
            ranged = Ranged(handle, size)
            try:
                row = fits.decode_from(ranged, size, path, self.header_only, self.bounds, self.hdu)
            except (ValueError, KeyError) as problem:
                if self.strict:
                    raise
                row = {"path": path, "is_valid": False, "error": str(problem)}
            return row | {"bytes_fetched": ranged.fetched}


class FitsDataSource(DataSource):
    """`spark.read.format("fits")`.

    Options: path, pattern, recursive, limit (first files by path), exclude (a folder), bounds ("x0,y0,w,h"), hdu,
    header_only, mode (PERMISSIVE or FAILFAST). Columns are those of `fits.SCHEMA` and bytes_fetched.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return fits.SCHEMA + ", bytes_fetched long"

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format `fits` known to a session, with filters on paths pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsDataSource)


def open_ranged(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, bounds: tuple[int, int, int, int] | None = None, **options) -> DataFrame:
    """Images below `path`, with the named columns of the format's schema or all; other options as for the format."""
    register(spark)
    reader = spark.read.format("fits")
    if columns is not None:
        whole = StructType.fromDDL(fits.SCHEMA + ", bytes_fetched long")
        reader = reader.schema(StructType([whole[c] for c in columns]))
    if bounds is not None:
        reader = reader.option("bounds", ",".join(map(str, bounds)))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)
