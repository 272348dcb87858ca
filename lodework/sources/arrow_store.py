"""Tables of Arrow files behind a data source of their own, with filters and pruning at the remote side.

A table is a folder of Arrow files and a manifest that names them with their rows and the least and greatest value of
every column.  A scan takes the filters that Spark offers: files whose range rules a filter out are never opened, the
others are filtered batch by batch before their rows reach Spark.  Files of tasks that failed or ran twice are in no
manifest, so readers never see them.  A folder is a path or a URI that Arrow's file systems open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage)

FORMAT = "arrow_store"
MANIFEST = "manifest.json"
#: Rows of a file; a task writes as many files as it needs.
FILE_ROWS = 1 << 20
#: Types whose range the manifest keeps, as values that JSON holds exactly.
RANGED = (pa.types.is_integer, pa.types.is_string, pa.types.is_date, pa.types.is_timestamp)
COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def stored(value: pa.Scalar):
    """A value as the manifest has it: numbers and texts as they are, dates and instants as numbers."""
    kind = value.type
    if pa.types.is_date32(kind):
        return value.cast(pa.int32()).as_py()
    if pa.types.is_timestamp(kind):
        return value.cast(pa.timestamp("us", kind.tz)).cast(pa.int64()).as_py()
    return value.as_py()


class Range:
    """Least and greatest value, and how many are null, of a column over batches."""

    def __init__(self):
        self.low = self.high = None
        self.nulls = 0

    def add(self, column: pa.Array) -> None:
        self.nulls += column.null_count
        found = pc.min_max(column)
        if found["min"].is_valid:
            low, high = stored(found["min"]), stored(found["max"])
            self.low = low if self.low is None else min(self.low, low)
            self.high = high if self.high is None else max(self.high, high)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, file_rows: int):
        self.folder, self.file_rows = folder, file_rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.folder)
        system.create_dir(root, recursive=True)
        done: list[dict] = []
        sink = out = None
        ranges: dict[str, Range] = {}

        def close():
            nonlocal sink, out
            if out is not None:
                out.close()
                sink.close()
                done[-1]["ranges"] = {n: [r.low, r.high, r.nulls] for n, r in ranges.items()}
                sink = out = None

        for batch in iterator:
            while batch.num_rows:
                if out is None:
                    name = f"{uuid.uuid4().hex}.arrow"
                    sink = system.open_output_stream(f"{root}/{name}")
                    out = pa.ipc.new_file(sink, batch.schema)
                    done.append({"name": name, "rows": 0})
                    ranges = {f.name: Range() for f in batch.schema if any(test(f.type) for test in RANGED)}
                part = batch.slice(0, self.file_rows - done[-1]["rows"])
                out.write_batch(part)
                for n, r in ranges.items():
                    r.add(part.column(n))
                done[-1]["rows"] += part.num_rows
                batch = batch.slice(part.num_rows)
                if done[-1]["rows"] >= self.file_rows:
                    close()
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """One line per file reaches the driver; the manifest comes last, so a table is there whole or not at all."""
        system, root = opened(self.folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write("\n".join(json.dumps(x) for m in messages if m for x in m.files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to undo: files without a manifest are no table."""


def remote_test(wanted: Filter, kinds: dict[str, pa.DataType]) -> tuple | None:
    """(column, test, value) of a filter that the store can answer exactly, else None."""
    path = getattr(wanted, "attribute", None)
    if path is None or len(path) != 1 or path[0] not in kinds:
        return None
    name, kind = path[0], kinds[path[0]]
    if isinstance(wanted, (IsNull, IsNotNull)):
        return name, type(wanted), None
    values = wanted.value if isinstance(wanted, In) else [getattr(wanted, "value", None)]
    if pa.types.is_timestamp(kind) and any(v is not None and (getattr(v, "tzinfo", None) is None) != (kind.tz is None) for v in values):
        return None  # an instant without its zone
    try:
        if isinstance(wanted, In):
            return name, In, pa.array(list(wanted.value), kind)
        if type(wanted) in COMPARED and not pa.types.is_floating(kind):  # NaN compares its own way in Spark
            return name, type(wanted), pa.scalar(wanted.value, kind)
        if isinstance(wanted, StringStartsWith) and pa.types.is_string(kind):
            return name, StringStartsWith, pa.scalar(wanted.value, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError):
        return None
    return None


def can_hold(file: dict, name: str, test: type, value) -> bool:
    """Whether a file can have a row that passes a test, by the range in the manifest."""
    if name not in file["ranges"]:
        return True
    low, high, nulls = file["ranges"][name]
    if test is IsNull:
        return nulls > 0
    if low is None:
        return False
    if test is IsNotNull:
        return True
    if test is In:
        return any(low <= stored(v) <= high for v in value if v.is_valid)
    x = stored(value)
    if test is EqualTo:
        return low <= x <= high
    if test is StringStartsWith:
        return low[: len(x)] <= x <= high[: len(x)]
    return {GreaterThan: high > x, GreaterThanOrEqual: high >= x, LessThan: low < x, LessThanOrEqual: low <= x}[test]


def passing(column: pa.Array, test: type, value) -> pa.Array:
    if test is IsNull:
        return pc.is_null(column)
    if test is IsNotNull:
        return pc.is_valid(column)
    if test is In:
        return pc.and_(pc.is_valid(column), pc.is_in(column, value_set=value))
    if test is StringStartsWith:
        return pc.starts_with(column, value.as_py())
    return COMPARED[test](column, value)


@dataclass
class File(InputPartition):
    name: str


class StoreReader(DataSourceReader):
    def __init__(self, folder: str, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.folder, self.schema = folder, to_arrow_schema(schema)
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        kinds = {f.name: f.type for f in self.schema}
        for wanted in filters:
            test = remote_test(wanted, kinds)
            if test is None:
                yield wanted  # Spark's to answer
            else:
                self.tests.append(test)

    def partitions(self):
        found = [File(x["name"]) for x in manifest(self.folder) if all(can_hold(x, *t) for t in self.tests)]
        return found or [File("")]

    def read(self, partition: File):
        if not partition.name:
            return
        system, root = opened(self.folder)
        with system.open_input_file(f"{root}/{partition.name}") as source, pa.ipc.open_file(source) as file:
            names = self.schema.names
            for i in range(file.num_record_batches):
                held = file.get_batch(i)
                batch = pa.RecordBatch.from_arrays([held.column(n).cast(self.schema.field(n).type) for n in names], schema=self.schema)
                for name, test, value in self.tests:
                    batch = batch.filter(passing(batch.column(name), test, value))
                if batch.num_rows:
                    yield batch


class ArrowStore(DataSource):
    """``spark.read.format("arrow_store").schema(..).option("path", ..)``; a narrower schema reads only its columns."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        system, root = opened(self.options["path"])
        for x in manifest(self.options["path"]):
            with system.open_input_file(f"{root}/{x['name']}") as source, pa.ipc.open_file(source) as file:
                return from_arrow_schema(file.schema)
        raise ValueError(f"no rows at {root}: give a schema")

    def reader(self, schema):
        return StoreReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return StoreWriter(self.options["path"], int(self.options.get("filerows", FILE_ROWS)))


def manifest(folder: str) -> list[dict]:
    system, root = opened(folder)
    with system.open_input_stream(f"{root}/{MANIFEST}") as f:
        return [json.loads(line) for line in f.read().decode().splitlines()]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_store(df: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Write a table; rows that are sorted or ranged by a column before make its filters skip files."""
    register(df.sparkSession)
    df.write.format(FORMAT).option("path", folder).option("fileRows", file_rows).mode("append").save()


def read_store(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """The table at ``folder``; ``schema`` (all columns if none) names those to read."""
    register(spark)
    reader = spark.read.format(FORMAT).option("path", folder)
    return (reader.schema(schema) if schema else reader).load()
