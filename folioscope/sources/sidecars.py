"""A data source for what runs leave behind: one folder a document, with small JSON files in it.

    spark.dataSource.register(Sidecars)
    spark.read.format("sidecars").schema(...).option("name", "phase1.json").load(root)
    df.write.format("sidecars").option("name", "result.json").mode("append").save(root)

``doc_id`` is the folder; the other columns are fields of the file.  Conditions on ``doc_id``
are pushed down: folders that they rule out are not opened, and where they name the folders the
root isn't listed either.  Folders whose names begin with ``_`` are left out.  A field that is
missing or of another kind is null; a file that isn't a JSON object gives nulls alone.

A written file is put in place by a rename, so it is there whole or not at all, and a task that
runs again replaces it by the same.  Paths are what Arrow's file systems reach (local or
mounted folders, hdfs, s3, gs); ``scan.sidecars`` reads the same files through Spark's own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

#: Folders that a task reads.
FOLDERS_A_TASK = 256
KEY = "doc_id"


def file_system(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" in path:
        return FileSystem.from_uri(path)
    return LocalFileSystem(), path.removeprefix("file:")


def fits(value, kind: DataType):
    """``value`` as it stands in a column of that type; null where it is of another kind."""
    name = kind.typeName()
    if name == "struct":
        return {f.name: fits(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if name == "array":
        return [fits(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if name == "string":
        return value if isinstance(value, str) else None
    if name == "boolean":
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if name in ("double", "float"):
        return float(value)
    low = 1 << {"byte": 7, "short": 15, "integer": 31, "long": 63}[name]
    return value if isinstance(value, int) and -low <= value < low else None


@dataclass
class Folders(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, root: str, name: str, batch: int):
        self.schema, self.root, self.name, self.batch = schema, root, name, batch
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, IsNotNull)
        for f in filters:
            inner = f.child if isinstance(f, Not) and isinstance(f.child, (EqualTo, In)) else f
            if isinstance(inner, known) and inner.attribute == (KEY,):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, name: str) -> bool:
        def one(f: Filter) -> bool:
            match f:
                case Not():
                    return not one(f.child)
                case EqualTo():
                    return name == f.value
                case In():
                    return name in f.value
                case StringStartsWith():
                    return name.startswith(f.value)
                case IsNotNull():
                    return True
                # strings are compared by their bytes, as the engine does
                case GreaterThan():
                    return name.encode() > f.value.encode()
                case GreaterThanOrEqual():
                    return name.encode() >= f.value.encode()
                case LessThan():
                    return name.encode() < f.value.encode()
                case LessThanOrEqual():
                    return name.encode() <= f.value.encode()
            raise ValueError(f)

        return not name.startswith("_") and all(map(one, self.tests))

    def folders(self) -> list[str]:
        named = [[f.value] if isinstance(f, EqualTo) else list(f.value) for f in self.tests if isinstance(f, (EqualTo, In))]
        if named:
            found = sorted({n for n in min(named, key=len) if isinstance(n, str)})
        else:
            from pyarrow.fs import FileSelector, FileType

            fs, root = file_system(self.root)
            found = sorted(i.base_name for i in fs.get_file_info(FileSelector(root, allow_not_found=True)) if i.type == FileType.Directory)
        return [n for n in found if self._passes(n)]

    def partitions(self) -> list[InputPartition]:
        found = self.folders()
        # an empty list would be taken for a source without partitions
        return [Folders(found[i : i + self.batch]) for i in range(0, len(found), self.batch)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(self.root)
        rows = []
        for folder in partition.names:
            try:
                with fs.open_input_stream(f"{root}/{folder}/{self.name}") as f:
                    text = f.read()
            except FileNotFoundError:
                continue
            try:
                data = json.loads(text)
            except ValueError:
                data = None
            data = data if isinstance(data, dict) else {}
            rows.append([folder if f.name == KEY else fits(data.get(f.name), f.dataType) for f in self.schema.fields])
        schema = to_arrow_schema(self.schema)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: int


class Writer(DataSourceWriter):
    def __init__(self, root: str, name: str):
        self.root, self.name = root, name

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        fs, root = file_system(self.root)
        n = 0
        for row in rows:
            data = row.asDict(recursive=True)
            folder = data.pop(KEY)
            if not folder or folder.startswith(("_", ".")) or "/" in folder:
                raise ValueError(f"{KEY} {folder!r} can't name a folder")
            fs.create_dir(f"{root}/{folder}", recursive=True)
            place = f"{root}/{folder}/{self.name}"
            part = f"{place}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(json.dumps({k: v for k, v in data.items() if v is not None}, ensure_ascii=False).encode())
            fs.move(part, place)
            n += 1
        return Written(n)


class Sidecars(DataSource):
    """Options: ``path`` (the root), ``name`` (of the file in each folder), ``folders`` (that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "sidecars"

    def schema(self) -> str:
        return f"{KEY} string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options["path"].rstrip("/"), self.options["name"], int(self.options.get("folders", FOLDERS_A_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("sidecars are added to a root or replaced one by one: mode append")
        return Writer(self.options["path"].rstrip("/"), self.options["name"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Sidecars)
