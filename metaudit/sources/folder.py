"""Folders of files as a Spark data source, for batches and streams: a row a file, with its attributes.

    spark.dataSource.register(FolderSource)
    spark.read.format("metaudit").option("tags", "00100010,00080060").load("/data/study")

Partitions hold whole files, up to ``files_per_partition`` of them and ``bytes_per_partition`` of what is read of
them; each opens one file system. With ``rows`` set to attributes there is a row for each attribute, and
conditions on ``tag`` are pushed into the reader where Spark is told to (spark.sql.python.filterPushdown.enabled
and the option ``pushdown``): values of other tags are not read. Options that begin with fs. go to Arrow's file
system of the path's kind; ``hadoop_options`` makes them of what Spark knows about a store.

A stream lists the folder and writes what is new to a numbered file of its ``log`` folder; that number is the
offset. So a batch that is run again reads the files that it read before, and a stream that starts again goes on
where it stopped. Partitions of a batch come from the log, not from the folder.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .scan import ATTRIBUTES, FIRST_BYTES, SCANNED, opened, read_outcome

FILES_PER_PARTITION, BYTES_PER_PARTITION = 4096, 64 << 20
#: Files whose rows are made at a time.
CHUNK = 256
PER_FILE = SCANNED.replace("file string,", "file string, relative_path string, size bigint,", 1)
PER_ATTRIBUTE = f"file string, {ATTRIBUTES}"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
_ATTRIBUTE = pa.struct([(f.split(" ")[0], _KINDS[f.split(" ")[1]]) for f in ATTRIBUTES.split(", ")])
_FILE = pa.schema([("file", pa.string()), ("relative_path", pa.string()), ("size", pa.int64()), ("outcome", pa.string()), ("reason", pa.string()), ("message", pa.string()), ("bytes_read", pa.int64()), ("attributes", pa.list_(_ATTRIBUTE))])


def file_system(root: str, options: dict[str, str]) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    kind, _, rest = root.partition("://") if "://" in root else ("file", "", re.sub("^file:/*", "/", root))
    own = {k[3:]: v for k, v in options.items() if k.startswith("fs.")}
    if kind in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem(**own), rest
    if kind == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", "/" + rest if root.startswith("file:") else rest)
    return fs.FileSystem.from_uri(root)


#: How Hadoop and Arrow name what gives access to an S3 store.
HADOOP_KEYS = {"fs.s3a.access.key": "access_key", "fs.s3a.secret.key": "secret_key", "fs.s3a.session.token": "session_token", "fs.s3a.endpoint": "endpoint_override", "fs.s3a.endpoint.region": "region"}


def hadoop_options(spark: SparkSession) -> dict[str, str]:
    """Options of this source for the access that Spark's Hadoop configuration gives."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return {f"fs.{name}": value for key, name in HADOOP_KEYS.items() if (value := conf.get(key))}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def planned(files: list[tuple[str, int]], most_files: int, most_bytes: int) -> list[Files]:
    """Files of a listing as partitions, in order. Of a file its first bytes count, as few are read of most."""
    out, own, held = [], [], 0
    for path, size in files:
        cost = min(size, FIRST_BYTES)
        if own and (len(own) >= most_files or held + cost > most_bytes):
            out.append(Files(own))
            own, held = [], 0
        own.append((path, size))
        held += cost
    return [*out, Files(own)] if own else out


class _Folder:
    """What readers of batches and streams share."""

    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.root = self.options["path"].rstrip("/")
        self.kind = self.root.partition("://")[0] + "://" if "://" in self.root else ""
        self.flat = self.options.get("rows") == "attributes"
        tags = self.options.get("tags")
        self.wanted = frozenset(t.strip() for t in tags.split(",")) if tags else None

    def listed(self) -> list[tuple[str, int]]:
        """(path, size) of all files below the root, sorted; names that begin with . or _ count as hidden."""
        where, path = file_system(self.root, self.options)
        found = where.get_file_info(fs.FileSelector(path, recursive=True))
        below = len(path.rstrip("/")) + 1
        hidden = lambda p: any(s[:1] in ("_", ".") for s in p[below:].split("/"))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))

    def plan(self, files: list[tuple[str, int]]) -> list[Files]:
        return planned(files, int(self.options.get("files_per_partition", FILES_PER_PARTITION)), int(self.options.get("bytes_per_partition", BYTES_PER_PARTITION)))

    def rows(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, path = file_system(self.root, self.options)
        above = len(path.rstrip("/").rpartition("/")[0])
        vrs = json.loads(self.options["vrs"]) if "vrs" in self.options else None
        for k in range(0, len(partition.files), CHUNK):
            some = partition.files[k : k + CHUNK]
            out = [(self.kind + f, f[above:].lstrip("/"), size, *read_outcome(lambda f=f: opened(f, where), vrs, self.wanted)) for f, size in some]
            if not self.flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _FILE, strict=True)], schema=_FILE)
                continue
            every = [(f, row) for f, *_, rows in out for row in rows or ()]
            if every:
                own = pa.array([row for _, row in every], _ATTRIBUTE)
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in every], pa.string()), *own.flatten()], ["file", *(f.name for f in _ATTRIBUTE)])


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)

    def partitions(self) -> list[Files]:
        return self.folder.plan(self.folder.listed()) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)


class PushingReader(FolderReader):
    """A reader of attributes that takes over conditions on their tags; Spark checks them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("tag",):
                tags = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.folder.wanted = tags if self.folder.wanted is None else self.folder.wanted & tags
            yield f


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.known, self.at = _Folder(options), set(), 0
        if "log" not in self.folder.options:
            raise ValueError("a stream needs a folder for its log: option log")
        self.where, self.log = file_system(self.folder.options["log"], self.folder.options)
        self.where.create_dir(self.log, recursive=True)

    def _read(self, number: int) -> list[tuple[str, int]] | None:
        path = f"{self.log}/{number:012d}.json"
        if self.where.get_file_info(path).type != fs.FileType.File:
            return None
        with self.where.open_input_stream(path) as f:
            return [tuple(x) for x in json.loads(f.read())]

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        while (files := self._read(self.at + 1)) is not None:  # of an earlier run, once
            self.known.update(p for p, _ in files)
            self.at += 1
        if new := [f for f in self.folder.listed() if f[0] not in self.known]:
            part = f"{self.log}/.{uuid.uuid4().hex}"
            with self.where.open_output_stream(part) as f:
                f.write(json.dumps(new).encode())
            self.where.move(part, f"{self.log}/{self.at + 1:012d}.json")
            self.known.update(p for p, _ in new)
            self.at += 1
        return {"number": self.at}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        files = [f for k in range(start["number"] + 1, end["number"] + 1) for f in self._read(k) or ()]
        return self.folder.plan(files) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metaudit"

    def schema(self) -> str:
        return PER_ATTRIBUTE if self.options.get("rows") == "attributes" else PER_FILE

    def reader(self, schema) -> DataSourceReader:
        flat = self.options.get("rows") == "attributes"
        return (PushingReader if flat and self.options.get("pushdown", "").lower() == "true" else FolderReader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(dict(self.options))


def _options(spark: SparkSession, vrs: dict[str, str] | None, tags, more: dict[str, str]) -> dict[str, str]:
    own = hadoop_options(spark)
    if vrs:
        own["vrs"] = json.dumps(vrs)
    if tags is not None:
        own["tags"] = ",".join(tags)
    return own | more


def read_folder(spark: SparkSession, root: str, vrs: dict[str, str] | None = None, tags=None, **options: str) -> DataFrame:
    """(file, relative_path, size, outcome, reason, message, bytes_read, attributes): a row for each file below ``root``, as ``scan`` gives it. ``tags``: the only ones that are wanted."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("metaudit").options(**_options(spark, vrs, tags, options)).load(root)


def read_attributes(spark: SparkSession, root: str, vrs: dict[str, str] | None = None, tags=None, **options: str) -> DataFrame:
    """The attribute rows of the files below ``root`` that can be read. Conditions on ``tag`` are pushed down if Spark's setting allows."""
    spark.dataSource.register(FolderSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("metaudit").options(rows="attributes", pushdown=pushes, **_options(spark, vrs, tags, options)).load(root)


def stream_folder(spark: SparkSession, root: str, log: str, vrs: dict[str, str] | None = None, **options: str) -> DataFrame:
    """``read_folder`` as a stream of the files that arrive; ``log`` is a folder that belongs to this stream."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("metaudit").options(log=log, **_options(spark, vrs, None, options)).load(root)
