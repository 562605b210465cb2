"""One file per row, and folders listed whole: a Spark data source.

Spark's own file sources skip names that begin with ``_`` or ``.``, and its writers choose
file names themselves. This source lists every file of a folder, deals them over
partitions and reads them there; it writes each row's content to the file that the
row names. A file is replaced at once (written beside it, then moved), so a reader never
sees half of one, and a task that runs twice writes the same files twice.

It reaches the stores that pyarrow's file systems reach (local and mounted folders,
``hdfs://``, ``s3://``, ``gs://``); for others use Spark's readers (``listing="spark"`` in :mod:`parley.sources.files`).
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "named_files"
SCHEMA = "path string, name string, modificationTime timestamp, length bigint, content binary"
#: Files to a partition.
FILES = 256


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class NamedFilesReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.patterns = [p for p in options.get("patterns", "*").split(",") if p]

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, folder = _open(self.folder)
        found = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and any(fnmatch.fnmatchcase(f.base_name, p) for p in self.patterns)]
        found.sort()
        return [Files(found[i:i + FILES]) for i in range(0, len(found), FILES)]

    def read(self, part: Files | None) -> Iterator[tuple]:
        store, folder = _open(self.folder)
        root = "file:" if store.type_name == "local" else self.folder.rstrip("/").removesuffix(folder.rstrip("/"))
        for info in store.get_file_info(part.paths if part else []):
            with store.open_input_stream(info.path) as f:
                yield root + info.path, info.base_name, info.mtime, info.size, f.read()


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, folder = _open(self.folder)
        store.create_dir(folder, recursive=True)
        for row in rows:
            if not row["name"] or "/" in row["name"] or row["name"] in (".", ".."):
                raise ValueError(f"{row['name']!r} is no file name")
            content = row["content"]
            place = posixpath.join(folder, row["name"])
            beside = posixpath.join(folder, f".{uuid.uuid4().hex}.part")
            with store.open_output_stream(beside) as f:
                f.write(content.encode("utf-8") if isinstance(content, str) else bytes(content))
            store.move(beside, place)
        return WriterCommitMessage()


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NamedFilesReader:
        return NamedFilesReader(self.options)

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options)


def read_files(spark: SparkSession, folder: str, *patterns: str) -> DataFrame:
    """(path, name, modificationTime, length, content) of the files of a folder whose names match a pattern."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format(NAME).option("patterns", ",".join(patterns or ("*",))).load(folder)


def write_files(df: DataFrame, folder: str) -> None:
    """Write each row's ``content`` (text or bytes) to the file ``name`` of ``folder``. Names must differ."""
    df.sparkSession.dataSource.register(NamedFiles)
    df.select("name", "content").write.format(NAME).mode("append").save(folder)
