"""Files of any size as Spark data sources: read in ranges, hashed chunk by chunk, written whole or not at all."""

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes that are held at a time, and of the range of a file that a task reads.
CHUNK, RANGE = 8 << 20, 256 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, by its scheme, and the path in it. A bare path is local, or a mount that all executors share."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(folder: str, suffix: str) -> list[tuple[str, int]]:
    system, at = opened(folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return sorted((scheme + f.path, f.size) for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(suffix.lower()))


@dataclass
class Range(InputPartition):
    path: str
    length: int
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".pdf")
        self.what, self.chunk, self.range = options.get("give", "digests"), int(options.get("chunkbytes", CHUNK)), int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Range]:
        """A file's ranges where its content is asked for; a hash goes through a file from its start, so there a file is one."""
        step = self.range if self.what == "chunks" else None
        return [Range(p, n, a, min(n, a + step) if step else n) for p, n in _listed(self.folder, self.suffix) for a in (range(0, max(n, 1), step) if step else (0,))]

    def read(self, part: Range) -> Iterator[tuple]:
        system, at = opened(part.path)
        with system.open_input_file(at) as f:
            f.seek(part.start)
            if self.what == "chunks":
                for start in range(part.start, max(part.stop, part.start + 1), self.chunk):
                    yield part.path, part.length, start, f.read(min(self.chunk, part.stop - start))
            else:
                digest = hashlib.sha256()
                while data := f.read(self.chunk):
                    digest.update(data)
                yield part.path, part.length, digest.hexdigest()


class _Placed(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """Files under passing names; the driver gives them their own once all tasks are done, or removes them."""

    def write(self, rows: Iterator[Row]) -> _Placed:
        made, path, out = [], None, None
        try:
            for row in rows:
                if row.path != path:
                    if out is not None:
                        out.close()
                    path = row.path
                    system, at = opened(path)
                    passing = f"{at}.{uuid.uuid4().hex}.part"
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    made.append((path, passing))
                    out = system.open_output_stream(passing)
                out.write(row.content)
            if out is not None:
                out.close()
        except BaseException:
            self._remove(made)
            raise
        return _Placed(made)

    def _remove(self, made: list[tuple[str, str]]) -> None:
        for path, passing in made:
            system, _ = opened(path)
            if system.get_file_info(passing).type == fs.FileType.File:
                system.delete_file(passing)

    def commit(self, messages: list) -> None:
        for m in messages:
            for path, passing in m.files if m else ():
                system, at = opened(path)
                system.move(passing, at)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m:
                self._remove(m.files)


class StoredFiles(DataSource):
    """Reading gives (path, length, sha256), or with give=chunks (path, length, start, content); writing takes (path, start, content)."""

    @classmethod
    def name(cls) -> str:
        return "stored_files"

    def schema(self) -> str:
        return "path string, length long, start long, content binary" if self.options.get("give") == "chunks" else "path string, length long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer()


def digests(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(path, length, sha256) of the files below a folder whose name ends in `suffix` (.pdf, in any letter case), of any size; a task holds one chunk."""
    spark.dataSource.register(StoredFiles)
    return spark.read.format("stored_files").options(path=folder, **options).load()


def chunks(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(path, length, start, content) of the files' chunks, large files in several tasks; an empty file is one empty chunk."""
    return digests(spark, folder, give="chunks", **options)


def write(parts: DataFrame) -> None:
    """Write files from their chunks (path, start, content). Each has its name only when all of them are whole; a run that is killed leaves none that is not.

    The chunks of one file are brought to one task, in order, and written as they come.
    """
    parts.sparkSession.dataSource.register(StoredFiles)
    parts.select("path", "start", "content").repartition("path").sortWithinPartitions("path", "start").write.format("stored_files").mode("append").save()
