"""A writer of one named file a directory, as the scans of earlier rounds expect them.

Spark's own JSON and CSV writers give part files of lines. Here each directory gets one
file: an array of JSON objects, or a sheet with one header. Tasks write to a folder of
their own beside the files; a commit moves finished files into place, so a file is the old
one or the new one, whole, whatever fails. Files of directories without rows are left.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyarrow import fs as filesystems
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark.package import ship


def filesystem(path: str) -> tuple[filesystems.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return filesystems.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if ":/" in path:
        return filesystems.FileSystem.from_uri(path)
    return filesystems.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is, and where it belongs


class DirectoryWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.options, self.folder = dict(options), f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches) -> Written:
        """Rows (directory, line) sorted by directory; a null line only makes sure of the file."""
        o, attempt = self.options, uuid.uuid4().hex
        system, root = filesystem(o["path"])
        done: list[tuple[str, str]] = []
        out, now, first = None, None, True

        def close():
            if out is not None:
                out.write(o["foot"].encode())
                out.close()

        try:
            for batch in batches:
                for directory, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if out is None or directory != now:
                        close()
                        at = posixpath.join(root, self.folder, attempt, str(len(done)))
                        system.create_dir(posixpath.dirname(at), recursive=True)
                        out, now, first = system.open_output_stream(at), directory, True
                        done.append((at, posixpath.join(root, directory, o["file"])))
                        out.write(o["head"].encode())
                    if line is not None:
                        out.write((("" if first else o["between"]) + line).encode())
                        first = False
            close()
        except BaseException:
            if out is not None:
                out.close()
            raise
        return Written(done)

    def commit(self, messages) -> None:
        system, root = filesystem(self.options["path"])
        for message in messages:
            for at, to in message.files if message else []:
                system.create_dir(posixpath.dirname(to), recursive=True)
                if not isinstance(system, filesystems.LocalFileSystem) and system.get_file_info(to).type != filesystems.FileType.NotFound:
                    system.delete_file(to)  # where a move does not replace
                system.move(at, to)
        self.abort(messages)

    def abort(self, messages) -> None:
        system, root = filesystem(self.options["path"])
        folder = posixpath.join(root, self.folder)
        if system.get_file_info(folder).type != filesystems.FileType.NotFound:
            system.delete_dir(folder)


class DirectoryFiles(DataSource):
    """``format("tidemark_directories")``; options path, file, head, between and foot."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_directories"

    def writer(self, schema, overwrite: bool) -> DirectoryWriter:
        return DirectoryWriter(self.options)


def write_lines(df: DataFrame, path: str, directory: Column, order: list[str], line: Column, file: str, head: str, between: str, foot: str) -> None:
    """One file a directory, its lines in order. A directory is written by one task, as a stream."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(DirectoryFiles)
    rows = df.select(directory.cast("string").alias("__directory"), line.alias("__line"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    rows = rows.repartition("__directory").sortWithinPartitions("__directory", *[f"__o{i}" for i in range(len(order))])
    options = {"path": path, "file": file, "head": head, "between": between, "foot": foot}
    rows.select("__directory", "__line").write.format("tidemark_directories").options(**options).mode("append").save()


def write_arrays(df: DataFrame, path: str, directory: Column, order: list[str], file: str = "events.json") -> None:
    """A JSON array a directory, of all columns but those of ``order`` that start with an underscore."""
    shown = [c for c in df.columns if not c.startswith("_")]
    line = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    write_lines(df, path, directory, order, F.when(~F.coalesce(F.col("_empty"), F.lit(False)), line) if "_empty" in df.columns else line, file, "[\n", ",\n", "\n]\n")


def write_tables(df: DataFrame, path: str, directory: Column, order: list[str], file: str = "review_sheet.csv") -> None:
    """A CSV sheet with a header a directory, of all columns but those that start with an underscore."""
    shown = [c for c in df.columns if not c.startswith("_")]
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cell = lambda c: F.when(text(c).rlike('[",\r\n]|^\\s|\\s$'), quoted(text(c))).otherwise(text(c))
    write_lines(df, path, directory, order, F.concat_ws(",", *[cell(c) for c in shown]), file, ",".join(shown) + "\n", "\n", "\n")
