"""Files of points, pictures or any bytes at a path, written by the executors.

`files` is a Spark data source: rows (name, content) become files below the
path. A task writes under names of its own attempt, and the driver gives the
files their names when all tasks have ended, so a lost or repeated task leaves
nothing behind.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.held = posixpath.join(self.path, f"_held-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        store, at = _store(self.held)
        store.create_dir(at, recursive=True)
        names = []
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = posixpath.join(at, uuid.uuid4().hex)
                with store.open_output_stream(own) as out:
                    out.write(content)
                names.append((own, name))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        taken: set[str] = set()
        for m in messages:
            for own, name in m.names if m else []:
                if name in taken:
                    raise ValueError(f"two files of the name {name}")
                taken.add(name)
                store.move(own, posixpath.join(at, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, at = _store(self.held)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ocellus_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str) -> None:
    """Rows name, content as files below path. Names must differ."""
    files.sparkSession.dataSource.register(FilesSource)
    files.select("name", "content").write.format("ocellus_files").mode("append").save(path)


def write_points(points: DataFrame, path: str, kind: str, **options) -> None:
    """A file of points (pcd, las or sdc) for each partition, below path; options are encode_points'."""
    from ocellus.sources.readers import encode_points

    made = encode_points(points, kind, **options)
    write_files(made.selectExpr(f"concat('part-', lpad(cast(part AS string), 6, '0'), '.{kind}') AS name", "content"), path)
