"""A sink for files as rows: ``df.write.format("filetree")`` with columns ``path`` and ``content``.

Every task writes into a folder of its own below the job's hidden one; when the job commits, the driver merges the folders of the tasks that
succeeded into the target and removes the rest. It is told tasks, not files, and a folder that the target lacks is renamed whole where the file system can. Paths are relative to the target, which
may be in any file system that ``pyarrow.fs`` opens and that all executors see. A path that comes twice
keeps one of its contents; a path that leaves the target is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _merge(fs: pa.fs.FileSystem, source: str, target: str) -> None:
    """Move what is below ``source`` to ``target``; files replace those of their names."""
    todo = [(source, target)]
    while todo:
        source, target = todo.pop()
        fs.create_dir(target, recursive=True)
        for entry in fs.get_file_info(pa.fs.FileSelector(source)):
            place = f"{target}/{entry.base_name}"
            whole = entry.is_file or (fs.type_name in ("local", "hdfs") and fs.get_file_info(place).type == pa.fs.FileType.NotFound)
            if whole:
                fs.move(entry.path, place)
            else:
                todo.append((entry.path, place))


@dataclass
class _Written(WriterCommitMessage):
    task: str


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.job = f".job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _open(self.path)
        task = uuid.uuid4().hex
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} leaves the target folder")
                place = f"{root}/{self.job}/{task}/{path}"
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(place, compression=None) as out:
                    out.write(content)
        return _Written(task)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            own = f"{root}/{self.job}/{m.task}" if m is not None else ""
            if own and fs.get_file_info(own).type == pa.fs.FileType.Directory:
                _merge(fs, own, root)
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class TreeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(dict(self.options))


def write(files: DataFrame, folder: str) -> None:
    """Write ``files(path, content)`` below ``folder``."""
    files.sparkSession.dataSource.register(TreeSink)
    files.select("path", "content").write.format("filetree").mode("append").save(folder)
