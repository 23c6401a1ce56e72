"""Reports written by executors, one file for each row, all of a run or none of it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


class ReportFiles(ds.DataSource):
    """Rows (name, body) become files ``name`` in the folder of option ``path``. Tasks write into a folder beside it, each attempt
    under its own names; once all are through, the attempts that counted are moved into place and the folder takes the place of
    the one before. A run that fails leaves the folder as it was and nothing beside it. Two rows of one name are an error."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceWriter:
        if [f.name for f in schema.fields] != ["name", "body"]:
            raise ValueError("reports have the columns name and body")
        return ReportWriter(self.options["path"].rstrip("/"))


@dataclass
class Written(ds.WriterCommitMessage):
    folder: str
    names: list[str]


class ReportWriter(ds.DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path
        head, _, tail = path.rpartition("/")
        self.stage = f"{head}/.{tail}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        """One attempt of a task, in a folder of its own, so that an attempt that is given up leaves nothing among the files that count."""
        task = TaskContext.get()
        folder, names = f"{task.partitionId()}-{task.taskAttemptId()}", []
        store, stage = _store(self.stage)
        store.create_dir(f"{stage}/{folder}", recursive=True)
        for row in iterator:
            if "/" in row.name or row.name in ("", ".", ".."):
                raise ValueError(f"no name of a file: {row.name!r}")
            with store.open_output_stream(f"{stage}/{folder}/{row.name}") as f:
                f.write((row.body or "").encode())
            names.append(row.name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, stage = _store(self.stage)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two reports have one name")
        store.create_dir(f"{stage}/all", recursive=True)
        for m in done:
            for n in m.names:
                store.move(f"{stage}/{m.folder}/{n}", f"{stage}/all/{n}")
        path = _store(self.path)[1]
        old = f"{stage}/old"
        if store.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
            store.move(path, old)
        store.move(f"{stage}/all", path)
        store.delete_dir(stage)

    def abort(self, messages: list[Written | None]) -> None:
        store, stage = _store(self.stage)
        if store.get_file_info(stage).type != pyarrow.fs.FileType.NotFound:
            store.delete_dir(stage)
