"""Files in tar archives: many small files as few large ones, that executors write and read member by member.

A folder and a file a document cost several calls of the file system each, on write, listing and read; an archive of some
MOST bytes costs them once. Members keep their own paths and bytes, and equal paths stay files of their own.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docloom.io import small_batches

SUFFIXES = ("tar", "tgz")
#: Bytes of an archive's members (one member at least), and of the members that go on together when it is read.
MOST, BATCH = 16 << 20, 4 << 20


def members(stream: BinaryIO) -> Iterator[tuple[str, bytes]]:
    """Path and bytes of an archive's files, in its order."""
    with tarfile.open(fileobj=stream, mode="r|*") as tar:
        for member in tar:
            if member.isfile():
                yield member.name, tar.extractfile(member).read()
            tar.members = []  # else it keeps all that it has passed


def write_archives(files: DataFrame, folder: str, most: int = MOST) -> None:
    """Rows of path (string) and content (binary) as archives under folder, each task's its own.

    An archive gets its name when it is whole. A task that runs again writes the same names, so its partition must hold the same rows.
    """
    small_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = arrow_fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task, done = TaskContext.get(), 0
        held: list[tuple[str, bytes]] = []

        def save() -> None:
            nonlocal done
            name, buffer = f"part-{task.partitionId():05d}-{done:05d}.tgz", io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as tar:
                for path, content in held:
                    about = tarfile.TarInfo(path)
                    about.size = len(content)
                    tar.addfile(about, io.BytesIO(content))
            unfinished = f"{base}/.{name}-{task.taskAttemptId()}"
            with system.open_output_stream(unfinished) as out:
                out.write(buffer.getbuffer())
            system.move(unfinished, f"{base}/{name}")
            held.clear()
            done += 1

        size = 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                if held and size + len(content.as_buffer()) > most:
                    save()
                    size = 0
                held.append((path.as_py(), content.as_py()))
                size += len(held[-1][1])
        if held:
            save()
        yield pa.RecordBatch.from_pydict({"archives": pa.array([done], pa.int64())})

    files.select("path", "content").mapInArrow(run, "archives long").write.format("noop").mode("overwrite").save()
    system, base = arrow_fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)  # no rows, no task


def open_archives(files: DataFrame) -> DataFrame:
    """identity and content of files, an archive replaced by its members, whose paths are taken from the archive's folder."""
    small_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[str, bytes]] = []
            size = 0
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                inner = place.lower().endswith(tuple(f".{s}" for s in SUFFIXES))
                folder = place[: place.rfind("/") + 1]
                own = ((folder + name, data) for name, data in members(pa.BufferReader(content.as_buffer()))) if inner else [(place, content.as_py())]
                for row in own:
                    held.append(row)
                    size += len(row[1])
                    if size > BATCH:
                        yield _batch(held)
                        held, size = [], 0
            if held:
                yield _batch(held)

    return files.select("identity", "content").mapInArrow(run, "identity string, content binary")


def _batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["identity", "content"])
