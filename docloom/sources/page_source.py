"""Pages of files as a Spark data source, batch and streaming: spark.read.format("docloom_pages").

Options: path (a folder, read recursively), parser (a name of files.PAGE_PARSERS, text-layer by default), suffixes,
filesPerPartition and archives (true: files in tar archives count as files). A row is a page: identity (path under the folder), name, hash (SHA-256 of the file), page (from 0), text. A
file that can't be read gives one row with page -1 and the error as its text. A partition is a group of files, dealt by bytes;
the driver lists files, executors open and parse them through pyarrow's file systems. A stream goes by modification
time and path, so files that are added or changed are read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docloom.sources.archives import SUFFIXES as ARCHIVES
from docloom.sources.archives import members

SCHEMA = "identity string, name string, hash string, page int, text string"
#: Bytes and files of a partition at most (one file at least).
PART_BYTES, PART_FILES = 64 << 20, 1000


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Pages:
    """Listing and reading, shared by the batch and the streaming reader."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.suffixes = tuple(options.get("suffixes", "pdf").lower().split(","))
        self.parser = options.get("parser", "text-layer")
        self.most = int(options.get("filesperpartition", PART_FILES))
        self.archives = ARCHIVES if options.get("archives", "false").lower() == "true" else ()

    def listed(self) -> list[tuple[int, str, int]]:
        """(modification time in microseconds, path, bytes) of the files with a parser, in this order."""
        system, base = arrow_fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(arrow_fs.FileSelector(base, recursive=True))
        return sorted((int(f.mtime.timestamp() * 1_000_000), f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and f.extension.lower() in (*self.suffixes, *self.archives) and not f.base_name.startswith(("_", ".")))

    def grouped(self, files: list[tuple[int, str, int]]) -> list[Files]:
        groups: list[list[str]] = []
        size = 0
        for _, path, n in files:
            if not groups or size + n > PART_BYTES or len(groups[-1]) >= self.most:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups]

    def contents(self, system: arrow_fs.FileSystem, base: str, paths: list[str]) -> Iterator[tuple[str, bytes]]:
        """Identity and bytes of the files, one at a time."""
        for path in paths:
            identity = path[len(base) :].lstrip("/")
            with system.open_input_stream(path) as stream:
                if identity.rsplit(".", 1)[-1].lower() not in self.archives:
                    yield identity, stream.read()
                    continue
                for name, content in members(stream):
                    if name.rsplit(".", 1)[-1].lower() in self.suffixes:
                        yield identity[: identity.rfind("/") + 1] + name, content

    def rows(self, partition: Files) -> Iterator[tuple]:
        from docloom.sources.files import PAGE_PARSERS

        parse = PAGE_PARSERS[self.parser]
        system, base = arrow_fs.FileSystem.from_uri(self.root)
        for identity, content in self.contents(system, base, partition.paths):
            about, name = hashlib.sha256(content).hexdigest(), identity.rsplit("/", 1)[-1]
            try:
                pages = parse(content)
            except Exception as error:  # one bad file must not end the scan of all
                yield identity, name, about, -1, f"{type(error).__name__}: {error}"
                continue
            for n, text in enumerate(pages):
                yield identity, name, about, n, text


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pages = _Pages(options)

    def partitions(self) -> list[Files]:
        return self.pages.grouped(self.pages.listed())

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.pages.rows(partition) if isinstance(partition, Files) else iter(())


class PageStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.pages.listed()
        return {"at": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, until = ((o["at"], o["path"]) for o in (start, end))
        return self.pages.grouped([f for f in self.pages.listed() if after < f[:2] <= until])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.pages.rows(partition)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> PageStream:
        return PageStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
