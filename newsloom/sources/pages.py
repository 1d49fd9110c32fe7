"""A Spark data source for folders of fetched bodies: one file a page, one partition a group of files.

spark.dataSource.register(FetchedPages); spark.read.format("fetched_pages").load(folder)
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "url string, method string, status int, content binary, error string"
_KINDS = {".xml": "sitemap", ".rss": "feed", ".atom": "feed", ".json": "json"}


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, folder: str, per_partition: int):
        self.folder, self.per_partition = folder, per_partition

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.path.join(d, f) for d, _, files in os.walk(self.folder) for f in files if not f.startswith(("_", ".")))
        return [_Files(names[k : k + self.per_partition]) for k in range(0, len(names), self.per_partition)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.names:
            url = "https://" + os.path.relpath(name, self.folder)
            plain = name.removesuffix(".gz")
            try:
                with open(name, "rb") as file:
                    yield url, _KINDS.get(os.path.splitext(plain)[1], "section"), 200, file.read(), None
            except OSError as problem:  # a page that can't be read is a row, like a failed fetch
                yield url, None, 0, None, type(problem).__name__


class _Done(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> WriterCommitMessage:
        for row in rows:
            target = os.path.join(self.folder, row["url"].removeprefix("https://"))
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target + ".part", "wb") as file:
                file.write(row["content"] or b"")
            os.replace(target + ".part", target)  # a page is there whole or not at all
        return _Done()


class FetchedPages(DataSource):
    """Option files_per_partition (1000): files that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("files_per_partition", 1000)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])
