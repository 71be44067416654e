"""A Python data source for paged interfaces: pages are partitions, so they are fetched in parallel."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        module, _, name = options["fetch"].rpartition(".")
        self.fetch = getattr(importlib.import_module(module), name)
        self.pages, self.options = int(options.get("pages", "1")), dict(options)

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.fetch(partition.number, self.options)


class PagedSource(DataSource):
    """Options fetch (dotted name of fetch(page, options) -> tuples), pages and schema."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def counted(page: int, options: dict) -> Iterator[tuple]:
    """An example of fetch: rows_per_page rows (page, row)."""
    return ((page, i) for i in range(int(options.get("rows_per_page", "3"))))
