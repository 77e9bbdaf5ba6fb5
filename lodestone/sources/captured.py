"""A Spark data source over captured search responses.

The files are `<path>/<keyword>/<page>.json`, the keyword percent-encoded (full stops too), pages numbered from 1. A partition holds
`keywordsPerPartition` keywords (1 unless given). A keyword's pages are read in order as long as there are results: the first
page without any is the last one that is read, as is one before a page that is missing, and the one whose number is the option
`pages`. A page that is no JSON object ends a keyword and is left out. Equality and IN filters on the keyword choose partitions
before anything is listed or read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from lodestone.sources.files import place

NAME = "lodestone_captured_search"
SCHEMA = "keyword string, page int, body string"
#: Bytes of pages that are handed on at once.
HELD = 1 << 22


@dataclass
class Keywords(InputPartition):
    keywords: tuple[str, ...]

    def __init__(self, keywords: tuple[str, ...]):
        super().__init__(keywords)
        self.keywords = keywords


class CapturedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return CapturedReader(self.options["path"], int(self.options.get("pages", "0")), int(self.options.get("keywordsPerPartition", "1")))


class CapturedReader(DataSourceReader):
    def __init__(self, path: str, pages: int, each: int):
        self.path, self.pages, self.each = path.rstrip("/"), pages, each
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("keyword",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Keywords]:
        store, root = place(self.path)
        if self.wanted is None:
            listed = [i.base_name for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory and not i.base_name.startswith(".")]
        else:
            found = store.get_file_info([f"{root}/{folder_of(k)}" for k in self.wanted if k]) if self.wanted - {None, ""} else []
            listed = [i.base_name for i in found if i.type == fs.FileType.Directory]
        names = sorted(map(unquote, listed))
        return [Keywords(tuple(names[i : i + self.each])) for i in range(0, max(1, len(names)), self.each)]

    def read(self, partition: Keywords) -> Iterator[pa.RecordBatch]:
        store, root = place(self.path)
        held: list[tuple[str, int, str]] = []
        size = 0
        for keyword in partition.keywords:
            for number, body in self.bodies(store, f"{root}/{folder_of(keyword)}"):
                held.append((keyword, number, body))
                size += len(body)
                if size >= HELD:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    def bodies(self, store: fs.FileSystem, folder: str) -> Iterator[tuple[int, str]]:
        number = 1
        while not self.pages or number <= self.pages:
            place_of = f"{folder}/{number}.json"
            if store.get_file_info(place_of).type != fs.FileType.File:
                return
            with store.open_input_stream(place_of) as file:
                body = file.read().decode("utf-8", "replace")
            try:
                response = json.loads(body)
            except ValueError:
                return
            if not isinstance(response, dict):
                return
            yield number, body
            if not isinstance(response.get("organic"), list) or not response["organic"]:
                return
            number += 1


def folder_of(keyword: str) -> str:
    return quote(keyword, safe="").replace(".", "%2E")


def batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    keywords, pages, bodies = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keywords, pa.string()), pa.array(pages, pa.int32()), pa.array(bodies, pa.string())], names=["keyword", "page", "body"])


def read_captured(spark: SparkSession, path: str, pages: int = 0, keywords_per_partition: int = 1) -> DataFrame:
    """keyword, page, body of the captured responses; pages 0 means all. Lets Spark hand filters to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedSearch)
    return spark.read.format(NAME).option("pages", pages).option("keywordsPerPartition", keywords_per_partition).load(path)


def file_name(keyword: Column, page: Column) -> Column:
    """Where the response for a page of a keyword lies."""
    folder = F.url_encode(keyword)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), (".", "%2E")):  # as folder_of has it
        folder = F.replace(folder, F.lit(a), F.lit(b))
    return F.concat(folder, F.lit("/"), page.cast("string"), F.lit(".json"))
