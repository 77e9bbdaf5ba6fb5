"""A Spark data source that writes files under the names that rows give them.

Rows are (name, content). Each task writes whole files into a folder of its own beside the target, with a list of their names. After
all tasks, Spark reads the lists, and tasks rename what they name; the driver holds a row for each task, never one for each file.
So a task that fails or is run twice leaves nothing, and a file that is seen is whole. Names are relative, parted by slashes. Two
rows with one name fail the job before anything is renamed; so does a name that is there already, unless the write overwrites,
which replaces files of the same names and keeps the others. A null name fails, null content makes an empty file. (If the driver
dies amid the renames, the files renamed so far stay, each of them whole.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.functions.arrow import slices
from lodestone.sources.files import place
from lodestone.storage import arrow_batches

NAME = "lodestone_named_files"
SCHEMA = "name string, content string"
#: Rows that a writing task is handed at once; renames of a task that are under way together; names that a task takes from a list at once; bytes that it reads back at once.
ROWS_HELD, RENAMES, NAMES_HELD, BYTES_HELD = 64, 8, 4096, 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """Folder of a task; its files are numbered, and `names` has theirs in a line each."""

    folder: str


def checked(name: str | None) -> str:
    parts = (name or "").split("/")
    if not all(parts) or {".", ".."} & set(parts):
        raise ValueError(f"no relative file name: {name!r}")
    return name


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["staging"])


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[Row]) -> Written:
        own = uuid.uuid4().hex
        store, folder = place(f"{self.staging}/{own}")
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/names") as names:
            for k, row in enumerate(iterator):
                with store.open_output_stream(f"{folder}/{k}") as file:
                    file.write((row["content"] or "").encode())
                names.write(f"{json.dumps(checked(row['name']))}\n".encode())
        return Written(own)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staging = place(self.staging)
        store.create_dir(staging)
        with store.open_output_stream(f"{staging}/tasks") as file:
            file.write(json.dumps([m.folder for m in messages if m is not None]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        clear(self.staging)


def clear(staging: str) -> None:
    store, folder = place(staging)
    if store.get_file_info(folder).type != fs.FileType.NotFound:
        store.delete_dir(folder)


def listed(spark, staging: str) -> DataFrame:
    """at, name of the files that tasks have written, a partition for each task."""
    store, folder = place(staging)
    with store.open_input_stream(f"{folder}/tasks") as file:
        tasks = json.loads(file.read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in (n for b in batches for n in b.column(0).to_pylist()):
            store, own = place(f"{staging}/{tasks[n]}")
            with store.open_input_file(f"{own}/names") as file:
                names = [json.loads(line) for line in file.read().splitlines()]
            for a in range(0, len(names), NAMES_HELD):
                some = names[a : a + NAMES_HELD]
                yield pa.RecordBatch.from_arrays([pa.array([f"{own}/{a + k}" for k in range(len(some))], pa.string()), pa.array(some, pa.string())], names=["at", "name"])

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(read, "at string, name string")


def publish(spark, staging: str, path: str, overwrite: bool) -> None:
    """Rename what tasks have written, unless two files have one name."""
    files = listed(spark, staging)

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, target = place(path)
        for batch in batches:
            names = batch.column("name").to_pylist()
            found = store.get_file_info([f"{target}/{n}" for n in names])
            yield pa.RecordBatch.from_arrays([pa.array([n for n, i in zip(names, found) if i.type != fs.FileType.NotFound], pa.string())], names=["name"])

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, target = place(path)
        made = set()

        def move(at: str, name: str) -> None:
            try:
                store.move(at, f"{target}/{name}")
            except FileNotFoundError:  # an earlier attempt of this task has moved it
                if store.get_file_info(f"{target}/{name}").type != fs.FileType.File:
                    raise

        with ThreadPoolExecutor(RENAMES) as pool:
            for batch in batches:
                pairs = list(zip(batch.column("at").to_pylist(), batch.column("name").to_pylist()))
                for folder in {f"{target}/{n}".rsplit("/", 1)[0] for _, n in pairs} - made:
                    store.create_dir(folder)
                    made.add(folder)
                list(pool.map(move, *zip(*pairs)))
                yield pa.RecordBatch.from_arrays([pa.array([len(pairs)], pa.int64())], names=["n"])

    bad = files.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name").limit(10).collect()
    bad = bad or ([] if overwrite else files.mapInArrow(there, "name string").limit(10).collect())
    if bad:
        raise ValueError(f"files of one name: {[r['name'] for r in bad]}")
    files.mapInArrow(rename, "n long").agg(F.sum("n")).collect()


def write_named_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows(name, content) as files under path."""
    spark, path = rows.sparkSession, path.rstrip("/")
    spark.dataSource.register(NamedFiles)
    staging = f"{path}/.writing-{uuid.uuid4().hex}"
    try:
        with arrow_batches(spark, ROWS_HELD):  # contents cross to Python whole
            rows.select("name", "content").write.format(NAME).option("staging", staging).mode("overwrite" if overwrite else "append").save(path)
        publish(spark, staging, path, overwrite)
    finally:
        clear(staging)


def read_named_files(names: DataFrame, path: str) -> DataFrame:
    """name, content of the files under path that names(name) tells; one that is missing fails. Nothing is listed: hidden and empty files count as others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, target = place(path)
        for batch in slices(batches, ROWS_HELD):
            held, size = [], 0
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{target}/{checked(name)}") as file:
                    held.append((name, file.read().decode("utf-8", "replace")))
                size += len(held[-1][1])
                if size >= BYTES_HELD:
                    yield of_rows(held)
                    held, size = [], 0
            if held:
                yield of_rows(held)

    def of_rows(held: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=["name", "content"])

    return names.select("name").mapInArrow(read, SCHEMA)
