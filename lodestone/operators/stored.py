"""Stored tables in buckets of their address: changes rewrite the buckets they touch, all tables of a change become visible at once.

A table's rows lie as Parquet in `<path>/<table>/<change>/bucket=<n>`, n being the hash of the address modulo `buckets`. The
file `<path>/versions/<version>.json` says for every table which change's bucket holds. A change reads and writes the
buckets of its addresses only, in a folder of its own, then writes the next version file under a name that must not be there
yet: of two writers one fails, and whoever reads sees all of a change or nothing. Older buckets, and those of changes that
failed, stay until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import store
from lodestone.storage import delete

RESULTS = "url string, keyword string, domain string, title string, snippet string, serp_position int, serp_page int, status string, created_at timestamp, word_count int, is_crawled int, source_url string"
#: The tables, and the column of each that holds the page's address.
TABLES = {
    "results": ("url", RESULTS),
    "history": ("url", "url string, keyword string, serp_position int, title string, recorded_at timestamp"),
    "headings": ("url", "url string, keyword string, ordinal int, tag string, text string"),
    "links": ("source_url", "source_url string, keyword string, ordinal int, obl_url string, anchor_text string"),
}


class StoredTables:
    """The tables under a path, opened at their latest version for each call."""

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, tuple[str, str]] = TABLES, buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), dict(tables), buckets

    def _file(self, path: str):
        hadoop_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path

    def version(self) -> int:
        """The latest version; 0 before the first change."""
        files, folder = self._file(f"{self.path}/versions")
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def snapshot(self, version: int | None = None) -> dict:
        """tables (for each, the change that wrote a bucket) and notes of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {t: {} for t in self.tables}, "notes": {}}
        text = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def bucket(self, address: Column) -> Column:
        return F.pmod(F.xxhash64(address), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows of a table, of all buckets or those given."""
        held = self.snapshot(version)["tables"][table]
        wanted = held if buckets is None else [b for b in map(str, buckets) if b in held]
        schema = self.tables[table][1]
        paths = [f"{self.path}/{table}/{held[b]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, changes: DataFrame, address: str = "url") -> list[int]:
        """Buckets of the addresses, `buckets` numbers at most."""
        return sorted(r[0] for r in changes.select(self.bucket(F.col(address)).alias("b")).distinct().collect())

    def commit(self, contents: Mapping[str, DataFrame], buckets: Sequence[int], based_on: int, notes: Mapping[str, object] | None = None) -> int:
        """Put contents in place of the given buckets of their tables. Fails if a version after based_on is there."""
        old, new = self.snapshot(based_on), based_on + 1
        change = f"{new}-{uuid.uuid4().hex[:12]}"
        tables = {t: dict(held) for t, held in old["tables"].items()}
        for table, rows in contents.items():
            address = self.tables[table][0]
            folder = f"{self.path}/{table}/{change}"
            placed = rows.withColumn("bucket", self.bucket(F.col(address)))
            placed.repartition(max(1, len(buckets)), "bucket").write.partitionBy("bucket").parquet(folder)
            files, hadoop_folder = self._file(folder)
            filled = {s.getPath().getName().removeprefix("bucket=") for s in files.listStatus(hadoop_folder) if s.isDirectory()}
            for b in map(str, buckets):  # a bucket that became empty goes
                tables[table].pop(b, None)
            if stray := filled - set(map(str, buckets)):
                raise ValueError(f"rows of {table} outside the buckets of the change: {sorted(stray)}")
            tables[table] |= {b: change for b in filled}
        self._publish(new, {"tables": tables, "notes": old["notes"] | dict(notes or {})})
        return new

    def _publish(self, version: int, content: dict) -> None:
        files, target = self._file(f"{self.path}/versions/{version}.json")
        _, draft = self._file(f"{self.path}/versions/.{version}-{id(content)}.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another change")

    def upsert(self, new: DataFrame, now: Column, batch: int | None = None) -> int:
        """Merge new results, with history; one row for each (url, keyword). A batch number that was merged before changes nothing."""
        version = self.version()
        if batch is not None and self.snapshot(version)["notes"].get("batch", -1) >= batch:
            return version
        buckets = self.touched(new)
        if not buckets:
            return version
        table, changed = store.upsert_results(self.read("results", buckets, version), new, now)
        history = self.read("history", buckets, version).unionByName(changed)
        return self.commit({"results": table, "history": history}, buckets, version, None if batch is None else {"batch": batch})

    def replace_children(self, table: str, parents: DataFrame, items: str, fields: Sequence[str]) -> int:
        """Children of parents(url, keyword, items: array of structs) in place of their old ones."""
        address, version = self.tables[table][0], self.version()
        buckets = self.touched(parents)
        if not buckets:
            return version
        own = parents.withColumnRenamed("url", address) if address != "url" else parents
        rows = store.replace_children(self.read(table, buckets, version), own, items, [address, "keyword"], fields)
        return self.commit({table: rows}, buckets, version)

    def delete(self, gone: DataFrame) -> int:
        """Delete what belongs to gone(url, keyword) from all tables, in one change."""
        version, buckets = self.version(), self.touched(gone)
        if not buckets:
            return version
        return self.commit(store.cascade_delete({t: self.read(t, buckets, version) for t in self.tables}, gone), buckets, version)

    def vacuum(self) -> None:
        """Delete buckets and version files that the latest version doesn't need. No one may be reading older ones."""
        latest = self.version()
        held = self.snapshot(latest)["tables"]
        for table in self.tables:
            needed = {(change, f"bucket={b}") for b, change in held[table].items()}
            self._delete_others(f"{self.path}/{table}", lambda change, b, needed=needed: (change, b) in needed)
        files, folder = self._file(f"{self.path}/versions")
        for s in files.listStatus(folder):
            if s.getPath().getName() != f"{latest}.json":
                files.delete(s.getPath(), False)

    def _delete_others(self, folder: str, needed: Callable[[str, str], bool]) -> None:
        files, top = self._file(folder)
        if not files.exists(top):
            return
        for version in files.listStatus(top):
            name = version.getPath().getName()
            for part in files.listStatus(version.getPath()):
                if part.isDirectory() and not needed(name, part.getPath().getName()):
                    delete(self.spark, part.getPath().toString())
