"""Tables that cut lineage, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Paths of scratch tables that were made within scratch_removed_on_failure().
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop removes it when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def materialise(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it survives lost executors and is computed once."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if free:
        free_shuffles(spark)
    table = spark.read.schema(schema).parquet(path)
    table._scratch_path = path
    return table


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() whose last reader has written what it made of them."""
    for table in tables:
        delete(table.sparkSession, table._scratch_path)


@contextmanager
def scratch_removed_on_failure(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables that this thread makes within it are deleted if it ends by an exception. Gives their paths."""
    made: list[str] = []
    before = _made.set(made)
    try:
        yield made
    except BaseException:
        for path in made:
            delete(spark, path)
        raise
    finally:
        _made.reset(before)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more; it does so after a collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_batches(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Within it, plans that are run hand at most so many rows at once to Python."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within it, plans that are run have the setting."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)
