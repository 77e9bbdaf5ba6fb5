"""Exact deduplication with keyed streaming state.

Rows are fingerprinted once (SHA-256 of the normalised text, stable identifier, content locator) into a table in
the shared folder. A streaming aggregation reads that table and keeps, per digest and without expiry, the largest
identifier, its locator and a count in RocksDB. keep_id and group_size come from that state. Where a digest was hit more than
once, the locator is followed: the full normalised bytes of all its rows are held against those of the row that the state
names. Only digests under which other bytes are found leave that path; their texts are told apart by the bytes.

Digests with a thousandth of all rows or more are a thousand at most; they are broadcast, so no task gathers their rows.

Null text counts as empty; a null doc_id groups like any other but is kept only if its whole group has none.
Rows that repeat a doc_id count each, and all rows of the staying doc_id stay. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import discard, materialise, scratch_path
from lodestone.llm.text import lower_ascii

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # many small stores: no space is claimed beforehand, and a batch writes its changes rather than whole snapshots
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


#: A digest with this share of all rows is hot; there are no more than its inverse.
HOT_SHARE = 1e-3


def sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def contents(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, body (normalised text), locator (file and identifier), text_sha256 of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"),
        F.concat_ws("#", F.input_file_name(), F.col("doc_id").cast("string")).alias("locator"),
    )
    return rows.withColumn("text_sha256", digest(F.col("body")))


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, text_sha256, locator of every row."""
    return contents(docs, digest).select("doc_id", "text_sha256", "locator")


def update_state(prints: DataFrame, state_path: str, prints_path: str) -> DataFrame:
    """Run the stateful stream over the rows that it has not seen; return the state: text_sha256, keep_id, locator, n_rows.

    A later call with the same two paths goes on where this one ended.
    """
    spark = prints.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            spark.readStream.schema(prints.schema)
            .parquet(prints_path)
            .withColumn("digest", F.unhex("text_sha256"))
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "locator")).alias("kept"), F.count(F.lit(1)).alias("n_rows"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state_path)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(state_path)
        fields = state.schema["value"].dataType.names
        return state.select(
            F.lower(F.hex(state["key"]["digest"])).alias("text_sha256"),
            state["value"][fields[0]]["doc_id"].alias("keep_id"),
            state["value"][fields[0]]["locator"].alias("locator"),
            state["value"][fields[1]].alias("n_rows"),
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_hits(rows: DataFrame, hits: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """rows joined (left or inner) with the state of their digests; rows of hot digests stay where they are."""
    hot = F.broadcast(hot)  # 1 / HOT_SHARE rows at most
    # both sides grow with the documents: merged at every size
    rest = rows.join(hot, "text_sha256", "left_anti").join(hits.join(hot, "text_sha256", "left_anti").hint("merge"), "text_sha256", how)
    return rest.unionByName(rows.join(hot, "text_sha256"))


def other_bytes(docs: DataFrame, hits: DataFrame, hot: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """text_sha256 of the digests under which some row's bytes are not those at the locator that the state has."""
    joined = with_hits(contents(docs, digest), hits.select("text_sha256", F.col("locator").alias("stored")), hot.select("text_sha256", F.col("locator").alias("stored")), "inner")
    # equal bytes of a digest meet in one group, those at the locator among them
    classes = joined.groupBy("text_sha256", "body").agg(F.max(F.col("locator") == F.col("stored")).alias("at_locator"))
    return classes.filter(~F.col("at_locator")).select("text_sha256").distinct()


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    prints_path = scratch_path(spark, "fingerprints")
    fingerprints(docs, digest).write.parquet(prints_path)
    prints = spark.read.schema(fingerprints(docs, digest).schema).parquet(prints_path)
    state = update_state(prints, scratch_path(spark, "dedup-state"), prints_path)

    hits = materialise(state.filter("n_rows > 1"), "dedup-hits")
    hot = materialise(hits.filter(F.col("n_rows") >= F.lit(HOT_SHARE * prints.count())), "dedup-hot")
    clashes = materialise(other_bytes(docs, hits, hot, digest), "dedup-clashes")
    rows = prints.select("doc_id", "text_sha256")
    if clashes.isEmpty():
        known = ["text_sha256", "keep_id", "n_rows"]
        joined = with_hits(rows, hits.select(*known), hot.select(*known), "left")
        discard(clashes)
    else:  # texts that share a digest are grouped by their bytes
        clashing = contents(docs, digest).join(clashes, "text_sha256", "left_semi").select("doc_id", "text_sha256", "body")
        by_bytes = clashing.groupBy("text_sha256", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))
        apart = clashing.join(by_bytes, ["text_sha256", "body"]).drop("body")
        alike = rows.join(clashes, "text_sha256", "left_anti").join(hits.select("text_sha256", "keep_id", "n_rows"), "text_sha256", "left")
        joined = alike.unionByName(apart)
    keep = F.when(F.col("n_rows").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n_rows", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps; of rows alike in doc_id and normalised text the one that is first by all columns."""
    name = "digest"
    while name in docs.columns:
        name += "_"
    body = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"))
    marked = docs.withColumn(name, sha256(body))
    same = marked["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (marked[name] == kept["kept_digest"])
    stay = marked.join(kept.hint("merge"), same, "left_semi")
    if kept.groupBy("kept_id", "kept_digest").count().filter("count > 1").isEmpty():
        return stay.drop(name)
    order = F.struct("text", *[F.col(c).cast("string") for c in docs.columns if c != "text"])
    first = stay.groupBy("doc_id", name).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return first.select("row.*")
