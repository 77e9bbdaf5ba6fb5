"""Importance resampling of documents towards a target distribution of hashed word n-grams.

Every feature falls into one of BUCKETS buckets. The log ratio of a bucket's share in the target and in the documents is its
gain; a document's weight is the sum of its features' gains, looked up in one array. Gumbel noise from the hash of the
identifier turns the highest scores into a draw without replacement.

The draw is a sort that stops: scored rows are written once; the eligible ones are sorted within their partitions, and each
partition's run is cut at score bounds into bins, a row of packed arrays for every bin. Bins have exact counts, so those
that the draw can't reach are never shuffled, and the first rank of each bin is known. One task merges the runs of a bin by
a tournament tree (see tournament.py) and stops ranking after the exact count. The bounds come from a sample of MOST_SAMPLED
scores; they decide how much work a task gets, not the result.

Null text has no features. A null identifier hashes like an empty one and comes after the others that have its score. Rows that
repeat an identifier are drawn each by itself (alike in score, those with the smaller weight come first). An empty table, or
too few eligible rows for one draw, gives no ranks; an empty target gives gains against the uniform distribution. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tournament import Spool, merge_all
from lodestone.storage import arrow_batches, materialise

BUCKETS = 10_000
LEAST_WORDS = 20
#: Bound on the scores that are sampled for bin bounds.
MOST_SAMPLED = 50_000  # expected; a sample has hardly more
#: Rows of a packed array at most, packed arrays that a task takes at once, rows that a bin should have at most.
PACKED, PACKED_ROWS, BIN_ROWS = 4096, 512, 500_000
#: Whole numbers of a packed row; features that are counted at once.
NUMBERS, COUNTED = 5, 1 << 20
#: Words whose bucket a task remembers at once.
REMEMBERED = 1 << 18
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"
RANKED = "doc_id long, n_features long, weight long, score long, rank long"
PACKED_TYPE = "bin int, run int, part int, rows binary"


class Buckets(dict):
    """Bucket of a feature, remembered for the next time."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % BUCKETS
        return bucket


def features(text: bytes, longest: int, buckets: Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to `longest` words."""
    words = WORD.findall(text.lower())  # bytes.lower() lowers A-Z alone
    found = [buckets[w] for w in words]
    for n in range(2, longest + 1):
        found += [buckets[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return len(words), np.array(found, np.int64)


def utf8(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def bucket_counts(texts: DataFrame, longest: int = 1) -> np.ndarray:
    """Features of texts(text) in each bucket. A task sends its own counts, one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total, held, size = Buckets(), np.zeros(BUCKETS, np.int64), [], 0
        for text in itertools.chain.from_iterable(utf8(b.column(0)) for b in batches):
            held.append(features(text, longest, buckets)[1])
            size += len(held[-1])
            if size >= COUNTED:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, size = [], 0
        total += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=BUCKETS)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(total[filled], pa.int64())], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows.collect():  # BUCKETS rows at most
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of every bucket."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: str, seed: str) -> int:
    """Gumbel noise in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gains: np.ndarray, seed: str, longest: int = 1) -> DataFrame:
    """SCORED of every row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            made = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                n_words, found = features(text, longest, buckets)
                weight = int(held.value[found].sum())
                made.append((doc_id, n_words, len(found), weight, weight + noise("" if doc_id is None else str(doc_id), seed)))
            columns = list(zip(*made)) if made else [()] * 5
            names = ["doc_id", "n_words", "n_features", "weight", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def score_bounds(eligible: DataFrame, n: int, wanted: int, bins: int) -> list[int]:
    """Falling scores that divide the wanted rows into about `bins` parts; what is below the last one belongs to one more bin."""
    sample = sorted((r[0] for r in eligible.select("score").sample(min(1.0, MOST_SAMPLED / n), seed=1).collect()), reverse=True)
    reach = min(len(sample) - 1, math.ceil(1.1 * len(sample) * wanted / n))
    return sorted({sample[reach * i // bins] for i in range(1, bins + 1)}, reverse=True) if sample else []


def bins_of(scores: np.ndarray, bounds: Sequence[int]) -> np.ndarray:
    """Number of bounds above each score."""
    return np.searchsorted(-np.array(bounds, np.int64), -scores, side="left")


def bin_counts(eligible: DataFrame, bounds: Sequence[int]) -> np.ndarray:
    """Rows of each bin. A task sends its own counts, one row a bin at most."""
    size = len(bounds) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(bins_of(batch.column(0).to_numpy(), bounds), minlength=size)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(total[filled], pa.int64())], names=["bin", "n"])

    counts = np.zeros(size, np.int64)
    for r in eligible.select("score").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row a bin
        counts[r["bin"]] = r["n"]
    return counts


def pack(eligible: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """PACKED_TYPE rows: each partition's rows as a sorted run, cut into bins.

    A row of the run is five numbers, which rise: the score with its sign changed, whether the identifier is null, the
    identifier, weight, number of features.
    """
    no_id = F.col("doc_id").isNull().cast("long")
    rows = eligible.select((-F.col("score")).alias("key"), no_id.alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "weight", "n_features")
    rows = rows.withColumn("run", F.spark_partition_id()).sortWithinPartitions("key", "no_id", "id", "weight", "n_features")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(c).to_numpy() for c in range(NUMBERS)], axis=1)
            bins = bins_of(-table[:, 0], bounds)
            edges = np.unique(np.r_[np.flatnonzero(np.diff(bins)) + 1, np.arange(0, len(bins), PACKED), len(bins)])
            begins, ends = edges[:-1], edges[1:]
            numbers = range(part, part := part + len(begins))
            columns = [pa.array(bins[begins], pa.int32()), batch.column("run").take(pa.array(begins)), pa.array(numbers, pa.int32()), pa.array([table[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bin", "run", "part", "rows"])

    return rows.mapInArrow(cut, PACKED_TYPE)


def ranked_bins(packed: DataFrame, first_ranks: Sequence[int], wanted: int) -> DataFrame:
    """RANKED rows of packed runs that are sorted by bin, run and part: ranks count on from the first one of their bin, up to `wanted`."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(b.column("bin").to_pylist(), b.column("run").to_pylist(), b.column("rows")) for b in batches)
        for bin_no, of_bin in itertools.groupby(rows, key=lambda r: r[0]):
            spool = Spool(NUMBERS)
            for _, of_run in itertools.groupby(of_bin, key=lambda r: r[1]):
                spool.new_run()
                for r in of_run:
                    spool.add(r[2].as_py())
            rank = first_ranks[bin_no]
            for block in merge_all(spool.runs(), NUMBERS, stop=max(0, wanted - rank + 1)):
                key, no_id, ids, weights, sizes = block.T
                ranks = np.arange(rank, rank + len(block))
                rank += len(block)
                columns = [pa.array(ids, mask=no_id != 0), pa.array(sizes), pa.array(weights), pa.array(-key), pa.array(ranks, mask=ranks > wanted)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "weight", "score", "rank"])

    return packed.mapInArrow(merged, RANKED)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, least_words: int = LEAST_WORDS, seed: str = "2024") -> DataFrame:
    """RANKED: every row of docs(doc_id, text) with its weight and score against target(text), and the rank of those drawn.

    Of the N rows with at least least_words words, floor(percent * N / 100) are drawn.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, longest), bucket_counts(target, longest))
    scored = materialise(score(docs, gains, seed, longest), "scored")
    eligible = scored.filter(F.col("n_words") >= least_words)
    n = eligible.count()
    wanted = percent * n // 100
    unranked = [*("doc_id", "n_features", "weight", "score"), F.lit(None).cast("long").alias("rank")]
    if not wanted:
        return scored.select(*unranked)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = score_bounds(eligible, n, wanted, max(partitions, -(-wanted // BIN_ROWS)))
    counts = bin_counts(eligible, bounds)
    first_ranks = (1 + np.r_[0, np.cumsum(counts)[:-1]]).tolist()
    last_bin = int(np.searchsorted(first_ranks, wanted, side="right")) - 1  # the rank `wanted` is in it
    reached = F.col("n_words") >= least_words
    if last_bin < len(bounds):
        reached = reached & (F.col("score") >= bounds[last_bin])
    packed = pack(scored.filter(reached), bounds).repartition(partitions, "bin").sortWithinPartitions("bin", "run", "part")
    with arrow_batches(spark, PACKED_ROWS):
        drawn = materialise(ranked_bins(packed, first_ranks, wanted), "drawn")
    return drawn.unionByName(scored.filter(~reached).select(*unranked))
