"""Near-duplicate vectors by cross-polytope hashing.

Equal vectors of a label are collapsed to one with a weight. Each unit vector is rotated by rounds of sign flips and fast
Hadamard transforms; the axis it then lies nearest to, with its sign, is a hash. A table joins several hashes to a
bucket; a vector also enters the buckets that it reaches by taking the second nearest axis for one hash. Pairs that
share a bucket which is the own one of either are verified by cosine in double precision. A pair is counted where it
meets first, so tasks return counts and spanning forests instead of pairs. Buckets of over BLOCK vectors are dealt out
by pairs of blocks.

The number of hashes of a table follows from the number of vectors, the number of tables from the wanted recall. Rows of a
bucket carry the vector in its own precision and the axes of its hashes, from which all its buckets follow.

Vectors with a null, a missing or non-finite component, of length zero or norm zero, without a label or with a null
vec_id link with nothing; vectors of different dimension don't either. Rows that repeat a vec_id are one vector of the
graph: alike ones count once, and the links of different ones are added up. Columns other than vec_id, embedding and label
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import binary_parts, numpy_columns, whole_groups
from lodestone.llm.bpe import ragged
from lodestone.llm.graph import connected_components
from lodestone.storage import discard, materialise
from lodestone.llm.suffix_dedup import BASE, scramble
from lodestone.llm.voronoi import Forest

THRESHOLD = 0.93
#: Vectors at the threshold share a hash with this probability (measured: 0.66 to 0.6 for 2 to 16 dimensions, 0.52 for 64, 0.45
#: for 384); a probe meets about half of those that don't, which the plan leaves as a reserve.
HASH_HIT = 0.6
MISS = 0.01
BUCKET_ROWS = 64
#: Rotations of fewer axes are too few to be told apart by signs.
LEAST_WIDTH = 16
BLOCK = 2048
#: Buckets of so many rows are compared together, pair by pair; larger ones by products of their rows.
SMALL = 64
PAIRS_AT_ONCE = 200_000
#: A vector with this share of all rows is hot; there are no more than its inverse.
HOT_SHARE = 1e-3
ROUNDS = 3
SEED = 20240


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n = x.shape[1]
    step = 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


def width_of(dimension: int) -> int:
    """Length that vectors are padded to: a power of two. Short ones get axes enough for rotations to differ."""
    return max(LEAST_WIDTH, 1 << (dimension - 1).bit_length())


def plan_tables(n_vectors: int, dimension: int) -> tuple[int, int]:
    """Hashes of a table, so that unrelated vectors spread thin; and tables, so that at most MISS of the pairs are missed."""
    hashes = max(1, math.ceil(math.log(max(2, n_vectors / BUCKET_ROWS)) / math.log(2 * width_of(dimension))))
    return hashes, math.ceil(math.log(MISS) / math.log(1 - HASH_HIT**hashes))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither small nor large ones leave the range of squares."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_axes(unit: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """Nearest and second nearest signed axis by vector, table and hash."""
    n, dimension = unit.shape
    width = width_of(dimension)
    padded = np.zeros((n, width))
    padded[:, :dimension] = unit
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, hashes, ROUNDS, width))
    axes = np.empty((n, tables, hashes, 2), np.uint32)
    rows = np.arange(n)
    for t in range(tables):
        for h in range(hashes):
            x = padded
            for r in range(ROUNDS):
                x = hadamard(x * signs[t, h, r])
            size = np.abs(x)
            for k in range(2):
                axis = size.argmax(1)
                axes[:, t, h, k] = 2 * axis + (x[rows, axis] < 0)
                size[rows, axis] = -1.0
    return axes


def bucket_base(label: np.ndarray, dimension: np.ndarray | int) -> np.ndarray:
    return scramble(label.astype(np.uint64) * np.uint64(BASE) + np.asarray(dimension, np.uint64))


def bucket_key(base: np.ndarray, table: np.ndarray | int, axes: np.ndarray) -> np.ndarray:
    """Key of the bucket of a table that axes (by vector and hash) name."""
    key = scramble(base + np.asarray(table, np.uint64) + np.uint64(1))
    for h in range(axes.shape[1]):
        key = scramble(key * np.uint64(BASE) + axes[:, h].astype(np.uint64))
    return key


def bucket_keys(base: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Keys by vector, table and probe; probe 0 is the vector's own bucket."""
    n, tables, hashes, _ = axes.shape
    keys = np.empty((n, tables, hashes + 1), np.uint64)
    for t in range(tables):
        for probe in range(hashes + 1):
            chosen = axes[:, t, :, 0].copy()
            if probe:
                chosen[:, probe - 1] = axes[:, t, probe - 1, 1]
            keys[:, t, probe] = bucket_key(base, t, chosen)
    return keys


def axis_type(dimension: int) -> type:
    """The smallest type for signed axes of vectors of at most this dimension."""
    return np.min_scalar_type(2 * width_of(dimension)).type


def hash_rows(batches: Iterator[pa.RecordBatch], hashes: int, tables: int, axis: type) -> Iterator[pa.RecordBatch]:
    """rep, weight, label, node, vector and axes (as bytes), keys (by table and probe)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        own = batch.column("embedding").to_numpy(zero_copy_only=False)
        dims = np.array([len(v) for v in own])
        keys = np.empty((len(own), tables * (hashes + 1)), np.int64)
        vectors, axes = [b""] * len(own), [b""] * len(own)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            stack = np.stack([own[i] for i in at])
            near = nearest_axes(unit_rows(stack.astype(np.float64)), hashes, tables)
            keys[at] = bucket_keys(bucket_base(label[at], d), near).reshape(len(at), -1).view(np.int64)
            for i, v, x in zip(at.tolist(), stack, near.astype(axis)):
                vectors[i], axes[i] = v.tobytes(), x.tobytes()
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
        columns = [batch.column(c) for c in ("rep", "weight", "label", "node")] + [pa.array(vectors, pa.binary()), pa.array(axes, pa.binary()), listed]
        yield pa.RecordBatch.from_arrays(columns, names=["rep", "weight", "label", "node", "vector", "axes", "keys"])


def linked_pairs(unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that are at the threshold."""
    keep = [np.zeros(0, np.int64)]
    for s in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(s, s + PAIRS_AT_ONCE)
        keep.append(s + np.flatnonzero(np.einsum("ij,ij->i", unit[i[part]], unit[j[part]]) >= THRESHOLD))
    at = np.concatenate(keep)
    return i[at], j[at]


def cosine_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of unit rows of a and b at the threshold, in strips of bounded size."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    strip = max(1, 4_000_000 // max(1, len(b)))
    for s in range(0, len(a), strip):
        i, j = np.nonzero(a[s : s + strip] @ b.T >= THRESHOLD)
        rows.append(i + s)
        cols.append(j)
    return np.concatenate(rows), np.concatenate(cols)


def reaches(near: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether vectors (axes by hash, nearest and second) enter the own buckets (nearest axes by hash) of others."""
    differ = near[:, :, 0] != other
    return (~differ | (near[:, :, 1] == other)).all(1) & (differ.sum(1) <= 1)


def first_meeting(axes: np.ndarray, base: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether pairs meet in this bucket before any other. i has the smaller identifier."""
    undecided, out = np.ones(len(i), bool), np.zeros(len(i), bool)
    for t in range(axes.shape[1]):
        a, b = axes[i, t], axes[j, t]
        at_i, at_j = reaches(b, a[:, :, 0]), reaches(a, b[:, :, 0])
        place = np.where(at_i, bucket_key(base[i], t, a[:, :, 0]), bucket_key(base[j], t, b[:, :, 0]))
        meets = (at_i | at_j) & undecided
        out |= meets & (place == bucket)
        undecided &= ~meets
    return out


def verify_cells(batches: Iterator[pa.RecordBatch], hashes: int, axis: type, element: type) -> Iterator[pa.RecordBatch]:
    """Counts (a, null, n) and links (a, b, 0) from sorted rows (cell, bucket, side, own, rep, weight, label, vector, axes)."""
    for table in whole_groups(batches, "cell", least_rows=8000):
        table = table.combine_chunks()
        cells, buckets, sides, own, reps, weights, labels = numpy_columns(table, "cell", "bucket", "side", "own", "rep", "weight", "label")
        data, ends = (np.concatenate(x) for x in zip(*(_lengths(c) for c in table.column("vector").chunks)))
        axes = np.concatenate([np.frombuffer(d[o[0] : o[-1]].tobytes(), axis) for d, o in map(binary_parts, table.column("axes").chunks)])
        axes = axes.reshape(table.num_rows, -1, hashes, 2)
        dims = ends // np.dtype(element).itemsize
        base = bucket_base(labels, dims)
        first_byte = np.cumsum(ends) - ends
        total: dict[int, int] = {}
        links: list[tuple[int, int]] = []
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            size = d * np.dtype(element).itemsize
            unit = unit_rows(np.frombuffer(data[(first_byte[rows][:, None] + np.arange(size)).ravel()].tobytes(), element).astype(np.float64).reshape(len(rows), d))
            own_cells = cells[rows]
            cuts = np.flatnonzero(np.r_[True, own_cells[1:] != own_cells[:-1], True])
            sizes = np.diff(cuts)
            small = np.repeat(sizes <= SMALL, sizes)
            later = np.where(small, np.repeat(cuts[1:], sizes) - np.arange(len(rows)) - 1, 0)
            found = []
            for part in np.array_split(np.arange(len(rows)), max(1, int(later.sum()) // (4 * PAIRS_AT_ONCE))):
                i, j = np.repeat(part, later[part]), ragged(part + 1, later[part])
                meet = (own[rows[i]] | own[rows[j]]) & ((sides[rows[i]] == 2) | (sides[rows[i]] != sides[rows[j]]))
                found.append(linked_pairs(unit, i[meet], j[meet]))
            for a, b in zip(cuts[:-1][sizes > SMALL].tolist(), cuts[1:][sizes > SMALL].tolist()):
                left = right = np.arange(a, b)
                if sides[rows[a]] != 2:
                    left, right = left[sides[rows[a:b]] == 0], right[sides[rows[a:b]] == 1]
                x, y = cosine_links(unit[left], unit[right])
                x, y = left[x], right[y]
                once = (own[rows[x]] | own[rows[y]]) & ((x < y) | (sides[rows[x]] != 2))
                found.append((x[once], y[once]))
            i, j = (rows[np.concatenate(x)] for x in zip(*found))
            ok = (reps[i] != reps[j]) & (labels[i] == labels[j])
            i, j = i[ok], j[ok]
            swap = reps[i] > reps[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            fresh = first_meeting(axes, base, i, j, buckets[i].view(np.uint64))
            i, j = i[fresh], j[fresh]
            names, at = np.unique(np.r_[reps[i], reps[j]], return_inverse=True)
            counts = np.bincount(at, weights=np.r_[weights[j], weights[i]], minlength=len(names))
            for x, n in zip(names.tolist(), counts.tolist()):
                total[x] = total.get(x, 0) + int(n)
            forest = Forest(len(names))
            for x, y in zip(at[: len(i)].tolist(), at[len(i) :].tolist()):
                if forest.join(x, y):
                    links.append((int(names[x]), int(names[y])))
        x = [*total, *(p for p, _ in links)]
        y = [*[None] * len(total), *(q for _, q in links)]
        n = [*total.values(), *[0] * len(links)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = binary_parts(column)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def bucket_cells(hashed: DataFrame, probes: int) -> DataFrame:
    """node, bucket, cell, side, own of what meets: buckets of over BLOCK rows become pairs of blocks."""
    entered = hashed.select("node", F.posexplode("keys").alias("at", "bucket")).select("node", "bucket", (F.col("at") % probes == 0).alias("own"))
    sizes = entered.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.max("own").alias("any_own")).filter("count > 1 AND any_own").drop("any_own")
    shared = entered.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("long"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = shared.withColumn("mine", mine).select("node", "bucket", "own", "blocks", "mine", others.alias("other"))
    # one side of a pair of different blocks has the smaller number; within a block, and an undivided bucket, all meet all
    return dealt.select(
        "node", "bucket", "own", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows(vec_id, embedding, label)."""
    kind = "float" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    values = F.col("embedding").cast(f"array<{kind}>")
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists(values, lambda v: v != 0), F.lit(False))
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"), F.col("label").cast("long").alias("label"), usable.alias("usable"))
    good = plain.filter("usable").select("vec_id", "embedding", "label")
    repeated = not good.groupBy("vec_id").count().filter("count > 1").isEmpty()
    own = good.distinct() if repeated else good
    distinct = own.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    same = ["label", "embedding"]
    n, n_rows, dimension = distinct.agg(F.count(F.lit(1)), F.sum("weight"), F.max(F.size("embedding"))).first()
    hashes, tables = plan_tables(n, dimension or 1)
    axis, element = axis_type(dimension or 1), np.float32 if kind == "float" else np.float64
    hashed = distinct.select("rep", "weight", "label", "node", "embedding").mapInArrow(
        lambda batches: hash_rows(batches, hashes, tables, axis), "rep long, weight long, label long, node long, vector binary, axes binary, keys array<long>"
    )
    hashed = materialise(hashed, "hashed-vectors")
    filled = bucket_cells(hashed, hashes + 1).join(hashed.drop("keys"), "node").drop("node")
    found = filled.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: verify_cells(batches, hashes, axis, element), "a long, b long, n long")
    found = materialise(found, "vector-links")
    discard(hashed)
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    links = found.filter("b IS NOT NULL").select("a", "b")
    if repeated:  # the vectors of one vec_id are one
        named = materialise(own.join(distinct, same).select("vec_id", "rep"), "vector-names")
        firsts = named.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a <> last").drop("last")
        links = links.unionByName(named.join(firsts, "vec_id").select("a", F.col("rep").alias("b")).filter("a <> b"))
    components = connected_components(links).withColumnRenamed("id", "rep")
    reps = distinct.join(counts, "rep", "left").join(components, "rep", "left").select(
        "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "weight"
    )
    reps = materialise(reps, "vector-classes")
    hot = F.broadcast(reps.filter(F.col("weight") >= F.lit(HOT_SHARE * (n_rows or 0))).drop("weight"))  # 1 / HOT_SHARE rows at most
    linked = own.join(hot, same).unionByName(own.join(hot, same, "left_anti").join(reps.drop("weight"), same)).select("vec_id", "n_links", "component_id")
    alone = plain.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if repeated:
        linked = good.select("vec_id").join(linked.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "vec_id")
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
