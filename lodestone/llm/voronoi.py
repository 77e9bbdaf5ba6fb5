"""Exact Jaccard joins inside large cells of sets: Voronoi regions of pivots, recursively.

A round chooses PIVOTS sets of every large cell and measures all its members' Jaccard distances to them. A member is at home
in the region of its nearest pivot; it is also a guest of every region whose pivot is not farther than that by more than
twice the radius, for by the triangle inequality no set at home there can be linked to it otherwise. Every linked pair
then shares a region where one of it is at home. Pivots have met everybody and leave. So do sets that are linked, directly or
by way of sets between pivots, with a pivot and nearer to it, by more than the radius, than any set of the cell that is not:
all that they link with is linked already. Regions are divided again, with pivots of their own, until a task can compare them.

Cells that pivots don't divide (all sets about equally far) are compared in pairs of blocks; large ones are told apart by the
shingles that are rare in them, and divided again, before that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.arrow import numpy_columns, whole_groups
from lodestone.storage import discard, materialise

#: Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 80
RADIUS = 1.0 - PERCENT / 100 + 1e-9
PIVOTS = 16
#: Sets that a task compares with each other, and sets and shingles that one measures against the pivots.
LEAF = 256
PART_SETS = 1024
PART_SHINGLES = 1 << 20
#: Undivided cells of more sets are told apart by their rare shingles before they are compared in pairs of blocks.
PAIRED = 4096
#: A round divides a cell if its regions have this share at most of the cell's pairs and are so many times as large in all.
PAIRS_LEFT = 0.5
MOST_GUESTS = 4
MEMBERS = "root long, cell string, id long, home boolean, tokens array<long>"
#: met has a bit for every pivot that a set is linked with.
MEASURED = MEMBERS + ", pivots array<long>, distance array<double>, hit array<boolean>, met long"


def linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    return 100 * common >= PERCENT * (a + b - common)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def distances(own: np.ndarray, flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard distances from one set to others (all their shingles, whose they are, and how many each has), and which link to it."""
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    common = np.bincount(owner, weights=own[at] == flat, minlength=len(sizes)).astype(np.int64)
    return 1.0 - common / (len(own) + sizes - common), linked(common, len(own), sizes)


def join_cell(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: windows around the first one decide who is compared."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    forest, out = Forest(n), []
    to_pivot, hits = distances(sets[0], flat, owner, sizes)
    for i in np.flatnonzero(hits).tolist():
        if forest.join(0, i):
            out.append((ids[0], ids[i]))
    for p in np.flatnonzero(~hits).tolist():
        near = np.flatnonzero((np.abs(to_pivot - to_pivot[p]) <= RADIUS) & (100 * np.minimum(sizes, sizes[p]) >= PERCENT * np.maximum(sizes, sizes[p])))
        near = np.array([i for i in near.tolist() if forest.root(i) != forest.root(p)], np.int64)
        if len(near):
            _, hit = distances(sets[p], np.concatenate([sets[i] for i in near]), np.repeat(np.arange(len(near)), sizes[near]), sizes[near])
            for i in near[hit].tolist():
                if forest.join(p, i):
                    out.append((ids[p], ids[i]))
    return out


def token_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(t, np.int64).view(np.uint64) for t in column.to_numpy()]


def join_token_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside cells from sorted rows (cell, id, tokens: whole sets)."""
    for table in whole_groups(batches, "cell", least_rows=500):
        cells, ids = numpy_columns(table, "cell", "id")
        sets = token_sets(table.column("tokens"))
        cuts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True]).tolist()
        yield links_batch([link for a, b in zip(cuts, cuts[1:]) for link in join_cell(ids[a:b].tolist(), sets[a:b])])


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MEASURED for the members in sorted rows (part, place, MEMBERS); the pivots of a part come first, with places below PIVOTS."""
    for table in whole_groups(batches, "part"):
        parts, places, ids = numpy_columns(table, "part", "place", "id")
        sets = token_sets(table.column("tokens"))
        rows, pivots, far, hit, met = [], [], [], [], []
        cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            if places[b - 1] != PIVOTS:  # a part without members
                continue
            first = a + int(np.argmax(places[a:b] == PIVOTS))
            own = sets[first:b]
            sizes = np.array([len(s) for s in own])
            flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
            found = [distances(sets[p], flat, owner, sizes) for p in range(a, first)]
            rows += range(first, b)
            pivots += [ids[a:first]] * (b - first)
            far += list(np.array([d for d, _ in found]).T)
            hits = np.array([h for _, h in found])
            hit += list(hits.T)
            met.append((hits * (1 << np.arange(len(found), dtype=np.int64))[:, None]).sum(0))
        if not rows:
            continue
        kept = table.take(pa.array(rows, pa.int64())).select(["root", "cell", "id", "home", "tokens"])
        bounds = pa.array(np.cumsum([0, *map(len, pivots)]), pa.int32())
        more = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (pivots, far, hit)]
        for batch in pa.table([*kept.columns, *more, pa.array(np.concatenate(met))], names=[*kept.column_names, "pivots", "distance", "hit", "met"]).combine_chunks().to_batches():
            yield batch


def large_cells(members: DataFrame) -> DataFrame:
    """cell, parts: the cells of more than LEAF members, and in how many parts they are measured."""
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("shingles")).filter(F.col("n") > LEAF)
    return sizes.select("cell", F.greatest(F.ceil(F.col("n") / PART_SETS), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int").alias("parts"))


def measured_members(members: DataFrame, large: DataFrame, level: int) -> DataFrame:
    """The members of large cells, with their distances to the pivots of their cells. Parts of a cell are measured apart."""
    own = members.join(large, "cell")
    by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(level)), "id")
    chosen = own.filter("home").select("cell", "id").withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= PIVOTS)
    pivots = own.join(chosen, ["cell", "id"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("place", (F.col("nth") - 1).cast("int"))
    rows = own.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("place", F.lit(PIVOTS))
    columns = [F.concat_ws("/", "cell", "part").alias("part"), "place", "root", "cell", "id", "home", "tokens"]
    dealt = pivots.select(*columns).unionByName(rows.select(*columns)).repartition("part").sortWithinPartitions("part", "place")
    return materialise(dealt.mapInArrow(measure, MEASURED), "measured")


def joined_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, joined (for each pivot the bits of those that it is linked with, by way of sets) from cell, met: one row a cell."""
    for batch in batches:
        out = []
        for mets in batch.column("met").to_pylist():
            groups: list[int] = []
            for m in mets:
                whole = m
                for g in groups:
                    whole |= g if g & m else 0
                groups = [*(g for g in groups if not g & m), whole]
            out.append([next((g for g in groups if g >> k & 1), 0) for k in range(PIVOTS)])
        yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(out, pa.list_(pa.int64()))], names=["cell", "joined"])


def unfinished(measured: DataFrame) -> DataFrame:
    """measured without pivots and without sets that can only link with what is linked with a pivot already."""
    # a cell has one row here, with 2 ** PIVOTS entries at most
    mets = measured.filter("met <> 0").groupBy("cell").agg(F.collect_set("met").alias("met"))
    joined = materialise(mets.mapInArrow(joined_pivots, "cell string, joined array<long>"), "joined-pivots")
    apart = lambda k: F.col("met").bitwiseAND(F.element_at("joined", k + 1)) == 0
    far = lambda k: F.get("distance", F.lit(k))
    others = measured.join(joined, "cell").groupBy("cell", "joined").agg(*[F.min(F.when(apart(k), far(k))).alias(f"o{k}") for k in range(PIVOTS)])
    others = materialise(others.select("cell", "joined", F.array(*[f"o{k}" for k in range(PIVOTS)]).alias("other")), "nearest-others")
    rows = measured.join(others, "cell", "left")
    other = lambda k: F.element_at("other", k + 1)
    inner = F.lit(False)
    for k in range(PIVOTS):
        inner = inner | (far(k).isNotNull() & ~apart(k) & (other(k).isNull() | (far(k) < other(k) - RADIUS)))
    rest = rows.filter(~F.coalesce(inner, F.lit(False)) & ~F.array_contains("pivots", F.col("id")))
    return materialise(rest.select(*measured.columns), "unfinished")


def regions_of(rest: DataFrame) -> DataFrame:
    """parent, MEMBERS of the regions of measured rows."""
    near = F.array_min("distance")
    placed = rest.select("root", "cell", "id", "home", "tokens", near.alias("near"), F.array_position("distance", near).alias("own"), F.posexplode("distance").alias("j", "far"))
    placed = placed.filter(F.col("far") <= F.col("near") + 2 * RADIUS)
    return placed.select(F.col("cell").alias("parent"), "root", F.concat_ws(".", "cell", "j").alias("cell"), "id", (F.col("home") & (F.col("j") + 1 == F.col("own"))).alias("home"), "tokens")


def join_regions(members: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Links inside the cells of members(MEMBERS), and the members of cells that pivots don't divide (None: there are none)."""
    found, leaves, stuck = [], [], []
    left, level = materialise(members, "members"), 0
    while True:
        large = materialise(large_cells(left), "large-cells")
        leaves.append(left.join(large, "cell", "left_anti").select("cell", "id", "tokens"))
        if large.isEmpty():
            break
        measured = measured_members(left, large, level)
        hits = measured.select("id", F.explode(F.arrays_zip("pivots", "hit")).alias("m")).filter("m.hit AND m.pivots <> id")
        found.append(hits.select(F.col("m.pivots").alias("a"), F.col("id").alias("b")))
        rest = unfinished(measured)
        if rest.isEmpty():
            break
        regions = materialise(regions_of(rest), "regions-of-pivots")
        counts = regions.groupBy("parent", "cell").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("home").alias("lived"))
        shares = counts.filter("lived").groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("rows"))
        whole = rest.groupBy(F.col("cell").alias("parent")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        divides = (F.col("pairs") <= PAIRS_LEFT * F.col("n") * F.col("n")) & (F.col("rows") <= MOST_GUESTS * F.col("n"))
        # what a task can compare need not be divided
        fate = F.when(F.col("n") <= LEAF, "leaf").when(F.coalesce(divides, F.lit(False)), "divided").otherwise("stuck")
        fates = materialise(whole.join(shares, "parent", "left").select("parent", fate.alias("fate")), "fates")
        told = rest.join(fates, F.col("cell") == F.col("parent")).select("fate", "root", "cell", "id", "home", "tokens")
        leaves.append(told.filter("fate = 'leaf'").select("cell", "id", "tokens"))
        stuck.append(told.filter("fate = 'stuck'").drop("fate"))
        lived = counts.filter("lived").select("cell")
        split = regions.join(fates.filter("fate = 'divided'").select("parent"), "parent", "left_semi").join(lived, "cell", "left_semi")
        left = materialise(split.select("root", "cell", "id", "home", "tokens"), "members")
        discard(regions)
        level += 1
    small_cells = union(leaves)
    found.append(small_cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(join_token_cells, "a long, b long"))
    if not stuck:
        return found, None
    rest = materialise(union(stuck), "undivided")
    return found, None if rest.isEmpty() else rest


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def block_pairs(members: DataFrame) -> DataFrame:
    """Links inside the cells of members(cell, id, tokens), compared in pairs of blocks."""
    sizes = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LEAF).cast("int").alias("blocks"))
    rows = members.join(sizes, "cell").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.concat_ws("/", "cell", F.least("mine", "other"), F.greatest("mine", "other"))
    return rows.select(key.alias("cell"), "id", "tokens").repartition("cell").sortWithinPartitions("cell").mapInArrow(join_token_cells, "a long, b long")


def join_cells(cells: DataFrame, told_apart: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Links inside the cells of cells(cell, id, tokens), which have no id in common.

    told_apart gives new cells (id, cell) of rows(cell, id, tokens) without losing a link.
    """
    members = cells.select(F.col("cell").alias("root"), F.col("cell").cast("string").alias("cell"), "id", F.lit(True).alias("home"), "tokens")
    found, rest = join_regions(members)
    if rest is None:
        return found
    many = materialise(rest.groupBy("cell").count().filter(F.col("count") > PAIRED).select("cell"), "undivided-cells")
    found.append(block_pairs(rest.join(many, "cell", "left_anti").select("cell", "id", "tokens")))
    if not many.isEmpty():
        once = materialise(rest.join(many, "cell", "left_semi").select(F.col("root").alias("cell"), "id", "tokens").dropDuplicates(["id"]), "undivided-sets")
        apart = once.select("id", "tokens").join(told_apart(once), "id")
        members = apart.select(F.col("cell").alias("root"), F.concat(F.lit("r"), F.col("cell").cast("string")).alias("cell"), "id", F.lit(True).alias("home"), "tokens")
        more, rest = join_regions(members)
        found += more
        if rest is not None:
            found.append(block_pairs(rest.select("cell", "id", "tokens")))
    return found
