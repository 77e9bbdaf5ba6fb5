"""Exact Jaccard join of documents by their word shingles, in the metric space of Jaccard distances.

Documents with one set are collapsed per task. Sets that no pivot is near are told apart first: every set shows its first
shingles in one global order (frequent ones last), as many as two sets within the threshold must share one of, and bounds
from the shown shingles discard pairs that can't be within reach. What may be linked forms a cell. Cells are joined on whole
sets in Voronoi regions of pivots, recursively (see voronoi); those of up to LEAF documents in one task, with windows around
one pivot.

Links within one component are not searched for: component_id and n_shingles are what is returned. Sets are of 64-bit hashes
of shingles; equal ones are told by size, sum and a mixed 64-bit sum of those.

Text without words, empty or null, has an empty set and is linked with nothing. Where a doc_id is null or repeated,
rows are ordered by doc_id (nulls first) and text, and rows alike in both are one document; its component_id is the
doc_id of the first reachable row. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import voronoi
from lodestone.llm.arrow import binary_parts, numpy_columns, slices, whole_groups
from lodestone.llm.graph import connected_components
from lodestone.llm.shingles import CHUNK, shingle_sets
from lodestone.storage import arrow_batches, materialise
from lodestone.llm.suffix_dedup import Powers, scramble, with_unique_ids
from lodestone.llm.voronoi import PERCENT, Forest, join_cell, links_batch

#: Frequent shingles that are told to all tasks: at most so many, and found in so many documents at least.
FREQUENT = 100_000
FREQUENT_DOCS = 32
#: Documents of a shingle's region whose bounds one task compares; larger regions may all be linked.
REGION = 1024
#: Documents whose sets are in memory at once, and shingles that are counted at once.
SLICE = 500
TOKENS_HELD = 1_500_000


def shown(n: int) -> int:
    """How many first shingles of a set of n one must share with any set that it links to."""
    return n - (PERCENT * n + 99) // 100 + 1


def count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several documents of this task have, with their number."""
    powers = Powers(CHUNK + 1)
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= 2
        return pa.RecordBatch.from_arrays([pa.array((token[often] >> np.uint64(16)).astype(np.int64)), pa.array(n[often])], names=["token", "n"])

    size = 0
    for batch in slices(batches, SLICE):
        sets = shingle_sets(*binary_parts(batch.column("body")), powers)
        held += sets
        size += sum(map(len, sets))
        if size > TOKENS_HELD:
            yield flush()
            held.clear()
            size = 0
    if held:
        yield flush()


def frequent_shingles(bodies: DataFrame) -> np.ndarray:
    """At most FREQUENT shingles (upper 48 bits) by the number of documents that tasks saw them in, sorted."""
    counted = bodies.select("body").mapInArrow(count_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= FREQUENT_DOCS).orderBy(F.desc("n"), "token").limit(FREQUENT)
    return np.sort(np.array([r["token"] for r in top.select("token").collect()], np.int64))


def show_sets(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, n, twin (the first document of this task with the same set), tokens (what a first one shows, in order)."""
    powers = Powers(CHUNK + 1)
    first_of: dict[tuple[int, int, int], int] = {}
    for batch in slices(batches, SLICE):
        sets = shingle_sets(*binary_parts(batch.column("body")), powers)
        ids = batch.column("id").to_pylist()
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        key = (flat >> np.uint64(16)).astype(np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
            key |= (frequent[at] == key).astype(np.int64) << 48
        ends = np.cumsum(sizes)
        twins, tokens = [], []
        for i, s, end, n in zip(ids, sets, ends.tolist(), sizes.tolist()):
            if not n:
                twins.append(i), tokens.append(key[:0])
                continue
            mark = (n, int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(scramble(s))))
            twin = first_of.setdefault(mark, i)
            twins.append(twin)
            tokens.append(np.sort(key[end - n : end])[: shown(n)] if twin == i else key[:0])
        bounds = np.cumsum([0, *map(len, tokens)])
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([*tokens, key[:0]])))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(twins, pa.int64()), listed], names=["id", "n", "twin", "tokens"])
        if len(first_of) > 1_000_000:
            first_of.clear()


def bound_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible links (a spanning forest of them) inside the regions of sorted rows (pivot, id, n, tokens)."""
    for table in whole_groups(batches, "pivot", least_rows=2000):
        pivots, ids, sizes = numpy_columns(table, "pivot", "id", "n")
        tokens = table.column("tokens").to_pylist()
        out: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.r_[True, pivots[1:] != pivots[:-1], True]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            order = sorted(range(a, b), key=lambda i: int(sizes[i]))
            have = {i: set(tokens[i]) for i in order}
            known = {i: sorted(have[i]) for i in order}
            forest = Forest(b - a)
            for x, i in enumerate(order):
                n = int(sizes[i])
                for j in order[x + 1 :]:
                    m = int(sizes[j])
                    if PERCENT * m > 100 * n:
                        break
                    if forest.root(i - a) == forest.root(j - a):
                        continue
                    common = len(have[i] & have[j])
                    if not common:
                        continue
                    edge = min(known[i][-1], known[j][-1])
                    apart = bisect_right(known[i], edge) + bisect_right(known[j], edge) - 2 * common
                    # linked sets differ by at most (n + m) * (100 - PERCENT) / (100 + PERCENT) shingles
                    if (100 + PERCENT) * apart <= (100 - PERCENT) * (n + m):
                        forest.join(i - a, j - a)
                        out.append((int(ids[i]), int(ids[j])))
        yield links_batch(out)


def join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside cells from sorted rows (cell, id, body)."""
    powers = Powers(CHUNK + 1)
    for table in whole_groups(batches, "cell", least_rows=500, least_bytes=8 << 20):
        table = table.combine_chunks()
        cells, ids = numpy_columns(table, "cell", "id")
        sets = [s for chunk in table.column("body").chunks for s in shingle_sets(*binary_parts(chunk), powers)]
        cuts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True]).tolist()
        yield links_batch([link for a, b in zip(cuts, cuts[1:]) for link in join_cell(ids[a:b].tolist(), sets[a:b])])


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers(CHUNK + 1)
    for batch in slices(batches, SLICE):
        sets = [s.view(np.int64) for s in shingle_sets(*binary_parts(batch.column("body")), powers)]
        bounds = np.cumsum([0, *map(len, sets)])
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("id"), listed], names=["cell", "id", "tokens"])


def region_rows(sets: DataFrame) -> DataFrame:
    """pivot, id of all regions, each pair once. The pivot names a region and is in it if another's size is near its own.

    Of the documents that share a shingle, ordered by size, those stay whose next smaller or larger one is near enough in
    size to be linked. Shingles that are frequent are grouped by pre-aggregation and a join that may be split.
    """
    shown_rows = sets.select("id", "n", F.explode("tokens").alias("token"))
    rare = F.shiftright("token", 48) == 0
    by_size = Window.partitionBy("token").orderBy("n", "id")
    near = (F.lag("n").over(by_size) * 100 >= F.col("n") * PERCENT) | (F.col("n") * 100 >= F.lead("n").over(by_size) * PERCENT)
    few = shown_rows.filter(rare).withColumn("near", near).withColumn("pivot", F.min("id").over(Window.partitionBy("token")))
    few = few.filter("near").select("pivot", "id")
    often = shown_rows.filter(~rare)
    heads = often.groupBy("token").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot <> last").select("token", "pivot")
    return few.unionByName(often.join(heads, "token").select("pivot", "id")).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    rows, given = with_unique_ids(docs)
    out = components_of(rows.select("id", "body"))
    if not given:
        return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
    firsts = rows.select(F.col("id").alias("component_id"), F.col("doc_id").alias("first_doc"))
    named = named_rows(rows).join(out, "id").join(firsts, "component_id").select("name_id", "name_digest", "n_shingles", "first_doc")
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    same = again["doc_id"].eqNullSafe(named["name_id"]) & (again["digest"] == named["name_digest"])
    return again.join(named, same).select("doc_id", "n_shingles", F.col("first_doc").alias("component_id"))


def keep_firsts(docs: DataFrame) -> DataFrame:
    """The rows of docs that come first, by doc_id and text, among those that they are linked with."""
    rows, given = with_unique_ids(docs)
    firsts = components_of(rows.select("id", "body")).filter("id = component_id").select("id")
    if not given:
        return docs.join(firsts, docs["doc_id"] == firsts["id"], "left_semi")
    named = named_rows(rows).join(firsts, "id", "left_semi")
    return docs.join(named, docs["doc_id"].cast("long").eqNullSafe(named["name_id"]) & (text_digest(docs["text"]) == named["name_digest"]), "left_semi")


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def named_rows(rows: DataFrame) -> DataFrame:
    """id, name_id, name_digest: what tells rows(id, doc_id, body) apart outside."""
    return rows.select("id", F.col("doc_id").alias("name_id"), F.sha2("body", 256).alias("name_digest"))


def cells_of(sets: DataFrame) -> DataFrame:
    """id, cell of what may be linked among sets(id, n, tokens to meet by, sketch to bound by)."""
    regions = materialise(region_rows(sets), "regions")
    crowded = regions.groupBy("pivot").count().filter(F.col("count") > REGION).select("pivot")
    at_large = regions.join(crowded, "pivot", "left_semi").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    # both sides grow with the documents: merged at every size
    filled = regions.join(crowded, "pivot", "left_anti").hint("merge").join(sets.select("id", "n", F.col("sketch").alias("tokens")), "id")
    bounded = filled.select("pivot", "id", "n", "tokens").repartition("pivot").sortWithinPartitions("pivot").mapInArrow(bound_regions, "a long, b long")
    return materialise(connected_components(bounded.unionByName(at_large)).withColumnRenamed("component", "cell"), "cells")


def large_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").count().filter(F.col("count") > voronoi.LEAF).select("cell")


def reordered(members: DataFrame) -> DataFrame:
    """What members(cell, id, tokens: whole sets) show when the shingles that are rare in their cell come first.

    The order is by how many sets of the cell have a shingle, counted exactly, then by the shingle.
    """
    rows = members.select("cell", "id", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    rarity = rows.groupBy("cell", "token").agg(F.least(F.count(F.lit(1)), F.lit(65535)).alias("df"))
    keyed = rows.join(rarity, ["cell", "token"]).select(
        "id", "n", F.struct("df", F.shiftrightunsigned("token", 33).alias("h"), F.expr("xxhash64(cell, token) & 281474976710655").alias("token")).alias("k")
    )
    n_shown = F.col("n") - F.floor((F.col("n") * PERCENT + 99) / 100) + 1
    gathered = keyed.groupBy("id", "n").agg(F.array_sort(F.collect_list("k")).alias("k")).withColumn("k", F.slice("k", 1, n_shown.cast("int")))
    sketch = F.array_distinct(F.transform("k", lambda k: F.shiftleft(k["df"].cast("long"), 31).bitwiseOR(k["h"])))
    return materialise(gathered.select("id", "n", F.col("k.token").alias("tokens"), sketch.alias("sketch")), "reordered-sets")


def components_of(bodies: DataFrame) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable) of bodies(id, body) with ids of their own."""
    with arrow_batches(bodies.sparkSession, SLICE):
        frequent = bodies.sparkSession.sparkContext.broadcast(frequent_shingles(bodies))
        sets = materialise(bodies.mapInArrow(lambda batches: show_sets(batches, frequent.value), "id long, n long, twin long, tokens array<long>"), "shown-sets")
        # 31 bits of a shingle are enough for bounds: merging shingles only brings sets nearer
        cells = cells_of(sets.withColumn("sketch", F.transform("tokens", lambda t: F.shiftright(t, 18).cast("int"))))
        large = materialise(large_cells(cells).withColumn("large", F.lit(True)), "large-cells")
        # both sides grow with the documents: merged at every size, and once for all cells
        marked = cells.join(large, "cell", "left").select("cell", "id", F.col("large").isNotNull().alias("large"))
        members = materialise(bodies.join(marked.hint("merge"), "id").select("cell", "id", "body", "large"), "cell-bodies")
        small_rows = members.filter("NOT large").select("cell", "id", "body")
        links = small_rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(join_cells, "a long, b long")
        if not large.isEmpty():
            whole = members.filter("large").select("cell", "id", "body").mapInArrow(whole_sets, "cell long, id long, tokens array<long>")
            for found in voronoi.join_cells(materialise(whole, "cell-sets"), lambda rest: cells_of(reordered(rest))):
                links = links.unionByName(found)
        twins = sets.filter("twin <> id").select(F.col("twin").alias("a"), F.col("id").alias("b"))
        components = connected_components(links.unionByName(twins))
    out = sets.select("id", F.col("n").alias("n_shingles")).join(components, "id", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
