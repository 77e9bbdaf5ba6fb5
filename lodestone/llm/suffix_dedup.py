"""Removal of repeated 100-byte strings with suffix arrays.

A byte goes if a string of `length` bytes covers it that also starts earlier (smaller doc_id, or earlier in the same
document). The work is dealt out by content, so that no task sees more than a share of the text:

1. Every string of `length` bytes picks the anchor with the smallest hash among its ANCHOR-byte grams. Consecutive
   strings with one anchor form a run; equal strings pick equal anchors. A task that has met a run before marks
   it at once and sends on only its first sight.
2. Runs meet by anchor hash, those of hot anchors by anchor and content. Runs of equal content are marked but for the
   first; anchors with different runs ask for their bytes.
3. Within batches of whole anchors a suffix array (linear grouping construction, over phrases that end at white space)
   puts equal strings side by side; neighbours are compared byte by byte, and all but the first are marked.
4. Marks are merged per document and cut out.

Bytes of runs under an anchor of more than HOT runs are dealt by what all strings in a block of anchor offsets share.
Tasks count the anchors that they meet SEEN times at once; an anchor whose counts reach HOT is hot.

Null text counts as empty. Where a doc_id is null or repeated, rows are ordered by doc_id (nulls first) and text, and
rows alike in both are one document. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import binary_parts, numpy_columns, slices, whole_groups
from lodestone.llm.bpe import ragged
from lodestone.storage import discard, materialise
from lodestone.llm.suffix_sort import suffix_array

LENGTH = 100
ANCHOR = 20
#: Runs of different content under one anchor beyond which they are dealt by more of their bytes.
HOT = 4000
SEEN = 32
#: Stands for the number of runs of a key that several tasks have.
ELSEWHERE = 1 << 40
OFFSET_BLOCK = 9
#: Bytes of text that are scanned at once, runs held before equal ones are merged, and bytes sorted at once.
SEGMENT = 1 << 19
RUNS_HELD = 1_000_000
SORTED_BYTES = 1 << 19
#: Bytes of cut runs, and documents, that are held at once.
CUT_BYTES = 8 << 20
SLICE = 500
#: Fixed odd constants of the polynomial and mixing hashes.
BASE = 0x2545F4914F6CDD1D
MIX = 0x9E3779B97F4A7C15
RUN_SCHEMA = "key long, digest long, doc_id long, spot long"


class Powers:
    """Powers of the hash base and of its inverse; hashes of ranges come from running sums."""

    def __init__(self, n: int):
        self.up, self.down = self.series(BASE, n + 1), self.series(pow(BASE, -1, 1 << 64), n + 1)

    @staticmethod
    def series(base: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return scramble((sums[stop] - sums[start]) * self.down[start])


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every full window: the tail of one block joined with the head of the next."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    head = np.minimum.accumulate(padded, 1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Runs of the pieces [start, stop) that fill data: piece, first string, last string, anchor, its hash, content digest."""
    width = LENGTH - ANCHOR + 1
    sums = powers.sums(data)
    at = np.arange(len(data) - ANCHOR + 1)
    grams = powers.ranges(sums, at, at + ANCHOR)
    low = np.uint64((1 << 21) - 1)  # the position decides between equal grams, by order alone
    chosen = (sliding_min((grams & ~low) | at.astype(np.uint64), width) & low).astype(np.int64)
    lengths = stops - starts
    piece = np.repeat(np.arange(len(starts)), lengths)[: len(chosen)]
    inside = np.arange(len(chosen)) + LENGTH <= stops[piece]
    begins = inside.copy()
    begins[1:] &= (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(begins)
    last = np.minimum(np.append(first[1:], len(chosen)) - 1, stops[piece[first]] - LENGTH)
    digest = powers.ranges(sums, first, last + LENGTH) ^ scramble((last - first).astype(np.uint64) * np.uint64(BASE) + (chosen[first] - first).astype(np.uint64))
    return piece[first], first, last, chosen[first], grams[chosen[first]], digest


def pack(first: np.ndarray, n_more: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A run within its document: first string, how many more strings, anchor's distance from the first."""
    return (first << 16) | (n_more << 8) | anchor


def unpack(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spot >> 16, (spot >> 8) & 255, spot & 255


def merge_spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch or overlap, joined; spans of one document all have the same length order as their starts."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    apart = np.r_[True, (doc[1:] != doc[:-1])]
    group = np.cumsum(apart) - 1
    step = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * step) - group * step
    fresh = apart.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return doc[at], start[at], np.maximum.reduceat(stop, at)


def mark_rows(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Spans as rows without a key: digest has the start, spot the end."""
    doc, start, stop = merge_spans(doc, start, stop)
    return pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()), pa.array(start), pa.array(doc), pa.array(stop)], names=["key", "digest", "doc_id", "spot"])


def run_rows(key: np.ndarray, digest: np.ndarray, doc: np.ndarray, spot: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(digest), pa.array(doc), pa.array(spot)], names=["key", "digest", "doc_id", "spot"])


def seen_rows(key: np.ndarray) -> pa.RecordBatch:
    """Anchors that many of these runs have, with their number as digest and no document."""
    own, n = np.unique(key, return_counts=True)
    often = n >= SEEN
    return pa.RecordBatch.from_arrays([pa.array(own[often]), pa.array(n[often]), pa.nulls(int(often.sum()), pa.int64()), pa.nulls(int(often.sum()), pa.int64())], names=["key", "digest", "doc_id", "spot"])


def split_first(key: np.ndarray, digest: np.ndarray, doc: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, digest, document and place; and which of that order are the first of their content."""
    order = np.lexsort((spot, doc, digest, key))
    k, d = key[order], digest[order]
    return order, np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the documents (id, body); those that this task has seen before are marks already. And counts of anchors."""
    powers = Powers(SEGMENT + LENGTH + 1)
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        key, digest, doc, spot = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order, first = split_first(key, digest, doc, spot)
        keep, again = order[first], order[~first]
        yield run_rows(key[keep], digest[keep], doc[keep], spot[keep])
        yield seen_rows(key[keep])
        start, more, _ = unpack(spot[again])
        yield mark_rows(doc[again], start, start + more + LENGTH)

    for batch in batches:
        data, offsets = binary_parts(batch.column("body"))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        # pieces: (row, first byte, last byte); long documents overlap by all but one byte of a string
        pieces = [(r, a, min(a + SEGMENT, int(offsets[r + 1]))) for r in range(len(ids)) for a in range(int(offsets[r]), max(int(offsets[r]) + 1, int(offsets[r + 1]) - LENGTH + 1), SEGMENT - LENGTH + 1)]
        pieces = [p for p in pieces if p[2] - p[1] >= LENGTH]
        begin = 0
        while begin < len(pieces):
            stop, size = begin, 0
            while stop < len(pieces) and (stop == begin or size + pieces[stop][2] - pieces[stop][1] <= SEGMENT):
                size += pieces[stop][2] - pieces[stop][1]
                stop += 1
            row, a, b = (np.array(x) for x in zip(*pieces[begin:stop]))
            begin = stop
            lengths = b - a
            ends = np.cumsum(lengths)
            flat = np.concatenate([data[x:y] for x, y in zip(a, b)])
            piece, first, last, anchor, key, digest = runs_of(flat, ends - lengths, ends, powers)
            place = first - (ends - lengths)[piece] + (a - offsets[row])[piece]
            held.append((key.view(np.int64), digest.view(np.int64), ids[row[piece]], pack(place, last - first, anchor - first)))
            if sum(len(x[0]) for x in held) > RUNS_HELD:
                yield from flush()
    if held:
        yield from flush()


def match_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs (and whether their key is hot) sorted by key: marks for repeated content, and the runs whose bytes must be compared (digest 1 under a hot key, ELSEWHERE where other tasks have some)."""
    for table in whole_groups(batches, "key", least_rows=200_000):
        key, digest, doc, spot, hot = numpy_columns(table, "key", "digest", "doc_id", "spot", "hot")
        order, first = split_first(key, digest, doc, spot)
        again, keep = order[~first], order[first]
        start, more, _ = unpack(spot[again])
        yield mark_rows(doc[again], start, start + more + LENGTH)
        _, at, n = np.unique(key[keep], return_inverse=True, return_counts=True)
        n = np.where(hot[keep], ELSEWHERE, n[at])
        keep, n = keep[n > 1], n[n > 1]
        yield run_rows(key[keep], np.where(n == ELSEWHERE, ELSEWHERE, n > HOT), doc[keep], spot[keep])


def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs (key, hot, spot) that each document was asked for; hot ones by block of anchor offsets."""
    out: list[tuple[int, int, int, bytes]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        keys, docs, spots, bodies = zip(*out) if out else ((), (), (), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(spots, pa.int64()), pa.array(bodies, pa.binary())], names=["key", "doc_id", "spot", "body"])

    for batch in slices(batches, SLICE):
        data, offsets = binary_parts(batch.column("body"))
        asked = batch.column("asked")
        bounds = asked.offsets.to_numpy()
        fields = asked.values
        key, hot, spot = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        first, more, anchor = unpack(spot)
        for r, doc in enumerate(batch.column("id").to_pylist()):
            raw = data[int(offsets[r]) : int(offsets[r + 1])].tobytes()
            for q in range(int(bounds[r]), int(bounds[r + 1])):
                a, b, middle = int(first[q]), int(first[q] + more[q]), int(first[q] + anchor[q])
                if not hot[q]:
                    out.append((int(key[q]), doc, (a << 16) | (b - a << 8) | (middle - a), raw[a : b + LENGTH]))
                    held += b - a + LENGTH
                else:
                    for block in range((middle - b) // OFFSET_BLOCK, (middle - a) // OFFSET_BLOCK + 1):
                        lo, hi = middle - block * OFFSET_BLOCK - OFFSET_BLOCK + 1, middle - block * OFFSET_BLOCK
                        core = hashlib.blake2b(raw[hi : lo + LENGTH] + b"%d" % block, digest_size=8).digest()
                        lo, hi = max(lo, a), min(hi, b)
                        out.append((int.from_bytes(core, "little", signed=True), doc, (lo << 16) | (hi - lo << 8) | (middle - lo), raw[lo : hi + LENGTH]))
                        held += hi - lo + LENGTH
                if held > CUT_BYTES:
                    yield flush()
                    held = 0
    if out:
        yield flush()


def plausible(keys: np.ndarray, spots: np.ndarray, bodies: list[bytes]) -> list[tuple[int, int, int]]:
    """Runs (number, first, last string to look at) that share with another run the anchor and the bytes on one of its sides."""
    half = (LENGTH - ANCHOR) // 2
    _, more, anchor = unpack(spots)
    seen: dict[tuple[int, bytes], int] = {}
    sides = []
    for n, body in enumerate(bodies):
        k, m, a = int(keys[n]), int(more[n]), int(anchor[n])
        left = (k, body[a - half : a + ANCHOR]) if a >= half else None
        right = (k, body[a : a + ANCHOR + half]) if a - m <= half else None
        sides.append((left, right))
        for side in {left, right} - {None}:
            seen[side] = seen.get(side, 0) + 1
    out = []
    for n, (left, right) in enumerate(sides):
        m, a = int(more[n]), int(anchor[n])
        ahead, behind = left is not None and seen[left] > 1, right is not None and seen[right] > 1
        if ahead or behind:
            out.append((n, 0 if ahead else max(0, a - half), m if behind else min(m, a - half)))
    return out


def repeated_strings(bodies: list[bytes], counts: np.ndarray, order_key: np.ndarray) -> np.ndarray:
    """Which strings are not the first of their kind. String s of body b starts at byte s < counts[b]; order_key ranks all strings.

    Phrases run from one white-space byte to the next, both included, so none is a prefix of another. Strings of the
    same bytes have the same bytes before their first phrase and neighbour each other in the order of what follows.
    """
    data = np.frombuffer(b"".join(bodies), np.uint8)
    lengths = np.array([len(b) for b in bodies])
    body_stop = np.cumsum(lengths)
    body_start = body_stop - lengths
    stop_of = np.repeat(body_stop, lengths)
    cut = np.flatnonzero((data == 32) | (data == 10))
    powers = Powers(len(data) + 1)
    sums = powers.sums(data)
    string = ragged(body_start, counts)
    # the symbols: phrases, and one separator of its own behind each body
    following = np.append(cut[1:], len(data)) if len(cut) else cut
    phrase_stop = np.minimum(following + 1, stop_of[cut]) if len(cut) else cut
    raw = data.tobytes()
    phrases = [raw[a:b] for a, b in zip(cut.tolist(), phrase_stop.tolist())]
    name = {p: n for n, p in enumerate(sorted(set(phrases)), len(bodies) + 1)}
    body_of_cut = np.searchsorted(body_stop, cut, side="right")
    symbols = np.zeros(len(cut) + len(bodies) + 1, np.int64)
    at = np.arange(len(cut)) + body_of_cut
    symbols[at] = [name[p] for p in phrases]
    separators = np.ones(len(symbols), bool)
    separators[at] = False
    separators[-1] = False
    symbols[separators] = np.arange(1, len(bodies) + 1)
    rank = np.empty(len(symbols), np.int64)
    rank[suffix_array(symbols.tolist())] = np.arange(len(symbols))
    # a string is ordered by what stands before its first cut, then by the suffix there
    next_cut = np.searchsorted(cut, string)
    cut_at = np.append(cut, len(data) + LENGTH)[next_cut]
    far = cut_at >= string + LENGTH
    lead = powers.ranges(sums, string, np.where(far, string + LENGTH, cut_at)) ^ (np.where(far, LENGTH, cut_at - string)).astype(np.uint64)
    follow = np.where(far, -1, rank[np.append(at, 0)[next_cut]])
    order = np.lexsort((order_key, follow, lead))
    ordered = string[order]
    mark = powers.ranges(sums, ordered, ordered + LENGTH)
    same = np.zeros(len(order), bool)
    maybe = np.flatnonzero(mark[1:] == mark[:-1]) + 1
    for part in np.array_split(maybe, max(1, len(maybe) // 10_000)):
        reach = np.arange(LENGTH)
        same[part] = (data[ordered[part][:, None] + reach] == data[ordered[part - 1][:, None] + reach]).all(1)
    kind = np.cumsum(~same)
    order = order[np.lexsort((order_key[order], kind))]
    out = np.zeros(len(order), bool)
    out[order] = same  # within a kind the first place is the one that is unlike what stands before
    return out


def compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from the bytes of runs that are sorted by key."""
    for table in whole_groups(batches, "key", least_bytes=SORTED_BYTES * 4):
        keys, docs, spots = numpy_columns(table, "key", "doc_id", "spot")
        bodies = table.column("body").to_pylist()
        chosen = plausible(keys, spots, bodies)
        marks: list[tuple[np.ndarray, np.ndarray]] = []
        begin = 0
        while begin < len(chosen):
            stop, size = begin, 0
            while stop < len(chosen) and (size < SORTED_BYTES or keys[chosen[stop][0]] == keys[chosen[stop - 1][0]]):
                size += len(bodies[chosen[stop][0]])
                stop += 1
            own = chosen[begin:stop]
            begin = stop
            number, lo, hi = (np.array(x) for x in zip(*own))
            counts = hi - lo + 1
            start = ragged((spots[number] >> 16) + lo, counts)
            doc = np.repeat(docs[number], counts)
            place = np.empty(len(doc), np.int64)
            place[np.lexsort((start, doc))] = np.arange(len(doc))
            hit = repeated_strings([bodies[n][a : b + LENGTH] for n, a, b in own], counts, place)
            marks.append((doc[hit], start[hit]))
        if marks:
            doc, start = (np.concatenate(x) for x in zip(*marks))
            doc, start, stop = merge_spans(doc, start, start + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(stop)], names=["doc_id", "start", "stop"])


def cut_documents(batches: Iterator[pa.RecordBatch], emit_text: bool) -> Iterator[pa.RecordBatch]:
    """The figures of the query, and what is left of each document without its marks if it is wanted."""
    for batch in slices(batches, SLICE):
        rows = []
        for key, body, marks in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), batch.column("marks").to_pylist()):
            kept, at, removed, spans = [], 0, 0, 0
            edge = -1
            for m in sorted((m["start"], m["stop"]) for m in marks or ()):
                if m[0] > edge:
                    spans += 1
                if m[1] > edge:
                    kept.append(body[at : max(at, m[0])])
                    removed += m[1] - max(edge, m[0]) if m[0] <= edge else m[1] - m[0]
                    at = edge = m[1]
            kept.append(body[at:])
            left = b"".join(kept)
            rows.append((key, len(body), removed, spans, hashlib.sha256(left).hexdigest(), left if emit_text else None))
        columns = list(zip(*rows)) if rows else [()] * 6
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def with_unique_ids(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs(doc_id, text) as (id, doc_id, body), id ordering them; and whether ids had to be given out.

    They are doc_id itself unless it is null or repeated somewhere.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    odd = rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("id"), "doc_id", "body"), False
    distinct = materialise(rows.distinct(), "distinct-rows")
    ordered = materialise(distinct.orderBy(F.asc_nulls_first("doc_id"), "body").select(F.monotonically_increasing_id().alias("id"), "doc_id", "body"), "ordered-rows")
    return ordered, True


def remove_repeats(docs: DataFrame, emit_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) for every row of docs(doc_id, text)."""
    rows, given = with_unique_ids(docs)
    bodies = rows.select("id", "body")
    runs = materialise(bodies.mapInArrow(scan_runs, RUN_SCHEMA), "anchor-runs")
    seen = runs.filter("doc_id IS NULL").groupBy("key").agg(F.sum("digest").alias("n")).filter(F.col("n") > HOT)
    hot = materialise(seen.select(F.col("key").alias("hot_key")), "hot-anchors")
    own = runs.filter("key IS NOT NULL AND doc_id IS NOT NULL").join(hot, F.col("key") == F.col("hot_key"), "left")
    own = own.select("key", "digest", "doc_id", "spot", F.col("hot_key").isNotNull().alias("hot"))
    deal = F.when(F.col("hot"), F.xxhash64("key", "digest")).otherwise(F.col("key"))
    dealt = own.withColumn("deal", deal).repartition("deal").drop("deal").sortWithinPartitions("key")
    found = materialise(dealt.mapInArrow(match_runs, RUN_SCHEMA), "suffix-runs")
    marks = runs.filter("key IS NULL").unionByName(found.filter("key IS NULL"))
    marks = materialise(marks.select("doc_id", F.col("digest").alias("start"), F.col("spot").alias("stop")), "equal-marks")
    discard(runs, hot)
    wanted = found.filter("key IS NOT NULL")
    # runs of keys that several tasks have are counted: as many groups as there are such keys
    spread = wanted.filter(F.col("digest") == ELSEWHERE).groupBy("key").count().select(F.col("key").alias("spread_key"), "count")
    spread = materialise(spread, "spread-anchors")
    wanted = wanted.join(spread, wanted["key"] == spread["spread_key"], "left").filter("count IS NULL OR count > 1")
    wanted = wanted.withColumn("hot", F.when(F.col("count").isNull(), F.col("digest")).otherwise((F.col("count") > HOT).cast("long")))
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "hot", "spot")).alias("asked"))
    cut = bodies.join(asked, bodies["id"] == asked["doc_id"]).select("id", "body", "asked").mapInArrow(cut_runs, "key long, doc_id long, spot long, body binary")
    compared = cut.repartition("key").sortWithinPartitions("key").mapInArrow(compare_runs, "doc_id long, start long, stop long")
    compared = materialise(compared, "compared-marks")
    discard(found, spread)
    per_doc = marks.unionByName(compared).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("marks")).withColumnRenamed("doc_id", "marked")
    joined = bodies.join(per_doc, bodies["id"] == per_doc["marked"], "left").select("id", "body", "marks")
    out = joined.mapInArrow(lambda batches: cut_documents(batches, emit_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * emit_text
    if not given:
        return out.select(F.col("id").alias("doc_id"), *columns)
    named = rows.select("id", "doc_id", F.sha2("body", 256).alias("digest")).join(out, "id").select("doc_id", "digest", *columns)
    again = docs.select(F.col("doc_id").cast("long").alias("d"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias("t"))
    return again.join(named, again["d"].eqNullSafe(named["doc_id"]) & (again["t"] == named["digest"])).select("doc_id", *columns)
