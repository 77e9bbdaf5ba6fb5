"""N-grams of many documents packed into few rows, so that little is shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that a task packs at once; the document at the end stays whole.
TOKENS_AT_ONCE = 1_000_000


def sizes_of(docs: pa.RecordBatch) -> np.ndarray:
    """The number of tokens of each row."""
    return pc.fill_null(pc.list_value_length(docs.column("tokens")), 0).to_numpy(zero_copy_only=False)


def mixed(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """A hash of three hashes."""
    h = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F) + third * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(33)


def counted_trigrams(owner: np.ndarray, doc: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """owner, first, second, third, times of every distinct trigram of codes 1 to n - 1; third is 0 where a document ends."""
    inside = doc[:-1] == doc[1:]
    third = np.zeros(len(inside), np.int64)
    third[:-1] = np.where(doc[:-2] == doc[2:], codes[2:], 0)
    pairs, place = np.unique((owner[:-1][inside] * n + codes[:-1][inside]) * n + codes[1:][inside], return_inverse=True)
    found, times = np.unique(place * n + third[inside], return_counts=True)
    pair = pairs[found // n]
    return pair // n // n, pair // n % n, pair % n, found % n, times


def packer(group: Sequence[str], schema: pa.Schema, buckets: int, longest_part: int, tokens_at_once: int = TOKENS_AT_ONCE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows of group, tokens: group, bucket, times, lines.

    A line is a trigram, or the bigram at the end of a document; it occurs so many times in the documents that the task had
    at once. All lines of a group that begin with the same bigram are in one bucket.
    """

    def packed(docs: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        ids: dict[tuple, int] = {}
        owners = [ids.setdefault(key, len(ids)) for d in docs for key in zip(*[d.column(g).to_pylist() for g in group])]
        sizes = np.concatenate([sizes_of(d) for d in docs])
        words = pc.utf8_slice_codeunits(pa.concat_arrays([d.column("tokens").flatten() for d in docs]), 0, longest_part)
        if len(words) < 2:
            return None
        coded = words.dictionary_encode()
        names = coded.dictionary
        owner = np.repeat(np.array(owners, np.int64), sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        own, first, second, third, times = counted_trigrams(owner, doc, coded.indices.to_numpy().astype(np.int64) + 1, len(names) + 1)
        if not len(own):
            return None
        hashes = np.array([0, *[zlib.crc32(w.encode()) for w in names.to_pylist()]], np.uint64)
        group_hashes = np.array([zlib.crc32(repr(key).encode()) for key in ids], np.uint64)
        bucket = (mixed(hashes[first], hashes[second], group_hashes[own]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((times, own, bucket))
        own, times, bucket = own[order], times[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(own) != 0) | (np.diff(times) != 0)])
        parts = [names.take(pa.array(c[order] - 1, mask=c[order] == 0)) for c in (first, second, third)]
        lines = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[starts, len(own)], pa.int32()), lines), "\n")
        keys = list(zip(*ids))
        groups = [pa.array(keys[i], schema.field(g).type).take(pa.array(own[starts])) for i, g in enumerate(group)]
        rest = [pa.array(bucket[starts], pa.int32()), pa.array(times[starts], pa.int64()), texts]
        return pa.RecordBatch.from_arrays([*groups, *rest], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = [], 0
        for batch in batches:
            upto, at, before = np.cumsum(sizes_of(batch), dtype=np.int64), 0, 0
            while at < batch.num_rows:
                end = min(int(np.searchsorted(upto, before + tokens_at_once - held)) + 1, batch.num_rows)
                docs.append(batch.slice(at, end - at))
                held += int(upto[end - 1]) - before
                at, before = end, int(upto[end - 1])
                if held >= tokens_at_once:
                    if (out := packed(docs)) is not None:
                        yield out
                    docs, held = [], 0
        if docs and (out := packed(docs)) is not None:
            yield out

    return pack
