"""External k-way merge of sorted runs by tournament trees.

A run is an iterator of blocks: two-dimensional arrays of whole numbers, whose rows rise from block to block. Every run has
one block in memory; more runs than FAN are merged in passes, whose results go to a file of the task that is deleted with it.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np

FAN = 128
#: Rows of a block.
ROWS = 2048


class Cursor:
    """The head of a run. `key` is None once the run has ended."""

    __slots__ = ("blocks", "keys", "at", "key")

    def __init__(self, blocks: Iterator[np.ndarray]):
        self.blocks, self.keys, self.at, self.key = blocks, [], -1, None
        self.step()

    def step(self) -> None:
        self.at += 1
        while self.at >= len(self.keys):
            block = next(self.blocks, None)
            if block is None:
                self.key = None
                return
            self.keys, self.at = list(map(tuple, block.tolist())), 0
        self.key = self.keys[self.at]

    def rest(self) -> Iterator[np.ndarray]:
        if self.key is not None:
            yield np.array(self.keys[self.at :], np.int64)
            yield from self.blocks


def merge(runs: Sequence[Iterator[np.ndarray]], stop: int | None = None) -> Iterator[np.ndarray]:
    """Blocks of all rows in rising order. After `stop` rows the others follow as they come, run by run.

    Every inner node of the tree keeps the run that lost there. When the winner steps on, only the nodes on its way up are
    played again.
    """
    cursors = [Cursor(r) for r in runs]
    k = len(cursors)
    if not k:
        return

    def beats(a: int, b: int) -> bool:
        x, y = cursors[a].key, cursors[b].key
        return y is None or (x is not None and x <= y)

    # leaves are k .. 2k - 1; the first games are played from the last inner node up
    winners, losers = [*range(k), *range(k)], [0] * k
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    taken, left = [], stop
    while cursors[best].key is not None and left != 0:
        taken.append(cursors[best].key)
        cursors[best].step()
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2
        left = None if left is None else left - 1
        if len(taken) >= ROWS:
            yield np.array(taken, np.int64)
            taken = []
    if taken:
        yield np.array(taken, np.int64)
    for cursor in cursors:
        yield from cursor.rest()


class Spool:
    """Blocks of several runs in one temporary file, in memory as long as it is small."""

    def __init__(self, columns: int, held: int = 1 << 26):
        self.file, self.columns, self.end = tempfile.SpooledTemporaryFile(max_size=held), columns, 0
        self.places: list[list[tuple[int, int]]] = []

    def new_run(self) -> None:
        self.places.append([])

    def add(self, data: bytes) -> None:
        """Rows of the latest run, as bytes of whole numbers."""
        self.file.seek(self.end)
        self.file.write(data)
        self.places[-1].append((self.end, len(data)))
        self.end += len(data)

    def runs(self) -> list[Iterator[np.ndarray]]:
        return [self.read(p) for p in self.places]

    def read(self, places: list[tuple[int, int]]) -> Iterator[np.ndarray]:
        size = ROWS * self.columns * 8
        for begin, length in places:
            for at in range(0, length, size):
                self.file.seek(begin + at)
                yield np.frombuffer(self.file.read(min(size, length - at)), np.int64).reshape(-1, self.columns)


def merge_all(runs: Sequence[Iterator[np.ndarray]], columns: int, stop: int | None = None, fan: int = FAN) -> Iterator[np.ndarray]:
    """merge() of any number of runs, `fan` at a time."""
    level = list(runs)
    while len(level) > fan:
        spool = Spool(columns)
        for group in itertools.batched(level, fan):
            spool.new_run()
            for block in merge(group):
                spool.add(block.tobytes())
        level = spool.runs()
    return merge(level, stop)
