"""Fill-in-the-middle transformation over ropes.

A text is a rope: leaves hold up to LEAF code points of it and cache how many units begin in them and how many code points
they have; inner nodes cache the sums. A unit is a run of ASCII letters or one other code point. Splitting at a unit rank
walks down by the cached unit counts, so prefix, middle and suffix are subtrees that share their leaves with the text; the
output concatenates them with sentinels. It is inverted by splitting the output's rope, at code-point ranks this time.

Null text counts as empty; an empty text, or one that contains a sentinel, stays plain, and so do the texts that the key
leaves out. The key is hashed with a seed: a null key hashes like an empty one, and rows that share a key share its draws.
Texts of any length are split in logarithmic steps. Functions work on columns, so other columns of any name stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = 512
#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
FIM_TYPE = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def unit_starts(text: str) -> np.ndarray:
    """For each code point whether a unit begins with it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points | 32) - 97 < 26
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return begins


class Leaf:
    """A piece of text. `begins` marks the code points that begin a unit of the text it was cut from."""

    __slots__ = ("text", "begins", "units", "chars")

    def __init__(self, text: str, begins: np.ndarray, units: int | None = None):
        self.text, self.begins, self.chars = text, begins, len(text)
        self.units = int(np.count_nonzero(begins)) if units is None else units

    def cut(self, at: int) -> tuple[Leaf, Leaf]:
        return Leaf(self.text[:at], self.begins[:at]), Leaf(self.text[at:], self.begins[at:])


class Node:
    """Two ropes in a row."""

    __slots__ = ("left", "right", "units", "chars")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.units, self.chars = left.units + right.units, left.chars + right.chars


Rope = Leaf | Node
EMPTY = Leaf("", np.zeros(0, bool))


def join(parts: Sequence[Rope]) -> Rope:
    """One balanced tree over the parts in their order."""
    level = [p for p in parts if p.chars]
    while len(level) > 1:
        level = [Node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def rope(text: str) -> Rope:
    begins = unit_starts(text)
    return join([Leaf(text[a : a + LEAF], begins[a : a + LEAF]) for a in range(0, len(text), LEAF)])


def split_units(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest. A unit that runs over leaves stays whole: the cut is where the next one begins."""
    if rank >= tree.units:
        return tree, EMPTY
    if isinstance(tree, Leaf):
        return tree.cut(int(np.flatnonzero(tree.begins)[rank]))
    if rank < tree.left.units:
        head, tail = split_units(tree.left, rank)
        return head, join([tail, tree.right])
    head, tail = split_units(tree.right, rank - tree.left.units)
    return join([tree.left, head]), tail


def split_chars(tree: Rope, at: int) -> tuple[Rope, Rope]:
    """The first `at` code points, and the rest."""
    if at <= 0:
        return EMPTY, tree
    if at >= tree.chars:
        return tree, EMPTY
    if isinstance(tree, Leaf):
        return tree.cut(at)
    if at < tree.left.chars:
        head, tail = split_chars(tree.left, at)
        return head, join([tail, tree.right])
    head, tail = split_chars(tree.right, at - tree.left.chars)
    return join([tree.left, head]), tail


def leaves(tree: Rope) -> Iterator[str]:
    open_nodes = [tree]
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, Leaf):
            yield node.text
        else:
            open_nodes += (node.right, node.left)


def whole(tree: Rope) -> str:
    return "".join(leaves(tree))


def sentinel(text: str) -> Leaf:
    return Leaf(text, np.zeros(len(text), bool), 0)


def rearrange(text: str, first: int, last: int, form: str, marks: Sequence[str] = SENTINELS) -> tuple[str, int, int]:
    """Output and the code points of prefix and middle, which end after `first` and `last` units."""
    head, suffix = split_units(rope(text), last)
    prefix, middle = split_units(head, first)
    p, s, m = map(sentinel, marks)
    order = [s, suffix, p, prefix, m, middle] if form == SPM else [p, prefix, s, suffix, m, middle]
    return whole(join(order)), prefix.chars, middle.chars


def restore(output: str, form: str, marks: Sequence[str] = SENTINELS) -> str:
    """The text that rearrange() took. No text that was rearranged holds a sentinel, so each is found where it was put."""
    if form == PLAIN:
        return output
    order = [marks[1], marks[0], marks[2]] if form == SPM else [marks[0], marks[1], marks[2]]
    at, parts, rest, before = [output.index(m) for m in order], [], rope(output), 0
    for begin, mark, end in zip(at, order, [*at[1:], len(output)]):
        _, rest = split_chars(rest, begin + len(mark) - before)
        part, rest = split_chars(rest, end - begin - len(mark))
        parts.append(part)
        before = end
    if form == SPM:
        suffix, prefix, middle = parts
    else:
        prefix, suffix, middle = parts
    return whole(join([prefix, middle, suffix]))


def draws(key: str, seed: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, key: str, rate: int, spm_rate: int, seed: str, marks: Sequence[str]) -> tuple:
    """n, form, prefix_chars, middle_chars, output."""
    n = int(np.count_nonzero(unit_starts(text)))
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, PLAIN, None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = SPM if h4 % 100 < spm_rate else PSM
    output, prefix_chars, middle_chars = rearrange(text, first, last, form, marks)
    return n, form, prefix_chars, middle_chars, output


def checked(marks: Sequence[str]) -> tuple[str, ...]:
    """Sentinels that can't be found across a border: none begins with a character that stands further on in one, or with another."""
    for a in marks:
        if not a or any(a[0] in b[1:] for b in marks) or sum(b.startswith(a) for b in marks) > 1:
            raise ValueError(f"sentinels could be found where none was put: {list(marks)}")
    return tuple(marks)


def fim(text: Column, key: Column, rate: int = 90, spm_rate: int = 20, seed: str = "1", marks: Sequence[str] = SENTINELS) -> Column:
    """Struct of n, form, prefix_chars, middle_chars (null if plain) and output.

    `rate` of 100 texts are transformed, `spm_rate` of 100 of those with the suffix first.
    """
    marks = checked(marks)

    @F.arrow_udf(FIM_TYPE)
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        rows = (transform(t.as_py() or "", k.as_py() or "", rate, spm_rate, seed, marks) for t, k in zip(texts, keys))
        n, form, prefix_chars, middle_chars, output = map(list, zip(*rows)) if len(texts) else ([],) * 5
        parts = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(output, pa.string())]
        return pa.StructArray.from_arrays(parts, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return run(text.cast("string"), key.cast("string"))


def restored(output: Column, form: Column, marks: Sequence[str] = SENTINELS) -> Column:
    """The text that fim() made output of."""
    marks = tuple(marks)

    @F.arrow_udf("string")
    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([None if o.as_py() is None else restore(o.as_py(), f.as_py(), marks) for o, f in zip(outputs, forms)], pa.string())

    return run(output, form)


def fim_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row of docs(doc_id, text)."""
    made = docs.select("doc_id", fim(F.col("text"), F.col("doc_id")).alias("made")).select("doc_id", "made.*")
    back = made.withColumn("restored", restored(F.col("output"), F.col("form")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
