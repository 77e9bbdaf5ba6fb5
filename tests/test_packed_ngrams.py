"""N-grams are counted from few packed rows: the counts are those of all places."""

import random
from collections import Counter

import pyarrow as pa

from lodestone.operators import corpus
from lodestone.operators.packed import packer
from lodestone.plans.queries import QUERIES


def brute(rows, least):
    count = Counter()
    for group, _, tokens in rows:
        words = [w[:40] for w in tokens]
        count.update((group, " ".join(words[p : p + k])) for k in (2, 3) for p in range(len(words) - k + 1))
    return {(*key, n) for key, n in count.items() if n >= least}


def some_rows():
    dice = random.Random(7)
    long = ["x" * 40 + "left", "x" * 40 + "right"]
    rows = [(g, d, dice.choices(["ab", "bc", "cd", "it's", *long], k=dice.choice([0, 1, 2, 3, 9]))) for g in ("s", "t", None) for d in range(200)]
    return rows + [("pair", 1, ["hot", "pair"] * 500), ("one", 1, ["ab"]), ("two", 1, ["ab", "bc"]), ("two", 2, ["ab", "bc"])]


def test_counts_are_of_all_places(spark):
    rows = some_rows()
    tokens = spark.createDataFrame(rows, "source string, doc long, tokens array<string>").repartition(3)
    for buckets in (1, 7):
        for least in (1, 2):
            got = corpus.repeated_ngrams(tokens, ["source"], buckets, least).collect()
            assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(rows, least)


def test_groups_of_two_columns(spark):
    rows = some_rows()
    tokens = spark.createDataFrame([(g, d % 2, w) for g, d, w in rows], "source string, half long, tokens array<string>")
    got = {((r["source"], r["half"]), r["ngram"], r["occurrences"]) for r in corpus.repeated_ngrams(tokens, ["source", "half"], 5).collect()}
    assert got == brute([((g, d % 2), d, w) for g, d, w in rows], 2)


def test_tokens_are_packed_in_pieces():
    """What a task holds at once is bounded, and the pieces add up."""
    rows = some_rows()
    schema = pa.schema([("source", pa.string()), ("bucket", pa.int32()), ("times", pa.int64()), ("lines", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows])], names=["source", "tokens"])
    pieces = [batch.slice(0, 0), batch.slice(0, 400), *[batch.slice(at, 50) for at in range(400, len(rows), 50)]]
    out = list(packer(["source"], schema, 3, 40, tokens_at_once=300)(iter(pieces)))
    assert all(sum(r["times"] * len(r["lines"].split("\n")) for r in x.to_pylist()) <= 1300 for x in out)
    assert len(out) > 3 and {b for x in out for b in x.column("bucket").to_pylist()} == {0, 1, 2}
    count = Counter()
    for source, times, lines in ((r["source"], r["times"], r["lines"]) for x in out for r in x.to_pylist()):
        for line in lines.split("\n"):
            count.update({(source, g): times for g in {" ".join(line.split(" ")[:2]), line}})
    assert {(*key, n) for key, n in count.items() if n >= 2} == brute(rows, 2)


def test_no_row_for_each_place_is_shuffled(spark, small):
    """N-grams become rows only behind the one exchange, and nothing is written before it."""
    plan = QUERIES["ngram_counts"](spark, small)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange ", 1)
    assert "Generate explode" in above and "Generate" not in below and "Exchange" not in below and "ngram" not in below
