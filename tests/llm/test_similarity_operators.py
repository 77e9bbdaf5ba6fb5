"""Jaccard join and embedding search against brute force; components."""

import re

from collections import Counter

import numpy as np
import pytest

from lodestone.llm import jaccard_join, voronoi
from lodestone.llm.embedding_dedup import near_duplicates, plan_tables
from lodestone.llm.graph import connected_components
from lodestone.llm.jaccard_join import jaccard_components, keep_firsts
from lodestone.llm.queries import op7_ngram_jaccard_join, op8_embedding_near_dedup


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = roots(pairs, ids)
    return {d: (len(sets[d]), top[d]) for d in ids}


def near_rows(seed):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        base = list(r.choice(vocabulary, r.choice([3, 5, 6, 20, 80, 200])))
        for c in range(r.integers(1, 10)):
            copy = list(base)
            for _ in range(r.integers(0, max(2, len(copy) // 18))):
                copy[r.integers(len(copy))] = str(r.choice(vocabulary))
            rows.append((len(rows) * 3, " ".join(copy).upper() if c % 4 == 0 else "\t".join(copy)))
    return [*rows, (9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "ONE"), (9006, "é"), (9007, "É"), (9008, "word " * 3000)]


def test_jaccard_is_brute_force(spark):
    rows = near_rows(1)
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, component_id int, tokens string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()} == brute_components(rows)


def test_jaccard_of_very_long_texts(spark, monkeypatch):
    """Near copies of texts that are longer than what is hashed at once, in tasks and in regions."""
    r = np.random.default_rng(6)
    base = r.choice([f"word{i}" for i in range(400)], 70_000)
    rows = [(9, " ".join(base))]
    for n, edits in enumerate((100, 1200, 3000)):
        copy = base.copy()
        copy[r.choice(len(copy), edits, replace=False)] = "edited"
        rows.append((n, " ".join(copy)))
    rows += [(20, " ".join(base[:30_000])), (21, "short text of a few words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) < len(rows)
    found = lambda: {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert found() == want
    smaller(monkeypatch, 2, 2)
    assert found() == want


def smaller(monkeypatch, leaf, pivots):
    for name, value in (("LEAF", leaf), ("PIVOTS", pivots), ("PART_SETS", 5), ("PAIRED", 2 * leaf)):
        monkeypatch.setattr(voronoi, name, value)


def test_jaccard_large_cells_in_regions(spark, monkeypatch):
    rows = near_rows(2)
    smaller(monkeypatch, 3, 3)
    monkeypatch.setattr(jaccard_join, "REGION", 4)
    monkeypatch.setattr(jaccard_join, "FREQUENT_DOCS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()} == brute_components(rows)


def cell_links(spark, cells, apart=None):
    """Components of what is found in cells of sets, and those of brute force."""
    rows = [(c, i, sorted(s)) for c, sets in cells.items() for i, s in sets.items()]
    found = voronoi.join_cells(spark.createDataFrame(rows, "cell long, id long, tokens array<long>"), apart or (lambda rest: rest.select("id", "cell")))
    links = [tuple(x) for part in found for x in part.collect()]
    sets = {i: set(s) for _, i, s in rows}
    want = [(i, j) for own in cells.values() for i in own for j in own if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert all((min(p), max(p)) in set(want) for p in links)
    return roots(links, sets), roots(want, sets)


@pytest.mark.parametrize("leaf", [2, 100])
def test_cells_in_regions(spark, monkeypatch, leaf):
    smaller(monkeypatch, leaf, 3)
    r = np.random.default_rng(4)
    base = np.arange(1, 101)
    close = {i: set(r.choice(base, 92, replace=False).tolist()) | {1000 + i} for i in range(40)}
    groups = {100 + i: set(range(2000 + 70 * (i % 5), 2100 + 70 * (i % 5))) - {2000 + 70 * (i % 5) + int(x) for x in r.integers(0, 100, 7)} for i in range(40)}
    got, want = cell_links(spark, {0: close, 1: groups})
    assert got == want


def test_regions_keep_chains(spark, monkeypatch):
    """Neighbours whose pivots differ, in chains through many regions."""
    smaller(monkeypatch, 2, 2)
    chain = {i: set(range(10 * k, 10 * k + 100)) for k, i in enumerate((1, 3, 4, 2, 9, 7, 8, 6, 5))}
    far = {i: set(range(1000 * i, 1000 * i + 100)) for i in range(10, 16)}
    got, want = cell_links(spark, {0: chain | far, 1: {100 + i: s for i, s in chain.items()}})
    assert got == want and len(set(want.values())) == 8


def test_cells_that_pivots_do_not_divide(spark, monkeypatch):
    """Sets that are all equally far from each other, but for a few links, go to blocks when nothing tells them apart."""
    smaller(monkeypatch, 4, 3)
    shared = set(range(60))
    alike = {i: shared | set(range(1000 * i, 1000 * i + 60)) for i in range(1, 31)}
    alike |= {100 + i: (alike[i] - {0, 1, 2}) | {-i} for i in range(1, 8)}
    got, want = cell_links(spark, {0: alike})
    assert got == want and sum(want[i] != i for i in want) == 7
    got, _ = cell_links(spark, {0: alike}, lambda rest: jaccard_join.cells_of(jaccard_join.reordered(rest)))
    assert got == want


def test_first_rows_of_components(spark):
    docs = spark.createDataFrame([(5, "a b c d e", 1), (5, "a b c d f", 2), (3, "A B C D E", 3), (None, "a b c d f", 4), (7, None, 5), (7, "x", 6)], "doc_id long, text string, id long")
    assert sorted(r["id"] for r in keep_firsts(docs).collect()) == [3, 4, 5, 6]
    alone = docs.filter("doc_id = 3 OR id = 1 OR id = 6")
    got = keep_firsts(alone)
    assert sorted(r["id"] for r in got.collect()) == [3, 6] and got.columns == docs.columns


def test_jaccard_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7_ngram_jaccard_join(spark, small).collect()} == brute_components(rows)


def test_jaccard_odd_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "A B C D E"), (7, "f g h i j"), (7, "a b c d e")], "doc_id long, text string")
    got = sorted(jaccard_components(docs).collect(), key=repr)
    assert len(got) == 5 and sum(r["component_id"] is None for r in got) == 4  # the row with the null id comes first
    assert jaccard_components(docs.limit(0)).count() == 0


def test_join_cell_windows():
    r = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.r_[r.choice(base, 100 - k, replace=False), np.arange(1000 + 50 * i, 1000 + 50 * i + k // 2, dtype=np.uint64)]) for i, k in enumerate(r.integers(0, 40, 30))]
    want = roots([(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))], range(30))
    assert roots(voronoi.join_cell(list(range(30)), sets), range(30)) == want


def test_components(spark):
    links = [(1, 2), (3, 2), (5, 4), (9, 9), (7, 8), (8, 6), (6, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots([p for p in links if p[0] != p[1]], {x for p in links for x in p if p[0] != p[1]})
    assert got == want


def brute_vectors(rows):
    rows = [(v, np.array(e, float), label) for v, e, label in rows]
    pairs = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if a[2] == b[2] and a[2] is not None and a[1] @ b[1] >= 0.93 * np.linalg.norm(a[1]) * np.linalg.norm(b[1])]
    top = roots(pairs, [r[0] for r in rows])
    return {v: (sum(v in p for p in pairs), top[v]) for v, _, _ in rows}


def clusters(seed, n=240, dimension=24):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dimension))
    return [(i * 2, (centres[i % 12] + r.normal(size=dimension) * r.choice([0.05, 0.2, 0.32])).tolist(), int(i % 12 % 3) if i % 17 else None) for i in range(n)]


def test_vectors_recall(spark):
    rows = clusters(1)
    rows += [(1001, rows[0][1], rows[0][2]), (1003, rows[0][1], rows[0][2])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, label int, weight int")).collect()}
    want = brute_vectors(rows)
    assert set(got) == set(want)
    assert all(got[v][0] <= want[v][0] for v in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values()) > 0


@pytest.mark.parametrize("dimension", [2, 3, 4, 8, 16, 24, 64, 384])
def test_pairs_at_the_threshold_meet(dimension):
    """Of pairs just above the threshold, the share that meets in a bucket, with the tables of small and large inputs."""
    from lodestone.llm import embedding_dedup as E

    r = np.random.default_rng(dimension)
    for n, m in ((10**3, 800), (10**6, 400), (10**9, 120)):
        a, away = E.unit_rows(r.normal(size=(m, dimension))), r.normal(size=(m, dimension))
        away = E.unit_rows(away - (away * a).sum(1, keepdims=True) * a)
        b = 0.931 * a + np.sqrt(1 - 0.931**2) * away
        hashes, tables = plan_tables(n, dimension)
        axes = [E.nearest_axes(x, hashes, tables) for x in (a, b)]
        one, two = (E.bucket_keys(np.zeros(m, np.uint64), x) for x in axes)
        met = ((one[:, :, :1] == two).any(2) | (two[:, :, :1] == one).any(2)).any(1).mean()
        assert met >= 0.95, (n, met)


def test_vectors_in_blocks(spark, monkeypatch):
    from lodestone.llm import embedding_dedup

    rows = clusters(2, 150)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, near_duplicates(frame).collect()))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 3)
    assert sorted(map(tuple, near_duplicates(frame).collect())) == whole


def test_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [float("inf"), 1.0], 1), (11, [1.0, 0.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(frame).collect()}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False)
    assert all(got[v] == (0, v, True) for v in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, True)
    assert near_duplicates(frame.limit(0)).count() == 0


def test_vectors_of_any_scale_and_repeated_ids(spark):
    rows = [(1, [1e-170, 0.0], 1), (2, [2e-170, 0.0], 1), (3, [1e200, 1.0], 2), (4, [1e200, 2.0], 2), (5, [1.0, 0.0], 3), (5, [1.0, 0.0], 3), (6, [1.0, 0.01], 3), (7, [0.0, 1.0], 4), (7, [1.0, 1.0], 4), (8, [0.0, 1.0], 4), (9, [1.0, 1.0], 4)]
    got = Counter(map(tuple, near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 2, 7, True), (7, 2, 7, True), (8, 1, 7, False), (9, 1, 7, False)]
    assert got == Counter(want)


def test_vectors_in_large_buckets(spark, monkeypatch):
    """The products of large buckets and the pairs of small ones give the same."""
    from lodestone.llm import embedding_dedup

    frame = spark.createDataFrame(clusters(4, 150), "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, near_duplicates(frame).collect()))
    monkeypatch.setattr(embedding_dedup, "SMALL", 2)
    assert sorted(map(tuple, near_duplicates(frame).collect())) == whole


def test_vector_query(spark, small):
    assert op8_embedding_near_dedup(spark, small).count() == 500


@pytest.mark.parametrize("n", [1, 10_000, 10**11])
def test_plan_tables(n):
    hashes, tables = plan_tables(n, 64)
    assert (1 - 0.6**hashes) ** tables <= 0.01
