"""Phrases in texts by automata, against a test of every pair."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import containment
from lodestone.operators.containment import phrase_coverage, phrase_hits

TEXTS = "grp string, text_id long, text string, place int, phrase string"
PHRASES = "grp string, place int, phrase string"


def made(seed, groups, n_texts, n_phrases):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé ", k=rng.randint(0, 4)))
    texts = [(rng.choice(groups), i, rng.choice([None, "", "".join(word() for _ in range(9))]) if i % 5 == 0 else "".join(word() for _ in range(12)), 1, "x") for i in range(n_texts)]
    phrases = [(rng.choice(groups), rng.randint(0, 9), rng.choice([None, ""]) if i % 17 == 0 else word() + word()) for i in range(n_phrases)]
    return texts, phrases


def hits_by_hand(texts, phrases):
    return Counter((g, i, p, w) for g, i, t, *_ in texts for h, p, w in phrases if g == h and t is not None and w is not None and w in t)


def coverage_by_hand(texts, phrases, most):
    out = []
    for g, i, t, *_ in texts:
        own = [(p, w) for h, p, w in phrases if h == g and w is not None]
        found = [x for x in own if t is not None and x[1] in t]
        missing = sorted((x for x in own if t is None or x[1] not in t), key=lambda x: x)
        out.append((g, i, len(found), len(own), tuple(w for _, w in missing[:most])))
    return Counter(out)


def check(spark, texts, phrases, most=3):
    t, p = spark.createDataFrame(texts, TEXTS).repartition(5), spark.createDataFrame(phrases, PHRASES).repartition(3)
    assert Counter(tuple(r) for r in phrase_hits(t, p, ["grp"]).collect()) == hits_by_hand(texts, phrases)
    got = Counter((r["grp"], r["text_id"], r["found"], r["total"], tuple(r["missing"])) for r in phrase_coverage(t, p, ["grp"], most).collect())
    assert got == coverage_by_hand(texts, phrases, most)


def test_every_pair(spark):
    check(spark, *made(1, ["a", "b", None, "only texts"], 60, 40))
    check(spark, [], made(2, ["a"], 0, 9)[1])
    check(spark, made(3, ["a"], 9, 0)[0], [])


def test_hot_groups_and_many_phrases(spark, monkeypatch):
    """A group with nearly all texts is dealt over salts, its phrases over shards."""
    monkeypatch.setattr(containment, "FEW", 20)
    monkeypatch.setattr(containment, "HOT_SHARE", 0.1)
    monkeypatch.setattr(containment, "SHARD", 7)
    monkeypatch.setattr(containment, "BATCH", 4)
    texts, phrases = made(4, ["a", "a", "a", "a", "b", None], 150, 90)
    check(spark, texts, phrases)
    rows = containment.dealt(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(phrases, PHRASES), ["grp"])
    keys = rows.filter("grp = 'a'").select("__key.salt", "__key.shard").distinct().collect()
    assert len({k["salt"] for k in keys}) >= 4 and len({k["shard"] for k in keys}) >= 4


def test_labels_and_long_texts(spark):
    texts = spark.createDataFrame([("g", 1, "x" * 200_000 + "needle" + "y" * 200_000)], "grp string, text_id long, text string")
    phrases = spark.createDataFrame([("g", 1, "needle", "Needle"), ("g", 2, "xy", "XY"), ("g", 3, "xneedley", "Whole")], "grp string, place int, phrase string, label string")
    assert sorted(r["label"] for r in phrase_hits(texts, phrases, ["grp"]).collect()) == ["Needle", "Whole"]
    assert phrase_coverage(texts, phrases, ["grp"]).select("found", "total", F.element_at("missing", 1)).first() == (2, 3, "XY")
