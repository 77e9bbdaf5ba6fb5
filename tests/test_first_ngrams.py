"""The first n-grams of a group are found in few documents, whatever repeats; their occurrences are counted in all."""

from collections import Counter

from lodestone.operators import corpus


def brute(rows, n, most):
    """group -> (ngram, occurrences) in order, of all n-grams."""
    out = set()
    for group in {g for g, _, _ in rows}:
        count, seen = Counter(), {}
        for _, doc, words in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
            for k in (2, 3):
                for p in range(len(words) - k + 1):
                    gram = " ".join(words[p : p + k])
                    count[gram] += 1
                    seen.setdefault(gram, (doc, k, p))
        early = sorted(seen, key=seen.get)[:most]
        kept = [g for g in early if count[g] >= 2 and len(set(g.split())) == len(g.split())]
        best = {}
        for g in sorted(kept, key=lambda g: (-count[g], seen[g])):
            best.setdefault(tuple(sorted(g.split())), g)
        out |= {(group, g, count[g], i) for i, g in enumerate(list(best.values())[:n], 1)}
    return out


def test_copies_before_new_texts(spark):
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows = [(g, d, words[:6]) for g in ("copies", None) for d in range(60)]
    rows += [(g, 60 + d, words[d : d + 7]) for g in ("copies", None, "few") for d in range(80)]
    tokens = spark.createDataFrame(rows, "source string, doc long, tokens array<string>")
    parts = corpus.first_ngrams(tokens, ["source"], 20)
    assert len(parts) > 1
    got = {tuple(r) for r in corpus.top_ngrams(tokens, ["source"], 30, 20).select("source", "ngram", "occurrences", "rank").collect()}
    assert got == brute(rows, 30, 20)


def test_few_ngrams_are_shuffled(spark):
    """Only documents up to the last of the first n-grams are grouped by n-gram."""
    rows = [("s", d, [f"w{chr(97 + d % 26)}{chr(97 + p)}" for p in range(20)]) for d in range(400)]
    tokens = spark.createDataFrame(rows, "source string, doc long, tokens array<string>")
    first = corpus.first_ngrams(tokens, ["source"], 30)
    assert sum(t.count() for t in first) == 30 and len(first) == 1


def test_all_ngrams_count(spark):
    """N-grams that come after the first ten thousand of a group are as good as others."""
    rows = [("many", d, [f"w{chr(97 + d // 26)}{chr(97 + d % 26)}{chr(97 + p // 26)}{chr(97 + p % 26)}" for p in range(60)]) for d in range(100)]
    rows += [(g, 100 + d, ["late", "comers", "after", "them", f"x{d % 3}"][d % 2 :]) for g in ("many", None, "few") for d in range(9)]
    rows += [("many", 200, ["comers", "late"]), ("many", 201, ["comers", "late"])]
    tokens = spark.createDataFrame(rows, "source string, doc long, tokens array<string>")
    for doc in ("doc", "array(doc)"):
        got = {tuple(r) for r in corpus.top_ngrams(tokens.selectExpr("source", f"{doc} AS doc", "tokens"), ["source"], 6, None).select("source", "ngram", "occurrences", "rank").collect()}
        assert got == brute(rows, 6, 1 << 60) and ("many", "after them", 9, 2) in got
    assert got != brute(rows, 6, 10_000)
