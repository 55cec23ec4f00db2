import math
import random
import re
from collections import Counter

import pytest

from donorloom.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def best(docs, queries, k):
    """Scores of all documents for all queries."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(1 for h in held if h[2]), sum(h[2] for h in held)
    df = Counter(w for h in held for w in h[1])
    out = []
    for item, text in set(queries):
        found = []
        for i, tf, size in held:
            score = 0
            for w in set(terms(text)) & set(tf):
                m = 100 - 50 + 50 * size * n // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def tables(spark, docs, queries):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, term string").repartition(3), spark.createDataFrame([(*q, 2) for q in queries], "item_id long, text string, score int")


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, small):
    """Both ways of joining, lists in parts, several blocks of queries; nulls, copies, ties, repeated rows and ids, a long text."""
    if small:
        for name, value in (("LIST_ROWS", 7), ("BLOCK_PAIRS", 30), ("SENT_ROWS", 0), ("HELD", 40)):
            monkeypatch.setattr(R, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "É9"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return rng.choice([" ", ", ", "-"]).join(rng.choice([w, w.upper() if w.isascii() else w]) for w in rng.choices(words, weights, k=n))

    docs = [(i, text(rng.randint(1, 40))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(3, docs[3][1]), (3, "other w50"), (None, docs[7][1]), (None, docs[7][1]), (400, None), (401, ""), (402, "?!"), (403, text(60_000))]
    rng.shuffle(docs)
    queries = [(i, text(rng.randint(1, 12))) for i in range(8)] + [(1, docs[0][1]), (20, None), (21, ""), (22, "nowhere"), (23, docs[3][1] if docs[3][1] else "w1"), (23, docs[3][1] if docs[3][1] else "w1"), (None, "w40 w41")]
    for k in (1, 5, 50):
        got = R.search_documents(*tables(spark, docs, queries), k=k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == best(docs, queries, k)


def test_search_in_nothing(spark):
    for docs, queries in (([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None), (2, "")], [(1, "a b")]), ([(1, "a")], [(1, None)])):
        assert R.search_documents(*tables(spark, docs, queries)).collect() == []
