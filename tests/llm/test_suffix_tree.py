import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from donorloom.llm import queries
from donorloom.llm import suffix_tree as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BEGIN, END = "<begin>", "<end>"


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [END]


class Tree:
    """The same model with strings, over all n-grams."""

    def __init__(self, texts):
        lists = [[BEGIN, *tokens(t)] for t in texts]
        self.n = Counter(w for own in lists for w in own[1:])
        self.total, self.scale = sum(self.n.values()), sum(self.n.values()) + 0.5 * (len(self.n) + 1)
        grams = Counter(tuple(own[i : i + d + 1]) for d in range(S.DEPTH + 1) for own in lists for i in range(len(own) - d))
        least = max(S.LEAST, math.ceil(self.total * S.SHARE))
        begins = len(lists)
        fine = lambda w: w == BEGIN or self.n[w] >= least
        self.grams = {g: n for g, n in grams.items() if len(g) > 1 and n >= least and all(map(fine, g)) and g[-1] != BEGIN}
        self.whole = lambda u: begins if u == (BEGIN,) else grams[u]
        self.after = defaultdict(list)
        for g in self.grams:
            self.after[g[:-1]].append(g[-1])
        every = set(self.after)
        self.kept = {u for u in every if self.gain(u, every) >= S.GAIN * len(self.after[u])}
        self.kept |= {u[i:] for u in self.kept for i in range(1, len(u))}

    def gain(self, u, kept):
        before = [self.p(x, u[1:], kept) for x in self.after[u]]
        n = [self.grams[(*u, x)] for x in self.after[u]]
        leaves = 1 - sum(k - S.DISCOUNT for k in n) / self.whole(u)
        return sum(k * math.log(self.p(x, u, kept) / b) for x, k, b in zip(self.after[u], n, before)) + (self.whole(u) - sum(n)) * math.log(leaves)

    def p(self, x, u, kept=None):
        kept = self.kept if kept is None else kept
        while u and u not in kept:
            u = u[1:]
        if not u:
            return (self.n[x] + 0.5) / self.scale
        own = [self.grams[(*u, y)] - S.DISCOUNT for y in self.after[u]]
        return max(0, self.grams.get((*u, x), 0) - S.DISCOUNT) / self.whole(u) + (1 - sum(own) / self.whole(u)) * self.p(x, u[1:], kept)

    def score(self, text):
        own = [BEGIN, *tokens(text)]
        return sum(math.log10(self.p(own[i], tuple(own[max(0, i - S.DEPTH) : i]))) for i in range(1, len(own)))


def corpus():
    rng = random.Random(8)
    words = [[f"{a}{i}" for i in range(12)] for a in "AbÜ"]
    out = []
    for i in range(240):
        own = rng.choice(words)
        text = [rng.choice(own)]
        for _ in range(rng.randint(0, 30)):
            at = own.index(text[-1]) if text[-1] in own else 0
            text.append(own[(at + 1) % 12] if rng.random() < 0.6 else rng.choice(own) if rng.random() < 0.9 else f"rare{rng.randint(0, 500)}")
        out.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    return out + [(300, None), (301, ""), (302, " \n "), (303, "A1 A1 A1 b2 " * 1_500), (304, "A1 A1 A1 b2 " * 1_500), (None, "A1 A2 A3"), (None, None), (5, out[5][1]), (5, "A1 unseen")]


@pytest.mark.parametrize(("word_share", "held"), [(2**-22, 1 << 21), (0.002, 100)])
def test_scores(spark, tmp_path, monkeypatch, word_share, held):
    """Equal to the model with strings, whether all words are sent or rare ones joined, and counts given away in parts or not."""
    monkeypatch.setattr(S, "SHARE", 2**-11)
    monkeypatch.setattr(S, "WORD_SHARE", word_share if word_share < S.SHARE else S.SHARE)
    monkeypatch.setattr(S, "HELD", held)
    rows = corpus()
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, n int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_lm_scoring(spark, str(tmp_path)).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tree = Tree([t for i, t in rows if not out(i)])
    assert any(len(u) == S.DEPTH for u in tree.kept) and len(tree.kept) < len(tree.after)
    want = sorted((str(i), out(i), len(tokens(t)), sum(tree.n[w] > 0 for w in tokens(t)), tree.total, sum(math.log10((tree.n[w] + 0.5) / tree.scale) for w in tokens(t)), tree.score(t)) for i, t in rows)
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    for w, h in zip(want, have):
        assert h[5:] == pytest.approx(w[5:], rel=1e-9)
    # probabilities after any state sum to 1, with one for all unknown words
    for u in random.Random(1).sample(sorted(tree.kept), min(20, len(tree.kept))):
        assert sum(tree.p(x, u) for x in [*tree.n, "never seen"]) == pytest.approx(1)
    held_out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out) + 0.05 * sum(r["n_tokens"] for r in held_out)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    words = S.count_words(empty)
    model = S.fit_suffix_tree(empty, words)
    assert S.score_texts(empty, model, words).collect() == []
    rows = S.score_texts(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), model, words).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
