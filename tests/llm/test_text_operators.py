import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from donorloom.llm import chat, decontaminate, fingerprint, language_id, quality, rows, token_counts, toxicity
from donorloom.llm import text as X


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, score string, next string")


def test_words_and_grams_do_not_cross_texts():
    piece = next(X.pieces(pa.array(["A b", None, "", "a B c", "c"])))
    found = X.words(piece)
    assert found.bounds.tolist() == [0, 2, 2, 2, 5, 6]
    assert (found.hashes[:2] == found.hashes[2:4]).all() and found.hashes[4] == found.hashes[5]
    got, bounds = X.grams(found, 2)
    assert bounds.tolist() == [0, 1, 1, 1, 3, 4] and got[0] == got[1] and len(set(got.tolist())) == 3


# chat


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<|", "<|end|>\n", "<|sep|>", "<|turn|>", "</s>", "[INST]", "\\", "<\\|", "<", "|", "[", "\n", "a", "é", "", "\\\\<|"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "a<|sep|>b", None]), rng.choice([None, "".join(rng.choices(bits, k=6))])))
    rows += [(None, None, "assistant", "x"), (99, 1, "user", "t"), (99, 1, "user", "t"), (98, 0, "user", "")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(table)
    got = {r["conv_id"]: r for r in done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        want = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in own)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [w[1:] for w in want]
        assert got[conv]["loss"] == "".join(w[2] for w in want if w[1] == "assistant")
    assert got[99]["formatted"] == "<|start|>user<|sep|>t<|turn|>t<|end|>\n"
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_of_many_turns_and_repeated_rows(spark):
    """A conversation of 20,000 turns beside short ones, a long text, repeated rows and a null role."""
    rows_ = [(1, t, ("user", "assistant", "assistant", None)[t % 4], f"text {t} <|end|>") for t in range(20_000)]
    rows_ += [(2, 0, "assistant", "x" * 3_000_000)] * 2 + [(3, None, "user", "a"), (3, 0, "user", "b"), (3, 1, None, None), (3, 1, "", "c")]
    table = spark.createDataFrame([(*r, 0) for r in rows_], "conv_id long, turn long, role string, text string, loss_spans int").repartition(3)
    done = chat.format_conversations(table)
    got = {r["conv_id"]: r for r in done.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv, own in itertools.groupby(rows_, key=lambda r: r[0]):
        want = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in own)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [w[1:] for w in want]
        assert got[conv]["loss"] == "".join(w[2] for w in want if w[1] == "assistant")
    assert got[3]["formatted"] == "<|start|>user<|sep|>a<|turn|>b<|end|>\n<|start|><|sep|><|turn|>c<|end|>\n"
    assert len(got[1]["loss_spans"]) == 10_000 and len(got[2]["formatted"]) > 6_000_000


# fingerprints


def test_fingerprints_add_up(spark):
    a, b = "One two. Three four, five\nsix", "Seven! Eight\n"
    row = spark.createDataFrame([(a, b, b + a, "six\n" + a[:-4], None)], "a string, b string, ab string, p string, n string").select(
        *(fingerprint.vector(F.col(c)).alias(c) for c in ("a", "b", "ab", "p", "n"))
    )
    got = row.select("a", "ab", "p", "n", fingerprint.add(F.col("a"), F.col("b")).alias("sum"), fingerprint.remove(F.col("ab"), F.col("b")).alias("less")).first()
    assert got["sum"] == got["ab"] and got["less"] == got["a"] and got["a"] != got["ab"] and set(got["n"]) == {0}


def test_fingerprints_are_of_paragraphs(spark):
    """Texts of the same clauses in other paragraphs differ; paragraphs in another order do not; one can be taken out and put in."""
    texts = ["a.b.\nc.", "a.\nb.c.", "c.\na.b.", "a.b.\nc.\nx. y", "x. y", "a.b.\n\nc."]
    got = [r["v"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", fingerprint.vector(F.col("text")).alias("v")).orderBy("i").collect()]
    assert got[0] != got[1] and got[0] == got[2] and got[0] != got[5]
    row = spark.createDataFrame([(got[3], got[4], got[2])], "whole array<bigint>, part array<bigint>, rest array<bigint>")
    less, more = row.select(fingerprint.remove(F.col("whole"), F.col("part")), fingerprint.add(F.col("rest"), F.col("part"))).first()
    assert less[0] == got[0][0] and less[2:] == got[0][2:] and more[2:] == got[3][2:]  # the break between them is of neither


def plain_vector(text):
    """The same fingerprint in plain Python."""
    counts = np.zeros((2, 60), np.int64)
    clauses = [c for line in text.split("\n") for c in re.findall(fingerprint.CLAUSE, line)]
    for c in clauses:
        digits = hashlib.md5(c.encode()).hexdigest()
        for side, at in enumerate((0, 16)):
            counts[side] += [(int(digits[at : at + 15], 16) >> j) & 1 for j in range(60)]
    packed = [int(counts[side][j]) + (int(counts[side][j + 30]) << 30) for side in (0, 1) for j in range(30)]
    v = np.concatenate([2 * counts[side][a : a + 30] - len(clauses) for a in (0, 30) for side in (0, 1)]).astype(float)
    sums = [hashlib.sha256(line.encode()).hexdigest() for line in text.split("\n") if line]
    wide = [sum(int(d[16 * i : 16 * i + 15], 16) for d in sums) % (1 << 60) for i in range(4)]
    return [len(clauses), text.count("\n"), *wide, *packed], v


def plain_likeness(a, b):
    (p, u), (q, v) = a, b
    size = math.sqrt((u @ u) * (v @ v))
    return 1.0 if p == q else 0.0 if size == 0 else min(1.0, max(0.0, u @ v / size))


def test_edited_fingerprints_equal_plain_ones(spark, monkeypatch):
    """All columns, over many buckets, with null, repeated and hot ids, empty and equal texts and a text of 40,000 clauses."""
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 4)
    monkeypatch.setattr(fingerprint, "FAN", 4)
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(["alpha", "beta,", "gamma.", "délta", "😀"]) for _ in range(rng.randint(0, 9)))
    ids = [*rng.sample(range(-500, 500), 60), *[7] * 12, *[8] * 30, None, None]
    table = [(i, "same text. again\n" if i == 8 and rng.random() < 0.8 else "\n".join(line() for _ in range(rng.randint(0, 5)))) for i in ids] + [(900, "a." * 40_000), (901, None)]
    tie = lambda t: xxhash.xxh64((t or "").encode(), seed=42).intdigest() >> 1
    order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    want = Counter()
    show = lambda v: ".".join(f"{x:X}" for x in v)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        own, other, following = map(plain_vector, (t, edited, u))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(own[0]), show(other[0]), round(plain_likeness(own, other), 9), round(plain_likeness(own, following), 9)] += 1
    got = fingerprint.edited_fingerprints(docs(spark, table).repartition(3)).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    own = spark.createDataFrame([(i, t) for i, t in enumerate(["", "one\ntwo. three", "\n\n", "x" * 200])], "i int, text string")
    both = own.withColumn("column", fingerprint.vector(F.col("text"))).join(fingerprint.vectors(own), "i").collect()
    assert len(both) == 4 and all(r["column"] == r["print"] for r in both)


def test_fingerprints_of_millions_of_clauses(spark):
    """More clauses than 21 bits can count: every vote is that of a single clause."""
    table = spark.createDataFrame([(1,), (2,)], "i int").select("i", F.when(F.col("i") == 1, F.repeat(F.lit("a."), F.lit(2_500_000))).otherwise("a.").alias("text"))
    many, one = (r["votes"] for r in fingerprint.vectors(table).orderBy("i").select(fingerprint.votes(F.col("print")).alias("votes")).collect())
    assert len(one) == 120 and [x / 2_500_000 for x in many] == one and set(one) == {1.0, -1.0}


def test_edited_fingerprints(spark):
    texts = [(3, "alpha beta. gamma delta. epsilon zeta. eta theta. " * 5), (1, None), (2, ""), (9, "xé"), (9, "xé"), (20, "other words here. nothing the same. " * 9)]
    got = fingerprint.edited_fingerprints(docs(spark, texts)).collect()
    order = sorted(texts, key=lambda r: (r[0], r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    own = {r["doc_id"]: r for r in got}
    assert own[1]["near_next"] == 1.0 and own[3]["near_edited"] > own[3]["near_next"] and all(0 <= r["near_edited"] <= 1 for r in got)
    assert fingerprint.edited_fingerprints(docs(spark, [])).count() == 0


def test_next_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    ids = sorted(random.Random(2).sample(range(10_000), 200))
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next"]["text"] for r in fingerprint.with_next(rows, "doc_id", ["text"], "text").collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


# decontamination


def test_tiling_covers_reordered_parts():
    a = list(range(20))
    b = [99] + a[10:] + [98, 97] + a[:10]
    assert sorted((i, n) for i, _, n in decontaminate.tile(a, b, 3)) == [(0, 10), (10, 10)]
    assert decontaminate.tile(a, [1, 2, 50, 3, 4], 3) == []
    rng = random.Random(4)
    for _ in range(200):
        x, y = ([rng.randrange(4) for _ in range(rng.randint(1, 25))] for _ in range(2))
        used_x, used_y, want = set(), set(), []
        while True:  # the longest common run that is free on both sides, again and again
            best = (0, 0, 0)
            for i in range(len(x)):
                for j in range(len(y)):
                    n = 0
                    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and i + n not in used_x and j + n not in used_y:
                        n += 1
                    if n > best[2]:
                        best = (i, j, n)
            if best[2] < 3:
                break
            want.append(best[2])
            used_x |= set(range(best[0], best[0] + best[2]))
            used_y |= set(range(best[1], best[1] + best[2]))
        got = decontaminate.tile(x, y, 3)
        assert [n for _, _, n in got] == want
        for side in (0, 1):
            spots = [p for t in got for p in range(t[side], t[side] + t[2])]
            assert len(spots) == len(set(spots))
        assert all(x[i : i + n] == y[j : j + n] for i, j, n in got)


def test_leaks(spark):
    words = [f"w{i}" for i in range(30)]
    item = " ".join(words)
    rows = [(1, "So: " + item.upper() + " end"), (2, " ".join(words[15:]) + " and then " + " ".join(words[:15])), (3, " ".join(words[:9])), (4, None), (5, ""), (6, "tiny"), (7, "one two"), (7, "one two")]
    bench = spark.createDataFrame([(10, item, "q"), (11, None, "q"), (12, "one two", "q"), (13, "", "q")], "item_id long, text string, doc_id string")
    sent = decontaminate.find_leaks(docs(spark, rows), bench, 0.5, 5).collect()
    joined = decontaminate.find_leaks(docs(spark, rows), bench, 0.5, 5, sent_tokens=0).collect()
    pairs = sorted((r["doc_id"], r["item_id"]) for r in sent)
    assert pairs == [(1, 10), (2, 10), (7, 12), (7, 12)]
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in joined} == {(r["doc_id"], r["item_id"], r["matched"]) for r in sent}
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs(spark, rows), bench).collect()) == [3, 4, 5, 6]


def plain_leaks(docs, items, coverage, seed):
    """Leaking pairs by greedy tiling in its plainest form, on all pairs of rows."""
    tokens = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", (t or "").lower()).split()
    out = []
    for d, text in docs:
        for i, item in items:
            x, y = tokens(item), tokens(text)
            if not x:
                continue
            least, used_x, used_y, n_tiles = min(seed, len(x)), set(), set(), 0
            while True:
                best = (0, 0, 0)
                for a in range(len(x)):
                    for b in range(len(y)):
                        n = 0
                        while a + n < len(x) and b + n < len(y) and x[a + n] == y[b + n] and a + n not in used_x and b + n not in used_y:
                            n += 1
                        if n > best[2]:
                            best = (a, b, n)
                if best[2] < least:
                    break
                used_x |= set(range(best[0], best[0] + best[2]))
                used_y |= set(range(best[1], best[1] + best[2]))
                n_tiles += 1
            if used_x and len(used_x) >= coverage * len(x):
                out.append((d, i, len(x), len(used_x), n_tiles))
    return Counter(out)


def test_both_ways_of_joining_equal_plain_tiling(spark, monkeypatch):
    """Null and repeated ids and items, short and hot items, a long text, clashing columns."""
    monkeypatch.setattr(rows, "KEY_ROWS", 3)
    rng = random.Random(9)
    word = lambda n: [rng.choice(["red", "Blue", "tin", "OAK", "fog", "é", "x1", "sun"]) for _ in range(n)]
    items = [(i, " ".join(word(rng.randint(6, 14)))) for i in range(5)] + [(None, " ".join(word(8))), (2, "tin, oak!"), (7, "FOG"), (8, ""), (9, None)]
    items += [items[0], items[5]]
    docs_ = []
    for i in range(40):
        parts = rng.choice(items)[1] or "none"
        cut = len(parts) // 2
        docs_.append((rng.choice([i, i, None, 3]), " ".join(word(rng.randint(0, 12))) + " - " + parts[cut:] + " / " + parts[:cut]))
    docs_ += [(50, None), (51, ""), (52, "; "), (53, " ".join(word(2000)))] + [docs_[0]] * 5
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = plain_leaks(docs_[:-6], items, 0.5, 3) + Counter({k: 5 * n for k, n in plain_leaks(docs_[-1:], items, 0.5, 3).items()})
    long = plain_leaks(docs_[-6:-5], items, 0.5, 3)
    for sent in (1 << 20, 0):
        got = decontaminate.find_leaks(docs(spark, docs_).repartition(3), bench, 0.5, 3, sent_tokens=sent).collect()
        assert Counter((r["doc_id"], r["item_id"], r["item_tokens"], r["matched"], r["tiles"]) for r in got) == want + long, sent


# token counts


def test_token_counts_equal_plain_search(spark):
    pieces = {"▁a": -1.0, "▁": -3.0, "a": -2.0, "ab": -2.5, "b": -2.0, "ba": -2.2, "▁ab": -2.0, "c": -4.0}

    def plain(word):
        text = "▁" + word
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
        for e in range(1, len(text) + 1):
            n = len(text[e - 1].encode())
            options = [(best[e - 1][0] + token_counts.BYTE_SCORE * n, -(best[e - 1][1] + n))]
            options += [(best[s][0] + pieces[text[s:e]], -(best[s][1] + 1)) for s in range(e) if text[s:e] in pieces]
            score, tokens = max(options)
            best[e] = (score, -tokens)
        return best[-1][1]

    rng = random.Random(3)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 7))) for _ in range(300)]
    assert token_counts.count_tokens(words, token_counts.Pieces(pieces)) == {w: plain(w) for w in words}
    got = token_counts.token_counts(docs(spark, [(1, " ".join(words)), (2, None), (3, " "), (3, " ")]), pieces).collect()
    assert sorted((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in got) == [(1, 300, sum(map(plain, words))), (2, 0, 0), (3, 0, 0), (3, 0, 0)]
    assert token_counts.token_counts(docs(spark, []), pieces).count() == 0


def test_token_counts_of_the_public_vocabulary(spark):
    """Whole rows against the plain search over the vocabulary itself; null ids, a very long text and a very long word."""
    pieces = token_counts.read_vocabulary()
    longest = max(map(len, pieces))

    def plain(word):
        text = token_counts.SPACE + word
        best = [(0.0, 0)]
        for e in range(1, len(text) + 1):
            n = len(text[e - 1].encode())
            options = [(best[e - 1][0] + token_counts.BYTE_SCORE * n, -(best[e - 1][1] + n))]
            options += [(best[s][0] + pieces[text[s:e]], -(best[s][1] + 1)) for s in range(max(0, e - longest), e) if text[s:e] in pieces]
            score, tokens = max(options)
            best.append((score, -tokens))
        return best[-1][1]

    table = [(1, "The quick brown fox, über 3.14 naïve 漢字 don't"), (None, "hello hello"), (2, "word " * 100_000), (3, "ab" * 20_000), (4, "\t\n "), (5, None)]
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(docs(spark, table), pieces).collect()}
    assert got == {i: (len((t or "").split()), sum(n * plain(w) for w, n in Counter((t or "").split()).items())) for i, t in table}


# language


def test_language_id(spark):
    rows = [(i, "the house and the tree with this and that", "en", "a.example.org") for i in range(8)]
    rows += [(10 + i, "das Haus und der Baum mit dem und das", "de", "b.example.de") for i in range(8)]
    rows += [(30, None, "en", None), (31, "", None, ""), (32, "123 !!", "de", "b.example.de"), (33, "der und das mit dem Haus", None, "new.example.de"), (34, "é", "de", "b.example.de")]
    table = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, kept string")
    got = {r["doc_id"]: r for r in language_id.identify(table).collect()}
    assert all(got[i]["language"] == ("en" if i < 8 else "de") and got[i]["kept"] for i in [*range(8), *range(10, 18), 33, 34] if i not in (8, 9))
    assert all(got[i]["language"] == "und" and not got[i]["kept"] for i in (30, 31, 32))
    assert language_id.identify(table.limit(0)).count() == 0
    assert [r["kept"] for r in language_id.identify(table.filter("doc_id = 31")).collect()] == [False]
    levels = spark.createDataFrame([("a.b.example.co",), (None,), ("src1",)], "h string").select(*(c.alias(n) for n, c in language_id.host_levels(F.col("h")).items())).collect()
    assert [tuple(r) for r in levels] == [("a.b.example.co", "example.co", "co"), ("", "", ""), ("src1", "src1", "")]


def plain_languages(rows_, accept=0.5):
    """The same fusion, row by row, in floating-point sums over dictionaries."""
    names = sorted({r[2] for r in rows_ if r[2]})
    grams = lambda t: language_id._bins(next(X.pieces(pa.array([t]))))[0].tolist() if t else []
    counts = {n: Counter() for n in names}
    for _, t, lang, _ in rows_:
        if lang:
            counts[lang].update(grams(t))
    total = {n: sum(c.values()) + language_id.BINS for n, c in counts.items()}
    rows_host = Counter(((r[3] or "").lower(), r[2]) for r in rows_ if r[2])
    share = {n: (sum(c for (_, x), c in rows_host.items() if x == n) + 1) / (sum(rows_host.values()) + len(names)) for n in names}

    def level(own, above):
        n = Counter()
        for (h, lang), c in rows_host.items():
            if own(h):
                n[lang] += c
        k = language_id.PRIOR_ROWS
        return {x: (n[x] + k * above[x]) / (sum(n.values()) + k) for x in names}

    out = []
    for i, t, lang, host in rows_:
        h = (host or "").lower()
        suffix, domain = (h.rsplit(".", 1)[-1] if "." in h else ""), ".".join(h.split(".")[-2:])
        of = lambda x: (x.rsplit(".", 1)[-1] if "." in x else "", ".".join(x.split(".")[-2:]))
        prior = level(lambda x: of(x)[0] == suffix, share)  # noqa: B023
        prior = level(lambda x: of(x) == (suffix, domain), prior)  # noqa: B023
        prior = level(lambda x: x == h, prior)  # noqa: B023
        g = grams(t)
        declared = {n: 0.0 if not lang else math.log(language_id.DECLARED if n == lang else (1 - language_id.DECLARED) / max(len(names) - 1, 1)) for n in names}
        fused = {n: (sum(math.log((counts[n][b] + 1) / total[n]) for b in g) / max(len(g), 1)) * min(len(g), language_id.TEXT_WEIGHT) + math.log(prior[n]) + declared[n] for n in names}
        best = max(names, key=lambda n: (fused[n], [-ord(c) for c in n]))  # noqa: B023
        letters = any(c.isalpha() for c in t or "")
        confidence = 1 / sum(math.exp(fused[n] - fused[best]) for n in names) if letters else 0.0
        out.append((i, best if letters else "und", round(confidence, 4), len(g), letters and confidence >= accept))
    return sorted(out, key=str)


def test_language_id_equals_plain_fusion(spark):
    """Hosts of three levels, null and repeated ids, texts without letters, a very long text."""
    rng = random.Random(8)
    say = {"en": "the and that with this house tree have".split(), "de": "der und das mit dem Haus Baum haben".split(), "fr": "le et que avec cette maison arbre été".split()}
    table = []
    for i in range(60):
        lang = rng.choice(list(say))
        table.append((rng.choice([i, None, 5]), " ".join(rng.choices(say[lang], k=rng.randint(0, 6))), rng.choice([lang, lang, None]), rng.choice(["a.x.org", "b.x.org", "y.de", "Y.DE", "bare", None, ""])))
    table += [(70, None, "en", "y.de"), (71, "12 !", None, "a.x.org"), (72, "the house " * 30_000, None, "y.de"), (73, "x", None, "y.de")] + [table[0]] * 3
    rows_ = spark.createDataFrame([(*r, "k") for r in table], "doc_id long, text string, lang string, source string, kept string").repartition(3)
    got = sorted(((r["doc_id"], r["language"], round(r["confidence"], 4), r["grams"], r["kept"]) for r in language_id.identify(rows_).collect()), key=str)
    want = plain_languages(table)
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(w[0], w[1], w[3], w[4]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-3)


def test_language_of_held_out_texts(spark, sf):
    """Labels of a third are withheld from text model, prior and evidence: by text alone, by host alone, and by both."""
    table = spark.read.parquet(f"{sf}/documents.parquet").filter("text rlike '[a-z]'")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    seen = table.withColumn("lang", F.when(~held, F.col("lang")))
    truth = {r["doc_id"]: r["lang"] for r in table.filter(held).collect()}

    def right(rows_, **evidence):
        return sum(truth.get(r["doc_id"]) == r["language"] for r in language_id.identify(rows_, declared=None, **evidence).collect()) / len(truth)

    text, host, both = right(seen, host=None), right(seen.withColumn("text", F.lit("x"))), right(seen)
    assert text >= 0.9 and both >= text - 0.02 and 0 < host < both


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows_ = spark.createDataFrame([(i, "text", f"l{i}", "s") for i in range(3)], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.identify(rows_)


# toxicity


def distance(a, b):
    """Letters put in, left out, changed, or swapped with the next one."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    terms = [toxicity.Term(w) for w in ("idiot", "scum", "disgusting", "moron", "fop")] + [toxicity.Term("vequa", stem=True)]
    automaton = toxicity.Automaton(terms, frozenset({"moran", "scam", "idiot"}))
    rng = random.Random(7)
    words = {"ldiot", "1diot", "diot", "scun", "stpuid", "idoit", "sucm", "moran", "scam", "idiot", ""}
    for t in terms:
        for _ in range(400):
            w = list(t.text)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(4)
                if kind == 3:
                    w[at : at + 2] = w[at : at + 2][::-1]
                else:
                    w[at : at + (kind > 0)] = [rng.choice("abidmostu")] if kind < 2 else []
            words.add("".join(w))
    for w in words:
        near = [d for t in terms if not t.stem for d in [distance(w, t.text)] if d <= t.edits and not (d and w in automaton.ordinary)]
        if w.startswith("vequa") and len(w) > 5:
            near.append(0)
        found = automaton.match(w)
        assert (found[1] if found else None) == (min(near) if near else None), w


def labelled(rng, n):
    """Texts with labels: "zorg" and words that begin with "brint" are toxic, "zork" is an ordinary word."""
    plain = ["calm", "river", "stone", "zork", "light", "paper", "green", "walk"]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        words = rng.choices(plain, k=12) + ([rng.choice(["zorg", "zorg", "brint" + rng.choice("abcdefgh") + "x"])] if y else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), y))
    return rows


def test_terms_are_learned_and_weighed(spark):
    sample = spark.createDataFrame(labelled(random.Random(1), 300), "doc_id long, text string, y int")
    terms = toxicity.learn_terms(sample)
    assert {(t.text, t.stem) for t in terms} == {("zorg", False), ("brin", True)}
    ordinary = toxicity.ordinary_words(terms, sample)
    assert ordinary == {"zork"}
    weighed = {t.text: t for t in toxicity.weigh_terms(terms, sample, ordinary)}
    total = sample.agg(F.sum("y"), F.count("*")).first()
    n = sample.filter("array_contains(split(text, ' '), 'zorg')").count()
    assert abs(weighed["zorg"].weight - (math.log((n + 0.5) / (total[0] + 1)) - math.log(0.5 / (total[1] - total[0] + 1)))) < 1e-9
    assert weighed["zorg"].misspelt == toxicity.Term("zorg").misspelt  # no misspelling met
    assert toxicity.learn_terms(sample.filter("y = 0")) == [] and toxicity.ordinary_words(terms, sample.limit(0)) == frozenset()


def test_logistic_regression_has_no_slope_left():
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [3, -2, 0] - 0.5)))).astype(float)
    w, bias = toxicity._logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.abs(x.T @ (p - y) + 0.05 * w).max() < 1e-5 and w[0] > 1.5 > -1 > w[1]


def test_toxicity_of_held_out_texts(spark):
    """Learned on one part, right on the other: misspelt and quoted terms, repeated, null and very long texts."""
    rng = random.Random(3)
    rows_ = labelled(rng, 400)
    held = labelled(rng, 150)
    texts = [(i, t) for i, t, _ in rows_] + [(1000 + i, t) for i, t, _ in held] + [(3000, "calm " * 200_000 + "zorg"), (3001, "you zrog, stone"), (3002, None), (3003, ""), (None, "zorg zorg"), (None, "calm")] + [(3004, "zorg")] * 2
    labels = spark.createDataFrame([(i, y) for i, _, y in rows_] + [(1, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs(spark, texts), labels)
    got = toxicity.score_toxicity(docs(spark, texts), model, 0.5).collect()
    own = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == len(texts) and sum(r["doc_id"] == 3004 for r in got) == 2
    assert sum(own[1000 + i]["predicted"] == y for i, _, y in held) >= 0.97 * len(held)
    assert own[3001]["score"] > own[3002]["score"] == own[3003]["score"] and own[3000]["score"] > own[3002]["score"]
    assert sorted(r["predicted"] for r in got if r["doc_id"] is None) == [0, 1]


def test_toxicity_tells_quotation_from_abuse(spark):
    model = toxicity.Model([toxicity.Term(w) for w in toxicity.INSULTS], np.array([2.0, 0.2, 1.0, 0.1, 0.5, 0.5, 0.0]), -3.0)
    rows = [(1, "you are an idiot and a moron"), (2, 'he said "idiot moron" once'), (3, "what a fine day"), (4, None), (5, ""), (6, "an idjot and a m0ron")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs(spark, rows), model).collect()}
    assert got[1] > 0.7 > got[2] > got[3] and got[3] == got[4] == got[5] and got[6] > got[3]
    assert toxicity.score_toxicity(docs(spark, []), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs(spark, rows), labels).bias == -3.0


# quality


def test_trees_learn_and_walk():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x[:1500], y[:1500])
    assert ((trees.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97

    def slow(row):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(trees.raw(x[:50]), [slow(r) for r in x[:50]])
    assert 0 < quality.fit(x[:10], np.ones(10)).probability(x[:1])[0] < 1


def plain_statistics(text):
    """FEATURES of a text in plain Python."""
    t = (text or "").encode()
    out = dict.fromkeys(quality.FEATURES, 0.0)
    for name, members in quality._CLASSES.items():
        out[name] = sum(bool(members[b]) for b in t) / max(len(t), 1)
    own = [bytes(w) for w in re.split(rb"[ \t-\r]+", t) if w]
    if own:
        low = [w.lower() for w in own]
        times, lines = Counter(low), [x for x in t.split(b"\n") if x]
        out |= {"log_words": math.log1p(len(own)), "mean_word": sum(map(len, own)) / len(own), "longest_word": min(max(map(len, own)), 200), "distinct_words": len(times) / len(own)}
        out |= {"top_word": max(times.values()) / len(own), "top_run": sum(a == b for a, b in itertools.pairwise(low)) / max(len(own) - 1, 1)}
        out |= {"lines": math.log1p(len(lines)), "distinct_lines": len({x.lower() for x in lines}) / len(lines)}
    return [out[f] for f in quality.FEATURES]


def test_statistics_equal_plain_ones():
    rng = random.Random(4)
    texts = ["".join(rng.choices("aB9é .\n|!", k=rng.randint(0, 60))) for _ in range(200)] + [None, "", "   ", "x" * 3_000_000, "one two\n" * 50_000]
    assert np.allclose(quality.statistics(pa.array(texts)), [plain_statistics(t) for t in texts], rtol=1e-4, atol=1e-5)


def test_quality_of_held_out_texts(spark, sf):
    """Labels of a fifth are never learned; the query's scores are those of the trees walked on plain statistics."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs_, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    trees = quality.fit_quality(docs_, labels.filter(~held))
    texts = {r["doc_id"]: r["text"] for r in docs_.collect()}
    got = quality.score_quality(docs_.withColumn("score", F.lit("clash")), trees, 0.3).collect()
    assert len(got) == len(texts)
    some = got[:60]
    assert np.allclose([r["score"] for r in some], trees.probability(np.array([plain_statistics(texts[r["doc_id"]]) for r in some], np.float32)), atol=1e-3)
    marks = {r["doc_id"]: r["quality"] for r in labels.filter(held & F.col("quality").isNotNull()).collect()}
    right = [int(r["score"] >= 0.5) == marks[r["doc_id"]] for r in got if r["doc_id"] in marks]
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)


def test_quality_defined_for_all_rows(spark):
    rows = [(i, "plain words of a calm text here. " * (i % 7 + 1)) for i in range(60)] + [(100 + i, "SPAM!! SPAM!! " * (i % 7 + 2)) for i in range(60)] + [(300, None), (301, ""), (301, "")]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows[:120]] + [(999, 1), (None, 1), (5, None)], "doc_id long, quality int")
    trees = quality.fit_quality(docs(spark, rows), labels)
    got = quality.score_quality(docs(spark, rows), trees, 0.5).collect()
    assert len(got) == len(rows) and all(r["predicted"] == int(r["doc_id"] < 100) for r in got if r["doc_id"] < 200)
    assert quality.score_quality(docs(spark, []), trees).count() == 0
