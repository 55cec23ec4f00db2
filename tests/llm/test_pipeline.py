import re
import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from donorloom.llm import language_id
from test_ngram_join import brute


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    extra = spark.createDataFrame([(90001, None, "en", "src0", 0), (90002, "", "en", "src0", 0), (90003, "12 34", None, None, 5)], docs.schema)
    before = docs.union(extra)
    kept = stages["language_id"](spark, before, sf)
    assert kept.columns == docs.columns
    own = {r["doc_id"]: r for r in kept.collect()}
    assert set(own) == {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"])}
    doubled = kept.union(kept.limit(3))
    single = stages["ngram_jaccard_join"](spark, doubled, sf)
    classes = brute({i: r["text"] for i, r in own.items()}, 5, 80)
    assert Counter(r["doc_id"] for r in single.collect()) == Counter({i for i, (_, c) in classes.items() if i == c})
    clean = stages["decontamination"](spark, single, sf)
    tokens = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", t.lower()).split()
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        own = tokens(text)
        grams = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for item in items:
            hit = set()
            for i in range(len(item) - 4):
                if tuple(item[i : i + 5]) in grams:
                    hit |= set(range(i, i + 5))
            if 2 * len(hit) >= len(item):
                return True
        return False

    left = {r["doc_id"] for r in clean.collect()}
    assert left == {r["doc_id"] for r in single.collect() if not leaks(r["text"])} and len(left) < single.count()
    mixed = stages["mixing"](spark, clean, sf)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= left and max(copies.values()) <= 2 and mixed.columns == docs.columns
    words = {r["doc_id"]: len(r["text"].split()) for r in clean.collect()}
    assert abs(sum(words[i] * n for i, n in copies.items()) / sum(words.values()) - 1.5) <= 0.01
    placed = stages["sharding"](spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in placed) == copies and {r["shard"] for r in placed} == set(range(16))
    for name in ("ngram_jaccard_join", "decontamination", "mixing", "sharding", "language_id"):
        assert stages[name](spark, docs.limit(0), sf).count() == 0


def test_pages_can_be_identified(spark, sf):
    """Markup, address and host as evidence, over web pages."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.col("page_id").alias("doc_id"), F.regexp_replace("html", "(?s)<[^>]*>", " ").alias("text"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("url", "://([^/:]+)", 1).alias("source"),
    )
    got = language_id.identify(pages).join(pages.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["language"] == r["lang"] for r in got) >= 0.95 * len(got)


def test_rows_of_null_and_repeated_ids_are_documents(spark, sf):
    """Each stage decides on rows: a row that goes takes no other of its id with it, and none is lost to a null id."""
    docs, stages = spark.read.parquet(f"{sf}/documents.parquet"), dict(corpus_pipeline.STAGES)
    word = lambda seed, n=40, *new: " ".join(f"new{seed}x{i}" if i in new else f"w{seed}x{i}" for i in range(n))
    make = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], docs.schema)
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    own = [(None, word(1), "a"), (None, word(2), "a"), (7, word(3), "b"), (7, word(4), "b"), (8, word(5), "a")]
    assert rows(stages["language_id"](spark, make([*own, (7, "12 34", "b"), (None, "- - -", "a"), (8, "", "a")]), sf)) == Counter((i, t) for i, t, _ in own)
    near = [(None, word(3, 40, 39), "a"), (9, word(1, 40, 39), "a"), (6, word(6), "a"), (6, word(6, 40, 39), "a"), *own[:2], (8, word(5), "b")]
    single = rows(stages["ngram_jaccard_join"](spark, make([*own, *near]), sf))
    sixes = Counter({x: n for x, n in single.items() if x[0] == 6})
    assert single - sixes == Counter([(None, word(2)), (7, word(3)), (7, word(4)), (8, word(5)), (9, word(1, 40, 39))]) and sum(sixes.values()) == 1
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    assert rows(stages["decontamination"](spark, make([*own, (7, item, "b"), (None, item, "a")]), sf)) == Counter((i, t) for i, t, _ in own)
    mixed = stages["mixing"](spark, make([*own, (8, word(5), "a")]), sf)
    taken = rows(mixed)
    assert sum(taken.values()) in (7, 8) and max(taken.values()) <= 2 and set(taken) <= {(i, t) for i, t, _ in own}
    assert taken == rows(stages["mixing"](spark, make([(8, word(5), "a"), *own[::-1]]).repartition(3), sf))
    assert rows(stages["sharding"](spark, mixed, sf).select("doc_id", F.col("text_crc32").cast("string").alias("text"))) == Counter({(i, str(zlib.crc32(t.encode()))): n for (i, t), n in taken.items()})
