"""What every operator must bear: columns of clashing names, very long texts, two models in one worker, hot keys dealt again."""

import random
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from donorloom.llm import chat, decontaminate, fingerprint, language_id, mixing, ngram_join, prefix_trie, quality, queries, ranked_search, sharding, suffix_tree, token_counts, toxicity
from donorloom.llm.rows import spread_join

#: Names that operators use inside, which a table may have as well.
CLASH = (
    "row", "node", "n", "token", "size", "key", "shard", "slot", "bytes", "copies", "taken", "target", "side", "print", "votes", "next", "features", "grams", "host", "domain", "suffix",
    "declared", "letters", "loglik", "part", "place", "order", "seed", "item", "item_id", "term", "impact", "rank", "score", "x", "y", "a", "b", "comp", "component", "stays", "least", "conv_id", "turns", "_bucket", "_row", "_part",
)
SHORT = [(1, "One two three four five six. You idiot!"), (2, None), (3, ""), (None, "seven eight nine ten eleven twelve"), (None, None), (5, "One two three four five six. You idiot!"), (5, "Ünï cödé wörds here, söme more of them"), (7, "x")]


def table(spark, rows, clash):
    df = spark.createDataFrame([(i, t, ("en", "de")[(i or 0) % 2], f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def items(spark, clash):
    df = spark.createDataFrame([(1, "two three four five six you"), (2, None), (None, "seven eight")], "item_id long, text string")
    return df.withColumns({c: F.lit(3) for c in CLASH if c not in ("item_id",)} | {"doc_id": F.lit(9)}) if clash else df


VOCABULARY = {"▁one": -3.0, "▁two": -3.0, "o": -6.0, "n": -6.0, "e": -6.0, "▁": -4.0}


def labels(spark, rows):
    return spark.createDataFrame([(i, i % 2) for i, _ in rows if i is not None], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))


OPERATORS = {
    "toxicity": lambda s, d, c: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels(s, SHORT))),
    "chat": lambda s, d, c: chat.format_conversations(d.select("text", F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("source").alias("role"), *([F.lit(1).alias(x) for x in CLASH if x != "conv_id"] if c else []))),
    "ngram_join": lambda s, d, c: ngram_join.ngram_jaccard_join(d, 4, 85),
    "sharding": lambda s, d, c: sharding.shard_by_bytes(d, 4),
    "language_id": lambda s, d, c: language_id.identify(d).withColumn("confidence", F.round("confidence", 9)),
    "token_counts": lambda s, d, c: token_counts.token_counts(d, VOCABULARY),
    "mixing": lambda s, d, c: mixing.mix(d),
    "quality": lambda s, d, c: quality.score_quality(d, quality.fit_quality(d, labels(s, SHORT))),
    "fingerprint": lambda s, d, c: fingerprint.edited_fingerprints(d),
    "decontaminate": lambda s, d, c: decontaminate.find_leaks(d, items(s, c), 0.5, 3),
    "decontaminate_joined": lambda s, d, c: decontaminate.find_leaks(d, items(s, c), 0.5, 3, sent_tokens=0),
    "ranked_search": lambda s, d, c: ranked_search.search_documents(d, items(s, c), 3),
    "suffix_tree": lambda s, d, c: suffix_tree.score_texts(d, suffix_tree.fit_suffix_tree(d, w), w) if (w := suffix_tree.count_words(d)) else None,
    "prefix_trie": lambda s, d, c: prefix_trie.prefix_trie(prefix_trie.turn_lists(d.select("text", F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("source").alias("role"), *([F.lit(1).alias(x) for x in CLASH if x != "conv_id"] if c else [])))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_clashing_names(spark, name):
    """Other columns, whatever their names, change nothing; nulls, empty texts, repeated ids and rows have their rows."""
    plain, clash = (Counter(map(str, OPERATORS[name](spark, table(spark, SHORT, c), c).collect())) for c in (False, True))
    assert plain == clash and plain


def test_pipeline_stages_with_clashing_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    clash = docs.withColumns({c: F.lit("clash") for c in CLASH})
    for name, stage in corpus_pipeline.STAGES:
        assert Counter(map(str, stage(spark, docs, sf).collect())) == Counter(map(str, stage(spark, clash, sf).collect())), name


def test_very_long_texts(spark, sf):
    """Texts of two million characters and more through joins, mixing and all stages: near copies link, whole sizes count."""
    rng = random.Random(5)
    words = [f"word{rng.randint(0, 10**6)}" for _ in range(250_000)]
    long, near, other = " ".join(words), " ".join([*words[:-40], *(f"new{i}" for i in range(40))]), " ".join(reversed(words))
    rows = [(1, long), (2, near), (3, other), (4, long), (5, "short text of a few words here")]
    docs = table(spark, rows, False)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in ngram_join.ngram_jaccard_join(docs, 5, 80).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5} and got[1][1] > 249_000
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: 250_000, 2: 250_000, 3: 250_000, 4: 250_000, 5: 7}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf)
        if name == "ngram_jaccard_join":
            assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]
    assert kept.agg(F.max("size")).first()[0] == len(long) + 1


def test_two_models_in_one_worker():
    """An automaton is that of the model asked for, whatever was asked for before and wherever it stood in memory."""
    for i in range(300):
        word = f"insult{chr(97 + i % 26)}{i}"
        sent = SimpleNamespace(value=toxicity.Lexicon([toxicity.Term(word)], frozenset()))
        assert toxicity._automaton(sent).match(word) == (0, 0) and toxicity._automaton(sent) is toxicity._automaton(sent)
        pieces = SimpleNamespace(value={f"▁{word}": -1.0, **{c: -9.0 for c in word}})
        assert token_counts.count_tokens([word], token_counts._pieces(pieces))[word] == 1
        del sent, pieces


def test_hot_keys_are_dealt_alike_again(spark):
    """A hot key's rows meet all they should, once each, and a row goes to the same part in whatever order it comes."""
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    few = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    want = sorted(tuple(r) for r in many.join(few, ["k"]).select("k", "v", "w").collect())
    for parts in (1, 5, 13):
        got = spread_join(many.repartition(parts, F.rand(parts)), few, ["k"], key_rows=40).select("k", "v", "w")
        assert sorted(tuple(r) for r in got.collect()) == want
    plan = spread_join(many, few, ["k"], key_rows=40)._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "xxhash64" in plan


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    docs = [(i, f"words {i} of a text", "en", "s", 5) for i in range(40)] + [(None, "no id", "en", "s", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*((i, i % 2, i % 2) for i in range(40)), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (queries.op1_toxicity, queries.op8_quality, queries.op12_lm_scoring):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == 41 and all(r["held_out"] in (True, False) for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
