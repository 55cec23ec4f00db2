"""The operators over the tables, each with its production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorloom.llm import fingerprint
from donorloom.llm.chat import format_conversations, read_loss, read_turns
from donorloom.llm.decontaminate import find_leaks
from donorloom.llm.fingerprint import edited_fingerprints
from donorloom.llm.language_id import identify
from donorloom.llm.mixing import mix
from donorloom.llm.ngram_join import ngram_jaccard_join
from donorloom.llm.prefix_trie import prefix_trie, turn_lists, with_shared_heads
from donorloom.llm.quality import fit_quality, score_quality
from donorloom.llm.ranked_search import search_documents
from donorloom.llm.sharding import shard_by_bytes
from donorloom.llm.suffix_tree import count_words, fit_suffix_tree, score_texts
from donorloom.llm.token_counts import read_vocabulary, token_counts
from donorloom.llm.toxicity import fit_toxicity, score_toxicity

from donorloom.operators.shared import materialize, ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int, at: int) -> Column:
    """Whether a document is of the held-out fold, by its id; without an id it is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == at, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of the held-out fold (remainder 1 of 3) are never read."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~_fold(3, 1)))
    scored = score_toxicity(docs, model, threshold=0.7)
    return scored.select("doc_id", _fold(3, 1).alias("held_out"), "score", "predicted")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from the formatted string."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(r"""SELECT * FROM VALUES (-7L, 0L, 'user', r'</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', r'</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)""")
    done = format_conversations(turns.unionByName(probe))
    back = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least id it reaches by links (4-word shingles, similarity of 0.85 or more)."""
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=4, percent=85).drop("node")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near equal bytes, rows of equal text together."""
    return shard_by_bytes(_table(spark, sf_dir, "documents"), shards=16)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language from its text, its declared language and its source."""
    return identify(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under the public vocabulary of 32,000 pieces."""
    return token_counts(_table(spark, sf_dir, "documents"), read_vocabulary())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of every document; weights 5, 2, 1, no source above twice its size."""
    mixed = mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, repeats=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; labels of the held-out fold (remainder 0 of 5) are never read."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~_fold(5, 0)))
    scored = score_quality(docs, trees, threshold=0.3)
    return scored.select("doc_id", _fold(5, 0).alias("held_out"), "score", "predicted")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and that of its text edited with the next one's; likeness to six digits."""
    made = edited_fingerprints(_table(spark, sf_dir, "documents"))
    return made.withColumns({c: F.round(c, 6) for c in ("near_edited", "near_next")})


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that leaks into it."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), coverage=0.5, seed=5)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for every test item."""
    return search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability by its words' counts, and by a suffix tree; the held-out fold (remainder 1 of 5) is never learned
    from. Documents without an id are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.filter(~_fold(5, 1))
    words = materialize(count_words(train), "words")
    scored = score_texts(docs, fit_suffix_tree(train, words), words)
    return scored.withColumn("held_out", _fold(5, 1))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, rebuilt with the first turns that a hundred of them share."""
    return prefix_trie(with_shared_heads(turn_lists(_table(spark, sf_dir, "conversations")), every=100, most=5))


def queries() -> dict:
    own = (
        op1_toxicity, op2_chat_format, op3_ngram_jaccard, op4_sharding, op5_language_id,
        op6_token_counts, op7_mixing, op8_quality, op9_fingerprints, op10_decontamination,
        op11_ranked_search, op12_lm_scoring, op13_prefix_trie,
    )
    return {f.__name__: f for f in own}


#: The template as SQL counts it: what stands before a turn, and the escaped length of a string.
_OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), u AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g')) AS role_chars,
         length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g')) AS text_chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN before = role THEN length('<|turn|>')
                                  ELSE length('<|start|><|sep|><|end|>') + 1 + role_chars END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""


#: Shingles of every text, all pairs of documents that share one, and what links reach.
_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w
), sets AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS whole, s FROM s
), one AS (  -- equal sets are one node
  SELECT whole, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS least FROM sets WHERE n > 0 GROUP BY whole
), t AS (SELECT whole, unnest(s) AS x FROM one),
pairs AS (SELECT a.whole AS a, b.whole AS b, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.whole < b.whole GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN one x ON x.whole = p.a JOIN one y ON y.whole = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT whole AS i, whole AS j FROM one UNION SELECT i, b FROM reach JOIN ways ON j = a),
found AS (SELECT i AS whole, min(least) AS component_id FROM reach JOIN one ON whole = j GROUP BY i)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN found USING (whole)
"""


def _op9() -> str:
    """The fingerprints as SQL: paragraphs and clauses as rows, a sum for each number and lane."""
    lanes = [f"CAST(sum(({p} >> {j}) & {1 | 1 << fingerprint.WIDTH}) AS BIGINT) AS {p}{j}" for p in "xy" for j in range(fingerprint.STEPS)]
    names = [f"{p}{j}" for p in "xy" for j in range(fingerprint.STEPS)]
    half = "CAST('0x' || substr(d, {}, 15) AS BIGINT)"
    wide = [f"w{i}" for i in range(fingerprint.WIDE)]
    summed = ", ".join(f"CAST(sum(CASE WHEN line = '' THEN 0 ELSE CAST('0x' || substr(d, {16 * i + 1}, 15) AS BIGINT) END) % {1 << 2 * fingerprint.WIDTH} AS BIGINT) AS w{i}" for i in range(fingerprint.WIDE))
    votes = [f"CAST(2 * (({n} >> {s}) & {(1 << fingerprint.WIDTH) - 1}) - clauses AS DOUBLE)" for s in (0, fingerprint.WIDTH) for n in names]
    shown = "concat_ws('.', " + ", ".join(f"printf('%X', {n})" for n in ("clauses", "breaks", *wide, *names)) + ")"
    dot = "list_sum(list_transform(list_zip({0}.votes, {1}.votes), lambda z: z[1] * z[2]))"
    like = "CASE WHEN {0}.shown = {1}.shown THEN 1.0 WHEN {0}.norm * {1}.norm = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, " + dot + " / sqrt({0}.norm * {1}.norm))) END"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM docs),
edits AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next, 1, length(text) // 2) AS edited FROM following),
sides AS (SELECT doc_id, 0 AS side, text FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
lines AS (SELECT doc_id, side, unnest(string_split(text, chr(10))) AS line FROM sides),
pieces AS (SELECT doc_id, side, unnest(CASE WHEN line = '' THEN [NULL] ELSE regexp_extract_all(line, '{fingerprint.CLAUSE}') END) AS c FROM lines),
bits AS (SELECT doc_id, side, c IS NOT NULL AS piece, coalesce({half.format(1)}, 0) AS x, coalesce({half.format(17)}, 0) AS y FROM (SELECT *, md5(c) AS d FROM pieces)),
sums AS (SELECT doc_id, side, count(*) FILTER (WHERE piece) AS clauses, {", ".join(lanes)} FROM bits GROUP BY 1, 2),
paragraphs AS (SELECT doc_id, side, {summed} FROM (SELECT *, sha256(line) AS d FROM lines) GROUP BY 1, 2),
made AS (SELECT doc_id, side, {shown} AS shown, [{", ".join(votes)}] AS votes FROM sums JOIN paragraphs USING (doc_id, side) JOIN (SELECT doc_id, side, length(text) - length(replace(text, chr(10), '')) AS breaks FROM sides) USING (doc_id, side)),
prints AS (SELECT *, list_sum(list_transform(votes, lambda v: v * v)) AS norm FROM made)
SELECT e.doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, p.shown AS fingerprint, q.shown AS edited_fingerprint,
       round(CAST({like.format('p', 'q')} AS DOUBLE), 6) AS near_edited, round(CAST({like.format('p', 'n')} AS DOUBLE), 6) AS near_next
FROM edits e JOIN prints p ON p.doc_id = e.doc_id AND p.side = 0 JOIN prints q ON q.doc_id = e.doc_id AND q.side = 1 JOIN prints n ON n.doc_id = e.next_id AND n.side = 0
"""


#: Scores of all documents that share a term with an item.
_OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sums AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM t SEMI JOIN items USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, sums),
p AS (SELECT doc_id, term, tf, 100 - 50 + (50 * n * docs) // total AS m FROM tf, sums),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM items JOIN p USING (term) JOIN w USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


#: CRC32 bit by bit, conversations rebuilt, all prefixes of all of them, and sums over those that go on from each.
_OP13 = r"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT b, 0, b FROM range(256) r(b) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8
), steps AS (SELECT b, v FROM bits WHERE k = 8),
t AS (
  SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), x, chars) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), crc(c, s, i, v) AS (
  SELECT c, CAST(c AS VARCHAR), 1, 4294967295 FROM (SELECT DISTINCT c FROM t)
  UNION ALL SELECT c, s, i + 1, xor(crc.v // 256, steps.v) FROM crc JOIN steps ON steps.b = xor(crc.v, ascii(s[i])) % 256 WHERE i <= length(s)
), h AS (SELECT c, c - c % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = length(s) + 1),
parts AS (
  SELECT h.c, p, x, chars FROM h JOIN t ON t.c = h.base WHERE p <= h
  UNION ALL SELECT h.c, p, x, chars FROM h JOIN t ON t.c = h.c WHERE p > h
), pre AS (
  SELECT c, row_number() OVER w AS d, chars, md5(string_agg(x, '') OVER w) AS own FROM parts WINDOW w AS (PARTITION BY c ORDER BY p)
  UNION ALL SELECT c, 0, 0, '' FROM h
), paths AS (SELECT *, lag(own) OVER w AS above, lead(own) OVER w IS NULL AS last FROM pre WINDOW w AS (PARTITION BY c ORDER BY d)),
nodes AS (SELECT own, d, any_value(above) AS above, any_value(chars) AS chars, min(c) AS least, count(*) AS n,
                 sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM paths GROUP BY own, d),
kids AS (SELECT above AS own, count(*) AS children FROM nodes WHERE d > 0 GROUP BY above),
sums AS (  -- a node counts at its least member, and at all prefixes of that
  SELECT p.c, p.own, sum(CASE WHEN k.own IS NULL AND n.least = p.c THEN 1 ELSE 0 END) OVER w AS leaves, sum(CASE WHEN n.least = p.c THEN (n.n - 1) * n.chars ELSE 0 END) OVER w AS saved
  FROM paths p JOIN nodes n ON n.own = p.own LEFT JOIN kids k ON k.own = p.own WINDOW w AS (PARTITION BY p.c ORDER BY p.d DESC)
), below AS (SELECT own, sum(leaves) AS leaves, sum(saved) AS saved FROM sums GROUP BY own)
SELECT n.least AS conv_id, CAST(n.d AS BIGINT) AS depth, u.least AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(children, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below USING (own) LEFT JOIN kids USING (own) LEFT JOIN nodes u ON u.own = n.above
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": _OP2, "op3_ngram_jaccard": _OP3, "op9_fingerprints": _op9(), "op11_ranked_search": _OP11, "op13_prefix_trie": _OP13}
