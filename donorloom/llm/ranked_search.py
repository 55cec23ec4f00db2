"""The highest-scoring documents for each of many queries, by three rounds over lists of postings (TPUT).

The lists are partitioned by term; a list of many postings is dealt to several parts. Round 1 takes the head of every list:
sums over heads are lower bounds, and the k-th largest of a query's is its bar. Round 2 fetches from every list all that
reaches the bar divided by the query's number of lists (a list serves several queries: the least of theirs); a document that
has not shown up in any cannot reach the bar. Sums of what was fetched and what the rest could add give lower and upper bounds,
the k-th largest lower bound is the next bar. Round 3 looks up the exact scores of the documents whose upper bound reaches it.

Documents that hold the same query terms as often, and have the same length factor, have the same scores: one of each such
class is searched, and the k least ids of a class stand for it in the result. So copies cost no more than one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from donorloom.llm import text as T
from donorloom.llm.rows import row_key
from donorloom.operators.shared import materialize

#: Pairs of query and term that one pass over the documents serves; queries of more are searched in several passes.
BLOCK_PAIRS = 1 << 20
#: Postings of one part of a list.
LIST_ROWS = 200_000
#: Rows that are sent to every task instead of moving the postings, counted before.
SENT_ROWS = 1_000_000
#: Products of postings and queries, and sums, that a task holds at once.
HELD = 1 << 21


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each query as 64-bit hashes."""
    for b in batches:
        row = 0
        for piece in T.pieces(b["text"]):
            found = T.words(piece, T.NOT_ALNUM)
            for i in range(piece.n):
                terms = np.unique(found.hashes[found.bounds[i] : found.bounds[i + 1]])
                item, item_id = b["item"][row].as_py(), b["item_id"][row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array([item_id] * len(terms), b["item_id"].type), pa.array(T.signed(terms))], ["item", "item_id", "term"])
                row += 1


def _scan(wanted):
    """Of each document its number of terms, and how often it holds each query term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, row = wanted.value, TaskContext.get().partitionId() << 33
        for b in batches:
            first = 0
            for piece in T.pieces(b["text"]):
                found = T.words(piece, T.NOT_ALNUM)
                n = np.diff(found.bounds)
                at = np.minimum(np.searchsorted(terms, found.hashes), len(terms) - 1)
                hit = terms[at] == found.hashes
                keys, tf = np.unique(np.repeat(np.arange(piece.n), n)[hit] * len(terms) + at[hit], return_counts=True)
                bounds = np.searchsorted(keys, np.arange(piece.n + 1) * len(terms)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (keys % len(terms), tf)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + piece.n)), b["doc_id"].slice(first, piece.n), pa.array(n), *lists], ["row", "doc_id", "n", "terms", "tfs"])
                row, first = row + piece.n, first + piece.n

    return run


def _postings(parts):
    """A document's postings: term, part of its list, and impact, the part of a score that no query changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts = parts.value
        for b in batches:
            each = pc.list_value_length(b["terms"]).to_numpy()
            term, tf = b["terms"].flatten().to_numpy().astype(np.int64), b["tfs"].flatten().to_numpy().astype(np.int64)
            row, m = np.repeat(b["row"].to_numpy(), each), np.repeat(b["m"].to_numpy(), each)
            part = (T.mix(T.unsigned(row)) % n_parts[term].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(part), pa.array(1_000_000_000 * tf // (1000 * tf + 20 * m)), pa.array(row)], ["term", "part", "impact", "row"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Postings in order of documents, as blocks of whole documents that make at most ``HELD`` products with queries."""
    width, kept, held = np.diff(first), [], 0

    def cut(x: list[np.ndarray], last: bool) -> Iterator:
        ends = np.flatnonzero(np.diff(x[0])) + 1
        if last:
            ends = np.append(ends, len(x[0]))
        made = np.concatenate([[0], np.cumsum(width[x[1]])])
        begin = 0
        while len(ends) and begin < ends[-1]:
            end = ends[max(np.searchsorted(made[ends], made[begin] + HELD, side="right") - 1, np.searchsorted(ends, begin, side="right"))]
            yield [c[begin:end] for c in x]
            begin = end
        kept[:] = [[c[begin:] for c in x]]

    for b in batches:
        kept.append([b[c].to_numpy() for c in ("row", "term", "impact")])
        held += int(width[kept[-1][1]].sum())
        if held >= HELD:
            yield from cut([np.concatenate(c) for c in zip(*kept, strict=True)], False)
            held = int(width[kept[0][1]].sum())
    if kept:
        yield from cut([np.concatenate(c) for c in zip(*kept, strict=True)], True)


def _bounds(sent, k: int):
    """Lower and upper bounds of the scores of documents that may be among a query's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, query, weight, rest, unseen, bar = (sent.value[c] for c in ("first", "query", "weight", "rest", "unseen", "bar"))
        n, bar = len(bar), bar.copy()
        best = np.zeros((k, n))
        for rows, term, impact in _blocks(batches, first):
            each = np.diff(first)[term]
            at = np.repeat(first[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            ids, local = np.unique(rows, return_inverse=True)
            step = max(1, HELD // n)
            own = np.repeat(local, each)
            for low in range(0, len(ids), step):
                few = min(step, len(ids) - low)
                a, z = np.searchsorted(own, [low, low + few])
                cell = (own[a:z] - low) * n + query[at[a:z]]
                # sums of whole numbers below 2**53 are exact in doubles
                lower = np.bincount(cell, weight[at[a:z]] * np.repeat(impact, each)[a:z], few * n).reshape(few, n)
                upper = lower + unseen - np.bincount(cell, rest[at[a:z]], few * n).reshape(few, n)
                best = np.partition(np.concatenate([best, lower]), few, axis=0)[few:]
                bar = np.maximum(bar, best[0])
                i, q = np.nonzero((lower > 0) & (upper >= bar))
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids[low + i]), pa.array(lower[i, q].astype(np.int64)), pa.array(upper[i, q].astype(np.int64))], ["query", "row", "lower", "upper"])

    return run


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SENT_ROWS else df


def _kth(sums: DataFrame, by: str, k: int) -> DataFrame:
    """Of each query the k-th largest sum; queries with fewer have none."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by)))
    return sums.select("query", by, place.alias("place")).filter(F.col("place") <= k).filter(F.col("place") == k).select("query", F.col(by).alias("bar"))


def _search(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The best documents of one block of queries; ``pairs`` of query and term are at most ``BLOCK_PAIRS`` or one query's."""
    spark = docs.sparkSession
    got = pairs.toPandas()
    terms, term = np.unique(T.unsigned(got["term"].to_numpy()), return_inverse=True)
    items, query = np.unique(got["item"].to_numpy(), return_inverse=True)
    context = spark.sparkContext
    scanned = materialize(docs.select("doc_id", "text").mapInArrow(_scan(context.broadcast(terms)), "row long, doc_id long, n long, terms array<int>, tfs array<int>"), "scanned")
    n, total = (int(x or 0) for x in scanned.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
    if not n:
        return spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    held = scanned.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # a row a query term
    df = np.zeros(len(terms), np.int64)
    df[held["term"]] = held["count"]
    w = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    m = F.expr(f"100 - 50 + CAST(50 * CAST(n AS DECIMAL(38, 0)) * {n} AS DECIMAL(38, 0)) div {total}")
    docs = scanned.filter(F.size("terms") > 0).withColumn("m", m)

    # one of each class of equal scores
    signed = docs.select("row", "doc_id", F.xxhash64(F.lit(1), "m", "terms", "tfs").alias("sig"), F.xxhash64(F.lit(2), "tfs", "terms", "m").alias("sig2"))
    least = F.min_by("row", F.struct(F.isnull("doc_id"), "doc_id", "row")).alias("stands")
    several = signed.groupBy("sig", "sig2").agg(F.count("*").alias("n"), least).filter("n > 1")
    classes = materialize(signed.join(several, ["sig", "sig2"]).select("stands", "row", "doc_id"), "classes")
    others = classes.filter(F.col("row") != F.col("stands")).select("row")
    lists = docs.join(_sent(others, others.count()), "row", "left_anti").select("row", "m", "terms", "tfs")
    parts = context.broadcast(np.maximum(1, -(-df // LIST_ROWS)))
    postings = lists.mapInArrow(_postings(parts), "term int, part int, impact long, row long")
    postings = materialize(postings.repartition("term", "part").sortWithinPartitions("term", "part", F.desc("impact")), "postings")

    # round 1: heads of the lists
    asked = F.broadcast(spark.createDataFrame(got.assign(query=query.astype(np.int32), term=term.astype(np.int32), w=w[term])[["query", "term", "w"]], "query int, term int, w long").filter("w > 0"))
    heads = postings.select("term", "impact", "row", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row")).alias("place")).filter(F.col("place") <= k)
    sums = heads.join(asked, "term").groupBy("query", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("lower")).filter("lower > 0")
    first_bar = _kth(sums, "lower", k).toPandas()
    bar = np.zeros(len(items), np.int64)
    bar[first_bar["query"]] = first_bar["bar"]

    # round 2: all that reaches a list's share of the bar
    width = np.bincount(query, minlength=len(items))
    share = np.where(w[term] > 0, -(-bar[query] // np.maximum(width[query] * w[term], 1)), np.iinfo(np.int64).max)
    floor = np.full(len(terms), np.iinfo(np.int64).max)
    np.minimum.at(floor, term, np.maximum(share, 1))
    rest = np.where(w[term] > 0, w[term] * (np.minimum(floor[term], 1_000_001) - 1), 0)  # an impact is a million at most
    by_term = np.lexsort((query, term))
    sent = context.broadcast({
        "first": np.searchsorted(term[by_term], np.arange(len(terms) + 1)), "query": query[by_term], "weight": w[term][by_term],
        "rest": rest[by_term], "unseen": np.bincount(query, rest, len(items)), "bar": bar.astype(float),
    })
    floors = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": np.arange(len(terms), dtype=np.int32), "floor": floor}), "term int, floor long"))
    fetched = postings.join(floors, "term").filter(F.col("impact") >= F.col("floor")).select("row", "term", "impact")
    bounded = fetched.repartition("row").sortWithinPartitions("row").mapInArrow(_bounds(sent, k), "query int, row long, lower long, upper long")
    bounded = materialize(bounded, "bounds")
    bars = F.broadcast(_kth(bounded, "lower", k))  # a row a query
    left = materialize(bounded.join(bars, "query", "left").filter(F.col("upper") >= F.coalesce("bar", F.lit(0))).select("query", "row"), "candidates")

    # round 3: exact scores
    exact = postings.join(_sent(left, left.count()), "row").join(asked, ["query", "term"]).groupBy("query", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "row"]
    ranked = Window.partitionBy("query").orderBy(*order)
    best = exact.filter("score > 0").join(scanned.select("row", "doc_id"), "row").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    members = classes.withColumn("place", F.row_number().over(Window.partitionBy("stands").orderBy(F.asc_nulls_last("doc_id"), "row"))).filter(F.col("place") <= k)
    members = members.select(F.col("stands").alias("row"), F.struct(F.col("row").alias("row"), F.col("doc_id").alias("doc_id")).alias("member"))
    whole = best.drop("rank").join(members, "row", "left").select("query", "score", F.coalesce("member.row", "row").alias("row"), F.when(F.isnull("member"), F.col("doc_id")).otherwise(F.col("member.doc_id")).alias("doc_id"))
    whole = whole.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    ids = F.broadcast(spark.createDataFrame(pd.DataFrame({"query": np.arange(len(items), dtype=np.int32), "item": items}), "query int, item long"))
    return whole.join(ids, "query").select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: of each query the ``k`` documents of highest score above 0, equal scores by
    ascending id (null last). ``docs`` has ``doc_id`` and ``text``, ``queries`` ``item_id`` and ``text``; other columns are
    not read.

    Terms are runs of letters and digits (and all beyond ASCII), A-Z lower-cased; weights and scores are whole numbers as the
    contract of the query gives them. Null and empty texts have no term; a query without any has no rows. Every row of the
    documents is one, also where ids are null or repeated; equal rows of the queries are one query, rows of one id with
    different texts are queries each, under that id. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    asked = queries.select("item_id", "text").distinct().select(row_key("item_id", "text").alias("item"), "item_id", "text")
    id_type = queries.schema["item_id"].dataType.simpleString()
    pairs = materialize(asked.mapInArrow(_words, f"item long, item_id {id_type}, term long"), "query-terms")
    n_blocks = -(-pairs.count() // BLOCK_PAIRS)
    names = pairs.select("item", "item_id").distinct()
    out = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    for b in range(n_blocks):
        found = _search(docs, pairs.filter(F.pmod("item", F.lit(n_blocks)) == b).select("item", "term"), k)
        out = found if n_blocks == 1 else out.unionByName(materialize(found, "ranked"))
    return out.join(names, "item").select("item_id", "rank", "doc_id", "score")
