"""Prefixes that conversations share, as a compressed trie built from sorted conversations (Patricia construction).

A conversation is a path of turn digests. Equal paths are one, with the number and the least of their conversations. Distinct
paths are range-partitioned and sorted, so that what one shares with the next tells all there is to know: points are made only
where paths branch, end or stop, an edge between two points stands for all nodes between them. Aggregates are summed on that
tree; then each edge is expanded: its nodes have the members of its lower point, and what they save is a suffix sum of the edge.

A range does not know what its neighbours hold. It finishes all points but those on its first and its last path, and gives
these two paths away with their points' own sums. The paths of all ranges, two a range, are merged by the same procedure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorloom.operators.shared import materialize

#: Hexadecimal digits of a turn's digest.
WIDTH = 32
#: Ids joined to one string at a time, before the strings of a path are hashed one after the other.
CHUNK = 4096
_BATCH = 20_000
_POINT = "struct<depth: int, n: bigint, least: bigint, ends: string, children: bigint, below: bigint, leaves: bigint, saved: bigint>"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, point string, parent string"
_ROW = f"{_NODE}, path string, chars array<int>, points array<{_POINT}>"
_NONE = hashlib.sha256(b"").hexdigest()


def turn_lists(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns in order (null first; turns of one number by role, then by digest), as
    digests of role and text (null as empty) and code points of the text. Rows without a conversation's id are in none."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    one = F.struct(F.isnotnull("turn"), F.col("turn"), role.alias("role"), digest.alias("digest"), F.length(text).alias("chars"))
    rows = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_heads(lists: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation ``c - c % every`` (all, if it has fewer; none,
    if there is no such); h is the CRC32 of c in decimal, modulo ``most + 1``."""
    heads = lists.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = lists.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h})
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


class Point:
    """A point of the compressed trie that is still open: conversations that end here, sums over children that are closed."""

    __slots__ = ("below", "children", "depth", "ends", "kids", "least", "leaves", "n", "saved")

    def __init__(self, depth: int, n: int = 0, least: int | None = None, ends: str | None = None, children: int = 0, below: int = 0, leaves: int = 0, saved: int = 0):
        self.depth, self.n, self.least, self.ends = depth, n, least, ends
        self.children, self.below, self.leaves, self.saved, self.kids = children, below, leaves, saved, []

    def add(self, other: Point) -> None:
        """The same point as another range has it."""
        self.n, self.below, self.children, self.leaves, self.saved = self.n + other.n, self.below + other.below, self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        self.least, self.ends = _least(self.least, other.least), self.ends or other.ends

    def given(self) -> dict:
        return {c: getattr(self, c) for c in ("depth", "n", "least", "ends", "children", "below", "leaves", "saved")}


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _edge(point: Point, chars: list[int], key: str | None) -> tuple[int, int, list]:
    """The nodes of an edge that ends at ``point``, lowest first, as ``chars`` of their last texts tell what they save."""
    n, saved, out = point.n + point.below, point.saved, []
    for i in range(len(chars) - 1, -1, -1):
        saved += (n - 1) * chars[i]
        low = i == len(chars) - 1
        out.append([point.least, point.depth - (len(chars) - 1 - i), point.least, n, point.children if low else 1, max(point.leaves, 1), saved, (point.ends if low else None) or _NONE, key if low else None, None])
    return n, saved, out


def _shared(a: str, b: str) -> int:
    """Number of turns that two paths begin with in common."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _key(path: str, depth: int) -> str:
    return hashlib.md5(path[: depth * WIDTH].encode()).hexdigest()


def build(paths: Iterable[tuple[str, list[int], list[Point]]], whole: bool, give: Callable[[str, list[int], list[Point]], None]) -> Iterator[list]:
    """Nodes of the trie of sorted paths, each with its points. If the paths are not the whole trie, the points on the first
    and the last path go to ``give``, and their finished children name their parent by its key; else all are finished."""
    stack, path, chars, first, left, spine = [Point(0)], "", [], None, 0, []

    def finish(p: Point, parent: int | None, name: str | None) -> Iterator[list]:
        for kid in p.kids:
            kid[-1][2], kid[-1][-1] = parent, name
            yield from kid
        p.kids = []

    def close(depth: int) -> Iterator[list]:
        """Close all open points below ``depth``, where a point is then open."""
        while stack[-1].depth > depth:
            p = stack.pop()
            if not whole and p.depth <= left:
                yield from finish(p, None, _key(path, p.depth))
                spine.append(p)
                if stack[-1].depth < depth:
                    stack.append(Point(depth))
                continue
            if stack[-1].depth < depth:
                stack.append(Point(depth))
            over = stack[-1]
            yield from finish(p, p.least, None)
            n, saved, nodes = _edge(p, chars[over.depth : p.depth], _key(path, p.depth) if whole else None)
            over.below, over.least, over.leaves, over.saved, over.children = over.below + n, _least(over.least, p.least), over.leaves + max(p.leaves, 1), over.saved + saved, over.children + 1
            over.kids.append(nodes)

    for new, new_chars, points in paths:
        if first is None:
            first, left = new, len(new) // WIDTH
        else:
            both = _shared(path, new)
            yield from close(both)
            left = min(left, both)
        path, chars = new, new_chars
        for p in points:
            at = len(stack)
            while at and stack[at - 1].depth > p.depth:
                at -= 1
            if at and stack[at - 1].depth == p.depth:
                stack[at - 1].add(p)
            else:
                stack.insert(at, p)
    if first is None:
        return
    if whole:
        yield from close(0)
        root = stack[0]
        yield from finish(root, root.least, None)
        yield [root.least, 0, None, root.n + root.below, root.children, max(root.leaves, 1), root.saved, root.ends or _NONE, _key("", 0), None]
        return
    if spine:
        give(first, None, spine)
    for p in stack:
        yield from finish(p, None, _key(path, p.depth))
    give(path, chars, stack)


def _rows(nodes: Iterator[list], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Node rows as batches of the columns of ``kind``; what a row lacks is null."""
    held: list[list] = []
    for node in nodes:
        held.append(node)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=False)], names=kind.names[: len(node)])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=False)], names=kind.names[: len(held[0])])


def _arrow(names: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))])


_NODES = _arrow(_NODE)
_POINTS = pa.list_(pa.struct([("depth", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string()), ("children", pa.int64()), ("below", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]))
_FULL = pa.schema([*_NODES, ("path", pa.string()), ("chars", pa.list_(pa.int32())), ("points", _POINTS)])


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of one range of sorted paths: finished nodes, and its first and last path with their points."""
    edges: list[tuple] = []
    first: list = []

    def paths() -> Iterator:
        for b in batches:
            for r in b.to_pylist():
                if not first:
                    first.extend([r["path"], r["chars"]])
                yield r["path"], r["chars"], [Point(len(r["chars"]), r["n"], r["least"], r["ends"])]

    def give(path: str, chars: list[int] | None, points: list[Point]) -> None:
        edges.append((path, first[1] if chars is None else chars, [p.given() for p in points]))

    for b in _rows(build(paths(), False, give), _NODES):
        full = [*b.columns, *(pa.nulls(b.num_rows, f.type) for f in list(_FULL)[len(_NODES) :])]
        yield pa.RecordBatch.from_arrays(full, schema=_FULL)
    if edges:
        none = [pa.nulls(len(edges), f.type) for f in _NODES]
        yield pa.RecordBatch.from_arrays([*none, *(pa.array(c, f.type) for c, f in zip(zip(*edges, strict=True), list(_FULL)[len(_NODES) :], strict=True))], schema=_FULL)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of the paths that all ranges have given away."""

    def paths() -> Iterator:
        for b in batches:
            for r in b.to_pylist():
                yield r["path"], r["chars"], sorted((Point(**p) for p in r["points"]), key=lambda p: p.depth)

    yield from _rows(build(paths(), True, lambda *_: None), _NODES)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each path its number of conversations, the least of them, and the hash of all their ids, string by string."""
    schema = pa.schema([("path", pa.string()), ("chars", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
    key, run, row, done = None, None, None, []
    for b in batches:
        for r in b.to_pylist():
            if r["key"] != key:
                if row:
                    done.append([*row, run.hexdigest()])
                key, run, row = r["key"], hashlib.sha256(r["ids"].encode()), [r["path"], r["chars"], r["n"], r["least"]]
            else:
                run.update(b"," + r["ids"].encode())
                row[2] += r["n"]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done = []
    if row:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip([*row, run.hexdigest()], schema, strict=True)], schema=schema)


def prefix_trie(lists: DataFrame) -> DataFrame:
    """All nodes of the trie of ``lists``, rows of ``conv_id`` and ``turns`` (array of digest and code points), with ``conv_id``
    (the least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    The root is of depth 0 and has every conversation, also those without turns; an empty table has no nodes. Rows of one id
    are members each. The digests of one conversation stand in one row (32 bytes a turn), those of copies in one for
    all; the ids of copies are hashed as a stream.
    """
    paths = lists.filter("conv_id IS NOT NULL").select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"), F.transform("turns", lambda t: t["chars"].cast("int")).alias("chars"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = paths.withColumns({"key": F.md5("path"), "chunk": F.floor(F.col("conv_id") / CHUNK)}).groupBy("key", "chunk").agg(
        F.first("path").alias("path"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")
    )
    ends = chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_ends, "path string, chars array<int>, n long, least long, ends string")
    ends = materialize(ends, "paths")
    made = materialize(ends.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_range, _ROW), "ranges")
    edges = made.filter("path IS NOT NULL").select("path", "chars", "points")  # two a range
    top = materialize(edges.repartition(1).sortWithinPartitions("path").mapInArrow(_merge, _NODE), "top")
    nodes = made.filter("path IS NULL")
    named = top.filter("point IS NOT NULL").select(F.col("point").alias("parent"), F.col("conv_id").alias("named"))
    below = nodes.filter("parent IS NOT NULL").join(named, "parent").withColumn("parent_conv_id", F.col("named"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.filter("parent IS NULL").select(out).unionByName(below.select(out)).unionByName(top.select(out))
