import hashlib
import random
import zlib
from collections import defaultdict

from donorloom.llm import prefix_trie as P

OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(rows, every=100, most=5):
    """All prefixes of all rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        base = c - (c % every if c >= 0 else -(-c % every))
        h = zlib.crc32(str(c).encode()) % (most + 1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = []

    def walk(p):
        leaves, saved = 0, 0
        for k in kids[p]:
            a, b = walk(k)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        saved += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        names = ",".join(map(str, sorted(ends[p])))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(names.encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=str)


def made(spark, rows, parts=4):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        table = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int")
        got = P.prefix_trie(P.with_shared_heads(P.turn_lists(table)))
        assert got.columns == OUT
        return sorted((tuple(r) for r in got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_ranges_merge():
    """A trie built in ranges, as many as one a path, is that of all paths at once."""
    rng = random.Random(2)
    for _ in range(300):
        alphabet = [hashlib.md5(bytes([i])).hexdigest() for i in range(rng.randint(1, 3))]
        found = {"".join(rng.choices(alphabet, k=rng.randint(0, 7))): rng.randint(1, 4) for _ in range(rng.randint(1, 12))}
        paths = [(p, [1 + alphabet.index(p[i * 32 : i * 32 + 32]) for i in range(len(p) // 32)], n) for p, n in sorted(found.items())]
        ids = iter(rng.sample(range(1000), len(paths)))
        paths = [(p, c, n, next(ids)) for p, c, n in paths]
        points = lambda some: [(p, c, [P.Point(len(c), n, i, f"e{i}")]) for p, c, n, i in some]
        want = [tuple(r[:8]) for r in P.build(points(paths), True, None)]
        edges, nodes, low = [], [], 0
        while low < len(paths):
            high = low + rng.randint(1, 4)
            nodes += P.build(points(paths[low:high]), False, lambda p, c, own, first=paths[low][1]: edges.append((p, c or first, sorted(own, key=lambda x: x.depth))))
            low = high
        for _, _, own in edges:
            for p in own:
                p.kids = []
        top = list(P.build(edges, True, None))
        named = {r[8]: r[0] for r in top if r[8]}
        for r in nodes:
            if r[9]:
                r[2] = named[r[9]]
        assert sorted((tuple(r[:8]) for r in [*nodes, *top]), key=str) == sorted(want, key=str)


def test_prefix_trie(spark):
    """Nulls in any column, turns of one number, repeated rows, copies, absent and short bases, negative ids, a very long conversation."""
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(230, 260), *range(-120, -95), 5_000_000_000]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", None, "çé", ""])) for t in range(rng.randint(1, 8))]
    rows += [(100, None, "user", "first"), (7, 2, "user", "a"), (7, 2, "user", "a"), (7, 2, None, "zz"), (None, 1, "user", "a"), (None, None, None, None), (300, None, None, None)]
    rows += [(c, t, "user", f"copy {t}") for c in range(400, 460) for t in range(6)]
    rows += [(901, t, "user", "x" * (t % 3)) for t in range(400)] + [(902, t, "user", "x" * (t % 3)) for t in range(390)] + [(903, 0, "user", "long " * 200_000)]
    rng.shuffle(rows)
    want = trie(rows)
    for parts in (1, 4, 23):
        assert made(spark, rows, parts) == want


def test_small_tries(spark):
    assert made(spark, []) == []
    assert made(spark, [(None, 1, "user", "a")]) == []
    for rows in ([(1, 0, "user", "a")], [(100, 0, "user", "abc"), (101, 0, "user", "abc")]):
        assert made(spark, rows) == trie(rows)
