import itertools
import random
import zlib

import pytest

from donorloom.llm import mixing, sharding


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, size int, key string")


def filled(sizes, weights, percent, repeats):
    """Shares by weight, cut at the cap, the excess shared again among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: repeats * sizes[s] for s in names}
    target, excess, free = dict.fromkeys(names, 0.0), percent / 100 * sum(sizes.values()), list(names)
    while excess > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += excess * weight[s] / total
        excess = sum(max(0.0, target[s] - cap[s]) for s in free)
        for s in free:
            target[s] = min(target[s], cap[s])
        free = [s for s in free if target[s] < cap[s]]
    return target


@pytest.mark.parametrize("part_rows", [50_000, 3])
def test_mix_meets_targets(spark, monkeypatch, part_rows):
    monkeypatch.setattr(mixing, "PART_ROWS", part_rows)
    rng = random.Random(3)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 40))), rng.choices(["a", "b", "c", "é", None], [9, 2, 2, 1, 1])[0]) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "b"), (5, "five", "a")]
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in got) == sorted((r["doc_id"], r["size"], r["taken"]) for r in again)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len((t or "").split())) for i, t, _ in rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = r["source"]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = filled(sizes, (5, 2, 1), 150, 2)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None, None)])).collect()] == [0]


def test_targets_of_many_sources(spark):
    """More sources than a task sorts, so many caps in turn; sources of no words, a null one, and none at all."""
    rng = random.Random(7)
    sizes = {f"s{i}": int(1.3**rng.randint(0, 40)) for i in range(300)} | {"é": 0, "": 3, None: 50, "😀": 9}
    table = spark.createDataFrame([(f"k{s}", s, n) for s, n in sizes.items()], "key string, source string, source_size long").repartition(5)
    for weights, percent, repeats in (((5, 2, 1), 150, 2), ((1,), 60, 1), ((3, 1), 500, 2)):
        got = {r["source"]: r["target"] for r in mixing.source_targets(table, weights, percent, repeats).collect()}
        assert got == pytest.approx(filled(sizes, weights, percent, repeats), abs=1e-6)
    assert mixing.source_targets(table.limit(0), (1,), 150, 2).count() == 0


def test_rows_of_null_and_repeated_ids_are_mixed(spark):
    rows = [(None, "a b c", "s"), (None, "d e f", "s"), (4, "a b", "s"), (4, "a b", "s"), (4, None, None), (None, None, None), (5, "w " * 50_000, "t")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((i or 0, len((t or "").split())) for i, t, _ in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got) and sum(r["taken"] for r in got if r["source"] == "t") in (50_000, 100_000)


def test_fit_budget_is_as_near_as_can_be():
    rng = random.Random(8)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 30), rng.randint(1, 5)))
        counts = [rng.randint(0, 4) for _ in lengths]
        budget = rng.randint(0, 120)
        got = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= g <= c for g, c in zip(got, counts, strict=True))
        words = sum(n * g for n, g in zip(lengths, got, strict=True))
        base = [c * budget // max(1, sum(n * c for n, c in zip(lengths, counts, strict=True))) for c in counts]
        if budget < sum(n * c for n, c in zip(lengths, counts, strict=True)):
            sums = {sum(n * x for n, x in zip(lengths, pick, strict=True)) for pick in itertools.product(*(range(b, c + 1) for b, c in zip(base, counts, strict=True)))}
            assert abs(words - budget) == min(abs(x - budget) for x in sums)


def test_fit_budget_fills_large_budgets_exactly():
    lengths, counts = list(range(1, 2000)), [50] * 1999
    got = mixing.fit_budget(lengths, counts, 44_444_443)
    assert sum(n * g for n, g in zip(lengths, got, strict=True)) == 44_444_443


def test_difference_keeps_every_part_and_balances():
    rng = random.Random(2)
    for shards in (2, 3, 16):
        parts = [[0] * (shards - 1) + [rng.randint(1, 1000)] for _ in range(200)]
        to = sharding.difference(parts, shards)
        assert all(sorted(t) == list(range(shards)) for t in to)
        sums = [0] * shards
        for p, t in zip(parts, to, strict=True):
            for slot, x in enumerate(p):
                sums[t[slot]] += x
        assert sum(sums) == sum(map(sum, parts)) and max(sums) - min(sums) <= 20
    assert sharding.difference([[8], [7]], 1) == [[0], [0]]
    assert sharding.difference([[0, 8], [0, 7], [0, 6], [0, 5], [0, 4]], 2) is not None


def test_difference_is_near_the_best_split():
    """Against all splits of small sets: never worse than the largest part, and mostly the best there is."""
    rng = random.Random(12)
    best_found = 0
    for _ in range(60):
        shards, sizes = rng.choice([2, 3]), [rng.randint(1, 60) for _ in range(rng.randint(4, 8))]
        to = sharding.difference([[0] * (shards - 1) + [x] for x in sizes], shards)
        sums = [0] * shards
        for x, t in zip(sizes, to, strict=True):
            sums[t[-1]] += x
        spread = lambda split: max(split) - min(split)
        splits = []
        for pick in itertools.product(range(shards), repeat=len(sizes)):
            own = [0] * shards
            for x, k in zip(sizes, pick, strict=True):
                own[k] += x
            splits.append(spread(own))
        assert min(splits) <= spread(sums) <= max(sizes)
        best_found += spread(sums) <= min(splits) + 3
    assert best_found >= 40


def test_rows_of_null_ids_and_long_texts_are_placed(spark):
    rows = [(None, "a", "s"), (None, "a", "s"), (None, None, "s"), (3, "x" * 2_000_000, "s"), (4, "", "s")]
    got = sharding.shard_by_bytes(docs(spark, rows), 16).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 1), (0, 2), (0, 2), (3, 2_000_001), (4, 1)]
    assert len({r["shard"] for r in got if r["size"] == 2}) == 1


@pytest.mark.parametrize(("bucket", "fan_in"), [(4096, 512), (7, 3)])
def test_shards(spark, bucket, fan_in):
    rng = random.Random(5)
    texts = ["x" * rng.randint(0, 400) + str(rng.random()) for _ in range(300)] + ["hot text"] * 40 + [None, None, "", "é"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(900, "again", "s"), (900, "again", "s")]
    groups = spark.createDataFrame([(str(i), rng.randint(1, 500)) for i in range(200)], "key string, bytes long")
    placed = sharding.shard_groups(groups, 4, bucket, fan_in).join(groups, "key").collect()
    sums = [sum(r["bytes"] for r in placed if r["shard"] == s) for s in range(4)]
    assert len(placed) == 200 and max(sums) - min(sums) <= (20 if bucket > 200 else 150)
    got = sharding.shard_by_bytes(docs(spark, rows), 16, slot_rows=3).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    text = {i: t for i, t, _ in rows}
    homes = {}
    for r in got:
        homes.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values()) and {r["law"] for r in got} == {"bytes"}
    assert sharding.shard_by_bytes(docs(spark, [])).count() == 0
