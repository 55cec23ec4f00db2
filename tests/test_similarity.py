import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from donorloom.functions import similarity as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def best_window(x, y):
    """Every window on its own."""
    if not x or not y:
        return 100.0 if x == y else 0.0
    found = []
    for s, l in [(x, y), (y, x)] if len(x) == len(y) else [(x, y) if len(x) < len(y) else (y, x)]:
        m, n = len(s), len(l)
        windows = [l[i : i + m] for i in range(n - m + 1)] + [l[:k] for k in range(1, m)] + [l[n - k :] for k in range(1, m)]
        found += [200.0 * lcs(s, w) / (m + len(w)) for w in windows]
    return max(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ABé😀 ", max_size=12), st.text("ABé😀 ", max_size=18)), max_size=6))
def test_partial_ratios(pairs):
    got = S.partial_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == pytest.approx([best_window(a, b) for a, b in pairs])


def test_partial_ratios_in_groups(monkeypatch):
    rng = random.Random(3)
    texts = lambda most: ["".join(rng.choices("ABCD ", k=rng.randint(0, most))) for _ in range(300)]
    a, b = texts(25), texts(90)
    want = S.partial_ratios(a, b)
    assert want.tolist() == pytest.approx([best_window(x, y) for x, y in zip(a, b)])
    monkeypatch.setattr(S, "GROUP_CELLS", 1)
    assert S.partial_ratios(a, b).tolist() == want.tolist()


def test_longer_string_costs_linear_time():
    def took(n):
        began = time.process_time()
        S.partial_ratios(["ABC D" * 20] * 4, ["ABDC " * n] * 4)
        return time.process_time() - began

    took(400)
    assert min(took(1600) for _ in range(3)) < 12 * min(took(400) for _ in range(3)) + 0.1
