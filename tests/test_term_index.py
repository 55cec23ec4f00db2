import random

import numpy as np
import pytest

from donorloom.functions.similarity import partial_ratios, ratios
from donorloom.operators.term_index import TermIndex


def similar(a, b, least):
    return np.maximum(ratios(a, b), partial_ratios(a, b)) >= least


@pytest.mark.parametrize(("alphabet", "least"), [("AB", 72), ("ABCDEFé ", 72), ("ABCDEFGHIKLMNOPRSTUVY  ", 72), ("ABCDEFGH ", 85)])
def test_index_loses_no_term(alphabet, least):
    rng = random.Random(len(alphabet))
    terms = ["".join(rng.choices(alphabet, k=rng.randint(2, 30))) for _ in range(150)]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(2, 40))) for _ in range(60)]
    for t in rng.sample(terms, 60):  # near ones, whole and within a longer text
        s = list(t)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randint(0, 1)] = rng.choice(alphabet)
        texts += ["".join(s), "".join(rng.choices(alphabet, k=rng.randint(0, 12))) + "".join(s) + "".join(rng.choices(alphabet, k=rng.randint(0, 12)))]
    index = TermIndex(terms, least)
    for text in (t for t in texts if len(t) >= 2):
        want = set(np.flatnonzero(similar(terms, [text] * len(terms), least)).tolist())
        assert want <= set(index.candidates(text).tolist())
    assert index.candidates("??").tolist() == TermIndex([], least).candidates("AB").tolist() == []


def test_index_finds_few():
    """Of names made of many words, a text meets few terms."""
    rng = random.Random(2)
    words = ["".join(rng.choices("ABCDEFGHIKLMNOPRSTUVWY", [8, 2, 3, 4, 12, 2, 2, 5, 7, 1, 4, 3, 7, 8, 2, 6, 6, 9, 3, 1, 2, 2], k=rng.randint(3, 9))) for _ in range(2000)]
    terms = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(300)]
    index = TermIndex(terms, 72)
    found = sum(len(index.candidates(t)) for t in texts)
    assert found < 0.2 * len(terms) * len(texts), found / len(terms) / len(texts)
