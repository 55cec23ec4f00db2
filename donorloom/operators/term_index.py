"""Search terms that a text can be similar to, by inverted lists of their characters and pairs of characters.

A text and a term of which the shorter has m characters can only reach a ratio r with a window if they share r m / (200 - r)
characters, in any order, and (3 r - 200) m / (200 - r) - 1 pairs of adjacent ones: of the pairs that the common subsequence
makes, each character left over on either side parts one. Lists say which terms have a pair of characters for the k-th time; merged,
they count what a text shares with the terms on its lists (a T-occurrence search), and no other term is looked at. Where
the shorter is so short that no pair need be shared, the lists are those of characters.

Of the terms found, those stay that share more: r m / 100 characters and (3 r - 200) m / 100 - 1 pairs for a window as long as
the shorter; or, for a window of w characters at an end, r (m + w) / 200 of those characters.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np


def _numbered(parts) -> list[tuple]:
    """Each part with how often it has come before."""
    seen: Counter = Counter()
    out = []
    for p in parts:
        out.append((p, seen[p]))
        seen[p] += 1
    return out


def _pairs(text: str) -> list[tuple]:
    return _numbered(zip(text, text[1:]))


class TermIndex:
    """Terms with the inverted lists of their pairs and characters, for one least ratio."""

    def __init__(self, terms: list[str], least: int):
        self.terms, self.least = terms, least
        self.size = np.array([len(t) for t in terms], np.int64)
        #: Length of the shorter up to which no pair need be shared.
        self.short = (200 - least) // (3 * least - 200)
        self.pairs, self.letters, self.short_letters = ({} for _ in range(3))
        for lists, parts, some in ((self.pairs, _pairs, None), (self.letters, _numbered, None), (self.short_letters, _numbered, self.short)):
            rows = defaultdict(list)
            for i, t in enumerate(terms):
                if some is None or len(t) <= some:
                    for p in parts(t):
                        rows[p].append(i)
            lists.update({p: np.array(own, np.int32) for p, own in rows.items()})
        bins, longest = _bins(terms), int(self.size.max(initial=1))
        self.counts = np.array([np.bincount(b, minlength=64) for b in bins], np.int64).reshape(-1, 64)
        self.chars, self.reversed = np.zeros((2, len(terms), longest), np.int64)
        for i, b in enumerate(bins):
            self.chars[i, : len(b)], self.reversed[i, : len(b)] = b, b[::-1]

    def _shared(self, lists: dict, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Terms on any of a text's lists, and on how many of them."""
        met = [lists[p] for p in parts if p in lists]
        if not met:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        count = np.bincount(np.concatenate(met))
        found = np.flatnonzero(count)
        return found, count[found]

    def candidates(self, text: str) -> np.ndarray:
        """Places of the terms that share as much with a text as the ratio asks for."""
        n, r = len(text), self.least
        found, own = self._shared(self.letters if n <= self.short else self.short_letters, _numbered(text))
        found = found[(200 - r) * own >= r * np.minimum(self.size[found], n)]
        pairs = np.full(len(found), n)
        if n > self.short:
            long, own = self._shared(self.pairs, _pairs(text))
            m = np.minimum(self.size[long], n)
            keep = (m > self.short) & ((200 - r) * (own + 1) >= (3 * r - 200) * m)
            found, pairs = np.concatenate([found, long[keep]]), np.concatenate([pairs, own[keep]])
        if not len(found):
            return found
        chars = _bins([text])[0]
        m, own = np.minimum(self.size[found], n), np.bincount(chars, minlength=64)
        shared = np.minimum(self.counts[found], own).sum(axis=1)
        stay = (100 * shared >= r * m) & (100 * (pairs + 1) >= (3 * r - 200) * m)
        rest = np.flatnonzero(~stay & ((200 - r) * shared >= r * m))
        for one, other in ((rest[self.size[found[rest]] <= n], True), (rest[self.size[found[rest]] >= n], False)):
            # the windows are the text's, or the term's
            i = found[one]
            short = self.counts[i] if other else np.broadcast_to(own, (len(i), 64))
            for step in (1, -1):
                if other:
                    windows = np.broadcast_to(chars[::step], (len(i), n))
                else:
                    windows = self.chars[i] if step == 1 else self.reversed[i]
                stay[one] |= _ends(short, windows, m[one], r)
        return np.sort(found[stay])


def _bins(texts: list[str]) -> list[np.ndarray]:
    return [np.array([ord(c) & 63 for c in t], np.int64) for t in texts]


def _ends(short: np.ndarray, windows: np.ndarray, m: np.ndarray, r: int) -> np.ndarray:
    """Whether any beginning of ``windows`` shorter than m shares enough characters with what ``short`` counts."""
    left, shared, out, rows = short.copy(), np.zeros(len(m), np.int64), np.zeros(len(m), bool), np.arange(len(m))
    for w in range(1, min(windows.shape[1], int(m.max(initial=1)) - 1) + 1):
        c = windows[:, w - 1]
        has = left[rows, c] > 0
        left[rows, c] -= has
        shared += has
        out |= (w < m) & (200 * shared >= r * (m + w))
    return out
