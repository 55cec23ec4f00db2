"""Toxicity: a Levenshtein automaton walked together with the trie of a lexicon, and scores of the context.

The lexicon is a short list of insults and the words and word beginnings that labelled toxic texts have more often
than chance allows. Its trie and the edit automaton (a letter more, less, other, or two swapped, the first one too) are
intersected step by step and kept as one deterministic automaton, so most words of a text end after a few letters.
Words near a term that labelled clean texts have are ordinary words, not misspellings. Each hit is weighed by its context
window: inside quotation marks or after a verb of reporting it counts as quoted, otherwise as abuse.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# General insults.
INSULTS = (
    "idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "clown", "disgusting", "imbecile", "garbage",
    "vermin", "filth", "coward", "dimwit", "halfwit", "degenerate", "parasite", "lowlife", "scumbag", "dumbass", "bastard", "bitch",
)
# Verbs that report another's words, and words that address the reader.
REPORTS = frozenset("said says say wrote writes quoted quote quotes called calls replied shouted term word reported claims claimed dit sagte schrieb dijo".split())
ADDRESS = frozenset("you your youre yourself u tu vous toi du dich ihr sie usted ustedes ti".split())
QUOTES = re.compile("[\"“”„«»]")
WORD = re.compile(r"\w+")

#: Labelled rows of each class that the lexicon and the weights are fitted on, at most: those of least hash. The learned
#: lexicon is all that passes its test on them, so the sample bounds it too.
FIT_ROWS = 4000
#: Lengths of learned beginnings of words.
STEMS = (4, 5, 6, 7, 8, 9)
WINDOW = 5
FEATURES = ("abuse", "quoted", "abuse_misspelt", "quoted_misspelt", "addressed", "terms", "density")


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool = False
    weight: float = 3.0
    misspelt: float = 1.5

    @property
    def edits(self) -> int:
        """Edits that a misspelling may have: none in terms under four letters and in beginnings of words, whose neighbours
        are other words."""
        n = len(self.text)
        return 0 if n < 4 or self.stem else 1 if n < 9 else 2


@dataclass
class Automaton:
    """Terms of a trie within their edits, as a deterministic automaton made on the way. A place of it is (node of the
    trie, letter that a swap still owes, edits so far)."""

    terms: list[Term]
    ordinary: frozenset[str] = frozenset()
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])
    slack: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for t, term in enumerate(self.terms):
            at = 0
            self.slack[0] = max(self.slack[0], term.edits)
            for c in term.text:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.slack.append(0)
                at = self.children[at][c]
                self.slack[at] = max(self.slack[at], term.edits)
            self.ends[at].append(t)
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.final: list[tuple[int, int] | None] = [None]
        self.begun: list[tuple[int, int] | None] = [None]
        self.start = self._state({(0, "", 0)})

    def _state(self, places: set[tuple[int, str, int]]) -> int:
        todo = [p for p in places if not p[1]]
        while todo:
            node, _, e = todo.pop()
            for nxt in self.children[node].values():
                if e < self.slack[nxt] and (nxt, "", e + 1) not in places:
                    places.add((nxt, "", e + 1))
                    todo.append((nxt, "", e + 1))
        least: dict[tuple[int, str], int] = {}
        for node, owed, e in places:
            least[node, owed] = min(e, least.get((node, owed), e))
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            hits = sorted((e, t) for (node, owed), e in key if not owed for t in self.ends[node] if e <= self.terms[t].edits)
            whole, stems = ([h for h in hits if self.terms[h[1]].stem == kind] for kind in (False, True))
            self.final.append(whole[0][::-1] if whole else None)
            self.begun.append(stems[0][::-1] if stems else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        places: set[tuple[int, str, int]] = set()
        for (node, owed), e in self.sets[state]:
            if owed:
                if owed == c:
                    places.add((node, "", e))
                continue
            nxt = self.children[node].get(c)
            if nxt is not None:
                places.add((nxt, "", e))
            if e < self.slack[node]:
                places.add((node, "", e + 1))
                for letter, other in self.children[node].items():
                    if e < self.slack[other]:
                        places.add((other, "", e + 1))
                        swapped = self.children[other].get(c)
                        if swapped is not None and letter != c and e < self.slack[swapped]:
                            places.add((swapped, letter, e + 1))
        to = self._state(places) if places else 0
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the entry that the word is, misspells or begins with and goes on; the fewest edits first. An
        ordinary word misspells nothing."""
        state, begun = self.start, None
        for c in word:
            found = self.begun[state]
            if found is not None and (begun is None or found[1] < begun[1]):
                begun = found
            to = self.steps[state].get(c)
            if to is None:
                to = self._step(state, c)
            if to == 0:
                return begun
            state = to
        found = self.final[state]
        if found is not None and found[1] and word in self.ordinary:
            found = None
        return found if found is not None and (begun is None or found[1] < begun[1]) else begun


def features(text: str, automaton: Automaton, known: dict[str, tuple[int, int] | None]) -> list[float]:
    """FEATURES of a text (logarithms): weights of its hits by kind, hits near a word of address, distinct terms, weight
    that is not quoted in a thousand words."""
    low = text.lower()
    out = [0.0] * len(FEATURES)
    hit = False
    for w in set(WORD.findall(low)):
        if w not in known:
            if len(known) > 1 << 18:
                known.clear()
            known[w] = automaton.match(w)
        hit = hit or known[w] is not None
    if not hit:
        return out
    spans = [(m.group(), m.start()) for m in WORD.finditer(low)]
    marks = [m.start() for m in QUOTES.finditer(low)]
    terms = set()
    before = 0
    for i, (w, at) in enumerate(spans):
        found = known[w] if w in known else automaton.match(w)
        if found is None:
            continue
        term, edits = found
        while before < len(marks) and marks[before] < at:
            before += 1
        near = {x for x, _ in spans[max(0, i - WINDOW) : i + WINDOW + 1]}
        told = {x for x, _ in spans[max(0, i - WINDOW) : i]}
        quoted = bool(before % 2 and before < len(marks)) or bool(told & REPORTS)
        out[(2 if edits else 0) + quoted] += automaton.terms[term].misspelt if edits else automaton.terms[term].weight
        out[4] += bool(near & ADDRESS)
        terms.add(term)
    out[5], out[6] = len(terms), 1000 * (out[0] + out[2]) / len(spans)
    return [math.log1p(x) for x in out]


def _features_udf(sent):
    @F.pandas_udf("array<double>")
    def of(text: pd.Series) -> pd.Series:
        automaton, known = _automaton(sent), {}
        return pd.Series([features(t or "", automaton, known) for t in text])

    return of


def learn_terms(sample: DataFrame) -> list[Term]:
    """Words, and beginnings of longer words, over-represented in the toxic rows of ``sample`` (text, y): their
    log-likelihood ratio against the sample's share must exceed what the best of all candidates would have by chance."""
    total = sample.agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c")).first()
    toxic, clean = total["t"], total["c"]
    if not toxic or not clean:
        return []
    share = toxic / (toxic + clean)
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    whole = F.concat(F.col("w"), F.lit("$"))
    begins = [F.when(F.length("w") > n, F.substr("w", F.lit(1), F.lit(n))) for n in STEMS]
    each = sample.select("doc_id", "y", F.explode(words).alias("w")).select("doc_id", "y", F.explode(F.array(whole, *begins)).alias("stem"))
    counts = each.filter("stem is not null and length(stem) > 3").distinct().groupBy("stem").agg(F.sum("y").alias("t"), (F.count("*") - F.sum("y")).alias("c"))
    t, c = F.col("t"), F.col("c")
    n = t + c
    ratio = t * F.log(t / (n * share)) + F.when(c > 0, c * F.log(c / (n * (1 - share)))).otherwise(0.0)
    passed = counts.filter((t >= 4) & (t / n > share)).withColumn("ratio", ratio).filter(F.col("ratio") > 18).orderBy(F.desc("ratio"), "stem")
    chosen: list[Term] = []
    begins_: set[str] = set()  # beginnings of chosen entries, themselves included
    stems: set[str] = set()
    for r in passed.select("stem").collect():
        own, whole = r["stem"].rstrip("$"), r["stem"].endswith("$")
        if whole:  # beside a beginning of it, too: only whole words have misspellings
            chosen.append(Term(own))
        elif own not in begins_ and not any(own[:i] in stems for i in range(1, len(own))):
            chosen.append(Term(own, stem=True))
            stems.add(own)
        else:
            continue
        begins_.update(own[:i] for i in range(1, len(own) + 1))
    return chosen


def _hits_udf(sent):
    """Hits of a text: "term:0", and for misspellings "term:1" and "=form"."""

    @F.pandas_udf("array<string>")
    def of(text: pd.Series) -> pd.Series:
        automaton = _automaton(sent)
        out = []
        for t in text:
            hits = set()
            for w in set(WORD.findall((t or "").lower())):
                found = automaton.match(w)
                if found is not None:
                    hits |= {f"{found[0]}:1", f"={w}"} if found[1] else {f"{found[0]}:0"}
            out.append(sorted(hits))
        return pd.Series(out)

    return of


def _met(terms: list[Term], ordinary: frozenset[str], sample: DataFrame) -> dict[str, tuple[int, int]]:
    """Toxic rows and all rows of ``sample`` with each hit."""
    sent = sample.sparkSession.sparkContext.broadcast(Lexicon(terms, ordinary))
    met = sample.select("y", F.explode(_hits_udf(sent)("text")).alias("hit")).groupBy("hit").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    return {r["hit"]: (r["t"], r["n"]) for r in met.collect()}


def ordinary_words(terms: list[Term], sample: DataFrame) -> frozenset[str]:
    """Words near a term that clean rows of ``sample`` (text, y) have, and toxic ones no more often than chance allows (two
    standard deviations above their share of all rows)."""
    total = sample.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    share = (total["t"] or 0) / max(total["n"], 1)
    return frozenset(hit[1:] for hit, (t, n) in _met(terms, frozenset(), sample).items() if hit.startswith("=") and t < n and t <= share * n + 2 * math.sqrt(n * share * (1 - share)))


def weigh_terms(terms: list[Term], sample: DataFrame, ordinary: frozenset[str] = frozenset()) -> list[Term]:
    """The terms with the log-odds that a text of ``sample`` (text, y) with one of them, or with a misspelling of it, is
    toxic; 0.05 at least, so a form that is an ordinary word says next to nothing. Terms not met keep theirs."""
    total = sample.agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c")).first()
    met = _met(terms, ordinary, sample)
    odds = {hit: max(0.05, math.log((t + 0.5) / (total["t"] + 1)) - math.log((n - t + 0.5) / (total["c"] + 1))) for hit, (t, n) in met.items()}
    return [replace(t, weight=odds.get(f"{i}:0", t.weight), misspelt=odds.get(f"{i}:1", t.misspelt)) for i, t in enumerate(terms)]


@dataclass
class Lexicon:
    terms: list[Term]
    ordinary: frozenset[str]


@dataclass
class Model:
    terms: list[Term]
    weights: np.ndarray
    bias: float
    ordinary: frozenset[str] = frozenset()

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Penalized logistic regression by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon and weights from the labelled documents, ``fit_rows`` of each class at most. Without both classes the
    lexicon is the list of insults with set weights. Null labels teach nothing; an id labelled twice counts
    once, its greatest label."""
    spark = docs.sparkSession
    base = [Term(w, misspelt=1.5 if len(w) > 4 else 0.75) for w in INSULTS]
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = marked.agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c")).first()
    if not total["t"] or not total["c"]:
        return Model(base, np.array([2.0, 0.5, 1.0, 0.2, 0.5, 0.5, 0.0]), -3.0)
    part = [marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for y in (0, 1)]
    wanted = part[0].union(part[1])
    # at most twice fit_rows ids
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "y").persist()
    try:
        terms = learn_terms(sample)
        terms += [t for t in base if t.text not in {x.text for x in terms if not x.stem}]
        ordinary = ordinary_words(terms, sample)
        terms = weigh_terms(terms, sample, ordinary)
        sent = spark.sparkContext.broadcast(Lexicon(terms, ordinary))
        rows = sample.select("doc_id", "y", _features_udf(sent)("text").alias("x")).orderBy("doc_id").toPandas()
    finally:
        sample.unpersist()
    if not 0 < rows["y"].sum() < len(rows):
        return Model(terms, np.array([2.0, 0.5, 1.0, 0.2, 0.5, 0.5, 0.0]), -3.0, ordinary)
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float)
    weights, bias = _logistic(x, y)
    bias += math.log(total["t"] / total["c"]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(terms, weights, bias, ordinary)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``, by its whole text; null and empty texts are scored as texts
    without a hit. Repeated rows, and those of null or equal ids, are scored each; an empty table gives an empty table."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        automaton, known = _automaton(sent), {}
        x = np.array([features(t or "", automaton, known) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(sent.value.probability(x))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


_made: list = [None, None]


def _automaton(sent) -> Automaton:
    """The automaton of a broadcast model or lexicon, made once for as long as a worker is asked for the same; the value is
    held beside it, so that no other can be taken for it."""
    if _made[0] is not sent.value:
        _made[:] = sent.value, Automaton(sent.value.terms, sent.value.ordinary)
    return _made[1]
