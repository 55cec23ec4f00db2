"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a batch are put in a trie. The best score of a prefix depends on the prefix alone, so one
walk of the trie finds it once for all words that begin so, and each word's count is stored where it ends. Which pieces end
at a character is told by an automaton over the trie of the vocabulary (Aho and Corasick, 1975), whose state depends on the
prefix alone as well. The vocabulary is a public one, given by path; nothing is trained.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What stands for the space before a word, and the score of a byte that no piece covers.
SPACE, BYTE_SCORE = "▁", -20.0
#: Distinct pre-tokens whose counts a task keeps between batches.
KEPT = 1 << 18

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces of a vocabulary file with log-probabilities by Zipf's law over their rank in the file; special
    and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(ranks))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ranks)}


class Pieces:
    """The vocabulary as an automaton: ``ends[state]`` has (length, score) of every piece that ends there."""

    def __init__(self, pieces: dict[str, float]):
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[tuple] = [()]
        for piece, score in pieces.items():
            at = 0
            for c in piece:
                to = self.steps[at].get(c)
                if to is None:
                    to = self.steps[at][c] = len(self.steps)
                    self.steps.append({})
                    self.ends.append(())
                at = to
            if at:
                self.ends[at] = ((len(piece), score),)
        self.back = [0] * len(self.steps)
        level = list(self.steps[0].values())
        while level:
            below = []
            for at in level:
                for c, to in self.steps[at].items():
                    self.back[to] = self.after(self.back[at], c)
                    self.ends[to] += self.ends[self.back[to]]
                    below.append(to)
            level = below

    def after(self, state: int, c: str) -> int:
        """The state after one more character: the longest end of the text that begins a piece."""
        while c not in self.steps[state]:
            if not state:
                return 0
            state = self.back[state]
        return self.steps[state][c]


def count_tokens(words: list[str], pieces: Pieces) -> dict[str, int]:
    """Number of tokens in the best segmentation of each word (with the space before it).

    Words go in sorted order, which is a walk of their trie: the stack holds (best score, tokens, state) of each prefix of
    the word before, and what the two words share is not computed again. A character that no piece covers costs
    its UTF-8 bytes, a token each. Equal scores take fewer tokens.
    """
    out: dict[str, int] = {}
    stack: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    before = ""
    after, ends = pieces.after, pieces.ends
    for word in sorted(words):
        text = SPACE + word
        shared, most = 0, min(len(text), len(before))
        while shared < most and text[shared] == before[shared]:
            shared += 1
        del stack[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            c = text[end - 1]
            n = 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
            score, tokens, state = stack[-1]
            best, best_tokens = score + BYTE_SCORE * n, tokens + n
            state = after(state, c)
            for length, own in ends[state]:
                score, tokens, _ = stack[end - length]
                score += own
                if score > best or (score == best and tokens < best_tokens):
                    best, best_tokens = score, tokens + 1
            stack.append((best, best_tokens, state))
        out[word] = stack[-1][1]
        before = text
    return out


_made: list = [None, None]


def _pieces(sent) -> Pieces:
    """The automaton of a broadcast vocabulary, made once for as long as a worker is asked for the same; the value is held
    beside it, so that no other can be taken for it."""
    if _made[0] is not sent.value:
        _made[:] = sent.value, Pieces(sent.value)
    return _made[1]


def _counted(sent):
    def run(batches):
        pieces = _pieces(sent)
        known: dict[str, int] = {}
        for b in batches:
            n, tokens = [], []
            for lo in range(0, b.num_rows, 512):
                words = [(t or "").split() for t in b.column(1)[lo : lo + 512].to_pylist()]
                fresh = {w for own in words for w in own}.difference(known)
                if len(known) + len(fresh) > KEPT:
                    known = {}
                    fresh = {w for own in words for w in own}
                known.update(count_tokens(list(fresh), pieces))
                n += [len(own) for own in words]
                tokens += [sum(map(known.__getitem__, own)) for own in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())], schema=_COUNTS)

    return run


def token_counts(docs: DataFrame, vocabulary: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens)`` for every row of ``docs``, by its whole text.

    Pre-tokens are runs without white space. Null and empty texts have none; repeated rows, and those of null or equal ids, are counted each; an
    empty table gives an empty table. The vocabulary (some MB) is one of a fixed size, sent to each executor.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted(sent), "doc_id bigint, n_pretokens bigint, n_tokens bigint")
