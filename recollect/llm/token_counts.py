"""Token counts: greedy longest-match word pieces by an automaton that builds no pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import Memo, small_batches, utf8_words


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that open a word and pieces that go on with one; byte and control pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [
        sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    ]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if "▁" not in p]


class Automaton:
    """Trie of a vocabulary with failure links and counts of the tokens popped along them.

    State 0 is the start of a word, state 1 follows a piece. When no child fits, the failure
    link leads to the state of what is left after the longest match's pieces, whose number is
    pops[state]; each character is read once.
    """

    def __init__(self, opening: Iterable[str], inner: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends: set[int] = set()
        for root, pieces in ((0, opening), (1, inner)):
            for piece in pieces:
                at = root
                for c in piece:
                    at = self.next[at].setdefault(c, len(self.next))
                    if at == len(self.next):
                        self.next.append({})
                ends.add(at)
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = [0, 1]
        for state in queue:
            for c, child in self.next[state].items():
                queue.append(child)
                if child in ends:  # all of it is a piece
                    self.fail[child], self.pops[child] = 1, 1
                    continue
                z, pops = self.fail[state], self.pops[state]
                while z >= 0 and c not in self.next[z]:
                    pops += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[child], self.pops[child] = self.next[z][c], pops

    def count(self, word: str) -> int:
        """Number of pieces of a word; 0 if it can't be cut into pieces."""
        state, pieces = 0, 0
        step, fail, pops = self.next, self.fail, self.pops
        for c in word:
            while c not in step[state]:
                pieces += pops[state]
                state = fail[state]
                if state < 0:
                    return 0
            state = step[state][c]
        while state > 1:
            pieces += pops[state]
            state = fail[state]
            if state < 0:
                return 0
        return pieces


class Counts(Memo):
    """word -> pieces, 0 for one that is unknown."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def make(self, word: bytes) -> int:
        return self.automaton.count(word.decode("utf-8", "replace"))


@lru_cache(maxsize=2)
def shared_counts(vocabulary: str) -> Counts:
    """One automaton and table a worker process, which go on from task to task."""
    return Counts(Automaton(*sentencepiece_vocabulary(vocabulary)))


def _count(batches: Iterator[pd.DataFrame], vocabulary: str) -> Iterator[pd.DataFrame]:
    counts = shared_counts(vocabulary)
    for batch in batches:
        rows = np.zeros((len(batch), 3), np.int64)
        for i, text in enumerate(batch["text"]):
            found = [counts[w] for w in utf8_words(text)]
            unknown = found.count(0)
            rows[i] = len(found), sum(found) + unknown, unknown
        out = pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])
        yield out.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy())[["doc_id", "n_words", "n_tokens", "n_unknown"]]


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every whole text.

    Words are runs between ASCII white space; each is cut greedily into the longest pieces of
    the vocabulary, the first from those that open a word, and counts as one unknown token if
    that fails. Null and empty texts have zeros; repeated rows are counted each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = partial(_count, vocabulary=vocabulary or default_vocabulary())
    return small_batches(rows).mapInPandas(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
