"""Token counts by a linear longest-match automaton.

The vocabulary trie gets failure links and, for each node, the number of pieces that are
popped when the link is taken. One pass over a word then gives the number of greedy
longest-match word pieces, without building a piece or stepping back.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import CACHE, byte_alphabet
from .common import as_batch, keyed, small_batches


class Automaton:
    """Greedy longest-match counts. ``first``: pieces that start a word; ``later``: pieces that follow, or start it where no first piece fits."""

    def __init__(self, first: set[bytes], later: set[bytes]):
        self.step: list[dict[int, int]] = [{}, {}]  # 0: start of a word, 1: within a word
        self.fail: list[int] = [1, -1]  # -1: no match from here
        self.pops: list[int] = [0, 0]
        whole: list[bool] = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for p in pieces:
                u = root
                for c in p:
                    v = self.step[u].get(c)
                    if v is None:
                        v = self.step[u][c] = len(self.step)
                        for x, y in ((self.step, {}), (self.fail, -1), (self.pops, 0), (whole, False)):
                            x.append(y)
                    u = v
                whole[u] = u > 1
        todo = [(r, c, v) for r in (0, 1) for c, v in self.step[r].items()]
        for u, c, v in todo:  # breadth first: parents are done before their children
            if whole[v]:
                self.fail[v], self.pops[v] = 1, 1
            else:
                z, n = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.step[z]:
                    n, z = n + self.pops[z], self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.step[z][c], n
            todo += [(v, d, w) for d, w in self.step[v].items()]

    def count(self, word: bytes) -> int:
        """Pieces of a word; a word that cannot be covered counts as one unknown piece, an empty one as none."""
        u = n = 0
        step, fail, pops = self.step, self.fail, self.pops
        for c in word:
            while c not in step[u]:
                if fail[u] < 0:
                    return 1
                n, u = n + pops[u], fail[u]
            u = step[u][c]
        while u > 1:
            if fail[u] < 0:
                return 1
            n, u = n + pops[u], fail[u]
        return n


def vocabulary(path: str, mark: str = "Ġ") -> tuple[set[bytes], set[bytes]]:
    """First and later pieces of a byte-level vocabulary file, where ``mark`` starts the pieces that begin a word."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = {c: i for i, c in enumerate(byte_alphabet())}
    raw = lambda t: bytes(byte[c] for c in t)
    return {raw(t[1:]) for t in vocab if t.startswith(mark) and len(t) > 1}, {raw(t) for t in vocab if mark not in t}


class Counts(dict):
    """word -> number of pieces, emptied when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


_made: dict[tuple[str, str], Automaton] = {}
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, path: str, mark: str = "Ġ") -> DataFrame:
    """Words ``[^\\x20\\x09-\\x0D]+`` and greedy word pieces of every whole text.

    A null or empty text has 0 and 0. Repeated rows and null ids give one row each; other
    columns are ignored; an empty table gives no rows. Where no piece that begins a word
    fits, the word begins with another; one that the vocabulary cannot cover counts as one
    piece.
    """

    def run(batches):
        if (path, mark) not in _made:
            _made[path, mark] = Automaton(*vocabulary(path, mark))
        known = Counts(_made[path, mark])
        for b in small_batches(batches):
            words = [(t or "").encode().split() for t in b.column(1).to_pylist()]
            yield as_batch(COUNTS, b.column(0), [len(w) for w in words], [sum(map(known.__getitem__, w)) for w in words])

    return keyed(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
