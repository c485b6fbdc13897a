"""Periodic runs of words by Main and Lorentz's divide and conquer.

The words of a text are interned. A text falls apart at words that can lie in no run (in a
run of four periods every word stands four times); what is left is halved again and again.
At each midpoint two Z-functions give, for every period, how far the repetition reaches to
both sides, and so all repetitions that cross the midpoint. What reaches beyond a half is
found whole at a higher midpoint. Equal intervals keep their smallest period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_batch, keyed, small_batches

#: A run has this many periods and this many words at least.
PERIODS, WORDS = 4, 6
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of ``s`` and what starts there; 0 for the first."""
    n = len(s)
    out, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        left, right = i, i + k
    return out


def crossing(x: list[int], lo: int, mid: int, hi: int):
    """(start, end, period) of the repetitions within ``x[lo:hi]`` that cross ``mid`` and are long enough."""
    u, v = x[lo:mid], x[mid:hi]
    a, b = len(u), len(v)
    ahead = np.array(z_function([*v, -1, *u, *v]))  # common prefixes of v with ...
    back = np.array(z_function([*u[::-1], -1, *v[::-1], *u[::-1]]))  # common suffixes of u with ...
    p = np.arange(1, min(a, (hi - lo) // PERIODS) + 1)  # the period that ends at the midpoint
    kinds = [(p, mid - p - np.where(p < a, back[np.minimum(p, a - 1)], 0), mid + ahead[b + 1 + a - p])]
    p = np.arange(1, min(b, (hi - lo) // PERIODS) + 1)  # the period that starts there
    kinds.append((p, mid - back[a + 1 + b - p], mid + p + np.where(p < b, ahead[np.minimum(p, b - 1)], 0)))
    for p, start, end in kinds:
        for j in np.flatnonzero(end - start >= np.maximum(WORDS, PERIODS * p)).tolist():
            yield int(start[j]), int(end[j]), int(p[j])


def runs_of(x: list[int]) -> list[tuple[int, int, int]]:
    """All runs of a stretch of word ids as (start, length, period), by start, then period."""
    least: dict[tuple[int, int], int] = {}
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < WORDS:
            continue
        mid = (lo + hi) // 2
        for start, end, p in crossing(x, lo, mid, hi):
            beyond = start == lo > 0 and x[start - 1] == x[start - 1 + p] or end == hi < len(x) and x[end] == x[end - p]
            if not beyond and p < least.get((start, end), p + 1):
                least[start, end] = p
        todo += [(lo, mid), (mid, hi)]
    return sorted((s, e - s, p) for (s, e), p in least.items())


def stretches(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches that can hold runs: no shorter than a run, and each of their words stands often enough in them.

    ``ids``: interned words of many texts, no id in two of them; ``ends``: where each text ends.
    """
    inside = np.ones(len(ids), bool)
    part, key = np.searchsorted(ends, np.arange(len(ids)), side="right"), ids
    while True:
        often = np.bincount(key)[key] >= PERIODS if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(inside)[often]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(part[at]) != 0)
        name = np.cumsum(new) - 1
        keep = np.bincount(name)[name] >= WORDS if len(at) else np.zeros(0, bool)
        at, name = at[keep], name[keep]
        if len(at) == len(key):
            break
        inside[:] = False
        inside[at] = True
        part[at] = name
        key = np.unique(name * (int(ids.max(initial=0)) + 1) + ids[at], return_inverse=True)[1]
    first = np.flatnonzero(np.diff(name, prepend=-1))
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(first, [*first[1:], len(at)])]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that come after the first period of a run."""
    if runs:
        keep = np.ones(len(words), bool)
        for s, n, p in runs:
            keep[s + p : s + n] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words ``[^\\x20\\x09-\\x0D]+``, runs and collapsed text of every whole text.

    A run is a maximal stretch of words with smallest period p, at least 4 p and 6 words
    long. A null or empty text has no words, no runs and an empty collapsed text. Repeated
    rows and null ids give one row each; other columns are ignored, whatever their names;
    an empty table gives no rows. Runs of equal intervals are one run, of the smallest
    period; runs may overlap and are ordered by start, then period. A text of any length is
    worked on whole, in time that grows with n log n; memory holds some 8 MB of texts at a time.
    """

    def run(batches):
        for b in small_batches(batches):
            texts = [(t or "").encode().split() for t in b.column(1).to_pylist()]
            ids, ends, known = [], [], 0
            for words in texts:
                own: dict[bytes, int] = {}
                ids.append(np.array([own.setdefault(w, known + len(own)) for w in words], np.int64))
                known += len(own)
                ends.append(len(words))
            ids, ends = np.concatenate([np.zeros(0, np.int64), *ids]), np.cumsum(ends)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for lo, hi in stretches(ids, ends):
                doc = int(np.searchsorted(ends, lo, side="right"))
                at = lo - (int(ends[doc - 1]) if doc else 0)
                runs[doc] += [(at + s, n, p) for s, n, p in runs_of(ids[lo:hi].tolist())]
            as_rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield as_batch(FOUND, b.column(0), list(map(len, texts)), as_rows, [collapsed(w, r).decode() for w, r in zip(texts, runs)])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
