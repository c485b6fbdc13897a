"""Word shingles and MinHash signatures of whole texts, computed for many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
U = np.uint64
#: Odd multipliers: of a byte's place in its word, and of a word's place in its shingle.
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=U)
_white = np.zeros(256, bool)
_white[[0x20, 9, 10, 11, 12, 13]] = True
_lower = np.arange(256, dtype=U)
_lower[65:91] += U(32)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, f in enumerate((BASE, INVERSE)):
            p = np.full(n, f, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and the bounds of each text in them."""
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    white = _white[raw]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(_lower[raw] * up, out=total[1:])
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(U))
    ends = np.cumsum([1 + len(t) for t in texts]) if texts else np.zeros(0, int)
    return h, np.concatenate(([0], np.searchsorted(start, ends)))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one for a text with fewer words, none without words."""
    h, at = word_hashes(texts)
    places = PLACES if words == len(PLACES) else mixed(np.arange(1, words + 1, dtype=U)) | U(1)
    n = max(0, len(h) - words + 1)
    v = np.zeros(n, U)
    for j in range(words):
        v += h[j : j + n] * places[j]
    v = mixed(v)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            s = np.sort(v[a : b - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mixed((h[a:b] * places[: b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U) * U(0x2545F4914F6CDD1D)) | U(1)


def signature(values: np.ndarray, mul: np.ndarray, step: int = 1024) -> np.ndarray:
    """Least hash of the set under each multiplier, 32 bits each."""
    best = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), step):
        np.minimum(best, ((values[at : at + step, None] * mul) >> U(32)).min(0).astype(np.uint32), out=best)
    return best
