"""Periodic runs against brute force."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from ledgerlight.llm import periodic, registry


def plain(x):
    """Every period, every maximal stretch; smallest period of each interval."""
    found = {}
    for p in range(1, len(x)):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def words_of(rnd):
    x = []
    for _ in range(rnd.randint(0, 6)):
        some = [rnd.choice("abcdefgh"[: rnd.choice((2, 3, 8))]) for _ in range(rnd.randint(1, 7))]
        x += (some * 9)[: rnd.randint(0, len(some) * 9)]
    return x


def test_runs_are_those_of_brute_force():
    rnd = random.Random(1)
    for _ in range(600):
        x = [ord(c) for c in words_of(rnd)]
        assert periodic.runs_of(x) == plain(x)


def test_texts_with_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(words_of(rnd)), "x") for i in range(300)] + [(7, "a\tb " * 5, "x"), (7, "a\tb " * 5, "x"), (None, None, None), (8, "", "x"), (9, " \n ", "x"), (10, "\xa0 " * 6, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.found(df).collect()))
    want = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        runs = plain(w)
        drop = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((str(i), len(w), runs, b" ".join(x for k, x in enumerate(w) if k not in drop).decode()))
    assert got == sorted(want)
    assert periodic.found(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = " ".join(["one two three"] * 60_000 + [f"w{i}" for i in range(50_000)] + ["z"] * 100_000)
    (got,) = periodic.found(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got.runs] == [(0, 180_000, 3), (230_000, 100_000, 1)] and len(got.collapsed.split()) == 3 + 50_000 + 1


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_contract(spark):
    sha = lambda s: hashlib.sha256(s).hexdigest()
    got = {r.doc_id: r for r in registry.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 5
    for d in docs:
        w, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue  # brute force is quadratic
        runs = fast(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        drop = {k for s, m, p in runs for k in range(s + p, s + m)}
        r = got[d.doc_id]
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.collapsed_sha256 == sha(b" ".join(x for k, x in enumerate(w) if k not in drop))


def fast(words):
    """The same brute force, period by period with arrays."""
    x, found = np.unique(np.array([w.decode() for w in words]), return_inverse=True)[1] if words else np.zeros(0, int), {}
    for p in range(1, len(x) // 4 + 1):
        same = np.diff(np.concatenate(([0], (x[p:] == x[:-p]).astype(int), [0])))
        for s, e in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            if e + p - s >= max(6, 4 * p):
                found.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())
