"""The contract queries on the smallest tables: against their SQL, the public library, or brute force."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from oracle import compare

from ledgerlight.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", registry.ORACLES)
def test_sql(spark, name):
    compare(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def library(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.vocabulary_file(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_bpe_is_the_library(spark):
    tok, t = library("word_bpe_49k.json"), texts(spark)
    got = {r.doc_id: r for r in registry.op5_bpe(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(t)
    for i, text in t.items():
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def check_packing(got, t, tok):
    from collections import defaultdict

    pieces, rows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        rows[r.sequence_id].append(r)
    for i, text in t.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for seq in rows.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, sum(r.length for r in got))


def test_packing(spark):
    assert check_packing(registry.op7_packing(spark, SF).collect(), texts(spark), library("byte_bpe_50k.json")) < 0.01


def test_packing_odd_rows(spark):
    from ledgerlight.llm.packing import pack

    rows = [(1, None, 1), (2, "", 2), (3, "word " * 9000, 3), (4, "<|endoftext|> x", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    path = registry.vocabulary_file("byte_bpe_50k.json")
    assert check_packing(pack(df, path).collect(), {i: t or "" for i, t, _ in rows}, library("byte_bpe_50k.json")) == 0
    assert pack(df.limit(0), path).count() == 0
    twice = pack(df.unionByName(df), path).collect()
    assert sum(r.length for r in twice if r.doc_id == 1) == 2


def test_token_counts_are_greedy_pieces(spark):
    from ledgerlight.llm.wordpieces import Automaton, vocabulary

    first, later = vocabulary(registry.vocabulary_file("byte_bpe_50k.json"))

    def brute(word):
        n, at, pieces = 0, 0, first
        while at < len(word):
            longest = lambda pieces: next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
            size = longest(pieces) or longest(later)
            if not size:
                return 1
            n, at, pieces = n + 1, at + size, later
        return n

    known = {}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in registry.op9_token_counts(spark, SF).collect()}
    for i, t in texts(spark).items():
        words = t.encode().split()
        for w in words:
            if w not in known:
                known[w] = brute(w)
        assert got[i] == (len(words), sum(known[w] for w in words))
    a = Automaton({b"ab", b"a"}, {b"c", b"bcd"})
    assert [a.count(w) for w in (b"", b"ab", b"abc", b"abx", b"acc", b"ca", b"cc")] == [0, 1, 2, 1, 3, 1, 2]
    b = Automaton(first, later)
    for w in ("привет", "统计数据", "한국어", "ไทย", "émigré"):  # some begin with bytes that no piece of a word's start has
        assert b.count(w.encode()) == brute(w.encode()) > 1


def test_neighbours_recall(spark):
    got = {}
    for r in registry.op6_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(want & got[ids[q]]), total + len(want)
    assert hits / total >= 0.9
