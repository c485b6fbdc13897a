"""Context-tree weighting against a plain computation of block probabilities."""

import math
import os
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from ledgerlight.llm import ctw, registry


class Plain:
    """Weighted probability of everything seen, computed anew from the counts; that of a bit is a quotient of two such probabilities."""

    def __init__(self, texts, depth):
        self.depth, self.seen = depth, {}
        for t in texts:
            for context, byte in self.places(t):
                for node, bit in self.bits(byte):
                    for d in range(depth + 1):
                        self.seen.setdefault((node, context[depth - d :]), [0, 0])[bit] += 1
        self.below = {}
        for node, context in self.seen:
            if context:
                self.below.setdefault((node, context[1:]), []).append(context)

    def places(self, t):
        t = b"\0" * self.depth + t + b"\0"
        return [(t[i - self.depth : i], t[i]) for i in range(self.depth, len(t))]

    @staticmethod
    def bits(byte):
        return [((1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @cache
    def weight(self, node, context, path=None, bit=None):
        """Log weighted probability of the subtree; with ``path`` one more ``bit`` was seen along it."""
        on_path = path is not None and path.endswith(context)
        a, b = self.seen.get((node, context), (0, 0))
        own = self.kt(a + (on_path and bit == 0), b + (on_path and bit == 1))
        if len(context) == self.depth:
            return own
        children = set(self.below.get((node, context), ()))
        if on_path:
            children.add(path[len(path) - len(context) - 1 :])
        rest = sum(self.weight(node, c, path if path is not None and path.endswith(c) else None, bit if path is not None and path.endswith(c) else None) for c in children)
        top = max(own, rest)
        return top + math.log(math.exp(own - top) + math.exp(rest - top)) - math.log(2)

    def score(self, text):
        return sum(self.weight(node, b"", context, bit) - self.weight(node, b"") for context, byte in self.places(text) for node, bit in self.bits(byte)) / math.log(10)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    seen, ends = Counter(), 0
    words = lambda t: (t or "").encode().lower().split()
    for i, t in rows:
        if not held_out(i):
            seen.update(words(t))
            ends += 1
    n, v = sum(seen.values()) + ends, len(seen) + (ends > 0)
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    return n, {k: (len(words(t)) + 1, sum(seen[w] > 0 for w in words(t)) + (ends > 0), math.fsum(log(seen[w]) for w in words(t)) + log(ends)) for k, (i, t) in enumerate(rows)}


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_probabilities(spark, depth, monkeypatch):
    rnd = random.Random(depth)
    rows = [(i, "".join(rnd.choice("aab é") for _ in range(rnd.randint(0, 40)))) for i in range(40)] + [(None, None), (5, ""), (5, "aab"), (5, "aab"), (50, "\0\0A")]
    monkeypatch.setattr(ctw, "BLOCK", 1500)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, gram string")
    got = ctw.scores(df, depth).collect()
    plain = Plain([(t or "").encode() for i, t in rows if not held_out(i)], depth)
    n, tokens = base(rows)
    want = sorted(((str(i), *tokens[k][:2], held_out(i)), (tokens[k][2], plain.score((t or "").encode()))) for k, (i, t) in enumerate(rows))
    have = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.held_out), (r.base_score, r.score)) for r in got)
    assert [w[0] for w in want] == [h[0] for h in have] and {r.train_tokens for r in got} == {n}
    assert np.allclose([w[1] for w in want], [h[1] for h in have], rtol=1e-9)


def test_probabilities_sum_to_one(spark):
    texts = [b"abab", b"abba", b"b", b"ba"]
    seen = [(int(g), 1) for g in ctw.grams(texts, 2)[0]]
    every = [(ord("b") << 16 | ord("a") << 8 | c, 0) for c in range(256)]
    gram = spark.createDataFrame(seen + every, "gram long, n long").groupBy("gram").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    after_ba = ctw.model(gram, 2).where(f"shiftright(gram, 8) = {ord('b') << 8 | ord('a')}").collect()
    assert len(after_ba) == 256 and abs(sum(10**r.value for r in after_ba) - 1) < 1e-9


def test_no_rows_and_nothing_learned(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ctw.scores(df.limit(0)).count() == 0
    alone = next(i for i in range(100) if held_out(i))
    (r,) = ctw.scores(spark.createDataFrame([(alone, "ab c")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0) and abs(r.score - 5 * 8 * math.log10(0.5)) < 1e-9 and abs(r.bits_per_byte - 8) < 1e-9


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_contract(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in registry.op11_context_trees(spark, SF).collect()}
    n, tokens = base(rows)
    plain = Plain([(t or "").encode() for i, t in rows if not held_out(i)], ctw.DEPTH)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*tokens[k][:2], n, held_out(i)) and math.isclose(r.base_score, tokens[k][2], rel_tol=1e-12)
    for i, t in rows[:12]:
        assert math.isclose(got[i].score, plain.score((t or "").encode()), rel_tol=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(-r.score for r in held) / math.log10(2) < 4.5 * sum(r.n_bytes for r in held)  # random bytes cost 8 bits


def test_no_table_of_the_model_goes_through_the_driver(spark):
    docs = spark.createDataFrame([(k, f"ein Text {k} von {k % 3}") for k in range(20)], "doc_id long, text string")
    gram = ctw.asked(ctw.blocks(docs), 3).where("gram IS NOT NULL").groupBy("gram").agg({"n": "sum"}).toDF("gram", "n")
    for df in (ctw.model(gram, 3), ctw.scores(docs, depth=2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
