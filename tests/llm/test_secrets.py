"""Texts with very many secrets: the work grows with the text, and spans still agree with plain regular expressions."""

import random
import re
import time

from pyspark.sql import functions as F

from ledgerlight.llm import secrets


def test_many_matches(spark):
    rnd = random.Random(3)
    keys = ["%016x" % rnd.getrandbits(64) for _ in range(64_000)]
    df = spark.createDataFrame([(1, " ".join(keys))], "doc_id long, text string")
    began = time.time()
    assert secrets.scanned(df).select(F.size("_spans")).first()[0] == len(keys)
    assert secrets.redacted(df).first().text == " ".join(["[SECRET]"] * len(keys))
    assert time.time() - began < 60


def test_spans_in_mixed_text(spark):
    rnd = random.Random(4)
    pieces = ["password = Abc123Abc123Abc", "tökén", "AKIA" + "Z9" * 9, "deadbeef" * 3, "é" * 700, "q8Zk2LmX0vB7nR4tY1wP", "x", "\n", " ", "'secret': \"ab12cd34ef56ab12cd34\""]
    rows = [(i, "".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r._spans for r in secrets.scanned(df).collect()}
    hidden = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    for i, t in rows:
        base = []
        for kind, (pattern, ok) in enumerate(((secrets.ASSIGN, lambda m: len(m[2]) >= 12), (secrets.ACCESS, bool), (secrets.HEX, bool))):
            base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t) if ok(m)]
        got = [(s.start, s.kind, s.end) for s in found[i]]
        assert sorted(base) == [s for s in got if s[1] < 3] and got == sorted(got)
        assert not any(a[1] == 3 and any(b[0] <= a[0] and b[2] >= a[2] for b in base) for a in got)
        out, at = "", 0
        for lo, _, hi in got:
            if lo >= at:
                out += t[at:lo] + "[SECRET]"
            at = max(at, hi)
        assert hidden[i] == out + t[at:]
