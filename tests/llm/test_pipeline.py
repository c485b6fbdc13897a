"""Every stage of the pipeline against brute force on its own input, over a small table."""

import os
import re

import pytest
import test_contracts
import test_minhash
import test_repeats

import corpus_pipeline as cp
from ledgerlight.llm import quality, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(t):
    """Figures of one text by plain Python."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = {}
    for i in range(len(w) - 2):
        tri.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {i + j for v in tri.values() if len(v) > 1 for i in v for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return dict(
        n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(t.count(c) for c in "#*$%&|<>"), n_lines=len(lines), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(repeated),
        n_letters=sum(1 for c in t if c.isalpha() and ord(c) < 128 or ord(c) > 127),
    )


def judged(rows):
    """Ids that the quality rules keep, with the estimation on all rows."""
    figures = {i: plain(t) for i, t in rows}
    holds = lambda f, sql: eval(re.sub(r"(?<![<>=])=(?!=)", "==", sql).replace(" AND ", " and ").replace(" OR ", " or "), {}, f)  # noqa: E731, S307
    votes = {i: tuple(-1 if holds(f, bad) else 1 if holds(f, good) else 0 for good, bad in quality.RULES.values()) for i, f in figures.items()}
    share, acc = quality.estimate([(v, 1) for v in votes.values()])
    score = lambda v: quality.logit(share) + sum(x * quality.logit(a) for x, a in zip(v, acc))
    return {i for i, f in figures.items() if not holds(f, quality.BASE) and score(votes[i]) >= 0}


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near duplicates", "repeats", "secrets", "packing"]
    held = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            out.write.parquet(str(tmp_path / str(k)))
            out = spark.read.parquet(str(tmp_path / str(k)))
        held.append((docs, out))
        docs = out

    (a, b), before, after = held[0], texts(held[0][0]), texts(held[0][1])
    assert set(after) == judged(before.items()) and 0 < len(after) < len(before)
    assert all(after[i] == before[i] for i in after)

    before, after = texts(held[1][0]), texts(held[1][1])
    assert set(after) == {i for i, (_, _, kept) in test_minhash.brute(before.items()).items() if kept} and len(after) < len(before)

    before, after = texts(held[2][0]), texts(held[2][1])
    want = test_repeats.brute([(i, t.encode()) for i, t in before.items()], 100)
    assert set(after) == set(before)
    assert sum(len(before[i].encode()) - len(after[i].encode()) for i in before) >= sum(want[i][1] for i in before) > 0
    assert all(after[i] == before[i] for i in before if not want[i][1])

    before, after = texts(held[3][0]), texts(held[3][1])
    found = {r.doc_id: r._spans for r in secrets.scanned(held[3][0]).collect()}
    for i, t in before.items():
        runs, out = [], []
        for s in found[i]:
            if runs and s.start < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], s.end)
            else:
                runs.append([s.start, s.end])
        at = 0
        for lo, hi in runs:
            out += [t[at:lo], "[SECRET]"]
            at = hi
        assert after[i] == "".join([*out, t[at:]])
    assert any(before[i] != after[i] for i in before)
    assert {r.doc_id: r.n_chars for r in held[3][1].collect()} == {i: len(t) for i, t in after.items()}

    before = texts(held[4][0])
    assert test_contracts.check_packing(held[4][1].collect(), before, test_contracts.library("byte_bpe_50k.json")) < 0.01
    assert sorted({r.doc_id for r in held[4][1].collect()}) == sorted(before)
    assert cp.run(spark, SF).count() == held[4][1].count()


def test_empty_and_odd(spark, tmp_path):
    rows = [(1, None, "a", 0), (1, None, "a", 0), (None, "x y z", "b", 5), (2, "", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, n_chars long")
    left = {"quality rules": 0, "near duplicates": 3, "repeats": 4, "secrets": 4}
    for name, stage in cp.STAGES:
        got, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0
        if name in left:
            assert got.columns == none.columns == docs.columns and got.count() == left[name]
    pieces = got.collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pieces if r.start == 0) == [("1", 1), ("1", 1), ("2", 1), ("None", 4)] and sum(r.length for r in pieces) == 7
