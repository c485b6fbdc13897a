import random

import pytest

from ledgerlight.llm import minhash
from ledgerlight.llm.shingles import shingle_sets


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            k = len(sets[i] & sets[j])
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus(seed, families=12, copies=10, edits=12, length=90):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(length)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, edits) if rnd.random() < 0.7 else rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w).replace(" ", rnd.choice([" ", "\n", "  "])))
    texts += ["", " \t", "one two", "ONE Two", "one two three four five six", "x " * 4000, "x " * 9]
    rnd.shuffle(texts)
    return list(enumerate(texts, 1))


def test_shingles_match_plain_sets():
    rows = corpus(2, families=2)
    for (_, t), s in zip(rows, shingle_sets([t.encode() for _, t in rows])):
        assert len(s) == len(sets_of([(0, t)])[0])


@pytest.mark.parametrize("block,small", [(256, 32), (16, 4)])
def test_components_match_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "FIRST", 2)
    monkeypatch.setattr(minhash, "NEXT", 2)
    rows = corpus(4, families=3, copies=50) if block < 256 else corpus(5)
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, rep long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.classes(df).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(3, t), (3, t), (2, None), (4, t.upper()), (None, t), (5, "")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in minhash.classes(df).collect())))
    assert got == sorted(map(str, [(3, 6, 3, True), (3, 6, 3, True), (4, 6, 3, False), (2, 0, 2, True), (5, 0, 5, True), (None, 6, None, True)]))
    assert minhash.classes(df.limit(0)).count() == 0


def test_ids_that_stand_for_several_texts(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    a, b, c, d = ([word() for _ in range(60)] for _ in range(4))
    near = lambda w: " ".join([*w[:-1], word()])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (3, near(a)), (4, " ".join(c)), (5, near(c)), (5, " ".join(d)), (9, near(d)), (8, " ".join(b)), (7, " ".join([word() for _ in range(60)]))]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (8, 1, False), (4, 4, True), (5, 4, False), (9, 4, False), (7, 7, True)}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _kept_id int, _kept_n int")
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 7]
