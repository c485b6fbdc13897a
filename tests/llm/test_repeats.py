import hashlib
import random

from ledgerlight.llm import repeats
from ledgerlight.llm.runindex import RunIndex


def brute(rows, length):
    """(n_bytes, n_removed, n_spans, digest) of (order key, text) rows, by a table of all strings."""
    seen, out = {}, {}
    for key, t in sorted(set(rows)):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen[w] = 1
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[key] = (len(t), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest())
    return out


def made(rnd, n, alphabet, longest=60):
    pieces = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, longest))) for _ in range(8)]
    return [(i, None if rnd.random() < 0.03 else "".join(rnd.choice(pieces) for _ in range(rnd.choice([0, 1, 4, 9])))) for i in range(n)]


def test_run_index_groups_equal_strings():
    rnd = random.Random(5)
    for depth, alphabet in ((4, b"ab"), (20, b"abc"), (30, b"\0\xffz")):
        for _ in range(20):
            texts = [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(6)]
            got = {}
            for g, k, p in zip(*RunIndex(texts, depth).stream()):
                got.setdefault(int(g), set()).add((int(k), int(p)))
            want = {}
            for k, t in enumerate(texts):
                for p in range(len(t) - depth + 1):
                    want.setdefault(t[p : p + depth], set()).add((k, p))
            assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, at string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(df, **how).collect()}
    assert got == brute([(i, (t or "").encode()) for i, t in rows], how.get("length", 100))


def test_matches_a_table_of_all_strings(spark):
    rnd = random.Random(1)
    check(spark, made(rnd, 60, "abcé "), length=20, gram=8, shard=500)
    check(spark, made(rnd, 60, "ab"), length=20, gram=8, shard=500, most=3)  # the way for crowded anchors
    check(spark, made(rnd, 40, "abcdefgh "))


def test_odd_rows(spark):
    long = "lorem ipsum " * 30
    df = spark.createDataFrame([(1, long), (1, long), (2, ""), (3, None), (None, long), (4, "a" * 500), (5, "a" * 150)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r for r in repeats.digests(df).collect()}
    assert got[None, 360].n_removed == 348  # its own period
    assert got[1, 360].n_removed == 360 and got[1, 360].n_spans == 1
    assert got[2, 0].n_removed == got[3, 0].n_removed == 0
    assert got[4, 500].n_removed == 499 and got[5, 150].n_removed == 150
    assert repeats.digests(df).count() == 7
    assert repeats.digests(df.limit(0)).count() == 0


def test_removed_keeps_columns(spark):
    t = "".join(chr(97 + i * 7 % 23) for i in range(300)) + "é" * 3
    df = spark.createDataFrame([(1, t, 5, "q"), (2, "z" + t, 6, None), (3, None, None, "r")], "doc_id long, text string, size int, _x string")
    got = {r.doc_id: r for r in repeats.removed(df).collect()}
    assert got[2].text == "z" and got[2].size == 6 and got[3].text is None and got[3]._x == "r"
    assert repeats.removed(df).columns == df.columns


def test_rows_without_ids_and_repeated_ids(spark):
    rnd = random.Random(7)
    pieces = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(30, 260))) for _ in range(40)]
    rows = [(rnd.choice([None, None, 5, k]), "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 2))) + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 150)))) for k in range(400)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _repeat_id int, _repeats int").repartition(3)
    hashed = {r.t: r.h for r in df.selectExpr("text AS t", "xxhash64(text) AS h").collect()}
    want = brute([((i if i is not None else -(1 << 63), hashed[t]), t.encode()) for i, t in rows], 100)
    got = {(r.doc_id if r.doc_id is not None else -(1 << 63), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(df).collect()}
    assert got == {(k[0], *v) for k, v in want.items()} and sum(v[1] for v in want.values()) > 0
    assert repeats.digests(df).count() == 400 and repeats.removed(df).columns == df.columns


def test_a_text_without_repeats_is_left_alone(spark):
    rnd = random.Random(8)
    rows = [(None, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rnd.randint(300, 900)))) for _ in range(500)]
    got = repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 500 and all(r.n_removed == 0 for r in got)


def test_crowded_anchors(spark, monkeypatch):
    rnd = random.Random(9)
    line = "".join(rnd.choice("abcdefghij") for _ in range(130))
    rows = [(i, "".join(rnd.choice("klmnop") for _ in range(90)) + line + "".join(rnd.choice("qrstuv") for _ in range(90))) for i in range(200)]
    check(spark, rows)
    monkeypatch.setattr(repeats, "COUNTERS", 50)
    monkeypatch.setattr(repeats, "HOT", 30)
    check(spark, rows, most=10)
    found = repeats.crowded(spark.createDataFrame([(i, 0, t) for i, t in rows], "id long, tie long, text string"), 100, 32, 10)
    assert 0 < len(found) <= 50


def test_copies_at_a_texts_beginning_in_different_tasks(spark):
    """Surroundings that a text's beginning cuts short: what is marked ends where they end."""
    rnd = random.Random(10)
    word = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    shared = [word(rnd.randint(100, 170), "abcdefghij") for _ in range(30)]
    rows = [(i, shared[i % 30] + word(120, "klmnopqrst")) for i in range(90)]
    check(spark, rows)
