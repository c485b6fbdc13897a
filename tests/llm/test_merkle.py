"""Merkle proofs against a plain computation."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerlight.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root, and for each leaf the (left, right) siblings of each level."""
    paths, level, above = [[] for _ in leaves], leaves, [[i] for i in range(len(leaves))]
    while len(level) > 1:
        ups, groups = [], []
        for at in range(0, len(level), 16):
            run = level[at : at + 16]
            for j, members in enumerate(above[at : at + 16]):
                for m in members:
                    paths[m].append(("".join(run[:j]), "".join(run[j + 1 :])))
            ups.append(sha(*run))
            groups.append(sum(above[at : at + 16], []))
        level, above = ups, groups
    return level[0], paths


def test_proofs_of_odd_rows(spark):
    sizes = {None: 3, "": 1, "a": 1, "b": 16, "c": 17, "d": 257, "é": 300, **{f"s{i}": 2 for i in range(14)}}
    rows = [(1000 * k + i, s, None if i % 3 else "en", i, f"Text {i} É " * (i % 4)) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, "a", None, None, None), (None, None, "x", 1, ""), (5, "b", "en", 1, "Same"), (5, "b", "en", 1, "Same"), (5, "b", "en", 1, "other"), (6, "c", "en", 1, "T " * 400_000)]
    rows = [(*r, "x", "y") for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string")
    groups = defaultdict(list)
    for i, source, lang, n, text, *_ in rows:
        own = leaf(i, source, lang, n, text)
        low = text.translate({c: c + 32 for c in range(65, 91)}) if text is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else text
        groups[source].append(((i is not None, i or 0), own, leaf(i, source, lang, n, low), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([x[1] for x in sorted(groups[s])]) for s in order}
    root, over = tree([built[s][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for (_, own, shown, i), path in zip(sorted(groups[s]), built[s][1]):
            path = path + over[k]
            to = shown
            for left, right in path:
                to = sha(left, to, right)
            want.append((str(i), own, built[s][0], root, sha(*(a + b for a, b in path)), to, to == root))
    got = merkle.proofs(df, shown=merkle.tampered_leaf())
    have = got.select("place", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded", F.col("folded") == F.col("root")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in have) == sorted(want)
    assert 0 < sum(not w[-1] for w in want) < len(want) / 3
    assert {r.group for r in got.select("group").distinct().collect()} == set(sizes)


def test_no_rows_and_one(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.proofs(df.limit(0)).count() == 0
    (r,) = merkle.proofs(df).collect()
    assert r.leaf == r.subroot == r.root == r.folded == leaf(1, None, None, None, None) and r.path == []


def test_no_key_of_a_node_serves_more_than_sixteen_runs(spark):
    runs = spark.range(5000).select(F.lit("t").alias("tree"), F.col("id").alias("run"), F.lit(80_000).cast("long").alias("size"))
    c = runs.select("run", F.explode(merkle.run_coordinates(F.col("run"), F.col("size"))).alias("c")).select("run", "c.*")
    most = c.groupBy("level", "index", F.pmod(F.shiftright("run", 4), merkle.copies(F.col("level"))).alias("copy")).count().agg(F.max("count")).first()[0]
    assert most <= 16
