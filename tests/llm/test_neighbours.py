import numpy as np
import pytest

from ledgerlight.llm import neighbours
from ledgerlight.llm.neighbours import search


def test_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-2


def brute(x, ids, k, every):
    out = {}
    for q, i in zip(x, ids):
        if i % every == 0:
            s = x @ q
            out[int(i)] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


@pytest.mark.parametrize("cell,cells,queries", [(4096, 1024, 8192), (200, 1024, 8192), (100, 2, 7)])
def test_recall_against_brute_force(spark, monkeypatch, cell, cells, queries):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "CELLS", cells)  # cells of more rows than CELL are split
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((1500, 24)) * rnd.uniform(0.2, 2, (1500, 1))
    x[::3] = x[0] + 0.05 * rnd.standard_normal((500, 24))
    x[1::30] = x[1]  # copies
    ids = rnd.permutation(np.arange(3000))[:1500]
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score int").repartition(4)
    want, got = brute(x, ids, 20, 20), {}
    for r in search(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    at = {int(i): v for i, v in zip(ids, x)}
    hits = 0
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21))
        scores = [(-s, i) for _, (i, s) in sorted(ranks.items())]
        assert scores == sorted(scores)
        assert all(abs(s - at[q] @ at[i]) < 1e-9 for i, s in ranks.values())
        hits += len({i for i, _ in ranks.values()} & set(want[q]))
    assert hits / (20 * len(want)) >= 0.95


def test_odd_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (None, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (6, [0.5, 0.5]), (40, [1.0, -0.0]), (7, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search(df).collect())
    assert got == [(20, 1, 40, 1.0), (20, 2, 6, 0.5), (40, 1, 20, 1.0), (40, 2, 6, 0.5)]
    assert search(df.limit(0)).count() == 0


def test_the_search_stops_early_on_clustered_vectors():
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((60, 64))
    x = centres[rnd.integers(0, 60, 6000)] + 0.1 * rnd.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lift = neighbours.Lift(64, 1 + 1e-9)
    tree, queries = neighbours.Tree(np.arange(len(x)), x, lift), x[::20]
    score, row = tree.search(queries, np.full(len(queries), np.inf), 21, neighbours.chi_square_quantile(neighbours.SURE, neighbours.DIMENSIONS))
    share = tree.visits / (len(queries) * len(tree.low))
    want = np.argsort(-(queries @ x.T), axis=1, kind="stable")[:, :21]
    recall = np.mean([len(set(tree.ids[r]) & set(w)) / 21 for r, w in zip(row, want)])
    assert share < 0.3 and recall >= 0.9, (share, recall)


def test_ties_of_different_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, *([0.25, 0.0] if i % 2 else [0.0, 0.25])]) for i in range(1, 60)]
    got = [(r["rank"], r.vec_id, r.score) for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1000).orderBy("rank").collect()]
    assert got == [(k, k, 0.5) for k in range(1, 21)]
