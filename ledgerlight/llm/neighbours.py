"""Nearest neighbours by stable projections in a kd-tree.

Vectors are lifted by one coordinate to one common length, so that the largest inner
product is the least distance, and projected by Gaussian (2-stable) directions to few
dimensions, where a kd-tree holds them: its upper part deals them to cells, its lower part
stands in each cell. A query visits leaves by projected distance and verifies the vectors
there. Projected over true squared distance follows a chi-square law, so the search stops
when the next leaf's share of the k-th best distance exceeds the law's quantile.

No task holds more than the tree of one part of a cell: cells with more rows are split by
a hash into parts that are all searched, queries stream by in small blocks, and cells that
very many queries visit are copied for groups of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, cut, small_batches

DIMENSIONS, LEAF, CELL = 8, 32, 2048
#: Chance that a nearer vector at the k-th best distance has been seen when the search stops.
SURE = 0.95
#: Rows from which the upper part of the tree is cut; every row is indexed.
SAMPLE = 4096
#: Cells of the upper part at most; those with more than CELL rows are split into parts.
CELLS = 1024
#: Queries that one copy of a cell's part answers, and that are answered at a time.
QUERIES, BLOCK = 8192, 256
#: Vectors kept beyond those asked for, so that rounding in blocks drops none that ties.
SPARE = 3


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return hi


class Lift:
    """The projection of lifted vectors; the same in every process."""

    def __init__(self, size: int, most: float):
        self.size, self.most = size, most  # most: largest squared length
        self.way = np.random.default_rng(20240229).standard_normal((size + 1, DIMENSIONS))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return x @ self.way[:-1] + np.sqrt(np.maximum(0, self.most - (x * x).sum(1)))[:, None] * self.way[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.way[:-1]


class Upper:
    """Upper part of the tree: median cuts over a sample, in heap order."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.axis, self.value = depth, np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        parts = {1: points}
        for node in range(1, 1 << depth):
            p = parts.pop(node)
            if len(p):
                self.axis[node] = np.argmax(p.max(0) - p.min(0))
                self.value[node] = np.median(p[:, self.axis[node]])
            left = p[:, self.axis[node]] < self.value[node]
            parts[2 * node], parts[2 * node + 1] = p[left], p[~left]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.value[node])
        return node - (1 << self.depth)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        p = points[:, j, None]
        gap = np.maximum(np.maximum(low[None, :, j] - p, p - high[None, :, j]), 0)
        out += gap * gap
    return out


class Tree:
    """Lower part of the tree over one cell's rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lift: Lift):
        points = lift.rows(vectors)
        todo, leaves = [np.arange(len(ids))], []
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            p = points[rows]
            half = np.argpartition(p[:, np.argmax(p.max(0) - p.min(0))], len(rows) // 2)
            todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
        order = np.concatenate(leaves)
        self.ids, self.vectors, self.order = ids[order], vectors[order], order
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in leaves])))
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])
        self.lift, self.visits = lift, 0  # visits: leaves that queries have looked at

    def search(self, queries: np.ndarray, bound: np.ndarray, k: int, quantile: float):
        """Scores and row numbers of the ``k`` nearest; ``bound``: squared distance of the k-th best known so far."""
        n = len(queries)
        near = box_distances(self.lift.queries(queries), self.low, self.high)
        turn = np.argsort(near, axis=1)
        base = self.lift.most + (queries * queries).sum(1)
        score, row = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        ids = np.append(self.ids, np.iinfo(np.int64).max)
        live = np.arange(n)
        for r in range(near.shape[1]):
            leaf = turn[live, r]
            kth = np.minimum(bound[live], base[live] - 2 * score[live, -1])
            go = near[live, leaf] <= quantile * kth
            live, leaf = live[go], leaf[go]
            if not len(live):
                break
            self.visits += len(live)
            order = np.argsort(leaf, kind="stable")
            edge = np.flatnonzero(np.diff(leaf[order], prepend=-1, append=-1))
            for a, b in zip(edge[:-1], edge[1:]):
                q, x = live[order[a:b]], leaf[order[a]]
                lo, hi = self.at[x], self.at[x + 1]
                s = queries[q] @ self.vectors[lo:hi].T
                better = (s >= score[q, -1, None]).any(1)
                q, s = q[better], s[better]
                if len(q):
                    s = np.concatenate((score[q], s), axis=1)
                    rows = np.concatenate((row[q], np.broadcast_to(np.arange(lo, hi), (len(q), hi - lo))), axis=1)
                    best = np.lexsort((ids[rows], -s), axis=-1)[:, :k]
                    score[q], row[q] = np.take_along_axis(s, best, 1), np.take_along_axis(rows, best, 1)
        # the final scores are sums over single pairs, the same in whatever block a pair is met
        i, j = np.nonzero(row >= 0)
        for lo in range(0, len(i), 1 << 14):
            a, c = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            score[a, c] = (queries[a] * self.vectors[row[a, c]]).sum(1)
        return score, row


def _by_cell(of: dict[int, int]) -> Column:
    """A number for each value of column ``cell``, as a constant of the plan; 1 where there is none."""
    known = sorted(of.items())
    return F.coalesce(F.try_element_at(F.map_from_arrays(F.array(*(F.lit(c) for c, _ in known)), F.array(*(F.lit(n) for _, n in known))), F.col("cell")), F.lit(1)) if known else F.lit(1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


MEMBERS = pa.schema([("vector", pa.binary()), ("ids", pa.list_(pa.int64())), ("asks", pa.bool_())])


def _classes(rows: DataFrame, keep: int, every: int) -> DataFrame:
    """(vector, ids, asks): equal vectors as one, with their ``keep`` least ids, all that a list of nearest can hold."""

    def run(batches):
        held: dict[bytes, list] = {}

        def out():
            return as_batch(MEMBERS, list(held), [v[0] for v in held.values()], [v[1] for v in held.values()])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.array(v, "<f8").tobytes()
                got = held.setdefault(v, [[], False])
                got[1] |= i % every == 0
                if i not in got[0]:
                    got[0] = sorted([*got[0], i])[:keep]
            if len(held) >= 20_000:
                yield out()
                held.clear()
        if held:
            yield out()

    each = rows.mapInArrow(run, "vector binary, ids array<long>, asks boolean")
    return each.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"), F.bool_or("asks").alias("asks"))


FOUND = pa.schema([("query", pa.int64()), ("score", pa.float64()), ("rep", pa.int64()), ("ids", pa.list_(pa.int64()))])


def _searched(rows: DataFrame, asked: DataFrame, lift: Lift, k: int, quantile: float, parts: Column, groups: Column) -> DataFrame:
    """Each asked (cell, query, vector, bound) in all parts of its cell; ``parts`` and ``groups``: how many the column ``cell`` has."""
    keys = ["cell", "part", "group"]

    def run(batches):
        now, held, tree, lists = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in range(3)])
            asks = pc.is_valid(b.column(3)).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0) | (asks[1:] != asks[:-1]), [True])))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if tuple(key[:, lo]) != now:
                    now, held, tree = tuple(key[:, lo]), [], None
                own = b.slice(lo, hi - lo)
                if not asks[lo]:
                    held.append(own)
                    continue
                if tree is None and held:
                    t = pa.Table.from_batches(held)
                    tree, lists, held = Tree(t.column(4).to_numpy(), _matrix(t.column(5).combine_chunks()), lift), t.column(6).combine_chunks(), []
                for at in range(0, own.num_rows if tree is not None else 0, BLOCK):
                    q = own.slice(at, BLOCK)
                    score, row = tree.search(_matrix(q.column(5)), q.column(3).to_numpy(), k, quantile)
                    i, j = np.nonzero(row >= 0)
                    found = row[i, j]
                    yield pa.RecordBatch.from_arrays([q.column(4).take(pa.array(i)), pa.array(score[i, j]), pa.array(tree.ids[found]), lists.take(pa.array(tree.order[found]))], schema=FOUND)

    index = rows.withColumn("group", F.explode(F.sequence(F.lit(0), groups - 1))).select("cell", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), "group", F.lit(None).cast("double").alias("bound"), "rep", "vector", "ids")
    queries = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("cell", "part", F.pmod(F.xxhash64("query"), groups).cast("int").alias("group"), "bound", F.col("query").alias("rep"), "vector", F.lit(None).cast("array<long>").alias("ids"))
    both = index.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, F.col("bound").asc_nulls_first(), "rep")
    return both.mapInArrow(run, "query long, score double, rep long, ids array<long>")


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of every row whose id is divisible by ``every``.

    Rows without an id, and vectors that are null, zero or hold null or non-finite
    components take no part, nor do vectors of another size than most (ties: the larger
    size). Repeated rows count once; rows of one id with different vectors are asked and
    found each, but never for their own id. Ties go to the smaller id. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    if size is None:
        return empty
    rows = rows.where(F.size("v") == size["size"])
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n_rows, most = rows.agg(F.count("*"), F.max(square)).first()
    lift, quantile = Lift(size["size"], most * (1 + 1e-12)), chi_square_quantile(SURE, DIMENSIONS)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    depth = min(int(math.log2(CELLS)), max(0, math.ceil(math.log2(n_rows / CELL))))
    upper = Upper(lift.rows(np.array([r.v for r in sample])), depth)

    celled_schema = pa.schema([("cell", pa.int32()), ("rep", pa.int64()), ("vector", pa.binary()), ("ids", pa.list_(pa.int64())), ("asks", pa.bool_()), ("point", pa.list_(pa.float64()))])

    def celled(batches):
        for b in batches:
            if b.num_rows:
                p = lift.rows(_matrix(b.column(0)))
                yield as_batch(celled_schema, upper.cells(p).astype(np.int32), [x[0] for x in b.column(1).to_pylist()], b.column(0), b.column(1), b.column(2), p.tolist())

    index = cut(_classes(rows, k + 1, every).mapInArrow(celled, "cell int, rep long, vector binary, ids array<long>, asks boolean, point array<double>"), "vectors")
    edges = [f(F.col("point")[j]).alias(f"{f.__name__}{j}") for j in range(DIMENSIONS) for f in (F.min, F.max)]
    boxes = index.groupBy("cell").agg(F.count("*").alias("n"), *edges).collect()  # CELLS at most
    cells = np.array([r.cell for r in boxes], np.int32)
    low, high = (np.array([[r[f"{f}{j}"] for j in range(DIMENSIONS)] for r in boxes]) for f in ("min", "max"))
    parts = _by_cell({r.cell: math.ceil(r.n / CELL) for r in boxes})

    asked_schema = pa.schema([("cell", pa.int32()), ("query", pa.int64()), ("vector", pa.binary()), ("bound", pa.float64())])

    def visited(b, first: bool):
        """(query row, cell row) of the cells that queries look at, the home cell first, the others after; and their bounds."""
        x = _matrix(b.column(1))
        near = box_distances(lift.queries(x), low, high)
        home = np.argmin(near, axis=1)
        bound = np.full(len(x), np.inf) if first else lift.most + (x * x).sum(1) - 2 * b.column(2).to_numpy(zero_copy_only=False)
        go = np.zeros(near.shape, bool) if first else near <= quantile * bound[:, None]
        go[np.arange(len(x)), home] = first
        return *np.nonzero(go), bound

    def asked(batches, first: bool):
        for b in small_batches(batches, 1 << 18):
            if b.num_rows:
                i, j, bound = visited(b, first)
                for lo in range(0, len(i), 1 << 14):  # a query's vector goes to each of its cells
                    a, c = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array(cells[c]), b.column(0).take(pa.array(a)), b.column(1).take(pa.array(a)), pa.array(bound[a])], schema=asked_schema)

    def counted(batches, first: bool):
        n = np.zeros(len(cells), np.int64)
        for b in small_batches(batches, 1 << 18):
            if b.num_rows:
                n += np.bincount(visited(b, first)[1], minlength=len(n))
        yield as_batch(pa.schema([("cell", pa.int32()), ("n", pa.int64())]), cells, n)

    def answers(queries: DataFrame, first: bool) -> DataFrame:
        n = queries.mapInArrow(lambda b: counted(b, first), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CELLS at most
        groups = _by_cell({r.cell: max(1, math.ceil(r.n / QUERIES)) for r in n})
        return _searched(index, queries.mapInArrow(lambda b: asked(b, first), "cell int, query long, vector binary, bound double"), lift, k + 1 + SPARE, quantile, parts, groups)

    queries = index.where("asks").select(F.col("rep").alias("query"), "vector")
    home = cut(answers(queries, True), "neighbours")
    # a cell's parts each give their best: the k-th best so far is that of all
    ranked = home.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k + 1)
    kth = ranked.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("kth"))
    further = cut(queries.join(kth, "query").select("query", "vector", "kth"), "bounds")
    found = home.unionByName(answers(further, False))

    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    entries = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))
    lists = top.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list(entries))).alias("list"))  # of k + 1 classes with as many ids

    named_schema = pa.schema([("id", pa.int64()), ("vector", pa.binary())])

    def named(batches):
        for b in batches:
            yield as_batch(named_schema, b.column(0), [np.array(x, "<f8").tobytes() for x in b.column(1).to_pylist()])

    asking = rows.where(F.col("id") % every == 0).mapInArrow(named, "id long, vector binary").distinct()
    listed = asking.join(queries, "vector").select("id", "query").join(lists, "query")
    own = F.slice(F.filter("list", lambda x: x["id"] != F.col("id")), 1, k)
    ranked = listed.select(F.col("id").alias("query_id"), F.posexplode(own).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
