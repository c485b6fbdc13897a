"""Merkle manifest of a dataset and proofs by coordinate lookup.

Every row is a leaf of the tree of its group; the groups' subroots are the leaves of one
more tree, whose last node is the root. Nodes are held in tables by (tree, level, index).
Which siblings a leaf needs follows from its index and the size of its group alone: the
coordinates are exploded, joined with the node table, ordered, concatenated and folded.

All leaves of a run of 16 need the same nodes but for their own place, so coordinates are
exploded once for each run. A node of a high level serves many runs; it is dealt out in as
many copies as its level has runs below, 16 requests for each, so that no key is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .exprs import LOWER, UPPER

BITS = 4  # 16 children
FAN = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a group that share one copy of the group's path to the root.
SHARED = 4096


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*values: Column) -> Column:
    """Digest of a row: ``-`` for null, else byte count, ``:`` and value."""
    text = [v.cast("string") for v in values]
    return digest(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text))


@dataclass
class Forest:
    """``leaves``: given columns with index and size of their tree; ``nodes``: (tree, level, index, digest); ``tops``: (tree, size, digest)."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame


def level_size(size: Column, level: Column) -> Column:
    return F.call_function("shiftright", size + power(level) - 1, (level * BITS).cast("int"))


def power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (level * BITS).cast("int"))


def depth(size: Column) -> Column:
    """Levels below the top of a tree with so many leaves."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda k: power(k) < size))


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, place, leaf, ...) with ``index`` within the tree by place (null first), then leaf, and the tree's ``size``.

    One sort by ranges over all trees; places within a range are counted, and the counts of
    the ranges before are added for each tree. So a tree of any size is spread over all tasks.
    """
    keys = ["tree", F.col("place").asc_nulls_first(), "leaf"]
    ordered = cut(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "merkle-ordered")
    counts = ordered.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    spans = counts.selectExpr(
        "tree", "_range", "coalesce(sum(_n) OVER (PARTITION BY tree ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) - _first AS _shift", "sum(_n) OVER (PARTITION BY tree) AS size"
    )
    return cut(ordered.join(spans, ["tree", "_range"]).withColumn("index", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift"), "merkle-leaves")


def grown(leaves: DataFrame) -> Forest:
    """All nodes of the trees of ``leaves`` (tree, place, leaf, ...): one aggregation and one table for each level."""
    leaves = numbered(leaves)
    levels = [leaves.select("tree", F.lit(0).alias("level"), "index", "size", F.col("leaf").alias("digest"))]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        up = (
            levels[-1].where("size > 1").groupBy("tree", (F.shiftright("index", BITS)).alias("up")).agg(F.first("level").alias("level"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("run"))
            .select("tree", (F.col("level") + 1).alias("level"), F.col("up").alias("index"), F.shiftright(F.col("size") + FAN - 1, BITS).alias("size"), digest(F.array_join(F.col("run.digest"), "")).alias("digest"))
        )
        levels.append(cut(up, f"merkle-level-{len(levels)}"))
        most = (most + FAN - 1) // FAN
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return Forest(leaves, nodes.drop("size"), nodes.where("size = 1").select("tree", F.col("digest")))


def run_coordinates(run: Column, size: Column) -> Column:
    """Coordinates a run of leaves needs: its own leaves, and above them the siblings of its nodes, as array<struct<level,j,index,own>>."""

    def of_level(k: Column) -> Column:
        own = F.when(k == 0, F.lit(-1)).otherwise(F.call_function("shiftright", run, ((k - 1) * BITS).cast("int")).bitwiseAND(FAN - 1).cast("int"))
        base = F.call_function("shiftright", run, (k * BITS).cast("int")) * FAN
        all_of = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda j: F.struct(k.alias("level"), j.alias("j"), (base + j).alias("index"), own.alias("own")))
        return F.filter(all_of, lambda c: (c["index"] < level_size(size, k)) & (c["j"] != c["own"]))

    return F.when(size > 1, F.flatten(F.transform(F.sequence(F.lit(0), depth(size) - 1), of_level))).otherwise(F.array().cast("array<struct<level:int,j:int,index:bigint,own:int>>"))


def copies(level: Column) -> Column:
    """In how many copies a node of this level is dealt out: 16 to the level less one; one for leaves."""
    return F.when(level > 1, power(level - 1)).otherwise(F.lit(1).cast("long"))


def run_paths(forest: Forest) -> DataFrame:
    """(tree, run, size, low: digests of the run's leaves, ups: the siblings to the left and right of each level above)."""
    runs = forest.leaves.groupBy("tree", F.shiftright("index", BITS).alias("run")).agg(F.first("size").alias("size"))
    asked = runs.select("tree", "run", "size", F.explode_outer(run_coordinates(F.col("run"), F.col("size"))).alias("c")).select(
        "tree", "run", "size", "c.level", "c.j", "c.index", "c.own", F.pmod(F.shiftright("run", BITS), copies(F.col("c.level"))).alias("copy")
    )
    nodes = forest.nodes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies(F.col("level")) - 1)))
    got = asked.join(nodes, ["tree", "level", "index", "copy"], "left")
    lists = got.groupBy("tree", "run").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("level", "j", "own", "digest")))).alias("found"))
    joined = lambda level, side: F.array_join(F.transform(F.filter("found", lambda x: (x["level"] == level) & side(x)), lambda x: x["digest"]), "")
    above = F.when(depth(F.col("size")) > 1, F.transform(F.sequence(F.lit(1), depth(F.col("size")) - 1), lambda k: F.struct(joined(k, lambda x: x["j"] < x["own"]).alias("left"), joined(k, lambda x: x["j"] > x["own"]).alias("right"))))
    low = F.transform(F.filter("found", lambda x: x["level"] == 0), lambda x: x["digest"])
    return lists.select("tree", "run", "size", low.alias("low"), F.coalesce(above, F.array().cast("array<struct<left:string,right:string>>")).alias("ups"))


def paths(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """``leaves`` with ``path``: the siblings left and right of the row's node, level by level; none in a tree of one leaf."""
    at = (F.col("index").bitwiseAND(FAN - 1)).cast("int")
    part = lambda of: F.array_join(of, "")
    own = F.when(F.size("low") > 0, F.array(F.struct(part(F.slice("low", F.lit(1), at)).alias("left"), part(F.slice("low", at + 2, F.lit(FAN))).alias("right")))).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
    return leaves.withColumn("run", F.shiftright("index", BITS)).join(runs.drop("size"), ["tree", "run"]).withColumn("path", F.concat(own, F.col("ups"))).drop("low", "ups", "run")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, x: digest(x["left"], acc, x["right"]))


def proofs(docs: DataFrame, fields=FIELDS, group: str = "source", order: str = "doc_id", shown: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that the ``shown`` leaf (default: the row's own) folds to.

    Rows of one group are ordered by ``order``, null first; rows that tie there by their
    digest. A null group is a tree of its own, before the others. Repeated rows are leaves
    of their own. Null and empty fields have different digests. Texts of any length are
    hashed whole. Other columns are ignored, whatever their names; an empty table gives no
    rows. Columns: place (the value of ``order``), group, leaf, shown, subroot, root, path
    (array of left and right siblings, leaf to root), folded.
    """
    own = leaf_of(*(F.col(f) for f in fields))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # sorts like the group, null first, and is never null
    leaves = cut(docs.select(tree.alias("tree"), F.col(order).alias("place"), own.alias("leaf"), F.coalesce(shown, own).alias("shown") if shown is not None else own.alias("shown")), "merkle-rows")
    forest = grown(leaves)
    tops = cut(forest.tops, "merkle-subroots")
    upper = grown(tops.select(F.lit("").alias("tree"), F.col("tree").alias("place"), F.col("digest").alias("leaf")))
    root = next((r[0] for r in upper.tops.select("digest").take(1)), None)
    above = paths(upper.leaves, run_paths(upper)).select(F.col("place").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("over"))
    sizes = forest.leaves.where("index = 0").select("tree", "size")
    shared = above.join(sizes, "tree").select("tree", "subroot", "over", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {SHARED}"))).alias("share"))
    runs = run_paths(forest).withColumn("share", F.expr(f"run * {FAN} div {SHARED}")).join(shared, ["tree", "share"])
    runs = runs.select("tree", "run", "size", "low", F.concat("ups", "over").alias("ups"), "subroot")
    return paths(forest.leaves, runs).select(
        "place", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("group"), "leaf", "shown", "subroot", F.lit(root).alias("root"), "path", folded(F.col("shown"), F.col("path")).alias("folded")
    )


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def tampered_leaf() -> Column:
    """Leaf of a row whose text lost its capitals, where 5 divides the check sum of its id; else null."""
    small = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_of(*small))


#: Check sums of decimal ids: the usual table of 256 entries from its polynomial, then one step for each digit.
_CRC = "list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_PART = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def oracle() -> str:
    part = "||".join
    own = part(_PART.format(f) for f in FIELDS)
    small = part(_PART.format(f"translate(text, '{UPPER}', '{LOWER}')" if f == "text" else f) for f in FIELDS)
    up = "SELECT {tree} level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (n + 15) // 16 FROM {of} WHERE n > 1 GROUP BY {tree} level, i // 16, n"
    return f"""
WITH RECURSIVE steps AS (SELECT {_CRC} AS t),
checked AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents d, steps),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS r
  FROM (SELECT doc_id, source, sha256({own}) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256({small}) ELSE sha256({own}) END AS shown FROM checked)),
nodes(source, level, i, digest, n) AS (SELECT source, 0, i, leaf, n FROM leaves UNION ALL {up.format(tree="source,", of="nodes")}),
subroots AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, digest, n) AS (SELECT 0, i, digest, n FROM subroots UNION ALL {up.format(tree="", of="tops")}),
sides AS (
  SELECT l.r, d.level, string_agg(d.digest, '' ORDER BY d.i) FILTER (d.i < l.i >> (4 * d.level)) AS before, string_agg(d.digest, '' ORDER BY d.i) FILTER (d.i > l.i >> (4 * d.level)) AS after
  FROM leaves l JOIN nodes d ON l.source IS NOT DISTINCT FROM d.source AND d.n > 1 AND d.i >> 4 = l.i >> (4 * d.level + 4) GROUP BY l.r, d.level
  UNION ALL
  SELECT l.r, 100 + d.level, string_agg(d.digest, '' ORDER BY d.i) FILTER (d.i < s.i >> (4 * d.level)), string_agg(d.digest, '' ORDER BY d.i) FILTER (d.i > s.i >> (4 * d.level))
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN tops d ON d.n > 1 AND d.i >> 4 = s.i >> (4 * d.level + 4) GROUP BY l.r, d.level),
steps_up AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS k, coalesce(before, '') AS before, coalesce(after, '') AS after FROM sides),
proofs AS (SELECT l.r, sha256(coalesce(string_agg(before || after, '' ORDER BY k), '')) AS proof_sha256 FROM leaves l LEFT JOIN steps_up u ON u.r = l.r GROUP BY l.r),
folds(r, k, digest) AS (SELECT r, 0, shown FROM leaves UNION ALL SELECT f.r, f.k + 1, sha256(u.before || f.digest || u.after) FROM folds f JOIN steps_up u ON u.r = f.r AND u.k = f.k + 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, p.proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN (SELECT digest FROM tops WHERE n = 1) t ON true JOIN proofs p ON p.r = l.r
JOIN (SELECT r, arg_max(digest, k) AS digest FROM folds GROUP BY r) f ON f.r = l.r
"""
