"""MinHash near-duplicate search with a forest of sorted signature orders.

Every distinct shingle set gets a signature; tree t of the forest orders the sets by its
own eight signature values, its label. Neighbours in an order have the longest common
prefixes. Sets whose labels share the first three values are a region: that is the depth
at which a pair of similarity 3/4 meets. A region with few sets is a block of its order and
its sets are compared with each other. A crowded region adapts its depth place by place:
its order is dealt out by ranges, so that no task holds it whole, and each set is compared
with its neighbours in the order, whose common prefixes are as long as they come there.
The candidates are confirmed on full sets.

Crowded regions are then completed: what has not joined the region's largest component is
compared with all of the region, in blocks, first with the likeliest partners and then
with every one left whose signature allows the link. So no partner is cut off by a bound.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, cut, free_name, keyed, small_batches
from .graphs import components
from .shingles import WORDS, multipliers, shingle_sets, signature

TREES, VALUES = 16, 8
HASHES = TREES * VALUES
#: A pair of similarity 3/4 shares the first 3 values in at least one of 16 trees but for 2 in 10,000 cases.
DEPTH = 3
#: Neighbours on each side in a crowded region's order.
NEAR = 8
#: Rows in a block at most, and rows up to which all pairs of a block are candidates at once.
BLOCK, SMALL = 256, 32
#: Partners that a row of a crowded block brings first.
FIRST, NEXT = 6, 8
#: Parts of a crowded region that a row tries before all.
PROBES = 4
#: Shingles up to which a set travels with its row when a crowded region is completed.
CARRIED = 512
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Equal signature values that a pair must have: 3.8 standard deviations below the mean of a pair at the bound.
EQUAL = 77
#: Ids up to which a semi-join broadcasts them (16 bytes each); beyond, it shuffles.
BROADCAST_IDS = 200_000



def digest_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, digest of the set or null, signature or null) of every text."""

    def run(batches):
        mul = multipliers(HASHES)
        for b in small_batches(batches, 1 << 20):
            sets = shingle_sets([t or b"" for t in pc.cast(b.column(1), pa.binary()).to_pylist()], words)
            yield as_batch(SIGNED, b.column(0), [len(s) for s in sets], list(map(digest_of, sets)), [signature(s, mul).astype("<u4").tobytes() if len(s) else None for s in sets])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def tree_keys(reps: DataFrame) -> DataFrame:
    """(rep, tree, key) for every tree: a hash of the tree and of the first values of its order."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(b.num_rows, HASHES)
            yield as_batch(schema, np.repeat(b.column(0).to_numpy(), TREES), np.tile(np.arange(TREES, dtype=np.int32), b.num_rows), prefix_keys(sig, DEPTH).ravel())

    schema = pa.schema([("rep", pa.int64()), ("tree", pa.int32()), ("key", pa.int64())])
    return reps.select("rep", "sig").mapInArrow(run, "rep long, tree int, key long")


def prefix_keys(sig: np.ndarray, depth: int) -> np.ndarray:
    """One key for each row and tree, as signed 64-bit integers."""
    from .shingles import U, mixed

    key = np.broadcast_to(np.arange(1, TREES + 1, dtype=U), (len(sig), TREES)).copy()
    for j in range(depth):
        key = mixed(key * U(31) + sig[:, j::VALUES].astype(U))
    return key.view(np.int64)


def label() -> Column:
    """The values of a row's tree as bytes: rows with a common prefix of values stand together in the order of labels."""
    return F.expr(f"substring(sig, tree * {4 * VALUES} + 1, {4 * VALUES})")


PAIRS = pa.schema([("i", pa.int64()), ("j", pa.int64())])


def short(sig: list[bytes]) -> np.ndarray:
    """The low byte of each signature value; a chance match of 1 in 256 only raises the estimate."""
    return np.frombuffer(b"".join(sig), "<u4").reshape(len(sig), HASHES).astype(np.uint8)


def _blocks(batches, key: int):
    """Rows of equal key as one list of column slices; batches are sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column(key).to_numpy()
        ends = [*(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), b.num_rows]
        at = 0
        for end in ends:
            if end > at:
                if held and held[-1].column(key)[0].as_py() != k[at]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(at, end - at))
                at = end
    if held:
        yield pa.Table.from_batches(held)


def _emit(i: np.ndarray, j: np.ndarray):
    return as_batch(PAIRS, np.minimum(i, j), np.maximum(i, j))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Candidate pairs of regions (key, rep, tree, sig) of few rows: all likely ones of small regions, the FIRST likeliest of each row in others, the longer common prefix first."""

    def run(batches):
        for t in _blocks(batches, 0):
            n = t.num_rows
            if n < 2:
                continue
            ids, raw = t.column(1).to_numpy(), t.column(2).to_pylist()
            s, tree = short(raw), t.column(3)[0].as_py()
            values = np.frombuffer(b"".join(raw), "<u4").reshape(n, HASHES)[:, tree * VALUES : (tree + 1) * VALUES]
            for lo in range(0, n, 64):
                eq = (s[lo : lo + 64, None, :] == s[None]).sum(2, dtype=np.int16)
                eq[ids[lo : lo + 64, None] == ids[None]] = 0
                eq[eq < EQUAL] = 0
                if n > SMALL:
                    prefix = (values[lo : lo + 64, None, :] == values[None]).cumprod(2).sum(2, dtype=np.int16)
                    rank = np.where(eq > 0, prefix * 256 + eq, 0)
                    eq[rank < np.partition(rank, n - FIRST, axis=1)[:, n - FIRST, None]] = 0
                i, j = np.nonzero(eq)
                if n <= SMALL:
                    i, j = i[j > i + lo], j[j > i + lo]
                if len(i):
                    yield _emit(ids[lo + i], ids[j])

    ordered = blocks.select("key", "rep", "sig", "tree", label().alias("label")).repartition("key").sortWithinPartitions("key", "label")
    return ordered.mapInArrow(run, "i long, j long").distinct()


def neighbour_pairs(crowded: DataFrame) -> DataFrame:
    """Candidate pairs of crowded regions (key, rep, tree, sig): likely ones among the NEAR neighbours in the tree's order.

    The order is dealt by ranges of (region, label), so that a region of any size is
    spread over tasks; what a border separates is left to the completion.
    """

    def run(batches):
        tail = None
        for b in small_batches(batches, 4 << 20):
            if not b.num_rows:
                continue
            both = pa.Table.from_batches([tail, b] if tail is not None else [b]).combine_chunks().to_batches()[0]
            old = tail.num_rows if tail is not None else 0
            key, ids, s = both.column(0).to_numpy(), both.column(1).to_numpy(), short(both.column(2).to_pylist())
            for step in range(1, min(NEAR, len(ids) - 1) + 1):
                at = np.arange(max(step, old), len(ids))
                at = at[(key[at] == key[at - step]) & (ids[at] != ids[at - step])]
                at = at[(s[at] == s[at - step]).sum(1, dtype=np.int16) >= EQUAL]
                if len(at):
                    yield _emit(ids[at], ids[at - step])
            tail = both.slice(max(0, both.num_rows - NEAR))

    ordered = crowded.select("key", "rep", "sig", label().alias("label")).repartitionByRange("key", "label", "rep").sortWithinPartitions("key", "label", "rep")
    return ordered.mapInArrow(run, "i long, j long").distinct()


def _met_before(sig: np.ndarray, q: int, base: np.ndarray, tree: int) -> np.ndarray:
    """Whether row ``q`` shares a region with each base row in an earlier tree too, where the pair is looked at."""
    if not tree:
        return np.zeros(len(base), bool)
    first = sig[:, : tree * VALUES].reshape(len(sig), tree, VALUES)[:, :, :DEPTH]
    return (first[base] == first[q]).all(2).any(1)


REST = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("sure", pa.bool_())])


def rest_pairs(rows: DataFrame, most: int | None, percent: int) -> DataFrame:
    """(i, j, sure) between different components: rows (block, rep, component, asks, tree, sig, set); each asking row against all others of its block.

    With ``most`` set, the likeliest partners of each row, to be confirmed. Without, all that
    are left: where both sets are at hand they are compared here and only links come out.
    """

    def run(batches):
        for t in _blocks(batches, 0):
            asks, tree = t.column(3).to_numpy(), t.column(4)[0].as_py()
            ids, comp, raw = t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(5).to_pylist()
            sig, s = np.frombuffer(b"".join(raw), "<u4").reshape(len(raw), HASHES), short(raw)
            sets = [None if x is None else np.frombuffer(x, "<u8") for x in t.column(6).to_pylist()]
            base = np.flatnonzero(~asks)
            out: list[list] = [[], [], []]
            for q in np.flatnonzero(asks).tolist() if len(base) else ():
                eq = (s[base] == s[q]).sum(1, dtype=np.int16)
                at = np.flatnonzero((eq >= EQUAL) & (comp[base] != comp[q]))
                at = at[~_met_before(sig, q, base[at], tree)]
                at = at[np.argsort(-eq[at], kind="stable")]
                joined = set()
                for x in base[at if most is None else at[:most]].tolist():
                    both = most is None and sets[q] is not None and sets[x] is not None
                    if both and (comp[x] in joined or not similar(sets[q], sets[x], percent)):
                        continue
                    if both:
                        joined.add(comp[x])
                    for c, v in zip(out, (ids[q], ids[x], both)):
                        c.append(v)
            if out[0]:
                i, j = np.array(out[0]), np.array(out[1])
                yield as_batch(REST, np.minimum(i, j), np.maximum(i, j), out[2])

    return rows.select("block", "rep", "component", "asks", "tree", "sig", "set").repartition("block").sortWithinPartitions("block").mapInArrow(run, "i long, j long, sure boolean").distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union for two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def set_table(docs: DataFrame, nodes: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rep, set) of the nodes in ``ids`` (one column): sorted 64-bit shingle hashes, from a document that holds the node's set."""
    schema = pa.schema([("rep", pa.int64()), ("set", pa.binary())])

    def run(batches):
        for b in small_batches(batches, 1 << 20):
            sets = shingle_sets([t or b"" for t in pc.cast(b.column(2), pa.binary()).to_pylist()], words)
            own = [digest_of(s) == d for s, d in zip(sets, b.column(1).to_pylist())]  # an id may stand for several texts
            yield as_batch(schema, b.column(0).filter(pa.array(own)), [s.astype("<u8").tobytes() for s, o in zip(sets, own) if o])

    asked = ids.toDF("rep").distinct()
    few = asked.count() <= BROADCAST_IDS
    wanted = nodes.select("rep", "doc", "digest").join(F.broadcast(asked) if few else asked, "rep", "left_semi")
    both = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"] == wanted["doc"]).select("rep", "digest", "text")
    return both.mapInArrow(run, "rep long, set binary").dropDuplicates(["rep"])


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are links by their full sets."""

    def run(batches):
        for b in small_batches(batches):
            keep = [similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], schema=PAIRS)

    sets = cut(set_table(docs, nodes, pairs.select(F.explode(F.array("i", "j"))), words), "sets")
    joined = pairs.join(sets.toDF("i", "x"), "i").join(sets.toDF("j", "y"), "j").select("i", "j", "x", "y")
    return joined.mapInArrow(run, "i long, j long")


def _nodes(linked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rep, doc, digest, sig) of every different set: its name, the least document that holds it; and links between sets of one id.

    A set is named after its least document. Where ids stand for several texts, and so one
    document would name several sets, all but one of these get a digest as their name, and
    the sets of one id are linked, since they are one document's.
    """
    sets = cut(linked.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min("sig").alias("sig")), "sets")
    if linked.select("doc_id", "digest").distinct().groupBy("doc_id").count().where("count > 1").isEmpty():
        return sets.select(F.col("doc").alias("rep"), "doc", "digest", "sig"), None
    first = F.row_number().over(Window.partitionBy("doc").orderBy("digest")) == 1
    nodes = cut(sets.select(F.when(first, F.col("doc")).otherwise(F.xxhash64("digest")).alias("rep"), "doc", "digest", "sig"), "nodes")
    held = linked.select("doc_id", "digest").distinct().join(nodes.select("digest", "rep"), "digest")
    least = held.groupBy("doc_id").agg(F.min("rep").alias("j"))
    return nodes, cut(held.join(least, "doc_id").where("rep <> j").select(F.col("rep").alias("i"), "j").distinct(), "links")


def _by_size(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``n``: how many share the key; rows alone with theirs are gone. The sizes are written, so that a large group of the join can be split."""
    return rows.join(cut(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "sizes"), key)


def _squares(region: DataFrame, every: bool) -> DataFrame:
    """Blocks of a part of a region's rows and a part of its asking rows: all combinations, or PROBES parts for each asking row."""
    p, parts, asked = F.col("part"), F.col("parts"), F.col("asked")
    asks = F.col("component") != F.col("main")
    near = F.sequence(F.lit(0), F.least(parts, F.lit(PROBES)) - 1)
    if every:
        q = F.pmod(F.xxhash64("rep", F.lit(1)), asked).cast("int")
        own, asking = F.transform(F.sequence(F.lit(0), asked - 1), lambda x: F.struct(x.alias("q"), p.alias("p"))), F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(q.alias("q"), x.alias("p")))
    else:
        own, asking = F.transform(near, lambda j: F.struct(F.pmod(p - j, parts).alias("q"), p.alias("p"))), F.transform(near, lambda j: F.struct(p.alias("q"), F.pmod(p + j, parts).alias("p")))
    rows = lambda df, at, flag: df.withColumn("at", F.explode(at)).select(F.xxhash64("key", "at.q", "at.p").alias("block"), "rep", "component", F.lit(flag).alias("asks"), "tree", "sig", "set")
    return rows(region, own, False).unionByName(rows(region.where(asks), asking, True))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    A text without words (null, empty) has no shingles and is linked with nothing. A row
    without an id is linked with nothing and kept, its component null. Rows of one id are
    one document and belong to one component, whatever their texts; each row with the
    component's id is kept. Other columns are ignored; an empty table gives no rows.
    """
    texts = keyed(docs, id_col, text_col)
    base = cut(signed(texts, words), "signatures")
    linked = base.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    one, same_id = _nodes(linked)

    shared = _by_size(cut(tree_keys(one), "keys"), "key")
    rows = cut(shared.join(one.select("rep", "sig"), "rep").select("rep", "tree", "key", "n", "sig"), "regions")
    many = rows.where(F.col("n") > BLOCK)
    pairs = block_pairs(rows.where(F.col("n") <= BLOCK))
    tried = cut(pairs if many.isEmpty() else pairs.unionByName(neighbour_pairs(many)).distinct(), "pairs")
    links = cut(confirmed(texts, one, tried, words, percent), "links")
    found = cut(components(links if same_id is None else links.unionByName(same_id)), "components")

    large = rows.where(F.col("n") > SMALL)
    if not large.isEmpty():
        for most in (NEXT, None):
            placed = cut(large.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
            sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
            mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("k"), (F.sum("c") - F.max("c")).alias("n_asks")).where("k > 1").drop("k")
            mixed = cut(mixed, "mixed")  # so that a large region of the join can be split
            region = placed.join(mixed, "key").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("asked", F.ceil(F.col("n_asks") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
            if most is None:
                sets = set_table(texts, one, region.select("rep"), words).where(F.length("set") <= 8 * CARRIED)
                region = cut(region.join(sets, "rep", "left"), "rest")
            else:
                region = region.withColumn("set", F.lit(None).cast("binary"))
            rest = cut(rest_pairs(_squares(region, most is None), most, percent), "pairs")
            new = cut(rest.where("not sure").select("i", "j").join(tried, ["i", "j"], "left_anti"), "pairs")
            more = rest.where("sure").select("i", "j")
            if not new.isEmpty():
                more = more.unionByName(cut(confirmed(texts, one, new, words, percent), "links"))
            tried = tried.unionByName(new)
            if not more.isEmpty():
                found = cut(components(found.toDF("i", "j").unionByName(more)), "components")

    of_set = one.select("digest", "rep", "doc").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "doc", F.coalesce("component", "rep").alias("component"))
    if same_id is not None:  # a component's name may be a digest: its least document is sought
        of_set = of_set.join(of_set.groupBy("component").agg(F.min("doc").alias("least")), "component").select("digest", F.col("least").alias("component"))
    in_set = linked.select("doc_id", "n_shingles", "digest").join(of_set, "digest").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = base.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return in_set.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest id. Rows without an id stay.

    Of rows that repeat that id the one with the smallest text stays. Columns are untouched.
    """
    id_, n = free_name(docs, "_kept_id"), free_name(docs, "_kept_n")
    kept = classes(docs, id_col, text_col, **how).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_)).distinct()
    own = F.col(id_col).cast("long")
    named = docs.where(own.isNotNull()).withColumn(id_, own).join(kept, id_, "left_semi")
    one = named.withColumn(n, F.row_number().over(Window.partitionBy(id_).orderBy(F.col(text_col).asc_nulls_first())))
    return one.where(F.col(n) == 1).select(*docs.columns).unionByName(docs.where(own.isNull()))
