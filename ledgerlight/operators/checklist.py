"""Hierarchical checklists: validation, order, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import numbered, settled


def paths(items: DataFrame, most: int) -> DataFrame:
    """Items (k, parent, sort, ...) with depth and sort path; those deeper than ``most`` levels or on cycles have none."""
    nodes = items.select("k", "parent", "sort")
    level = nodes.where(F.col("parent").isNull()).select("k", F.lit(1).alias("depth"), F.array("sort").alias("path"))
    found = level
    for depth in range(2, most + 1):
        below = nodes.where(F.col("parent").isNotNull()).join(level.select(F.col("k").alias("parent"), "path"), "parent")
        level = below.select("k", F.lit(depth).alias("depth"), F.concat("path", F.array("sort")).alias("path"))
        found = found.unionByName(level)
    return items.join(found, "k", "left")


def preorder(items: DataFrame, most: int) -> DataFrame:
    """Items that can be reached, parents before their children, siblings by ``sort``, with ``position`` from 1.

    Positions count within each root's tree, from where the trees before it end; only one
    row for each value of a root's ``sort`` meets in one task.
    """
    placed = paths(items, most).where(F.col("depth").isNotNull()).withColumn("_root", F.col("path")[0])
    sizes = placed.groupBy("_root").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_root").orderBy("path", "k")))
    return inner.join(before, "_root").withColumn("position", (F.col("_before") + F.col("_at")).cast("long")).drop("_root", "_before", "_at")


def display_order(items: DataFrame, deepest: int = 3, locale: str = "de") -> DataFrame:
    """Items (k, key, parent_key, sort, ...) with ``depth`` from 0 and ``position`` from 1: parents before children, siblings by ``sort``, then by key in the locale's order.

    Parents are found whatever the case of their key; an item whose parent is unknown is a
    root. Items below ``deepest`` or on cycles are left out, equal ones follow ``k``, a null
    ``sort`` comes first. Keys are meant to be unique (see ``issues``).
    """
    ids = items.select(F.lower("key").alias("_id")).where("_id IS NOT NULL").distinct()
    own = items.join(ids.withColumnRenamed("_id", "_up"), F.lower("parent_key") == F.col("_up"), "left")
    place = lambda d: F.struct("sort", F.collate("key", locale).alias("key"), "k").alias(f"_{d}")
    level = own.where("_up IS NULL").select(*items.columns, place(0))
    found = level.withColumn("depth", F.lit(0))
    for depth in range(1, deepest + 1):
        above = level.select(F.lower("key").alias("_up"), *(f"_{d}" for d in range(depth)))
        level = own.where("_up IS NOT NULL").join(above, "_up").select(*items.columns, *(f"_{d}" for d in range(depth)), place(depth))
        found = found.unionByName(level.withColumn("depth", F.lit(depth)), allowMissingColumns=True)
    order = [F.col(f"_{d}.{c}").asc_nulls_first() for d in range(deepest + 1) for c in ("sort", "key", "k")]
    return numbered(found, order).drop(*(f"_{d}" for d in range(deepest + 1)))


def moved(items: DataFrame, step: int) -> DataFrame:
    """Items (k, parent, sort) with ``new_sort`` after each alone changes places with its neighbour among its siblings: ``step`` -1 up, 1 down; null at the end of the list.

    ``swap_k`` is the neighbour, which takes the item's ``sort``.
    """
    w = Window.partitionBy("parent").orderBy("sort", "k")
    other = lambda c: F.lead(c).over(w) if step > 0 else F.lag(c).over(w)
    return items.withColumn("new_sort", other("sort")).withColumn("swap_k", other("k"))


def issues(items: DataFrame, most: int = 3, longest: int = 2000) -> DataFrame:
    """(k, issue) of checklist items (k, parent, sort, text): what stands against publishing them."""
    per = items.withColumn("same", F.count("*").over(Window.partitionBy("k")))
    known = items.select(F.col("k").alias("_known")).distinct()
    placed = paths(items.dropDuplicates(["k"]), most).select(F.col("k").alias("_k"), "depth")
    all_ = per.join(known, F.col("parent") == F.col("_known"), "left").join(placed, F.col("k") == F.col("_k"), "left")
    up = _cycles(items)
    all_ = all_.join(up, "k", "left")
    t = F.col("text")
    found = F.filter(
        F.array(
            F.when(F.col("same") > 1, "duplicate_key"),
            F.when(F.coalesce(F.trim(t), F.lit("")) == "", "empty_text"),
            F.when(F.length(t) > longest, "text_too_long"),
            F.when(F.col("parent") == F.col("k"), "self_parent"),
            F.when(F.col("parent").isNotNull() & F.col("_known").isNull(), "unknown_parent"),
            F.when(F.col("cycle") & (F.col("parent") != F.col("k")), "cycle"),
            F.when(F.col("depth").isNull() & ~F.coalesce("cycle", F.lit(False)) & F.col("_known").isNotNull() & (F.col("parent") != F.col("k")), "too_deep"),
        ),
        lambda x: x.isNotNull(),
    )
    return all_.select("k", F.explode(F.array_distinct(found)).alias("issue")).distinct()


#: Limits of a checklist's fields. Fixed values.
KEY, ITEMS, REFERENCE, TITLE, REQUIREMENT, ASPECT, ASPECTS = "(?u)^[\\p{L}\\p{N}][\\p{L}\\p{N}._\\-/ ]{0,79}$", 500, 200, 300, 6_000, 500, 20


def field_issues(items: DataFrame) -> DataFrame:
    """(key, issue) of items (key, reference, title, requirement, aspects, order) one by one, and of the whole list with a null key: none or too many items."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    longer = lambda c, most: F.coalesce(F.length(c) > most, F.lit(False))
    too_long = longer("reference", REFERENCE) | longer("title", TITLE) | longer("requirement", REQUIREMENT) | F.coalesce((F.size("aspects") > ASPECTS) | F.exists("aspects", lambda a: F.length(a) > ASPECT), F.lit(False))
    found = (
        ("invalid_key", ~F.coalesce(F.col("key").rlike(KEY), F.lit(False))), ("empty_reference", empty("reference")), ("empty_title", empty("title")), ("empty_requirement", empty("requirement")),
        ("text_too_long", too_long), ("invalid_order", F.col("order").isNull()),
    )
    each = items.select("key", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in found)))).alias("issue"))
    n = items.agg(F.count("*").alias("n"))
    whole = n.select(F.lit(None).cast("string").alias("key"), F.when(F.col("n") == 0, "no_items").when(F.col("n") > ITEMS, "too_many_items").alias("issue")).where("issue IS NOT NULL")
    return each.unionByName(whole)


def _cycles(items: DataFrame) -> DataFrame:
    """(k, cycle = true) of items on cycles of any length, by pointer jumping: every step goes twice as far as the one before.

    Items whose chain of parents ends drop out. When steps are as long as there are items
    left, every step has come to a cycle, and each item of a cycle is where some step ends. Of
    repeated keys the least parent counts. Memory and rows a round: one row for each item left.
    """
    first = items.groupBy("k").agg(F.min("parent").alias("up")).where("up IS NOT NULL")
    step, length, left = settled(first.join(first.select(F.col("k").alias("up")), "up", "left_semi")), 1, None
    while (left := step.count()) > length:
        step = step.alias("a").join(step.alias("b"), F.col("a.up") == F.col("b.k")).select(F.col("a.k").alias("k"), F.col("b.up").alias("up"))
        step, length = settled(step), 2 * length
    # what is left has a step of this length; on a cycle that permutes its items, elsewhere it may still be a chain's end
    ends = step.select(F.col("up").alias("k")).distinct()
    return ends.join(step.select("k"), "k", "left_semi").distinct().withColumn("cycle", F.lit(True)) if left else ends.withColumn("cycle", F.lit(True)).where("false")
