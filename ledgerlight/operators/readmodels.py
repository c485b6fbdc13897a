"""Read models: small, reusable shapes of joins, folds and windows over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key, the one that came first."""
    return latest(rows, keys, [F.col(seq)])


def append_new(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the rows of ``batch`` whose key it lacks, each once: an insert that ignores conflicts."""
    new = batch.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return target.unionByName(new)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the values of ``batch``, where a key is in both, and its new keys."""
    t, b = target.alias("t"), batch.withColumn("_there", F.lit(True)).alias("b")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    pick = [F.when(F.col("b._there"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns]
    return t.join(b, on, "full_outer").select(*pick)


def page_after(rows: DataFrame, seq: str, since: int, size: int) -> DataFrame:
    """One page of a change feed by key: ``size`` rows after ``since``, with whether more follow."""
    more = rows.where(F.col(seq) > since).orderBy(seq).limit(size + 1)  # the page and one more: bounded
    n = F.row_number().over(Window.orderBy(seq))
    return more.withColumn("_n", n).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


def worst_first(status: Column, order: tuple[str, ...]) -> Column:
    """Rank of a status in ``order``, best first, as a number."""
    return F.coalesce(*(F.when(status == s, F.lit(i)) for i, s in enumerate(order)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, null for an empty whole."""
    return F.round(F.try_divide(100.0 * part, whole), digits)


def upper_median(name: str) -> Column:
    """Element at floor(n / 2), from 0, of the sorted values of a column: from above it is the first with half of them. Holds counts of distinct values, not the values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def best_as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its keys strictly before it, or nulls: one union, one window, no range join."""
    here = left.select(*by, F.col(left_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    there = right.select(*by, F.col(right_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(here.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_value"))
    seen = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, -1)
    got = here.unionByName(there).withColumn("_last", F.last("_value", ignorenulls=True).over(seen)).where("_side = 0")
    return got.select("_row.*", *(F.col(f"_last.{v}").alias(v) for v in values))
