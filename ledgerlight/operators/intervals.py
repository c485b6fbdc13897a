"""Spans within one block: overlaps, runs, subtotals, triples of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_overlaps(spans: Column) -> Column:
    """Of struct(start, end, ...) spans the longest win, the earlier at ties; equal spans stay together."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s.alias("s"))))
    clash = lambda kept, x: F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]) & ~((k["start"] == x["start"]) & (k["end"] == x["end"])))
    kept = F.aggregate(order, F.filter(order, lambda x: F.lit(False)), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda x: x["s"])


def change_triples(cells: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, now, past, change) column triples in this order from left to right, or right to left for the first two, with change = now - past in all rows, ``least`` at least.

    ``cells``: doc_id, row_no, column_no, micro.
    """
    c = lambda name: cells.select("doc_id", "row_no", F.col("column_no").alias(name), F.col("micro").alias(f"{name}_v"))
    rows = c("now").join(c("past"), ["doc_id", "row_no"]).where("now < past").join(c("change"), ["doc_id", "row_no"]).where("past < change")
    fits = F.col("change_v") == F.col("now_v") - F.col("past_v")
    return rows.groupBy("doc_id", "now", "past", "change").agg(F.bool_and(fits).alias("fits"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("fits")).drop("fits")


def subtotal(stack: Column, value: Column, most: int = 12) -> Column:
    """Length of the shortest run of 2 to ``most`` values at the end of ``stack`` that adds up to ``value``, or null."""
    n = F.size(stack)
    runs = F.when(n >= 2, F.sequence(F.lit(2), F.least(n, F.lit(most)))).otherwise(F.array().cast("array<int>"))
    total = lambda k: F.aggregate(F.slice(stack, n - k + 1, k), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.get(F.filter(runs, lambda k: total(k) == value), F.lit(0))


def ascending_runs(rows: DataFrame, key: str, order: str, value: str, least: int = 4) -> DataFrame:
    """(key, first, last, n) of maximal stretches in which ``value`` does not fall, of ``least`` rows or more."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(True)).cast("int")
    run = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")
