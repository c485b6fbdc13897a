"""Column helpers for row-local text work without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[ \\t-\\r]+", -1), lambda w: w != "")


def scanned(values: Column, combine) -> Column:
    """Running ``combine`` over an array (associative: sums, largest values), in log2 of its size passes."""
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")))
    pass_ = lambda acc, k: F.transform(acc, lambda x, i: let(F.get(acc, i - F.pow(F.lit(2.0), k).cast("int")), lambda before: F.when(before.isNull(), x).otherwise(combine(before, x))))
    return F.aggregate(passes, values, pass_)


def occurrences(c: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start:int, s:string>>, starts in code points from 0."""
    none = F.array().cast("array<struct<start:int,s:string>>")

    def placed(gaps: Column) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        pieces = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"), found.alias("s")), lambda x: F.struct((F.length(x["gap"]) + F.length(x["s"])).alias("n"), x["s"].alias("s")))
        return let(
            pieces,
            lambda p: let(
                scanned(F.transform(p, lambda x: x["n"]), lambda a, b: a + b), lambda ends: F.transform(p, lambda x, i: F.struct((F.get(ends, i) - F.length(x["s"])).cast("int").alias("start"), x["s"].alias("s")))
            ),
        )

    return F.when(c.rlike(pattern), let(F.split(c, pattern, -1), placed)).otherwise(none)
