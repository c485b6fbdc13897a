"""Figures that a model assigns to line items: batches, answers, checks. Answers are an input table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import compared

BATCH, CHUNK, CERTAIN, RESOLVED = 6, 48, 7_000, 8_000


def batched(figures: DataFrame) -> DataFrame:
    """Open figures (doc_id, figure_id, ...) with batch and chunk numbers, in order of id."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("figure_id")) - 1
    return figures.withColumn("batch", F.floor(n / BATCH) + 1).withColumn("chunk", F.floor(n / CHUNK) + 1)


def read_answers(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Usable answers (doc_id, figure_id, item, bp): only of figures that were asked, the first of each."""
    known = answers.join(asked.select("doc_id", "figure_id"), ["doc_id", "figure_id"], "left_semi")
    return known.groupBy("doc_id", "figure_id").agg(F.min_by(F.struct("item", "bp"), "seq").alias("a")).select("doc_id", "figure_id", "a.*")


def merged_confidence(item_bp: Column, period_bp: Column) -> Column:
    """Struct(bp, resolved) of a pair of questions: the weaker one counts."""
    bp = F.least(item_bp, period_bp)
    return F.struct(bp.alias("bp"), (bp >= RESOLVED).alias("resolved"))


def assignment_checks(figures: DataFrame, answers: DataFrame, values: DataFrame) -> DataFrame:
    """Assigned figures against the item's own value: unsure answers and items with several values are uncertain.

    ``figures``: doc_id, figure_id, period, micro, display_unit; ``values``: doc_id, item,
    period, micro, display_unit.
    """
    own = values.groupBy("doc_id", "item", "period").agg(F.first("micro").alias("expected"), F.first("display_unit").alias("unit"), F.count("*").alias("n"))
    both = figures.join(answers, ["doc_id", "figure_id"]).join(own, ["doc_id", "item", "period"])
    c = compared(F.col("micro"), F.col("display_unit"), F.col("expected"), F.col("unit"))
    status = F.when((F.col("bp") < CERTAIN) | (F.col("n") > 1), "uncertain").otherwise(c["status"])
    return both.select("doc_id", "figure_id", "item", status.alias("status"), F.col("micro").alias("actual"), "expected")


def settled(figures: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, asked, answered, open) counts."""
    a = answers.select("doc_id", "figure_id", F.lit(1).alias("_a")).dropDuplicates(["doc_id", "figure_id"])
    return figures.join(a, ["doc_id", "figure_id"], "left").groupBy("doc_id").agg(F.count("*").alias("asked"), F.count("_a").alias("answered"), F.count_if(F.col("_a").isNull()).alias("open"))
