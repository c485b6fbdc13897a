"""Request batches: questions that share their blocks, in runs of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan(units: DataFrame, sizes: DataFrame, budget: int, most: int) -> DataFrame:
    """(doc_id, batch, unit_ids, block_keys, state_tokens, question_tokens, fits) of units (doc_id, unit_id, block_keys, question_tokens).

    Questions of a document over the same set of blocks share batches of ``most``, in order
    of their ids, so that blocks and longest question stay within ``budget``; those that do
    not fit it alone make batches of their own. Batches are numbered by their first unit.
    ``sizes``: doc_id, block_key, tokens; a block without a size counts as 0.
    """
    keyed = units.withColumn("block_keys", F.array_sort(F.array_distinct("block_keys")))
    sets = keyed.select("doc_id", "block_keys").distinct().select("doc_id", "block_keys", F.explode_outer("block_keys").alias("block_key"))
    state = sets.join(sizes, ["doc_id", "block_key"], "left").groupBy("doc_id", "block_keys").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("state_tokens"))
    each = keyed.join(state, ["doc_id", "block_keys"]).withColumn("fits", F.col("state_tokens") + F.col("question_tokens") <= budget)
    same = ["doc_id", "block_keys", "state_tokens", "fits"]
    run = F.floor((F.row_number().over(Window.partitionBy(*same).orderBy("unit_id")) - 1) / most)
    made = each.withColumn("run", run).groupBy(*same, "run").agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"), F.max("question_tokens").alias("question_tokens"))  # ``most`` at most
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("unit_ids")[0]))
    return made.select("doc_id", number.alias("batch"), "unit_ids", "block_keys", "state_tokens", "question_tokens", "fits")


def summary(batches: DataFrame) -> DataFrame:
    return batches.agg(F.count("*").alias("requests"), F.sum(F.size("unit_ids")).alias("questions"), F.sum(F.col("state_tokens") + F.col("question_tokens")).alias("tokens"))
