"""The decision grid: sections, routing, escalation, progress, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_estimate


def section_numbers(sizes: Column, target: int) -> Column:
    """Section of each element, from 1: a new one begins where the next would exceed ``target``; no element is split."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(1).cast("long").alias("section"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        new = (F.size(acc["out"]) > 0) & (acc["total"] + n > target)
        section = acc["section"] + new.cast("long")
        return F.struct(F.when(new, n).otherwise(acc["total"] + n).alias("total"), section.alias("section"), F.concat(acc["out"], F.array(section)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def sections(rows: DataFrame, key: str, order: str, text: str, target: int) -> DataFrame:
    """(key, order, section) of ordered texts, by estimated tokens."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), tokens_estimate(F.col(text)).alias("n")))).alias("items"))  # one document's blocks
    numbered = lists.withColumn("sections", section_numbers(F.transform("items", lambda x: x["n"]), target))
    return numbered.select(key, F.explode(F.arrays_zip("items", "sections")).alias("x")).select(key, F.col(f"x.items.{order}").alias(order), F.col("x.sections").alias("section"))


def citation_check(choice: Column, confidence: Column, accept: int = 8_000) -> Column:
    """Verdict of one citation's answer as struct(verdict, confidence_bp, needs_review)."""
    bp = F.floor(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) * 10_000 + 0.5).cast("long")
    verdict = F.when(choice == "contradicts", "contradicted").when(choice == "supports", "verified").otherwise("unsupported")
    return F.struct(verdict.alias("verdict"), bp.alias("confidence_bp"), (~((choice == "supports") & (bp >= accept))).alias("needs_review"))


def cell_outcome(verdict: Column, confidence_bp: Column, accept: int = 8_000) -> Column:
    """Aggregate of a cell's citations: an invented or contradicted one decides, else one good support is enough."""
    has = lambda v: F.coalesce(F.bool_or(verdict == v), F.lit(False))
    best = F.max(F.when(verdict == "verified", confidence_bp))
    return F.struct(
        F.when(has("fabricated"), "fabricated").when(has("contradicted"), "contradicted").when(has("verified"), "verified").otherwise("unsupported").alias("verdict"),
        (has("fabricated") | has("contradicted") | ~has("verified") | (best < accept)).alias("needs_review"),
    )


def worst_verdict(verdict: Column) -> Column:
    order = ("verified", "unsupported", "contradicted", "fabricated")
    rank = F.coalesce(*(F.when(verdict == v, F.lit(i)) for i, v in enumerate(order)))
    return F.max_by(verdict, rank)


def escalated(cells: DataFrame, run: str, order: list[str], confidence: str, needs_review: str, threshold: int, budget: int) -> DataFrame:
    """Cells with reason, escalate, blocked and state; the first ``budget`` of a run that ask for escalation get it."""
    wanted = F.when(F.col(needs_review), "citation_needs_review").when(F.col(confidence) < threshold, "low_confidence")
    asked = cells.withColumn("reason", wanted)
    place = F.row_number().over(Window.partitionBy(run, F.col("reason").isNotNull()).orderBy(*order))
    given = F.col("reason").isNotNull() & (place <= budget)
    out = asked.withColumn("escalate", given).withColumn("blocked", F.col("reason").isNotNull() & ~F.col("escalate"))
    state = F.when(F.col("escalate"), "escalated").when(F.col("blocked") | F.col(needs_review), "needs_review").otherwise("complete")
    return out.withColumn("state", state)


def progress(done: Column, total: Column, before: Column | None = None) -> Column:
    """Per cent of a run, from 10 to 99, never falling below what it was."""
    now = F.least(F.lit(99), 10 + F.floor(89 * done / F.greatest(F.lit(1), total)))
    return now if before is None else F.greatest(before, now)


#: What a missing answer counts as; from when a block is an instruction to the reader.
THRESHOLD, INJECTION = 4_000, 5_000


def routed(blocks: DataFrame, answers: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, column_no, ordinal, section, tokens, relevance_bp, injection_bp): every block with every column of its run.

    ``blocks``: doc_id, ordinal, section, tokens. ``answers``: doc_id, section, column_no
    (null: the injection question), bp. ``columns``: column_no; a run has few, so they
    travel as one array.
    """
    listed = columns.agg(F.collect_set("column_no").alias("_columns"))
    injected = answers.where("column_no IS NULL").groupBy("doc_id", "section").agg(F.max("bp").alias("_i"))
    relevant = answers.where("column_no IS NOT NULL").groupBy("doc_id", "section", "column_no").agg(F.max("bp").alias("_r"))
    each = blocks.join(F.broadcast(listed)).withColumn("column_no", F.explode("_columns")).drop("_columns")
    both = each.join(injected, ["doc_id", "section"], "left").join(relevant, ["doc_id", "section", "column_no"], "left")
    return both.withColumn("relevance_bp", F.coalesce("_r", F.lit(THRESHOLD))).withColumn("injection_bp", F.coalesce("_i", F.lit(THRESHOLD))).drop("_i", "_r")


def cell_packets(routes: DataFrame, budget: int, most: int = 1 << 20) -> DataFrame:
    """(doc_id, column_no, ordinal, place): the relevant, harmless blocks of a cell that fit its budget, most relevant first, numbered in document order."""
    from .retrieval import greedy

    fit = routes.where((F.col("relevance_bp") >= THRESHOLD) & (F.col("injection_bp") < INJECTION))
    item = F.struct((-F.col("relevance_bp")).alias("worse"), "ordinal", F.col("tokens").cast("long").alias("tokens"))
    lists = fit.groupBy("doc_id", "column_no").agg(F.array_sort(F.collect_list(item)).alias("items"))  # one document's blocks
    kept = F.array_sort(F.transform(greedy(F.col("items"), "tokens", budget, most), lambda x: x["ordinal"]))
    return lists.select("doc_id", "column_no", F.posexplode(kept).alias("pos", "ordinal")).select("doc_id", "column_no", "ordinal", (F.col("pos") + 1).alias("place"))


def cell_quotes(quotes: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` best quotes of each cell (doc_id, column_no, ordinal, bp), numbered in document order."""
    best = Window.partitionBy("doc_id", "column_no").orderBy(F.desc("bp"), "ordinal")
    top = quotes.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
    return top.withColumn("citation", F.row_number().over(Window.partitionBy("doc_id", "column_no").orderBy("ordinal"))).drop("_n")
