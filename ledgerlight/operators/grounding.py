"""Grounding of model answers, given as tables: quotes, contracts, reasons to verify, filters, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, locate_quote

CONFIDENCE, DRIFT = 85, 10
INJECTION, IRRELEVANT = 5_000, 2_500
STATUSES = ("fulfilled", "partially_fulfilled", "not_fulfilled", "no_assessment_possible")


def grounded(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Citations (doc_id, block_key, quote, ...) with ``grounded``, the document's wording, and ``error`` (unknown_block, quote_not_found or null)."""
    b = blocks.select("doc_id", "block_key", F.col("text").alias("_text"))
    found = locate_quote(F.col("_text"), F.col("quote"))
    got = citations.join(b, ["doc_id", "block_key"], "left").withColumn("grounded", found)
    error = F.when(F.col("_text").isNull(), "unknown_block").when(F.col("grounded").isNull(), "quote_not_found")
    return got.withColumn("error", error).drop("_text")


def contains_quote(block: Column, quote: Column) -> Column:
    return F.contains(collapse(block), collapse(quote))


def contract_violations(status: Column, evidence: Column, missing: Column, confidence: Column, explanation: Column) -> Column:
    """Broken rules of an assessment as an array; ``evidence``: array of struct(block_key, quote, support)."""
    n, support = F.size(evidence), F.transform(evidence, lambda e: e["support"])
    pairs = F.transform(evidence, lambda e: F.concat_ws("\u0000", e["block_key"], e["quote"]))
    return F.filter(
        F.array(
            F.when(~status.isin(*STATUSES), "status"),
            F.when(~confidence.between(0, 100), "confidence"),
            F.when(F.coalesce(F.trim(explanation), F.lit("")) == "", "explanation"),
            F.when((status == "fulfilled") & ~F.array_contains(support, "supports"), "fulfilled_without_support"),
            F.when((status == "partially_fulfilled") & (n == 0), "partial_without_evidence"),
            F.when((status == "no_assessment_possible") & (F.size(missing) == 0), "missing_information"),
            F.when(F.size(F.array_distinct(pairs)) < n, "repeated_evidence"),
        ),
        lambda x: x.isNotNull(),
    )


def sampled(a: Column, b: Column, percent: int = DRIFT) -> Column:
    """Whether a pair of keys is in the fixed sample: the first eight digits of its digest, modulo 100."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", a, b), 256), 1, 8), 16, 10).cast("long") % 100 < percent


def verification_reasons(status: Column, confidence: Column, contradicts: Column, retried: Column, analysis: Column, requirement: Column) -> Column:
    return F.filter(
        F.array(
            F.when(status == "fulfilled", "fulfilled"), F.when(status == "not_fulfilled", "not_fulfilled"), F.when(confidence < CONFIDENCE, "low_confidence"),
            F.when(contradicts, "contradiction"), F.when(retried, "retried"), F.when(sampled(analysis, requirement), "drift_sample"),
        ),
        lambda x: x.isNotNull(),
    )


def triage_eligible(reasons: Column) -> Column:
    return reasons == F.array(F.lit("fulfilled"))


def after_triage(reasons: Column, waived: Column) -> Column:
    return F.when(waived & triage_eligible(reasons), F.array().cast("array<string>")).otherwise(reasons)


def filtered_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (keys, ordinal, role, relevance_bp, injection_bp) with ``dropped`` (irrelevant, injection, orphaned_context or null) and ``fallback``.

    Without a judgement a candidate stays; if no match is left, all stay.
    """
    injected = F.coalesce(F.col("injection_bp"), F.lit(0)) >= INJECTION
    weak = (F.col("role") == "match") & F.coalesce(F.col("relevance_bp") < IRRELEVANT, F.lit(False))
    first = candidates.withColumn("_first", F.when(injected, "injection").when(weak, "irrelevant"))
    kept = F.col("_first").isNull() & (F.col("role") == "match")
    group = Window.partitionBy(*keys)
    at = F.collect_set(F.when(kept, F.col("ordinal"))).over(group)  # of one packet
    near = F.array_contains(F.col("_at"), F.col("ordinal") - 1) | F.array_contains(F.col("_at"), F.col("ordinal") + 1)
    out = first.withColumn("_at", at).withColumn("fallback", F.size("_at") == 0)
    dropped = F.when(F.col("fallback"), F.lit(None)).otherwise(F.coalesce("_first", F.when((F.col("role") != "match") & ~near, "orphaned_context")))
    return out.withColumn("dropped", dropped).drop("_first", "_at")


def assessment_outcome(status: Column, checks: Column) -> Column:
    """Struct(needs_review, reason) of an assessment from its citations' checks: array of struct(support, verdict, needs_review)."""
    seen = F.filter(checks, lambda c: (c["support"] != "context") & c["verdict"].isNotNull())
    carries = lambda c: (c["verdict"] == "verified") & ~c["needs_review"] & (
        ((status == "fulfilled") & (c["support"] == "supports")) | ((status == "not_fulfilled") & (c["support"] == "contradicts")) | ((status == "partially_fulfilled") & c["support"].isin("supports", "contradicts"))
    )
    judged = status.isin("fulfilled", "not_fulfilled", "partially_fulfilled") & (F.size(seen) > 0)
    reason = F.when(judged & F.exists(seen, lambda c: c["verdict"] == "contradicted"), "contradicted").when(judged & ~F.exists(seen, carries), "not_supported")
    return F.struct(reason.isNotNull().alias("needs_review"), reason.alias("reason"))


def review_states(events: DataFrame) -> DataFrame:
    """(subject, status, prepared_by, reviewed_by, refused) after all events (subject, at, actor, action).

    Prepare resets the reviewer; release and reject need a prepared subject and another
    person than the preparer; reject leaves it prepared. What breaks these rules is refused.
    """
    zero = F.struct(F.lit("open").alias("status"), F.lit(None).cast("string").alias("prepared_by"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(0).alias("refused"))

    def step(s: Column, e: Column) -> Column:
        refuse = F.struct(s["status"].alias("status"), s["prepared_by"].alias("prepared_by"), s["reviewed_by"].alias("reviewed_by"), (s["refused"] + 1).alias("refused"))
        prepared = F.struct(F.lit("prepared").alias("status"), e["actor"].alias("prepared_by"), F.lit(None).cast("string").alias("reviewed_by"), s["refused"].alias("refused"))
        released = F.struct(F.lit("reviewed").alias("status"), s["prepared_by"].alias("prepared_by"), e["actor"].alias("reviewed_by"), s["refused"].alias("refused"))
        manager = (s["status"] == "prepared") & (s["prepared_by"] != e["actor"])
        return (
            F.when(e["action"] == "prepare", F.when(s["status"] == "reviewed", refuse).otherwise(prepared))
            .when(e["action"] == "release", F.when(manager, released).otherwise(refuse))
            .when(e["action"] == "reject", F.when(manager, s).otherwise(refuse))
            .otherwise(s)
        )

    lists = events.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("at", F.col("actor").cast("string").alias("actor"), "action"))).alias("e"))  # one subject's history
    return lists.select("subject", F.aggregate("e", zero, step).alias("s")).select("subject", "s.*")


def effective(results: DataFrame, overrides: DataFrame, confirmations: DataFrame, key: str) -> DataFrame:
    """Results (key, status) with the last override's status and whether a confirmation came after it."""
    last = overrides.groupBy(key).agg(F.max_by("status", F.struct("at", "id")).alias("_status"), F.max("at").alias("_at"))
    sure = confirmations.groupBy(key).agg(F.max("at").alias("_sure"))
    both = results.join(last, key, "left").join(sure, key, "left")
    confirmed = F.col("_sure").isNotNull() & (F.col("_at").isNull() | (F.col("_sure") > F.col("_at")))
    return both.select(*[c for c in results.columns if c != "status"], F.coalesce("_status", "status").alias("status"), F.col("_status").isNotNull().alias("overridden"), confirmed.alias("confirmed"))
