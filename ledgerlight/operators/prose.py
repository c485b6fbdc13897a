"""Checks of what prose says: arithmetic of a sentence, direction of a change, stale years, prior reports."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prose
from ..functions.exact import compared, ratio_percent, whole

_D = pa.decimal128(38, 0)
_PARTS = ("before", "by", "after", "percent")
_CHANGES = pa.schema(
    [("doc_id", pa.int64()), ("ordinal", pa.int64()), ("clause", pa.int32()), ("item", pa.string()), ("candidates", pa.int32()), ("direction", pa.string()), *((f"{p}{s}", _D) for p in _PARTS for s in ("", "_unit"))]
)
CHANGES = "doc_id long, ordinal long, clause int, item string, candidates int, direction string, " + ", ".join(f"`{p}` decimal(38,0), {p}_unit decimal(38,0)" for p in _PARTS)


def changes(blocks: DataFrame) -> DataFrame:
    """What the clauses of blocks (doc_id, ordinal, text) say of changes: roles as amounts with their display units."""

    def run(batches):
        for b in batches:
            rows = []
            for d, n, t in zip(*(c.to_pylist() for c in b.columns)):
                for c in prose.changes(t or ""):
                    parts = [v for f in (c.before, c.by, c.after, c.percent) for v in ((Decimal(f.micro), Decimal(f.display_unit)) if f else (None, None))]
                    rows.append((d, n, c.clause, c.item, c.candidates, c.direction, *parts))
            columns = list(zip(*rows)) or [[] for _ in _CHANGES]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHANGES)], schema=_CHANGES)

    return blocks.select(F.col("doc_id").cast("long"), F.col("ordinal").cast("long"), "text").mapInArrow(run, CHANGES)


def _check(rows: DataFrame, check: str, c: Column) -> DataFrame:
    return rows.withColumn("_c", c).select("doc_id", "ordinal", "clause", F.lit(check).alias("check"), F.col("_c.status").alias("status"), F.col("_c.rounded").alias("rounded"), F.col("_c.difference").alias("difference"))


def sentence_arithmetic(found: DataFrame) -> DataFrame:
    """``from A by B to C``: B against C less A, its sign the direction's, with tolerance for two terms."""
    b = F.abs("by") * F.when(F.coalesce(F.col("direction"), F.lit("")) == "down", -1).when((F.col("direction") == "up") | (F.col("by") < 0), F.signum("by").cast("int")).otherwise(F.when(F.col("after") < F.col("before"), -1).otherwise(1))
    full = found.where("before IS NOT NULL AND `by` IS NOT NULL AND after IS NOT NULL")
    return _check(full, "sentence_arithmetic", compared(whole(b), F.col("by_unit"), F.col("after") - F.col("before"), F.greatest("before_unit", "after_unit"), 2))


def change_ratio(found: DataFrame) -> DataFrame:
    """The percentage of a change against (C - A) / |A|."""
    full = found.where("before IS NOT NULL AND after IS NOT NULL AND percent IS NOT NULL AND before <> 0")
    expected = ratio_percent(F.col("after") - F.col("before"), F.abs("before"))
    sign = F.when(F.col("percent") * expected < 0, -1).otherwise(1)
    return _check(full, "ratio", compared(whole(F.col("percent") * sign), F.col("percent_unit"), expected, F.lit(0), 1))


def directions(found: DataFrame) -> DataFrame:
    """The word of a change against its amounts: a flat change may be 5 per cent; one within rounding is uncertain."""
    full = found.where("direction IS NOT NULL AND before IS NOT NULL AND after IS NOT NULL")
    change, unit = F.col("after") - F.col("before"), F.greatest("before_unit", "after_unit")
    flat = F.abs(change) * 20 <= F.abs("before")
    fits = F.when(F.col("direction") == "flat", flat).when(F.col("direction") == "up", change > 0).otherwise(change < 0)
    status = F.when(fits, "match").when(F.abs(change) <= unit, "uncertain").otherwise("mismatch")
    return full.select("doc_id", "ordinal", "clause", F.lit("direction").alias("check"), status.alias("status"), (F.abs(change) <= unit).alias("rounded"), whole(change).alias("difference"))


def stated_values(found: DataFrame, values: DataFrame) -> DataFrame:
    """Closing amounts of named items against their values (doc_id, item, micro, display_unit); several candidates that do not all agree are uncertain."""
    both = found.where("item IS NOT NULL AND after IS NOT NULL").join(values, ["doc_id", "item"])
    c = compared(F.col("after"), F.col("after_unit"), F.col("micro"), F.col("display_unit"))
    each = both.withColumn("_c", c)
    agg = each.groupBy("doc_id", "ordinal", "clause").agg(F.count_if(F.col("_c.status") == "match").alias("hits"), F.count("*").alias("n"), F.max("candidates").alias("candidates"), F.min("_c").alias("_c"))
    status = F.when(F.col("hits") == 1, "match").when((F.col("candidates") > 1) | (F.col("n") > 1), "uncertain").otherwise(F.col("_c.status"))
    return agg.select("doc_id", "ordinal", "clause", F.lit("cross_reference").alias("check"), status.alias("status"), F.col("_c.rounded").alias("rounded"), F.col("_c.difference").alias("difference"))


def dated_amounts(entries: DataFrame) -> DataFrame:
    """What several places say of one item at one date: each statement against one other, with what it stands against and where.

    ``entries``: doc_id, key (item and date), unit, ordinal, start, micro, display_unit. The
    statements of a key fall into classes of equal value and precision; the leading class is
    that of most statements, then the one stated first. A statement is held against the first
    one of the leading class; that one itself against the last of its class or, where it is
    alone, against the class that ranks last. So n statements give n rows, not n * (n - 1),
    and every other value shows as a row. A key with one statement gives none; entries with
    a null value or key take no part. Equal entries at one place count as often.
    """
    group, place = ["doc_id", "key", "unit"], F.struct("ordinal", "start")
    known = entries.select(*group, "ordinal", "start", "micro", "display_unit").dropna()
    classes = known.groupBy(*group, "micro", "display_unit").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    rank = F.struct((-F.col("n")).alias("n"), "first", "last", "micro", "display_unit")
    of_key = classes.groupBy(*group).agg(F.min(rank).alias("lead"), F.max(rank).alias("tail"), F.count("*").alias("classes"), F.sum("n").alias("statements")).where("statements > 1")
    both = known.join(of_key, group)
    leads = (F.col("micro") == F.col("lead.micro")) & (F.col("display_unit") == F.col("lead.display_unit"))
    heads = leads & (place == F.col("lead.first"))
    alone = heads & (F.col("lead.n") == -1)
    other = lambda field: F.when(alone, F.col("tail")[field]).otherwise(F.col("lead")[field])
    at = F.when(heads & ~alone, F.col("lead.last")).otherwise(other("first"))
    seen = both.withColumn("expected", other("micro")).withColumn("_unit", other("display_unit")).withColumn("_at", at)
    signed = compared(F.col("micro"), F.col("display_unit"), F.col("expected"), F.col("_unit"))
    size = compared(F.abs("micro"), F.col("display_unit"), F.abs("expected"), F.col("_unit"))
    told = seen.withColumn("_c", signed).withColumn("_s", size)
    code = F.when(F.col("_c.status") == "match", "reference_matches").when(F.col("_s.status") == "match", "reference_sign").otherwise("reference_differs")
    return told.select(*group, "ordinal", "start", F.lit("cross_reference").alias("check"), F.col("_c.status").alias("status"), code.alias("code"), F.col("_c.rounded").alias("rounded"), F.col("_c.difference").alias("difference"), F.col("_at.ordinal").alias("other_ordinal"), F.col("_at.start").alias("other_start"), "classes", "statements")


def masked(blocks: DataFrame) -> DataFrame:
    """Blocks with ``mask``: numbers as #, years kept, and ``years``."""
    schema = pa.schema([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("mask", pa.string()), ("years", pa.list_(pa.int32()))])

    def run(batches):
        from ..functions import spans as sp

        for b in batches:
            d, n, t = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array([prose.template(x or "") for x in t], pa.string()), pa.array([[y[3] for y in sp.years(x or "")] for x in t], pa.list_(pa.int32()))], schema=schema)

    return blocks.select(F.col("doc_id").cast("long"), F.col("ordinal").cast("long"), "text").mapInArrow(run, "doc_id long, ordinal long, mask string, years array<int>")


def stale_years(now: DataFrame, prior: DataFrame, report_year: int) -> DataFrame:
    """Paragraphs that still name the prior report's year: a twin with the same mask in the same company's prior report (of the same doc_id) makes it a mismatch, else a suspicion."""
    old = masked(now).where(F.array_contains("years", F.lit(report_year - 1)) & ~F.array_contains("years", F.lit(report_year)))
    twins = masked(prior).select("doc_id", F.col("mask"), F.lit(True).alias("twin")).distinct()
    return old.join(twins, ["doc_id", "mask"], "left").select("doc_id", "ordinal", F.lit("rollover").alias("check"), F.when(F.col("twin"), "mismatch").otherwise("uncertain").alias("status"))


def prior_report(cells: DataFrame, prior_cells: DataFrame) -> DataFrame:
    """Prior-year amounts against the prior report's current ones, joined on labels that are unique in it; another sign counts as another amount."""
    from ..functions.lineitems import bare_label
    from .checks import judged

    label = F.lower(bare_label(F.col("label")))
    was = prior_cells.where("kind = 'amount' AND period = 'current'").select("doc_id", label.alias("_l"), F.col("micro").alias("_was"), F.col("display_unit").alias("_was_unit"))
    now = cells.where("kind = 'amount' AND period = 'prior'").withColumn("_l", label).withColumn("_now", F.lit(True))
    every = now.unionByName(was, allowMissingColumns=True)
    by_label = Window.partitionBy("doc_id", "_l")
    every = every.withColumns({"was": F.min("_was").over(by_label), "_hi": F.max("_was").over(by_label), "was_unit": F.max("_was_unit").over(by_label)})
    both = every.where("_now AND doc_id IS NOT NULL AND _l IS NOT NULL AND was = _hi")
    return judged(both, "prior_report", F.col("micro"), F.col("display_unit"), F.col("was"), F.col("was_unit"))
