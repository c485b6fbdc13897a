"""Texts made from results: rationales of decisions, comments of checks, steps of a calculation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIONALE = {
    "de": ("{label}: {criterion}.", "Wahrscheinlichkeit {p} %.", "Beleg: {n}.", "Belege: {n}.", "Kein Beleg gefunden."),
    "en": ("{label}: {criterion}.", "Probability {p} %.", "Evidence: {n}.", "Evidence: {n}.", "No evidence found."),
}
COMMENT_LENGTH, TITLE_LENGTH = 160, 60


def filled(template: Column, params: Column) -> Column:
    """A template with each ``{name}`` replaced from a map of strings."""
    return F.aggregate(F.map_entries(params), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def clipped(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis if it was longer."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def comment(template: Column, params: Column, most: int = COMMENT_LENGTH) -> Column:
    return clipped(filled(template, params), most)


def rationale(locale: str, label: Column, criterion: Column, probability_bp: Column, numbers: Column) -> Column:
    """Label and criterion, probability with no or one decimal, citation numbers in order."""
    decided, probable, one, several, none = RATIONALE[locale]
    p = F.when(probability_bp % 100 == 0, F.format_string("%d", (probability_bp / 100).cast("long"))).otherwise(F.format_string("%.1f", probability_bp / 100))
    listed = F.array_join(F.transform(F.array_sort(numbers), lambda n: F.format_string("[%d]", n)), ", ")
    evidence = F.when(F.size(numbers) == 0, none).when(F.size(numbers) == 1, F.replace(F.lit(one), F.lit("{n}"), listed)).otherwise(F.replace(F.lit(several), F.lit("{n}"), listed))
    head = F.replace(F.replace(F.lit(decided), F.lit("{label}"), label), F.lit("{criterion}"), criterion)
    return F.concat_ws(" ", head, F.replace(F.lit(probable), F.lit("{p}"), p), evidence)


def calculation(kind: Column, figures: Column, signs: Column, shape: Column) -> Column:
    """Steps of a check as an array of text, or null: signed sums, shares (``share``), percentages of change (``change``) and differences (``difference``)."""
    a, b = F.get(figures, F.lit(0)), F.get(figures, F.lit(1))
    n = F.size(figures)
    signed = F.transform(figures, lambda f, i: F.concat(F.when(F.get(signs, i) < 0, "− ").when(i == 0, "").otherwise("+ "), f))
    return (
        F.when((n > 0) & (F.size(signs) == n), signed)
        .when((kind == "ratio") & (n == 2) & (shape == "change"), F.array(b, F.concat(F.lit("− "), a), F.concat(F.lit("÷ "), a), F.lit("× 100")))
        .when((kind == "ratio") & (n == 2) & (shape == "share"), F.array(a, F.concat(F.lit("÷ "), b), F.lit("× 100")))
        .when((kind == "derived") & (n == 2) & (shape == "difference"), F.array(a, F.concat(F.lit("− "), b)))
    )
