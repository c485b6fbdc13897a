"""Typed decisions from answers: yes or no, one of several options, a level of a scale.

A column's ``criteria`` is struct(type, options array<struct<key, label>>, levels
array<string>, true_label, false_label); an answer is struct(type, noul, choice, score,
confidence, probabilities map<string, double>). Where they do not fit, the decision is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basis_points(p: Column) -> Column:
    """A probability as basis points, halves up, within 0 and 10,000."""
    return F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 10_000 + 0.5).cast("long")


def _decision(boolean: Column, choice: Column, score: Column, probability: Column, confidence: Column, label: Column) -> Column:
    return F.struct(
        boolean.cast("boolean").alias("answer_boolean"), choice.cast("string").alias("answer_choice"), score.cast("long").alias("answer_score_bp"), probability.cast("long").alias("probability_bp"),
        confidence.cast("long").alias("confidence_bp"), label.cast("string").alias("criterion"),
    )


def _option(criteria: Column, key: Column) -> Column:
    return F.get(F.filter(criteria["options"], lambda o: o["key"] == key), F.lit(0))


def from_answer(criteria: Column, answer: Column) -> Column:
    """The decision of a typed answer; a level is a share of its scale, 0.5 is the least certain yes or no."""
    none = F.lit(None)
    same = lambda t: (criteria["type"] == t) & (answer["type"] == t)
    yes = answer["noul"] >= 0.5
    noul = _decision(yes, none, none, basis_points(F.when(yes, answer["noul"]).otherwise(1 - answer["noul"])), basis_points(F.abs(answer["noul"] - 0.5) * 2), F.when(yes, criteria["true_label"]).otherwise(criteria["false_label"]))
    option = _option(criteria, answer["choice"])
    choice = _decision(none, option["key"], none, basis_points(F.coalesce(F.try_element_at(answer["probabilities"], answer["choice"]), answer["confidence"])), basis_points(answer["confidence"]), option["label"])
    last = F.size(criteria["levels"]) - 1
    level = F.floor(answer["score"] + 0.5).cast("int")
    share = F.when(last == 0, F.lit(0)).otherwise(basis_points(answer["score"] / last))
    score = _decision(none, none, share, basis_points(F.coalesce(F.try_element_at(answer["probabilities"], level.cast("string")), F.lit(0.0))), basis_points(answer["confidence"]), F.get(criteria["levels"], level))
    return F.when(same("noul"), noul).when(same("choice") & option.isNotNull(), choice).when(same("score") & answer["score"].between(0, last), score)


def from_model(criteria: Column, boolean: Column, choice: Column, level: Column, confidence_bp: Column) -> Column:
    """The decision of a model that gave exactly one of three answers, of the column's type, among its options or levels."""
    none = F.lit(None)
    sure = F.least(F.greatest(confidence_bp, F.lit(0)), F.lit(10_000)).cast("long")
    one = sum((c.isNotNull().cast("int") for c in (boolean, choice, level)), F.lit(0)) == 1
    option, last = _option(criteria, choice), F.size(criteria["levels"]) - 1
    share = F.when(last == 0, F.lit(0)).otherwise(basis_points(level / last))
    return (
        F.when(one & (criteria["type"] == "noul") & boolean.isNotNull(), _decision(boolean, none, none, sure, sure, F.when(boolean, criteria["true_label"]).otherwise(criteria["false_label"])))
        .when(one & (criteria["type"] == "choice") & option.isNotNull(), _decision(none, option["key"], none, sure, sure, option["label"]))
        .when(one & (criteria["type"] == "score") & level.between(0, last), _decision(none, none, share, sure, sure, F.get(criteria["levels"], level)))
    )


def state_text(blocks: Column) -> Column:
    """Numbered blocks as one text: ``[1] ...`` and so on."""
    return F.array_join(F.transform(blocks, lambda t, i: F.concat(F.format_string("[%d] ", i + 1), t)), "\n\n")


def lexical_candidates(words: Column, others: Column, most: int = 6, least: int = 6) -> Column:
    """Keys of at most ``most`` entries (array<struct<key, words>>) that share words of ``least`` letters with a text, most shared first."""
    long = F.filter(F.array_distinct(words), lambda w: F.length(w) >= least)
    shared = F.transform(others, lambda o: F.struct((-F.size(F.array_intersect(o["words"], long))).alias("n"), o["key"].alias("key")))
    return F.transform(F.slice(F.array_sort(F.filter(shared, lambda x: x["n"] < 0)), 1, most), lambda x: x["key"])
