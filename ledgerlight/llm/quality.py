"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one figure of a text and votes good (1), bad (-1) or abstains (0). The
patterns of votes over the whole corpus, at most 3 to the number of rules, are counted;
from these counts alone the accuracies of the rules and the share of good texts are
estimated. A text stays if its posterior probability of being good is one half or more.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name
from .exprs import WHITE, let, words

#: Rules: name -> (good if, bad if), as SQL over the figures of a text.
RULES = {
    "length": ("n_words >= 100", "n_words < 50"),
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "2 * word_chars < 5 * n_words OR word_chars > 14 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "lines": ("n_dup_lines = 0", "3 * n_dup_lines > n_lines"),
    "repeats": ("10 * n_repeat_words <= n_words", "100 * n_repeat_words > 35 * n_words"),
    "letters": ("5 * n_letters >= 4 * word_chars", "5 * n_letters < 3 * word_chars"),
}
#: Fails whatever the votes say.
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
ROUNDS, FIRST_ACCURACY, FIRST_SHARE = 30, 0.8, 0.8
#: Accuracies stay in these limits: a rule is better than chance and never certain.
LEAST, MOST = 0.55, 0.99
SHARE_LEAST, SHARE_MOST = 0.05, 0.95


def repeated_words(w: Column) -> Column:
    """How many words lie in three-word windows that the text holds twice or more."""

    def covered(tri: Column) -> Column:
        tagged = F.array_sort(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        starts = lambda s: F.array_sort(F.transform(again(s), lambda x: x["i"]))
        count = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(tri)) == F.size(tri), 0).otherwise(let(tagged, lambda s: let(starts(s), count)))

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    triples = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))
    return F.when(F.size(w) < 3, 0).otherwise(let(hashed, lambda h: let(triples(h), covered)))


def figures(text: Column) -> Column:
    """All figures of one text as a struct; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, WHITE, "") != "")
    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            F.size(full).cast("long").alias("n_lines"),
            (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.length(F.regexp_replace(t, "[\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]+", "")).cast("long").alias("n_letters"),
        ),
    )


def votes(of: str = "") -> list[Column]:
    own = lambda sql: re.sub(r"(?=\b(n_|word_chars))", of, sql)
    return [F.expr(f"CASE WHEN {own(bad)} THEN -1 WHEN {own(good)} THEN 1 ELSE 0 END").alias(f"v_{name}") for name, (good, bad) in RULES.items()]


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[float]]:
    """Share of good texts and accuracy of each rule from counted vote patterns, by expectation-maximisation."""
    share, acc = FIRST_SHARE, [FIRST_ACCURACY] * len(RULES)
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        good = [1 / (1 + math.exp(-(logit(share) + sum(v * logit(a) for v, a in zip(p, acc))))) for p, _ in patterns]
        share = min(SHARE_MOST, max(SHARE_LEAST, sum(n * q for (_, n), q in zip(patterns, good)) / total))
        for j in range(len(acc)):
            voted = sum(n for p, n in patterns if p[j])
            right = sum(n * (q if p[j] > 0 else 1 - q) for (p, n), q in zip(patterns, good) if p[j])
            acc[j] = min(MOST, max(LEAST, right / voted)) if voted else FIRST_ACCURACY
    return share, acc


def judged(docs: DataFrame, text_col: str = "text", out: str = "_q", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with column ``out``: figures, base_failed, posterior and kept.

    A null or empty text has all figures 0 and fails the base rule. Rows are judged one by
    one: repeated rows and null ids are kept apart, other columns are untouched (but one of
    the name ``out``), an empty table gives no rows. With ``keep`` only those columns are
    returned and written in between, not the texts.
    """
    got = cut(docs.withColumn(out, figures(F.col(text_col))).select(*(docs.columns if keep is None else keep), out), "quality")
    counted = got.select(f"{out}.*").groupBy(*votes()).count().collect()  # 3 to the number of rules at most
    share, acc = estimate([(tuple(r[f"v_{n}"] for n in RULES), r["count"]) for r in counted])
    score = F.lit(logit(share))
    for vote, a in zip(votes(f"{out}."), acc):
        score = score + vote * F.lit(logit(a))
    failed = F.expr(BASE.replace("n_", f"{out}.n_"))
    return got.withColumn(out, F.col(out).withField("base_failed", failed).withField("posterior", 1 / (1 + F.exp(-score))).withField("kept", ~failed & (score >= 0)))


def filtered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, without further columns; see ``judged``."""
    own = free_name(docs, "_q")
    return judged(docs, text_col, own).where(F.col(own)["kept"]).select(*docs.columns)


def oracle() -> str:
    """The same results as one DuckDB statement over table ``documents``, the estimation as a recursion."""
    names = list(RULES)
    case = lambda n: f"CASE WHEN {RULES[n][1]} THEN -1 WHEN {RULES[n][0]} THEN 1 ELSE 0 END"
    clip = lambda x, a, b: f"least({b}, greatest({a}, {x}))"
    score = "ln(share / (1 - share)) + " + " + ".join(f"v_{n} * ln(a_{n} / (1 - a_{n}))" for n in names)
    return rf"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, regexp_extract_all(t, '[^ \t-\r]+') AS w FROM t
), tri AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), again AS (
  SELECT k, i FROM tri QUALIFY count(*) OVER (PARTITION BY k, x) > 1
), covered AS (
  SELECT k, count(DISTINCT i + j) AS n FROM again, range(3) AS r(j) GROUP BY k
), f AS (
  SELECT t.k, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')))::BIGINT AS n_lines,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')))::BIGINT
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]'))))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[\x00-\x40\x5b-\x60\x7b-\x7f]+', '', 'g')) AS n_letters
  FROM t JOIN w ON w.k = t.k LEFT JOIN covered ON covered.k = t.k
), v AS (
  SELECT *, {", ".join(f"{case(n)} AS v_{n}" for n in names)} FROM f
), p AS (
  SELECT {", ".join(f"v_{n}" for n in names)}, count(*) AS n FROM v GROUP BY ALL
), em AS (
  SELECT 0 AS i, {FIRST_SHARE}::DOUBLE AS share, {", ".join(f"{FIRST_ACCURACY}::DOUBLE AS a_{n}" for n in names)}
  UNION ALL
  SELECT i + 1, {clip("sum(n * q) / sum(n)", SHARE_LEAST, SHARE_MOST)},
    {", ".join(f"coalesce({clip(f'sum(n * CASE v_{n} WHEN 1 THEN q WHEN -1 THEN 1 - q ELSE 0 END) / nullif(sum(n * abs(v_{n})), 0)', LEAST, MOST)}, {FIRST_ACCURACY})" for n in names)}
  FROM (SELECT em.*, p.*, 1 / (1 + exp(-({score}))) AS q FROM em, p WHERE i < {ROUNDS}) GROUP BY i
), last AS (SELECT * FROM em WHERE i = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE}) AS base_failed, NOT ({BASE}) AND {score} >= 0 AS kept
FROM v, last
"""
