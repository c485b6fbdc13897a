"""Secret scans: known shapes, and high-entropy windows of candidate strings.

Candidates are long runs of key characters that hold a digit. A window slides over each;
its Shannon entropy follows from character counts that change by one character in and one
out. A candidate is reported if its best window passes the bound of its character class
and no allow-listed piece occurs in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import let, occurrences, scanned as running

#: Patterns of the known shapes, fixed values; leftmost matches, then the least length holds for group 2 or the match.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WIDTH = 20
#: Character class -> (pattern of the whole candidate, least entropy in bits), first fit wins.
CLASSES = {"hex": ("^([0-9a-f]+|[0-9A-F]+)$", 2.95), "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", 3.65), "base64": ("^[A-Za-z0-9+/_=-]+$", 3.85)}
#: Pieces of well-known harmless strings.
ALLOWED = ("example", "EXAMPLE", "xxxxxxxx", "XXXXXXXX", "0123456789", "1234567890", "abcdefghij", "ABCDEFGHIJ", "deadbeef", "00000000", "placeholder", "changeme")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "entropy")
#: Code points in which a text is cut to be put together again.
PART = 1024


def best_entropy(s: Column, width: int = WIDTH) -> Column:
    """Largest Shannon entropy, in bits, of the windows of ``width`` characters; 0 for shorter strings."""
    part = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)))  # c log c by count
    counts = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    zero = F.struct(counts.alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(codes: Column):
        def moved(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.get(codes, i - width)
            grown = F.transform(acc["n"], lambda x, j: x + F.when(j == enters, 1).otherwise(0) - F.when(j == leaves, 1).otherwise(0))
            plus = F.when(enters == leaves, 0.0).otherwise(
                F.get(part, F.get(acc["n"], enters) + 1) - F.get(part, F.get(acc["n"], enters))
                + F.coalesce(F.get(part, F.get(acc["n"], leaves) - 1) - F.get(part, F.get(acc["n"], leaves)), F.lit(0.0)))
            return let(
                acc["sum"] + plus,
                lambda t: F.struct(grown.alias("n"), t.alias("sum"), F.greatest(acc["best"], F.when(i >= width - 1, F.lit(math.log2(width)) - t / width).otherwise(0.0)).alias("best")),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, moved, lambda acc: acc["best"])

    codes = F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    return F.when(F.length(s) < width, 0.0).otherwise(let(codes, step))


def suspicious(s: Column) -> Column:
    """Whether a candidate holds a digit, no allow-listed piece, and a window beyond its class's bound."""
    bound = F.coalesce(*(F.when(s.rlike(p), F.lit(least)) for p, least in CLASSES.values()))
    allowed = F.lit(False)
    for a in ALLOWED:
        allowed = allowed | s.contains(a)
    return s.rlike("[0-9]") & ~allowed & (best_entropy(s) >= bound)


def spans(text: Column) -> Column:
    """All spans of a text as array<struct<start, kind, end>> by start and kind; kind counts from 0 as in KINDS."""

    def tagged(found: Column, kind: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["s"])).alias("end")))

    def apart(every: Column) -> Column:
        """Of spans in order, the base ones and the others that no base span holds: none before reaches as far."""
        reach = running(F.transform(every, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(-1)), lambda a, b: F.greatest(a, b))
        return let(reach, lambda r: F.filter(every, lambda x, i: (x["kind"] < 3) | (F.get(r, i) < x["end"])))

    def whole(base: Column) -> Column:
        more = F.filter(occurrences(text, CANDIDATE), lambda x: suspicious(x["s"]))
        return let(F.array_sort(F.concat(base, tagged(more, 3))), apart)

    assign = F.filter(occurrences(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.concat(tagged(assign, 0), tagged(occurrences(text, ACCESS), 1), tagged(occurrences(text, HEX), 2))
    return let(base, whole)


def listed(s: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def scanned(docs: DataFrame, text_col: str = "text", out: str = "_spans") -> DataFrame:
    """The rows of ``docs`` with column ``out``: all spans, code points from 0, ends exclusive.

    A null or empty text has none. Rows are scanned one by one: repeated rows and null ids
    are kept apart, other columns are untouched, an empty table gives no rows.
    """
    return docs.withColumn(out, spans(F.coalesce(F.col(text_col), F.lit(""))))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with each maximal run of spans replaced by ``mark``; all other columns are untouched.

    A text with spans is cut into parts of PART code points, and what stands between two
    runs is read from its own parts only. So the work grows with the text and its spans,
    not with their product.
    """
    t = F.col(text_col)
    parts = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))

    def piece(parts: Column, lo: Column, hi: Column) -> Column:
        first = F.floor(lo / PART).cast("int")
        own = F.array_join(F.slice(parts, first + 1, F.floor((hi - 1) / PART).cast("int") - first + 1), "")
        return F.when(hi <= lo, "").otherwise(F.substring(own, lo - first * PART + 1, hi - lo))

    def heads(s: Column, reach: Column) -> Column:
        """(lo, hi) of what stands before each run of spans; a run ends where the furthest span so far ends."""
        before = F.transform(s, lambda x, i: F.struct(F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("lo"), x["start"].alias("hi")))
        return F.filter(before, lambda x, i: (i == 0) | (x["hi"] >= x["lo"]))

    def hidden(s: Column, reach: Column, parts: Column) -> Column:
        shown = F.transform(heads(s, reach), lambda x: F.concat(piece(parts, x["lo"], x["hi"]), F.lit(mark)))
        return F.concat(F.array_join(shown, ""), piece(parts, F.element_at(reach, -1), F.length(t)))

    ends = lambda s: running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    found = let(spans(F.coalesce(t, F.lit(""))), lambda s: F.when(F.size(s) == 0, t).otherwise(let(ends(s), lambda r: let(parts, lambda p: hidden(s, r, p)))))
    return docs.withColumn(text_col, found)


def oracle() -> str:
    """The same results as one DuckDB statement over table ``documents``; each window's entropy from scratch."""
    found = lambda p: f"list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda k: struct_pack(s := list_sum(list_transform(string_split_regex(t, '{p}')[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:k - 1], lambda g: length(g))), 0), x := regexp_extract_all(t, '{p}')[k]))"
    q = lambda p: p.replace("'", "''")
    bound = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN {b}" for p, b in CLASSES.values()) + " END"
    allowed = " OR ".join(f"contains(x, '{a}')" for a in ALLOWED)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT k, 0 AS kind, unnest({found(q(ASSIGN))}, recursive := true) FROM t UNION ALL
  SELECT k, 1, unnest({found(ACCESS)}, recursive := true) FROM t UNION ALL
  SELECT k, 2, unnest({found(HEX)}, recursive := true) FROM t UNION ALL
  SELECT k, 3, unnest({found(CANDIDATE)}, recursive := true) FROM t
), cand AS (
  SELECT k, kind, s::BIGINT AS s, x, (s + length(x))::BIGINT AS e FROM found
), windows AS (
  SELECT DISTINCT x, substr(x, i, {WIDTH}) AS w FROM (SELECT x, unnest(range(1, length(x) - {WIDTH} + 2)) AS i FROM cand WHERE kind = 3 AND regexp_matches(x, '[0-9]') AND NOT ({allowed}))
), entropy AS (
  SELECT x, max(log2({WIDTH}) - sum_clogc / {WIDTH}) AS best FROM (
    SELECT x, w, sum(c * log2(c)) AS sum_clogc FROM (SELECT x, w, ch, count(*) AS c FROM (SELECT x, w, unnest(string_split(w, '')) AS ch FROM windows) GROUP BY x, w, ch) GROUP BY x, w) GROUP BY x
), base AS (
  SELECT k, kind, s, e FROM cand WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(x, '{q(ASSIGN)}', 2)) >= {ASSIGN_LEAST}
), more AS (
  SELECT k, kind, s, e FROM cand JOIN entropy USING (x) WHERE kind = 3 AND best >= {bound}
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.k = cand.k AND b.s <= cand.s AND b.e >= cand.e)
), every AS (SELECT *, ['{"', '".join(KINDS)}'][kind + 1] || ':' || s || ':' || e AS span FROM (FROM base UNION ALL FROM more)),
g AS (
  SELECT k, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
    coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base, string_agg(span, ',' ORDER BY s, kind) AS spans
  FROM every GROUP BY k
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON g.k = t.k
"""
