"""URL rules by a cascade of Bloom filters.

A rule is a host and the beginning of a path, written as one key (``net/de/``). The keys
that could match are known for the whole corpus: every host suffix with the beginnings of
the path that have the length of some rule's path. Level 1 encodes the listed keys, level
2 the other corpus keys that level 1 passes wrongly, level 3 the listed keys that level 2
passes wrongly, and so on until none is left. Over the corpus, the first level that
rejects a key then tells exactly whether it is listed, without a join. The tables are
read three times, however many levels there are: for the number of keys, for the false
positives of the first levels, which are kept, and for the verdicts. A cascade whose
levels are too large for a plan gives way to a join with the listed keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .exprs import ascii_lower, let

#: (rule, verdict), fixed values.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Bits of one level that may stand in a plan as a literal; beyond, listed keys are looked up by a join instead.
MOST_BITS = 1 << 18
#: Bits for each key in all levels but the first, whose false positives number about as many as the listed keys.
BITS = 8.0


class TooLarge(Exception):
    """A level of a cascade would take more than the bits that fit in a plan."""


class Cascade:
    """Exact membership for keys of a known universe. Built by Spark; only bits, of bounded number, reach the driver."""

    def __init__(self, listed: DataFrame, most_bits: int):
        """``listed`` has one column ``key``; the first level is for ``open``, the rest for ``close``."""
        self.levels: list[tuple[int, int, list[int]]] = []  # bits, hashes, words
        self.listed, self.most = listed.where("key IS NOT NULL").distinct(), most_bits
        self.n = self.listed.count()

    def open(self, universe: int) -> None:
        """Level 1, so that about as many of ``universe`` keys pass wrongly as are listed."""
        if self.n:
            self._add(self.listed, self.n, max(4.0, 1.44 * math.log2(max(2.0, universe / self.n))))

    def close(self, wrong: DataFrame) -> None:
        """All further levels, from the keys of the universe that level 1 passes wrongly."""
        ins, outs = self.listed, wrong
        while self.n and (n := outs.count()) > 0:
            self._add(outs, n, BITS)
            ins, outs = outs, ins.where(self.passes(F.col("key"), len(self.levels) - 1))

    def _add(self, keys: DataFrame, n: int, bits_per_key: float) -> None:
        size, hashes = 64 * max(1, math.ceil(n * bits_per_key / 64)), max(1, round(bits_per_key * math.log(2)))
        if size > self.most:
            raise TooLarge(f"{size} bits")
        at = F.explode(F.array(*self._positions(F.col("key"), len(self.levels), size, hashes))).alias("at")
        rows = keys.select(at).groupBy(F.expr("at div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect()
        words = [0] * (size // 64)
        for r in rows:
            words[r.w] = r.bits
        self.levels.append((size, hashes, words))

    @staticmethod
    def _positions(key: Column, level: int, size: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(size).cast("long")) for i in range(hashes)]

    def passes(self, key: Column, level: int) -> Column:
        size, hashes, words = self.levels[level]
        bits, out = F.array(*(F.lit(w).cast("long") for w in words)), F.lit(True)
        for p in self._positions(key, level, size, hashes):
            out = out & let(p, lambda p: F.getbit(F.get(bits, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
        return out

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that rejects it decides; odd levels encode listed keys."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self.passes(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def cascades(listed: DataFrame, universe: DataFrame, verdicts: tuple[str, ...], most_bits: int) -> dict[str, Cascade]:
    """One cascade for each verdict over the same universe (column ``key``), which is read twice."""
    own = {v: Cascade(listed.where(F.col("verdict") == v).select("key"), most_bits) for v in verdicts}
    if not any(c.n for c in own.values()):
        return own
    size = universe.agg(F.approx_count_distinct("key", 0.05)).first()[0]
    for c in own.values():
        c.open(size)
    through = F.array_compact(F.array(*(F.when(c.passes(F.col("key"), 0), F.lit(v)) for v, c in own.items() if c.n)))
    passed = universe.select("key", F.explode(through).alias("verdict")).distinct()
    wrong = cut(passed.join(listed, ["key", "verdict"], "left_anti"), "false-positives")
    for v, c in own.items():
        c.close(wrong.where(F.col("verdict") == v).select("key"))
    return own


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null and where ``://`` is missing."""
    shape = "(?s)^.*?://([^/?#]*)([^?#]*)"
    own = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(own, shape, 1)), F.regexp_extract(own, shape, 2)


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule for this URL could have: host suffixes times path beginnings of the given lengths."""
    suffixes = let(F.split(host, "\\."), lambda h: F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_join(F.slice(h, i, F.size(h)), ".")))
    starts = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


def rule_table(spark, rules) -> DataFrame:
    """(key, verdict) of a rule list as a constant of the plan."""
    rows = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("verdict")) for k, v in rules)) if rules else F.array().cast("array<struct<key:string,verdict:string>>")
    return spark.range(1).select(F.inline(rows))


def judge(pages: DataFrame, rules=RULES, url_col: str = "url", id_col: str = "page_id", most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    Of the rules that fit a URL the longest decides (of equal ones the last in order of
    text); without any the verdict is allow, since the cascade holds no key of the URL. A
    null URL and one without ``://`` have empty parts and fit no rule. Repeated rows and
    null ids give one row each; other columns are ignored; an empty table gives no rows.
    Rules too many for the bits of a plan are looked up by a join with the same results.
    """
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    lengths = sorted({len(r) - r.index("/") for r, _ in rules}) or [1]
    candidates = urls.withColumn("keys", keys(F.col("host"), F.col("path"), lengths))
    listed = rule_table(pages.sparkSession, rules)
    try:
        own = cascades(listed, candidates.select(F.explode("keys").alias("key")), ("allow", "block"), most_bits)
    except TooLarge:
        return _joined(urls, candidates, listed)
    verdict = lambda k: F.when(own["allow"].holds(k), "allow").when(own["block"].holds(k), "block")
    fits = F.filter(F.transform("keys", lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), verdict(k).alias("verdict"))), lambda x: x["verdict"].isNotNull())
    best = F.array_max(fits)
    return candidates.select("page_id", "host", "path", best["key"].alias("rule"), F.coalesce(best["verdict"], F.lit("allow")).alias("verdict"))


def _joined(urls: DataFrame, candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """The same verdicts by joins: keys of each different URL with the listed ones, the best with the URLs."""
    each = candidates.select("host", "path", "keys").dropDuplicates(["host", "path"]).select("host", "path", F.explode("keys").alias("key"))
    fit = each.join(listed, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    return urls.join(fit, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def oracle() -> str:
    """The same results as one DuckDB statement over table ``pages``."""
    values = ", ".join(f"('{r}', '{v}')" for r, v in RULES)
    return rf"""
WITH r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM (VALUES {values}) AS v(rule, verdict)),
u AS (
  SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC NULLS LAST, rule DESC) = 1
"""
