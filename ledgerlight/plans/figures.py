"""Queries of exact arithmetic and plausibility checks, over report tables derived from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exact
from ..operators import checks
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


UNIT = 1_000_000  # one euro


def report(spark, sf_dir):
    """One table for each customer: a row for each order status, a column for each priority, totals, a cell now and then off by two."""
    o = table(spark, sf_dir, "orders")
    cell = o.groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(F.sum(F.round("o_totalprice").cast("long")).alias("v"))
    row_no = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    parts = cell.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("table_no"), row_no.alias("row_no"), F.substring("o_orderpriority", 1, 1).cast("int").alias("column_no"), F.col("o_orderstatus").alias("label"), F.lit("amount").alias("kind"), F.col("v"))
    off = F.when((F.col("doc_id") % 7 == 0) & (F.col("row_no") == 2), 9).when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    totals = parts.groupBy("doc_id", "table_no", "row_no", "label").agg(F.sum("v").alias("s")).select("doc_id", "table_no", "row_no", F.lit(9).alias("column_no"), "label", F.lit("total").alias("kind"), (F.col("s") + off).alias("v"))
    return parts.unionByName(totals).select("*", F.lit("current").alias("period"), exact.whole(F.col("v") * UNIT).alias("micro"), exact.whole(F.lit(UNIT)).alias("display_unit")).drop("v")


SQL_REPORT = f"""
cell AS (SELECT o_custkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS row_no, left(o_orderpriority, 1)::INT AS column_no, o_orderstatus AS label, sum(round(o_totalprice)::BIGINT)::BIGINT AS v FROM orders GROUP BY ALL),
tot AS (SELECT doc_id, row_no, label, sum(v)::BIGINT + CASE WHEN doc_id % 7 = 0 AND row_no = 2 THEN 9 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS v, sum(v)::BIGINT AS s, count(*) FILTER (v <> 0) AS terms, count(*) AS n FROM cell GROUP BY doc_id, row_no, label)
"""


def _text(df):
    return df.select(*(F.col(c).cast("string").alias(c) if t.startswith("decimal") else c for c, t in df.dtypes))


@query(f"""
WITH {SQL_REPORT}, w AS (SELECT doc_id, max(n) AS width FROM tot GROUP BY 1)
SELECT doc_id, 1 AS table_no, row_no, 9 AS column_no, 'horizontal_sum' AS "check", CASE WHEN abs(v - s) <= greatest(1, terms) THEN 'match' WHEN n = width THEN 'mismatch' ELSE 'uncertain' END AS status,
  (v * {UNIT})::VARCHAR AS actual, (s * {UNIT})::VARCHAR AS expected, (greatest(1, terms) * {UNIT})::VARCHAR AS tolerance, v <> s AND abs(v - s) <= greatest(1, terms) AS rounded
FROM tot JOIN w USING (doc_id)""")
def d11_horizontal_sum(spark, sf_dir):
    return _text(checks.horizontal_sums(report(spark, sf_dir)))


D12 = f"""
WITH y AS (SELECT n_name AS label, n_nationkey AS row_no, n_regionkey AS doc_id, sum(round(o_totalprice)::BIGINT) FILTER (year(o_orderdate) = 1997)::BIGINT AS now, sum(round(o_totalprice)::BIGINT) FILTER (year(o_orderdate) = 1996)::BIGINT AS past
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
c AS (SELECT *, now - past + CASE WHEN row_no % 6 = 0 OR doc_id = 4 THEN 50 ELSE 0 END AS change FROM y WHERE now IS NOT NULL AND past IS NOT NULL)
SELECT doc_id::BIGINT AS doc_id, 1 AS table_no, row_no, 3 AS column_no, 'change_column' AS "check", CASE WHEN change = now - past THEN 'match' ELSE 'mismatch' END AS status, (change * {UNIT})::VARCHAR AS actual, ((now - past) * {UNIT})::VARCHAR AS expected,
  '{2 * UNIT}' AS tolerance, false AS rounded FROM c QUALIFY 2 * count(*) FILTER (change = now - past) OVER (PARTITION BY doc_id) > count(*) OVER (PARTITION BY doc_id)"""


@query(D12)
def d12_change_column(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    year = lambda y: F.sum(F.when(F.year("o_orderdate") == y, F.round("o_totalprice").cast("long")))
    y = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey", "n_name").agg(year(1997).alias("now"), year(1996).alias("past")).where("now IS NOT NULL AND past IS NOT NULL")
    off = F.when((F.col("n_nationkey") % 6 == 0) | (F.col("n_regionkey") == 4), 50).otherwise(0)
    kinds = F.array(*(F.struct(F.lit(k).alias("column_no"), F.lit(kind).alias("kind"), F.lit(p).alias("period"), v.alias("v")) for k, kind, p, v in ((1, "amount", "current", F.col("now")), (2, "amount", "prior", F.col("past")), (3, "change", None, F.col("now") - F.col("past") + off))))
    cells = y.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit(1).alias("table_no"), F.col("n_nationkey").alias("row_no"), F.col("n_name").alias("label"), F.explode(kinds).alias("x")).select("doc_id", "table_no", "row_no", "label", "x.*")
    return _text(checks.change_columns(cells.select("*", exact.whole(F.col("v") * UNIT).alias("micro"), exact.whole(F.lit(UNIT)).alias("display_unit"))))


D13 = f"""
WITH t AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row_no, CASE WHEN event_type = 'view' THEN 'assets' WHEN event_type = 'click' THEN 'liabilities' END AS side, round(value)::BIGINT AS v FROM events WHERE event_type IN ('view', 'click')),
a AS (SELECT *, last_value(CASE WHEN side = 'assets' THEN v END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM t)
SELECT doc_id, row_no::INT AS row_no, CASE WHEN abs(v - a) <= 1 THEN 'match' ELSE 'mismatch' END AS status, (a * {UNIT})::VARCHAR AS expected FROM a WHERE side = 'liabilities' AND a IS NOT NULL"""


@query(D13)
def d13_balance(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    side = F.when(F.col("event_type") == "view", "assets").otherwise("liabilities")
    t = e.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("table_no"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("row_no"), F.lit(1).alias("column_no"), F.lit("current").alias("period"), side.alias("side"), exact.whole(F.round("value").cast("long") * UNIT).alias("micro"), exact.whole(F.lit(UNIT)).alias("display_unit"))
    return _text(checks.balances(t).select("doc_id", "row_no", "status", "expected"))


D29 = f"""
WITH {SQL_REPORT}, w AS (SELECT doc_id, max(n) AS width FROM tot GROUP BY 1), c AS (
  SELECT doc_id, row_no, 2 AS seq, 'horizontal_sum' AS "check", CASE WHEN abs(v - s) <= greatest(1, terms) THEN 'match' WHEN n = width THEN 'mismatch' ELSE 'uncertain' END AS status FROM tot JOIN w USING (doc_id)
  UNION ALL SELECT doc_id, row_no, 1, 'limit', CASE WHEN v > 1000000 THEN 'uncertain' ELSE 'match' END FROM tot)
SELECT doc_id, row_no, arg_max("check", (CASE status WHEN 'mismatch' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END) * 10 - seq) AS "check", arg_max(status, (CASE status WHEN 'mismatch' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END) * 10 - seq) AS status,
  row_number() OVER (PARTITION BY doc_id ORDER BY row_no)::INT AS finding FROM c GROUP BY doc_id, row_no HAVING max(CASE status WHEN 'mismatch' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END) > 0"""


@query(D29)
def d29_findings(spark, sf_dir):
    cells = report(spark, sf_dir)
    sums = checks.horizontal_sums(cells).withColumn("seq", F.lit(2))
    limit = cells.where("kind = 'total'").select(*checks.PLACE, F.lit("limit").alias("check"), F.when(F.col("micro") > 1_000_000 * UNIT, "uncertain").otherwise("match").alias("status"), F.col("micro").alias("actual"), F.col("micro").alias("expected"), exact.whole(F.lit(0)).alias("tolerance"), F.lit(False).alias("rounded"), F.lit(1).alias("seq"))
    return checks.findings(limit.unionByName(sums)).select("doc_id", "row_no", "check", "status", "finding")


D22 = f"""
WITH a AS (SELECT s_nationkey % 5 AS doc_id, sum((round(s_acctbal * 100)::BIGINT) * 10000)::BIGINT AS total FROM supplier GROUP BY 1),
f AS (SELECT doc_id, (total // 1000000000 + CASE WHEN doc_id = 2 THEN 3 ELSE 0 END) * 1000000000 AS micro, total FROM a)
SELECT doc_id::BIGINT AS doc_id, CASE WHEN abs(micro - total) <= 1000000000 THEN 'match' ELSE 'mismatch' END AS status, micro::VARCHAR AS actual, total::VARCHAR AS expected FROM f"""


@query(D22)
def d22_evidence(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("doc_id", (F.col("s_nationkey") % 5).cast("long"))
    accounts = s.select("doc_id", F.lit("liquide_mittel").alias("item"), exact.whole(F.round(F.col("s_acctbal") * 100).cast("long") * 10_000).alias("closing"))
    total = accounts.groupBy("doc_id").agg(F.sum("closing").alias("t"))
    thousands = F.floor(F.col("t") / 1_000_000_000) + F.when(F.col("doc_id") == 2, 3).otherwise(0)
    cells = total.select("doc_id", F.lit(1).alias("table_no"), F.lit(1).alias("row_no"), F.lit(1).alias("column_no"), F.lit("I. Liquide Mittel:").alias("label"), F.lit("current").alias("period"), F.lit("amount").alias("kind"), exact.whole(thousands * 1_000_000_000).alias("micro"), exact.whole(F.lit(1_000_000_000)).alias("display_unit"))
    return _text(checks.evidence(cells, accounts).select("doc_id", "status", "actual", "expected"))


F34 = """
WITH v AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::HUGEINT * 10000 AS a, round(l_quantity * l_discount * 5000)::HUGEINT * 1000000 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(a - b) <= 100000000 THEN 'match' ELSE 'mismatch' END AS status, (a - b)::VARCHAR AS difference,
  (CASE WHEN b <> 0 THEN ((a * 100000000 * 2 + b) // (b * 2)) END)::VARCHAR AS ratio, (((a + 500000000) // 1000000000) * 1000000000)::VARCHAR AS rounded, CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' ELSE 'flat' END AS direction FROM v"""


@query(F34)
def f34_exact_arithmetic(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    v = li.select("l_orderkey", "l_linenumber", exact.whole(F.round(F.col("l_extendedprice") * 100).cast("long") * 10_000).alias("a"), exact.whole(F.round(F.col("l_quantity") * F.col("l_discount") * 5000).cast("long") * 1_000_000).alias("b"))
    c = exact.compared(F.col("a"), F.lit(100_000_000), F.col("b"), F.lit(1))
    return v.select(
        "l_orderkey", "l_linenumber", c["status"].alias("status"), c["difference"].cast("string").alias("difference"), exact.ratio_percent(F.col("a"), F.col("b")).cast("string").alias("ratio"),
        exact.round_to(F.col("a"), F.lit(1_000_000_000)).cast("string").alias("rounded"), exact.direction(F.col("a"), F.col("b")).alias("direction"),
    )


J19_CLASSES = f"""
WITH e AS (SELECT l_suppkey AS doc_id, year(l_shipdate) * 100 + month(l_shipdate) AS key, l_orderkey AS ordinal, l_linenumber AS start, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * ((l_quantity::BIGINT % 3) * 5 + l_linenumber % 2) AS v FROM lineitem),
c AS (SELECT doc_id, key, v, count(*) AS n, min((ordinal, start)) AS f, max((ordinal, start)) AS l FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY n DESC, f, l, v) AS i, count(*) OVER (PARTITION BY doc_id, key) AS classes, (sum(n) OVER (PARTITION BY doc_id, key))::BIGINT AS statements FROM c),
b AS (SELECT e.*, a.n, a.v AS lv, a.f AS lf, a.l AS ll, z.v AS zv, z.f AS zf, a.classes, a.statements, e.v = a.v AND (e.ordinal, e.start) = a.f AS heads FROM e JOIN r a ON a.doc_id = e.doc_id AND a.key = e.key AND a.i = 1 JOIN r z ON z.doc_id = e.doc_id AND z.key = e.key AND z.i = z.classes WHERE a.statements > 1),
x AS (SELECT *, CASE WHEN heads AND n = 1 THEN zv ELSE lv END AS w, CASE WHEN heads AND n = 1 THEN zf WHEN heads THEN ll ELSE lf END AS o FROM b)
SELECT doc_id, key::BIGINT AS key, ordinal, start, CASE WHEN abs(v - w) <= 1 THEN 'match' ELSE 'mismatch' END AS status, CASE WHEN abs(v - w) <= 1 THEN 'reference_matches' WHEN abs(abs(v) - abs(w)) <= 1 THEN 'reference_sign' ELSE 'reference_differs' END AS code,
  v <> w AND abs(v - w) <= 1 AS rounded, ((v - w)::BIGINT * {UNIT})::VARCHAR AS difference, o[1] AS other_ordinal, o[2] AS other_start, classes, statements FROM x"""


@query(J19_CLASSES)
def j19_dated_amounts(spark, sf_dir):
    """What several places say of one month: each against the leading value, by classes of equal values and not by pairs."""
    from ..operators import prose

    li = table(spark, sf_dir, "lineitem")
    v = F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * (F.col("l_quantity").cast("long") % 3 * 5 + F.col("l_linenumber") % 2)
    key = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long")
    entries = li.select(F.col("l_suppkey").alias("doc_id"), key.alias("key"), F.lit("EUR").alias("unit"), F.col("l_orderkey").alias("ordinal"), F.col("l_linenumber").alias("start"), exact.whole(v * UNIT).alias("micro"), exact.whole(F.lit(UNIT)).alias("display_unit"))
    return prose.dated_amounts(entries).select("doc_id", "key", "ordinal", "start", "status", "code", "rounded", F.col("difference").cast("string").alias("difference"), "other_ordinal", "other_start", "classes", "statements")
