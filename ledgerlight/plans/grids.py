"""Queries of the decision grid, model answers and invocation figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import assignment, grid
from ..operators import readmodels as rm
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


D30 = """
WITH RECURSIVE b AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS section, o_orderkey % 50 + 10 AS tokens FROM orders),
a AS (SELECT DISTINCT o_custkey AS doc_id, s AS section, c AS column_no, (o_custkey * 37 + s * 101 + coalesce(c, 9) * 53) % 10 * 1000 AS bp FROM orders, range(8) AS r(s), (VALUES (1), (2), (NULL)) AS v(c) WHERE (o_custkey + s) % 3 <> 0),
r AS (SELECT b.*, cc.c AS column_no, coalesce(x.bp, 4000) AS rel, coalesce(i.bp, 4000) AS inj FROM b CROSS JOIN (VALUES (1), (2)) AS cc(c) LEFT JOIN a x ON x.doc_id = b.doc_id AND x.section = b.section AND x.column_no = cc.c LEFT JOIN a i ON i.doc_id = b.doc_id AND i.section = b.section AND i.column_no IS NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, column_no ORDER BY rel DESC, ordinal) AS i FROM r WHERE rel >= 4000 AND inj < 5000),
f AS (SELECT doc_id, column_no, ordinal, i, CASE WHEN tokens <= 120 THEN tokens ELSE 0 END AS total, tokens <= 120 AS kept FROM o WHERE i = 1 UNION ALL
  SELECT o.doc_id, o.column_no, o.ordinal, o.i, CASE WHEN total + tokens <= 120 THEN total + tokens ELSE total END, total + tokens <= 120 FROM f JOIN o ON o.doc_id = f.doc_id AND o.column_no = f.column_no AND o.i = f.i + 1)
SELECT doc_id, column_no, ordinal, row_number() OVER (PARTITION BY doc_id, column_no ORDER BY ordinal)::INT AS place FROM f WHERE kept"""


@query(D30)
def d30_cell_packets(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    blocks = o.select(F.col("o_custkey").alias("doc_id"), n.alias("ordinal"), F.floor((n - 1) / 4).alias("section"), (F.col("o_orderkey") % 50 + 10).alias("tokens"))
    docs = o.select(F.col("o_custkey").alias("doc_id")).distinct()
    questions = F.array(*(F.lit(c).cast("int") for c in (1, 2, None)))
    asked = docs.select("doc_id", F.explode(F.expr("sequence(0L, 7L)")).alias("section")).where((F.col("doc_id") + F.col("section")) % 3 != 0).select("doc_id", "section", F.explode(questions).alias("column_no"))
    answers = asked.withColumn("bp", (F.col("doc_id") * 37 + F.col("section") * 101 + F.coalesce("column_no", F.lit(9)) * 53) % 10 * 1000)
    columns = spark.range(1, 3).select(F.col("id").cast("int").alias("column_no"))
    return grid.cell_packets(grid.routed(blocks, answers, columns), 120)


D26 = """
SELECT l_orderkey % 200 AS doc_id, l_partkey * 10 + l_linenumber AS figure_id, (row_number() OVER w - 1) // 6 + 1 AS batch, (row_number() OVER w - 1) // 48 + 1 AS chunk
FROM (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey % 200, l_partkey * 10 + l_linenumber ORDER BY l_orderkey) = 1) WINDOW w AS (PARTITION BY l_orderkey % 200 ORDER BY l_partkey * 10 + l_linenumber)"""


@query(D26)
def d26_assignment_batches(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("doc_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("figure_id")).distinct()
    return assignment.batched(li)


D25 = """
WITH f AS (SELECT o_custkey AS doc_id, o_orderkey AS figure_id, o_orderpriority AS item, o_orderkey % 101 * 100 AS bp, round(o_totalprice)::BIGINT AS v FROM orders),
i AS (SELECT doc_id, item, min(v) AS v, count(*) AS n FROM f GROUP BY ALL)
SELECT doc_id, figure_id, CASE WHEN bp < 7000 OR n > 1 THEN 'uncertain' WHEN abs(f.v - i.v) <= 1 THEN 'match' ELSE 'mismatch' END AS status FROM f JOIN i USING (doc_id, item)"""


@query(D25)
def d25_assignment_checks(spark, sf_dir):
    from ..functions.exact import whole

    o = table(spark, sf_dir, "orders").withColumn("v", F.round("o_totalprice").cast("long"))
    named = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("figure_id"), F.lit("current").alias("period"), F.col("o_orderpriority").alias("item"), (F.col("o_orderkey") % 101 * 100).alias("bp"), whole(F.col("v") * 1_000_000).alias("micro"), whole(F.lit(1_000_000)).alias("display_unit"))
    figures = named.drop("item", "bp")
    return assignment.assignment_checks(figures, named.select("doc_id", "figure_id", "item", "bp"), named.select("doc_id", "item", "period", "micro", "display_unit")).select("doc_id", "figure_id", "status")


D27 = """SELECT event_id, least(user_id * 97 % 10001, event_id * 31 % 10001) AS bp, least(user_id * 97 % 10001, event_id * 31 % 10001) >= 8000 AS resolved FROM events"""


@query(D27)
def d27_merged_confidence(spark, sf_dir):
    m = assignment.merged_confidence(F.col("user_id") * 97 % 10001, F.col("event_id") * 31 % 10001)
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", "m.bp", "m.resolved")


F44 = """
SELECT conv_id, sum(ceil(length(text) / 3.5))::BIGINT AS tokens, max(ceil(length(text) / 3.5))::BIGINT AS longest, (32000 - max(ceil(length(text) / 3.5)) - 64)::BIGINT AS state_budget, round(sum(ceil(length(text) / 3.5)) * 0.042, 6) AS cost_microdollars FROM conversations GROUP BY 1"""


@query(F44)
def f44_token_budgets(spark, sf_dir):
    from ..functions.text import tokens_estimate

    n = tokens_estimate(F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(n).alias("tokens"), F.max(n).alias("longest"), (32_000 - F.max(n) - 64).alias("state_budget"), F.round(F.sum(n) * 0.042, 6).alias("cost_microdollars"))


F46 = """
SELECT o_custkey, greatest(10, least(99, 10 + floor(89 * count(*) FILTER (o_orderstatus <> 'P') / count(*))))::BIGINT AS progress, count(*) FILTER (o_orderstatus = 'P') > 0 AS gaps, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'completed_with_gaps' ELSE 'completed' END AS state FROM orders GROUP BY 1"""


@query(F46)
def f46_progress_and_state(spark, sf_dir):
    gaps = F.count_if(F.col("o_orderstatus") == "P")
    done = grid.progress(F.count("*") - gaps, F.count("*"), F.lit(10).cast("long"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(done.cast("long").alias("progress"), (gaps > 0).alias("gaps"), F.when(gaps > 0, "completed_with_gaps").otherwise("completed").alias("state"))


P13 = """
WITH m AS (SELECT event_type AS model, avg(value) AS mean, count(*) FILTER (value > 100) * 1.0 / count(*) AS high, count(DISTINCT user_id) AS users, max(value) AS worst FROM events GROUP BY 1)
SELECT model, users >= 50 AND worst < 100000 AND high <= 0.6 AND mean > 1 AS qualified FROM m"""


@query(P13)
def p13_qualification_gate(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("mean"), (F.count_if(F.col("value") > 100) / F.count("*")).alias("high"), F.count_distinct("user_id").alias("users"), F.max("value").alias("worst"))
    return m.select("model", ((F.col("users") >= 50) & (F.col("worst") < 100_000) & (F.col("high") <= 0.6) & (F.col("mean") > 1)).alias("qualified"))


F66 = """
SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::BIGINT >= 50 AS large FROM events"""


@query(F66)
def f66_json_fields(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k >= 50).alias("large"))


D35 = """
WITH scope AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), cache AS (SELECT c_custkey AS k, c_acctbal > 0 AS valid FROM customer WHERE c_custkey % 3 = 0)
SELECT scope.k AS k, n, CASE WHEN cache.k IS NULL THEN 'miss' WHEN NOT valid THEN 'expired' ELSE 'hit' END AS cache FROM scope LEFT JOIN cache ON scope.k = cache.k"""


@query(D35)
def d35_cache_lookup(spark, sf_dir):
    scope = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    cache = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") > 0).alias("valid"))
    return scope.join(cache, "k", "left").select("k", "n", F.when(F.col("valid").isNull(), "miss").when(~F.col("valid"), "expired").otherwise("hit").alias("cache"))


F60 = """
WITH lines AS (SELECT l_orderkey AS k, string_agg('{"charges":{"2":' || regexp_replace(CAST(round(l_tax, 2) AS VARCHAR), '\\.0$', '') || ',"10":' || regexp_replace(CAST(round(l_discount, 2) AS VARCHAR), '\\.0$', '') || ',"net":' || regexp_replace(CAST(round(l_extendedprice, 2) AS VARCHAR), '\\.0$', '') || '},"n":' || l_linenumber || ',"status":' || to_json(l_linestatus) || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS t FROM lineitem GROUP BY 1)
SELECT o_orderkey AS k, '{"key":' || o_orderkey || ',"lines":[' || t || '],"note":null,"Priority":"' || o_orderpriority || '\\n\\"","total":' || regexp_replace(CAST(round(o_totalprice, 2) AS VARCHAR), '\\.0$', '') || '}' AS text, sha256(text) AS content_hash FROM orders JOIN lines ON k = o_orderkey"""


@query(F60)
def f60_canonical_hash(spark, sf_dir):
    """Orders with their lines (a handful each) as canonical JSON, and its digest: nested lists and objects, whole-number keys, numbers, escapes."""
    li = table(spark, sf_dir, "lineitem")
    two = lambda c: F.round(F.col(c).cast("double"), 2)
    charges = F.struct(two("l_extendedprice").alias("net"), two("l_discount").alias("10"), two("l_tax").alias("2"))
    one = F.struct(F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("n"), charges.alias("charges"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("at")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, one.alias("x")))), lambda e: e["x"]).alias("lines"))
    both = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    whole = F.struct(two("o_totalprice").alias("total"), F.concat("o_orderpriority", F.lit('\n"')).alias("Priority"), F.lit(None).cast("string").alias("note"), "lines", F.col("o_orderkey").alias("key"))
    made = both.select(F.col("o_orderkey").alias("k"), whole.alias("x"))
    text = canonical.canonical(F.col("x"), made.schema["x"].dataType)
    return made.select("k", text.alias("text")).withColumn("content_hash", F.sha2("text", 256))


D38 = """
SELECT o_custkey AS release, sha256(string_agg(o_orderkey || ':' || o_orderpriority, '|' ORDER BY o_orderkey)) AS content_hash FROM orders GROUP BY 1"""


@query(D38)
def d38_release_hash(spark, sf_dir):
    child = F.struct("o_orderkey", F.concat_ws(":", "o_orderkey", "o_orderpriority").alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(child)), lambda x: x["t"])
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("release")).agg(F.sha2(F.array_join(ordered, "|"), 256).alias("content_hash"))


W3 = """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders WHERE o_orderstatus <> 'P'"""


@query(W3)
def w3_renumbered(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.row_number().over(w).alias("number"))


T8 = """SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-02' ORDER BY ts, event_id LIMIT 25"""


@query(T8)
def t8_purge_batch(spark, sf_dir):
    """The next rows to delete: expired ones, oldest first, one batch."""
    return table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).orderBy("ts", "event_id").limit(25).select("event_id", "ts")


S12 = """
SELECT o_orderkey, l_linenumber, o_orderstatus, coalesce(p_name, '') AS label FROM (SELECT * FROM orders WHERE o_totalprice > 450000) JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey"""


@query(S12)
def s12_findings_export(spark, sf_dir):
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    known = p.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return o.where("o_totalprice > 450000").join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(known, "l_partkey", "left").select("o_orderkey", "l_linenumber", "o_orderstatus", F.coalesce("p_name", F.lit("")).alias("label"))


A22 = """SELECT user_id, count(*) AS requests, sum(event_id % 7)::BIGINT AS questions, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 1) AS failed FROM events GROUP BY 1"""


@query(A22)
def a22_batch_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("requests"), F.sum(F.col("event_id") % 7).alias("questions"), rm.percent(F.count_if(F.col("event_type") == "error"), F.count("*")).alias("failed"))
