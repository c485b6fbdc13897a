"""Queries of spans, runs, triples, templates, hierarchies and sheets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checklist, intervals, sheets
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


J16 = """
WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_partkey % 60 AS s, l_partkey % 60 + l_quantity::BIGINT AS e, l_linenumber AS id FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_quantity) * FROM lineitem)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s - e, s, e, id) AS i FROM s),
f AS (SELECT k, i, s, e, id, true AS kept, [{'s': s, 'e': e}] AS got FROM o WHERE i = 1 UNION ALL
  SELECT o.k, o.i, o.s, o.e, o.id, len(list_filter(got, lambda g: g.s < o.e AND o.s < g.e AND NOT (g.s = o.s AND g.e = o.e))) = 0,
    CASE WHEN len(list_filter(got, lambda g: g.s < o.e AND o.s < g.e AND NOT (g.s = o.s AND g.e = o.e))) = 0 THEN list_append(got, {'s': o.s, 'e': o.e}) ELSE got END FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k, s AS start, e AS "end", id FROM f WHERE kept"""


@query(J16)
def j16_longest_spans(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    start = F.col("l_partkey") % 60
    s = li.select(F.col("l_orderkey").alias("k"), F.struct(start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linenumber").alias("id")).alias("s"))
    lists = s.groupBy("k").agg(F.collect_list("s").alias("s"))  # one block's spans
    return lists.select("k", F.explode(intervals.without_overlaps(F.col("s"))).alias("x")).select("k", "x.*")


J18 = """
WITH c AS (SELECT o_custkey AS d, o_orderkey AS r, round(o_totalprice)::BIGINT AS a, o_orderkey % 1000 AS b, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS off FROM orders)
SELECT d AS doc_id, 1 AS now, 2 AS past, 3 AS change, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 3 AND max(off) = 0"""


@query(J18)
def j18_change_triples(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = F.round("o_totalprice").cast("long"), F.col("o_orderkey") % 1000
    off = F.when((F.col("o_custkey") % 3 == 0) & (F.col("o_orderkey") % 2 == 0), 1).otherwise(0)
    cells = F.array(*(F.struct(F.lit(k).alias("column_no"), v.alias("micro")) for k, v in ((1, a), (2, b), (3, a - b + off))))
    return intervals.change_triples(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("row_no"), F.explode(cells).alias("c")).select("doc_id", "row_no", "c.*"))


J21 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, trim(regexp_replace(line, '[0-9]+', '#', 'g')) AS mask FROM l),
d AS (SELECT DISTINCT doc_id, mask FROM t WHERE length(mask) > 30)
SELECT a.doc_id AS doc_id, count(*) AS twins FROM d a JOIN (SELECT mask, doc_id, count(*) OVER (PARTITION BY mask) AS n FROM d) b ON a.mask = b.mask AND a.doc_id <> b.doc_id GROUP BY 1"""


@query(J21)
def j21_template_twins(spark, sf_dir):
    """How many twins each document's lines have, numbers masked: counts by mask, no pairs."""
    line = F.explode(F.split("text", "\n", -1)).alias("line")
    mask = F.trim(F.regexp_replace("line", "[0-9]+", "#"))
    d = table(spark, sf_dir, "documents").select("doc_id", line).select("doc_id", mask.alias("mask")).where(F.length("mask") > 30).distinct()
    n = d.groupBy("mask").agg((F.count("*") - 1).alias("others")).where("others > 0")
    return d.join(n, "mask").groupBy("doc_id").agg(F.sum("others").alias("twins"))


J25 = """SELECT l.doc_id, c.k AS column_no, CASE WHEN c.k = 1 THEN quality ELSE toxic END AS value FROM labels l CROSS JOIN (VALUES (1), (2)) AS c(k)"""


@query(J25)
def j25_cells_of_grid(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array("quality", "toxic"))).alias("column_no", "value"))


W9 = """
WITH r AS (SELECT o_custkey AS k, o_orderkey AS o, o_totalprice AS v, coalesce(o_totalprice < lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), true)::INT AS new FROM orders),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY o ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT k AS o_custkey, min(o) AS first, max(o) AS last, count(*) AS n FROM g GROUP BY k, run HAVING count(*) >= 4"""


@query(W9)
def w9_ascending_runs(spark, sf_dir):
    return intervals.ascending_runs(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@query("""
WITH s AS (SELECT conv_id, list(length(text) ORDER BY turn) AS v FROM conversations GROUP BY 1)
SELECT conv_id, list_min(list_filter(range(2, least(len(v), 12) + 1), lambda k: list_sum(v[len(v) - k + 1:]) = list_sum(v[len(v) - 2:])))::INT AS n FROM s WHERE len(v) >= 3""")
def w12_subtotal_runs(spark, sf_dir):
    """Shortest run at the end of a column that gives the sum of its last three values."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("v")))).alias("s"))
    v = F.transform("s", lambda x: x["v"])
    three = F.aggregate(F.slice(v, -3, 3), F.lit(0).cast("long"), lambda a, x: a + x)
    return c.where(F.size("s") >= 3).select("conv_id", intervals.subtotal(v, three).alias("n"))


D33 = """
WITH RECURSIVE i AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 97 = 1 THEN p_partkey WHEN p_partkey % 50 = 7 THEN -1 ELSE p_partkey - 1 END AS parent, CASE WHEN p_size = 3 THEN ' ' ELSE p_name END AS text FROM part),
t AS (SELECT k, 1 AS depth FROM i WHERE parent IS NULL UNION ALL SELECT i.k, depth + 1 FROM t JOIN i ON i.parent = t.k AND i.k <> i.parent WHERE depth < 3)
SELECT k, issue FROM (
  SELECT k, 'empty_text' AS issue FROM i WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT k, 'self_parent' FROM i WHERE parent = k UNION ALL SELECT k, 'unknown_parent' FROM i WHERE parent IS NOT NULL AND parent NOT IN (SELECT k FROM i)
  UNION ALL SELECT k, 'too_deep' FROM i WHERE k NOT IN (SELECT k FROM t) AND parent IN (SELECT k FROM i) AND parent <> k)"""


@query(D33)
def d33_checklist_issues(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    parent = F.when(k % 10 == 0, F.lit(None)).when(k % 97 == 1, k).when(k % 50 == 7, F.lit(-1)).otherwise(k - 1)
    items = p.select(k.alias("k"), parent.alias("parent"), F.lpad(k.cast("string"), 8, "0").alias("sort"), F.when(F.col("p_size") == 3, " ").otherwise(F.col("p_name")).alias("text"))
    return checklist.issues(items, 3)


S7 = """
SELECT n_name AS file_id, (row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) + 2)::INT AS row_no, (1000 + s_suppkey)::VARCHAR AS account, s_name AS label, (CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE 1 END * round(s_acctbal * 100)::BIGINT * 10000)::VARCHAR AS closing
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0"""


@query(S7)
def s7_trial_balance(spark, sf_dir):
    """One sheet for each nation: a title, a header, an account for each supplier with German amounts and sides."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.where("s_acctbal >= 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("row_no", (F.row_number().over(Window.partitionBy("n_name").orderBy("s_suppkey")) + 2).cast("int"))
    cents = F.round(F.col("s_acctbal") * 100).cast("long")
    grouped = F.translate(F.format_number(F.floor(cents / 100), 0), ",", ".")
    amount = F.concat(grouped, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    side = F.when(F.col("s_suppkey") % 4 == 0, "H").otherwise("S")
    cell = lambda *vs: F.explode(F.array(*(F.struct(F.lit(k).alias("column_no"), v.alias("value")) for k, v in enumerate(vs)))).alias("c")
    body = rows.select(F.col("n_name").alias("file_id"), "row_no", cell((F.col("s_suppkey") + 1000).cast("string"), F.col("s_name"), amount, side)).select("file_id", "row_no", "c.*")
    files = body.select("file_id").distinct()
    head = files.select("file_id", F.lit(2).alias("row_no"), cell(*map(F.lit, ("Konto-Nr.", "Bezeichnung", "Saldo", "S/H")))).select("file_id", "row_no", "c.*")
    title = files.select("file_id", F.lit(1).alias("row_no"), F.lit(0).alias("column_no"), F.lit("Summen und Salden").alias("value"))
    return sheets.trial_balance(body.unionByName(head).unionByName(title)).select("file_id", "row_no", "account", "label", F.col("closing").cast("string").alias("closing"))


U5 = """
WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1)
SELECT k, array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH', '9-NONE'], lambda x: list_contains(p, x))), ',') AS allowed, array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH', '9-NONE'], lambda x: NOT list_contains(p, x))), ',') AS orphans FROM a"""


@query(U5)
def u5_allowed_and_orphans(spark, sf_dir):
    wanted = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "9-NONE")))
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("p"))
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return a.select("k", listed(F.array_intersect(wanted, F.col("p"))).alias("allowed"), listed(F.array_except(wanted, F.col("p"))).alias("orphans"))


U3 = """
SELECT k, arg_min(kind, seq) AS kind FROM (SELECT l_orderkey AS k, 'low' AS kind, 2 AS seq FROM lineitem WHERE l_discount = 0 UNION ALL SELECT l_orderkey, 'high', 1 FROM lineitem WHERE l_quantity = 50 UNION ALL SELECT l_orderkey, 'returned', 3 FROM lineitem WHERE l_returnflag = 'R') GROUP BY k"""


@query(U3)
def u3_families_then_dedupe(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kinds = F.array(*(F.when(c, F.struct(F.lit(n).alias("seq"), F.lit(k).alias("kind"))) for n, k, c in ((2, "low", F.col("l_discount") == 0), (1, "high", F.col("l_quantity") == 50), (3, "returned", F.col("l_returnflag") == "R"))))
    each = li.select(F.col("l_orderkey").alias("k"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x"))
    return each.groupBy("k").agg(F.min("x").alias("x")).select("k", "x.kind")


F8 = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 END AS level, p_name AS label FROM part"""


@query(F8)
def f8_label_numbering(spark, sf_dir):
    from ..functions.lineitems import bare_label, enumeration_level

    marks = F.element_at(F.array(*map(F.lit, ("C. ", "II. ", "12. ", "a) ", "aa) ", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    label = F.concat(marks, "p_name", F.lit(": "))
    return table(spark, sf_dir, "part").select("p_partkey", enumeration_level(label).alias("level"), bare_label(label).alias("label"))


F36 = """SELECT l_orderkey, l_linenumber, replace(format('{:,}', round(l_extendedprice * 100)::BIGINT // 100), ',', '.') || ',' || lpad((round(l_extendedprice * 100)::BIGINT % 100)::VARCHAR, 2, '0') || ' EUR' AS amount FROM lineitem"""


@query(F36)
def f36_german_amounts(spark, sf_dir):
    from ..functions.exact import formatted, whole

    micro = whole(F.round(F.col("l_extendedprice") * 100).cast("long") * 10_000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formatted(micro, 2, " EUR").alias("amount"))


D31 = """
WITH u AS (SELECT conv_id AS doc_id, 'u' || lpad(turn::VARCHAR, 4, '0') AS unit_id, list_transform(range(turn // 3 * 3, turn // 3 * 3 + 3), lambda t: 't' || t) AS block_keys, length(text) % 50 + 5 AS q, turn // 3 AS g FROM conversations),
s AS (SELECT conv_id AS doc_id, turn // 3 AS g, sum(ceil(length(text) / 3.5))::BIGINT AS state_tokens FROM conversations GROUP BY ALL),
e AS (SELECT *, state_tokens + q <= 300 AS fits FROM u JOIN s USING (doc_id, g)), r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, g, fits ORDER BY unit_id) - 1) // 2 AS run FROM e),
b AS (SELECT doc_id, g, run, fits, state_tokens, string_agg(unit_id, ',' ORDER BY unit_id) AS unit_ids, any_value(array_to_string(list_sort(block_keys), ',')) AS block_keys, max(q)::BIGINT AS question_tokens FROM r GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit_ids)::INT AS batch, unit_ids, block_keys, state_tokens, question_tokens, fits FROM b"""


@query(D31)
def d31_batch_plan(spark, sf_dir):
    """Questions over runs of three turns of conversations, two in a batch."""
    from ..functions.text import tokens_estimate
    from ..operators import batches

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    first = (F.floor(F.col("turn") / 3) * 3).cast("int")
    keys = F.transform(F.sequence(first, first + 2), lambda t: F.concat(F.lit("t"), t.cast("string")))
    units = c.select("doc_id", F.concat(F.lit("u"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("unit_id"), keys.alias("block_keys"), (F.length("text") % 50 + 5).cast("long").alias("question_tokens"))
    sizes = c.select("doc_id", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("block_key"), tokens_estimate(F.col("text")).alias("tokens"))
    b = batches.plan(units, sizes, 300, 2)
    return b.select("doc_id", "batch", F.array_join("unit_ids", ",").alias("unit_ids"), F.array_join("block_keys", ",").alias("block_keys"), "state_tokens", "question_tokens", "fits")
