"""Queries of the relational read model: joins, aggregates, windows, sorts, sets, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import readmodels as rm
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _t(*names):
    return lambda spark, sf_dir: [table(spark, sf_dir, n) for n in names]


def micros(c):
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


cents = lambda c: F.round(F.col(c) * 100).cast("long")


# Joins

@query("""SELECT l_orderkey, l_linenumber, o_orderstatus, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE l_quantity >= 49""")
def j1_inner_then_left(spark, sf_dir):
    li, o, c = _t("lineitem", "orders", "customer")(spark, sf_dir)
    known = c.where("c_acctbal > 0").select("c_custkey", "c_name")
    return li.where("l_quantity >= 49").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name")


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(max(o_orderstatus), 'pending') AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY c_custkey""")
def j2_pending_rows_kept(spark, sf_dir):
    c, o = _t("customer", "orders")(spark, sf_dir)
    big = o.where("o_totalprice > 400000").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("s"))
    return c.join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("s", F.lit("pending")).alias("status"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total_cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def j3_star(spark, sf_dir):
    o, c, n, r = _t("orders", "customer", "nation", "region")(spark, sf_dir)
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total_cents"))
    )


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.n FROM lineitem a LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE a.l_returnflag = 'N'""")
def j4_two_keys_left(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    back = li.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return li.where("l_returnflag = 'N'").join(back, ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "n")


@query("""SELECT n_name, s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal < 1000""")
def j5_inner_chain(spark, sf_dir):
    s, n, r = _t("supplier", "nation", "region")(spark, sf_dir)
    return s.where("s_acctbal < 1000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "s_suppkey", "r_name")


@query("""SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0""")
def j6_left_with_literal(spark, sf_dir):
    d, lab = _t("documents", "labels")(spark, sf_dir)
    return d.select("doc_id", "lang").join(lab.where("toxic = 0").select("doc_id", "quality"), "doc_id", "left")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def j7_anti(spark, sf_dir):
    c, o = _t("customer", "orders")(spark, sf_dir)
    return c.join(o.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT d.doc_id, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL""")
def j8_open_items(spark, sf_dir):
    d, lab = _t("documents", "labels")(spark, sf_dir)
    return d.join(lab, "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)""")
def j9_semi(spark, sf_dir):
    o, c = _t("orders", "customer")(spark, sf_dir)
    return o.join(c.where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40) AS n_large FROM part""")
def j10_scalar_subquery(spark, sf_dir):
    p, li = _t("part", "lineitem")(spark, sf_dir)
    n = li.where("l_quantity > 40").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return p.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n_large"))


@query("""SELECT s_suppkey, r_regionkey, (s_nationkey = n_nationkey)::BOOLEAN AS home FROM supplier, (SELECT r_regionkey, min(n_nationkey) AS n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)""")
def j11_grid_cells(spark, sf_dir):
    """Every document of a run with every column: the columns of a run are a bounded table."""
    s, r, n = _t("supplier", "region", "nation")(spark, sf_dir)
    columns = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.min("n_nationkey").alias("n_nationkey"))
    listed = columns.agg(F.collect_list(F.struct("r_regionkey", "n_nationkey")).alias("cols"))  # one row for the run
    return s.join(F.broadcast(listed)).select("s_suppkey", "s_nationkey", F.explode("cols").alias("c")).select("s_suppkey", "c.r_regionkey", (F.col("s_nationkey") == F.col("c.n_nationkey")).alias("home"))


@query("""SELECT a.conv_id, a.turn, b.turn AS neighbour, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND (b.turn = a.turn - 1 OR b.turn = a.turn + 1) WHERE a.role = 'assistant'""")
def j13_neighbours(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    near = c.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("neighbour"))
    return near.join(c.select("conv_id", F.col("turn").alias("neighbour"), "role"), ["conv_id", "neighbour"]).select("conv_id", "turn", "neighbour", "role")


@query("""SELECT p.event_id, p.user_id, v.event_id AS last_view, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN LATERAL (SELECT event_id, value FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts < p.ts ORDER BY v.ts DESC LIMIT 1) v ON true""")
def j14_as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("last_view"), F.col("value").alias("view_value"))
    return rm.best_as_of(buys, views, ["user_id"], "ts", "view_ts", ["last_view", "view_value"]).select("event_id", "user_id", "last_view", "view_value")


J15 = """
WITH s AS (SELECT l_orderkey AS k, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT l_orderkey, l_linenumber, lo, hi FROM lineitem JOIN s ON l_orderkey = k AND l_linenumber >= lo AND l_linenumber <= hi WHERE l_returnflag <> 'A'"""


@query(J15)
def j15_contained_spans(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    s = li.where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    return li.where("l_returnflag <> 'A'").join(s, "l_orderkey").where("l_linenumber BETWEEN lo AND hi").select("l_orderkey", "l_linenumber", "lo", "hi")


J17 = """
SELECT a.event_id, b.event_id AS nearest FROM (SELECT * FROM events WHERE event_type = 'error') a JOIN (SELECT * FROM events WHERE event_type = 'click') b
ON a.user_id = b.user_id AND abs(a.event_id - b.event_id) <= 90 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.event_id - b.event_id), b.event_id) = 1"""


@query(J17)
def j17_nearest_within(spark, sf_dir):
    """Nearest row within 90: both sides meet in bands of that width, each row on the right in its band and the next ones."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    a = e.where("event_type = 'error'").withColumn("band", F.expr("event_id div 90"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("nearest"), F.explode(F.expr("array(event_id div 90 - 1, event_id div 90, event_id div 90 + 1)")).alias("band"))
    gap = F.abs(F.col("event_id") - F.col("nearest"))
    return rm.latest(a.join(b, ["user_id", "band"]).where(gap <= 90), ["event_id"], [gap, F.col("nearest")]).select("event_id", "nearest")


J19 = """SELECT a.o_custkey, a.o_orderkey AS first_key, b.o_orderkey AS second_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey"""


@query(J19)
def j19_pairs_of_one_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("first_key"))
    b = o.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("second_key"))
    return a.join(b, ["o_custkey", "o_orderdate"]).where("first_key < second_key").select("o_custkey", "first_key", "second_key")


J20 = """
WITH p AS (SELECT p_name, min(p_size) AS size FROM part WHERE p_type = 'ECONOMY' GROUP BY 1 HAVING min(p_size) = max(p_size))
SELECT p_partkey, part.p_name, size AS prior_size FROM part JOIN p USING (p_name) WHERE p_type <> 'ECONOMY'"""


@query(J20)
def j20_unique_label_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    agreed = p.where("p_type = 'ECONOMY'").groupBy("p_name").agg(F.min("p_size").alias("prior_size"), F.max("p_size").alias("hi")).where("prior_size = hi").drop("hi")
    return p.where("p_type <> 'ECONOMY'").join(agreed, "p_name").select("p_partkey", "p_name", "prior_size")


J20_BRANDS = """
WITH p AS (SELECT p_name, p_brand, min(p_size) AS size FROM part WHERE p_type = 'ECONOMY' GROUP BY ALL HAVING min(p_size) = max(p_size))
SELECT p_partkey, part.p_name, p_brand, size AS prior_size FROM part JOIN p USING (p_name, p_brand) WHERE p_type <> 'ECONOMY'"""


@query(J20_BRANDS)
def j20_unique_labels_of_brands(spark, sf_dir):
    """As ``j20_unique_label_join`` by name and brand, where many labels stand once."""
    p = table(spark, sf_dir, "part")
    agreed = p.where("p_type = 'ECONOMY'").groupBy("p_name", "p_brand").agg(F.min("p_size").alias("prior_size"), F.max("p_size").alias("hi")).where("prior_size = hi").drop("hi")
    return p.where("p_type <> 'ECONOMY'").join(agreed, ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_brand", "prior_size")


#: Rules for labels, first match wins.
LABEL_RULES = (("steel", "steel|metal"), ("small", "^small"), ("ring", "ring$"), ("rest", "."))


J22 = f"""
SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(p_name, '{p}') THEN '{k}'" for k, p in LABEL_RULES)} END AS item FROM part"""


@query(J22)
def j22_first_matching_rule(spark, sf_dir):
    """Rules stand as expressions on the distinct labels, so that no pair of row and rule is built."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    labels = p.select("p_name").distinct()
    item = F.coalesce(*(F.when(F.col("p_name").rlike(pattern), F.lit(k)) for k, pattern in LABEL_RULES))
    return p.join(labels.withColumn("item", item), "p_name").select("p_partkey", "item")


J24 = """
WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role FROM conversations),
b AS (SELECT conv_id, turn + 1 AS i, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM conversations)
SELECT conv_id, bool_and(coalesce(a.role = b.role, false)) AS same, count(*) AS n FROM a FULL JOIN b USING (conv_id, i) GROUP BY conv_id"""


@query(J24)
def j24_zip_with_guard(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("i"), "role")
    b = c.select("conv_id", (F.col("turn") + 1).alias("i"), F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("expected"))
    return a.join(b, ["conv_id", "i"], "full_outer").groupBy("conv_id").agg(F.bool_and(F.coalesce(F.col("role") == F.col("expected"), F.lit(False))).alias("same"), F.count("*").alias("n"))


J26 = """
SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN l_linestatus <> o_orderstatus THEN 'different' ELSE 'same' END AS state
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') ON l_orderkey = o_orderkey"""


@query(J26)
def j26_validated_lookup(spark, sf_dir):
    li, o = _t("lineitem", "orders")(spark, sf_dir)
    known = o.where("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_orderstatus")
    state = F.when(F.col("o_orderkey").isNull(), "unknown").when(F.col("l_linestatus") != F.col("o_orderstatus"), "different").otherwise("same")
    return li.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", state.alias("state"))


J27 = """
WITH w AS (SELECT user_id, date_trunc('week', ts) AS week, max(CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 2 ELSE 1 END) AS rank FROM events GROUP BY ALL)
SELECT user_id, a.week AS week, a.rank AS rank, b.rank AS next_rank FROM w a JOIN w b USING (user_id) WHERE b.week = a.week + INTERVAL 7 DAY AND a.rank <> b.rank"""


@query(J27)
def j27_changed_between_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "view", 2).otherwise(1)
    w = e.groupBy("user_id", F.date_trunc("week", "ts").alias("week")).agg(F.max(rank).alias("rank"))
    n = w.select("user_id", (F.col("week") - F.expr("INTERVAL 7 DAYS")).alias("week"), F.col("rank").alias("next_rank"))
    return w.join(n, ["user_id", "week"]).where("rank <> next_rank").select("user_id", "week", "rank", "next_rank")


# Aggregates

@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def a2_count_by_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS gaps, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY 1""")
def a3_filtered_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(s == "F").alias("gaps"), F.count_if(s == "O").alias("open"))


A4 = """SELECT source, count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars, coalesce(sum(length(text)), 0) >= greatest(80, 20 * count(*)) AS covered FROM documents GROUP BY 1"""


@query(A4)
def a4_text_coverage(spark, sf_dir):
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), chars.alias("chars"), (chars >= F.greatest(F.lit(80), 20 * F.count("*"))).alias("covered"))


@query("""SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_id FROM orders GROUP BY 1""")
def a5_next_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_id"))


A6 = """
SELECT event_type, count(*) AS n, sum(round(value * 100)::BIGINT) FILTER (WHERE value > 50)::BIGINT AS large_cents, round(100.0 * count(*) FILTER (WHERE value > 50) / nullif(count(*) FILTER (WHERE value > 10), 0), 1) AS share
FROM events GROUP BY 1"""


@query(A6)
def a6_kpi_by_mode(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.when(v > 50, cents("value"))).alias("large_cents"), rm.percent(F.count_if(v > 50), F.count_if(v > 10)).alias("share")
    )


A7 = """
SELECT user_id, CASE WHEN bool_and(value < 250) THEN epoch_us(max(ts)) - epoch_us(min(ts)) END AS span_us, epoch_us(min(ts) FILTER (WHERE event_type = 'purchase')) - epoch_us(min(ts)) AS first_us
FROM events GROUP BY 1"""


@query(A7)
def a7_first_and_last_latency(spark, sf_dir):
    us = micros("ts")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.when(F.bool_and(F.col("value") < 250), F.max(us) - F.min(us)).alias("span_us"),
        (F.min(F.when(F.col("event_type") == "purchase", us)) - F.min(us)).alias("first_us"),
    )


A9 = """
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, y AS report_year FROM y QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, y DESC) = 1"""


@query(A9)
def a9_mode_with_ties(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return years.groupBy("o_custkey").agg(F.max_by("y", F.struct("n", "y")).cast("long").alias("report_year"))


@query("""SELECT l_partkey, list_sort(list(l_quantity))[(floor(count(*) / 2) + 1)::INT] AS median FROM lineitem GROUP BY 1""")
def a10_upper_median(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(rm.upper_median("l_quantity").alias("median"))


@query("""SELECT l_partkey, bool_and(l_tax = (SELECT min(b.l_tax) FROM lineitem b WHERE b.l_partkey = a.l_partkey)) AS agree, count(*) AS n FROM lineitem a GROUP BY 1""")
def a13_all_agree(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.min("l_tax") == F.max("l_tax")).alias("agree"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber AS best_line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_extendedprice DESC, l_linenumber) = 1""")
def a14_best_of_group(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_discount", -F.col("l_extendedprice"), "l_linenumber")).alias("best_line"))


A15 = """
SELECT o_custkey, o_orderkey AS worst_key, o_orderstatus AS worst FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END DESC, o_orderkey) = 1"""


@query(A15)
def a15_worst_first_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rank = rm.worst_first(F.col("o_orderstatus"), ("O", "P", "F"))
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct(rank, -F.col("o_orderkey"))).alias("x")).select("o_custkey", F.col("x.o_orderkey").alias("worst_key"), F.col("x.o_orderstatus").alias("worst"))


A18 = """
SELECT l_suppkey, sum(round(l_extendedprice * 1000000)::DECIMAL(38,0))::DECIMAL(38,0)::VARCHAR AS micro, count(*) FILTER (WHERE l_extendedprice <> 0) AS terms, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags
FROM lineitem GROUP BY 1"""


@query(A18)
def a18_balances_and_lists(spark, sf_dir):
    from ..functions.exact import amount

    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum(amount(F.col("l_extendedprice"))).cast("decimal(38,0)").cast("string").alias("micro"), F.count_if(F.col("l_extendedprice") != 0).alias("terms"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags")
    )


@query("""SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY ALL""")
def a20_first_of_composite_key(spark, sf_dir):
    return rm.first_wins(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("first_key"))


A21 = """
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), d AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1)
SELECT source, line, count(DISTINCT doc_id) AS n FROM l JOIN d USING (source) WHERE trim(line) <> '' GROUP BY source, line, docs HAVING count(DISTINCT doc_id) >= greatest(3, ceil(docs * 0.04))"""


@query(A21)
def a21_repeated_margin_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select("source", "doc_id", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where(F.trim("line") != "")
    docs = d.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"))
    return lines.groupBy("source", "line").agg(F.count_distinct("doc_id").alias("n")).join(docs, "source").where(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("docs") * 0.04))).select("source", "line", "n")


A23 = """
SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS missing, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS extra"""


@query(A23)
def a23_set_equality(spark, sf_dir):
    o, li = _t("orders", "lineitem")(spark, sf_dir)
    both = o.select(F.col("o_orderkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(li.select(F.col("l_orderkey"), F.lit(0), F.lit(1)))
    each = both.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count_if(F.col("b") == 0).alias("missing"), F.count_if(F.col("a") == 0).alias("extra"))


@query("""SELECT l_suppkey, 2 * count(*) FILTER (WHERE l_discount >= 0.05) > count(*) AS mostly FROM lineitem GROUP BY 1""")
def a24_majority(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((2 * F.count_if(F.col("l_discount") >= 0.05) > F.count("*")).alias("mostly"))


# Windows

@query("""SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 8""")
def w1_top_k(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def w2_latest_per_group(spark, sf_dir):
    return rm.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


W4 = """
WITH b AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS ordinal, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc_id, ordinal, 'block-' || lpad(ordinal::VARCHAR, 5, '0') AS block_key, (sum(length(line)) OVER w - length(line))::BIGINT AS start_offset, (sum(length(line)) OVER w)::BIGINT AS end_offset,
  len(list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x <> ''))::INT AS n_words, sha256(line) AS text_hash
FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)"""


@query(W4)
def w4_block_sink(spark, sf_dir):
    """Blocks as they are stored: key, running offsets, words, digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    run = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    words = F.size(F.filter(F.split(F.trim("line"), "\\s+"), lambda x: x != ""))
    end = F.sum(F.length("line")).over(run)
    return d.select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("ordinal"), F.concat(F.lit("block-"), F.lpad((F.col("pos") + 1).cast("string"), 5, "0")).alias("block_key"),
        (end - F.length("line")).alias("start_offset"), end.alias("end_offset"), words.alias("n_words"), F.sha2("line", 256).alias("text_hash"),
    )


W6 = """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id WHEN event_type = 'error' THEN -1 END IGNORE NULLS) OVER w AS mark, nullif(last_value(CASE WHEN event_type = 'signup' THEN event_id WHEN event_type = 'error' THEN -1 END IGNORE NULLS) OVER w, -1) AS section
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


@query(W6)
def w6_forward_fill_with_reset(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")).when(F.col("event_type") == "error", F.lit(-1)), ignorenulls=True).over(w)
    return e.select("event_id", "user_id", mark.alias("mark")).withColumn("section", F.nullif("mark", F.lit(-1)))


W8 = """
WITH f AS (SELECT event_id, user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM f"""


@query(W8)
def w8_gaps_and_islands(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = micros("ts") - micros(F.lag("ts").over(w))
    e = table(spark, sf_dir, "events").withColumn("new", (F.coalesce(gap, F.lit(1 << 60)) > 6 * 3_600_000_000).cast("long"))
    return e.select("event_id", "user_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))


W11 = """
WITH RECURSIVE l AS (SELECT conv_id, turn, ceil(length(text) / 3.5)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, i, n AS total, 1::BIGINT AS section FROM l WHERE i = 1 UNION ALL
  SELECT l.conv_id, l.turn, l.i, CASE WHEN total + n > 200 THEN n ELSE total + n END, CASE WHEN total + n > 200 THEN section + 1 ELSE section END FROM f JOIN l ON l.conv_id = f.conv_id AND l.i = f.i + 1)
SELECT conv_id, turn, section FROM f"""


@query(W11)
def w11_sections_by_tokens(spark, sf_dir):
    from ..operators.grid import sections

    return sections(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 200).select("conv_id", "turn", "section")


@query("""SELECT o_orderkey, floor(10000 * o_totalprice / greatest(1, max(o_totalprice) OVER (PARTITION BY o_custkey)) + 0.5)::BIGINT AS score_bp FROM orders""")
def w15_normalised_score(spark, sf_dir):
    top = F.max("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(10000 * F.col("o_totalprice") / F.greatest(F.lit(1.0), top) + 0.5).alias("score_bp"))


W16 = """
SELECT o_custkey, bool_and(up) AS ascending FROM (SELECT o_custkey, coalesce(o_totalprice >= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), true) AS up FROM orders) GROUP BY 1"""


@query(W16)
def w16_ascending(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.coalesce(F.col("o_totalprice") >= F.lag("o_totalprice").over(w), F.lit(True)).alias("up"))
    return o.groupBy("o_custkey").agg(F.bool_and("up").alias("ascending"))


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def w17_trailing_count(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", micros("ts"))
    return e.select("event_id", "user_id", F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)).alias("recent"))


# Sorts, limits, sets

@query("""SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_id > 5000) > 300 AS has_more FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 300""")
def o2_keyset_page(spark, sf_dir):
    return rm.page_after(table(spark, sf_dir, "events"), "event_id", 5000, 300).select("event_id", "user_id", "has_more")


O5 = """
WITH RECURSIVE h AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey < 5 THEN NULL ELSE n_nationkey % 5 END AS parent FROM nation),
t AS (SELECT k, name, 1 AS depth, lpad(k::VARCHAR, 3, '0') AS path FROM h WHERE parent IS NULL UNION ALL
  SELECT h.k, h.name, depth + 1, path || '/' || lpad(h.k::VARCHAR, 3, '0') FROM t JOIN h ON h.parent = t.k WHERE depth < 3)
SELECT k, name, depth, row_number() OVER (ORDER BY path) AS position FROM t"""


@query(O5)
def o5_hierarchy_preorder(spark, sf_dir):
    from ..operators.checklist import preorder

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey") % 5).cast("long").alias("parent"))
    return preorder(n.withColumn("sort", F.lpad(F.col("k").cast("string"), 3, "0")), 3).select("k", "name", "depth", "position")


O6 = """SELECT s_suppkey, coalesce(lead(s_suppkey) OVER w, s_suppkey) AS after_move_down FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)"""


@query(O6)
def o6_sibling_moves(spark, sf_dir):
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.lead("s_suppkey").over(w), "s_suppkey").alias("after_move_down"))


#: Words whose German order differs from that of their code points.
WORDS = ("Zoll", "Ärmel", "Apfel", "ärgerlich", "Öl", "Ofen", "Über", "Ufer", "zart", "Österreich", "Arm")
O5_GERMAN = f"""
WITH RECURSIVE h AS (SELECT p_partkey AS k, ({list(WORDS)})[(p_partkey * 7919 % {len(WORDS)} + 1)::INT] || ' ' || p_partkey AS key, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey // 5 END AS parent, p_size % 2 AS sort FROM part),
t AS (SELECT h.*, 0 AS depth, sort AS s0, key AS c0, k AS k0, NULL::BIGINT AS s1, NULL::VARCHAR AS c1, NULL::BIGINT AS k1, NULL::BIGINT AS s2, NULL::VARCHAR AS c2, NULL::BIGINT AS k2, NULL::BIGINT AS s3, NULL::VARCHAR AS c3, NULL::BIGINT AS k3
  FROM h WHERE parent IS NULL OR parent NOT IN (SELECT k FROM h)
  UNION ALL SELECT h.*, depth + 1, s0, c0, k0, CASE depth WHEN 0 THEN h.sort ELSE s1 END, CASE depth WHEN 0 THEN h.key ELSE c1 END, CASE depth WHEN 0 THEN h.k ELSE k1 END,
    CASE depth WHEN 1 THEN h.sort ELSE s2 END, CASE depth WHEN 1 THEN h.key ELSE c2 END, CASE depth WHEN 1 THEN h.k ELSE k2 END, CASE depth WHEN 2 THEN h.sort END, CASE depth WHEN 2 THEN h.key END, CASE depth WHEN 2 THEN h.k END
  FROM t JOIN h ON h.parent = t.k WHERE depth < 3)
SELECT k, key, depth, row_number() OVER (ORDER BY s0, c0 COLLATE de, k0, s1 NULLS FIRST, c1 COLLATE de NULLS FIRST, k1 NULLS FIRST, s2 NULLS FIRST, c2 COLLATE de NULLS FIRST, k2 NULLS FIRST, s3 NULLS FIRST, c3 COLLATE de NULLS FIRST, k3 NULLS FIRST) AS position FROM t"""


@query(O5_GERMAN)
def o5_german_order(spark, sf_dir):
    """Parts as a hierarchy in display order: umlauts in their German place, parents found in any case, four levels, positions counted over ranges."""
    from ..operators.checklist import display_order

    k = F.col("p_partkey").cast("long")
    name = lambda n: F.concat(F.element_at(F.array(*map(F.lit, WORDS)), (n * 7919 % len(WORDS) + 1).cast("int")), F.lit(" "), n)
    above = F.expr("p_partkey div 5")
    items = table(spark, sf_dir, "part").select(k.alias("k"), name(k).alias("key"), F.when(k % 5 != 0, F.upper(name(above))).alias("parent_key"), (F.col("p_size") % 2).cast("long").alias("sort"))
    return display_order(items).select("k", "key", "depth", "position")


O6_BOTH = """
SELECT s_suppkey AS k, step, CASE step WHEN 1 THEN lead(s_acctbal) OVER w ELSE lag(s_acctbal) OVER w END AS new_sort, CASE step WHEN 1 THEN lead(s_suppkey) OVER w ELSE lag(s_suppkey) OVER w END AS swap_k
FROM supplier, (VALUES (-1), (1)) AS v(step) WINDOW w AS (PARTITION BY s_nationkey, step ORDER BY s_acctbal, s_suppkey)"""


@query(O6_BOTH)
def o6_moves_both_ways(spark, sf_dir):
    """Where each supplier comes among its nation's, moved up and moved down, and with whom it changes places."""
    from ..operators.checklist import moved

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("parent"), F.col("s_acctbal").alias("sort"))
    up, down = (moved(s, step).select("k", F.lit(step).alias("step"), "new_sort", "swap_k") for step in (-1, 1))
    return up.unionByName(down)


@query("""SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 500""")
def o7_shortlist(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(500).select("p_partkey", "p_retailprice")


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def u1_union_all(spark, sf_dir):
    c, s = _t("customer", "supplier")(spark, sf_dir)
    return c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label")).unionByName(s.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")))


U2 = """
SELECT doc_id, origin FROM (SELECT doc_id, 'label' AS origin, 0 AS seq FROM labels UNION ALL SELECT doc_id, 'corpus', 1 FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1"""


@query(U2)
def u2_union_first_wins(spark, sf_dir):
    lab, d = _t("labels", "documents")(spark, sf_dir)
    both = lab.select("doc_id", F.lit("label").alias("origin"), F.lit(0).alias("seq")).unionByName(d.select("doc_id", F.lit("corpus").alias("origin"), F.lit(1).alias("seq")))
    return both.groupBy("doc_id").agg(F.min_by("origin", "seq").alias("origin"))


U4 = """
WITH s AS (SELECT l_orderkey % 1000 AS k, list(DISTINCT l_suppkey) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_orderkey % 1000 AS k, list(DISTINCT l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT k, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS only_a FROM s JOIN r USING (k)"""


@query(U4)
def u4_set_similarity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") % 1000)
    sets = li.groupBy("k").agg(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    return sets.select("k", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 9).alias("jaccard"), F.size(F.array_except("a", "b")).cast("long").alias("only_a"))


# Predicates and projections

P2 = """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') AND o_orderpriority LIKE '1%' OR o_totalprice >= 490000 AND o_orderpriority ILIKE '%urg%' AND regexp_matches(o_orderpriority, '^[0-9]-')"""


@query(P2)
def p2_predicates(spark, sf_dir):
    p = F.col("o_orderpriority")
    one = F.col("o_orderstatus").isin("F", "O") & ~p.isin("5-LOW") & p.like("1%")
    two = (F.col("o_totalprice") >= 490000) & p.ilike("%urg%") & p.rlike("^[0-9]-")
    return table(spark, sf_dir, "orders").where(one | two).select("o_orderkey", "o_orderpriority")


P3 = """
SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY lang = 'es' DESC, lang = 'de' DESC, lang, doc_id) = 1"""


@query(P3)
def p3_localised_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return d.groupBy("source").agg(F.min_by(F.struct("lang", "doc_id"), F.struct(F.col("lang") != "es", F.col("lang") != "de", "lang", "doc_id")).alias("x")).select("source", "x.lang", "x.doc_id")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), '#17')""")
def p4_catalogue_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("ring")) | F.exists(F.array("p_brand"), lambda a: F.contains(F.lower(a), F.lit("#17")))).select("p_partkey", "p_name")


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END) AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def p5_effective_value(spark, sf_dir):
    d, lab = _t("documents", "labels")(spark, sf_dir)
    own = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    override = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    return d.select("doc_id", "n_chars").join(lab.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(override, own).alias("status"))


P6 = """
SELECT event_id, ((value > 100)::INT + (event_type = 'error')::INT + (user_id % 2 = 0)::INT) = 1 AS exactly_one FROM events"""


@query(P6)
def p6_exactly_one(spark, sf_dir):
    n = sum((c.cast("int") for c in (F.col("value") > 100, F.col("event_type") == "error", F.col("user_id") % 2 == 0)), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", (n == 1).alias("exactly_one"))


# Sinks

S11 = """
SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN n END) AS urgent, max(CASE WHEN o_orderpriority = '2-HIGH' THEN n END) AS high, max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN n END) AS medium
FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1"""


@query(S11)
def s11_grid_pivot(spark, sf_dir):
    values = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderpriority", list(values)).agg(F.count(F.lit(1)))
    return p.select("o_custkey", *(F.col(f"`{k}`").alias(v) for k, v in values.items()))


S13 = """
SELECT o_orderkey, 'old' AS origin FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT DISTINCT l_orderkey, 'new' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""


@query(S13)
def s13_insert_ignore(spark, sf_dir):
    o, li = _t("orders", "lineitem")(spark, sf_dir)
    return rm.append_new(o.where("o_orderstatus <> 'P'").select("o_orderkey", F.lit("old").alias("origin")), li.select(F.col("l_orderkey").alias("o_orderkey"), F.lit("new").alias("origin")), ["o_orderkey"])


S14 = """
SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a
FULL JOIN (SELECT o_custkey + 1000 AS k, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE AS v FROM orders GROUP BY 1) b ON a.k = b.k"""


@query(S14)
def s14_upsert(spark, sf_dir):
    c, o = _t("customer", "orders")(spark, sf_dir)
    batch = o.groupBy((F.col("o_custkey") + 1000).alias("k")).agg(F.sum(cents("o_totalprice")).cast("double").alias("v"))
    return rm.upsert(c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), batch, ["k"])


S10 = """
SELECT conv_id, string_agg('• ' || substr(text, 1, 40), chr(10) ORDER BY turn) AS passages, max(CASE WHEN regexp_matches(text, '^[=+@-]') THEN '''' || text ELSE text END) AS safe
FROM conversations GROUP BY 1"""


@query(S10)
def s10_export_rows(spark, sf_dir):
    """Rows of a spreadsheet: bulleted passages in order, cells that cannot run as formulas."""
    from ..functions.text import safe_cell

    c = table(spark, sf_dir, "conversations")
    bullets = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("• "), F.substring("text", 1, 40)).alias("s"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(bullets, lambda x: x["s"]), "\n").alias("passages"), F.max(safe_cell(F.col("text"))).alias("safe"))


S10_WHOLE = """
WITH c AS (SELECT conv_id, string_agg('• ' || text, chr(10) ORDER BY turn, text) AS passages, max(CASE WHEN regexp_matches(text, '^[=+@-]') THEN '''' || text ELSE text END) AS safe FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN length(passages) > 32767 THEN left(passages, 32753) || ' … [gekürzt]' ELSE passages END AS passages, safe FROM c"""


@query(S10_WHOLE)
def s10_whole_passages(spark, sf_dir):
    """``s10_export_rows`` with whole passages, up to what a cell holds."""
    from ..functions.text import safe_cell

    c = table(spark, sf_dir, "conversations")
    bullets = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("• "), F.col("text")).alias("s"))))
    joined = F.array_join(F.transform(bullets, lambda x: x["s"]), "\n")
    return c.groupBy("conv_id").agg(joined.alias("passages"), F.max(safe_cell(F.col("text"))).alias("safe")).withColumn("passages", safe_cell(F.col("passages")))
