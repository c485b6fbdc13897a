"""Queries over evidence: retrieval packets, grounding, verdicts, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from .common import SQL_BLOCKS, spread, sql_collapse, sql_tokens, table

#: Least score of a passage that is sought as a whole; the library's own default is lower.
PASSAGE_SCORE = 40.0
PACKET_TOKENS = 120


def evidence_packets(spark, sf_dir):
    """Blocks of all documents that answer the benchmark passages, packed by rank."""
    blocks = retrieval.text_blocks(table(spark, sf_dir, "documents"))
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("req_id"), F.lit("title").alias("part"), "text")
    return retrieval.packets(blocks, wanted, max_tokens=PACKET_TOKENS, minimum=PASSAGE_SCORE)


def packets_sql(minimum: float, max_tokens: int) -> str:
    return rf"""
WITH RECURSIVE {SQL_BLOCKS},
t AS (SELECT doc_id, ordinal, lower(text) AS plain, {sql_tokens('text')} AS toks FROM blocks),
b AS (SELECT *, len(toks) AS n_tokens, count(*) OVER (PARTITION BY doc_id) AS n_blocks, avg(len(toks)) OVER (PARTITION BY doc_id) AS mean FROM t),
q AS (SELECT item_id AS req_id, term, 4.0 * count(*) AS weight FROM (SELECT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
ph AS (SELECT item_id AS req_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM benchmark),
tf AS (SELECT doc_id, ordinal, n_tokens, n_blocks, mean, term, count(*) AS tf FROM (SELECT * EXCLUDE (toks, plain), unnest(toks) AS term FROM b) GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM tf WHERE term IN (SELECT term FROM q)),
s AS (
  SELECT doc_id, req_id, ordinal, n_tokens, sum(weight * ln(1 + (n_blocks - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n_tokens / greatest(1.0, mean)))) AS score,
    string_agg(term, ' ' ORDER BY term) AS matched
  FROM w JOIN q USING (term) GROUP BY ALL
), m AS (
  SELECT s.doc_id, s.req_id, s.ordinal, s.n_tokens, matched, round(score + CASE WHEN length(p) >= 12 AND contains(plain, p) THEN 3.0 ELSE 0 END, 9) AS score
  FROM s JOIN ph USING (req_id) JOIN b ON b.doc_id = s.doc_id AND b.ordinal = s.ordinal
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, req_id ORDER BY score DESC, ordinal) AS place FROM m WHERE score >= {minimum} QUALIFY place <= 8
), a AS (
  SELECT doc_id, req_id, place, ordinal + o AS ordinal, o, CASE WHEN o = 0 THEN score ELSE score * 0.2 END AS score, CASE WHEN o = 0 THEN matched ELSE '' END AS matched FROM r, (VALUES (0), (-1), (1)) AS v(o)
), sel AS (
  SELECT a.*, b.n_tokens FROM a JOIN b USING (doc_id, ordinal) QUALIFY row_number() OVER (PARTITION BY doc_id, req_id, ordinal ORDER BY o <> 0, place, o) = 1
), o AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, req_id ORDER BY score DESC, ordinal) AS i, greatest(1.0, max(score) OVER (PARTITION BY doc_id, req_id)) AS top FROM sel
), fold AS (
  SELECT doc_id, req_id, i, CASE WHEN n_tokens <= {max_tokens} THEN n_tokens ELSE 0 END AS total, (n_tokens <= {max_tokens})::INT AS taken, (n_tokens <= {max_tokens}) AS kept FROM o WHERE i = 1
  UNION ALL
  SELECT o.doc_id, o.req_id, o.i, CASE WHEN taken < 16 AND total + n_tokens <= {max_tokens} THEN total + n_tokens ELSE total END,
    CASE WHEN taken < 16 AND total + n_tokens <= {max_tokens} THEN taken + 1 ELSE taken END, taken < 16 AND total + n_tokens <= {max_tokens}
  FROM fold JOIN o ON o.doc_id = fold.doc_id AND o.req_id = fold.req_id AND o.i = fold.i + 1
)
SELECT doc_id, req_id, taken AS rank, ordinal, CASE WHEN o < 0 THEN 'context_before' WHEN o > 0 THEN 'context_after' ELSE 'match' END AS role, round(score, 9) AS score,
  floor(score / top * 10000 + 0.5)::BIGINT AS score_bp, matched AS matched_terms, n_tokens
FROM fold JOIN o USING (doc_id, req_id, i) WHERE kept
"""


EVIDENCE_PACKETS = packets_sql(PASSAGE_SCORE, PACKET_TOKENS)

QUERIES = {"evidence_packets": evidence_packets}
ORACLES = {"evidence_packets": EVIDENCE_PACKETS}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Least score and token budget of the reference.
REFERENCE_SCORE, REFERENCE_TOKENS = 0.75, 6000


@query(packets_sql(REFERENCE_SCORE, REFERENCE_TOKENS))
def d1_evidence_packets(spark, sf_dir):
    """``evidence_packets`` with the reference's least score and token budget: partial matches and long blocks count too."""
    blocks = retrieval.text_blocks(table(spark, sf_dir, "documents"))
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("req_id"), F.lit("title").alias("part"), "text")
    return retrieval.packets(blocks, wanted, max_tokens=REFERENCE_TOKENS, minimum=REFERENCE_SCORE)


P8 = rf"""
WITH {SQL_BLOCKS}, q AS (SELECT item_id, upper(left(t, 1)) || substr(t, 2) || '!' AS quote, t FROM (SELECT item_id, trim(regexp_replace(split_part(text, '.', 1), '\s+', ' ', 'g')) AS t FROM benchmark) WHERE length(t) > 40)
SELECT doc_id, ordinal, item_id, CASE WHEN contains(text, t) THEN t END AS grounded FROM blocks, q WHERE contains(text, t)"""


@query(P8)
def p8_grounded_quotes(spark, sf_dir):
    """First sentences of the benchmark passages as quotes with another end, found in all blocks.

    A block that holds a quote holds its rarest words: quotes meet blocks on one long word
    of theirs, then containment decides.
    """
    from ..functions.text import collapse, lexical_tokens, locate_quote

    first = collapse(F.split_part("text", F.lit("."), F.lit(1)))
    q = table(spark, sf_dir, "benchmark").select("item_id", first.alias("t")).where(F.length("t") > 40)
    longest = F.array_max(F.transform(F.filter(lexical_tokens(F.col("t")), lambda w: F.contains(F.lower("t"), F.concat(F.lit(" "), w, F.lit(" ")))), lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    quotes = q.withColumn("word", longest).withColumn("quote", F.concat(F.upper(F.substring("t", 1, 1)), F.substring("t", 2, 1 << 30), F.lit("!")))
    blocks = retrieval.text_blocks(table(spark, sf_dir, "documents"))
    words = blocks.select("doc_id", "ordinal", "text", F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("word"))
    found = words.join(quotes, "word").withColumn("grounded", locate_quote(F.col("text"), F.col("quote"))).where("grounded IS NOT NULL")
    return found.select("doc_id", "ordinal", "item_id", "grounded")


P8_ALL = rf"""
WITH {SQL_BLOCKS}, p AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda l: {sql_collapse('l')}), lambda l: l <> '') AS ts FROM benchmark),
s AS (SELECT item_id, unnest(range(1, len(ts) + 1)) AS sentence, unnest(ts) AS t FROM p), q AS (SELECT item_id, sentence, upper(left(t, 1)) || substr(t, 2) || '!' AS quote FROM s),
v AS (SELECT *, rtrim(regexp_replace(quote, '[.:;,!?]+$', ''), ' ') AS bare FROM q),
g AS (SELECT doc_id, ordinal, item_id, sentence, list_filter([quote, lower(left(quote, 1)) || substr(quote, 2), bare, lower(left(bare, 1)) || substr(bare, 2)], lambda x: x <> '' AND contains(text, x))[1] AS grounded FROM blocks, v WHERE contains(text, substr(bare, 2)))
SELECT * FROM g WHERE grounded IS NOT NULL"""


@query(P8_ALL)
def p8_all_quotes(spark, sf_dir):
    """Every sentence of the benchmark passages, of any length, as a quote with another end, found in all blocks.

    All variants of a quote share what follows its first letter, without marks at the end. A
    word between two spaces in there stands so in every block that holds the quote, and they
    meet on it; a quote without such a word is looked for in each block. Documents are dealt
    over all tasks first: a file of one piece would be the work of one.
    """
    from ..functions.text import bare_quote, collapse, lexical_tokens, quote_variants

    sentences = F.filter(F.transform(F.split("text", "[.!?\n]"), collapse), lambda t: t != "")
    q = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(sentences).alias("pos", "t"))
    q = q.select("item_id", (F.col("pos") + 1).cast("long").alias("sentence"), F.concat(F.upper(F.substring("t", 1, 1)), F.substring("t", 2, 1 << 30), F.lit("!")).alias("quote")).withColumn("bare", bare_quote(F.col("quote")))
    alone = F.filter(lexical_tokens(F.col("bare")), lambda w: F.contains(F.lower("bare"), F.concat(F.lit(" "), w, F.lit(" "))) & ~w.endswith("-"))
    variants = F.filter(F.array_distinct(F.array(*quote_variants(F.col("quote")))), lambda v: v != "")
    quotes = q.withColumn("variants", variants).withColumn("word", F.array_max(F.transform(alone, lambda w: F.struct(F.length(w), w.alias("w"))))["w"]).withColumn("rest", F.substring("bare", 2, 1 << 30))
    blocks = retrieval.text_blocks(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")).select("doc_id", "ordinal", "text")
    words = blocks.withColumn("word", F.explode(F.array_distinct(F.split(F.lower("text"), " "))))  # white space is one space already
    by_word = words.join(quotes.where("word IS NOT NULL"), "word").where(F.contains("text", "rest")).drop("word")
    by_text = blocks.join(F.broadcast(quotes.where("word IS NULL").drop("word")), F.contains("text", "rest"))  # few: one or two words each
    found = by_word.unionByName(by_text).withColumn("grounded", F.get(F.filter("variants", lambda v: F.contains(F.col("text"), v)), F.lit(0)))  # blocks are collapsed already
    return found.where("grounded IS NOT NULL").select("doc_id", "ordinal", "item_id", "sentence", "grounded")


P14 = """
WITH a AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'fulfilled' WHEN 'error' THEN 'not_fulfilled' ELSE 'partially_fulfilled' END AS status, floor(value)::BIGINT % 101 AS confidence, user_id FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN status = 'fulfilled' THEN 'fulfilled' END, CASE WHEN status = 'not_fulfilled' THEN 'not_fulfilled' END, CASE WHEN confidence < 85 THEN 'low_confidence' END, CASE WHEN event_id % 13 = 0 THEN 'contradiction' END,
  CASE WHEN event_id % 17 = 0 THEN 'retried' END, CASE WHEN ('0x' || left(sha256(user_id || ':' || event_id), 8))::BIGINT % 100 < 10 THEN 'drift_sample' END], lambda x: x IS NOT NULL), ',') AS reasons FROM a"""


@query(P14)
def p14_verification_reasons(spark, sf_dir):
    from ..operators.grounding import verification_reasons

    status = F.when(F.col("event_type") == "view", "fulfilled").when(F.col("event_type") == "error", "not_fulfilled").otherwise("partially_fulfilled")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status"), (F.floor("value") % 101).alias("confidence"))
    r = verification_reasons(F.col("status"), F.col("confidence"), F.col("event_id") % 13 == 0, F.col("event_id") % 17 == 0, F.col("user_id"), F.col("event_id"))
    return e.select("event_id", F.array_join(r, ",").alias("reasons"))


P17 = """
WITH c AS (SELECT l_orderkey AS k, l_linenumber AS ordinal, CASE WHEN l_returnflag = 'N' THEN 'context' ELSE 'match' END AS role, CASE WHEN l_tax > 0.01 THEN (l_discount * 100000)::BIGINT END AS rel, (l_quantity * 110)::BIGINT AS inj, l_partkey FROM lineitem),
f AS (SELECT *, CASE WHEN inj >= 5000 THEN 'injection' WHEN role = 'match' AND rel < 2500 THEN 'irrelevant' END AS first FROM c),
g AS (SELECT *, list(ordinal) FILTER (first IS NULL AND role = 'match') OVER (PARTITION BY k) AS pos FROM f)
SELECT k, ordinal, l_partkey, pos IS NULL AS fallback, CASE WHEN pos IS NULL THEN NULL ELSE coalesce(first, CASE WHEN role <> 'match' AND NOT list_contains(pos, ordinal - 1) AND NOT list_contains(pos, ordinal + 1) THEN 'orphaned_context' END) END AS dropped FROM g"""


@query(P17)
def p17_filtered_candidates(spark, sf_dir):
    from ..operators.grounding import filtered_candidates

    li = table(spark, sf_dir, "lineitem")
    c = li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ordinal"), "l_partkey", F.when(F.col("l_returnflag") == "N", "context").otherwise("match").alias("role"),
        F.when(F.col("l_tax") > 0.01, F.round(F.col("l_discount") * 100_000).cast("long")).alias("relevance_bp"), F.round(F.col("l_quantity") * 110).cast("long").alias("injection_bp"),
    )
    return filtered_candidates(c, ["k"]).select("k", "ordinal", "l_partkey", "fallback", "dropped")


A16 = """
WITH c AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'R' THEN 'silent' ELSE CASE WHEN l_tax >= 0.07 THEN 'contradicts' ELSE 'supports' END END AS choice, floor(least(greatest(l_discount * 12, 0), 1) * 10000 + 0.5)::BIGINT AS bp FROM lineitem),
v AS (SELECT l_orderkey, CASE choice WHEN 'contradicts' THEN 'contradicted' WHEN 'supports' THEN 'verified' ELSE 'unsupported' END AS verdict, bp FROM c)
SELECT l_orderkey, CASE WHEN bool_or(verdict = 'contradicted') THEN 'contradicted' WHEN bool_or(verdict = 'verified') THEN 'verified' ELSE 'unsupported' END AS verdict,
  bool_or(verdict = 'contradicted') OR NOT bool_or(verdict = 'verified') OR max(bp) FILTER (verdict = 'verified') < 8000 AS needs_review,
  CASE WHEN bool_or(verdict = 'contradicted') THEN 'contradicted' WHEN bool_or(verdict = 'unsupported') THEN 'unsupported' ELSE 'verified' END AS worst FROM v GROUP BY 1"""


@query(A16)
def a16_cell_verdicts(spark, sf_dir):
    from ..operators.grid import cell_outcome, citation_check, worst_verdict

    flag = F.col("l_returnflag")
    choice = F.when(flag == "A", "supports").when(flag == "R", "silent").when(F.col("l_tax") >= 0.07, "contradicts").otherwise("supports")
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", citation_check(choice, F.col("l_discount") * 12).alias("c"))
    out = c.groupBy("l_orderkey").agg(cell_outcome(F.col("c.verdict"), F.col("c.confidence_bp")).alias("o"), worst_verdict(F.col("c.verdict")).alias("worst"))
    return out.select("l_orderkey", "o.verdict", F.coalesce("o.needs_review", F.lit(False)).alias("needs_review"), "worst")


F43 = """
WITH c AS (SELECT o_custkey, o_orderkey, (o_totalprice::BIGINT % 10000) AS bp, o_orderstatus = 'P' AS review FROM orders),
w AS (SELECT *, CASE WHEN review THEN 'citation_needs_review' WHEN bp < 6000 THEN 'low_confidence' END AS reason FROM c),
r AS (SELECT *, reason IS NOT NULL AND row_number() OVER (PARTITION BY o_custkey, reason IS NOT NULL ORDER BY o_orderkey) <= 3 AS escalate FROM w)
SELECT o_orderkey, reason, escalate, CASE WHEN escalate THEN 'escalated' WHEN reason IS NOT NULL THEN 'needs_review' ELSE 'complete' END AS state FROM r"""


@query(F43)
def f43_escalation_budget(spark, sf_dir):
    from ..operators.grid import escalated

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.round("o_totalprice").cast("long") % 10_000).alias("bp"), (F.col("o_orderstatus") == "P").alias("review"))
    return escalated(o, "o_custkey", ["o_orderkey"], "bp", "review", 6000, 3).select("o_orderkey", "reason", "escalate", "state")


D36 = """
WITH RECURSIVE e AS (SELECT o_custkey AS subject, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, (o_orderkey % 3)::VARCHAR AS actor, CASE o_orderpriority WHEN '1-URGENT' THEN 'release' WHEN '2-HIGH' THEN 'reject' WHEN '3-MEDIUM' THEN 'release' ELSE 'prepare' END AS action FROM orders),
s AS (SELECT DISTINCT o_custkey AS subject, 0::BIGINT AS i, 'open' AS status, NULL::VARCHAR AS p, NULL::VARCHAR AS r, 0 AS refused FROM orders UNION ALL
  SELECT s.subject, e.i, CASE WHEN action = 'prepare' AND status <> 'reviewed' THEN 'prepared' WHEN action = 'release' AND status = 'prepared' AND p <> actor THEN 'reviewed' ELSE status END,
    CASE WHEN action = 'prepare' AND status <> 'reviewed' THEN actor ELSE p END, CASE WHEN action = 'prepare' AND status <> 'reviewed' THEN NULL WHEN action = 'release' AND status = 'prepared' AND p <> actor THEN actor ELSE r END,
    refused + CASE WHEN action = 'prepare' THEN (status = 'reviewed')::INT ELSE 1 - coalesce(status = 'prepared' AND p <> actor, false)::INT END
  FROM s JOIN e ON e.subject = s.subject AND e.i = s.i + 1)
SELECT subject, status, p AS prepared_by, r AS reviewed_by, refused FROM s QUALIFY row_number() OVER (PARTITION BY subject ORDER BY i DESC) = 1"""


@query(D36)
def d36_review_states(spark, sf_dir):
    from ..operators.grounding import review_states

    p = F.col("o_orderpriority")
    action = F.when(p.isin("1-URGENT", "3-MEDIUM"), "release").when(p == "2-HIGH", "reject").otherwise("prepare")
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 3).cast("string").alias("actor"), action.alias("action"))
    return review_states(e)


D37 = """
WITH o AS (SELECT user_id, arg_max(floor(value)::BIGINT % 4, event_id) AS status, max(event_id) AS moment FROM events WHERE event_type = 'error' GROUP BY 1), c AS (SELECT user_id, max(event_id) AS sure FROM events WHERE event_type = 'signup' GROUP BY 1),
r AS (SELECT DISTINCT user_id, 9 AS status FROM events)
SELECT user_id, coalesce(o.status, r.status)::BIGINT AS status, o.status IS NOT NULL AS overridden, sure IS NOT NULL AND (moment IS NULL OR sure > moment) AS confirmed FROM r LEFT JOIN o USING (user_id) LEFT JOIN c USING (user_id)"""


@query(D37)
def d37_override_and_confirmation(spark, sf_dir):
    from ..operators.grounding import effective

    e = table(spark, sf_dir, "events").withColumn("at", F.col("event_id")).withColumn("id", F.col("event_id"))
    results = e.select("user_id").distinct().withColumn("status", F.lit(9).cast("long"))
    overrides = e.where("event_type = 'error'").withColumn("status", F.floor("value") % 4)
    return effective(results, overrides, e.where("event_type = 'signup'"), "user_id")


@query(None)
def s2_html_blocks(spark, sf_dir):
    """Typed blocks of all pages with their heading paths."""
    from ..operators import structure

    blocks = structure.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")
    return structure.outlined(blocks).select("doc_id", "ordinal", "kind", "text", "level", F.array_join("heading_path", " / ").alias("heading_path"))


@query(None)
def d7_figures(spark, sf_dir):
    from ..operators import recognition

    return recognition.figures(retrieval.text_blocks(table(spark, sf_dir, "documents"))).withColumn("micro", F.col("micro").cast("string")).withColumn("display_unit", F.col("display_unit").cast("string"))


@query(None)
def d8_statements(spark, sf_dir):
    from ..operators import recognition

    return recognition.statements(retrieval.text_blocks(table(spark, sf_dir, "documents")))


D2 = rf"""
WITH s AS (SELECT conv_id, turn, length(text) AS chars, {sql_tokens('text')} AS toks FROM conversations), n AS (SELECT conv_id, turn, chars, toks, len(toks) AS len, count(*) OVER (PARTITION BY conv_id) AS n, avg(len(toks)) OVER (PARTITION BY conv_id) AS mean FROM s),
q AS (SELECT conv_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
tf AS (SELECT conv_id, turn, len, n, mean, term, count(*) AS tf FROM (SELECT * EXCLUDE (toks), unnest(toks) AS term FROM n) JOIN q USING (conv_id, term) GROUP BY ALL),
d AS (SELECT *, count(*) OVER (PARTITION BY conv_id, term) AS df FROM tf)
SELECT conv_id, turn, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / greatest(1.0, mean)))), 9) AS score FROM d GROUP BY conv_id, turn
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) <= 6"""


@query(D2)
def d2_chat_sources(spark, sf_dir):
    """The turns of each conversation that answer its first turn best."""
    from ..operators.retrieval import chat_matches

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn"), "text")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    return chat_matches(c, first, "conv_id", "turn", 6).select("conv_id", "turn", "score")


F68 = r"""
SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text || ' [2] [' || turn || '] [2]', '\[(\d+)\]', 1), lambda x: x::INT), ',') AS cited, len(list_filter(list_distinct(list_transform(regexp_extract_all(text || ' [2] [' || turn || '] [2]', '\[(\d+)\]', 1), lambda x: x::INT)), lambda x: x > 3))::BIGINT AS unknown FROM conversations"""


@query(F68)
def f68_cited_numbers(spark, sf_dir):
    from ..functions.text import cited_numbers

    t = F.concat("text", F.lit(" [2] ["), "turn", F.lit("] [2]"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", cited_numbers(t).alias("c"))
    return c.select("conv_id", "turn", F.array_join(F.col("c").cast("array<string>"), ",").alias("cited"), F.size(F.array_except(F.array_distinct("c"), F.array(*(F.lit(k) for k in (0, 1, 2, 3))))).cast("long").alias("unknown"))


F9 = r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
p AS (SELECT doc_id, t, left(t, 600) AS h, reverse(left(t, 600)) AS r FROM t),
c AS (SELECT doc_id, t, h, greatest(CASE WHEN strpos(r, ' .') > 0 THEN length(h) - strpos(r, ' .') ELSE 0 END, CASE WHEN strpos(r, ' ;') > 0 THEN length(h) - strpos(r, ' ;') ELSE 0 END, CASE WHEN strpos(r, ' :') > 0 THEN length(h) - strpos(r, ' :') ELSE 0 END) AS s,
  CASE WHEN strpos(r, ' ') > 0 THEN length(h) - strpos(r, ' ') ELSE length(h) END AS sp FROM p)
SELECT doc_id, CASE WHEN length(t) <= 600 THEN t WHEN (s - 1) * 3 >= 600 THEN left(h, s) ELSE rtrim(left(h, sp)) END AS excerpt FROM c"""


@query(F9)
def f9_excerpts(spark, sf_dir):
    from ..functions.text import excerpt

    return table(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text")).alias("excerpt"))
