"""Lexical retrieval: BM25 of requirements over the blocks of each document, packed into evidence packets.

All work on one document stays in the partition of its id: one shuffle deals the blocks,
and terms, statistics, ranking, neighbours and packing follow from that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens, once, phrase

#: Weights of a requirement's parts, fixed values.
WEIGHTS = {"title": 4.0, "legal_text": 1.0, "guidance": 1.25, "aspect": 3.0, "sub_title": 2.0, "sub_legal_text": 0.5, "sub_aspect": 1.5}
PHRASE_LENGTH, PHRASE_BONUS = 12, 3.0
CONTEXT_SHARE = 0.2
#: Decimals of a score that count for ranks, so that the order of addition does not.
DIGITS = 9
#: Partitions for each of the session's: a block has a row for each term of each requirement that it shares.
SPREAD = 4


def term_score(weight: Column, tf: Column, df: Column, blocks: Column, length: Column, mean: Column) -> Column:
    idf = F.log(1 + (blocks - df + 0.5) / (df + 0.5))
    return weight * idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / F.greatest(F.lit(1.0), mean)))


def query_terms(requirements: DataFrame) -> DataFrame:
    """(req_id, term, weight) of requirements (req_id, part, text), part as in WEIGHTS."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("part")]
    each = requirements.select("req_id", weight.alias("w"), F.explode(lexical_tokens(F.col("text"))).alias("term"))
    return each.groupBy("req_id", "term").agg(F.sum("w").alias("weight"))


def phrases(requirements: DataFrame) -> DataFrame:
    """(req_id, phrases): titles and aspects that are long enough to count as phrases."""
    p = phrase(F.col("text"))
    kept = requirements.where(F.col("part").isin("title", "aspect")).select("req_id", p.alias("p")).where(F.length("p") >= PHRASE_LENGTH)
    return kept.groupBy("req_id").agg(F.collect_list("p").alias("phrases"))


def said(blocks: DataFrame, requirements: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, ordinal, text, heading) dealt by document, with ``said``: the requirement of each phrase that they contain."""
    parts = SPREAD * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = phrases(requirements).select("req_id", F.explode("phrases").alias("p"))
    every = each.agg(F.collect_list(F.struct("req_id", "p")).alias("_every"))
    plain = phrase(F.concat_ws(" ", F.coalesce("heading", F.lit("")), "text"))
    dealt = blocks.select("doc_id", "ordinal", "text", "heading").repartition(parts, "doc_id")
    return dealt.crossJoin(F.broadcast(every)).withColumn("said", once(plain, lambda t: F.transform(F.filter("_every", lambda x: F.contains(t, x["p"])), lambda x: x["req_id"]))).drop("_every")


def wanted_terms(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, ordinal, n_tokens, before, after, term, said, tf, df, n_blocks, mean) of the blocks' terms that a requirement has, and of the phrases in them.

    ``blocks``: of ``said``. A heading counts twice for term frequency, not for length.
    ``before`` and ``after`` are the lengths of the blocks next to it. A row has a term or the
    requirement of a phrase (``tf`` times); one without either stands for each block in the
    document's statistics and is dropped after them.
    """
    by_doc = Window.partitionBy("doc_id")
    body, head = lexical_tokens(F.col("text")), lexical_tokens(F.coalesce("heading", F.lit("")))
    each = blocks.select("doc_id", "ordinal", "said", F.struct(body.alias("body"), head.alias("head")).alias("t"))
    none = F.lit(None).cast(blocks.schema["said"].dataType.elementType)
    as_term = lambda t: F.struct(t.alias("term"), none.alias("said"))
    every = F.concat(
        F.array(as_term(F.lit(None).cast("string"))), F.transform(F.concat("t.body", "t.head", "t.head"), as_term), F.transform("said", lambda r: F.struct(F.lit(None).cast("string").alias("term"), r.alias("said")))
    )
    rows = each.select("doc_id", "ordinal", F.size("t.body").cast("long").alias("n_tokens"), F.explode(every).alias("x")).select("doc_id", "ordinal", "n_tokens", "x.*")
    known = terms.select("term").distinct().withColumn("known", F.lit(True))
    kept = rows.join(F.broadcast(known), "term", "left").where("term IS NULL OR known").drop("known")
    counts = kept.groupBy("doc_id", "ordinal", "n_tokens", "term", "said").agg(F.count("*").alias("tf"))
    length = F.when(F.col("term").isNull() & F.col("said").isNull(), F.col("n_tokens"))
    with_doc = counts.withColumn("n_blocks", F.count(length).over(by_doc)).withColumn("mean", F.avg(length).over(by_doc))
    in_order = by_doc.orderBy("ordinal")
    with_doc = with_doc.withColumn("before", F.max("n_tokens").over(in_order.rangeBetween(-1, -1))).withColumn("after", F.max("n_tokens").over(in_order.rangeBetween(1, 1)))
    return with_doc.where("term IS NOT NULL OR said IS NOT NULL").withColumn("df", F.count("*").over(Window.partitionBy("doc_id", "term")))


def scored(blocks: DataFrame, requirements: DataFrame, minimum: float) -> DataFrame:
    """(doc_id, req_id, ordinal, score, matched, n_tokens, before, after) of blocks that share a term with a requirement and reach ``minimum``.

    Blocks are dealt by document once; terms, phrases, statistics and scores follow in the
    same partition, and what is joined to them is broadcast.
    """
    terms = query_terms(requirements)
    hits = wanted_terms(said(blocks, requirements), terms).join(F.broadcast(terms), "term", "left").withColumn("req_id", F.coalesce("said", "req_id"))
    s = term_score(F.col("weight"), F.col("tf"), F.col("df"), F.col("n_blocks"), F.col("n_tokens"), F.col("mean"))
    bonus = F.coalesce(F.sum(F.when(F.col("said").isNotNull(), F.col("tf"))), F.lit(0)) * PHRASE_BONUS
    found = hits.groupBy("doc_id", "req_id", "ordinal", "n_tokens", "before", "after").agg(F.sum(F.when(F.col("said").isNull(), s)).alias("bm25"), bonus.alias("bonus"), F.array_sort(F.collect_list("term")).alias("matched"))
    score = F.round(F.col("bm25") + F.col("bonus"), DIGITS)
    return found.where(F.size("matched") > 0).select("doc_id", "req_id", "ordinal", score.alias("score"), "matched", "n_tokens", "before", "after").where(F.col("score") >= minimum)


def greedy(items: Column, size: str, budget: int, most: int) -> Column:
    """Items taken in order while they fit; one that does not fit is skipped, the next may still fit."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.filter(items, lambda x: F.lit(False)).alias("kept"))
    take = lambda acc, x: F.when(
        (F.size(acc["kept"]) < most) & (acc["total"] + x[size] <= budget),
        F.struct((acc["total"] + x[size]).alias("total"), F.concat(acc["kept"], F.array(x)).alias("kept")),
    ).otherwise(acc)
    return F.aggregate(items, zero, take, lambda acc: acc["kept"])


def packets(blocks: DataFrame, requirements: DataFrame, max_matches: int = 8, max_blocks: int = 16, max_tokens: int = 6000, minimum: float = 0.75) -> DataFrame:
    """One row for each block in the packet of a (document, requirement) pair, by rank.

    The best matches come with the blocks before and after them at a fifth of the score; a
    match is never replaced by a context. Packing by score stops at ``max_blocks`` and skips
    what exceeds ``max_tokens``.
    """
    pair = Window.partitionBy("doc_id", "req_id")
    ranked = scored(blocks, requirements, minimum).withColumn("place", F.row_number().over(pair.orderBy(F.desc("score"), "ordinal"))).where(F.col("place") <= max_matches)
    side = lambda o, size: F.struct(F.lit(o).alias("side"), (F.col("ordinal") + o).alias("ordinal"), (F.col("score") * (1.0 if o == 0 else CONTEXT_SHARE)).alias("score"), F.col(size).alias("n_tokens"))
    around = ranked.select("doc_id", "req_id", "place", F.explode(F.array(side(0, "n_tokens"), side(-1, "before"), side(1, "after"))).alias("x"), "matched").where("x.n_tokens IS NOT NULL")
    around = around.select("doc_id", "req_id", "place", "x.*", F.when(F.col("x.side") == 0, F.col("matched")).otherwise(F.array().cast("array<string>")).alias("matched"))
    first = Window.partitionBy("doc_id", "req_id", "ordinal").orderBy(F.col("side") != 0, "place", "side")
    selected = around.withColumn("n", F.row_number().over(first)).where("n = 1")
    role = F.when(F.col("side") == 0, "match").when(F.col("side") < 0, "context_before").otherwise("context_after")
    item = F.struct((-F.col("score")).alias("worse"), "ordinal", "n_tokens", role.alias("role"), "matched")
    lists = selected.groupBy("doc_id", "req_id").agg(F.array_sort(F.collect_list(item)).alias("items"))  # three times max_matches at most
    kept = lists.select("doc_id", "req_id", F.greatest(F.lit(1.0), -F.col("items")[0]["worse"]).alias("top"), F.posexplode(greedy(F.col("items"), "n_tokens", max_tokens, max_blocks)).alias("pos", "x"))
    return kept.select(
        "doc_id", "req_id", (F.col("pos") + 1).alias("rank"), F.col("x.ordinal").alias("ordinal"), F.col("x.role").alias("role"),
        F.round(-F.col("x.worse"), DIGITS).alias("score"), F.floor(-F.col("x.worse") / F.col("top") * 10_000 + 0.5).cast("long").alias("score_bp"),
        F.array_join("x.matched", " ").alias("matched_terms"), F.col("x.n_tokens").alias("n_tokens"),
    )


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-empty lines of plain texts as blocks: doc_id, ordinal from 1, text with collapsed white space, heading null."""
    from ..functions.text import collapse

    lines = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), collapse), lambda x: x != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("pos", "text")).select(
        "doc_id", (F.col("pos") + 1).alias("ordinal"), "text", F.lit(None).cast("string").alias("heading")
    )


def chat_matches(sources: DataFrame, questions: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The best sources (key, order, text) of each question (key, question), all query terms of equal weight."""
    by = Window.partitionBy(key)
    each = sources.select(key, order, lexical_tokens(F.col("text")).alias("terms")).withColumn("length", F.size("terms"))
    each = each.withColumn("n", F.count("*").over(by)).withColumn("mean", F.avg("length").over(by))
    asked = questions.select(key, F.explode(F.array_distinct(lexical_tokens(F.col("question")))).alias("term"))
    tf = each.select(key, order, "length", "n", "mean", F.explode("terms").alias("term")).join(asked, [key, "term"]).groupBy(key, order, "length", "n", "mean", "term").agg(F.count("*").alias("tf"))
    df = tf.withColumn("df", F.count("*").over(Window.partitionBy(key, "term")))
    s = term_score(F.lit(1.0), F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("mean"))
    scores = df.groupBy(key, order).agg(F.round(F.sum(s), DIGITS).alias("score"))
    return scores.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), order))).where(F.col("place") <= most)


def chat_packets(sources: DataFrame, questions: DataFrame, key: str, order: str, most: int = 6, depth: int = 3, characters: int = 28_000) -> DataFrame:
    """Matches with the neighbours of the first ``depth``, in document order, packed by characters; the first source is always kept."""
    found = chat_matches(sources, questions, key, order, most)
    sides = F.when(F.col("place") <= depth, F.array(F.lit(0), F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0)))
    around = found.select(key, "place", "score", F.col(order).alias("_o"), F.explode(sides).alias("side")).select(key, "place", "side", (F.col("_o") + F.col("side")).alias(order), F.when(F.col("side") == 0, F.col("score")).otherwise(F.col("score") * CONTEXT_SHARE).alias("score"))
    known = sources.select(key, order, F.length("text").cast("long").alias("size"))
    first = Window.partitionBy(key, order).orderBy(F.col("side") != 0, "place", "side")
    chosen = around.join(known, [key, order]).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    item = F.struct(F.col(order).alias("at"), "size", "score", F.when(F.col("side") == 0, "match").otherwise("context").alias("role"))
    lists = chosen.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    head = F.slice("items", 1, 1)
    kept = F.when(F.col("items")[0]["size"] > characters, head).otherwise(greedy(F.col("items"), "size", characters, 1 << 20))
    return lists.select(key, F.posexplode(kept).alias("pos", "x")).select(key, (F.col("pos") + 1).alias("citation"), F.col("x.at").alias(order), "x.role", "x.score")
