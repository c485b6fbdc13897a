"""Contract queries of the corpus operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import licenses, merkle, quality, secrets, urls
from .common import documents
from .exprs import let, words


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op2_near_duplicates(spark, sf_dir):
    from .minhash import classes

    return classes(documents(spark, sf_dir))


def op3_urls(spark, sf_dir):
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_repeats(spark, sf_dir):
    from .repeats import digests

    return digests(documents(spark, sf_dir))


def op5_bpe(spark, sf_dir):
    from .bpe import round_trip

    return round_trip(documents(spark, sf_dir), vocabulary_file("word_bpe_49k.json"))


def op6_neighbours(spark, sf_dir):
    from .neighbours import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_packing(spark, sf_dir):
    from .packing import pack

    return pack(documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"))


def op8_quality(spark, sf_dir):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", *(f"_q.{f}" for f in fields))


def op9_token_counts(spark, sf_dir):
    from .wordpieces import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"))


def op10_secrets(spark, sf_dir):
    s = F.col("_spans")
    found = secrets.scanned(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "_spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(s, lambda x: x["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(s).alias("spans"))


def op11_context_trees(spark, sf_dir):
    from .ctw import scores

    got = scores(documents(spark, sf_dir))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op12_merkle(spark, sf_dir):
    got = merkle.proofs(documents(spark, sf_dir), shown=merkle.tampered_leaf())
    return got.select(F.col("place").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _made_periodic(docs):
    """Where 10 divides the check sum of the id, the words from one place on repeat those of a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    return docs.select("doc_id", F.when((h % 10 == 0) & (F.size(words(F.col("text"))) > 0), let(words(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir):
    from .periodic import found

    best = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    got = found(_made_periodic(documents(spark, sf_dir))).withColumn("b", F.get(best, F.lit(0)))
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start"), (-F.col("b.short")).alias("length"), F.col("b.period"), F.expr("(-b.short * 1000) div b.period").alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_licenses, op2_near_duplicates, op3_urls, op4_repeats, op5_bpe, op6_neighbours, op7_packing, op8_quality, op9_token_counts, op10_secrets, op11_context_trees, op12_merkle, op13_periodic_runs)}
ORACLES = {"op1_licenses": licenses.oracle(), "op3_urls": urls.oracle(), "op8_quality": quality.oracle(), "op10_secrets": secrets.oracle(), "op12_merkle": merkle.oracle()}
