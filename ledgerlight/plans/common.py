"""What the query modules share: tables, and pieces of SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import STOP_WORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all tasks by ``keys``: a small file is one piece, however much Python does with each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows that a task of ``dealt`` makes its rows from.
ROWS = 20_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """As ``spread``, but with a task for every ROWS rows at most, so that what a task holds does not grow with the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // ROWS)), *keys)


def sql_collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\s\x{{0B}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+', ' ', 'g'), ' ')"


def sql_tokens(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"list_filter(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]+'), lambda tok: regexp_replace(tok, '^-|-$', '')), lambda tok: length(tok) >= 3 AND tok NOT IN ({stop}))"


#: Lines of ``documents`` as blocks (doc_id, ordinal, text).
SQL_BLOCKS = f"""
lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql_collapse('l')}), lambda l: l <> '') AS ls FROM documents),
blocks AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS ordinal, unnest(ls) AS text FROM lines)
"""
