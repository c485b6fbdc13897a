"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``; only where that is unset (tests), one below the warehouse."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    return got or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def _on_disk(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends the lineage, survives lost executors, and is computed once.

    The folder goes when the application ends, or earlier by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, fs = _on_disk(spark, path)
    fs.deleteOnExit(at)
    got = spark.read.schema(df.schema).parquet(path)
    got._cut_path = path
    return got


def release(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` whose readers have all been written themselves."""
    for t in tables:
        at, fs = _on_disk(t.sparkSession, t._cut_path)
        fs.delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns of any name do no harm."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as no column of ``df`` has, for a working column; names are compared without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def small_batches(batches, most: int = 8 << 20):
    """Arrow batches cut to about ``most`` bytes, so that very long texts are not held as Python objects all at once."""
    for b in batches:
        step = max(1, int(b.num_rows * most / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
