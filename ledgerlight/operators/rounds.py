"""Tables written in between: work in rounds, and tables that several parts of a plan read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spark deletes what a query shuffled when the query ends, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, ends the lineage, survives lost executors; deleted when the application ends.

    The folder is ``spark.checkpoint.dir``; only where that is unset (tests), one below the warehouse.
    What the write itself shuffled goes as soon as it is done: no table in between keeps more on disk than its rows.
    """
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    path = f"{place}/settled-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if kept is None else spark.conf.set(CLEANUP, kept)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's place from 1 in ``order``, counted over ranges: no task holds more than one, and only their sizes, one row for each partition, meet in one.

    ``order`` must tell all rows apart. The ranges are written once, so that both readings see the same.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_ahead"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_at", inner).join(F.broadcast(ahead), "_range").withColumn(name, F.col("_ahead") + F.col("_at")).drop("_range", "_at", "_ahead")
