"""Globally sorted Parquet tables: written by ranges of the key, checked from the files themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The key a published table is sorted by, as far as it has these columns.
ORDER = ("scope", "estimator", "ticker", "date", "signal_date")
#: Rows of a file that one task puts in their places.
BLOCK = 2**18


def order_of(df: DataFrame) -> list[str]:
    return [c for c in ORDER if c in df.columns]


def write_sorted(df: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """Write a table whose files follow each other in key order, each sorted in itself.

    Ranges of the key become partitions of even size whatever the keys, so no task sorts the table.
    """
    order = order or order_of(df)
    ranged = df.repartitionByRange(*order) if order else df
    (ranged.sortWithinPartitions(*order) if order else ranged).write.mode("errorifexists").parquet(folder)


def order_violations(spark: SparkSession, folder: str, order: list[str] | None = None) -> DataFrame:
    """rule, file, found: rows of a file behind a larger key, and files that begin before one's end.

    Rows are taken at their place in their file, in blocks of `BLOCK`, so that a file of any size is dealt
    to many tasks; blocks and files are compared by their first and last keys alone.
    """
    table = spark.read.parquet(folder)
    order = order or order_of(table)
    rows = table.select(
        F.struct(*order).alias("key"),
        F.col("_metadata.file_name").alias("file"),
        F.floor(F.col("_metadata.row_index") / BLOCK).alias("block"),
        F.col("_metadata.row_index").alias("place"),
    )
    before = F.lag("key").over(Window.partitionBy("file", "block").orderBy("place"))
    per_block = (
        rows.withColumn("before", before)
        .groupBy("file", "block")
        .agg(
            F.min_by("key", "place").alias("first"),
            F.max_by("key", "place").alias("end"),
            F.max("key").alias("last"),
            F.count_if(F.col("before") > F.col("key")).alias("found"),
        )
    )
    # One row per block, one per file.
    joint = F.lag("end").over(Window.partitionBy("file").orderBy("block")) > F.col("first")
    per_file = (
        per_block.withColumn("joint", joint)
        .groupBy("file")
        .agg(
            F.min_by("first", "block").alias("first"),
            F.max("last").alias("last"),
            (F.sum("found") + F.count_if("joint")).alias("found"),
        )
    )
    following = per_file.withColumn("previous", F.lag("last").over(Window.orderBy("file")))
    unsorted = following.where("found > 0").select(F.lit("rows_out_of_order").alias("rule"), "file", "found")
    overlapping = following.where(F.col("previous") > F.col("first")).select(
        F.lit("file_begins_too_early").alias("rule"), "file", F.lit(1).cast("bigint").alias("found")
    )
    return unsorted.unionByName(overlapping)
