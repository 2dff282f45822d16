"""Sorted tables: what the writer promises and what the check notices."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from tickerloom.plans import ordering as od


def table(spark):
    return spark.range(20_000).select(
        F.format_string("T%02d", F.col("id") % 37).alias("ticker"),
        F.when(F.col("id") % 11 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 37).cast("int"))).alias("date"),
        "id",
    )


def rules(spark, folder):
    return {(r["rule"], r["found"]) for r in od.order_violations(spark, folder).collect()}


def test_written_tables_are_sorted_over_all_files(spark, tmp_path):
    folder = str(tmp_path / "sorted")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        od.write_sorted(table(spark), folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{folder}/part-*")) > 2 and rules(spark, folder) == set()
    assert spark.read.parquet(folder).count() == 20_000


def test_one_tampered_file_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "tampered")
    sorted_rows = table(spark).repartitionByRange(4, "ticker", "date").sortWithinPartitions("ticker", "date")
    # The last two rows of one partition change places with the first two of it.
    sorted_rows.write.parquet(folder)
    part = sorted(glob.glob(f"{folder}/part-*"))[1]
    rows = spark.read.parquet(part).coalesce(1).collect()
    turned = rows[-2:] + rows[2:-2] + rows[:2]
    spark.createDataFrame(turned, table(spark).schema).coalesce(1).write.parquet(str(tmp_path / "one"))
    files = spark._jvm.java.nio.file.Files
    path = lambda p: spark._jvm.java.nio.file.Paths.get(p, spark.sparkContext._gateway.new_array(spark._jvm.String, 0))
    files.delete(path(part))
    crc = part.rpartition("/")
    files.deleteIfExists(path(f"{crc[0]}/.{crc[2]}.crc"))
    files.copy(path(glob.glob(str(tmp_path / "one" / "part-*"))[0]), path(part), spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.CopyOption, 0))
    found = rules(spark, folder)
    assert {r for r, _ in found} == {"rows_out_of_order"} and all(n <= 2 for _, n in found)


def test_tables_without_rows_or_key(spark, tmp_path):
    od.write_sorted(table(spark).where("false"), str(tmp_path / "none"))
    assert rules(spark, str(tmp_path / "none")) == set()
    od.write_sorted(table(spark).select("id"), str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 20_000


def test_one_file_is_checked_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(od, "BLOCK", 1000)
    rows = spark.range(5000).select(F.format_string("T%05d", "id").alias("ticker"), "id")
    folder = str(tmp_path / "one")
    rows.orderBy(F.desc("ticker")).coalesce(1).write.parquet(folder)
    assert rules(spark, folder) == {("rows_out_of_order", 4999)}
    ordered = str(tmp_path / "ordered")
    rows.orderBy("ticker").coalesce(1).write.parquet(ordered)
    assert rules(spark, ordered) == set()
