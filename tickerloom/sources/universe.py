"""The configured instrument list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.quality import require_none
from tickerloom.schemas import ContractError

UNIVERSE_DDL = "ord bigint, ticker string, name string, category string"


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Read a JSON document with an ordered ``etfs`` list into (ord, ticker, name, category)."""
    document = spark.read.option("multiLine", True).schema(
        "etfs array<struct<ticker: string, name: string, category: string>>"
    ).json(path)
    rows = document.select(F.posexplode("etfs").alias("at", "entry"))
    return rows.select(
        (F.col("at") + 1).cast("bigint").alias("ord"),
        *[F.trim(F.col("entry")[c]).alias(c) for c in ("ticker", "name", "category")],
    )


def universe_violations(universe: DataFrame) -> DataFrame:
    """Blank fields and tickers that repeat regardless of case."""
    blank = universe.select(
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"blank_{c}"))
                        for c in ("ticker", "name", "category")
                    ]
                )
            )
        ).alias("rule"),
        "ticker",
    )
    repeated = (
        universe.groupBy(F.lower(F.trim("ticker")).alias("folded"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("ticker").alias("ticker"))
        .where("n > 1")
        .select(F.lit("duplicate_ticker").alias("rule"), "ticker")
    )
    return blank.unionByName(repeated)


def validate_universe(universe: DataFrame) -> None:
    found = universe_violations(universe).select(
        F.lit(1).alias("priority"), "rule", "ticker", F.lit(None).cast("date").alias("date")
    )
    require_none(found, "universe entries")
    if universe.isEmpty():
        raise ContractError("the universe must not be empty")


BLOCK = 10_000


def universe_hash(universe: DataFrame) -> DataFrame:
    """SHA-256 of the definitions as JSON in configured order.

    The list is cut into blocks of ten thousand entries, and the hash is that of the block
    hashes in order, also of a single block, so no task holds more than one block's text;
    the hashes themselves meet in one task.
    """
    entries = F.sort_array(F.collect_list(F.struct("ord", "category", "name", "ticker")))
    plain = F.transform(
        entries,
        lambda e: F.struct(
            e["category"].alias("category"), e["name"].alias("name"), e["ticker"].alias("ticker")
        ),
    )
    blocks = universe.groupBy(F.expr(f"(ord - 1) div {BLOCK}").alias("block")).agg(
        F.sha2(F.to_json(plain), 256).alias("digest"), F.count(F.lit(1)).alias("entries")
    )
    digests = F.sort_array(F.collect_list(F.struct("block", "digest")))["digest"]
    joined = F.sha2(F.array_join(digests, ""), 256)
    return blocks.agg(joined.alias("universe_sha256"), F.sum("entries").alias("instruments"))
