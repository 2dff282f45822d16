"""The corpus pipeline: quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the docs of the next. All but the last
return the columns of documents.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tickerloom.llm import minhash, packing, quality, queries, secrets  # noqa: E402
from tickerloom.llm.common import discard, noted_folders, table, written  # noqa: E402


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    machine = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, machine, "__quality").where(F.col("__quality") >= quality.THRESHOLD)
    return scored.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word similarities of 0.8 or more connect.

    SimHash links are taken first and compared exactly; MinHash finds the similar pairs beyond its radius.
    """
    return minhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the live-looking secrets in texts; widely copied examples stay."""
    return secrets.redacted(docs, queries.owner(), queries.repository())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row per piece, as the packing query returns."""
    return queries.packed_columns(packing.pack(packing.pieces(docs, queries.WORD_BPE)))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: A factorisation machine and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents below sf_dir."""
    docs, folder = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with noted_folders() as folders:
            result = stage(spark, docs, sf_dir)
        docs, after = written(result, f"stage-{name}")
        # What the stage left is read by nobody once its result is written.
        for used in (*folders, *([folder] if folder else [])):
            discard(spark, used)
        folder = after
    return docs
