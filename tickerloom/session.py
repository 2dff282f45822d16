"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: int | str = 8, app: str = "tickerloom", **settings: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=None)
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="tickerloom-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a session whose executors are threads of the driver may go without the setting, as
    tests do; its own folder is then shared by nature.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _test_folder()


def new_folder(spark: SparkSession, purpose: str) -> str:
    """An unused folder below the shared one."""
    return f"{shared_folder(spark)}/tickerloom/{purpose}-{uuid.uuid4().hex}"


def stored_in(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """As `stored`, with the folder, for callers that remove it when they are done."""
    folder = new_folder(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    return stored_in(df, purpose)[0]


def side_by_side(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """The results of steps that do not need each other, whose Spark jobs share the cluster; the first error is raised."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table; unlike one made of an empty list, reading it starts no Python worker."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
