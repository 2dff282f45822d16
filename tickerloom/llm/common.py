"""Helpers the operators share: tables, whole texts, row numbers and prefix sums."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.session import new_folder
from tickerloom.sources.files import remove

#: Characters handled at a time inside a task; longer texts are handled alone, never cut.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Lets the Python workers of a local session import the library from the driver's folder.

    On a cluster the library is installed on the executors, and nothing is done here.
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if spark.sparkContext.master.startswith("local[") and root not in known.get("PYTHONPATH", ""):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH")]))


def whole_text(column: str | Column = "text") -> Column:
    """The whole text; a null text is an empty one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts that hold about `chars` characters each."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside further lambdas."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(lengths: Column, chunk: int = 256) -> Column:
    """Sums of all earlier entries of an array of longs, for each entry.

    Sums are kept per chunk, so that an array of n entries takes about n * chunk steps and not
    the square of n.
    """
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: a + x)

    def of(values: Column) -> Column:
        last = F.greatest(F.floor((F.size(values) - 1) / chunk), F.lit(0)).cast("int")
        chunks = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: total(F.slice(values, k * chunk + 1, F.lit(chunk))),
        )
        starts = let(
            chunks,
            lambda sums: F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k))),
        )
        return let(starts, lambda begin: F.transform(values, lambda _, i: within(values, begin, i)))

    def within(values: Column, begin: Column, i: Column) -> Column:
        k = F.floor(i / chunk).cast("int")
        return F.get(begin, k) + total(F.slice(values, k * chunk + 1, i % chunk))

    return let(lengths, of)


def check_columns(df: DataFrame, wanted: Iterable[str]) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


_noted: list[list[str]] = []


@contextmanager
def noted_folders() -> Iterator[list[str]]:
    """The folders written within, for a caller that removes them once their reader is done."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def written(df: DataFrame, purpose: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and the folder, for `discard`."""
    folder = new_folder(df.sparkSession, purpose)
    for folders in _noted:
        folders.append(folder)
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """As `written`, and the shuffle files behind the result go once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return written(df, purpose)
    finally:
        conf.set(_CLEANUP, before)


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder that no later step reads."""
    remove(spark, folder)
