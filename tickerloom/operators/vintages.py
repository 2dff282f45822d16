"""Deduplication and the revision rules between two vintages of a canonical table."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.schemas import KEY, ContractError

REJECTED = ("lose", "stale", "conflict")


def _any(columns: list[Column]) -> Column:
    return reduce(or_, columns)


def _all(columns: list[Column]) -> Column:
    return reduce(and_, columns)


def grouped_copies(df: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """One row per key with its values, latest retrieval and whether its copies disagree.

    Copies agree when every column has one value, or none, in all of them. Extremes
    and counts show that in fixed-size buffers that combine before the shuffle, so a
    key with very many copies is no burden to the task that ends up with it.
    """
    # Most keys have one copy, whose extremes are equal: as two equal runs of bytes they compress in the shuffle.
    measures = [
        *[F.min(c).alias(c) for c in values],
        *[F.max(c).alias(f"{c}_top") for c in values],
        *[F.count(c).alias(f"{c}_n") for c in values],
    ]
    grouped = df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("copies"), F.max("retrieved_at").alias("retrieved_at"), *measures
    )
    differs = _any(
        [
            (F.col(c) != F.col(f"{c}_top")) | ((F.col(f"{c}_n") > 0) & (F.col(f"{c}_n") < F.col("copies")))
            for c in values
        ]
    )
    return grouped.select(
        *KEY, *values, "retrieved_at", "copies", F.coalesce(differs, F.lit(False)).alias("in_conflict")
    )


def deduplicate(df: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """One row per key whose copies agree, at its latest retrieval time."""
    return grouped_copies(df, values).where(~F.col("in_conflict")).select(*df.columns)


def duplicate_conflicts(df: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Keys whose copies hold different values."""
    return grouped_copies(df, values).where("in_conflict").select(*KEY, "copies")


def deduplicate_strict(df: DataFrame, values: tuple[str, ...]) -> DataFrame:
    bad = duplicate_conflicts(df, values).orderBy(*KEY).limit(5).collect()
    if bad:
        raise ContractError(f"conflicting values for duplicate keys: {[tuple(r[:2]) for r in bad]}")
    return deduplicate(df, values)


def vintage_actions(existing: DataFrame, incoming: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """What an incoming vintage does to every key of either table.

    Both inputs hold one row per key. The checks apply in this order: a value that
    would be lost, equal values, an older retrieval, an equal retrieval, a revision.
    """
    e, i = existing.alias("e"), incoming.alias("i")
    joined = e.join(i, list(KEY), "full_outer")
    old_time, new_time = F.col("e.retrieved_at"), F.col("i.retrieved_at")
    loses = _any([F.col(f"e.{c}").isNotNull() & F.col(f"i.{c}").isNull() for c in values])
    same = _all([F.col(f"e.{c}").eqNullSafe(F.col(f"i.{c}")) for c in values])
    action = (
        F.when(new_time.isNull(), "existing_only")
        .when(old_time.isNull(), "new")
        .when(loses, "lose")
        .when(same & (new_time > old_time), "advance")
        .when(same, "identical")
        .when(new_time < old_time, "stale")
        .when(new_time == old_time, "conflict")
        .otherwise("revise")
    )
    takes_new = F.col("action").isin("new", "revise")
    return joined.withColumn("action", action).select(
        *KEY,
        *[F.when(takes_new, F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in values],
        F.when(takes_new | (F.col("action") == "advance"), new_time).otherwise(old_time).alias("retrieved_at"),
        "action",
        *[
            (F.col(f"e.{c}").isNotNull() & F.col(f"i.{c}").isNotNull() & (F.col(f"e.{c}") != F.col(f"i.{c}"))).alias(
                f"{c}_changed"
            )
            for c in values
        ],
    )


def merged(actions: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The combined table: existing rows of rejected keys stay as they are."""
    return actions.select(*columns)


def rejected(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action").isin(*REJECTED)).select(*KEY, "action")


def revision_summary(actions: DataFrame) -> DataFrame:
    """Revised rows per ticker."""
    return actions.where("action = 'revise'").groupBy("ticker").agg(F.count(F.lit(1)).alias("revised_rows"))


def vanished_rows(existing: DataFrame, statuses: DataFrame) -> DataFrame:
    """Stored keys inside a successful ticker's query window that its response lacks.

    Failed, empty and unrequested tickers claim nothing and are exempt.
    """
    success = statuses.where("status = 'success'")
    windows = success.select("ticker", "query_start", "query_end")
    returned = success.select("ticker", F.explode("returned_dates").alias("date"))
    # Lists of dates are taken for far fewer than they hold; like rows, they are never broadcast.
    absent = existing.select(*KEY).join(returned.hint("merge"), list(KEY), "left_anti")
    return (
        absent.join(windows, "ticker")
        .where((F.col("date") >= F.col("query_start")) & (F.col("date") < F.col("query_end")))
        .select(*KEY)
    )


def common_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*KEY).intersect(right.select(*KEY))


def frame_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, counting copies; empty means equal.

    Arrays and doubles compare as values, nulls compare equal. One union and one
    grouping replace two exceptAll passes.
    """
    columns = left.columns
    tagged = left.select(*columns, F.lit(1).alias("side")).unionByName(
        right.select(*columns, F.lit(-1).alias("side"))
    )
    return (
        tagged.groupBy(*columns)
        .agg(F.sum("side").alias("surplus"))
        .where("surplus <> 0")
        .withColumn("only_in", F.when(F.col("surplus") > 0, "left").otherwise("right"))
    )


def vintage_difference(actions: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """One-row revision report: keys added and removed, rows and fields changed on shared keys."""
    shared = ~F.col("action").isin("existing_only", "new")
    changed = _any([F.col(f"{c}_changed") for c in values])
    return actions.agg(
        F.count_if(shared).alias("shared_keys"),
        F.count_if(F.col("action") == "new").alias("added_keys"),
        F.count_if(F.col("action") == "existing_only").alias("removed_keys"),
        F.count_if(shared & changed).alias("changed_rows"),
        *[F.count_if(shared & F.col(f"{c}_changed")).alias(f"{c}_changed") for c in values],
    )


def signal_difference(first: DataFrame, second: DataFrame, raw: str, percentile: str) -> DataFrame:
    """How many signal keys shared by two runs changed their raw value or percentile."""
    keys = ["ticker", "signal_date"]
    a, b = first.alias("a"), second.alias("b")

    def changed(name: str) -> Column:
        return F.count_if(~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")))

    return a.join(b, keys).agg(
        F.count(F.lit(1)).alias("shared_signal_keys"),
        changed(raw).alias("raw_changed"),
        changed(percentile).alias("percentile_changed"),
    )
