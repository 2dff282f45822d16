"""Pearson and Spearman dependence between the two percentiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.schemas import DEPENDENCE_COLUMNS
from tickerloom.sources.calendar import SessionCalendar

MIN_PAIRS = 3


def paired_percentiles(momentum: DataFrame, volatility: DataFrame, universe: DataFrame) -> DataFrame:
    """Configured (ticker, session) keys on which both percentiles are present."""
    x = momentum.where("momentum_percentile is not null").select(
        "ticker", "signal_date", F.col("momentum_percentile").alias("x")
    )
    y = volatility.where("volatility_percentile is not null").select(
        "ticker", "signal_date", F.col("volatility_percentile").alias("y")
    )
    return x.join(y, ["ticker", "signal_date"]).join(universe.select("ord", "ticker"), "ticker")


def average_ranks(pairs: DataFrame, group: str, value: str) -> DataFrame:
    """Average rank of every distinct value within its session.

    A session's group grows with the instruments, so the ranks are made from counts
    of distinct values: they combine before the shuffle, and a percentile is a
    half-integer over at most 755, which bounds a group to about half a million values.
    """
    counts = pairs.groupBy(group, value).agg(F.count(F.lit(1)).alias("ties"))
    below = (
        Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.select(
        group,
        value,
        (F.coalesce(F.sum("ties").over(below), F.lit(0)) + (F.col("ties") + 1) / 2.0).alias(f"rank_{value}"),
    )


def ticker_ranks(pairs: DataFrame) -> DataFrame:
    """Pairs with the average ranks of both values within their ticker.

    A ticker has at most one pair per session, so its windows are bounded by the calendar;
    they and the aggregate after them share one partitioning.
    """
    for v in ("x", "y"):
        place = F.rank().over(Window.partitionBy("ticker").orderBy(v))
        pairs = pairs.withColumn(f"rank_{v}", place)
    for v in ("x", "y"):
        ties = F.count(F.lit(1)).over(Window.partitionBy("ticker", v))
        pairs = pairs.withColumn(f"rank_{v}", F.col(f"rank_{v}") + (ties - 1) / 2.0)
    return pairs


def _guarded(x: str, y: str) -> Column:
    """Correlation, null instead of an error on a constant side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def _status(pairs: Column, flat_x: Column, flat_y: Column) -> Column:
    return (
        F.when(pairs < MIN_PAIRS, "insufficient_pairs")
        .when(flat_x | flat_y, "constant_input")
        .otherwise("available")
    )


def correlations(pairs: DataFrame, group: str) -> DataFrame:
    """Pair count, date range, status and both estimates per group that has pairs."""
    dates = []
    if group == "signal_date":
        ranked = pairs.join(average_ranks(pairs, group, "x"), [group, "x"]).join(
            average_ranks(pairs, group, "y"), [group, "y"]
        )
    else:
        ranked = ticker_ranks(pairs)
        dates = [
            F.min("signal_date").alias("first_signal_date"),
            F.max("signal_date").alias("last_signal_date"),
        ]
    measured = ranked.groupBy(group).agg(
        F.count(F.lit(1)).alias("pair_count"),
        *dates,
        (F.min("x") == F.max("x")).alias("flat_x"),
        (F.min("y") == F.max("y")).alias("flat_y"),
        _guarded("x", "y").alias("pearson"),
        _guarded("rank_x", "rank_y").alias("spearman"),
    )
    return measured.withColumn("status", _status(F.col("pair_count"), F.col("flat_x"), F.col("flat_y")))


def _by_estimator(frame: DataFrame) -> DataFrame:
    rows = F.array(
        *[F.struct(F.lit(e).alias("estimator"), F.col(e).alias("value")) for e in ("pearson", "spearman")]
    )
    return frame.select("*", F.inline(rows)).withColumn(
        "estimate", F.when(F.col("status") == "available", F.col("value"))
    )


def dependence_by_ticker(pairs: DataFrame, universe: DataFrame) -> DataFrame:
    """Two rows per configured ticker, with or without pairs."""
    joined = universe.select("ord", "ticker").join(correlations(pairs, "ticker"), "ticker", "left")
    filled = joined.withColumns(
        {
            "pair_count": F.coalesce("pair_count", F.lit(0).cast("bigint")),
            "status": F.coalesce("status", F.lit("insufficient_pairs")),
        }
    )
    return _by_estimator(filled).select(
        F.lit("per_etf").alias("scope"),
        "estimator",
        "ticker",
        F.lit(None).cast("date").alias("signal_date"),
        "pair_count",
        "first_signal_date",
        "last_signal_date",
        F.when(F.col("pair_count") > 0, F.array("ticker"))
        .otherwise(F.expr("cast(array() as array<string>)"))
        .alias("included_tickers"),
        F.lit("not_applicable").alias("universe_status"),
        "status",
        "estimate",
    )


def session_members(pairs: DataFrame) -> DataFrame:
    """The included tickers of every session in long form, at any universe size."""
    return pairs.select("signal_date", "ord", "ticker")


def dependence_by_session(
    pairs: DataFrame, universe: DataFrame, calendar: SessionCalendar, first: date, last: date
) -> DataFrame:
    """Two rows per session of the range, with or without pairs.

    The universe is a configured dimension; its size is read once to compare each
    session with it. A session's list of included tickers is published whole, whatever the
    size of the universe; session_members gives the same facts as rows.
    """
    spark = pairs.sparkSession
    configured = universe.count()
    measured = correlations(pairs, "signal_date")
    members = pairs.groupBy("signal_date").agg(
        F.sort_array(F.collect_list(F.struct("ord", "ticker")))["ticker"].alias("members")
    )
    measured = measured.join(members, "signal_date")
    included = F.coalesce("members", F.expr("cast(array() as array<string>)"))
    sessions = calendar.between(spark, first, last).select(F.col("session").alias("signal_date"))
    joined = sessions.join(measured, "signal_date", "left").withColumns(
        {
            "pair_count": F.coalesce("pair_count", F.lit(0).cast("bigint")),
            "status": F.coalesce("status", F.lit("insufficient_pairs")),
        }
    )
    seen = F.when(F.col("pair_count") > 0, F.col("signal_date"))
    full = F.col("pair_count") == configured
    return _by_estimator(joined).select(
        F.lit("per_session").alias("scope"),
        "estimator",
        F.lit(None).cast("string").alias("ticker"),
        "signal_date",
        "pair_count",
        seen.alias("first_signal_date"),
        seen.alias("last_signal_date"),
        included.alias("included_tickers"),
        F.when(full, "full_universe").otherwise("incomplete_universe").alias("universe_status"),
        "status",
        "estimate",
    )


def dependence(
    momentum: DataFrame,
    volatility: DataFrame,
    universe: DataFrame,
    calendar: SessionCalendar,
    first: date,
    last: date,
) -> DataFrame:
    """The full dependence table: 2·(instruments + sessions) rows."""
    pairs = paired_percentiles(momentum, volatility, universe)
    return (
        dependence_by_ticker(pairs, universe)
        .unionByName(dependence_by_session(pairs, universe, calendar, first, last))
        .select(*DEPENDENCE_COLUMNS)
    )
