"""Signals after a revision: only the rows that a changed price can reach are computed again.

A price reaches the observations of its own session and of the next 252, and through their ranks the
755 sessions behind those. Changed keys of a ticker are widened to these sessions and merged into
islands; each island is computed from its own bounded history, and all other rows are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.signals import momentum_columns, panel_of_spine, volatility_columns, with_running_gaps
from tickerloom.operators.spine import SignalBounds, filled_spine
from tickerloom.schemas import MOMENTUM_LAG, REFERENCE_SPAN

#: Sessions ahead that a price can change, and sessions back that an observation reads.
REACH = MOMENTUM_LAG + REFERENCE_SPAN


@dataclass(frozen=True)
class Refreshed:
    """Both signals after a revision, and per ticker how many sessions were computed again."""

    momentum: DataFrame
    volatility: DataFrame
    islands: DataFrame


def impact_islands(changed: DataFrame, tickers: DataFrame, bounds: SignalBounds, known_last: int | None) -> DataFrame:
    """ticker, lo, hi: merged ranges of session places whose rows may differ.

    changed has ticker and date; tickers those that already have rows, up to place known_last. A
    ticker without rows gets its whole range, and every ticker the sessions behind known_last.
    """
    spark = changed.sparkSession
    sessions = bounds.calendar.frame(spark).select("pos", F.col("session").alias("date"))
    reached = changed.join(F.broadcast(sessions), "date").select(
        "ticker", F.greatest("pos", F.lit(bounds.first)).alias("lo"), (F.col("pos") + REACH).alias("hi")
    )
    new = changed.select("ticker").distinct().join(tickers, "ticker", "left_anti")
    ranges = reached.unionByName(new.select("ticker", F.lit(bounds.first).alias("lo"), F.lit(bounds.last).alias("hi")))
    if known_last is not None and known_last < bounds.last:
        ahead = tickers.select("ticker", F.lit(known_last + 1).alias("lo"), F.lit(bounds.last).alias("hi"))
        ranges = ranges.unionByName(ahead)
    ranges = ranges.withColumn("hi", F.least("hi", F.lit(bounds.last))).where("lo <= hi")
    # A ticker has at most one change per session, so its ranges are few.
    line = Window.partitionBy("ticker").orderBy("lo", "hi")
    reach = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    apart = ranges.distinct().withColumn("opens", F.coalesce(F.col("lo") > reach + 1, F.lit(True)).cast("int"))
    numbered = apart.withColumn("island", F.sum("opens").over(line))
    return numbered.groupBy("ticker", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def island_spine(prices: DataFrame, islands: DataFrame, bounds: SignalBounds, earliest: int) -> DataFrame:
    """The dense spine of every island from the history its rows read; the key is (ticker, lo).

    earliest is the lowest island start: nothing before its history is read from the prices.
    """
    spark = prices.sparkSession
    days = bounds.calendar.sessions
    sessions = bounds.calendar.frame(spark).select("pos", F.col("session").alias("date"))
    base = F.greatest(F.col("lo") - (REACH + 1), F.lit(0))
    from_day = days[max(0, earliest - REACH - 1)]
    rows = (
        prices.where((F.col("date") >= F.lit(from_day)) & (F.col("date") <= F.lit(bounds.end_day)))
        .select("ticker", "date", "adjusted_close")
        .join(F.broadcast(sessions), "date")
    )
    key = F.struct("ticker", "lo").alias("key")
    observed = rows.join(islands, "ticker").where((F.col("pos") >= base) & (F.col("pos") <= F.col("hi"))).select(
        key, "pos", "adjusted_close", F.lit(True).alias("observed"), base.alias("base"), F.col("hi").alias("last")
    )
    # A row before the first session, so that an island without prices has its sessions too.
    opening = islands.select(
        key,
        (base - 1).alias("pos"),
        F.lit(None).cast("double").alias("adjusted_close"),
        F.lit(False).alias("observed"),
        base.alias("base"),
        F.col("hi").alias("last"),
    )
    return filled_spine(observed.unionByName(opening).withColumnRenamed("key", "ticker"))


def refreshed_rows(prices: DataFrame, islands: DataFrame, bounds: SignalBounds, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both signals on the sessions of the islands, computed once below the folder."""
    spark = prices.sparkSession
    earliest = islands.agg(F.min("lo")).first()[0]
    calendar = bounds.calendar.frame(spark).select("pos", "session", "next_session", "back_21", "back_252")
    spine = island_spine(prices, islands, bounds, bounds.first if earliest is None else earliest)
    panel = panel_of_spine(with_running_gaps(spine.join(F.broadcast(calendar), "pos")))
    own = panel.where(F.col("pos") >= F.col("ticker.lo")).withColumn("ticker", F.col("ticker.ticker"))
    own.select(
        F.struct(*momentum_columns()).alias("momentum"), F.struct(*volatility_columns()).alias("volatility")
    ).write.mode("errorifexists").parquet(folder)
    both = spark.read.parquet(folder)
    return both.select("momentum.*"), both.select("volatility.*")


def merged_rows(old: DataFrame, fresh: DataFrame, islands: DataFrame, bounds: SignalBounds) -> DataFrame:
    """The rows outside all islands and the fresh ones; a ticker's islands travel as one short list."""
    spark = old.sparkSession
    sessions = bounds.calendar.frame(spark).select("pos", "session")
    dated = (
        islands.join(F.broadcast(sessions.select(F.col("pos").alias("lo"), F.col("session").alias("a"))), "lo")
        .join(F.broadcast(sessions.select(F.col("pos").alias("hi"), F.col("session").alias("b"))), "hi")
        .groupBy("ticker")
        .agg(F.collect_list(F.struct("a", "b")).alias("islands"))
    )
    inside = F.exists("islands", lambda i: (F.col("signal_date") >= i["a"]) & (F.col("signal_date") <= i["b"]))
    kept = old.join(dated, "ticker", "left").where(~F.coalesce(inside, F.lit(False))).select(*old.columns)
    return kept.unionByName(fresh.select(*old.columns))


def refresh_signals(
    momentum: DataFrame,
    volatility: DataFrame,
    prices: DataFrame,
    changed: DataFrame,
    bounds: SignalBounds,
    folder: str,
) -> Refreshed:
    """Both signals of the revised prices from those before, for the same first session.

    changed holds the keys whose rows were added or revised. The result equals a full computation;
    a panel whose first session moved needs one, and is an error here.
    """
    days = bounds.calendar.sessions
    row = momentum.agg(F.min("signal_date"), F.max("signal_date")).first()
    if row[0] is not None and row[0] != days[bounds.first]:
        raise ValueError("the first session of the panel changed: compute the signals in full")
    last = None if row[1] is None else bounds.calendar.index_until(row[1])
    tickers = momentum.select("ticker").distinct()
    keys = changed.select("ticker", "date").where(F.col("date") <= F.lit(bounds.end_day))
    islands = impact_islands(keys, tickers, bounds, last)
    islands.write.mode("errorifexists").parquet(f"{folder}/islands")
    islands = prices.sparkSession.read.parquet(f"{folder}/islands")
    m, v = refreshed_rows(prices, islands, bounds, f"{folder}/rows")
    return Refreshed(
        merged_rows(momentum, m, islands, bounds), merged_rows(volatility, v, islands, bounds), islands
    )
