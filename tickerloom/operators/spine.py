"""Bounds and the dense ticker × session spine."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.schemas import ContractError
from tickerloom.sources.calendar import SessionCalendar


@dataclass(frozen=True)
class SignalBounds:
    """Session positions that limit one signal calculation."""

    calendar: SessionCalendar
    origin: int
    first: int
    last: int

    @property
    def end_day(self) -> date:
        return self.calendar.sessions[self.last]


def signal_bounds(
    prices: DataFrame,
    start: date | None = None,
    end: date | None = None,
    price_range: tuple[date, date] | None = None,
) -> SignalBounds | None:
    """Resolve output bounds against the panel's own first and last date.

    One single-row aggregate over the date column; pass ``price_range`` when it is
    already known. Returns None for an empty panel.
    """
    if start is not None and end is not None and start > end:
        raise ContractError("evaluation_start must be on or before evaluation_end")
    if price_range is None:
        row = prices.agg(F.min("date"), F.max("date")).first()
        price_range = (row[0], row[1])
    earliest, latest = price_range
    if earliest is None:
        return None
    start = start or earliest
    end = end or latest
    if start < earliest:
        raise ContractError("evaluation_start cannot precede the earliest price date")
    if end < earliest:
        raise ContractError("evaluation_end cannot precede the earliest price date")
    if start > end:
        raise ContractError("evaluation_start must be on or before evaluation_end")
    calendar = SessionCalendar.around(earliest, end)
    first, last = calendar.index_from(start), calendar.index_until(end)
    if first > last:
        raise ContractError("the evaluation range contains no session")
    return SignalBounds(calendar, calendar.index_from(earliest), first, last)


def off_calendar(prices: DataFrame, calendar: SessionCalendar) -> DataFrame:
    """Price rows that do not fall on a session; they are errors, never dropped silently."""
    sessions = calendar.frame(prices.sparkSession).select(F.col("session").alias("date"))
    return prices.join(F.broadcast(sessions), "date", "left_anti")


def dense_spine(prices: DataFrame, bounds: SignalBounds, lookback: int) -> DataFrame:
    """Every ticker on every session from ``lookback`` sessions before the output range.

    A gap is filled by exploding each row up to the ticker's next one, so the spine
    needs one shuffle on ticker and neither a cross join nor a join back to prices.
    Sessions without a price row carry ``row_present = false`` and no value.
    """
    spark = prices.sparkSession
    days = bounds.calendar.sessions
    base = max(0, bounds.first - lookback)
    sessions = bounds.calendar.frame(spark)

    rows = prices.where(F.col("date") <= F.lit(bounds.end_day)).select("ticker", "date", "adjusted_close")
    observed = (
        rows.where(F.col("date") >= F.lit(days[base]))
        .join(F.broadcast(sessions.select("pos", F.col("session").alias("date"))), "date")
        .select("ticker", "pos", "adjusted_close", F.lit(True).alias("observed"))
    )
    if base > bounds.origin:
        # Tickers whose last row lies before the lookback still own output rows.
        known = rows.where(F.col("date") < F.lit(days[base])).select("ticker").distinct()
        observed = observed.unionByName(
            known.select(
                "ticker",
                F.lit(base - 1).alias("pos"),
                F.lit(None).cast("double").alias("adjusted_close"),
                F.lit(False).alias("observed"),
            )
        )
    return filled_spine(observed.withColumns({"base": F.lit(base), "last": F.lit(bounds.last)}))


def filled_spine(observed: DataFrame) -> DataFrame:
    """Every session place from `base` to `last` of each ticker, from its observed rows.

    observed has ticker (any key), pos, adjusted_close, observed, base and last.
    """
    window = Window.partitionBy("ticker").orderBy("pos")
    # The exploded rows and the ranking weigh far more than the shuffled ones, so the
    # configured number of partitions is kept: adaptive coalescing sees only the latter.
    partitions = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = observed.repartition(partitions, "ticker").select(
        "ticker",
        "pos",
        "adjusted_close",
        "observed",
        F.when(F.lag("pos").over(window).isNull(), F.col("base")).otherwise(F.col("pos")).alias("from_pos"),
        F.coalesce(F.lead("pos").over(window) - 1, F.col("last")).alias("to_pos"),
    ).where(F.col("from_pos") <= F.col("to_pos"))
    own = F.col("observed") & (F.col("at") == F.col("pos"))
    return reach.select(
        "ticker", "pos", "adjusted_close", "observed", F.explode(F.sequence("from_pos", "to_pos")).alias("at")
    ).select(
        "ticker",
        F.col("at").alias("pos"),
        own.alias("row_present"),
        F.when(own, F.col("adjusted_close")).alias("adjusted_close"),
    )


def missing_sessions(prices: DataFrame, calendar: SessionCalendar, first: date, last: date) -> DataFrame:
    """Sessions of a closed range on which a ticker has no price row, in long form."""
    lists = missing_session_lists(prices, calendar, first, last)
    return lists.select("ticker", F.explode("missing_canonical_dates").alias("date"))


def missing_session_lists(prices: DataFrame, calendar: SessionCalendar, first: date, last: date) -> DataFrame:
    """Missing session dates per ticker; each list is bounded by the calendar."""
    present = prices.groupBy("ticker").agg(F.collect_set("date").alias("present"))
    return present.select(
        "ticker",
        F.array_except(calendar.session_array(first, last), "present").alias("missing_canonical_dates"),
    )
