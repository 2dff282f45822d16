"""Momentum and volatility observations on the session calendar."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.labels import issue_codes
from tickerloom.functions.numeric import (
    log_return,
    midrank_counts,
    midrank_percentile,
    simple_return_status,
    with_simple_return,
)
from tickerloom.operators.quality import price_rules, require_none, violations
from tickerloom.operators.spine import SignalBounds, dense_spine, off_calendar, signal_bounds
from tickerloom.schemas import (
    ANNUAL_SESSIONS,
    MOMENTUM_COLUMNS,
    MOMENTUM_LAG,
    PRICE_VALUES,
    REFERENCE_SPAN,
    VOLATILITY_COLUMNS,
    VOLATILITY_WINDOW,
)
from tickerloom.sources.calendar import SessionCalendar


def _series():
    return Window.partitionBy("ticker").orderBy("pos")


def endpoint_status(start_present, start, end_present, end) -> Column:
    return issue_codes(
        F.when(~start_present, "missing_start_row").when(start.isNull(), "missing_start_adjusted_close"),
        F.when(~end_present, "missing_end_row").when(end.isNull(), "missing_end_adjusted_close"),
    )


def window_status(missing_rows, missing_values) -> Column:
    return issue_codes(
        F.when(missing_rows > 0, "missing_price_rows"),
        F.when(missing_values > 0, "missing_adjusted_close"),
    )


def with_running_gaps(spine: DataFrame) -> DataFrame:
    """Running counts of absent rows and of present rows without a value."""
    gap_row = ~F.col("row_present")
    gap_value = F.col("row_present") & F.col("adjusted_close").isNull()
    running = _series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spine.withColumns(
        {
            "gap_row": gap_row,
            "gap_value": gap_value,
            "row_gaps": F.count_if(gap_row).over(running),
            "value_gaps": F.count_if(gap_value).over(running),
        }
    )


def with_raw_momentum(spine: DataFrame) -> DataFrame:
    """The 252-session log return, and where its interior gaps lie in the running counts."""
    start = F.lag("adjusted_close", MOMENTUM_LAG).over(_series())
    staged = spine.withColumns(
        {
            "start_adjusted_close": start,
            "start_present": F.lag("row_present", MOMENTUM_LAG, False).over(_series()),
            "m_rows_from": F.lag("row_gaps", MOMENTUM_LAG, 0).over(_series()),
            "m_rows_to": F.lag("row_gaps", 1, 0).over(_series()),
            "m_values_from": F.lag("value_gaps", MOMENTUM_LAG, 0).over(_series()),
            "m_values_to": F.lag("value_gaps", 1, 0).over(_series()),
        }
    )
    return staged.withColumn(
        "raw_momentum", log_return(F.col("start_adjusted_close"), F.col("adjusted_close"))
    )


def with_raw_volatility(spine: DataFrame) -> DataFrame:
    """Annualised sample deviation of 21 adjacent-session returns, all of them required."""
    returns = spine.withColumns(
        {
            "daily_return": log_return(F.lag("adjusted_close", 1).over(_series()), F.col("adjusted_close")),
            "v_rows_from": F.lag("row_gaps", VOLATILITY_WINDOW + 1, 0).over(_series()),
            "v_values_from": F.lag("value_gaps", VOLATILITY_WINDOW + 1, 0).over(_series()),
        }
    )
    frame = _series().rowsBetween(-(VOLATILITY_WINDOW - 1), 0)
    complete = F.count("daily_return").over(frame) == VOLATILITY_WINDOW
    deviation = F.stddev_samp("daily_return").over(frame) * F.lit(ANNUAL_SESSIONS**0.5)
    return returns.withColumn("raw_volatility", F.when(complete, deviation))


def _counted(frame: DataFrame, raw: tuple[str, ...]) -> DataFrame:
    """Attach the sliding midrank counts of each raw column.

    The rows of a ticker, at most one per session, are packed into an array (already
    co-located by the window shuffle, so no exchange), ranked there and unpacked.
    """
    fields = [c for c in frame.columns if c not in ("ticker", "gap_row", "gap_value")]
    packed = frame.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("pos", *[c for c in fields if c != "pos"]))).alias("series"),
        F.sort_array(F.collect_list(F.when(F.col("gap_row"), F.col("session")))).alias("row_gap_days"),
        F.sort_array(F.collect_list(F.when(F.col("gap_value"), F.col("session")))).alias("value_gap_days"),
    )
    for name in raw:
        packed = packed.withColumn(f"{name}_counts", midrank_counts(F.col(f"series.{name}")))
    zipped = ["series"]
    for name in raw:
        packed = packed.withColumns(
            {
                f"{name}_references": F.col(f"{name}_counts.references"),
                f"{name}_doubled": F.col(f"{name}_counts.doubled"),
            }
        )
        zipped += [f"{name}_references", f"{name}_doubled"]
    return packed.select(
        "ticker", "row_gap_days", "value_gap_days", F.inline(F.arrays_zip(*zipped))
    ).select("ticker", "row_gap_days", "value_gap_days", "series.*", *zipped[1:])


def _between(days: str, low: Column, high: Column) -> Column:
    return F.slice(F.col(days), (low + 1).cast("int"), (high - low).cast("int"))


def session_spine(prices: DataFrame, bounds: SignalBounds, lookback: int) -> DataFrame:
    """The dense spine with its session dates and running gap counts."""
    calendar = bounds.calendar.frame(prices.sparkSession).select(
        "pos", "session", "next_session", "back_21", "back_252"
    )
    return with_running_gaps(dense_spine(prices, bounds, lookback).join(F.broadcast(calendar), "pos"))


def raw_signals(prices: DataFrame, bounds: SignalBounds) -> DataFrame:
    """Raw momentum, daily return and raw volatility per ticker and session, unranked."""
    spine = with_raw_volatility(with_raw_momentum(session_spine(prices, bounds, MOMENTUM_LAG + 1)))
    return spine.where(F.col("pos") >= bounds.first)


def signal_panel(prices: DataFrame, bounds: SignalBounds, momentum: bool = True, volatility: bool = True) -> DataFrame:
    """Both signals (or one) over one shared spine and one shuffle of the prices."""
    reach = MOMENTUM_LAG if momentum else VOLATILITY_WINDOW
    # Before the panel's first date there are no values, only missing rows, and no
    # diagnostic reaches further back than one lag.
    spine = session_spine(prices, bounds, min(REFERENCE_SPAN + reach, bounds.first - bounds.origin + reach + 1))
    return panel_of_spine(spine, momentum, volatility, bounds.first)


def panel_of_spine(
    spine: DataFrame, momentum: bool = True, volatility: bool = True, first: int | None = None
) -> DataFrame:
    """The ranked signals of a session spine, from place `first` on where it is given."""
    raw: tuple[str, ...] = ()
    if momentum:
        spine, raw = with_raw_momentum(spine), raw + ("raw_momentum",)
    if volatility:
        spine, raw = with_raw_volatility(spine), raw + ("raw_volatility",)
    panel = _counted(spine, raw)
    if first is not None:
        panel = panel.where(F.col("pos") >= first)
    if momentum:
        panel = with_simple_return(panel, "start_adjusted_close", "adjusted_close", "raw_momentum", "simple_return_pct")
    return panel


def momentum_columns() -> list[Column]:
    """The 18 momentum columns of a signal panel."""
    start, end = F.col("start_adjusted_close"), F.col("adjusted_close")
    status = endpoint_status(F.col("start_present"), start, F.col("row_present"), end)
    eligible = start.isNotNull() & end.isNotNull()
    pct = F.col("simple_return_pct")
    references = F.col("raw_momentum_references")
    return [
        F.col("ticker"),
        F.col("session").alias("signal_date"),
        F.col("back_252").alias("endpoint_start_date"),
        F.col("session").alias("endpoint_end_date"),
        start.alias("start_adjusted_close"),
        end.alias("end_adjusted_close"),
        F.col("raw_momentum"),
        pct,
        simple_return_status(eligible, pct).alias("simple_return_status"),
        midrank_percentile(F.col("raw_momentum"), references, F.col("raw_momentum_doubled")).alias(
            "momentum_percentile"
        ),
        references.cast("bigint").alias("normalization_reference_count"),
        F.col("next_session").alias("first_prospective_session"),
        eligible.alias("endpoint_eligible"),
        status.alias("endpoint_status"),
        (F.col("m_rows_to") - F.col("m_rows_from")).alias("interior_missing_row_count"),
        _between("row_gap_days", F.col("m_rows_from"), F.col("m_rows_to")).alias("interior_missing_row_dates"),
        (F.col("m_values_to") - F.col("m_values_from")).alias("interior_missing_adjusted_close_count"),
        _between("value_gap_days", F.col("m_values_from"), F.col("m_values_to")).alias(
            "interior_missing_adjusted_close_dates"
        ),
    ]


def volatility_columns() -> list[Column]:
    """The 15 volatility columns of a signal panel."""
    rows = F.col("row_gaps") - F.col("v_rows_from")
    values = F.col("value_gaps") - F.col("v_values_from")
    references = F.col("raw_volatility_references")
    return [
        F.col("ticker"),
        F.col("session").alias("signal_date"),
        F.col("back_21").alias("window_start_date"),
        F.col("session").alias("window_end_date"),
        F.col("raw_volatility").alias("raw_annualized_volatility"),
        (F.col("raw_volatility") * 100.0).alias("annualized_volatility_pct"),
        midrank_percentile(F.col("raw_volatility"), references, F.col("raw_volatility_doubled")).alias(
            "volatility_percentile"
        ),
        references.cast("bigint").alias("normalization_reference_count"),
        F.col("next_session").alias("first_prospective_session"),
        ((rows == 0) & (values == 0)).alias("window_eligible"),
        window_status(rows, values).alias("window_status"),
        rows.alias("missing_row_count"),
        _between("row_gap_days", F.col("v_rows_from"), F.col("row_gaps")).alias("missing_row_dates"),
        values.alias("missing_adjusted_close_count"),
        _between("value_gap_days", F.col("v_values_from"), F.col("value_gaps")).alias(
            "missing_adjusted_close_dates"
        ),
    ]


_DATES = ("signal_date", "endpoint_start_date", "endpoint_end_date", "window_start_date",
          "window_end_date", "first_prospective_session")


def _empty(spark: SparkSession, columns: tuple[str, ...]) -> DataFrame:
    def kind(name: str) -> T.DataType:
        if name in _DATES:
            return T.DateType()
        if name.endswith("_dates"):
            return T.ArrayType(T.DateType())
        if name.endswith("_count"):
            return T.LongType()
        if name.endswith("_eligible"):
            return T.BooleanType()
        if name == "ticker" or name.endswith("_status"):
            return T.StringType()
        return T.DoubleType()

    return spark.createDataFrame([], T.StructType([T.StructField(c, kind(c)) for c in columns]))


def input_violations(prices: DataFrame, calendar: SessionCalendar) -> DataFrame:
    """Rows a signal must not be computed from: broken row rules, repeated keys, dates off the
    calendar. Rules of price columns that the table does not have are left out."""
    held = set(prices.columns)
    absent = {c: F.lit(None) for c in (*PRICE_VALUES, "retrieved_at") if c not in held}
    rules = [r for r in price_rules() if "retrieved_at" in held or r.name != "missing_retrieved_at"]
    if absent:
        market = "no_market_value"  # a null adjusted close is a valid gap in a narrow table
        rules = [r for r in rules if r.name != market]
        prices = prices.withColumns({c: v.cast("double") for c, v in absent.items()})
    strays = off_calendar(prices.where("date is not null"), calendar).select(
        F.lit(80).alias("priority"), F.lit("off_calendar").alias("rule"), "ticker", "date"
    )
    return violations(prices, rules).unionByName(strays)


def require_valid(prices: DataFrame, calendar: SessionCalendar) -> None:
    require_none(input_violations(prices, calendar), "price rows")


def momentum(
    prices: DataFrame,
    start: date | None = None,
    end: date | None = None,
    price_range: tuple[date, date] | None = None,
    validated: bool = False,
) -> DataFrame:
    """Momentum rows of every ticker on every session in the evaluation range.

    Invalid input is an error; pass ``validated`` when the rows were checked already.
    """
    bounds = signal_bounds(prices, start, end, price_range)
    if bounds is None:
        return _empty(prices.sparkSession, MOMENTUM_COLUMNS)
    if not validated:
        require_valid(prices, bounds.calendar)
    return signal_panel(prices, bounds, volatility=False).select(*momentum_columns())


def volatility(
    prices: DataFrame,
    start: date | None = None,
    end: date | None = None,
    price_range: tuple[date, date] | None = None,
    validated: bool = False,
) -> DataFrame:
    """Volatility rows of every ticker on every session in the evaluation range.

    Invalid input is an error; pass ``validated`` when the rows were checked already.
    """
    bounds = signal_bounds(prices, start, end, price_range)
    if bounds is None:
        return _empty(prices.sparkSession, VOLATILITY_COLUMNS)
    if not validated:
        require_valid(prices, bounds.calendar)
    return signal_panel(prices, bounds, momentum=False).select(*volatility_columns())


def stored_signals(prices: DataFrame, bounds: SignalBounds, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both signals computed once, written to ``folder`` and read back as two tables.

    Everything downstream reads each signal several times; the written table also
    survives lost executors and gives the planner real sizes.
    """
    panel = signal_panel(prices, bounds)
    panel.select(
        F.struct(*momentum_columns()).alias("momentum"), F.struct(*volatility_columns()).alias("volatility")
    ).write.mode("errorifexists").parquet(folder)
    both = prices.sparkSession.read.parquet(folder)
    return both.select("momentum.*"), both.select("volatility.*")
