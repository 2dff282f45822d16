"""Coverage and staleness: one diagnostic row per configured instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.numeric import normalization_status
from tickerloom.sources.calendar import EvaluationTarget, SessionCalendar


def evaluation_slice(prices: DataFrame, universe: DataFrame, target: EvaluationTarget) -> DataFrame:
    """Configured tickers between the request start and the target session."""
    inside = F.col("date").between(F.lit(target.request_start), F.lit(target.target_session))
    return prices.where(inside).join(universe.select("ticker"), "ticker", "left_semi").select(*prices.columns)


def evaluation_calendar(target: EvaluationTarget) -> SessionCalendar:
    return SessionCalendar.around(target.request_start, target.target_session)


def _session_ord(day: Column) -> Column:
    """Index of a session among the evaluation sessions, zero when it is none."""
    return F.array_position(F.col("expected"), day)


def price_coverage(prices: DataFrame, target: EvaluationTarget) -> DataFrame:
    """Presence, gaps and retrieval range per ticker; lists are bounded by the calendar."""
    held = F.col("adjusted_close").isNotNull()
    at_target = F.col("date") == F.lit(target.target_session)
    expected = evaluation_calendar(target).session_array(target.request_start, target.target_session)
    return (
        prices.groupBy("ticker")
        .agg(
            F.min("retrieved_at").alias("input_first_retrieved_at"),
            F.max("retrieved_at").alias("input_last_retrieved_at"),
            F.min("date").alias("first_canonical_date"),
            F.max("date").alias("last_canonical_date"),
            F.count(F.lit(1)).alias("present_xnys_observation_count"),
            F.collect_set("date").alias("present"),
            F.array_sort(F.collect_list(F.when(~held, F.col("date")))).alias("missing_adjusted_close_dates"),
            F.min(F.when(held, F.col("date"))).alias("first_adjusted_close_date"),
            F.max(F.when(held, F.col("date"))).alias("last_adjusted_close_date"),
            F.bool_or(at_target).alias("target_price_row_present"),
            F.bool_or(at_target & held).alias("target_adjusted_close_present"),
        )
        .withColumn("missing_canonical_dates", F.array_except(expected, F.col("present")))
        .drop("present")
    )


def signal_coverage(frame: DataFrame, prefix: str, columns: dict[str, str], target: EvaluationTarget) -> DataFrame:
    """First and last present dates per ticker, and its row at the target session.

    ``columns`` maps the target fields of the coverage row to signal columns; ``raw``
    and ``percentile`` are among them. The dates come from a hash aggregate over all
    rows; the target rows from a filter that Parquet can skip by, one row per ticker.
    """
    raw, percentile = F.col(columns["raw"]), F.col(columns["percentile"])

    def when_present(value: Column) -> Column:
        return F.when(value.isNotNull(), F.col("signal_date"))

    dates = frame.groupBy("ticker").agg(
        F.min(when_present(raw)).alias(f"{prefix}_first_raw_date"),
        F.max(when_present(raw)).alias(f"{prefix}_last_raw_date"),
        F.min(when_present(percentile)).alias(f"{prefix}_first_normalized_date"),
        F.max(when_present(percentile)).alias(f"{prefix}_last_normalized_date"),
    )
    at_target = frame.where(F.col("signal_date") == F.lit(target.target_session)).select(
        "ticker",
        F.lit(True).alias(f"{prefix}_target_seen"),
        *[F.col(source).alias(f"{prefix}_target_{name}") for name, source in columns.items()],
    )
    return dates.join(at_target, "ticker", "left")


MOMENTUM_TARGETS = {
    "raw": "raw_momentum",
    "simple_return_pct": "simple_return_pct",
    "percentile": "momentum_percentile",
    "status": "endpoint_status",
    "reference_count": "normalization_reference_count",
}
VOLATILITY_TARGETS = {
    "raw": "raw_annualized_volatility",
    "annualized_pct": "annualized_volatility_pct",
    "percentile": "volatility_percentile",
    "status": "window_status",
    "reference_count": "normalization_reference_count",
}


def _signal_fields(prefix: str, display: str) -> list[Column]:
    seen = F.coalesce(F.col(f"{prefix}_target_seen"), F.lit(False))
    raw, percentile = F.col(f"{prefix}_target_raw"), F.col(f"{prefix}_target_percentile")

    def stale(day: str) -> Column:
        return (F.size("expected") - _session_ord(F.col(day))).cast("bigint")

    return [
        F.col(f"{prefix}_first_raw_date"),
        F.col(f"{prefix}_last_raw_date"),
        F.col(f"{prefix}_first_normalized_date"),
        F.col(f"{prefix}_last_normalized_date"),
        raw.isNotNull().alias(f"{prefix}_target_raw_eligible"),
        percentile.isNotNull().alias(f"{prefix}_target_normalized_eligible"),
        raw,
        F.col(f"{prefix}_target_{display}"),
        percentile,
        F.when(seen, F.col(f"{prefix}_target_status")).otherwise("ticker_unavailable").alias(f"{prefix}_target_status"),
        normalization_status(seen, raw, percentile).alias(f"{prefix}_target_normalization_status"),
        F.col(f"{prefix}_target_reference_count"),
        stale(f"{prefix}_last_raw_date").alias(f"{prefix}_raw_staleness_sessions"),
        stale(f"{prefix}_last_normalized_date").alias(f"{prefix}_normalized_staleness_sessions"),
    ]


def coverage(
    prices: DataFrame,
    universe: DataFrame,
    target: EvaluationTarget,
    momentum: DataFrame,
    volatility: DataFrame,
    statuses: DataFrame | None = None,
) -> DataFrame:
    """The 53-column diagnostic row of every configured instrument, present in prices or not."""
    expected = evaluation_calendar(target).session_array(target.request_start, target.target_session)
    joined = (
        universe.join(price_coverage(prices, target), "ticker", "left")
        .join(signal_coverage(momentum, "momentum", MOMENTUM_TARGETS, target), "ticker", "left")
        .join(signal_coverage(volatility, "volatility", VOLATILITY_TARGETS, target), "ticker", "left")
    )
    if statuses is None:
        acquisition = [
            F.lit("not_requested").alias("acquisition_status"),
            F.lit(None).cast("string").alias("acquisition_error"),
            F.lit(None).cast("bigint").alias("acquisition_rows_received"),
            F.lit(None).cast("timestamp").alias("acquisition_retrieved_at"),
        ]
    else:
        claims = statuses.select(
            "ticker",
            F.col("status").alias("acquisition_status"),
            F.col("error").alias("acquisition_error"),
            F.col("rows_received").alias("acquisition_rows_received"),
            F.col("retrieved_at").alias("acquisition_retrieved_at"),
        )
        joined = joined.join(claims, "ticker", "left")
        acquisition = [
            F.coalesce("acquisition_status", F.lit("not_requested")).alias("acquisition_status"),
            F.col("acquisition_error"),
            F.col("acquisition_rows_received"),
            F.col("acquisition_retrieved_at"),
        ]
    total = F.size("expected").cast("bigint")
    present = F.coalesce("present_xnys_observation_count", F.lit(0).cast("bigint"))
    missing = F.coalesce("missing_canonical_dates", F.col("expected"))
    unvalued = F.coalesce("missing_adjusted_close_dates", F.expr("cast(array() as array<date>)"))
    return joined.withColumn("expected", expected).select(
        "ord",
        "ticker",
        "name",
        "category",
        *acquisition,
        "input_first_retrieved_at",
        "input_last_retrieved_at",
        F.lit(target.request_start).alias("request_start"),
        F.lit(target.request_end).alias("request_end_exclusive"),
        F.lit(target.target_session).alias("target_session"),
        "first_canonical_date",
        "last_canonical_date",
        total.alias("expected_xnys_observation_count"),
        present.alias("present_xnys_observation_count"),
        F.size(missing).cast("bigint").alias("missing_canonical_count"),
        missing.alias("missing_canonical_dates"),
        F.size(unvalued).cast("bigint").alias("missing_adjusted_close_count"),
        unvalued.alias("missing_adjusted_close_dates"),
        "first_adjusted_close_date",
        "last_adjusted_close_date",
        F.coalesce("target_price_row_present", F.lit(False)).alias("target_price_row_present"),
        F.coalesce("target_adjusted_close_present", F.lit(False)).alias("target_adjusted_close_present"),
        (total - _session_ord(F.col("last_adjusted_close_date"))).alias("price_staleness_sessions"),
        *_signal_fields("momentum", "simple_return_pct"),
        *_signal_fields("volatility", "annualized_pct"),
    )


def staleness(latest: DataFrame, target: EvaluationTarget) -> DataFrame:
    """Sessions between each ``latest`` date and the target; null when there is none.

    A latest date that is no session is reported, not rounded.
    """
    sessions = evaluation_calendar(target).between(
        latest.sparkSession, target.request_start, target.target_session
    )
    at = sessions.select(F.col("session").alias("latest"), F.col("pos").alias("at"))
    last = evaluation_calendar(target).index_until(target.target_session)
    return latest.join(F.broadcast(at), "latest", "left").select(
        *latest.columns,
        (F.lit(last) - F.col("at")).cast("bigint").alias("staleness_sessions"),
        (F.col("latest").isNotNull() & F.col("at").isNull()).alias("not_a_session"),
    )


def first_last_present(frame: DataFrame, value: str) -> DataFrame:
    """First and last signal date with a value, per ticker."""
    present = F.when(F.col(value).isNotNull(), F.col("signal_date"))
    return frame.groupBy("ticker").agg(F.min(present).alias("first_date"), F.max(present).alias("last_date"))


def latest_eligible(frame: DataFrame, value: str) -> DataFrame:
    """The last present observation of every ticker that has one."""
    held = frame.where(F.col(value).isNotNull())
    return held.groupBy("ticker").agg(
        F.max("signal_date").alias("signal_date"), F.max_by(value, "signal_date").alias(value)
    )


def target_observation(frame: DataFrame, universe: DataFrame, target: EvaluationTarget) -> DataFrame:
    """Each configured ticker's row at the target session; absent tickers stay with nulls."""
    rows = frame.where(F.col("signal_date") == F.lit(target.target_session))
    return universe.select("ord", "ticker").join(rows, "ticker", "left")
