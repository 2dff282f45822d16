"""Landing batches: an independent outcome for every requested ticker."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.labels import failure_text
from tickerloom.operators.quality import Rule, outside_window_rule, price_rules, row_violations, share_rules
from tickerloom.schemas import KEY, PRICE_COLUMNS, PRICE_VALUES, SHARE_COLUMNS, SHARE_VALUES


def requested_tickers(requests: DataFrame) -> DataFrame:
    """Requested tickers, trimmed and folded by case, with the problems that stop a batch."""
    trimmed = requests.select(F.coalesce(F.trim("ticker"), F.lit("")).alias("ticker"))
    folded = trimmed.groupBy(F.lower("ticker").alias("folded")).agg(
        F.min("ticker").alias("ticker"), F.count(F.lit(1)).alias("copies")
    )
    return folded.select(
        "ticker",
        F.when(F.col("ticker") == "", "blank_ticker").when(F.col("copies") > 1, "duplicate_ticker").alias("problem"),
    )


@dataclass(frozen=True)
class BatchKind:
    """What a batch of prices or of shares checks, and how it names its failures."""

    columns: tuple[str, ...]
    values: tuple[str, ...]
    rules: Callable[[], list[Rule]]
    parse_error: str
    data_error: str


PRICES = BatchKind(PRICE_COLUMNS, PRICE_VALUES, price_rules, "PriceNormalizationError", "PriceDataValidationError")
SHARES = BatchKind(SHARE_COLUMNS, SHARE_VALUES, share_rules, "SharesNormalizationError", "ShareDataValidationError")


def failing_tickers(kind: BatchKind, copies: DataFrame, window: tuple[date, date] | None = None) -> DataFrame:
    """The first broken rule of every ticker that breaks one, from its grouped copies.

    Only prices have a window: share query bounds are hints to the provider.
    """
    rules = [Rule(5, "conflicting_duplicates", F.col("in_conflict")), *kind.rules()]
    if window:
        rules.append(outside_window_rule(*window))
    found = row_violations(copies, rules)
    return found.groupBy("ticker").agg(F.min(F.struct("priority", "rule"))["rule"].alias("rule"))


def accepted_rows(copies: DataFrame, failing: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of the tickers that break no rule; one bad row fails its ticker and no other."""
    return copies.join(failing, "ticker", "left_anti").select(*columns)


def batch_statuses(
    kind: BatchKind,
    parsed: DataFrame,
    failing: DataFrame,
    accepted: DataFrame,
    requests: DataFrame,
    window: tuple[date | None, date | None] = (None, None),
) -> DataFrame:
    """One status per requested ticker: success, empty or failed.

    A ticker that the answers lack is empty at the batch's latest answer. Only where nothing was
    landed at all does every ticker fail.
    """
    per_ticker = accepted.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows_received"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.array_sort(F.collect_list("date")).alias("returned_dates"),
    )
    answered = parsed.select("ticker", "issue", F.col("retrieved_at").alias("answered_at"))
    joined = (
        requests.select("ticker")
        .join(answered, "ticker", "left")
        .join(failing, "ticker", "left")
        .join(per_ticker, "ticker", "left")
    )
    # One instant of the whole batch.
    latest = answered.agg(F.max("answered_at")).first()[0]
    answered_at = F.coalesce("answered_at", F.lit(latest).cast("timestamp"))
    silent = F.lit(latest is None)
    failed = silent | F.col("issue").isNotNull() | F.col("rule").isNotNull()
    status = F.when(failed, "failed").when(F.col("rows_received") > 0, "success").otherwise("empty")
    error = (
        F.when(silent, F.lit("LandingError: nothing was landed"))
        .when(F.col("issue").isNotNull(), failure_text(F.lit(kind.parse_error), F.col("issue")))
        .when(F.col("rule").isNotNull(), failure_text(F.lit(kind.data_error), F.col("rule")))
    )
    return joined.select(
        "ticker",
        status.alias("status"),
        F.coalesce("rows_received", F.lit(0).cast("bigint")).alias("rows_received"),
        "first_date",
        "last_date",
        F.when(~failed, answered_at).alias("retrieved_at"),
        F.lit(window[0]).cast("date").alias("query_start"),
        F.lit(window[1]).cast("date").alias("query_end"),
        F.coalesce("returned_dates", F.expr("cast(array() as array<date>)")).alias("returned_dates"),
        error.alias("error"),
    )


def batch_retrieved_at(statuses: DataFrame) -> DataFrame:
    """The batch's retrieval time: the latest answer that did not fail."""
    answered = F.when(F.col("status") != "failed", F.col("retrieved_at"))
    return statuses.agg(F.max(answered).alias("retrieved_at"), F.count(F.lit(1)).alias("tickers"))


def status_summary(statuses: DataFrame) -> DataFrame:
    """Tickers, rows and date range per outcome."""
    return statuses.groupBy("status").agg(
        F.count(F.lit(1)).alias("tickers"),
        F.sum("rows_received").alias("rows_received"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.min("ticker").alias("first_ticker"),
        F.max("ticker").alias("last_ticker"),
    )


def acquisition_view(prices: DataFrame, statuses: DataFrame) -> DataFrame:
    """Only the rows that successful statuses claim."""
    claimed = statuses.where("status = 'success'").select("ticker", F.explode("returned_dates").alias("date"))
    # The lists are as many dates as there are rows, which no estimate of an exploded list shows: never broadcast.
    return prices.join(claimed.hint("merge"), list(KEY), "left_semi").select(*prices.columns)


def _status_rules(start: date | None, end: date | None) -> list[tuple[str, Column]]:
    dates = F.col("returned_dates")
    some = F.size(dates) > 0
    nothing = (F.col("rows_received") == 0) & F.col("first_date").isNull() & F.col("last_date").isNull() & ~some
    success = (
        (F.col("rows_received") > 0)
        & (F.col("rows_received") == F.size(dates))
        & F.col("first_date").eqNullSafe(F.get(dates, F.lit(0)))
        & F.col("last_date").eqNullSafe(F.element_at(dates, -1))
        & F.col("error").isNull()
    )
    shown = F.coalesce(F.col("error"), F.lit(""))
    status = F.col("status")
    rules = [
        ("padded_ticker", (F.col("ticker") == "") | (F.col("ticker") != F.trim("ticker"))),
        ("invalid_query_window", F.coalesce(F.col("query_start") >= F.col("query_end"), F.lit(True))),
        ("unordered_dates", F.array_sort(F.array_distinct(dates)) != dates),
        (
            "dates_outside_window",
            F.exists(dates, lambda d: (d < F.col("query_start")) | (d >= F.col("query_end"))),
        ),
        ("unknown_status", ~status.isin("success", "empty", "failed")),
        ("inconsistent_success", (status == "success") & some & ~success),
        ("success_without_rows", (status == "success") & ~some),
        ("inconsistent_empty", (status == "empty") & ~(nothing & F.col("error").isNull())),
        ("missing_retrieved_at", status.isin("success", "empty") & F.col("retrieved_at").isNull()),
        (
            "inconsistent_failed",
            (status == "failed")
            & ~(nothing & F.col("retrieved_at").isNull() & (shown != "") & (shown == F.trim(shown))),
        ),
    ]
    if start is not None:
        rules.append(("unexpected_query_start", F.col("query_start") != F.lit(start)))
        rules.append(("unexpected_query_end", F.col("query_end") != F.lit(end)))
    return rules


def status_violations(
    statuses: DataFrame,
    incoming: DataFrame,
    expected: DataFrame | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Where statuses break their own contract or disagree with the rows they claim."""
    own = statuses.select(
        F.explode(
            F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in _status_rules(start, end)]))
        ).alias("rule"),
        "ticker",
        F.lit(None).cast("date").alias("date"),
    )
    repeated = (
        statuses.groupBy(F.lower("ticker").alias("folded"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("ticker").alias("ticker"))
        .where("n > 1")
        .select(F.lit("duplicate_ticker").alias("rule"), "ticker", F.lit(None).cast("date").alias("date"))
    )
    windows = (
        statuses.groupBy()
        .agg(
            F.min("query_start").alias("a"),
            F.max("query_start").alias("b"),
            F.min("query_end").alias("c"),
            F.max("query_end").alias("d"),
        )
        .where("a <> b or c <> d")
        .select(
            F.lit("several_query_windows").alias("rule"),
            F.lit(None).cast("string").alias("ticker"),
            F.lit(None).cast("date").alias("date"),
        )
    )
    claimed = statuses.where("status = 'success'").select(
        "ticker", F.explode("returned_dates").alias("date"), F.col("retrieved_at").alias("claimed_at")
    )
    matched = claimed.join(incoming.select(*KEY, F.col("retrieved_at").alias("stored_at")), list(KEY), "full_outer")
    rows = matched.select(
        F.when(F.col("stored_at").isNull(), "claimed_row_absent")
        .when(F.col("claimed_at").isNull(), "unclaimed_row")
        .when(F.col("claimed_at") != F.col("stored_at"), "retrieval_time_differs")
        .alias("rule"),
        "ticker",
        "date",
    ).where("rule is not null")
    found = own.unionByName(repeated).unionByName(windows).unionByName(rows)
    if expected is not None:
        population = (
            statuses.select("ticker", F.lit(1).alias("has_status"))
            .join(expected.select("ticker", F.lit(1).alias("is_expected")), "ticker", "full_outer")
            .where("has_status is null or is_expected is null")
            .select(
                F.when(F.col("has_status").isNull(), "status_missing").otherwise("unexpected_ticker").alias("rule"),
                "ticker",
                F.lit(None).cast("date").alias("date"),
            )
        )
        found = found.unionByName(population)
    return found


def default_end_dates(instants: DataFrame, column: str = "instant") -> DataFrame:
    """The exclusive default end of a request: the exchange's calendar date at the instant."""
    local = F.from_utc_timestamp(column, "America/New_York")
    return instants.withColumn("default_end", F.to_date(local))


def share_query_windows(requests: DataFrame) -> DataFrame:
    """Day-aligned share query windows.

    ``requests`` holds ticker, zone, start, end (dates, may be null) and the batch
    instant. Without an end the instant in the ticker's zone is used, without a start
    548 days before the end; the start is floored and the end raised to a whole day.
    """
    zone = F.col("zone")
    end_utc = F.coalesce(F.to_utc_timestamp(F.col("end").cast("timestamp"), zone), F.col("instant"))
    start_utc = F.coalesce(
        F.to_utc_timestamp(F.col("start").cast("timestamp"), zone), end_utc - F.expr("INTERVAL 548 DAYS")
    )
    end, start = F.from_utc_timestamp(end_utc, zone), F.from_utc_timestamp(start_utc, zone)
    whole = F.date_trunc("day", end) == end
    return requests.select(
        "ticker",
        F.to_date(F.date_trunc("day", start)).alias("query_start"),
        F.when(whole, F.to_date(end)).otherwise(F.date_add(F.to_date(end), 1)).alias("query_end"),
        (start_utc >= end_utc).alias("reversed"),
    )
