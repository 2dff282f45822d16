"""Fixed schemas and numeric constants of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the signal definitions.
MOMENTUM_LAG = 252
VOLATILITY_WINDOW = 21
REFERENCE_SPAN = 755
MIN_REFERENCES = 252
ANNUAL_SESSIONS = 252
HISTORY_START = "2018-01-01"


# Fixed values of the flow proxy.
SPLIT_FACTORS = (1.25, 1.5, 2.0, 3.0, 4.0, 5.0, 10.0)
FLOW_TOLERANCE = 1.05
NOTIONAL_TOLERANCE = 1.10
LARGE_RATIO = 1.5
LONGEST_INTERVAL = 5
FLOW_SPAN = 756
CLOSE_AGE_DAYS = 4
TOP_HOLDINGS = 10

PRICE_VALUES = ("open", "high", "low", "close", "adjusted_close", "volume")
POSITIVE_PRICES = ("open", "high", "low", "close", "adjusted_close")
SHARE_VALUES = ("shares_outstanding",)
KEY = ("ticker", "date")

PRICE_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType(), False),
        T.StructField("ticker", T.StringType(), False),
        *[T.StructField(c, T.DoubleType(), True) for c in PRICE_VALUES],
        T.StructField("retrieved_at", T.TimestampType(), False),
    ]
)
#: Holds every unsigned 64-bit count, and fractions as providers write them.
EXACT_SHARE_TYPE = T.DecimalType(38, 17)
SHARE_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType(), False),
        T.StructField("ticker", T.StringType(), False),
        T.StructField("shares_outstanding", EXACT_SHARE_TYPE, True),
        T.StructField("retrieved_at", T.TimestampType(), False),
    ]
)

PRICE_COLUMNS = tuple(f.name for f in PRICE_SCHEMA)
SHARE_COLUMNS = tuple(f.name for f in SHARE_SCHEMA)

STATUS_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("rows_received", T.LongType(), False),
        T.StructField("first_date", T.DateType(), True),
        T.StructField("last_date", T.DateType(), True),
        T.StructField("retrieved_at", T.TimestampType(), True),
        T.StructField("query_start", T.DateType(), True),
        T.StructField("query_end", T.DateType(), True),
        T.StructField("returned_dates", T.ArrayType(T.DateType()), False),
        T.StructField("error", T.StringType(), True),
    ]
)

MOMENTUM_COLUMNS = (
    "ticker",
    "signal_date",
    "endpoint_start_date",
    "endpoint_end_date",
    "start_adjusted_close",
    "end_adjusted_close",
    "raw_momentum",
    "simple_return_pct",
    "simple_return_status",
    "momentum_percentile",
    "normalization_reference_count",
    "first_prospective_session",
    "endpoint_eligible",
    "endpoint_status",
    "interior_missing_row_count",
    "interior_missing_row_dates",
    "interior_missing_adjusted_close_count",
    "interior_missing_adjusted_close_dates",
)
VOLATILITY_COLUMNS = (
    "ticker",
    "signal_date",
    "window_start_date",
    "window_end_date",
    "raw_annualized_volatility",
    "annualized_volatility_pct",
    "volatility_percentile",
    "normalization_reference_count",
    "first_prospective_session",
    "window_eligible",
    "window_status",
    "missing_row_count",
    "missing_row_dates",
    "missing_adjusted_close_count",
    "missing_adjusted_close_dates",
)
DEPENDENCE_COLUMNS = (
    "scope",
    "estimator",
    "ticker",
    "signal_date",
    "pair_count",
    "first_signal_date",
    "last_signal_date",
    "included_tickers",
    "universe_status",
    "status",
    "estimate",
)
FLOW_COLUMNS = (
    "ticker",
    "start_date",
    "end_date",
    "start_shares",
    "end_shares",
    "delta_shares",
    "interval_share_change",
    "price_dates",
    "signal_date",
    "status",
    "raw_flow_rate",
    "reference_count",
    "flow_percentile",
    "share_ratio",
    "matched_factor",
    "quarantine_reason",
    "start_close",
    "start_close_age",
    "end_close",
    "end_close_age",
    "notional_ratio",
    "price_evidence",
    "dollar_flow",
)
ARTIFACTS = ("input_prices", "coverage", "momentum", "volatility", "dependence")

_NUMERIC = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
)


class ContractError(ValueError):
    """A table breaks its fixed contract."""


def is_dense_numeric(data_type: T.DataType) -> bool:
    """Integer and floating types only; an unsigned 64-bit file column reads as DECIMAL(20,0)."""
    return isinstance(data_type, _NUMERIC) or data_type == T.DecimalType(20, 0)


def check_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reject duplicate, missing and unexpected columns and wrong type families before any action."""
    names = list(df.columns)
    wanted = [f.name for f in schema]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ContractError(f"duplicate column labels: {repeated}")
    missing = [n for n in wanted if n not in names]
    if missing:
        raise ContractError(f"missing required columns: {missing}")
    extra = [n for n in names if n not in wanted]
    if extra:
        raise ContractError(f"unexpected columns: {extra}")
    for field in schema:
        actual = df.schema[field.name].dataType
        if isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            if not is_dense_numeric(actual) and actual != field.dataType:
                raise ContractError(
                    f"column '{field.name}' must be a dense integer or floating type, got {actual.simpleString()}"
                )
        elif actual != field.dataType:
            raise ContractError(
                f"column '{field.name}' must be {field.dataType.simpleString()}, got {actual.simpleString()}"
            )
    return df.select(*wanted)
