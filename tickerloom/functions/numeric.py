"""Numeric column expressions: stable returns, lossless casts, sliding midrank."""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.schemas import MIN_REFERENCES, REFERENCE_SPAN

MAX_DOUBLE = 1.7976931348623157e308
INFINITY = float("inf")

# Tasks get the helpers below by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_COUNTS = T.StructType(
    [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("references", "doubled")]
)


def is_finite(x: Column) -> Column:
    """False for NaN and both infinities; null stays null."""
    return ~F.isnan(x) & (F.abs(x) != F.lit(INFINITY))


def log_return(start: Column, end: Column) -> Column:
    """ln(end/start): log1p of the change inside a factor of two, a difference of logs outside."""
    change = end - start
    near = F.when(change >= 0, change <= start).otherwise(-change <= end)
    return F.when(near, F.log1p(change / start)).otherwise(F.log(end) - F.log(start))


def with_simple_return(df: DataFrame, start: str, end: str, raw: str, name: str) -> DataFrame:
    """Add 100 × the relative change; null when it does not fit a double.

    The change falls back to the log return where its direct form overflows, reaches
    -1 or collapses to 0. Each step is its own column: as one expression the optimizer
    would repeat the step in every place that uses it.
    """
    s, e = F.col(start), F.col(end)
    direct, change = F.col(f"{name}_direct"), F.col(f"{name}_change")
    unusable = ~is_finite(direct) | (direct <= -1.0) | ((direct == 0.0) & (s != e))
    return (
        df.withColumn(f"{name}_direct", (e - s) / s)
        .withColumn(f"{name}_change", F.when(unusable, F.expm1(raw)).otherwise(direct))
        .withColumn(name, F.when(is_finite(change) & (change <= MAX_DOUBLE / 100.0), change * 100.0))
        .drop(f"{name}_direct", f"{name}_change")
    )


def simple_return_status(eligible: Column, pct: Column) -> Column:
    return (
        F.when(~eligible, "endpoint_ineligible")
        .when(pct.isNull(), "exceeds_float64_range")
        .otherwise("available")
    )


def casts_losslessly(x: Column, source: str, target: str) -> Column:
    """True when the value survives source → target → source; null survives."""
    return x.try_cast(target).try_cast(source).eqNullSafe(x)


def exact_double(x: Column, source: str, what: str) -> Column:
    """x as a double; a value that a double cannot hold exactly ends the job with a message."""
    if source != "bigint" and not source.startswith("decimal"):
        return x.cast("double")
    message = F.concat(F.lit(f"{what} has a value that double cannot hold exactly: "), x.cast("string"))
    return F.when(casts_losslessly(x, source, "double"), x.cast("double")).otherwise(
        F.raise_error(message).cast("double")
    )


def exact_value(x: Column, source: T.DataType, target: T.DataType, what: str) -> Column:
    """x in a canonical type, double or decimal; a value that changes on the way ends the job."""
    if isinstance(target, T.DoubleType):
        return exact_double(x, source.simpleString(), what)
    if source == target:
        return x
    name = target.simpleString()
    message = F.concat(F.lit(f"{what} has a value that {name} cannot hold exactly: "), x.cast("string"))
    return F.when(casts_losslessly(x, source.simpleString(), name), x.try_cast(name)).otherwise(
        F.raise_error(message).cast(name)
    )


def exact_decimal_text(text: Column, target: str) -> Column:
    """The decimal that a number's text says; null where the type cannot hold it.

    Digits beyond the type's scale are accepted where they say nothing more than the double does.
    """
    value = text.try_cast(target)
    whole = text.rlike("^-?[0-9]+$")
    return F.when(whole | (value.cast("double") == text.try_cast("double")), value)


def normalization_status(row_exists: Column, raw: Column, percentile: Column) -> Column:
    return (
        F.when(~row_exists, "ticker_unavailable")
        .when(raw.isNull(), "raw_ineligible")
        .when(percentile.isNull(), "insufficient_reference_history")
        .otherwise("eligible")
    )


def sliding_counts(values: np.ndarray, span: int = REFERENCE_SPAN):
    """For each position: how many of the ``span`` values before it are present, and
    twice the midrank count (2·below + equal) of the value among them.

    The window is kept sorted: a value enters and leaves it once, and its rank is where it would
    enter. That takes the logarithm of the span per position instead of the span.
    """
    size = len(values)
    present = np.concatenate([[0], np.cumsum(~np.isnan(values))])
    at = np.arange(size)
    references = (present[at] - present[np.maximum(at - span, 0)]).astype(np.int32)
    places = np.flatnonzero(~np.isnan(values))
    _, ranks = np.unique(values[places], return_inverse=True)
    held, oldest = [], 0
    found = np.zeros(len(places), dtype=np.int32)
    positions, ranks = places.tolist(), ranks.tolist()
    for k, (place, rank) in enumerate(zip(positions, ranks)):
        while positions[oldest] < place - span:
            del held[bisect_left(held, ranks[oldest])]
            oldest += 1
        below = through = bisect_left(held, rank)
        if below < len(held) and held[below] == rank:
            through = bisect_right(held, rank, below)
        found[k] = below + through
        held.insert(through, rank)
    doubled = np.zeros(size, dtype=np.int32)
    doubled[places] = found
    return references, doubled


@F.arrow_udf(_COUNTS)
def midrank_counts(series: pa.Array) -> pa.Array:
    """Sliding midrank counts of dense per-ticker series.

    As a window frame the rank of every value among its own previous 755 means re-reading 755
    boxed rows per row; over a dense array a sorted window follows the series instead. One
    series is bounded by the session calendar, so one call never sees an unbounded group.
    """
    offsets = series.offsets.to_numpy()
    flat = series.values.to_numpy(zero_copy_only=False).astype(np.float64)
    base = offsets[0]
    references = np.zeros(offsets[-1] - base, dtype=np.int32)
    doubled = np.zeros_like(references)
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        cut = slice(lo - base, hi - base)
        references[cut], doubled[cut] = sliding_counts(flat[lo:hi])
    lists = [pa.ListArray.from_arrays(pa.array(offsets - base), pa.array(x)) for x in (references, doubled)]
    return pa.StructArray.from_arrays(lists, names=["references", "doubled"])


@F.arrow_udf(_COUNTS)
def sparse_midrank_counts(places: pa.Array, series: pa.Array) -> pa.Array:
    """Sliding midrank counts of values at rising places, over the places before each.

    A place may hold several entries, of which one has a value.
    """
    offsets = series.offsets.to_numpy()
    at = places.values.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = series.values.to_numpy(zero_copy_only=False).astype(np.float64)
    base = offsets[0]
    references = np.zeros(offsets[-1] - base, dtype=np.int32)
    doubled = np.zeros_like(references)
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        if lo < hi:
            own = at[lo:hi] - at[lo]
            dense, valued = np.full(own[-1] + 1, np.nan), ~np.isnan(flat[lo:hi])
            dense[own[valued]] = flat[lo:hi][valued]
            counts = sliding_counts(dense)
            references[lo - base : hi - base], doubled[lo - base : hi - base] = (c[own] for c in counts)
    lists = [pa.ListArray.from_arrays(pa.array(offsets - base), pa.array(x)) for x in (references, doubled)]
    return pa.StructArray.from_arrays(lists, names=["references", "doubled"])


def midrank_percentile(raw: Column, references: Column, doubled: Column) -> Column:
    """100·(below + ½·equal)/N over the reference window, null under 252 references."""
    return F.when(
        raw.isNotNull() & (references >= MIN_REFERENCES),
        F.lit(100.0) * (doubled / F.lit(2.0)) / references,
    )
