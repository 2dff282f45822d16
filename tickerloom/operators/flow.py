"""Creation and redemption proxy from sparse share counts, and its rank among earlier intervals.

Prices and share counts are laid on one line of events per ticker, so that an as-of value or a count
of price dates is a running value and needs no range join. The line is cut into blocks of a calendar
year: rows are dealt by (ticker, block), and what a block needs from earlier or later ones (price
dates so far, the last close, the last share count, the next price date) comes from one summary row
per block. A ticker with very long or very dense history is therefore many small groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import is_finite, log_return, midrank_percentile, sparse_midrank_counts
from tickerloom.schemas import (
    CLOSE_AGE_DAYS,
    FLOW_COLUMNS,
    FLOW_SPAN,
    FLOW_TOLERANCE,
    LARGE_RATIO,
    LONGEST_INTERVAL,
    NOTIONAL_TOLERANCE,
    SPLIT_FACTORS,
)

_BLOCK = ("ticker", "block")


def _within(x: Column, tolerance: float) -> Column:
    """|ln x| <= ln(tolerance), without logarithms."""
    return (x <= tolerance) & (F.lit(1.0) / x <= tolerance)


def _events(shares: DataFrame, prices: DataFrame) -> DataFrame:
    """Price dates (kind 0) and share counts (kind 1); a price comes before a count of its date."""
    close = F.col("close").cast("double")
    valid = F.coalesce(is_finite(close) & (close > 0), F.lit(False))
    priced = prices.select(
        "ticker",
        "date",
        F.lit(0).alias("kind"),
        F.when(valid, F.struct(F.col("date").alias("day"), close.alias("close"))).alias("quote"),
        F.lit(None).cast(shares.schema["shares_outstanding"].dataType).alias("shares"),
    )
    counted = shares.select(
        "ticker",
        "date",
        F.lit(1).alias("kind"),
        F.lit(None).cast("struct<day:date,close:double>").alias("quote"),
        F.col("shares_outstanding").alias("shares"),
    )
    return priced.unionByName(counted).withColumn("block", F.year("date"))


def _within_blocks(events: DataFrame) -> DataFrame:
    """Running values inside each block: price dates so far, the last close, the next price date."""
    onward = Window.partitionBy(*_BLOCK).orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*_BLOCK).orderBy(F.desc("date"), F.desc("kind"))
    backward = backward.rowsBetween(Window.unboundedPreceding, 0)
    is_price = F.col("kind") == 0
    return events.withColumns(
        {
            "priced": F.count_if(is_price).over(onward),
            "quote": F.last("quote", ignorenulls=True).over(onward),
            "next_price": F.last(F.when(is_price, F.col("date")), ignorenulls=True).over(backward),
        }
    )


def _between_blocks(rows: DataFrame) -> DataFrame:
    """What earlier and later blocks of its ticker hand to each block; one row per block."""
    is_price, is_count = F.col("kind") == 0, F.col("kind") == 1
    count = F.struct("date", "shares", "priced", "quote")
    summary = rows.groupBy(*_BLOCK).agg(
        F.count_if(is_price).alias("prices"),
        F.max("quote").alias("last_quote"),
        F.min(F.when(is_price, F.col("date"))).alias("first_price"),
        F.max(F.when(is_count, count)).alias("last_count"),
    )
    line = Window.partitionBy("ticker").orderBy("block")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("ticker").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumns(
        {
            "before": F.coalesce(F.sum("prices").over(earlier), F.lit(0)),
            "quote_before": F.last("last_quote", ignorenulls=True).over(earlier),
            "price_after": F.last("first_price", ignorenulls=True).over(later),
        }
    )
    own = F.struct(
        F.col("last_count.date").alias("date"),
        F.col("last_count.shares").alias("shares"),
        (F.col("before") + F.col("last_count.priced")).alias("priced"),
        F.coalesce("last_count.quote", "quote_before").alias("quote"),
    )
    return carried.withColumn("count", F.when(F.col("last_count").isNotNull(), own)).select(
        *_BLOCK,
        "before",
        "quote_before",
        "price_after",
        F.last("count", ignorenulls=True).over(earlier).alias("count_before"),
    )


def share_intervals(shares: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per interval between consecutive present share counts; a dated null breaks the chain.

    Both tables hold one row per ticker and date. Each end has its as-of close and the number of
    price dates up to it, the interval the first price date after it.
    """
    rows = _within_blocks(_events(shares, prices))
    counts = rows.where("kind = 1").join(_between_blocks(rows), list(_BLOCK))
    resolved = counts.select(
        *_BLOCK,
        "date",
        F.struct(
            "date",
            "shares",
            (F.col("before") + F.col("priced")).alias("priced"),
            F.coalesce("quote", "quote_before").alias("quote"),
        ).alias("end"),
        "count_before",
        F.coalesce("next_price", "price_after").alias("signal_date"),
    )
    before = Window.partitionBy(*_BLOCK).orderBy("date")
    chained = resolved.withColumn("start", F.coalesce(F.lag("end").over(before), "count_before"))
    present = F.col("start.shares").isNotNull() & F.col("end.shares").isNotNull()

    def as_of(end: str) -> dict[str, Column]:
        age = F.date_diff(F.col(f"{end}.date"), F.col(f"{end}.quote.day"))
        fresh = age <= CLOSE_AGE_DAYS
        return {
            f"{end}_close": F.when(fresh, F.col(f"{end}.quote.close")),
            f"{end}_close_age": F.when(fresh, age),
        }

    return chained.where(present).select(
        "ticker",
        F.col("start.date").alias("start_date"),
        F.col("end.date").alias("end_date"),
        F.col("start.shares").alias("start_shares"),
        F.col("end.shares").alias("end_shares"),
        (F.col("end.priced") - F.col("start.priced")).alias("price_dates"),
        F.col("end.priced").alias("priced"),
        "signal_date",
        *[c.alias(n) for end in ("start", "end") for n, c in as_of(end).items()],
    )


def with_quarantine(intervals: DataFrame) -> DataFrame:
    """The suspected corporate actions: share ratio near a split factor, or large in itself.

    Closes can confirm a candidate and never clear it.
    """
    ratio = F.col("end_shares").cast("double") / F.col("start_shares").cast("double")
    factors = sorted({*SPLIT_FACTORS, *(1.0 / f for f in SPLIT_FACTORS)})
    matched = reduce(
        lambda known, f: known.when(_within(F.col("share_ratio") / f, FLOW_TOLERANCE), F.lit(f)),
        factors[1:],
        F.when(_within(F.col("share_ratio") / factors[0], FLOW_TOLERANCE), F.lit(factors[0])),
    )
    large = (F.col("share_ratio") >= LARGE_RATIO) | (F.lit(1.0) / F.col("share_ratio") >= LARGE_RATIO)
    reason = F.concat_ws(
        "|",
        F.when(F.col("matched_factor").isNotNull(), F.lit("common_factor")),
        F.when(large, F.lit("large_ratio")),
    )
    notional = F.col("share_ratio") * (F.col("end_close") / F.col("start_close"))
    confirmed = (
        F.when(F.col("quarantine_reason").isNull(), F.lit(None).cast("string"))
        .when(F.col("notional_ratio").isNull(), "price_missing")
        .when(_within(F.col("notional_ratio"), NOTIONAL_TOLERANCE), "price_confirmed")
        .otherwise("price_inconsistent")
    )
    return (
        intervals.withColumn("share_ratio", ratio)
        .withColumn("matched_factor", matched)
        .withColumn("quarantine_reason", F.nullif(reason, F.lit("")))
        .withColumn("notional_ratio", notional)
        .withColumn("price_evidence", confirmed)
    )


def with_flow_rank(flows: DataFrame) -> DataFrame:
    """Reference count and midrank percentile among the eligible intervals of 756 price dates.

    The place of a signal is the number of its price date; eligible intervals have different ones.
    Places are cut into stretches as long as the reference window, and each holds its own intervals
    and the eligible ones of the stretch before, so a group is bounded whatever the history. Rows
    are packed whole: nothing is joined back.
    """
    stretch = F.expr(f"priced div {FLOW_SPAN}")
    ranked = (F.col("status") == "eligible") & F.col("signal_date").isNotNull()
    rate = F.when(ranked, F.col("raw_flow_rate"))
    dealt = flows.withColumn("rate", rate).withColumn(
        "stretch", F.explode(F.when(ranked, F.array(stretch, stretch + 1)).otherwise(F.array(stretch)))
    )
    entry = F.struct("priced", "end_date", "rate", (F.col("stretch") == stretch).alias("own"), F.struct(*flows.columns).alias("row"))
    packed = dealt.groupBy("ticker", "stretch").agg(F.sort_array(F.collect_list(entry)).alias("series"))
    counted = packed.where(F.exists("series", lambda e: e["own"])).withColumn(
        "counts", sparse_midrank_counts(F.col("series.priced"), F.col("series.rate"))
    )
    references, doubled = F.col("counts.references").alias("n"), F.col("counts.doubled").alias("d")
    rows = counted.select(F.inline(F.arrays_zip("series", references, doubled))).where("series.own")
    found = F.col("series.rate").isNotNull()
    return rows.select(
        "series.row.*",
        F.when(found, F.col("n")).alias("reference_count"),
        midrank_percentile(F.col("series.rate"), F.col("n"), F.col("d")).alias("flow_percentile"),
    )


def flow_proxy(shares: DataFrame, prices: DataFrame) -> DataFrame:
    """Every share interval with its signed rate per price date, its diagnostics and its rank.

    An interval is eligible with one to five price dates and no suspected corporate action. Its rate
    belongs to the first price date after it. Nothing is filled, bridged or clipped; an interval that
    is not eligible, or ends after the last price date, has neither rate nor rank.
    """
    quarantined = with_quarantine(share_intervals(shares, prices))
    status = (
        F.when(F.col("quarantine_reason").isNotNull(), "suspected_corporate_action")
        .when(F.col("price_dates") < 1, "no_price_date")
        .when(F.col("price_dates") > LONGEST_INTERVAL, "too_many_price_dates")
        .otherwise("eligible")
    )
    start, end = F.col("start_shares"), F.col("end_shares")
    rate = log_return(start.cast("double"), end.cast("double")) / F.col("price_dates")
    change = (end - start).cast("double")
    flows = quarantined.withColumn("status", status).withColumns(
        {
            "delta_shares": end - start,
            "interval_share_change": change / start.cast("double"),
            "raw_flow_rate": F.when(F.col("status") == "eligible", rate),
            "dollar_flow": change * F.col("end_close"),
        }
    )
    return with_flow_rank(flows).select(*FLOW_COLUMNS)
