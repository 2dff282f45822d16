"""Price panels, raw feeds and universes read from the star-schema tables.

A desk is a block of twenty suppliers, so the number of instruments grows with the
data while each stays dense enough on the session calendar to carry signals.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.schemas import EXACT_SHARE_TYPE, PRICE_COLUMNS, PRICE_VALUES
from tickerloom.sources.calendar import SessionCalendar

SUPPLIERS_PER_DESK = 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@lru_cache(maxsize=None)
def _ship_range(sf_dir: str) -> tuple[date, date]:
    row = (
        read_table(_session(), sf_dir, "lineitem")
        .agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate")))
        .first()
    )
    return row[0], row[1]


@lru_cache(maxsize=None)
def panel_calendar(sf_dir: str) -> SessionCalendar:
    return SessionCalendar.around(*_ship_range(sf_dir))


@lru_cache(maxsize=None)
def panel_sessions(sf_dir: str) -> tuple[date, date]:
    """First and last session on which a line was shipped."""
    row = shipped_lines(_session(), sf_dir).agg(F.min("date"), F.max("date")).first()
    return row[0], row[1]


def padded(number: Column, width: int) -> Column:
    """A number with zeros in front up to a width; longer numbers stay whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def desk_name(slot: Column) -> Column:
    return F.concat(F.lit("DESK"), padded(slot, 7))


def supplier_name(slot: Column) -> Column:
    return F.concat(F.lit("SUP"), padded(slot, 9))


def retrieved(hour: Column) -> Column:
    return F.col("date").cast("timestamp") + F.make_dt_interval(hours=hour + 21)


def shipped_lines(spark: SparkSession, sf_dir: str, per: int = SUPPLIERS_PER_DESK) -> DataFrame:
    """All line items as trades in whole cents, so every sum is exact in any order.

    A line belongs to the session on or after its ship date; one without a date keeps none.
    """
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.expr(f"l_suppkey div {per}").alias("slot"),
        F.to_date("l_shipdate").alias("day"),
        F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.rint(F.col("l_discount") * 100).cast("bigint").alias("off"),
        F.col("l_quantity").cast("bigint").alias("units"),
        F.col("l_linestatus").alias("side"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").alias("hour"),
    )
    days = panel_calendar(sf_dir).days(spark).select("day", F.col("session").alias("date"))
    return lines.join(F.broadcast(days), "day", "left").drop("day")


def bars(lines: DataFrame, name=desk_name) -> DataFrame:
    """Daily bars: one shuffle on (slot, date) after map-side sums of whole numbers."""
    opening = F.col("side") == "O"
    reduced = F.col("off") > 0
    sums = lines.groupBy("slot", "date").agg(
        F.max("cents").alias("top"),
        F.min("cents").alias("bottom"),
        F.sum("cents").alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(opening, F.col("cents"))).alias("open_total"),
        F.count_if(opening).alias("open_n"),
        F.sum(F.when(reduced, F.col("cents") * (100 - F.col("off")))).alias("net_total"),
        F.count_if(reduced).alias("net_n"),
        F.sum("units").alias("units"),
        F.max("hour").alias("hour"),
    )
    return sums.select(
        "date",
        name(F.col("slot")).alias("ticker"),
        F.try_divide(F.col("open_total").cast("double"), F.col("open_n") * 100.0).alias("open"),
        (F.col("top") / 100.0).alias("high"),
        (F.col("bottom") / 100.0).alias("low"),
        (F.col("total") / (F.col("n") * 100.0)).alias("close"),
        F.try_divide(F.col("net_total").cast("double"), F.col("net_n") * 10000.0).alias("adjusted_close"),
        F.col("units").cast("double").alias("volume"),
        retrieved(F.col("hour")).alias("retrieved_at"),
    )


def desk_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical daily price table of the desks."""
    return bars(shipped_lines(spark, sf_dir))


def first_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price table as it stands without returned lines."""
    return bars(shipped_lines(spark, sf_dir).where(F.col("flag") != "R"))


def second_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later reading that lacks the accepted lines: losing, stale and equal-time rows occur."""
    return bars(shipped_lines(spark, sf_dir).where(F.col("flag") != "A"))


#: Fixed value: the day from which every second desk's earlier reading lacks the returned lines.
STALE_FROM = date(2000, 6, 1)


def stale_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price table before a late revision of every second desk."""
    late = (F.col("slot") % 2 == 0) & (F.col("flag") == "R") & (F.col("date") >= F.lit(STALE_FROM))
    return bars(shipped_lines(spark, sf_dir).where(~late))


def later_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full reading of all lines, retrieved twelve hours after the last one: a clean revision."""
    full = desk_prices(spark, sf_dir)
    return full.withColumn("retrieved_at", F.col("retrieved_at") + F.expr("INTERVAL 12 HOURS"))


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unvalidated vendor feed in which every row rule is broken somewhere.

    One quote per order, with the customer's balance as an opening price that may be
    negative and day-end fields that do not have to agree with it.
    """
    orders = read_table(spark, sf_dir, "orders")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    balance, total = F.col("c_acctbal"), F.col("o_totalprice")
    no_values = (status == "P") & (priority == "3-MEDIUM")

    def shown(value):
        return F.when(~no_values, value)

    return joined.select(
        F.when((status == "P") & (priority == "2-HIGH"), F.lit(None).cast("date"))
        .otherwise(F.to_date("o_orderdate"))
        .alias("date"),
        F.when((status == "P") & (priority == "1-URGENT"), "  ").otherwise(F.col("c_name")).alias("ticker"),
        shown(balance).alias("open"),
        shown(total).alias("high"),
        shown(F.when(status != "F", balance / 2.0)).alias("low"),
        shown(F.when(status != "O", total / 4.0)).alias("close"),
        shown(
            F.when(priority == "5-LOW", F.lit(float("nan")))
            .when(priority == "4-NOT SPECIFIED", F.lit(float("inf")))
            .otherwise(total)
        ).alias("adjusted_close"),
        shown(balance - 500.0).alias("volume"),
        F.col("o_orderdate").cast("timestamp").alias("retrieved_at"),
    )


def line_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed with one price row per line item: many copies per (ticker, date), some in conflict."""
    lines = shipped_lines(spark, sf_dir, per=1)
    level = F.col("units").cast("double")
    return lines.select(
        "date",
        supplier_name(F.col("slot")).alias("ticker"),
        *[
            (F.when(F.col("side") == "O", level) if c == "open" else level).alias(c)
            for c in PRICE_VALUES
        ],
        retrieved(F.col("hour")).alias("retrieved_at"),
    ).select(*PRICE_COLUMNS)


def copied_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The desk prices as sent once per line item: equal values, different retrieval times."""
    prices = desk_prices(spark, sf_dir).drop("retrieved_at")
    sends = shipped_lines(spark, sf_dir).select(
        desk_name(F.col("slot")).alias("ticker"),
        "date",
        retrieved(F.col("hour")).alias("retrieved_at"),
    )
    return prices.join(sends, ["ticker", "date"]).select(*PRICE_COLUMNS)


#: Nations whose counts lie beyond what a double, or a signed 64-bit number, holds.
BEYOND_DOUBLE, BEYOND_LONG = 6, 9


def share_counts(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """Sparse share counts per nation: cents ordered by its customers on one day, null for open orders.

    Two nations have 2^53 + 1 and 2^63 + 1 shares on top.
    """
    base = (
        F.when(F.col("c_nationkey") == BEYOND_DOUBLE, F.lit(2**53 + 1).cast("decimal(20,0)"))
        .when(F.col("c_nationkey") == BEYOND_LONG, F.lit(str(2**63 + 1)).cast("decimal(20,0)"))
        .otherwise(F.lit(0).cast("decimal(20,0)"))
    )
    orders = read_table(spark, sf_dir, "orders")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    if flag:
        orders = orders.where(F.col("o_orderstatus") != flag)
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(
            F.to_date("o_orderdate").alias("date"),
            F.concat(F.lit("NATION"), padded(F.col("c_nationkey"), 3)).alias("ticker"),
            base.alias("base"),
        )
        .agg(
            F.sum(
                F.when(F.col("o_orderstatus") != "O", F.rint(F.col("o_totalprice") * 100).cast("bigint"))
            ).alias("cents"),
            F.max(F.substring("o_orderpriority", 1, 1).cast("int")).alias("hour"),
        )
        .select(
            "date",
            "ticker",
            (F.col("base") + F.col("cents")).cast(EXACT_SHARE_TYPE).alias("shares_outstanding"),
            retrieved(F.col("hour")).alias("retrieved_at"),
        )
    )


def desk_share_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse share counts per desk: units shipped less units returned so far, on calendar days.

    A day whose dearest line costs a multiple of eleven cents, or that leaves no units, is a dated null.
    """
    daily = (
        read_table(spark, sf_dir, "lineitem")
        .where("l_shipdate is not null")
        .select(
            desk_name(F.expr(f"l_suppkey div {SUPPLIERS_PER_DESK}")).alias("ticker"),
            F.to_date("l_shipdate").alias("date"),
            F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
            F.col("l_quantity").cast("bigint").alias("units"),
            F.col("l_returnflag").alias("flag"),
        )
        .groupBy("ticker", "date")
        .agg(
            F.sum(F.when(F.col("flag") == "R", -F.col("units")).otherwise(F.col("units"))).alias("net"),
            F.max("cents").alias("top"),
        )
    )
    # Days are bounded by the calendar, so a desk's running total is no large group.
    so_far = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    level = F.sum("net").over(so_far)
    return daily.withColumn("level", level).select(
        "date",
        "ticker",
        F.when((F.col("level") > 0) & (F.col("top") % 11 != 0), F.col("level").cast(EXACT_SHARE_TYPE)).alias(
            "shares_outstanding"
        ),
        (F.col("date").cast("timestamp") + F.expr("INTERVAL 21 HOURS")).alias("retrieved_at"),
    )


def desk_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each desk holds of each part in cents; returned lines are no direct-long position."""
    return (
        read_table(spark, sf_dir, "lineitem")
        .select(
            desk_name(F.expr(f"l_suppkey div {SUPPLIERS_PER_DESK}")).alias("fund"),
            F.col("l_partkey").alias("security"),
            (F.col("l_returnflag") != "R").alias("direct_long"),
            F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("weight"),
        )
        .groupBy("fund", "security", "direct_long")
        .agg(F.sum("weight").alias("weight"))
    )


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maker of each part: its brand and name; parts above size 45 are not mapped."""
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("security"),
        F.when(F.col("p_size") <= 45, F.concat_ws(" ", "p_brand", "p_name")).alias("entity"),
    )


def desk_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured instruments: one index per region, which have no prices, then every desk."""
    table = read_table(spark, sf_dir, "region")
    indexes = table.agg(F.coalesce(F.max("r_regionkey") + 1, F.lit(0))).first()[0]
    regions = table.select(
        (F.col("r_regionkey") + 1).cast("bigint").alias("ord"),
        F.concat(F.lit("IDX"), padded(F.col("r_regionkey"), 3)).alias("ticker"),
        F.col("r_name").alias("name"),
        F.lit("Region index").alias("category"),
    )
    desks = (
        read_table(spark, sf_dir, "supplier")
        .groupBy(F.expr(f"s_suppkey div {SUPPLIERS_PER_DESK}").alias("slot"))
        .agg(F.min("s_suppkey").alias("s_suppkey"), F.min("s_nationkey").alias("n_nationkey"))
        .join(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
        .select(
            (F.col("slot") + 1 + indexes).cast("bigint").alias("ord"),
            desk_name(F.col("slot")).alias("ticker"),
            F.concat(F.lit("Suppliers from "), F.col("s_suppkey")).alias("name"),
            F.col("n_name").alias("category"),
        )
    )
    return regions.unionByName(desks)


def request_bounds(sf_dir: str) -> tuple[date, date]:
    """A request window that starts ten days before the first session and ends after the last."""
    first, last = panel_sessions(sf_dir)
    return first - timedelta(days=10), last + timedelta(days=1)


# Nations whose suppliers' payloads show one provider defect each.
WRONG_SYMBOL, NO_TIMES, TEXT_VOLUME, OLD_DATES, MIDNIGHT = 3, 7, 11, 13, 5
WRONG_SHARES, NO_SHARES, UNEVEN_SHARES = 4, 8, 12


def landed_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chart payload per supplier, built from its daily bars, some with a defect."""
    daily = bars(shipped_lines(spark, sf_dir, per=1), supplier_name).drop("retrieved_at")
    suppliers = read_table(spark, sf_dir, "supplier").select(
        supplier_name(F.col("s_suppkey")).alias("ticker"), "s_nationkey", "s_acctbal"
    )
    entry = F.struct("date", *PRICE_VALUES)
    series = daily.groupBy("ticker").agg(F.sort_array(F.collect_list(entry)).alias("d"))
    nation = F.col("s_nationkey")
    opening = F.when(nation == MIDNIGHT, 4 * 3600).when(nation == OLD_DATES, -3650 * 86400).otherwise(14 * 3600 + 1800)
    stamps = F.when(
        nation != NO_TIMES,
        F.transform("d", lambda x: F.unix_seconds(x["date"].cast("timestamp")) + opening),
    )
    units = F.when(nation == TEXT_VOLUME, F.transform("d.volume", lambda x: F.concat(F.lit("about "), x.cast("string"))))

    def chart(volumes: Column) -> Column:
        quote = F.struct(
            *[F.col(f"d.{c}").alias(c) for c in ("open", "high", "low", "close")], volumes.alias("volume")
        )
        return F.struct(
            F.struct(
                F.array(
                    F.struct(
                        F.struct(
                            F.when(nation == WRONG_SYMBOL, F.lower("ticker")).otherwise(F.col("ticker")).alias("symbol"),
                            F.lit("America/New_York").alias("exchangeTimezoneName"),
                        ).alias("meta"),
                        stamps.alias("timestamp"),
                        F.struct(
                            F.array(quote).alias("quote"),
                            F.array(F.struct(F.col("d.adjusted_close").alias("adjclose"))).alias("adjclose"),
                        ).alias("indicators"),
                    )
                ).alias("result"),
                F.lit(None).cast("string").alias("error"),
            ).alias("chart")
        )

    keep = {"ignoreNullFields": "false"}
    refusal = F.lit('{"chart": {"result": null, "error": {"code": "Not Found", "description": "No data found"}}}')
    payload = (
        F.when(F.col("s_acctbal") < 0, refusal)
        .when(nation == TEXT_VOLUME, F.to_json(chart(units), keep))
        .otherwise(F.to_json(chart(F.col("d.volume")), keep))
    )
    return suppliers.join(series, "ticker").select(
        "ticker",
        payload.alias("payload"),
        (F.lit("2002-01-01").cast("timestamp") + F.make_dt_interval(hours=nation)).alias("retrieved_at"),
    )


def chart_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier, and the region indexes, for which nothing was landed."""
    suppliers = read_table(spark, sf_dir, "supplier").select(supplier_name(F.col("s_suppkey")).alias("ticker"))
    indexes = read_table(spark, sf_dir, "region").select(
        F.concat(F.lit("IDX"), padded(F.col("r_regionkey"), 3)).alias("ticker")
    )
    return suppliers.unionByName(indexes)


def landed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One share payload per customer nation, some with a defect."""
    counts = share_counts(spark, sf_dir)
    nation = F.expr("substring(ticker, 7)").cast("int")
    series = counts.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("date", "shares_outstanding"))).alias("d")
    )
    # Whole counts, written with all their digits.
    counts = F.transform("d", lambda x: x["shares_outstanding"].cast("decimal(20,0)"))
    values = F.when(nation != NO_SHARES, counts)
    values = F.when(nation == UNEVEN_SHARES, F.slice(values, 2, F.size("d"))).otherwise(values)
    body = F.struct(
        F.struct(
            F.array(
                F.struct(
                    F.struct(
                        F.array(F.when(nation == WRONG_SHARES, F.lit("OTHER")).otherwise(F.col("ticker"))).alias("symbol")
                    ).alias("meta"),
                    F.transform("d.date", lambda x: F.unix_seconds(x.cast("timestamp"))).alias("timestamp"),
                    values.alias("shares_out"),
                )
            ).alias("result")
        ).alias("timeseries")
    )
    return series.select(
        "ticker",
        F.to_json(body).alias("payload"),
        (F.lit("2002-01-01").cast("timestamp") + F.make_dt_interval(hours=nation)).alias("retrieved_at"),
    )


def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines by the region of their supplier."""
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    homes = (
        read_table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("slot"), F.col("n_regionkey").cast("bigint").alias("region"))
    )
    lines = shipped_lines(spark, sf_dir, per=1)
    return lines.join(homes, "slot").withColumn("slot", F.col("region")).drop("region")


def region_name(slot: Column) -> Column:
    return F.concat(F.lit("REG"), slot.cast("string"))


def wide_region_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per date with 'field|ticker' columns for every region."""
    keys = sorted(r[0] for r in read_table(spark, sf_dir, "region").select("r_regionkey").collect())
    daily = bars(region_lines(spark, sf_dir), region_name)
    labels = {"open": "Open", "high": "High", "low": "Low", "close": "Close", "adjusted_close": "Adj Close", "volume": "Volume"}
    cells = [
        F.max(F.when(F.col("ticker") == f"REG{r}", F.col(field))).alias(f"{label}|REG{r}")
        for r in keys
        for field, label in labels.items()
    ]
    return daily.groupBy("date").agg(*cells)


def flat_market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker's flat table with provider spellings of the field labels."""
    lines = shipped_lines(spark, sf_dir).withColumn("slot", F.lit(0).cast("bigint"))
    daily = bars(lines, lambda slot: F.lit("MARKET"))
    return daily.select(
        "date",
        F.col("open").alias("Open"),
        F.col("high").alias("HIGH"),
        F.col("low").alias(" low "),
        F.col("close").alias("Close"),
        F.col("adjusted_close").alias("Adj_Close"),
        F.col("volume").cast("bigint").alias("Volume"),
        F.lit("ignored").alias("Dividends"),
    )


def claims(prices: DataFrame, start: date, end: date) -> DataFrame:
    """Successful retrieval statuses that claim exactly these rows."""
    return prices.groupBy("ticker").agg(
        F.lit("success").alias("status"),
        F.count(F.lit(1)).alias("rows_received"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max("retrieved_at").alias("retrieved_at"),
        F.lit(start).alias("query_start"),
        F.lit(end).alias("query_end"),
        F.array_sort(F.collect_list("date")).alias("returned_dates"),
        F.lit(None).cast("string").alias("error"),
    )
