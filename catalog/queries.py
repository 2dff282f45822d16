"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


from tickerloom.functions import digests as dg
from tickerloom.functions import labels as lb
from tickerloom.functions import numeric as nm
from tickerloom.operators import batches as bt
from tickerloom.operators import concentration as cn
from tickerloom.operators import coverage as cv
from tickerloom.operators import dependence as dp
from tickerloom.operators import flow as fl
from tickerloom.operators import incremental as ic
from tickerloom.operators import quality as ql
from tickerloom.operators import signals as sg
from tickerloom.operators import spine as sp
from tickerloom.operators import vintages as vt
from tickerloom.plans import jobs, ordering as od, publish as pb, reports as rp, verify as vf
from tickerloom.plans.evaluate import Evaluation, evaluate
from tickerloom.schemas import MOMENTUM_COLUMNS, PRICE_VALUES, SHARE_VALUES, VOLATILITY_COLUMNS
from tickerloom.session import new_folder, side_by_side, stored
from tickerloom.sources import payloads as pl
from tickerloom.sources import tables as tb
from tickerloom.sources import universe as un
from tickerloom.sources.calendar import EvaluationTarget, SessionCalendar, resolve_instants
from tickerloom.streaming import updates as up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def flat(df: DataFrame, *columns: str, rounded: tuple[str, ...] = ()) -> DataFrame:
    """Dates, instants, decimals and lists as text and whole numbers as BIGINT, for comparison across engines."""
    out = []
    for name in columns or df.columns:
        kind, col = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DecimalType):
            col = F.regexp_replace(col.cast("string"), r"\.0*$|(\.[0-9]*[1-9])0+$", "$1")
        elif isinstance(kind, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), ",")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint")
        elif name in rounded:
            col = F.round(col, 6)
        out.append(col.alias(name))
    return df.select(*out)


RAW_MOMENTUM = ("raw_momentum", "simple_return_pct")
RAW_VOLATILITY = ("raw_annualized_volatility", "annualized_volatility_pct")


@query
def momentum(spark, sf_dir):
    return flat(sg.momentum(tb.desk_prices(spark, sf_dir), price_range=tb.panel_sessions(sf_dir), validated=True), rounded=RAW_MOMENTUM)


@query
def volatility(spark, sf_dir):
    return flat(sg.volatility(tb.desk_prices(spark, sf_dir), price_range=tb.panel_sessions(sf_dir), validated=True), rounded=RAW_VOLATILITY)


@query
def session_calendar(spark, sf_dir):
    """The session of each day with orders, its close and its neighbours."""
    calendar = tb.panel_calendar(sf_dir)
    days = tb.read_table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    joined = days.join(F.broadcast(calendar.days(spark)), "day", "left").join(
        F.broadcast(calendar.with_closes(spark)), "session", "left"
    )
    return flat(joined, "day", "orders", "session", "next_session", "back_21", "back_252", "close_utc")


@query
def scan_prices(spark, sf_dir):
    return flat(tb.desk_prices(spark, sf_dir))


# ---------------------------------------------------------------- shared inputs

BOUNDED = (date(2000, 1, 3), date(2000, 12, 29))
SLICE = EvaluationTarget(datetime(2000, 12, 30, tzinfo=timezone.utc), date(2000, 12, 29), date(1996, 1, 2), date(2000, 12, 30))


def prices_of(spark, sf_dir):
    return tb.desk_prices(spark, sf_dir)


def bounds_of(spark, sf_dir, prices=None):
    prices = prices_of(spark, sf_dir) if prices is None else prices
    return sp.signal_bounds(prices, price_range=tb.panel_sessions(sf_dir))


def target_of(sf_dir) -> EvaluationTarget:
    start, end = tb.request_bounds(sf_dir)
    last = end - timedelta(days=1)
    return EvaluationTarget(datetime(last.year, last.month, last.day, 23, tzinfo=timezone.utc), last, start, end)


def signals_of(spark, sf_dir, prices=None):
    """Both signals of a panel, computed once into the shared folder."""
    prices = prices_of(spark, sf_dir) if prices is None else prices
    bounds = sp.signal_bounds(prices, price_range=tb.panel_sessions(sf_dir))
    return sg.stored_signals(prices, bounds, new_folder(spark, "signals"))


def coverage_of(spark, sf_dir, prices=None):
    prices = stored(prices_of(spark, sf_dir), "prices")
    m, v = signals_of(spark, sf_dir, prices)
    return cv.coverage(prices, tb.desk_universe(spark, sf_dir), target_of(sf_dir), m, v), prices, m, v


def pairs_of(spark, sf_dir):
    m, v = signals_of(spark, sf_dir)
    return stored(dp.paired_percentiles(m, v, tb.desk_universe(spark, sf_dir)), "pairs")


# ---------------------------------------------------------------- signals


@query
def momentum_raw(spark, sf_dir):
    rows = sg.raw_signals(prices_of(spark, sf_dir), bounds_of(spark, sf_dir)).where("raw_momentum is not null")
    return flat(rows.withColumnRenamed("session", "signal_date"), "ticker", "signal_date", "raw_momentum", rounded=RAW_MOMENTUM)


@query
def daily_log_return(spark, sf_dir):
    rows = sg.raw_signals(prices_of(spark, sf_dir), bounds_of(spark, sf_dir)).where("daily_return is not null")
    return flat(rows.withColumnRenamed("session", "signal_date"), "ticker", "signal_date", "daily_return", rounded=("daily_return",))


@query
def volatility_raw(spark, sf_dir):
    rows = sg.raw_signals(prices_of(spark, sf_dir), bounds_of(spark, sf_dir)).where("raw_volatility is not null")
    return flat(rows.withColumnRenamed("session", "signal_date"), "ticker", "signal_date", "raw_volatility", rounded=("raw_volatility",))


def momentum_of(spark, sf_dir):
    return sg.momentum(prices_of(spark, sf_dir), price_range=tb.panel_sessions(sf_dir), validated=True)


def volatility_of(spark, sf_dir):
    return sg.volatility(prices_of(spark, sf_dir), price_range=tb.panel_sessions(sf_dir), validated=True)


@query
def momentum_percentile(spark, sf_dir):
    return flat(momentum_of(spark, sf_dir), "ticker", "signal_date", "momentum_percentile", "normalization_reference_count")


@query
def volatility_percentile(spark, sf_dir):
    return flat(volatility_of(spark, sf_dir), "ticker", "signal_date", "volatility_percentile", "normalization_reference_count")


@query
def momentum_missing(spark, sf_dir):
    return flat(
        momentum_of(spark, sf_dir),
        "ticker",
        "signal_date",
        "interior_missing_row_count",
        "interior_missing_row_dates",
        "interior_missing_adjusted_close_count",
        "interior_missing_adjusted_close_dates",
    )


@query
def volatility_missing(spark, sf_dir):
    return flat(
        volatility_of(spark, sf_dir),
        "ticker",
        "signal_date",
        "missing_row_count",
        "missing_row_dates",
        "missing_adjusted_close_count",
        "missing_adjusted_close_dates",
    )


@query
def momentum_bounded(spark, sf_dir):
    rows = sg.momentum(prices_of(spark, sf_dir), *BOUNDED, price_range=tb.panel_sessions(sf_dir), validated=True)
    return flat(rows, rounded=RAW_MOMENTUM)


@query
def endpoint_status(spark, sf_dir):
    return momentum_of(spark, sf_dir).groupBy("ticker", "endpoint_status", "endpoint_eligible").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def window_status(spark, sf_dir):
    return volatility_of(spark, sf_dir).groupBy("ticker", "window_status", "window_eligible").agg(
        F.count(F.lit(1)).alias("rows")
    )


def _return_inputs(spark, sf_dir):
    """A near endpoint pair for early lines, a far one for the others."""
    far = F.col("l_linenumber") > 3
    return tb.read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("start"),
        F.when(far, F.col("l_quantity")).otherwise(F.col("l_extendedprice") * (1.0 - F.col("l_discount"))).alias("end"),
    )


@query
def stable_log_return(spark, sf_dir):
    rows = _return_inputs(spark, sf_dir).withColumn("raw", nm.log_return(F.col("start"), F.col("end")))
    return flat(rows, "l_orderkey", "l_linenumber", "start", "raw", rounded=("raw",))


@query
def simple_return(spark, sf_dir):
    rows = _return_inputs(spark, sf_dir).withColumn("raw", nm.log_return(F.col("start"), F.col("end")))
    rows = nm.with_simple_return(rows, "start", "end", "raw", "pct").withColumn(
        "status", nm.simple_return_status(F.lit(True), F.col("pct"))
    )
    return flat(rows, "l_orderkey", "l_linenumber", "start", "pct", "status", rounded=("pct",))


@query
def next_session(spark, sf_dir):
    """The first session after each on which lines count, with their number."""
    lines = tb.shipped_lines(spark, sf_dir).groupBy(F.col("date").alias("session")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    sessions = tb.panel_calendar(sf_dir).frame(spark)
    return flat(lines.join(F.broadcast(sessions), "session"), "session", "next_session", "lines")


@query
def first_last_present(spark, sf_dir):
    return flat(cv.first_last_present(volatility_of(spark, sf_dir), "volatility_percentile"))


@query
def latest_eligible(spark, sf_dir):
    return flat(cv.latest_eligible(momentum_of(spark, sf_dir), "momentum_percentile"))


@query
def staleness(spark, sf_dir):
    held = cv.first_last_present(volatility_of(spark, sf_dir), "raw_annualized_volatility")
    latest = tb.desk_universe(spark, sf_dir).select("ticker").join(
        held.select("ticker", F.col("last_date").alias("latest")), "ticker", "left"
    )
    return flat(cv.staleness(latest, target_of(sf_dir)))


@query
def target_observation(spark, sf_dir):
    rows = cv.target_observation(momentum_of(spark, sf_dir), tb.desk_universe(spark, sf_dir), target_of(sf_dir))
    return flat(rows, "ord", "ticker", "signal_date", "raw_momentum", "momentum_percentile", "endpoint_status", rounded=RAW_MOMENTUM)


@query
def normalization_status(spark, sf_dir):
    m = momentum_of(spark, sf_dir).withColumn(
        "status",
        nm.normalization_status(F.lit(True), F.col("raw_momentum"), F.col("momentum_percentile")),
    )
    return m.groupBy("ticker", "status").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- flow and concentration


@query
def flow_proxy(spark, sf_dir):
    """Share intervals of the desks against their own prices, with rates, quarantine and ranks."""
    flows = fl.flow_proxy(tb.desk_share_levels(spark, sf_dir), tb.desk_prices(spark, sf_dir))
    wholes = {c: F.col(c).cast("bigint") for c in ("start_shares", "end_shares", "delta_shares")}
    return flat(flows.withColumns(wholes), rounded=("raw_flow_rate", "interval_share_change", "share_ratio", "notional_ratio", "dollar_flow"))


@query
def holdings_concentration(spark, sf_dir):
    """How concentrated the direct-long holdings of every desk are by maker."""
    return flat(
        cn.concentration(tb.desk_holdings(spark, sf_dir), tb.part_entities(spark, sf_dir)),
        rounded=("raw_hhi", "hhi_points", "effective_holdings", "top_10_weight_pct"),
    )


# ---------------------------------------------------------------- quality


def _rules(*names: str):
    return [r for r in ql.price_rules() if r.name in names]


def _found(spark, sf_dir, rules):
    return flat(ql.row_violations(tb.raw_quotes(spark, sf_dir), rules), "rule", "ticker", "date")


@query
def dq_nonfinite(spark, sf_dir):
    return _found(spark, sf_dir, [r for r in ql.price_rules() if r.name.startswith("nonfinite")])


@query
def dq_keys(spark, sf_dir):
    return _found(spark, sf_dir, ql.key_rules())


@query
def dq_all_missing(spark, sf_dir):
    return _found(spark, sf_dir, _rules("no_market_value"))


@query
def dq_positive(spark, sf_dir):
    return _found(spark, sf_dir, [r for r in ql.price_rules() if r.name.startswith("nonpositive")])


@query
def dq_volume(spark, sf_dir):
    return _found(spark, sf_dir, _rules("negative_volume"))


@query
def dq_ohlc(spark, sf_dir):
    return _found(spark, sf_dir, ql.ohlc_rules())


@query
def dq_duplicate_keys(spark, sf_dir):
    return flat(ql.duplicate_keys(tb.line_quotes(spark, sf_dir)))


@query
def dq_shares_positive(spark, sf_dir):
    customers = tb.read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    orders = tb.read_table(spark, sf_dir, "orders")
    shares = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.to_date("o_orderdate").alias("date"),
        F.col("c_name").alias("ticker"),
        F.when(F.col("o_orderstatus") != "F", F.col("c_acctbal")).alias("shares_outstanding"),
        F.col("o_orderdate").cast("timestamp").alias("retrieved_at"),
    )
    return flat(ql.row_violations(shares, ql.share_rules()), "rule", "ticker", "date")


@query
def dq_off_calendar(spark, sf_dir):
    daily = tb.read_table(spark, sf_dir, "lineitem").groupBy(
        F.expr("l_suppkey div 20").alias("slot"), F.to_date("l_shipdate").alias("date")
    ).agg(F.count(F.lit(1)).alias("lines"))
    prices = daily.select(tb.desk_name(F.col("slot")).alias("ticker"), "date", "lines")
    return flat(sp.off_calendar(prices, tb.panel_calendar(sf_dir)), "ticker", "date", "lines")


@query
def signal_input_violations(spark, sf_dir):
    """What a signal call refuses in a feed with one row per line item on its raw ship date."""
    feed = tb.read_table(spark, sf_dir, "lineitem").select(
        tb.desk_name(F.expr(f"l_suppkey div {tb.SUPPLIERS_PER_DESK}")).alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("adjusted_close"),
    )
    return flat(sg.input_violations(feed, tb.panel_calendar(sf_dir)), "rule", "ticker", "date")


@query
def violation_examples(spark, sf_dir):
    found = ql.violations(tb.raw_quotes(spark, sf_dir), ql.price_rules())
    return flat(ql.first_examples(found), "rule", "ticker", "date", "example")


@query
def window_violations(spark, sf_dir):
    found = ql.outside_window(prices_of(spark, sf_dir), date(1996, 1, 2), date(2001, 1, 2))
    return found.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"),
    )


@query
def lossless_cast(spark, sf_dir):
    wide = tb.read_table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") + 9007199254740992).alias("big")
    )
    lost_double = ql.lossy_casts(wide, "big", "double").select("o_orderkey", F.lit("bigint to double").alias("cast"))
    totals = tb.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lost_bigint = ql.lossy_casts(totals, "o_totalprice", "bigint").select("o_orderkey", F.lit("double to bigint").alias("cast"))
    return lost_double.unionByName(lost_bigint)


# ---------------------------------------------------------------- vintages


def vintages(spark, sf_dir):
    return tb.first_vintage(spark, sf_dir), tb.second_vintage(spark, sf_dir)


@query
def dedupe_prices(spark, sf_dir):
    return flat(vt.deduplicate(tb.copied_quotes(spark, sf_dir), PRICE_VALUES))


@query
def dedupe_conflicts(spark, sf_dir):
    return flat(vt.duplicate_conflicts(tb.line_quotes(spark, sf_dir), PRICE_VALUES))


def _sent_twice(shares):
    return shares.unionByName(shares.withColumn("retrieved_at", F.col("retrieved_at") + F.expr("INTERVAL 12 HOURS")))


@query
def scan_shares(spark, sf_dir):
    return flat(tb.share_counts(spark, sf_dir))


@query
def dedupe_shares(spark, sf_dir):
    return flat(vt.deduplicate(_sent_twice(tb.share_counts(spark, sf_dir)), SHARE_VALUES))


@query
def merge_actions(spark, sf_dir):
    return flat(vt.vintage_actions(*vintages(spark, sf_dir), PRICE_VALUES), "ticker", "date", "action")


@query
def merge_prices(spark, sf_dir):
    actions = vt.vintage_actions(*vintages(spark, sf_dir), PRICE_VALUES)
    return flat(vt.merged(actions, ("ticker", "date", *PRICE_VALUES, "retrieved_at")))


@query
def merge_shares(spark, sf_dir):
    first, second = tb.share_counts(spark, sf_dir, "F"), tb.share_counts(spark, sf_dir, "P")
    actions = vt.vintage_actions(first, second, SHARE_VALUES)
    return flat(actions, "ticker", "date", "shares_outstanding", "retrieved_at", "action")


@query
def revision_summary(spark, sf_dir):
    return vt.revision_summary(vt.vintage_actions(*vintages(spark, sf_dir), PRICE_VALUES))


@query
def vanished_rows(spark, sf_dir):
    first, second = vintages(spark, sf_dir)
    statuses = tb.claims(second, date(1996, 1, 2), date(2001, 1, 2))
    return flat(vt.vanished_rows(first, statuses))


@query
def common_keys(spark, sf_dir):
    return flat(vt.common_keys(*vintages(spark, sf_dir)))


@query
def missing_sessions(spark, sf_dir):
    first, last = tb.panel_sessions(sf_dir)
    return flat(sp.missing_sessions(prices_of(spark, sf_dir), tb.panel_calendar(sf_dir), first, last))


@query
def frame_diff(spark, sf_dir):
    first, second = vintages(spark, sf_dir)
    columns = ("ticker", "date", "high", "low", "close", "volume")
    return flat(vt.frame_difference(first.select(*columns), second.select(*columns)))


# ---------------------------------------------------------------- the canonical store


def price_store(spark):
    return jobs.price_store(spark, new_folder(spark, "prices"))


def revised_store(spark, sf_dir):
    """A store that took the first vintage and then a full, later reading of all lines."""
    store = price_store(spark)
    store.persist(tb.first_vintage(spark, sf_dir))
    return store, store.persist(tb.later_vintage(spark, sf_dir))


@query
def persist_prices(spark, sf_dir):
    return flat(revised_store(spark, sf_dir)[0].read())


@query
def persist_revisions(spark, sf_dir):
    return revised_store(spark, sf_dir)[1].revised_tickers


@query
def snapshot_rows(spark, sf_dir):
    """The superseded table, read under the snapshot that the revision left."""
    store, persisted = revised_store(spark, sf_dir)
    return flat(store.read(number=store.snapshots()[persisted.snapshot]))


@query
def persist_shares(spark, sf_dir):
    store = jobs.share_store(spark, new_folder(spark, "shares"))
    full = tb.share_counts(spark, sf_dir)
    store.persist(tb.share_counts(spark, sf_dir, "F"))
    store.persist(full.withColumn("retrieved_at", F.col("retrieved_at") + F.expr("INTERVAL 12 HOURS")))
    return flat(store.read())


@query
def stream_updates(spark, sf_dir):
    """Two vintages land as files and a stream merges them: the held rows and the refused ones."""
    store = price_store(spark)
    landing, quarantine, checkpoint = (new_folder(spark, p) for p in ("landing", "quarantine", "stream"))
    for vintage in vintages(spark, sf_dir):
        vintage.write.mode("append").parquet(landing)
        up.stream_updates(spark, landing, store, quarantine, checkpoint).awaitTermination()
    held = store.read().select("ticker", "date", "adjusted_close", "retrieved_at", F.lit("held").alias("outcome"))
    refused = spark.read.parquet(quarantine).select("ticker", "date", F.col("reason").alias("outcome"))
    return flat(held.unionByName(refused, allowMissingColumns=True))


@query
def harmonise_vintages(spark, sf_dir):
    """Whole numbers beyond 2^53 united with doubles: the type that holds both is found first."""
    orders = tb.read_table(spark, sf_dir, "orders")
    whole = orders.select("o_orderkey", (F.col("o_orderkey") + 9007199254740992).alias("units"))
    real = orders.select("o_orderkey", F.floor("o_totalprice").cast("double").alias("units"))
    return ql.union_losslessly([whole, real], ("units",))


@query
def vintage_diff(spark, sf_dir):
    old, new = stored(tb.first_vintage(spark, sf_dir), "prices"), stored(prices_of(spark, sf_dir), "prices")
    m1, v1 = signals_of(spark, sf_dir, old)
    m2, v2 = signals_of(spark, sf_dir, new)
    return rp.revision_report(
        old,
        new,
        {
            "momentum": (m1, m2, "raw_momentum", "momentum_percentile"),
            "volatility": (v1, v2, "raw_annualized_volatility", "volatility_percentile"),
        },
    )


def refreshed(spark, sf_dir):
    """Signals of a stale table, brought up to date after the revision that the store took."""
    store = price_store(spark)
    before = store.persist(tb.stale_vintage(spark, sf_dir)).entry
    stale = store.read()
    bounds = sp.signal_bounds(stale)
    m, v = sg.stored_signals(stale, bounds, new_folder(spark, "signals"))
    store.persist(tb.later_vintage(spark, sf_dir))
    prices = store.read()
    return ic.refresh_signals(m, v, prices, store.changes(before), sp.signal_bounds(prices), new_folder(spark, "refreshed"))


@query
def incremental_momentum(spark, sf_dir):
    return flat(refreshed(spark, sf_dir).momentum, rounded=RAW_MOMENTUM)


@query
def incremental_volatility(spark, sf_dir):
    return flat(refreshed(spark, sf_dir).volatility, rounded=RAW_VOLATILITY)


@query
def incremental_reach(spark, sf_dir):
    """How many sessions of each desk a late revision made the refresh compute again."""
    return refreshed(spark, sf_dir).islands.groupBy("ticker").agg(
        F.sum(F.col("hi") - F.col("lo") + 1).cast("bigint").alias("recomputed_rows")
    )


# ---------------------------------------------------------------- sources


@query
def ingest_chart_json(spark, sf_dir):
    return flat(pl.chart_rows(pl.chart_payloads(tb.landed_charts(spark, sf_dir))))


def price_landing(spark, sf_dir):
    start, end = tb.request_bounds(sf_dir)
    return jobs.land_prices(tb.landed_charts(spark, sf_dir), tb.chart_requests(spark, sf_dir), start, end)


@query
def ingest_batch_status(spark, sf_dir):
    return flat(price_landing(spark, sf_dir)[1])


@query
def status_summary(spark, sf_dir):
    return flat(bt.status_summary(price_landing(spark, sf_dir)[1]))


@query
def batch_retrieved_at(spark, sf_dir):
    return flat(bt.batch_retrieved_at(price_landing(spark, sf_dir)[1]))


@query
def acquisition_view(spark, sf_dir):
    rows = pl.chart_rows(pl.chart_payloads(tb.landed_charts(spark, sf_dir)))
    return flat(bt.acquisition_view(rows, price_landing(spark, sf_dir)[1]))


@query
def dq_status_reconcile(spark, sf_dir):
    first, second = vintages(spark, sf_dir)
    start, end = tb.request_bounds(sf_dir)
    found = bt.status_violations(
        tb.claims(second, start, end), first, tb.desk_universe(spark, sf_dir), start, end - timedelta(days=1)
    )
    return flat(found)


@query
def ingest_shares_json(spark, sf_dir):
    return flat(pl.share_rows(pl.share_payloads(tb.landed_shares(spark, sf_dir))))


@query
def ingest_shares_status(spark, sf_dir):
    landed = tb.landed_shares(spark, sf_dir)
    return flat(jobs.land_shares(landed, landed.select("ticker"))[1])


FIXED_INSTANT = datetime(2002, 1, 1, 6, tzinfo=timezone.utc)


@query
def unpivot_wide_prices(spark, sf_dir):
    wanted = ["REG0", "reg2", "REG4", "ABSENT"]
    return flat(pl.unpivot_wide(tb.wide_region_prices(spark, sf_dir), wanted, F.lit(FIXED_INSTANT)))


@query
def normalize_flat_prices(spark, sf_dir):
    return flat(pl.normalize_flat(tb.flat_market_prices(spark, sf_dir), "MARKET", F.lit(FIXED_INSTANT)))


@query
def normalize_shares(spark, sf_dir):
    series = tb.read_table(spark, sf_dir, "orders").select(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:30:00-05:00")).alias("stamp"),
        F.when(F.col("o_orderstatus") != "O", F.floor("o_totalprice")).alias("value"),
        F.concat(F.lit("CUST"), F.col("o_custkey")).alias("name"),
    )
    rows = pl.normalize_shares(series, F.col("name"), F.lit(FIXED_INSTANT))
    # These counts are small: shown as doubles, as the statement has them.
    return flat(rows.withColumn("shares_outstanding", F.col("shares_outstanding").cast("double")))


@query
def universe_check(spark, sf_dir):
    part = tb.read_table(spark, sf_dir, "part")
    entries = part.select(
        F.when(F.col("p_type") == "ECONOMY", F.upper("p_name")).otherwise(F.col("p_name")).alias("ticker"),
        F.col("p_brand").alias("name"),
        F.when(F.col("p_size") < 3, " ").otherwise(F.col("p_type")).alias("category"),
    )
    return un.universe_violations(entries)


@query
def universe_hash(spark, sf_dir):
    return un.universe_hash(tb.desk_universe(spark, sf_dir))


@query
def default_end_date(spark, sf_dir):
    instants = tb.read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("instant"))
    return flat(bt.default_end_dates(instants), "event_id", "default_end")


@query
def shares_query_window(spark, sf_dir):
    kind = F.col("event_type")
    day = F.to_date("ts")
    requests = tb.read_table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("ticker"),
        F.when(kind == "click", "Asia/Tokyo").when(kind == "view", "Europe/London").otherwise("America/New_York").alias("zone"),
        F.when(kind == "error", F.date_sub(day, 30)).when(kind == "purchase", F.date_add(day, 30)).alias("start"),
        F.when(kind.isin("signup", "purchase"), day).alias("end"),
        F.col("ts").cast("timestamp").alias("instant"),
    )
    return flat(bt.share_query_windows(requests))


@query
def resolve_target(spark, sf_dir):
    # Instants of errors are shown a century early, before any session rule is known.
    shown = F.when(F.col("event_type") == "error", F.col("ts") - F.expr("INTERVAL 100 YEARS")).otherwise(F.col("ts"))
    events = tb.read_table(spark, sf_dir, "events")
    rows = resolve_instants(events.select("event_id", shown.cast("timestamp").alias("captured_at")), date(2018, 1, 1))
    return flat(rows, "event_id", "target_session", "request_start", "request_end", "target_status")


@query
def run_id(spark, sf_dir):
    events = tb.read_table(spark, sf_dir, "events")
    return events.select("event_id", lb.run_id(F.col("ts").cast("timestamp")).alias("run_id"))


@query
def classify_runs(spark, sf_dir):
    kind = F.col("event_type")
    stem = lb.run_id(F.col("ts").cast("timestamp"))
    name = (
        F.when(kind == "error", F.concat(stem, F.lit(".invalid-1")))
        .when(kind == "view", F.concat(F.lit("."), stem, F.lit(".tmp-1")))
        .when(kind == "signup", F.concat(F.lit("note-"), F.col("event_id")))
        .when(kind == "purchase", F.concat(F.lit("note.tmp-"), F.col("event_id")))
        .otherwise(stem)
    )
    return pb.classify_runs(tb.read_table(spark, sf_dir, "events").select(name.alias("name")))


# ---------------------------------------------------------------- evaluation


@query
def evaluation_slice(spark, sf_dir):
    rows = cv.evaluation_slice(prices_of(spark, sf_dir), tb.desk_universe(spark, sf_dir), SLICE)
    return flat(rows, "ticker", "date", "close", "adjusted_close")


@query
def coverage_prices(spark, sf_dir):
    return flat(cv.price_coverage(prices_of(spark, sf_dir), target_of(sf_dir)))


@query
def coverage_missing_dates(spark, sf_dir):
    target = target_of(sf_dir)
    lists = sp.missing_session_lists(
        prices_of(spark, sf_dir), cv.evaluation_calendar(target), target.request_start, target.target_session
    )
    return flat(lists)


RAW_COVERAGE = (
    "momentum_target_raw",
    "momentum_target_simple_return_pct",
    "volatility_target_raw",
    "volatility_target_annualized_pct",
)


@query
def coverage(spark, sf_dir):
    return flat(coverage_of(spark, sf_dir)[0], rounded=RAW_COVERAGE)


def evaluation_of(spark, sf_dir):
    """An offline evaluation of the desks, by the public entry point."""
    return evaluate(prices_of(spark, sf_dir), tb.desk_universe(spark, sf_dir), target_of(sf_dir))


@query
def evaluation_coverage(spark, sf_dir):
    return flat(evaluation_of(spark, sf_dir).frames["coverage"], rounded=RAW_COVERAGE)


@query
def evaluation_validated(spark, sf_dir):
    """An evaluation whose coverage was changed for one nation, against its recomputation."""
    held = evaluation_of(spark, sf_dir)
    fresh = jobs.recompute(held.frames["input_prices"], held.universe, held.target)
    coverage = held.frames["coverage"]
    odd = F.when(F.col("category") == "NATION_1", F.lit(99)).otherwise(F.col("missing_canonical_count"))
    frames = held.frames | {"coverage": coverage.withColumn("missing_canonical_count", odd.cast("bigint"))}
    names = ("input_prices", "momentum", "volatility", "coverage")
    return vf.regeneration({n: frames[n] for n in names}, {n: fresh[n] for n in names})


@query
def dependence_pearson(spark, sf_dir):
    rows = dp.correlations(pairs_of(spark, sf_dir), "ticker")
    return flat(rows, "ticker", "pair_count", "status", "pearson", rounded=("pearson",))


@query
def dependence_spearman(spark, sf_dir):
    rows = dp.correlations(pairs_of(spark, sf_dir), "ticker")
    return flat(rows, "ticker", "pair_count", "status", "spearman", rounded=("spearman",))


@query
def dependence_by_ticker(spark, sf_dir):
    rows = dp.dependence_by_ticker(pairs_of(spark, sf_dir), tb.desk_universe(spark, sf_dir))
    return flat(rows, rounded=("estimate",))


def by_session(spark, sf_dir):
    target = target_of(sf_dir)
    return dp.dependence_by_session(
        pairs_of(spark, sf_dir),
        tb.desk_universe(spark, sf_dir),
        cv.evaluation_calendar(target),
        target.request_start,
        target.target_session,
    )


@query
def dependence_by_session(spark, sf_dir):
    return flat(by_session(spark, sf_dir), rounded=("estimate",))


@query
def dependence(spark, sf_dir):
    m, v = signals_of(spark, sf_dir)
    target = target_of(sf_dir)
    pairs = stored(dp.paired_percentiles(m, v, tb.desk_universe(spark, sf_dir)), "pairs")
    universe = tb.desk_universe(spark, sf_dir)
    rows = dp.dependence_by_ticker(pairs, universe).unionByName(
        dp.dependence_by_session(
            pairs, universe, cv.evaluation_calendar(target), target.request_start, target.target_session
        )
    )
    return flat(rows, rounded=("estimate",))


@query
def dependence_history(spark, sf_dir):
    return flat(rp.dependence_history(by_session(spark, sf_dir), "spearman"), rounded=("estimate",))


# ---------------------------------------------------------------- publication and verification


def frames_of(spark, sf_dir):
    rows, prices, m, v = coverage_of(spark, sf_dir)
    target, universe = target_of(sf_dir), tb.desk_universe(spark, sf_dir)
    pairs = stored(dp.paired_percentiles(m, v, universe), "pairs")
    calendar = cv.evaluation_calendar(target)
    dependence_rows = dp.dependence_by_ticker(pairs, universe).unionByName(
        dp.dependence_by_session(pairs, universe, calendar, target.request_start, target.target_session)
    )
    return {
        "input_prices": prices,
        "coverage": stored(rows, "coverage"),
        "momentum": m,
        "volatility": v,
        "dependence": stored(dependence_rows, "dependence"),
    }


@query
def publish_manifest(spark, sf_dir):
    return flat(pb.manifest_rows(frames_of(spark, sf_dir)), "artifact", "filename", "fields", "row_count")


@query
def artifact_inventory(spark, sf_dir):
    """Fields of the five artifacts, as the manifest lists them."""
    return flat(pb.inventory_rows(pb.manifest_rows(frames_of(spark, sf_dir))))


@query
def artifact_digest(spark, sf_dir):
    return flat(dg.content_digest(prices_of(spark, sf_dir)))


@query
def verify_order(spark, sf_dir):
    """Momentum written in order, with its rows turned round, and with two files in the wrong order."""
    m, key = signals_of(spark, sf_dir)[0], ["ticker", "signal_date"]
    folders = {case: new_folder(spark, f"order-{case}") for case in ("sorted", "reversed", "swapped")}
    od.write_sorted(m, folders["sorted"], key)
    # One file takes the sorted ranges one after the other; none is larger than a range of the sort.
    m.orderBy(*[F.desc(c) for c in key]).coalesce(1).write.parquet(folders["reversed"])
    # The row of the smallest key comes behind the files of all others.
    least = m.agg(F.min(F.struct(*key)).alias("least"))
    marked = m.crossJoin(F.broadcast(least)).withColumn("early", F.struct(*key) == F.col("least")).drop("least")
    parts = [marked.where("not early").repartitionByRange(*key), marked.where("early").coalesce(1)]
    late, early = (part.drop("early").sortWithinPartitions(*key) for part in parts)
    late.unionByName(early).write.parquet(folders["swapped"])
    found = [od.order_violations(spark, folder, key).withColumn("artifact", F.lit(case)) for case, folder in folders.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("artifact", "rule").agg(F.sum("found").alias("found"))


@query
def verify_row_counts(spark, sf_dir):
    """Artifact row counts against the counts that the population rules demand."""
    frames = frames_of(spark, sf_dir)
    target, universe = target_of(sf_dir), tb.desk_universe(spark, sf_dir)
    calendar = cv.evaluation_calendar(target)
    everyone, days = universe.count(), calendar.index_until(target.target_session) - calendar.index_from(target.request_start) + 1
    first, last = tb.panel_sessions(sf_dir)
    spanned = calendar.index_until(last) - calendar.index_from(first) + 1
    priced = frames["input_prices"].select("ticker").distinct().count()
    demanded = {
        "coverage": everyone,
        "momentum": priced * spanned,
        "volatility": priced * spanned,
        "dependence": 2 * (everyone + days),
    }
    manifest = pb.manifest_rows({k: frames[k] for k in demanded})
    claim = F.element_at(F.create_map(*[F.lit(x) for pair in demanded.items() for x in pair]), F.col("artifact"))
    return flat(manifest.withColumn("demanded", claim), "artifact", "row_count", "demanded")


MONDAY, WEDNESDAY, FRIDAY = 0, 2, 4


def tampered_momentum(spark, sf_dir):
    day = F.weekday("signal_date")
    rows = momentum_of(spark, sf_dir)
    return rows.withColumns(
        {
            "momentum_percentile": F.when(day == FRIDAY, F.col("momentum_percentile") + 200.0).otherwise(F.col("momentum_percentile")),
            "endpoint_status": F.when(
                (day == MONDAY) & (F.col("endpoint_status") == "missing_start_row"),
                "missing_start_row|missing_start_adjusted_close",
            ).otherwise(F.col("endpoint_status")),
            "interior_missing_row_count": F.when(
                (day == WEDNESDAY) & (F.col("interior_missing_row_count") > 0), F.col("interior_missing_row_count") + 1
            ).otherwise(F.col("interior_missing_row_count")),
        }
    )


@query
def verify_momentum_contract(spark, sf_dir):
    return flat(vf.momentum_contract(stored(tampered_momentum(spark, sf_dir), "tampered"), tb.panel_calendar(sf_dir)))


@query
def verify_volatility_contract(spark, sf_dir):
    day = F.weekday("signal_date")
    rows = volatility_of(spark, sf_dir)
    tampered = rows.withColumns(
        {
            "annualized_volatility_pct": F.when(day == FRIDAY, F.col("annualized_volatility_pct") * 2.0).otherwise(
                F.col("annualized_volatility_pct")
            ),
            "window_eligible": F.when(day == MONDAY, F.lit(True)).otherwise(F.col("window_eligible")),
            "first_prospective_session": F.when(day == WEDNESDAY, F.col("signal_date")).otherwise(
                F.col("first_prospective_session")
            ),
        }
    )
    return flat(vf.volatility_contract(stored(tampered, "tampered"), tb.panel_calendar(sf_dir)))


@query
def verify_key_population(spark, sf_dir):
    prices = prices_of(spark, sf_dir)
    keys = tb.first_vintage(spark, sf_dir).select("ticker", F.col("date").alias("signal_date"))
    first, last = tb.panel_sessions(sf_dir)
    return vf.key_population(keys, prices, tb.panel_calendar(sf_dir), first, last)


@query
def verify_input_diagnostics(spark, sf_dir):
    sessions = tb.panel_sessions(sf_dir)
    published = sg.momentum(tb.first_vintage(spark, sf_dir), price_range=sessions, validated=True)
    recomputed = sg.momentum(prices_of(spark, sf_dir), price_range=sessions, validated=True)
    return flat(vf.input_diagnostics(stored(published, "published"), stored(recomputed, "again"), "momentum"))


@query
def verify_regeneration(spark, sf_dir):
    old, new = stored(tb.first_vintage(spark, sf_dir), "prices"), stored(prices_of(spark, sf_dir), "prices")
    (m1, v1), (m2, v2) = side_by_side(spark, *[partial(signals_of, spark, sf_dir, prices) for prices in (old, new)])
    return vf.regeneration({"momentum": m1, "volatility": v1}, {"momentum": m2, "volatility": v2})


@query
def verify_untouched(spark, sf_dir):
    """A tampered percentile in one month of a copy: only the rows of its digest nodes are compared."""
    m, v = signals_of(spark, sf_dir)
    odd = (F.col("ticker") == F.lit("DESK0000001")) & (F.date_format("signal_date", "yyyy-MM") == "2001-03")
    changed = m.withColumn("momentum_percentile", F.when(odd, F.lit(-1.0)).otherwise(F.col("momentum_percentile")))
    return vf.regeneration({"momentum": changed, "volatility": v}, {"momentum": m, "volatility": v})


@query
def verify_coverage_counts(spark, sf_dir):
    rows = coverage_of(spark, sf_dir)[0]
    tampered = rows.where("category <> 'NATION_1'").withColumn(
        "missing_canonical_count",
        F.when(F.col("missing_adjusted_close_count") > 0, F.col("missing_canonical_count") + 1).otherwise(
            F.col("missing_canonical_count")
        ),
    )
    target = target_of(sf_dir)
    calendar = cv.evaluation_calendar(target)
    days = calendar.index_until(target.target_session) - calendar.index_from(target.request_start) + 1
    return vf.coverage_counts(tampered, tb.desk_universe(spark, sf_dir), days)


@query
def verify_coverage_fields(spark, sf_dir):
    rows = stored(coverage_of(spark, sf_dir)[0], "coverage")
    tampered = rows.where("category <> 'NATION_1'").withColumns(
        {
            "price_staleness_sessions": F.coalesce(F.col("price_staleness_sessions"), F.lit(0).cast("bigint")),
            "momentum_target_status": F.when(F.col("target_price_row_present"), "tampered").otherwise(
                F.col("momentum_target_status")
            ),
        }
    )
    return flat(vf.field_differences(tampered, rows, ["ticker"]))


@query
def verify_dependence_contract(spark, sf_dir):
    rows = dp.dependence_by_ticker(pairs_of(spark, sf_dir), tb.desk_universe(spark, sf_dir))
    tampered = rows.withColumns(
        {
            "estimator": F.when(F.col("ticker") == "IDX001", "kendall").otherwise(F.col("estimator")),
            "status": F.when(F.col("ticker") == "IDX002", "available").otherwise(F.col("status")),
        }
    )
    target = target_of(sf_dir)
    calendar = cv.evaluation_calendar(target)
    days = calendar.index_until(target.target_session) - calendar.index_from(target.request_start) + 1
    return flat(vf.dependence_contract(tampered, tb.desk_universe(spark, sf_dir).count(), days))


def acquired(spark, sf_dir):
    """Desk prices whose even desks carry one retrieval time, and metadata that claims one for all."""
    start, end = tb.request_bounds(sf_dir)
    even = F.expr("substring(ticker, 5)").cast("bigint") % 2 == 0
    prices = prices_of(spark, sf_dir).withColumn(
        "retrieved_at", F.when(even, F.lit(FIXED_INSTANT)).otherwise(F.col("retrieved_at"))
    )
    statuses = tb.claims(prices, start, end)
    metadata = pb.ticker_metadata(tb.desk_universe(spark, sf_dir), prices, statuses)
    return prices, metadata.withColumn(
        "acquisition_status", F.coalesce("acquisition_status", F.lit("not_requested"))
    )


@query
def verify_provenance(spark, sf_dir):
    prices, metadata = acquired(spark, sf_dir)
    return vf.provenance(metadata, prices)


@query
def verify_ticker_metadata(spark, sf_dir):
    start, end = tb.request_bounds(sf_dir)
    return vf.metadata_contract(acquired(spark, sf_dir)[1], "refresh", start, end + timedelta(days=1))


# ---------------------------------------------------------------- reports


@query
def overview_momentum(spark, sf_dir):
    return flat(rp.overview(coverage_of(spark, sf_dir)[0], "momentum"), rounded=("raw", "display_pct"))


@query
def overview_volatility(spark, sf_dir):
    return flat(rp.overview(coverage_of(spark, sf_dir)[0], "volatility"), rounded=("raw", "display_pct"))


@query
def current_percentiles(spark, sf_dir):
    return flat(rp.current_percentiles(coverage_of(spark, sf_dir)[0]))


@query
def price_history_gaps(spark, sf_dir):
    first, last = tb.panel_sessions(sf_dir)
    prices = prices_of(spark, sf_dir)
    return flat(rp.price_history(prices, sp.missing_sessions(prices, tb.panel_calendar(sf_dir), first, last)))


@query
def staleness_table(spark, sf_dir):
    return flat(rp.staleness_table(coverage_of(spark, sf_dir)[0]))


@query
def observation_detail(spark, sf_dir):
    rows = cv.target_observation(momentum_of(spark, sf_dir), tb.desk_universe(spark, sf_dir), target_of(sf_dir))
    return rp.observation_detail(rows, MOMENTUM_COLUMNS)


@query
def observation_detail_volatility(spark, sf_dir):
    rows = cv.target_observation(volatility_of(spark, sf_dir), tb.desk_universe(spark, sf_dir), target_of(sf_dir))
    return rp.observation_detail(rows, VOLATILITY_COLUMNS)


def evaluation_of(spark, sf_dir):
    return Evaluation("offline", target_of(sf_dir), tb.desk_universe(spark, sf_dir), None, frames_of(spark, sf_dir))


@query
def run_metadata(spark, sf_dir):
    """What the manifest of a run over the panel says of the run as a whole."""
    target = target_of(sf_dir)
    evaluation = Evaluation("offline", target, tb.desk_universe(spark, sf_dir), None, {})
    head = pb.manifest_head(evaluation, target.captured_at)
    fields = [f for f in vf.MANIFEST_FIELDS if f not in ("context", "artifacts")]
    row = spark.createDataFrame([tuple(head[f] for f in fields)], ", ".join(f"{f} string" for f in fields))
    return rp.run_metadata(row)


@query
def verify_run(spark, sf_dir):
    """Publish an evaluation of the panel and re-verify it from its files; no rows mean it holds."""
    evaluation = evaluation_of(spark, sf_dir)
    folder = pb.publish(evaluation, new_folder(spark, "runs"), evaluation.target.captured_at)
    return jobs.verify_run(spark, folder, evaluation.target.request_start)[1]


@query
def verify_tampered_run(spark, sf_dir):
    """The same run with the target session's momentum percentiles, one session of volatility,
    the universe hash and a row count changed after publication."""
    evaluation = evaluation_of(spark, sf_dir)
    target = evaluation.target
    folder = pb.publish(evaluation, new_folder(spark, "runs"), target.captured_at)
    manifest, frames = pb.read_run(spark, folder)
    manifest["universe_sha256"] = "0" * 64
    manifest["artifacts"]["dependence"]["row_count"] += 1
    last = F.col("signal_date") == F.lit(target.target_session)
    percentile = F.col("momentum_percentile")
    frames["momentum"] = frames["momentum"].withColumn(
        "momentum_percentile", F.when(last, percentile + 200.0).otherwise(percentile)
    )
    frames["volatility"] = frames["volatility"].where(~last)
    return jobs.run_violations(spark, manifest, frames, manifest["run_id"], target.request_start)
