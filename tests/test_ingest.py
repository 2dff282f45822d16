import json
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.helpers import AT
from tickerloom.operators import batches as bt
from tickerloom.operators import vintages as vt
from tickerloom.plans.jobs import land_prices, land_shares
from tickerloom.schemas import ContractError
from tickerloom.sources import payloads as pl
from tickerloom.sources.universe import read_universe, universe_hash, universe_violations, validate_universe

STAMPS = [1704292200, 1704378600]  # 14:30 UTC on 2024-01-03 and 2024-01-04


def chart(symbol="AAA", stamps=STAMPS, zone="America/New_York", adjusted=True, **fields):
    quote = {
        "open": [10.0, 10],
        "high": [12.5, 12.5],
        "low": [9, 9],
        "close": [11.0, None],
        "volume": [100, 0],
    }
    quote.update(fields)
    indicators = {"quote": [quote]}
    if adjusted:
        indicators["adjclose"] = [{"adjclose": [10.5, 10.75]}]
    result = {"meta": {"symbol": symbol, "exchangeTimezoneName": zone}, "timestamp": stamps, "indicators": indicators}
    return {"chart": {"result": [result], "error": None}}


def landed(spark, **payloads):
    rows = [(t, p if isinstance(p, str) else json.dumps(p), AT) for t, p in payloads.items()]
    return spark.createDataFrame(rows, "ticker string, payload string, retrieved_at timestamp")


def issue(spark, payload, ticker="AAA"):
    return pl.chart_payloads(landed(spark, **{ticker: payload})).first()["issue"]


def nested(payload, path, value):
    copy = json.loads(json.dumps(payload))
    node = copy
    for step in path[:-1]:
        node = node[step]
    if value is KeyError:
        del node[path[-1]]
    else:
        node[path[-1]] = value
    return copy


R = ["chart", "result", 0]


@pytest.mark.parametrize(
    "payload, text",
    [
        (chart(), None),
        (chart(adjusted=False), None),
        (chart(stamps=[]), None),
        (chart(stamps=None), None),
        ("not json", "payload is not an object"),
        ("[1]", "payload is not an object"),
        ({}, "chart object is missing"),
        (nested(chart(), ["chart", "error"], {"code": "x"}), "provider reported an error"),
        (nested(chart(), ["chart", "result"], None), "result list is missing"),
        (nested(chart(), ["chart", "result"], []), "result list is empty"),
        (nested(chart(), ["chart", "result"], [chart()["chart"]["result"][0]] * 2), "result must hold one object"),
        (nested(chart(), [*R, "meta"], KeyError), "meta object is missing"),
        (chart(symbol=" AAA"), "symbol is missing or padded"),
        (chart(symbol="BBB"), "symbol differs from the requested ticker"),
        (chart(zone=None), "exchange timezone is missing"),
        (nested(chart(), [*R, "indicators", "quote"], []), "quote indicator is missing"),
        (chart(stamps=[STAMPS[0], None]), "timestamps are not whole epochs"),
        (chart(stamps=[STAMPS[0], True]), "timestamps are not whole epochs"),
        (chart(stamps=[1.5, 2.5]), "timestamps are not whole epochs"),
        (chart(volume=[1]), "field volume is malformed"),
        (chart(volume=[2**53 + 1, 1]), "volume does not fit a double exactly"),
        (chart(volume=[2**60, 1e300]), None),
        (chart(open=None), "field open is malformed"),
        (chart(high=["12", 12]), "field high is malformed"),
        (chart(high=[True, 12]), "field high is malformed"),
        (nested(chart(), [*R, "indicators", "adjclose"], []), "adjusted close is malformed"),
        (nested(chart(), [*R, "indicators", "adjclose", 0, "adjclose"], [1.0]), "adjusted close is malformed"),
        (nested(chart(), [*R, "indicators", "adjclose", 0, "adjclose"], [1.0, "x"]), "adjusted close is malformed"),
    ],
)
def test_chart_issues(spark, payload, text):
    assert issue(spark, payload) == text


def test_chart_rows_keep_nulls_and_exact_values(spark):
    rows = pl.chart_rows(pl.chart_payloads(landed(spark, AAA=chart()))).orderBy("date").collect()
    assert [r["date"] for r in rows] == [date(2024, 1, 3), date(2024, 1, 4)]
    assert rows[1]["close"] is None and rows[1]["volume"] == 0.0 and rows[1]["adjusted_close"] == 10.75
    bare = pl.chart_rows(pl.chart_payloads(landed(spark, AAA=chart(adjusted=False)))).collect()
    assert len(bare) == 2 and all(r["adjusted_close"] is None for r in bare)


def test_lowercase_request_matches_uppercase_symbol(spark):
    assert issue(spark, chart(), "aaa") is None


def test_market_date_rules(spark):
    df = spark.createDataFrame(
        [(1704340800, "America/New_York"), (1704292200, "Asia/Tokyo"), (1704297600, "Asia/Tokyo")],
        "stamp bigint, zone string",
    )
    found = [r[0] for r in df.select(pl.market_date(F.col("stamp"), F.col("zone"))).collect()]
    # 23:00 sharp belongs to the next day, 23:30 does not.
    assert found == [date(2024, 1, 4), date(2024, 1, 3), date(2024, 1, 4)]


def test_batch_outcomes_are_independent(spark):
    payloads = landed(
        spark,
        GOOD=chart("GOOD"),
        NONE=chart("NONE", stamps=[]),
        WRONG=chart("OTHER"),
        NEGATIVE=chart("NEGATIVE", open=[-1, 1]),
        OUTSIDE=chart("OUTSIDE", stamps=[STAMPS[0], STAMPS[0] + 86400 * 400]),
        CONFLICT=chart("CONFLICT", stamps=[STAMPS[0], STAMPS[0]]),
    )
    requests = payloads.select("ticker").unionByName(spark.createDataFrame([("SILENT",)], "ticker string"))
    rows, statuses = land_prices(payloads, requests, date(2024, 1, 1), date(2024, 2, 1))
    by = {r["ticker"]: r for r in statuses.collect()}
    assert {r["ticker"] for r in rows.collect()} == {"GOOD"}
    assert by["GOOD"]["status"] == "success" and by["GOOD"]["returned_dates"] == [date(2024, 1, 3), date(2024, 1, 4)]
    assert by["NONE"]["status"] == "empty" and by["NONE"]["retrieved_at"] is not None
    assert by["WRONG"]["error"] == "PriceNormalizationError: symbol differs from the requested ticker"
    assert by["NEGATIVE"]["error"] == "PriceDataValidationError: nonpositive_open"
    assert by["OUTSIDE"]["error"] == "PriceDataValidationError: outside_request_window"
    assert by["CONFLICT"]["error"] == "PriceDataValidationError: conflicting_duplicates"
    assert by["SILENT"]["status"] == "empty" and by["SILENT"]["retrieved_at"] is not None
    assert bt.status_violations(statuses, rows, requests, date(2024, 1, 1), date(2024, 2, 1)).isEmpty()
    assert bt.batch_retrieved_at(statuses).first()["retrieved_at"] == AT.replace(tzinfo=None)


def test_status_violations(spark):
    payloads = landed(spark, GOOD=chart("GOOD"))
    rows, statuses = land_prices(payloads, payloads.select("ticker"), date(2024, 1, 1), date(2024, 2, 1))

    def rules(changed, incoming=rows, **bounds):
        return {r["rule"] for r in bt.status_violations(changed, incoming, **bounds).collect()}

    assert rules(statuses, rows.where("date > '2024-01-03'")) == {"claimed_row_absent"}
    assert rules(statuses.withColumn("rows_received", F.lit(9).cast("bigint"))) == {"inconsistent_success"}
    assert rules(statuses.withColumn("retrieved_at", F.col("retrieved_at") + F.expr("INTERVAL 1 HOUR"))) == {"retrieval_time_differs"}
    assert rules(statuses.withColumn("query_end", F.lit(date(2024, 1, 4)))) == {"dates_outside_window"}
    assert rules(statuses.withColumn("status", F.lit("odd"))) == {"unknown_status", "unclaimed_row"}
    assert "inconsistent_failed" in rules(statuses.withColumn("status", F.lit("failed")))
    assert rules(statuses.unionByName(statuses)) >= {"duplicate_ticker"}
    assert rules(statuses, start=date(2024, 1, 2), end=date(2024, 2, 1)) == {"unexpected_query_start"}
    extra = spark.createDataFrame([("GOOD",), ("MORE",)], "ticker string")
    assert rules(statuses, expected=extra) == {"status_missing"}


def test_claimed_dates_are_never_broadcast(spark):
    """A list is taken for one date when sizes are estimated, so its dates must not be sent to every task."""
    day, later_day = date(2024, 1, 2), date(2024, 1, 3)
    prices = spark.createDataFrame([("A", day, 1.0), ("A", later_day, 2.0), ("B", day, 3.0)], "ticker string, date date, close double")
    statuses = spark.createDataFrame(
        [("A", "success", [day], day, date(2024, 2, 1)), ("B", "failed", [], day, later_day)],
        "ticker string, status string, returned_dates array<date>, query_start date, query_end date",
    )
    for found, wanted in ((bt.acquisition_view(prices, statuses), [1.0]), (vt.vanished_rows(prices.select("ticker", "date"), statuses), [later_day])):
        assert [r[-1] for r in found.collect()] == wanted
        assert "SortMergeJoin [ticker" in found._jdf.queryExecution().executedPlan().toString()


def shares(symbol="AAA", stamps=STAMPS, values=(5, None), **more):
    result = {"meta": {"symbol": [symbol]}, "timestamp": list(stamps)}
    if values is not None:
        result["shares_out"] = list(values)
    return {"timeseries": {"result": [result]}, **more}


@pytest.mark.parametrize(
    "payload, text",
    [
        (shares(), None),
        (shares(values=None), None),
        (shares(values=[2**53 + 1, 2**63 + 1]), None),
        (shares(values=[2**64 - 1, 1.0]), None),
        (shares(values=[10**30, 1]), "a share count cannot be held exactly"),
        (shares(values=[1]), "list lengths differ"),
        (shares(values=["1", 2]), "share counts are not numbers"),
        (shares(stamps=[None, 1]), "timestamps are not finite numbers"),
        (shares(symbol="BBB"), "symbol differs from the requested ticker"),
        (shares(finance={"error": "down"}), "provider reported an error"),
        ({"timeseries": {"result": []}}, "result list is empty"),
        ({"timeseries": {"result": [{"meta": {"symbol": ["A", "B"]}}]}}, "one symbol is required"),
    ],
)
def test_share_issues(spark, payload, text):
    assert pl.share_payloads(landed(spark, AAA=payload)).first()["issue"] == text


def test_share_dates_are_utc_dates(spark):
    late = 1704326400 + 86399  # 23:59:59 UTC on 2024-01-04
    payloads = landed(spark, AAA=shares(stamps=[late, late + 86400]))
    rows, statuses = land_shares(payloads, payloads.select("ticker"))
    got = sorted((r["date"], r["shares_outstanding"]) for r in rows.collect())
    assert got == [(date(2024, 1, 4), 5.0), (date(2024, 1, 5), None)]
    assert statuses.first()["status"] == "success"


def test_flat_and_wide_tables(spark):
    flat = spark.createDataFrame(
        [(date(2024, 1, 3), 1.0, 2.0, 0.5, 1.5, 10, "x")], "date date, Open double, HIGH double, `low ` double, close double, VOLUME bigint, note string"
    )
    row = pl.normalize_flat(flat, "AAA", F.lit(AT)).first()
    assert row["adjusted_close"] is None and row["volume"] == 10.0 and row["ticker"] == "AAA"
    with pytest.raises(ContractError):
        pl.normalize_flat(flat.drop("Open"), "AAA", F.lit(AT))
    with pytest.raises(ContractError):
        pl.normalize_flat(flat.withColumn("Adj Close", F.lit(1.0)).withColumn("adj_close", F.lit(1.0)), "AAA", F.lit(AT))

    fields = ["Open", "High", "Low", "Close", "Adj Close", "Volume"]
    for label in ("{f}|{t}", "{t}|{f}"):
        columns = [F.lit(float(i)).alias(label.format(f=f, t=t)) for t in ("AAA", "BBB") for i, f in enumerate(fields, 1)]
        wide = spark.createDataFrame([(date(2024, 1, 3),)], "date date").select("date", *columns)
        rows = pl.unpivot_wide(wide, ["aaa", "CCC"], F.lit(AT)).collect()
        assert [(r["ticker"], r["open"], r["adjusted_close"]) for r in rows] == [("aaa", 1.0, 5.0)]
    plan = pl.unpivot_wide(wide, ["aaa", "BBB"], F.lit(AT))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_share_query_windows(spark):
    df = spark.createDataFrame(
        [
            ("A", "America/New_York", None, None, datetime(2024, 1, 4, 3, tzinfo=timezone.utc)),
            ("B", "Asia/Tokyo", date(2024, 1, 1), date(2024, 1, 3), AT),
            ("C", "UTC", None, date(2024, 1, 3), AT),
        ],
        "ticker string, zone string, start date, end date, instant timestamp",
    )
    rows = {r["ticker"]: (r["query_start"], r["query_end"], r["reversed"]) for r in bt.share_query_windows(df).collect()}
    assert rows["A"] == (date(2022, 7, 4), date(2024, 1, 4), False)
    assert rows["B"] == (date(2024, 1, 1), date(2024, 1, 3), False)
    assert rows["C"] == (date(2022, 7, 4), date(2024, 1, 3), False)


def test_requests_and_universe(spark, tmp_path):
    asked = spark.createDataFrame([(" a ",), ("A",), ("",), ("b",)], "ticker string")
    problems = {r["ticker"]: r["problem"] for r in bt.requested_tickers(asked).collect()}
    assert problems == {"A": "duplicate_ticker", "": "blank_ticker", "b": None}

    path = tmp_path / "universe.json"
    entries = [{"ticker": t, "name": f"Fund {t}", "category": "Broad"} for t in ("ZZZ", "AAA")]
    path.write_text(json.dumps({"etfs": entries}, indent=1))
    universe = read_universe(spark, str(path))
    assert [(r["ord"], r["ticker"]) for r in universe.orderBy("ord").collect()] == [(1, "ZZZ"), (2, "AAA")]
    validate_universe(universe)
    reordered = universe.withColumn("ord", -F.col("ord"))
    assert universe_hash(universe).first()[0] != universe_hash(reordered).first()[0]
    twice = universe.unionByName(universe.withColumn("ticker", F.lower("ticker")).withColumn("name", F.lit(" ")))
    found = {r["rule"] for r in universe_violations(twice).collect()}
    assert found == {"blank_name", "duplicate_ticker"}
    with pytest.raises(ContractError):
        validate_universe(twice)


def test_labels(spark):
    from tickerloom.functions import labels as lb

    df = spark.createDataFrame([(" Adj_Close ",), ("HIGH",), ("adj   close",), ("Dividends",)], "x string")
    assert [r[0] for r in df.select(lb.canonical_field(F.col("x"))).collect()] == ["adjusted_close", "high", "adjusted_close", None]
    text = df.select(lb.failure_text(F.lit("Kind"), F.lit(" why ")), lb.failure_text(F.lit("Kind"), F.lit(" "))).first()
    assert tuple(text) == ("Kind: why", "Kind")


def test_inexact_provider_values(spark):
    table = spark.createDataFrame([(2**53 + 1, 1.5), (5, 2.5)], "Volume bigint, Open double")
    assert [r["Volume"] for r in pl.inexact_prices(table, ["Volume", "Open"]).collect()] == [2**53 + 1]
