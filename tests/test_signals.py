import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import CALENDAR, bar, midrank, panel, sessions, wave
from tickerloom.functions import numeric as nm
from tickerloom.operators.signals import momentum, volatility
from tickerloom.operators.spine import off_calendar
from tickerloom.schemas import MOMENTUM_COLUMNS, VOLATILITY_COLUMNS, ContractError


def rows_of(df):
    return {(r["ticker"], r["signal_date"]): r for r in df.collect()}


def test_columns_and_population(spark):
    prices = panel(spark, {"A": wave(30), "B": ["absent"] * 10 + wave(20)})
    m, v = momentum(prices), volatility(prices)
    assert tuple(m.columns) == MOMENTUM_COLUMNS and tuple(v.columns) == VOLATILITY_COLUMNS
    days = sessions(30)
    for frame in (m, v):
        assert set(rows_of(frame)) == {(t, d) for t in "AB" for d in days}
    assert not any("score" in c or "composite" in c for c in m.columns + v.columns)


def test_momentum_uses_exactly_252_sessions_and_counts_prehistory(spark):
    values = wave(260)
    found = rows_of(momentum(panel(spark, {"A": values})))
    days = sessions(260)
    first = found["A", days[0]]
    assert first["endpoint_status"] == "missing_start_row" and not first["endpoint_eligible"]
    assert first["interior_missing_row_count"] == 251 and len(first["interior_missing_row_dates"]) == 251
    start = CALENDAR.index_from(days[0]) - 252
    assert first["endpoint_start_date"] == CALENDAR.sessions[start]
    assert found["A", days[251]]["raw_momentum"] is None
    row = found["A", days[252]]
    assert row["raw_momentum"] == pytest.approx(math.log(values[252] / values[0]), rel=1e-12)
    assert row["interior_missing_row_count"] == 0 and row["endpoint_start_date"] == days[0]
    assert row["first_prospective_session"] == days[253]


def test_percentile_against_brute_force(spark):
    random.seed(4)
    count = 1300
    values = [round(100 + random.random() * 3, 1) for _ in range(count)]
    holes = set(random.sample(range(1, count - 1), 25))
    nulls = set(random.sample(sorted(set(range(count)) - holes), 25))
    series = ["absent" if i in holes else None if i in nulls else values[i] for i in range(count)]
    found = rows_of(momentum(panel(spark, {"A": series})))
    days = sessions(count)
    held = [None if isinstance(x, str) else x for x in series]
    raw = [
        None
        if i < 252 or held[i] is None or held[i - 252] is None
        else found["A", days[i]]["raw_momentum"]
        for i in range(count)
    ]
    for i in range(count):
        row = found["A", days[i]]
        if raw[i] is not None:
            assert raw[i] == pytest.approx(math.log(held[i] / held[i - 252]), rel=1e-12, abs=1e-15)
        references, percentile = midrank(raw, i)
        assert row["normalization_reference_count"] == references
        assert row["momentum_percentile"] == percentile


def test_reference_boundaries():
    values = np.arange(1200, dtype=float)
    references, doubled = nm.sliding_counts(values)
    assert references[755] == 755 and references[756] == 755 and references[251] == 251
    assert doubled[800] == 2 * 755
    references, doubled = nm.sliding_counts(np.full(300, 5.0))
    assert doubled[299] == 299 and references[299] == 299
    references, doubled = nm.sliding_counts(np.array([1.0, np.nan, 1.0, 0.5]))
    assert list(references) == [0, 1, 1, 2] and list(doubled) == [0, 0, 1, 0]


def test_earliest_percentiles(spark):
    count = 520
    prices = panel(spark, {"A": wave(count)})
    days = sessions(count)
    m, v = rows_of(momentum(prices)), rows_of(volatility(prices))
    assert m["A", days[503]]["momentum_percentile"] is None and m["A", days[504]]["momentum_percentile"] is not None
    assert v["A", days[20]]["raw_annualized_volatility"] is None
    assert v["A", days[21]]["raw_annualized_volatility"] is not None
    assert v["A", days[272]]["volatility_percentile"] is None and v["A", days[273]]["volatility_percentile"] is not None


def test_volatility_value_and_missing_window(spark):
    values = wave(80)
    series = list(values)
    series[40], series[60] = "absent", None
    days = sessions(80)
    found = rows_of(volatility(panel(spark, {"A": series, "B": values})))
    returns = np.diff(np.log(values))
    for i in range(21, 80):
        expected = np.std(returns[i - 21 : i], ddof=1) * math.sqrt(252)
        row = found["B", days[i]]
        assert row["raw_annualized_volatility"] == pytest.approx(expected, rel=1e-10)
        assert row["annualized_volatility_pct"] == 100.0 * row["raw_annualized_volatility"]
    gap = found["A", days[61]]
    assert gap["window_status"] == "missing_price_rows|missing_adjusted_close"
    assert gap["missing_row_dates"] == [days[40]] and gap["missing_adjusted_close_dates"] == [days[60]]
    assert found["A", days[39]]["window_eligible"] and not found["A", days[40]]["window_eligible"]
    assert found["A", days[62]]["window_status"] == "missing_adjusted_close"


def test_constant_prices_are_exactly_zero_and_rank_fifty(spark):
    days = sessions(300)
    found = rows_of(volatility(panel(spark, {"A": [7.25] * 300})))
    assert found["A", days[299]]["raw_annualized_volatility"] == 0.0
    assert found["A", days[299]]["volatility_percentile"] == 50.0


def test_endpoint_states(spark):
    series = wave(300)
    series[0], series[1], series[260], series[261] = "absent", None, "absent", None
    series[8], series[9] = "absent", None
    days = sessions(300)
    other = wave(300)
    found = rows_of(momentum(panel(spark, {"A": series, "Z": other})))
    assert found["A", days[252]]["endpoint_status"] == "missing_start_row"
    assert found["A", days[253]]["endpoint_status"] == "missing_start_adjusted_close"
    assert found["A", days[260]]["endpoint_status"] == "missing_start_row|missing_end_row"
    assert found["A", days[261]]["endpoint_status"] == "missing_start_adjusted_close|missing_end_adjusted_close"
    shown = found["A", days[252]]
    assert shown["end_adjusted_close"] == series[252] and shown["raw_momentum"] is None
    assert shown["simple_return_status"] == "endpoint_ineligible"
    inside = found["A", days[270]]
    assert inside["endpoint_eligible"]
    assert inside["interior_missing_row_dates"] == [days[260]]
    assert inside["interior_missing_adjusted_close_dates"] == [days[261]]


def test_bounds_trim_rows_but_not_history(spark):
    days = sessions(1400)
    prices = panel(spark, {"A": wave(1400), "OLD": wave(100)})
    whole, part = rows_of(momentum(prices)), rows_of(momentum(prices, days[1300], days[1350]))
    assert set(part) == {(t, d) for t in ("A", "OLD") for d in days[1300:1351]}
    for key, row in part.items():
        assert row == whole[key]
    v_whole, v_part = rows_of(volatility(prices)), rows_of(volatility(prices, days[1300], days[1350]))
    for key, row in v_part.items():
        assert row == v_whole[key]


def test_invalid_bounds(spark):
    prices = panel(spark, {"A": wave(40)})
    days = sessions(40)
    for start, end in [(date(2017, 1, 3), None), (None, date(2017, 1, 3)), (days[20], days[10])]:
        with pytest.raises(ContractError):
            momentum(prices, start, end)
    with pytest.raises(ContractError):
        momentum(prices.limit(0), days[20], days[10])
    with pytest.raises(ContractError):
        momentum(prices, date(2018, 1, 6), date(2018, 1, 7))
    assert momentum(prices.limit(0)).count() == 0 and tuple(volatility(prices.limit(0)).columns) == VOLATILITY_COLUMNS


def test_off_calendar_rows_are_reported(spark):
    prices = panel(spark, {"A": [1.0, 2.0]}, [date(2018, 1, 5), date(2018, 1, 6)])
    assert [r["date"] for r in off_calendar(prices, CALENDAR).collect()] == [date(2018, 1, 6)]


@pytest.mark.parametrize(
    "start, end",
    [(100.0, 100.0 + 1e-12), (100.0, 50.0), (100.0, 200.0), (1.0, 1e300), (1e300, 1e-300), (3.0, 2.9999999999)],
)
def test_log_return_is_stable(spark, start, end):
    row = spark.createDataFrame([(start, end)], "s double, e double").select(
        nm.log_return(F.col("s"), F.col("e")).alias("r")
    )
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    exact = float((Decimal(end) / Decimal(start)).ln())
    assert row.first()["r"] == pytest.approx(exact, rel=1e-13)


def test_simple_return_range(spark):
    df = spark.createDataFrame([(1e-300, 1e300), (100.0, 110.0), (1e300, 1e-300)], "s double, e double")
    df = df.withColumn("raw", nm.log_return(F.col("s"), F.col("e")))
    found = nm.with_simple_return(df, "s", "e", "raw", "p")
    rows = found.select("p", nm.simple_return_status(F.lit(True), F.col("p")).alias("status")).collect()
    assert rows[0]["p"] is None and rows[0]["status"] == "exceeds_float64_range"
    assert rows[1]["p"] == pytest.approx(10.0) and rows[1]["status"] == "available"
    assert rows[2]["p"] == -100.0


def test_one_exchange_per_signal(spark):
    prices = panel(spark, {"A": wave(40)})
    plan = momentum(prices, price_range=(sessions(1)[0], sessions(40)[-1]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hot_ticker_with_copies_is_bounded_by_the_calendar(spark):
    from tickerloom.operators.vintages import deduplicate
    from tickerloom.schemas import PRICE_VALUES

    days = sessions(60)
    rows = [bar(d, "HOT", 5.0 + i) for i, d in enumerate(days)] * 40 + [bar(d, "T%d" % t, 1.0 + t) for t in range(3) for d in days]
    raw = spark.createDataFrame(rows, panel(spark, {"A": [1.0]}).schema)
    assert volatility(deduplicate(raw, PRICE_VALUES)).count() == 4 * 60


@pytest.mark.parametrize("signal", [momentum, volatility])
def test_signals_refuse_invalid_rows(spark, signal):
    days = sessions(30)
    good = [("A", d, 10.0 + i) for i, d in enumerate(days)]
    saturday = date(2024, 1, 6)
    assert saturday.weekday() == 5
    for extra, rule in (
        (("A", days[3], 99.0), "duplicate_key"),
        (("A", saturday, 2.0), "off_calendar"),
        (("A", days[3], float("nan")), "nonfinite_adjusted_close"),
        (("B", days[3], -1.0), "nonpositive_adjusted_close"),
        ((" ", days[3], 1.0), "blank_ticker"),
    ):
        frame = spark.createDataFrame([*good, extra], "ticker string, date date, adjusted_close double")
        with pytest.raises(ContractError, match=rule):
            signal(frame, price_range=(days[0], max(days[-1], extra[1])))
    frame = spark.createDataFrame([*good, ("B", days[0], None)], "ticker string, date date, adjusted_close double")
    assert signal(frame).count() == 60


def test_sorted_window_by_brute_force():
    r = np.random.default_rng(3)
    for size, span in ((0, 5), (1, 5), (400, 1), (400, 37), (1200, 755)):
        values = np.round(r.random(size), 2)
        values[r.random(size) < 0.2] = np.nan
        references, doubled = nm.sliding_counts(values, span)
        for i in range(size):
            window = values[max(0, i - span) : i]
            assert references[i] == np.count_nonzero(~np.isnan(window))
            if not np.isnan(values[i]):
                assert doubled[i] == np.sum(window < values[i]) + np.sum(window <= values[i])
