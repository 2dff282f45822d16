"""Flow proxy and concentration against plain readings of their rules."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from tickerloom.operators import concentration as cn
from tickerloom.operators import flow as fl
from tickerloom.schemas import FLOW_COLUMNS, SPLIT_FACTORS

DAY = date(2019, 12, 2)


def plain_flow(shares, prices):
    """Rows by ticker and end date from lists of (ticker, day, value)."""
    out = {}
    factors = [*SPLIT_FACTORS, *(1 / f for f in SPLIT_FACTORS)]
    for ticker in {t for t, _, _ in shares}:
        line = sorted((d, v) for t, d, v in shares if t == ticker)
        quotes = sorted((d, v) for t, d, v in prices if t == ticker)
        days = [d for d, _ in quotes]

        def close_at(day):
            valid = [(d, v) for d, v in quotes if d <= day and v is not None and math.isfinite(v) and v > 0]
            return valid[-1][1] if valid and (day - valid[-1][0]).days <= 4 else None

        eligible = []
        for (d0, s0), (d1, s1) in zip(line, line[1:]):
            if s0 is None or s1 is None:
                continue
            n = sum(d0 < d <= d1 for d in days)
            ratio = s1 / s0
            match = [f for f in factors if abs(math.log(ratio / f)) <= math.log(1.05) + 1e-12]
            large = ratio >= 1.5 or ratio <= 2 / 3
            status = "suspected_corporate_action" if match or large else "no_price_date" if n < 1 else "too_many_price_dates" if n > 5 else "eligible"
            after = [k for k, d in enumerate(days) if d > d1]
            rate = math.log1p((s1 - s0) / s0) / n if status == "eligible" else None
            refs = percentile = None
            if rate is not None and after:
                place = after[0]
                # Rates are equal if their ratios and numbers of price dates are.
                own = (Fraction(s1, s0), n if s0 != s1 else 0)
                known = [(r, e) for p, r, e in eligible if p >= place - 755]
                refs = len(known)
                if refs >= 252:
                    equal = sum(e == own for _, e in known)
                    below = sum(r < rate and e != own for r, e in known)
                    percentile = 100 * (below + equal / 2) / refs
                eligible.append((place, rate, own))
            out[ticker, d1] = (d0, n, days[after[0]] if after else None, status, rate, refs, percentile, close_at(d1), match[0] if match else None)
    return out


def frames(spark, shares, prices):
    at = datetime(2024, 1, 1)
    counted = spark.createDataFrame(
        [(d, t, None if v is None else Decimal(v), at) for t, d, v in shares], "date date, ticker string, shares_outstanding decimal(20,0), retrieved_at timestamp"
    )
    priced = spark.createDataFrame([(d, t, v) for t, d, v in prices], "date date, ticker string, close double")
    return counted, priced


@pytest.fixture(scope="module")
def panel():
    r = random.Random(4)
    shares, prices = [], []
    for ticker, length in (("LONG", 1500), ("SHORT", 40), ("UNPRICED", 10)):
        level = 100_000
        for k in range(length):
            day = DAY + timedelta(days=k)
            if day.weekday() < 5 and ticker != "UNPRICED" and r.random() < 0.97:
                prices.append((ticker, day, r.choice([10.0, 20.0, None, float("nan"), -1.0]) if r.random() < 0.1 else 10.0))
            if r.random() < 0.8:
                level = max(1, level + r.choice([0, 0, 10, -10, 250, -200, 3]))
                if r.random() < 0.01:
                    level = level * r.choice([2, 3, 10])
                shares.append((ticker, day, None if r.random() < 0.05 else level))
    return shares, prices


def test_flow_by_brute_force(spark, panel):
    shares, prices = panel
    found = fl.flow_proxy(*frames(spark, shares, prices))
    assert tuple(found.columns) == FLOW_COLUMNS
    rows = {(r["ticker"], r["end_date"]): r for r in found.collect()}
    want = plain_flow(shares, prices)
    assert rows.keys() == want.keys()
    ranked = 0
    for key, (start, n, signal, status, rate, refs, percentile, close, factor) in want.items():
        r = rows[key]
        assert (r["start_date"], r["price_dates"], r["signal_date"], r["status"], r["reference_count"], r["end_close"]) == (start, n, signal, status, refs, close)
        assert (r["raw_flow_rate"] is None) == (rate is None) and (rate is None or math.isclose(r["raw_flow_rate"], rate, rel_tol=1e-9, abs_tol=1e-15))
        assert (r["matched_factor"] is None) == (factor is None) and (factor is None or math.isclose(r["matched_factor"], factor))
        assert r["flow_percentile"] == pytest.approx(percentile)
        ranked += percentile is not None
    assert ranked > 300


def test_chain_rules_and_price_evidence(spark):
    day = lambda k: DAY + timedelta(days=k)  # noqa: E731  Monday onwards
    shares = [("A", day(0), 100), ("A", day(1), 100), ("A", day(2), None), ("A", day(3), 110), ("A", day(4), 220), ("A", day(30), 230)]
    prices = [("A", day(k), c) for k, c in ((0, 10.0), (1, 10.0), (3, 10.0), (4, 5.0), (31, 5.0))]
    rows = {r["end_date"]: r for r in fl.flow_proxy(*frames(spark, shares, prices)).collect()}
    # The null on the third day breaks the chain, and nothing bridges it.
    assert set(rows) == {day(1), day(4), day(30)}
    assert rows[day(1)]["raw_flow_rate"] == 0.0 and rows[day(1)]["delta_shares"] == 0 and rows[day(1)]["signal_date"] == day(3)
    split = rows[day(4)]
    assert (split["quarantine_reason"], split["matched_factor"], split["price_evidence"]) == ("common_factor|large_ratio", 2.0, "price_confirmed")
    assert split["raw_flow_rate"] is None
    # The last close before day 30 is older than four days.
    assert rows[day(30)]["end_close"] is None and rows[day(30)]["status"] == "no_price_date"


def test_counts_beyond_doubles_keep_their_difference(spark):
    big = 2**63 + 1
    shares = [("B", DAY, big), ("B", DAY + timedelta(days=1), big + 2)]
    row = fl.flow_proxy(*frames(spark, shares, [("B", DAY, 1.0), ("B", DAY + timedelta(days=1), 1.0)])).first()
    assert (int(row["start_shares"]), int(row["delta_shares"])) == (big, 2)


def test_flow_of_nothing_and_no_range_join(spark, panel):
    counted, priced = frames(spark, *panel)
    assert fl.flow_proxy(counted.where("false"), priced).isEmpty()
    assert fl.flow_proxy(counted, priced.where("false")).where("status = 'eligible'").isEmpty()
    plan = fl.flow_proxy(counted, priced)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "hashpartitioning(ticker" in plan and "block" in plan


def test_concentration_by_hand(spark):
    holdings = [("F", s, True, w) for s, w in enumerate([50, 30, 10, 10])] + [("F", 1, False, 99), ("F", 9, True, 7)]
    holdings += [("G", 0, True, 5), ("H", 0, False, 5), ("I", 2, True, -3), ("I", 3, True, 4)]
    held = spark.createDataFrame(holdings, "fund string, security long, direct_long boolean, weight long")
    entities = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, "z"), (9, None)], "security long, entity string")
    rows = {r["fund"]: r for r in cn.concentration(held, entities).collect()}
    f = rows["F"]
    assert (f["entities"], f["eligible_weight"], f["unmapped_weight"], f["excluded_weight"]) == (3, 100, 7, 99)
    assert f["raw_hhi"] == pytest.approx(0.6**2 + 0.3**2 + 0.1**2) and f["top_10_weight_pct"] == pytest.approx(100.0)
    assert rows["G"]["effective_holdings"] == pytest.approx(1.0)
    assert rows["H"]["raw_hhi"] is None and rows["H"]["entities"] == 0
    assert rows["I"]["entities"] == 1 and rows["I"]["raw_hhi"] == pytest.approx(1.0)


def test_concentration_of_a_hot_fund(spark):
    r = random.Random(2)
    weights = {(f, s): r.randrange(1, 10**13) for f in ("HOT", "B") for s in range(20_000 if f == "HOT" else 30)}
    held = spark.createDataFrame([(f, s, True, w) for (f, s), w in weights.items()], "fund string, security long, direct_long boolean, weight long")
    entities = spark.range(20_000).selectExpr("id AS security", "concat('e', id) AS entity")
    found = cn.concentration(held.repartition(16), entities)
    rows = {r["fund"]: r for r in found.collect()}
    for fund in ("HOT", "B"):
        own = sorted((w for (f, _), w in weights.items() if f == fund), reverse=True)
        assert rows[fund]["raw_hhi"] == pytest.approx(sum(w * w for w in own) / sum(own) ** 2, rel=1e-12)
        assert rows[fund]["top_10_weight_pct"] == pytest.approx(100 * sum(own[:10]) / sum(own), rel=1e-12)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_largest_of_every_fund():
    funds, weights = np.array([1, 0, 1, 1, 2]), np.array([5, 9, 7, 6, 1])
    assert sorted(cn.largest_of(funds, weights, 2).tolist()) == [1, 2, 3, 4]
