"""Refreshed signals against a full computation of the revised panel."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import AT, bar, later, sessions
from tickerloom.operators import incremental as ic
from tickerloom.operators.signals import stored_signals
from tickerloom.operators.spine import signal_bounds
from tickerloom.operators.vintages import frame_difference
from tickerloom.plans import jobs
from tickerloom.session import new_folder
from tickerloom.sources import files
from tickerloom.streaming.updates import signal_refresher, stream_updates

DAYS = sessions(1500)


def rows(ticker, days, seed, gaps=0.03):
    r = random.Random(seed)
    return {(ticker, d): 10 + r.random() for d in days if r.random() >= gaps}


def frame(spark, held, store, hours=0):
    bars = [bar(d, t, value, later(hours)) for (t, d), value in sorted(held.items())]
    return spark.createDataFrame(bars, store.schema)


def signals(spark, prices):
    return stored_signals(prices, signal_bounds(prices), new_folder(spark, "signals"))


@pytest.fixture
def store(spark, tmp_path):
    return jobs.price_store(spark, str(tmp_path / "prices"))


def test_refresh_equals_a_full_computation(spark, store):
    old = rows("A", DAYS[:1480], 1) | rows("B", DAYS[:1480], 2) | rows("GONE", DAYS[:90], 3)
    old |= {("A", DAYS[0]): 11.0}
    new = dict(old)
    new |= {("A", DAYS[200]): 15.0, ("A", DAYS[201]): 16.0, ("A", DAYS[1470]): 3.0}
    new |= {(t, d): 12.0 for t in ("A", "B") for d in DAYS[1480:]} | rows("LATE", DAYS[700:900], 4)
    before = store.persist(frame(spark, old, store)).entry
    m, v = signals(spark, store.read())
    store.persist(frame(spark, new, store, 1))
    prices = store.read()
    found = ic.refresh_signals(m, v, prices, store.changes(before), signal_bounds(prices), new_folder(spark, "fresh"))
    full = signals(spark, prices)
    assert frame_difference(found.momentum, full[0]).isEmpty()
    assert frame_difference(found.volatility, full[1]).isEmpty()
    spans = {}
    for r in found.islands.collect():
        spans.setdefault(r["ticker"], []).append(r["hi"] - r["lo"] + 1)
    # Two changed sessions side by side reach one session more than one does; the new sessions,
    # and a late change, are an island of their own; a new ticker is computed whole.
    assert sorted(spans["A"]) == [30, 1009]
    assert spans["B"] == [20] and spans["GONE"] == [20] and spans["LATE"] == [1500]


def test_refresh_without_changes_keeps_every_row(spark, store):
    store.persist(frame(spark, rows("A", DAYS[:60], 1, 0), store))
    m, v = signals(spark, store.read())
    prices = store.read()
    found = ic.refresh_signals(m, v, prices, store.changes(1), signal_bounds(prices), new_folder(spark, "fresh"))
    assert found.islands.isEmpty() and frame_difference(found.momentum, m).isEmpty()
    assert frame_difference(found.volatility, v).isEmpty()


def test_a_moved_first_session_needs_a_full_computation(spark, store):
    store.persist(frame(spark, rows("A", DAYS[1:60], 1, 0), store))
    m, v = signals(spark, store.read())
    store.persist(frame(spark, rows("A", DAYS[:1], 1, 0), store))
    prices = store.read()
    with pytest.raises(ValueError, match="in full"):
        ic.refresh_signals(m, v, prices, store.changes(1), signal_bounds(prices), new_folder(spark, "fresh"))


def test_history_is_bounded_by_the_earliest_island(spark, store):
    store.persist(frame(spark, rows("A", DAYS, 1, 0), store))
    prices = store.read()
    bounds = signal_bounds(prices)
    islands = ic.impact_islands(
        spark.createDataFrame([("A", DAYS[-2])], "ticker string, date date"), prices.select("ticker").distinct(), bounds, bounds.last
    )
    assert [(r["lo"], r["hi"]) for r in islands.collect()] == [(bounds.last - 1, bounds.last)]
    spine = ic.island_spine(prices, islands, bounds, bounds.last - 1)
    assert spine.count() == ic.REACH + 3
    plan = spine._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(date,{DAYS[-2 - ic.REACH - 1]})" in plan.replace(" ", "")


def test_the_stream_refreshes_signals_behind_every_batch(spark, store, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "signals")
    refresh = signal_refresher(store, root)
    held = rows("A", DAYS[:300], 1) | rows("B", DAYS[:300], 2)
    batches = [held, {("A", DAYS[40]): 20.0} | {("B", d): 9.0 for d in DAYS[300:303]}, {}]
    for hours, batch in enumerate(batches):
        if batch:
            frame(spark, batch, store, hours).write.mode("append").parquet(landing)
        stream_updates(spark, landing, store, str(tmp_path / "refused"), str(tmp_path / "checkpoint"), refresh).awaitTermination()
        refresh()  # a repeated run finds nothing to do
        state = files.read_json(spark, f"{root}/current.json")
        full = signals(spark, store.read())
        for name, want in zip(("momentum", "volatility"), full):
            assert frame_difference(spark.read.parquet(f"{root}/{state['entry']:08d}/{name}"), want).isEmpty()
    # Ticker A from the changed session on, ticker B on the three new ones.
    assert state["recomputed_rows"] == 303 - 40 + 3
    assert [n for n in files.names(spark, root) if n.startswith("0")] == [f"{state['entry']:08d}"]
