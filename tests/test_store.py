import json
from decimal import Decimal
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.helpers import AT, bar, later, panel, sessions, wave
from tests.test_ingest import STAMPS, chart, landed, shares
from tickerloom.plans import jobs
from tickerloom.plans.publish import read_run
from tickerloom.schemas import ContractError
from tickerloom.session import shared_folder
from tickerloom.sources import files
from tickerloom.sources import payloads as pl
from tickerloom.streaming import updates as up
from tickerloom.streaming.updates import stream_updates

DAYS = sessions(45)


def vintage(spark, hours=0, factor=1.0, days=DAYS, ticker="A"):
    rows = [bar(d, ticker, 10.0 * factor + i, later(hours)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, panel(spark, {"A": [1.0]}).schema)


@pytest.fixture
def store(spark, tmp_path):
    return jobs.price_store(spark, str(tmp_path / "prices"))


def contents(df):
    return sorted((r["ticker"], r["date"], r["adjusted_close"], r["retrieved_at"]) for r in df.collect())


def test_missing_table_is_an_error(store):
    with pytest.raises(FileNotFoundError):
        store.read()


def test_write_advance_revise_and_snapshot(spark, store):
    first = store.persist(vintage(spark))
    assert (first.revised_rows, first.snapshot) == (0, None) and store.read().count() == 45
    before = contents(store.read())

    advanced = store.persist(vintage(spark, 1))
    assert advanced.revised_rows == 0 and advanced.snapshot is None
    assert {r["retrieved_at"] for r in store.read().collect()} == {later(1).replace(tzinfo=None)}

    at = datetime(2026, 8, 31, 7, 56, 36, 968830, tzinfo=timezone.utc)
    january = [d for d in DAYS if d.month == 1]
    revised = store.persist(vintage(spark, 2, 2.0, january), snapshot_time=at)
    assert revised.revised_rows == len(january)
    assert [tuple(r) for r in revised.revised_tickers.collect()] == [("A", len(january))]
    assert revised.snapshot == "prices_20260831T075636968830Z"
    assert store.snapshots() == {revised.snapshot: 2}
    assert store.read(number=1).count() == 45 and contents(store.read(number=1)) == before
    months = store.current()["months"]
    assert months["2018-01"].startswith("versions/00000003") and months["2018-02"].startswith("versions/00000002")
    again = store.persist(vintage(spark, 3, 3.0, january), snapshot_time=at)
    assert again.snapshot == "prices_20260831T075636968830Z_001"


def test_replay_changes_nothing(spark, store):
    store.persist(vintage(spark))
    replay = store.persist(vintage(spark))
    assert replay.entry == 1 and store.entries() == [1]


@pytest.mark.parametrize("hours, factor, rule", [(0, 2.0, "conflict"), (-1, 2.0, "stale")])
def test_refused_vintages_leave_the_table_alone(spark, store, hours, factor, rule):
    store.persist(vintage(spark))
    before = contents(store.read())
    with pytest.raises(ContractError, match=rule):
        store.persist(vintage(spark, hours, factor))
    with pytest.raises(ContractError, match="lose"):
        store.persist(vintage(spark, 5).withColumn("volume", F.lit(None).cast("double")))
    with pytest.raises(ContractError, match="nonpositive_open"):
        store.persist(vintage(spark, 5).withColumn("open", F.lit(-1.0)))
    with pytest.raises(ContractError, match="conflicting_duplicates"):
        store.persist(vintage(spark, 5).unionByName(vintage(spark, 5, 2.0)))
    with pytest.raises(ContractError, match="no observations"):
        store.persist(vintage(spark).limit(0))
    assert contents(store.read()) == before and store.entries() == [1]


def test_vanished_rows_refuse_the_update(spark, store):
    two = landed(spark, AAA=chart("AAA"))
    asked = two.select("ticker")
    jobs.update_prices(store, two, asked, date(2024, 1, 1), date(2024, 2, 1))
    one = landed(spark, AAA=chart("AAA", stamps=STAMPS[:1], adjusted=False, **{c: [10.0] for c in ("open", "high", "low", "close", "volume")}))
    with pytest.raises(ContractError, match="vanished"):
        jobs.update_prices(store, one, asked, date(2024, 1, 1), date(2024, 2, 1))
    failed = landed(spark, AAA="not json")
    persisted, statuses = jobs.update_prices(store, failed, asked, date(2024, 1, 1), date(2024, 2, 1))
    assert persisted is None and statuses.first()["status"] == "failed" and store.read().count() == 2


def test_share_updates(spark, tmp_path):
    store = jobs.share_store(spark, str(tmp_path / "shares"))
    payloads = landed(spark, AAA=shares())
    persisted, _ = jobs.update_shares(store, payloads, payloads.select("ticker"))
    assert persisted.entry == 1
    assert sorted((r["date"], r["shares_outstanding"]) for r in store.read().collect()) == [
        (date(2024, 1, 3), 5.0),
        (date(2024, 1, 4), None),
    ]


def test_large_counts_survive_every_step(spark, tmp_path):
    counts = [2**53 + 1, 2**63 + 1]
    store = jobs.share_store(spark, str(tmp_path / "shares"))
    payloads = landed(spark, AAA=shares(values=counts), BBB=shares("BBB", values=[2**64 - 1, 1.5]))
    _, statuses = jobs.update_shares(store, payloads, payloads.select("ticker"))
    assert {r["status"] for r in statuses.collect()} == {"success"}

    def held(ticker):
        rows = store.read().where(F.col("ticker") == ticker).orderBy("date").collect()
        return [r["shares_outstanding"] for r in rows]

    assert held("AAA") == counts and held("BBB") == [2**64 - 1, Decimal("1.5")]
    # One share more is a revision, the same count again is none; both are lost on doubles.
    later = payloads.withColumn("retrieved_at", F.col("retrieved_at") + F.expr("INTERVAL 1 HOUR"))
    more = landed(spark, AAA=shares(values=[2**53 + 2, 2**63 + 1])).withColumn("retrieved_at", F.lit(AT) + F.expr("INTERVAL 2 HOURS"))
    assert jobs.update_shares(store, later, later.select("ticker"))[0].revised_rows == 0
    assert jobs.update_shares(store, more, more.select("ticker"))[0].revised_rows == 1
    assert held("AAA") == [2**53 + 2, 2**63 + 1]
    # Copies that differ by one share conflict.
    copies = store.read().unionByName(store.read().withColumn("shares_outstanding", F.col("shares_outstanding") + 1).select(store.read().columns).withColumn("shares_outstanding", F.col("shares_outstanding").cast(store.schema["shares_outstanding"].dataType)))
    with pytest.raises(ContractError, match="conflicting_duplicates"):
        store.persist(copies)


def test_end_to_end_refresh(spark, tmp_path):
    store = jobs.price_store(spark, str(tmp_path / "prices"))
    days = sessions(60)
    stamps = [int(datetime(d.year, d.month, d.day, 15, tzinfo=timezone.utc).timestamp()) for d in days]
    values = wave(60)
    fields = {"open": values, "high": [x + 1 for x in values], "low": [x - 1 for x in values], "close": values, "volume": [5] * 60}
    payload = chart("AAA", stamps=stamps, **fields)
    payload["chart"]["result"][0]["indicators"]["adjclose"] = [{"adjclose": values}]
    payloads = landed(spark, AAA=payload, BBB="broken")
    universe = spark.createDataFrame([(1, "AAA", "A", "X"), (2, "BBB", "B", "X")], "ord bigint, ticker string, name string, category string")
    last = days[-1]
    at = datetime(last.year, last.month, last.day, 23, tzinfo=timezone.utc)
    evaluation, folder = jobs.run_evaluation(store, universe, str(tmp_path / "runs"), at, payloads)
    assert evaluation.mode == "refresh"
    by = {r["ticker"]: r for r in evaluation.frames["coverage"].collect()}
    assert by["AAA"]["acquisition_status"] == "success" and by["AAA"]["acquisition_rows_received"] == 60
    assert by["BBB"]["acquisition_status"] == "failed" and by["BBB"]["momentum_target_status"] == "ticker_unavailable"
    _, found = jobs.verify_run(spark, folder)
    assert found.collect() == []
    manifest, _ = read_run(spark, folder)
    assert manifest["mode"] == "refresh" and manifest["target_session"] == last.isoformat()


def test_stream_merges_and_quarantines(spark, tmp_path):
    store = jobs.price_store(spark, str(tmp_path / "prices"))
    landing, quarantine, checkpoint = (str(tmp_path / n) for n in ("landing", "quarantine", "checkpoint"))
    runs = []

    def drain():
        query = stream_updates(spark, landing, store, quarantine, checkpoint, lambda: runs.append(store.current()["number"]))
        query.awaitTermination()

    vintage(spark).coalesce(1).write.parquet(landing)
    drain()
    assert store.read().count() == 45 and spark.read.parquet(quarantine).isEmpty()
    stale = vintage(spark, -1, 2.0, DAYS[:3])
    bad = vintage(spark, 4, 1.0, DAYS[3:4]).withColumn("open", F.lit(-1.0))
    better = vintage(spark, 4, 2.0, DAYS[10:12])
    fresh = vintage(spark, 4, 1.0, DAYS[:2], "B")
    stale.unionByName(bad).unionByName(better).unionByName(fresh).coalesce(1).write.mode("append").parquet(landing)
    drain()
    held = {(r["ticker"], r["date"]): r["adjusted_close"] for r in store.read().collect()}
    assert len(held) == 47 and held["A", DAYS[0]] == 10.0 and held["A", DAYS[10]] == 20.0
    reasons = {(r["date"], r["reason"]) for r in spark.read.parquet(quarantine).collect()}
    assert reasons == {(DAYS[0], "stale"), (DAYS[1], "stale"), (DAYS[2], "stale"), (DAYS[3], "nonpositive_open")}
    assert runs == [1, 2]
    drain()
    assert store.entries() == [1, 2]


def test_whole_numbers_survive_or_fail_loudly(spark, store):
    whole = vintage(spark).withColumn("volume", F.lit(2**53).cast("bigint"))
    assert store.persist(whole).revised_rows == 0
    assert {r["volume"] for r in store.read().collect()} == {float(2**53)}
    with pytest.raises(Exception, match="cannot hold exactly"):
        store.persist(vintage(spark, 1).withColumn("volume", F.lit(2**53 + 1).cast("bigint")))
    assert {r["volume"] for r in store.read().collect()} == {float(2**53)}
    flat = spark.range(1).selectExpr(
        "date'2024-01-03' AS date", "1.0D AS Open", "1.0D AS High", "1.0D AS Low", "1.0D AS Close",
        "9007199254740993L AS Volume",
    )
    with pytest.raises(Exception, match="cannot hold exactly"):
        pl.normalize_flat(flat, "A", F.lit(AT)).collect()
    wide = flat.select("date", *[F.col(c).alias(f"{c}|A") for c in flat.columns[1:]])
    with pytest.raises(Exception, match="cannot hold exactly"):
        pl.unpivot_wide(wide, ["A"], F.lit(AT)).collect()
    series = spark.sql("SELECT '2024-01-03T00:00:00+00:00' AS stamp, 9007199254740993L AS value")
    assert pl.normalize_shares(series, "A", F.lit(AT)).first()["shares_outstanding"] == 2**53 + 1
    # Doubles become the decimals that print them; what no decimal of the type holds is refused.
    for value, held in ((5.25, Decimal("5.25")), (1e20, Decimal(10) ** 20)):
        assert pl.normalize_shares(series.withColumn("value", F.lit(value)), "A", F.lit(AT)).first()["shares_outstanding"] == held
    for value in (1e30, float("inf"), 1e-30):
        with pytest.raises(Exception, match="cannot hold exactly"):
            pl.normalize_shares(series.withColumn("value", F.lit(value)), "A", F.lit(AT)).collect()


def test_a_merge_leaves_no_intermediate_folder(spark, store):
    shared = f"{shared_folder(spark)}/tickerloom"
    before = set(files.names(spark, shared))
    store.persist(vintage(spark))
    assert store.persist(vintage(spark)).revised_tickers.collect() == []
    with pytest.raises(ContractError):
        store.persist(vintage(spark, -1, 2.0))
    assert set(files.names(spark, shared)) == before


def test_broken_stored_rows_stop_a_merge(spark, store):
    store.persist(vintage(spark))
    folder = f"{store.root}/{store.current()['months']['2018-01']}"
    held = spark.read.parquet(folder).withColumn("open", F.lit(-1.0)).collect()
    schema = spark.read.parquet(folder).schema
    spark.createDataFrame(held, schema).coalesce(1).write.mode("overwrite").parquet(folder)
    with pytest.raises(ContractError, match="stored rows break rule 'nonpositive_open'"):
        store.persist(vintage(spark, 1))
    assert store.entries() == [1]


def test_copies_of_a_streamed_vintage_are_grouped_once(spark, store):
    store.persist(vintage(spark))
    folders = []
    accepted, refused = up.split_vintage(store, vintage(spark, hours=5, factor=2.0), folders)
    assert accepted.count() == len(DAYS) and refused.isEmpty()
    # What is accepted is read from written copies and meets only what is refused.
    assert "Aggregate" not in accepted._jdf.queryExecution().optimizedPlan().toString()
    assert len(folders) == 3 and all(files.exists(spark, f) for f in folders)


def test_a_decided_vintage_is_written_without_joining_again(spark, store, monkeypatch):
    store.persist(vintage(spark))
    stale, fresh = vintage(spark, -1, 2.0, DAYS[:3]), vintage(spark, 5, 2.0, DAYS[3:5])
    folders = []
    decided, refused = up.decide_vintage(store, stale.unionByName(fresh), folders)
    assert {r["reason"] for r in refused.collect()} == {"stale"} and refused.count() == 3
    monkeypatch.setattr("tickerloom.sources.store.vintage_actions", None)
    monkeypatch.setattr("tickerloom.sources.store.grouped_copies", None)
    before = {r["date"]: r["adjusted_close"] for r in store.read().collect()}
    assert store.persist_decided(decided).revised_rows == 2
    held = {r["date"]: r["adjusted_close"] for r in store.read().collect()}
    assert held == before | {r["date"]: r["adjusted_close"] for r in fresh.collect()}
