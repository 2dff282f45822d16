import math
import threading
from datetime import date, datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import panel, sessions, wave
from tickerloom.operators import coverage as cv
from tickerloom.operators import dependence as dp
from tickerloom.plans import jobs, publish as pb, reports as rp, verify as vf
from tickerloom.plans.evaluate import evaluate
from tickerloom.schemas import ARTIFACTS, VOLATILITY_COLUMNS, ContractError
from tickerloom.sources import files
from tickerloom.sources.calendar import EvaluationTarget, resolve_target

COUNT = 560


@pytest.fixture(scope="module")
def universe(spark):
    rows = [(1, "ZED", "Zed fund", "Broad"), (2, "AAA", "A fund", "Broad"), (3, "GONE", "Absent", "Other")]
    return spark.createDataFrame(rows, "ord bigint, ticker string, name string, category string")


@pytest.fixture(scope="module")
def prices(spark):
    z = wave(COUNT, 1.0)
    z[-1] = "absent"
    z[100] = "absent"
    z[101] = None
    return panel(spark, {"AAA": wave(COUNT), "ZED": z, "EXTRA": wave(COUNT, 2.0)})


@pytest.fixture(scope="module")
def target(spark):
    day = sessions(COUNT)[-1]
    return resolve_target(spark, datetime(day.year, day.month, day.day, 23, tzinfo=timezone.utc))


@pytest.fixture(scope="module")
def evaluation(prices, universe, target):
    return evaluate(prices, universe, target)


def test_coverage_rows(evaluation, target):
    frame = evaluation.frames["coverage"]
    assert len(frame.columns) == 54
    by = {r["ticker"]: r for r in frame.collect()}
    assert set(by) == {"ZED", "AAA", "GONE"}
    days = sessions(COUNT)
    zed, gone, whole = by["ZED"], by["GONE"], by["AAA"]
    assert zed["missing_canonical_dates"] == [days[100], days[-1]]
    assert zed["missing_adjusted_close_dates"] == [days[101]]
    assert zed["price_staleness_sessions"] == 1 and zed["target_price_row_present"] is False
    assert zed["momentum_target_status"] == "missing_end_row"
    assert zed["momentum_target_normalization_status"] == "raw_ineligible"
    assert zed["momentum_raw_staleness_sessions"] == 1
    assert gone["missing_canonical_count"] == COUNT and gone["price_staleness_sessions"] is None
    assert gone["momentum_target_status"] == gone["volatility_target_status"] == "ticker_unavailable"
    assert gone["momentum_target_reference_count"] is None and gone["first_canonical_date"] is None
    assert whole["price_staleness_sessions"] == 0 and whole["momentum_target_normalized_eligible"]
    assert {r["acquisition_status"] for r in by.values()} == {"not_requested"}
    assert {r["expected_xnys_observation_count"] for r in by.values()} == {COUNT}


def naive(pairs):
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    if len(pairs) < 3:
        return "insufficient_pairs", None, None
    if len(set(x)) < 2 or len(set(y)) < 2:
        return "constant_input", None, None

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    return "available", np.corrcoef(x, y)[0, 1], np.corrcoef(ranks(x), ranks(y))[0, 1]


def test_dependence_against_plain_python(spark, evaluation, universe):
    m = {(r["ticker"], r["signal_date"]): r["momentum_percentile"] for r in evaluation.frames["momentum"].collect()}
    v = {(r["ticker"], r["signal_date"]): r["volatility_percentile"] for r in evaluation.frames["volatility"].collect()}
    rows = evaluation.frames["dependence"].collect()
    assert len(rows) == 2 * (3 + COUNT)
    order = ["ZED", "AAA", "GONE"]
    for r in rows:
        keys = [
            k
            for k in m
            if m[k] is not None and v[k] is not None and k[0] in order and (k[0] == r["ticker"] if r["scope"] == "per_etf" else k[1] == r["signal_date"])
        ]
        status, pearson, spearman = naive([(m[k], v[k]) for k in keys])
        assert (r["pair_count"], r["status"]) == (len(keys), status)
        expected = pearson if r["estimator"] == "pearson" else spearman
        if expected is None:
            assert r["estimate"] is None
        else:
            assert r["estimate"] == pytest.approx(expected, abs=1e-12)
        if r["scope"] == "per_session":
            assert r["included_tickers"] == [t for t in order if (t, r["signal_date"]) in keys]
            assert r["universe_status"] == "incomplete_universe"
        else:
            assert r["included_tickers"] == ([r["ticker"]] if keys else []) and r["universe_status"] == "not_applicable"


def test_correlation_guards_and_ties(spark):
    rows = [("a", float(i % 4), float(i * i % 5)) for i in range(40)] + [("flat", 1.0, float(i)) for i in range(5)] + [("few", 1.0, 2.0)] * 2
    pairs = spark.createDataFrame(rows, "ticker string, x double, y double").withColumn("signal_date", F.current_date())
    by = {r["ticker"]: r for r in dp.correlations(pairs, "ticker").collect()}
    status, pearson, spearman = naive([r[1:] for r in rows if r[0] == "a"])
    assert by["a"]["status"] == status
    assert by["a"]["pearson"] == pytest.approx(pearson, abs=1e-12) and by["a"]["spearman"] == pytest.approx(spearman, abs=1e-12)
    assert by["flat"]["status"] == "constant_input" and by["few"]["status"] == "insufficient_pairs"


def test_members_are_listed_whole_in_a_large_universe(spark, target):
    calendar = cv.evaluation_calendar(target)
    day = calendar.sessions[calendar.index_until(target.target_session)]
    universe = spark.range(1, 10_002).selectExpr("id as ord", "concat('T', id) as ticker")
    pairs = universe.selectExpr("ticker", f"date'{day}' as signal_date", "double(ord) as x", "double(ord) as y", "ord")
    rows = dp.dependence_by_session(pairs, universe, calendar, day, day)
    assert [(len(r["included_tickers"]), r["universe_status"]) for r in rows.collect()] == [(10_001, "full_universe")] * 2
    assert dp.session_members(pairs).count() == rows.where("estimator = 'pearson'").agg(F.sum("pair_count")).first()[0]


def test_offline_target_and_refresh_guards(spark, prices, universe, target):
    with pytest.raises(ContractError, match="no configured price"):
        evaluate(prices.where("ticker = 'EXTRA'"), universe, target)
    with pytest.raises(ContractError, match="status"):
        evaluate(prices, universe, target, "refresh")


def test_artifacts_are_written_side_by_side(spark, evaluation, tmp_path, monkeypatch):
    met, write = threading.Barrier(len(ARTIFACTS)), pb.write_sorted

    def waiting(frame, folder):
        met.wait(60)
        write(frame, folder)

    monkeypatch.setattr(pb, "write_sorted", waiting)
    folder = pb.publish(evaluation, str(tmp_path / "runs"), datetime(2026, 1, 2, tzinfo=timezone.utc))
    manifest, frames = pb.read_run(spark, folder)
    assert pb.artifact_violations(spark, frames, manifest).isEmpty()


def test_publish_and_verify(spark, evaluation, tmp_path):
    root = str(tmp_path / "runs")
    at = datetime(2026, 1, 2, 3, 4, 5, 678900, tzinfo=timezone.utc)
    folder = pb.publish(evaluation, root, at, {"head": "abc"})
    assert folder.endswith("20260102T030405678900Z")
    with pytest.raises(FileExistsError):
        pb.publish(evaluation, root, at)
    frames, found = jobs.verify_run(spark, folder)
    assert found.isEmpty() and set(frames) == {*ARTIFACTS, "ticker_metadata"}
    manifest, _ = pb.read_run(spark, folder)
    inventory = pb.artifact_inventory(manifest, spark)
    assert inventory.where("artifact = 'momentum'").count() == 18
    assert inventory.where("field = 'missing_row_dates'").first()["type"] == "array<date>"
    (tmp_path / "runs" / "stray").mkdir()
    (tmp_path / "runs" / "20260101T000000000000Z.invalid-1").mkdir()
    kinds = [(r["name"][:8], r["kind"]) for r in pb.discover_runs(spark, root).collect()]
    assert kinds == [("stray", "rejected"), ("20260102", "run"), ("20260101", "quarantined")]


@pytest.fixture(scope="module")
def manifest(evaluation):
    at = evaluation.target.captured_at
    rows = {r["artifact"]: r.asDict() for r in pb.manifest_rows(evaluation.frames).collect()}
    return pb.manifest_head(evaluation, at, {"head": "abc"}) | {"artifacts": rows}


def problems(spark, manifest, run, sha):
    return set(vf.manifest_problems(spark, manifest, run, sha))


@pytest.mark.parametrize(
    "field, value, rules",
    [
        ("run_id", "20200101T000000000000Z", {"differs_from_folder", "differs_from_creation"}),
        ("created_at", "2017-05-05T00:00:00.000000Z", {"differs_from_creation:run_id", "before_capture"}),
        ("created_at", "yesterday", {"malformed"}),
        ("mode", "online", {"unknown_value"}),
        ("captured_at", "2018-13-01T00:00:00.000000Z", {"malformed"}),
        ("captured_at", 5, {"malformed"}),
        ("target_session", "2018-01-04", {"differs_from_capture"}),
        ("request_start", "2018-01-02", {"differs_from_history_start"}),
        ("request_end_exclusive", "2018-01-04", {"differs_from_capture"}),
        ("universe_sha256", "0" * 64, {"differs_from_universe"}),
        ("universe_sha256", "ABC", {"malformed"}),
        ("notes", "more", {"field_unknown"}),
    ],
)
def test_manifest_fields_are_checked(spark, manifest, field, value, rules):
    run, sha = manifest["run_id"], manifest["universe_sha256"]
    assert problems(spark, manifest, run, sha) == set()
    found = problems(spark, manifest | {field: value}, run, sha)
    assert found == {(r.split(":")[0], r.split(":")[1] if ":" in r else field) for r in rules}


def test_manifest_without_fields_or_artifacts(spark, manifest, evaluation):
    run, sha = manifest["run_id"], manifest["universe_sha256"]
    for field in vf.MANIFEST_FIELDS:
        less = {k: v for k, v in manifest.items() if k != field}
        assert ("field_missing", field) in problems(spark, less, run, sha)
    claims = manifest["artifacts"]

    def changed(name, claim):
        return problems(spark, manifest | {"artifacts": claims | {name: claim}}, run, sha)

    momentum = claims["momentum"]
    assert changed("extra", momentum) == {("artifact_unknown", "extra")}
    assert changed("momentum", {"digest": "0"}) == {("artifact_fields_differ", "momentum")}
    assert changed("momentum", momentum | {"filename": "x"}) == {("artifact_name_differs", "momentum")}
    assert changed("momentum", momentum | {"row_count": -1}) == {("malformed_row_count", "momentum")}
    assert problems(spark, manifest | {"artifacts": {}}, run, sha) == {("artifact_missing", a) for a in ARTIFACTS}
    # Without a target nothing else can be judged, and nothing else is claimed.
    frames = evaluation.frames | {
        "ticker_metadata": pb.ticker_metadata(evaluation.universe, evaluation.frames["input_prices"], None)
    }
    rows = jobs.run_violations(spark, manifest | {"captured_at": None}, frames, run).collect()
    assert [tuple(r) for r in rows] == [("manifest", "malformed", "captured_at")]


def test_tampered_artifacts_are_noticed(spark, evaluation, prices, target):
    frames = dict(evaluation.frames)
    manifest = {"artifacts": {r["artifact"]: r.asDict() for r in pb.manifest_rows(frames).collect()}}
    assert pb.artifact_violations(spark, frames, manifest).isEmpty()
    frames["momentum"] = frames["momentum"].withColumn(
        "momentum_percentile", F.when(F.col("ticker") == "AAA", F.col("momentum_percentile") + 1e-9).otherwise(F.col("momentum_percentile"))
    )
    frames["volatility"] = frames["volatility"].where("ticker <> 'AAA'")
    found = {(r["artifact"], r["rule"]) for r in pb.artifact_violations(spark, frames, manifest).collect()}
    assert found == {("momentum", "digest_differs"), ("volatility", "digest_differs"), ("volatility", "row_count_differs")}


@pytest.mark.parametrize(
    "column, value, rule",
    [
        ("endpoint_status", "odd", "unknown_issue"),
        ("first_prospective_session", date(2018, 1, 2), "prospective_session_differs"),
        ("endpoint_start_date", date(2018, 1, 2), "endpoint_start_differs"),
        ("simple_return_pct", -100.0, "simple_return_too_low"),
        ("raw_momentum", float("nan"), "raw_not_finite"),
        ("normalization_reference_count", 756, "reference_count_out_of_range"),
        ("momentum_percentile", 100.5, "percentile_out_of_range"),
        ("simple_return_status", "other", "simple_return_status_differs"),
    ],
)
def test_momentum_contract(spark, evaluation, target, column, value, rule):
    frame = evaluation.frames["momentum"]
    calendar = cv.evaluation_calendar(target)
    assert vf.momentum_contract(frame, calendar).isEmpty()
    changed = frame.withColumn(column, F.lit(value).cast(frame.schema[column].dataType))
    assert rule in {r["rule"] for r in vf.momentum_contract(changed, calendar).select("rule").distinct().collect()}


def test_volatility_contract_and_key_population(spark, evaluation, prices, universe, target):
    frame = evaluation.frames["volatility"]
    calendar = cv.evaluation_calendar(target)
    assert vf.volatility_contract(frame, calendar).isEmpty()
    twice = frame.unionByName(frame.limit(1))
    assert {r["rule"] for r in vf.volatility_contract(twice, calendar).collect()} == {"duplicate_key"}
    weekend = frame.withColumn("missing_row_dates", F.array(F.lit(date(2018, 1, 6)))).withColumn("missing_row_count", F.lit(1).cast("bigint"))
    assert "missing_row_dates" in {r["rule"] for r in vf.volatility_contract(weekend, calendar).collect()}
    days = sessions(COUNT)
    held = evaluation.frames["input_prices"]
    assert vf.key_population(frame, held, calendar, days[0], days[-1]).isEmpty()
    short = frame.where(F.col("signal_date") < F.lit(days[-1]))
    assert {r["rule"] for r in vf.key_population(short, held, calendar, days[0], days[-1]).collect()} == {"incomplete_sessions"}


def test_reports(spark, evaluation, target, universe):
    table = rp.staleness_table(evaluation.frames["coverage"])
    flags = {(r["ticker"], r["measure"]): r["flag"] for r in table.collect()}
    assert flags["ZED", "price_staleness_sessions"] == "stale" and flags["GONE", "price_staleness_sessions"] == "missing"
    assert flags["AAA", "momentum_raw_staleness_sessions"] == "current"
    order = [r["ticker"] for r in rp.overview(evaluation.frames["coverage"], "momentum").collect()]
    assert order == ["ZED", "AAA", "GONE"]
    seen = cv.target_observation(evaluation.frames["volatility"], universe, target)
    detail = rp.observation_detail(seen, VOLATILITY_COLUMNS)
    assert detail.where("ticker = 'ZED' and field = 'window_status'").first()["value"] == "missing_price_rows"
    assert [tuple(r) for r in detail.where("ticker = 'GONE'").collect()] == [("GONE", "signal_date", "missing")]
    days = sessions(COUNT)
    latest = spark.createDataFrame([("a", days[-3]), ("b", None), ("c", date(2018, 1, 6))], "ticker string, latest date")
    rows = {r["ticker"]: (r["staleness_sessions"], r["not_a_session"]) for r in cv.staleness(latest, target).collect()}
    assert rows == {"a": (2, False), "b": (None, False), "c": (None, True)}
