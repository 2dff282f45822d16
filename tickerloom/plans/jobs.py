"""Batch jobs: update the canonical tables from landed payloads, evaluate, publish, verify.

Run one with ``spark-submit`` by calling ``main`` with its name and folders.
"""

from __future__ import annotations

import argparse
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.operators.batches import (
    PRICES,
    SHARES,
    BatchKind,
    accepted_rows,
    batch_statuses,
    failing_tickers,
    requested_tickers,
)
from tickerloom.operators.coverage import coverage, evaluation_calendar, evaluation_slice
from tickerloom.operators.dependence import dependence
from tickerloom.operators.quality import price_rules, share_rules
from tickerloom.operators.signals import require_valid, stored_signals
from tickerloom.operators.spine import signal_bounds
from tickerloom.operators.vintages import grouped_copies
from tickerloom.plans import verify
from tickerloom.plans.evaluate import Evaluation, evaluate
from tickerloom.plans.publish import artifact_violations, publish, read_run
from tickerloom.schemas import ARTIFACTS, HISTORY_START, PRICE_SCHEMA, PRICE_VALUES, SHARE_SCHEMA, SHARE_VALUES, ContractError
from tickerloom.session import new_folder, no_rows, stored
from tickerloom.sources.calendar import resolve_target
from tickerloom.sources.payloads import chart_payloads, chart_rows, share_payloads, share_rows
from tickerloom.sources.store import CanonicalStore, Persisted
from tickerloom.sources.universe import read_universe, universe_hash

VIOLATIONS = T.StructType().add("check", "string").add("rule", "string").add("subject", "string")
LANDED_DDL = "ticker string, payload string, retrieved_at timestamp"


def price_store(spark: SparkSession, root: str) -> CanonicalStore:
    return CanonicalStore(spark, root, PRICE_SCHEMA, PRICE_VALUES, price_rules())


def share_store(spark: SparkSession, root: str) -> CanonicalStore:
    return CanonicalStore(spark, root, SHARE_SCHEMA, SHARE_VALUES, share_rules())


def _checked_requests(requests: DataFrame) -> DataFrame:
    asked = requested_tickers(requests)
    bad = asked.where("problem is not null").limit(5).collect()
    if bad:
        raise ContractError(f"requested tickers: {[(r['ticker'], r['problem']) for r in bad]}")
    return asked.select("ticker")


def _land(kind: BatchKind, parsed: DataFrame, read_rows, requests: DataFrame, window=None) -> tuple[DataFrame, DataFrame]:
    """Each step is written once, so no later one repeats the parse."""
    requests = _checked_requests(requests)
    parsed = stored(parsed, "parsed")
    copies = stored(grouped_copies(read_rows(parsed), kind.values), "copies")
    failing = failing_tickers(kind, copies, window)
    accepted = stored(accepted_rows(copies, failing, kind.columns), "incoming")
    statuses = batch_statuses(kind, parsed, failing, accepted, requests, window or (None, None))
    return accepted, stored(statuses, "statuses")


def land_prices(landed: DataFrame, requests: DataFrame, start: date, end: date) -> tuple[DataFrame, DataFrame]:
    """Price payloads to the rows of the successful tickers and a status per request."""
    if start >= end:
        raise ContractError("start must be earlier than the exclusive end")
    return _land(PRICES, chart_payloads(landed), chart_rows, requests, (start, end))


def land_shares(landed: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Share payloads to rows and statuses; bounds are hints, so no row is out of window."""
    return _land(SHARES, share_payloads(landed), share_rows, requests)


def update_prices(
    store: CanonicalStore, landed: DataFrame, requests: DataFrame, start: date, end: date
) -> tuple[Persisted | None, DataFrame]:
    """A partial batch persists its successes; a batch without any writes nothing."""
    incoming, statuses = land_prices(landed, requests, start, end)
    persisted = None if incoming.isEmpty() else store.persist(incoming, statuses)
    return persisted, statuses


def update_shares(store: CanonicalStore, landed: DataFrame, requests: DataFrame) -> tuple[Persisted | None, DataFrame]:
    incoming, statuses = land_shares(landed, requests)
    persisted = None if incoming.isEmpty() else store.persist(incoming)
    return persisted, statuses


def run_evaluation(
    store: CanonicalStore,
    universe: DataFrame,
    output_root: str,
    captured_at: datetime | None = None,
    landed: DataFrame | None = None,
    context: dict | None = None,
) -> tuple[Evaluation, str]:
    """Resolve the target, refresh if payloads are given, evaluate and publish."""
    spark = universe.sparkSession
    captured_at = captured_at or datetime.now(timezone.utc)
    target = resolve_target(spark, captured_at, date.fromisoformat(HISTORY_START))
    statuses = None
    if landed is not None:
        _, statuses = update_prices(store, landed, universe, target.request_start, target.request_end)
    mode = "offline" if landed is None else "refresh"
    evaluation = evaluate(store.read(), universe, target, mode, statuses)
    return evaluation, publish(evaluation, output_root, captured_at, context)


def recompute(prices: DataFrame, universe: DataFrame, target, statuses: DataFrame | None = None) -> dict[str, DataFrame]:
    """The derived tables of a run, from its stored input alone."""
    first, last = target.request_start, target.target_session
    bounds = signal_bounds(prices, end=last)
    if bounds is None:
        raise ContractError("the run holds no price rows")
    require_valid(prices, bounds.calendar)
    m, v = stored_signals(prices, bounds, new_folder(prices.sparkSession, "check-signals"))
    return {
        "input_prices": evaluation_slice(prices, universe, target),
        "momentum": m,
        "volatility": v,
        "coverage": coverage(prices, universe, target, m, v, statuses),
        "dependence": dependence(m, v, universe, evaluation_calendar(target), first, last),
    }


def verify_run(
    spark: SparkSession, folder: str, history_start: date | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Re-verify a published run; the second table is empty when everything holds."""
    manifest, frames = read_run(spark, folder)
    return frames, run_violations(spark, manifest, frames, folder.rstrip("/").rsplit("/", 1)[-1], history_start)


def run_violations(
    spark: SparkSession, manifest: dict, frames: dict[str, DataFrame], run: str, history_start: date | None = None
) -> DataFrame:
    """check, rule and subject of all that does not hold in a run's manifest and tables.

    A manifest that does not state its mode, target and artifacts leaves nothing to judge the
    tables by; then only its own problems are returned.
    """
    hashed = universe_hash(frames["ticker_metadata"].select("ord", "ticker", "name", "category"))
    problems = verify.manifest_problems(
        spark, manifest, run, hashed.first()["universe_sha256"], history_start
    )
    claimed = spark.createDataFrame([("manifest", *p) for p in problems], VIOLATIONS) if problems else no_rows(spark, VIOLATIONS)
    needed = {"mode", *verify.TARGET_FIELDS, *ARTIFACTS, "artifacts"}
    if any(subject in needed for _, subject in problems):
        return claimed
    target = verify.evaluation_target(manifest)
    metadata, prices = frames["ticker_metadata"], frames["input_prices"]
    universe = metadata.select("ord", "ticker", "name", "category")
    calendar = evaluation_calendar(target)
    sessions = calendar.index_until(target.target_session) - calendar.index_from(target.request_start) + 1
    first = prices.agg(F.min("date")).first()[0]
    last = target.target_session
    statuses = None
    if manifest["mode"] == "refresh":
        statuses = metadata.select(
            "ticker", F.col("acquisition_status").alias("status"), "error", "rows_received", "retrieved_at"
        )
    again = recompute(prices, universe, target, statuses)

    def tagged(check: str, found: DataFrame) -> DataFrame:
        name = next(c for c in ("rule", "field", "only_in") if c in found.columns)
        key = next((c for c in ("ticker", "artifact") if c in found.columns), None)
        return found.select(
            F.lit(check).alias("check"),
            F.col(name).alias("rule"),
            (F.col(key) if key else F.lit(None).cast("string")).alias("subject"),
        )

    m, v = frames["momentum"], frames["volatility"]
    results = {
        "artifacts": artifact_violations(spark, frames, manifest),
        "provenance": verify.provenance(metadata, prices),
        "ticker_metadata": verify.metadata_contract(
            metadata, manifest["mode"], target.request_start, target.request_end
        ),
        "momentum_keys": verify.key_population(m, prices, calendar, first, last),
        "volatility_keys": verify.key_population(v, prices, calendar, first, last),
        "momentum_contract": verify.momentum_contract(m, calendar),
        "volatility_contract": verify.volatility_contract(v, calendar),
        "momentum_input": verify.input_diagnostics(m, again["momentum"], "momentum"),
        "volatility_input": verify.input_diagnostics(v, again["volatility"], "volatility"),
        "coverage_counts": verify.coverage_counts(frames["coverage"], universe, sessions),
        "coverage_fields": verify.field_differences(frames["coverage"], again["coverage"], ["ticker"]),
        "dependence_contract": verify.dependence_contract(frames["dependence"], universe.count(), sessions),
        "dependence_fields": verify.dependence_differences(frames["dependence"], again["dependence"]),
        "regeneration": verify.regeneration(
            frames, {name: again[name] for name in ("input_prices", "momentum", "volatility")}
        ),
    }
    for check, found in results.items():
        claimed = claimed.unionByName(tagged(check, found))
    return claimed


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="session-panel signal jobs")
    parser.add_argument("job", choices=["update-prices", "update-shares", "evaluate", "verify"])
    parser.add_argument("--store", help="root folder of the canonical table")
    parser.add_argument("--landing", help="folder of JSON lines with ticker, payload, retrieved_at")
    parser.add_argument("--universe", help="JSON document of configured instruments")
    parser.add_argument("--output", help="root folder of published runs, or one run to verify")
    parser.add_argument("--start", type=date.fromisoformat, default=date.fromisoformat(HISTORY_START))
    parser.add_argument("--end", type=date.fromisoformat)
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if given.job == "verify":
        _, found = verify_run(spark, given.output)
        found.show(truncate=False)
        return
    universe = read_universe(spark, given.universe)
    landed = spark.read.schema(LANDED_DDL).json(given.landing) if given.landing else None
    if given.job == "update-prices":
        store = price_store(spark, given.store)
        _, statuses = update_prices(store, landed, universe, given.start, given.end or date.today())
        statuses.groupBy("status").count().show()
    elif given.job == "update-shares":
        _, statuses = update_shares(share_store(spark, given.store), landed, universe)
        statuses.groupBy("status").count().show()
    else:
        _, folder = run_evaluation(price_store(spark, given.store), universe, given.output, landed=landed)
        print(folder)


if __name__ == "__main__":
    main()
