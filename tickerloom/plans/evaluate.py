"""Evaluation of one target session: slice, signals, coverage, dependence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.batches import acquisition_view, status_violations
from tickerloom.operators.coverage import coverage, evaluation_calendar, evaluation_slice
from tickerloom.operators.dependence import dependence_by_session, dependence_by_ticker, paired_percentiles
from tickerloom.operators.quality import price_rules, require_none, violations
from tickerloom.operators.signals import stored_signals
from tickerloom.operators.spine import off_calendar, signal_bounds
from tickerloom.schemas import DEPENDENCE_COLUMNS, ContractError
from tickerloom.session import new_folder, stored
from tickerloom.sources.calendar import EvaluationTarget
from tickerloom.sources.universe import validate_universe


@dataclass(frozen=True)
class Evaluation:
    mode: str
    target: EvaluationTarget
    universe: DataFrame
    statuses: DataFrame | None
    frames: dict[str, DataFrame]


def evaluate(
    prices: DataFrame,
    universe: DataFrame,
    target: EvaluationTarget,
    mode: str = "offline",
    statuses: DataFrame | None = None,
) -> Evaluation:
    """Compute the five frames of an evaluation.

    Every frame is written to the shared folder once. Coverage and dependence read the
    written signals instead of repeating their pipeline, and publication compares files
    with tables that cannot change between two reads.
    """
    validate_universe(universe)
    spark = prices.sparkSession
    sliced = stored(evaluation_slice(prices, universe, target), "slice")
    bounds = signal_bounds(sliced, end=target.target_session) if not sliced.isEmpty() else None
    if bounds is None:
        raise ContractError("no configured price observation lies in the evaluation range")
    require_none(violations(sliced, price_rules()), "price rows")
    calendar = evaluation_calendar(target)
    strays = off_calendar(sliced, calendar).select(
        F.lit(1).alias("priority"), F.lit("off_calendar").alias("rule"), "ticker", "date"
    )
    require_none(strays, "price rows")
    if statuses is not None:
        found = status_violations(
            statuses,
            acquisition_view(sliced, statuses),
            universe,
            target.request_start,
            target.request_end,
        )
        require_none(found.withColumn("priority", F.lit(1)), "retrieval statuses")
    elif mode == "refresh":
        raise ContractError("a refresh needs a status for every configured instrument")
    momentum, volatility = stored_signals(sliced, bounds, new_folder(spark, "signals"))
    pairs = stored(paired_percentiles(momentum, volatility, universe), "pairs")
    by_ticker = dependence_by_ticker(pairs, universe)
    by_session = dependence_by_session(pairs, universe, calendar, target.request_start, target.target_session)
    dependence = by_ticker.unionByName(by_session).select(*DEPENDENCE_COLUMNS)
    return Evaluation(
        mode,
        target,
        universe,
        statuses,
        {
            "input_prices": sliced,
            "coverage": stored(coverage(sliced, universe, target, momentum, volatility, statuses), "coverage"),
            "momentum": momentum,
            "volatility": volatility,
            "dependence": stored(dependence, "dependence"),
        },
    )
