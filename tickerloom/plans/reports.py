"""Report tables over coverage, signals, dependence and run manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.vintages import signal_difference, vintage_actions, vintage_difference
from tickerloom.schemas import PRICE_VALUES

# The staleness measures and the status shown with each.
STALENESS = (
    ("price_staleness_sessions", "acquisition_status"),
    ("momentum_raw_staleness_sessions", "momentum_target_status"),
    ("momentum_normalized_staleness_sessions", "momentum_target_normalization_status"),
    ("volatility_raw_staleness_sessions", "volatility_target_status"),
    ("volatility_normalized_staleness_sessions", "volatility_target_normalization_status"),
)
MISSING = "missing"


def overview(coverage: DataFrame, component: str) -> DataFrame:
    """One component's overview in configured order; nothing combines the components."""
    display = "simple_return_pct" if component == "momentum" else "annualized_pct"
    return coverage.select(
        "ord",
        "ticker",
        "name",
        "category",
        "target_session",
        F.col(f"{component}_target_raw").alias("raw"),
        F.col(f"{component}_target_{display}").alias("display_pct"),
        F.col(f"{component}_target_percentile").alias("percentile"),
        F.col(f"{component}_target_status").alias("status"),
        F.col(f"{component}_target_normalization_status").alias("normalization_status"),
        F.col(f"{component}_target_raw_eligible").alias("raw_eligible"),
        F.col(f"{component}_target_normalized_eligible").alias("normalized_eligible"),
        F.col(f"{component}_target_reference_count").alias("reference_count"),
        "price_staleness_sessions",
        F.col(f"{component}_raw_staleness_sessions").alias("raw_staleness_sessions"),
        F.col(f"{component}_normalized_staleness_sessions").alias("percentile_staleness_sessions"),
        "acquisition_status",
    ).orderBy("ord")


def current_percentiles(coverage: DataFrame) -> DataFrame:
    """Present target percentiles of both components; missing ones are left out."""
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("component"),
                F.col(f"{c}_target_percentile").alias("percentile"),
                F.col(f"{c}_target_normalization_status").alias("normalization_status"),
            )
            for c in ("momentum", "volatility")
        ]
    )
    return coverage.select("ord", "ticker", F.inline(entries)).where("percentile is not null")


def price_history(prices: DataFrame, missing: DataFrame) -> DataFrame:
    """Adjusted closes with an explicit null row for every missing session."""
    gaps = missing.select(
        "ticker", "date", F.lit(None).cast("double").alias("adjusted_close"), F.lit(True).alias("is_gap")
    )
    held = prices.select("ticker", "date", "adjusted_close", F.lit(False).alias("is_gap"))
    return held.unionByName(gaps)


def staleness_table(coverage: DataFrame) -> DataFrame:
    """Five staleness measures per instrument; zero and missing stay apart."""
    entries = F.array(
        *[
            F.struct(
                F.lit(sessions).alias("measure"),
                F.col(sessions).alias("sessions"),
                F.col(status).alias("verified_status"),
            )
            for sessions, status in STALENESS
        ]
    )
    return coverage.select("ord", "ticker", F.inline(entries)).withColumn(
        "flag",
        F.when(F.col("sessions").isNull(), "missing").when(F.col("sessions") > 0, "stale").otherwise("current"),
    )


def _shown(frame: DataFrame, column: str) -> Column:
    kind = frame.schema[column].dataType.simpleString()
    if kind == "array<date>":
        return F.array_join(F.col(column).cast("array<string>"), ", ")
    if kind == "double":
        return F.round(F.col(column), 6).try_cast("decimal(38,6)").cast("string")
    return F.col(column).cast("string")


def observation_detail(observations: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Field and value rows of each target observation.

    An instrument without an observation has one row that says so.
    """
    rest = [c for c in columns if c not in ("ticker", "signal_date")]
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("field"), _shown(observations, c).alias("value"))
            for c in ("signal_date", *rest)
        ]
    )
    absent = F.array(F.struct(F.lit("signal_date").alias("field"), F.lit(MISSING).alias("value")))
    shown = F.when(F.col("signal_date").isNull(), absent).otherwise(entries)
    return observations.select("ticker", F.inline(shown))


def dependence_history(dependence: DataFrame, estimator: str) -> DataFrame:
    """One estimator's per-session estimates over time."""
    return dependence.where((F.col("scope") == "per_session") & (F.col("estimator") == estimator)).select(
        "signal_date", "pair_count", "universe_status", "status", "estimate"
    )


def run_metadata(manifest: DataFrame) -> DataFrame:
    """Run-level provenance as field and value rows."""
    fields = (
        "run_id",
        "target_session",
        "captured_at",
        "request_start",
        "request_end_exclusive",
        "mode",
        "universe_sha256",
    )
    return manifest.select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    )


def revision_report(
    old_prices: DataFrame,
    new_prices: DataFrame,
    signals: dict[str, tuple[DataFrame, DataFrame, str, str]],
) -> DataFrame:
    """Two-vintage audit: price keys and fields changed, then signal values changed.

    ``signals`` maps a component to its two frames and the names of its raw value and
    percentile.
    """
    actions = vintage_actions(old_prices, new_prices, PRICE_VALUES)
    counts = vintage_difference(actions, PRICE_VALUES)
    rows = counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("rows")) for c in counts.columns]))
    )
    for component, (first, second, raw, percentile) in signals.items():
        changed = signal_difference(first, second, raw, percentile)
        rows = rows.unionByName(
            changed.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(F.lit(f"{component}_{c}").alias("measure"), F.col(c).alias("rows"))
                            for c in changed.columns
                        ]
                    )
                )
            )
        )
    return rows
