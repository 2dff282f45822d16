"""Independent checks of published tables; every check yields violation rows."""

from __future__ import annotations

import re
from datetime import date, datetime, timezone
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.digests import differing_nodes, hash_difference, in_nodes
from tickerloom.functions.numeric import is_finite
from tickerloom.operators.vintages import frame_difference
from tickerloom.schemas import ARTIFACTS, HISTORY_START, MIN_REFERENCES, REFERENCE_SPAN
from tickerloom.session import no_rows, side_by_side
from tickerloom.sources.calendar import EvaluationTarget, SessionCalendar, resolve_target
from tickerloom.sources.store import RUN_STAMP

MOMENTUM_ISSUES = (
    "missing_start_row",
    "missing_start_adjusted_close",
    "missing_end_row",
    "missing_end_adjusted_close",
)


def _broken(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """One row per broken rule. A rule that is null (a compared value is absent) holds."""
    hits = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return df.select(F.explode(hits).alias("rule"), *keys)


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_key").alias("rule"), *keys)
    )


def _with_calendar(frame: DataFrame, calendar: SessionCalendar) -> DataFrame:
    days = calendar.frame(frame.sparkSession).select(
        F.col("session").alias("signal_date"), "pos", "next_session", "back_21", "back_252"
    )
    return frame.join(F.broadcast(days), "signal_date", "left")


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _bad_dates(dates: str, count: str, low: Column, high: Column, calendar: SessionCalendar) -> Column:
    """Wrong size, unsorted or repeated, outside the bounds, or not a session."""
    days = F.col(dates)
    # A constant IN list is a hash lookup, however many closures the calendar has.
    closed = ", ".join(f"date'{d}'" for d in calendar.weekday_closures)
    no_session = F.expr(f"exists({dates}, d -> weekday(d) >= 5 OR d IN ({closed}))")
    outside = (F.size(days) > 0) & ((F.array_min(days) < low) | (F.array_max(days) > high))
    return (F.size(days) != F.col(count)) | (F.array_sort(F.array_distinct(days)) != days) | outside | no_session


def _percentile_rules(raw: str, percentile: str, eligible: Column) -> dict[str, Column]:
    references = F.col("normalization_reference_count")
    shown = F.col(percentile)
    return {
        "percentile_out_of_range": (shown < 0) | (shown > 100) | ~is_finite(shown),
        "reference_count_out_of_range": (references < 0) | (references > REFERENCE_SPAN) | references.isNull(),
        "raw_not_finite": ~is_finite(F.col(raw)),
        "percentile_contradicts_history": shown.isNotNull() != (eligible & (references >= MIN_REFERENCES)),
    }


def volatility_contract(volatility: DataFrame, calendar: SessionCalendar) -> DataFrame:
    """Rows that break the volatility output contract."""
    eligible = F.col("window_eligible")
    raw, pct = F.col("raw_annualized_volatility"), F.col("annualized_volatility_pct")
    expected_status = F.concat_ws(
        "|",
        F.when(F.col("missing_row_count") > 0, "missing_price_rows"),
        F.when(F.col("missing_adjusted_close_count") > 0, "missing_adjusted_close"),
    )
    low, high = F.col("window_start_date"), F.col("signal_date")
    rules = {
        "blank_ticker": F.coalesce(F.trim("ticker"), F.lit("")) == "",
        "not_a_session": F.col("pos").isNull(),
        "window_end_differs": _differs("window_end_date", "signal_date"),
        "window_start_differs": _differs("window_start_date", "back_21"),
        "prospective_session_differs": _differs("first_prospective_session", "next_session"),
        "negative_volatility": (raw < 0) | (pct < 0),
        "negative_count": (F.col("missing_row_count") < 0) | (F.col("missing_adjusted_close_count") < 0),
        "missing_row_dates": _bad_dates("missing_row_dates", "missing_row_count", low, high, calendar),
        "missing_value_dates": _bad_dates(
            "missing_adjusted_close_dates", "missing_adjusted_close_count", low, high, calendar
        ),
        "overlapping_diagnostics": F.arrays_overlap("missing_row_dates", "missing_adjusted_close_dates"),
        "eligibility_differs": eligible
        != ((F.col("missing_row_count") == 0) & (F.col("missing_adjusted_close_count") == 0)),
        "status_differs": F.col("window_status")
        != F.when(expected_status == "", "eligible").otherwise(expected_status),
        "value_contradicts_eligibility": (raw.isNotNull() != eligible) | (pct.isNotNull() != eligible),
        "display_differs": pct != raw * 100.0,
        **_percentile_rules("raw_annualized_volatility", "volatility_percentile", eligible),
    }
    keys = ("ticker", "signal_date")
    return _broken(_with_calendar(volatility, calendar), rules, *keys).unionByName(_repeated(volatility, *keys))


def momentum_contract(momentum: DataFrame, calendar: SessionCalendar) -> DataFrame:
    """Rows that break the momentum output contract."""
    eligible, status = F.col("endpoint_eligible"), F.col("endpoint_status")
    issues = F.split(status, r"\|")
    allowed = F.array(*[F.lit(i) for i in MOMENTUM_ISSUES])
    raw, simple = F.col("raw_momentum"), F.col("simple_return_pct")
    shown = F.col("simple_return_status")
    low, high = F.date_add("endpoint_start_date", 1), F.date_sub("signal_date", 1)

    def both(a: str, b: str) -> Column:
        return F.array_contains(issues, a) & F.array_contains(issues, b)

    rules = {
        "blank_ticker": F.coalesce(F.trim("ticker"), F.lit("")) == "",
        "not_a_session": F.col("pos").isNull(),
        "endpoint_end_differs": _differs("endpoint_end_date", "signal_date"),
        "endpoint_start_differs": _differs("endpoint_start_date", "back_252"),
        "prospective_session_differs": _differs("first_prospective_session", "next_session"),
        "simple_return_too_low": simple <= -100,
        "eligibility_differs": eligible != (status == "eligible"),
        "unknown_issue": ~eligible & (F.size(F.array_except(issues, allowed)) > 0),
        "contradictory_status": both("missing_start_row", "missing_start_adjusted_close")
        | both("missing_end_row", "missing_end_adjusted_close"),
        "eligible_without_values": eligible
        & (raw.isNull() | F.col("start_adjusted_close").isNull() | F.col("end_adjusted_close").isNull()),
        "simple_return_status_differs": (eligible & ~shown.isin("available", "exceeds_float64_range"))
        | (eligible & ((shown == "available") != simple.isNotNull()))
        | (~eligible & (shown != "endpoint_ineligible")),
        "ineligible_with_values": ~eligible & (raw.isNotNull() | simple.isNotNull()),
        "missing_row_dates": _bad_dates(
            "interior_missing_row_dates", "interior_missing_row_count", low, high, calendar
        ),
        "missing_value_dates": _bad_dates(
            "interior_missing_adjusted_close_dates", "interior_missing_adjusted_close_count", low, high, calendar
        ),
        "overlapping_diagnostics": F.arrays_overlap(
            "interior_missing_row_dates", "interior_missing_adjusted_close_dates"
        ),
        **_percentile_rules("raw_momentum", "momentum_percentile", eligible),
    }
    keys = ("ticker", "signal_date")
    return _broken(_with_calendar(momentum, calendar), rules, *keys).unionByName(_repeated(momentum, *keys))


def key_population(frame: DataFrame, prices: DataFrame, calendar: SessionCalendar, first: date, last: date) -> DataFrame:
    """Tickers whose rows are not exactly the sessions from the panel's first date on.

    Distinct dates inside the range that are all sessions and as many as the range has
    are the range, so counting replaces building the ticker × session product.
    """
    wanted = calendar.index_until(last) - calendar.index_from(first) + 1
    days = calendar.between(frame.sparkSession, first, last).select(F.col("session").alias("signal_date"), F.lit(1).alias("known"))
    rows = (
        frame.join(F.broadcast(days), "signal_date", "left")
        .groupBy("ticker")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("signal_date").alias("dates"), F.count("known").alias("inside"))
    )
    priced = prices.select("ticker").distinct().withColumn("priced", F.lit(1))
    rules = {
        "ticker_without_rows": F.col("rows").isNull(),
        "ticker_without_prices": F.col("priced").isNull(),
        "repeated_dates": F.col("rows") != F.col("dates"),
        "dates_outside_population": F.col("rows") != F.col("inside"),
        "incomplete_sessions": F.col("dates") != wanted,
    }
    return _broken(rows.join(priced, "ticker", "full_outer"), rules, "ticker")


def field_differences(
    stored: DataFrame, expected: DataFrame, keys: list[str], tolerance: dict[str, float] | None = None
) -> DataFrame:
    """Keys and fields on which a stored table differs from its recomputation.

    Correlations add doubles in whatever order tasks finish, so such a field may be
    given an absolute tolerance; every other field must be equal.
    """
    s, e = stored.withColumn("_s", F.lit(1)).alias("s"), expected.withColumn("_e", F.lit(1)).alias("e")
    fields = [c for c in expected.columns if c not in keys]

    def differs(name: str) -> Column:
        a, b = F.col(f"s.{name}"), F.col(f"e.{name}")
        unequal = ~a.eqNullSafe(b)
        if tolerance and name in tolerance:
            unequal = unequal & F.coalesce(F.abs(a - b) > tolerance[name], F.lit(True))
        return F.col("_s").isNotNull() & F.col("_e").isNotNull() & unequal

    names = F.array_compact(
        F.array(
            F.when(F.col("_s").isNull(), F.lit("row_missing")),
            F.when(F.col("_e").isNull(), F.lit("row_unexpected")),
            *[F.when(differs(c), F.lit(c)) for c in fields],
        )
    )
    return s.join(e, keys, "full_outer").select(*keys, F.explode(names).alias("field"))


def dependence_differences(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Dependence rows that differ from their recomputation; the estimate within 1e-9."""

    def keyed(frame: DataFrame) -> DataFrame:
        parts = ("scope", "estimator", "ticker", "signal_date")
        return frame.withColumn("subject", F.concat_ws("|", *[F.col(p).cast("string") for p in parts]))

    found = field_differences(keyed(stored), keyed(expected), ["subject"], {"estimate": 1e-9})
    return found.withColumnRenamed("subject", "ticker")


DIAGNOSTICS = {
    "momentum": (
        "ticker",
        "signal_date",
        "endpoint_status",
        "start_adjusted_close",
        "end_adjusted_close",
        "interior_missing_row_dates",
        "interior_missing_adjusted_close_dates",
    ),
    "volatility": ("ticker", "signal_date", "window_status", "missing_row_dates", "missing_adjusted_close_dates"),
}


def input_diagnostics(stored: DataFrame, recomputed: DataFrame, component: str) -> DataFrame:
    """Signal diagnostics that disagree with the input prices."""
    columns = DIAGNOSTICS[component]
    return field_differences(stored.select(*columns), recomputed.select(*columns), ["ticker", "signal_date"])


def coverage_counts(coverage: DataFrame, universe: DataFrame, expected_sessions: int) -> DataFrame:
    """Coverage rows whose counts, lists or population do not add up."""
    total = F.col("expected_xnys_observation_count")
    rules = {
        "expected_count_differs": total != expected_sessions,
        "counts_do_not_add_up": F.col("present_xnys_observation_count") + F.col("missing_canonical_count") != total,
        "missing_dates_differ": F.size("missing_canonical_dates") != F.col("missing_canonical_count"),
        "missing_values_differ": F.size("missing_adjusted_close_dates") != F.col("missing_adjusted_close_count"),
    }
    population = coverage.select("ticker", F.lit(1).alias("has_row")).join(
        universe.select("ticker", F.lit(1).alias("is_configured")), "ticker", "full_outer"
    )
    members = {
        "instrument_without_row": F.col("has_row").isNull(),
        "row_without_instrument": F.col("is_configured").isNull(),
    }
    return (
        _broken(coverage, rules, "ticker")
        .unionByName(_broken(population, members, "ticker"))
        .unionByName(_repeated(coverage, "ticker"))
    )


def dependence_contract(dependence: DataFrame, instruments: int, sessions: int) -> DataFrame:
    """Dependence rows and totals outside the contract."""
    available = F.col("status") == "available"
    rules = {
        "unknown_scope": ~F.col("scope").isin("per_etf", "per_session"),
        "unknown_estimator": ~F.col("estimator").isin("pearson", "spearman"),
        "status_contradicts_estimate": available != F.col("estimate").isNotNull(),
        "too_few_pairs": available & (F.col("pair_count") < 3),
        "estimate_not_finite": ~is_finite(F.col("estimate")),
    }
    keys = ("scope", "estimator", "ticker", "signal_date")
    total = (
        dependence.groupBy()
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") != 2 * (instruments + sessions))
        .select(
            F.lit("row_count_differs").alias("rule"),
            *[F.lit(None).cast("date" if k == "signal_date" else "string").alias(k) for k in keys],
        )
    )
    return _broken(dependence, rules, *keys).unionByName(_repeated(dependence, *keys)).unionByName(total)


def provenance(metadata: DataFrame, prices: DataFrame) -> DataFrame:
    """Acquisition claims that the stored rows of that very retrieval time contradict."""
    claims = metadata.where(F.col("acquisition_status").isin("success", "empty")).select(
        "ticker",
        "acquisition_status",
        "rows_received",
        "retrieved_at",
        "query_start",
        "query_end_exclusive",
        "first_returned_date",
        "last_returned_date",
    )
    inside = (F.col("date") >= F.col("query_start")) & (F.col("date") < F.col("query_end_exclusive"))
    matched = claims.join(prices.select("ticker", "retrieved_at", "date"), ["ticker", "retrieved_at"], "left")
    summed = matched.groupBy(*claims.columns).agg(
        F.count_if(inside).alias("inside"),
        F.count_if(~inside).alias("outside"),
        F.min(F.when(inside, F.col("date"))).alias("first_inside"),
        F.max(F.when(inside, F.col("date"))).alias("last_inside"),
    )
    success = F.col("acquisition_status") == "success"
    rules = {
        "rows_outside_window": F.col("outside") > 0,
        "empty_claim_has_rows": ~success & (F.col("inside") > 0),
        "row_count_differs": success & (F.col("inside") != F.col("rows_received")),
        "first_date_differs": success & ~F.col("first_inside").eqNullSafe(F.col("first_returned_date")),
        "last_date_differs": success & ~F.col("last_inside").eqNullSafe(F.col("last_returned_date")),
    }
    return _broken(summed, rules, "ticker")


def metadata_contract(metadata: DataFrame, mode: str, start: date, end: date) -> DataFrame:
    """Ticker metadata that contradict the mode, the request window or themselves."""
    status = F.col("acquisition_status")
    asked = status != "not_requested"
    claims = ("error", "rows_received", "retrieved_at", "query_start", "query_end_exclusive",
              "first_returned_date", "last_returned_date")
    none_claimed = F.coalesce(*[F.col(c).cast("string") for c in claims]).isNull()
    first, last = F.col("first_returned_date"), F.col("last_returned_date")
    shown = F.coalesce(F.col("error"), F.lit(""))
    input_first, input_last = F.col("input_first_retrieved_at"), F.col("input_last_retrieved_at")
    rules = {
        "unknown_status": ~status.isin("not_requested", "success", "empty", "failed"),
        "status_contradicts_mode": (F.lit(mode) == "offline") == asked,
        "input_extrema_differ": input_first.isNull() != input_last.isNull(),
        "input_extrema_reversed": input_first > input_last,
        "offline_with_claims": ~asked & ~none_claimed,
        "query_window_differs": asked
        & ~(F.col("query_start").eqNullSafe(F.lit(start)) & F.col("query_end_exclusive").eqNullSafe(F.lit(end))),
        "invalid_success": (status == "success")
        & ~F.coalesce(
            (F.col("rows_received") > 0)
            & F.col("error").isNull()
            & F.col("retrieved_at").isNotNull()
            & (first <= last)
            & (first >= F.col("query_start"))
            & (last < F.col("query_end_exclusive")),
            F.lit(False),
        ),
        "invalid_empty": (status == "empty")
        & ~F.coalesce(
            (F.col("rows_received") == 0)
            & F.col("error").isNull()
            & first.isNull()
            & last.isNull()
            & F.col("retrieved_at").isNotNull(),
            F.lit(False),
        ),
        "invalid_failed": (status == "failed")
        & ~F.coalesce(
            (F.col("rows_received") == 0)
            & (shown != "")
            & (shown == F.trim(shown))
            & first.isNull()
            & last.isNull()
            & F.col("retrieved_at").isNull(),
            F.lit(False),
        ),
    }
    return _broken(metadata, rules, "ticker")


REGENERATION_KEYS = ("scope", "estimator", "ticker", "date", "signal_date")


DIFFERENCES = T.StructType().add("artifact", "string").add("only_in", "string").add("rows", "long")


def regeneration(stored: dict[str, DataFrame], recomputed: dict[str, DataFrame]) -> DataFrame:
    """Per artifact: rows that only the stored or only the recomputed table has.

    Digests of key ranges are compared first, and rows, by their hashes, only where those differ. Artifacts
    are compared side by side.
    """
    spark = next(iter(recomputed.values())).sparkSession

    def differing(name: str) -> DataFrame | None:
        fresh = recomputed[name]
        held = stored[name].select(*fresh.columns)
        key = [c for c in REGENERATION_KEYS if c in fresh.columns]
        if [f.dataType for f in held.schema] != [f.dataType for f in fresh.schema]:
            return frame_difference(held, fresh).groupBy("only_in").agg(F.sum(F.abs("surplus")).alias("rows"))
        nodes = differing_nodes(held, fresh, key)
        return nodes and hash_difference(in_nodes(held, key, nodes), in_nodes(fresh, key, nodes))

    found = zip(recomputed, side_by_side(spark, *[partial(differing, name) for name in recomputed]), strict=True)
    parts = [rows.select(F.lit(name).alias("artifact"), "only_in", "rows") for name, rows in found if rows is not None]
    return reduce(DataFrame.unionByName, parts) if parts else no_rows(spark, DIFFERENCES)


MANIFEST_FIELDS = (
    "run_id",
    "created_at",
    "mode",
    "captured_at",
    "target_session",
    "request_start",
    "request_end_exclusive",
    "universe_sha256",
    "context",
    "artifacts",
)
ARTIFACT_FIELDS = ("artifact", "filename", "fields", "schema", "row_count", "digest")
TARGET_FIELDS = ("captured_at", "target_session", "request_start", "request_end_exclusive")
INSTANT = "%Y-%m-%dT%H:%M:%S.%fZ"


def _parsed(text: object, read) -> object:
    """What a manifest text stands for, or None where it is not of that form."""
    try:
        return read(text) if isinstance(text, str) else None
    except ValueError:
        return None


def _instant(text: str) -> datetime:
    return datetime.strptime(text, INSTANT).replace(tzinfo=timezone.utc)


def manifest_problems(
    spark: SparkSession, manifest: dict, run: str, universe_sha256: str, history_start: date | None = None
) -> list[tuple[str, str]]:
    """Rules the manifest of the folder `run` breaks, each with the field it concerns.

    The manifest is one small document; the tables it describes are checked elsewhere. The
    claims of one field are compared with the folder's name, with each other, and with what
    follows from the captured instant.
    """
    found = [("field_missing", f) for f in MANIFEST_FIELDS if f not in manifest]
    found += [("field_unknown", f) for f in manifest if f not in MANIFEST_FIELDS]
    created = _parsed(manifest.get("created_at"), _instant)
    captured = _parsed(manifest.get("captured_at"), _instant)
    days = {f: _parsed(manifest.get(f), date.fromisoformat) for f in TARGET_FIELDS[1:]}
    forms = {"created_at": created, "captured_at": captured, **days}
    found += [("malformed", f) for f, value in forms.items() if f in manifest and value is None]
    if manifest.get("run_id") != run:
        found.append(("differs_from_folder", "run_id"))
    if created and manifest.get("run_id") != created.strftime(RUN_STAMP):
        found.append(("differs_from_creation", "run_id"))
    if created and captured and created < captured:
        found.append(("before_capture", "created_at"))
    if manifest.get("mode") not in ("offline", "refresh"):
        found.append(("unknown_value", "mode"))
    if not re.fullmatch("[0-9a-f]{64}", str(manifest.get("universe_sha256"))):
        found.append(("malformed", "universe_sha256"))
    elif manifest["universe_sha256"] != universe_sha256:
        found.append(("differs_from_universe", "universe_sha256"))
    start = history_start or date.fromisoformat(HISTORY_START)
    if days["request_start"] and days["request_start"] != start:
        found.append(("differs_from_history_start", "request_start"))
    if captured and all(days.values()):
        try:
            follows = resolve_target(spark, captured, start)
        except ValueError:
            found.append(("has_no_target", "captured_at"))
        else:
            if days["target_session"] != follows.target_session:
                found.append(("differs_from_capture", "target_session"))
            if days["request_end_exclusive"] != follows.request_end:
                found.append(("differs_from_capture", "request_end_exclusive"))
    artifacts = manifest.get("artifacts")
    artifacts = artifacts if isinstance(artifacts, dict) else {}
    found += [("artifact_missing", a) for a in ARTIFACTS if a not in artifacts]
    for name, claims in artifacts.items():
        if name not in ARTIFACTS:
            found.append(("artifact_unknown", name))
        elif not isinstance(claims, dict) or set(claims) != set(ARTIFACT_FIELDS):
            found.append(("artifact_fields_differ", name))
        elif claims["artifact"] != name or claims["filename"] != f"{name}.parquet":
            found.append(("artifact_name_differs", name))
        elif type(claims["row_count"]) is not int or claims["row_count"] < 0:
            found.append(("malformed_row_count", name))
    return found


def evaluation_target(manifest: dict) -> EvaluationTarget:
    return EvaluationTarget(
        datetime.fromisoformat(manifest["captured_at"]),
        date.fromisoformat(manifest["target_session"]),
        date.fromisoformat(manifest["request_start"]),
        date.fromisoformat(manifest["request_end_exclusive"]),
    )
