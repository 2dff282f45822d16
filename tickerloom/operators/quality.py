"""Row and table rules of the canonical tables, reported as violation rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import is_finite
from tickerloom.schemas import (
    KEY,
    POSITIVE_PRICES,
    PRICE_VALUES,
    SHARE_VALUES,
    ContractError,
)

EXAMPLES = 5


@dataclass(frozen=True)
class Rule:
    """A named row predicate; lower priority is reported first."""

    priority: int
    name: str
    broken: Column


def _finite_rules(values: tuple[str, ...]) -> list[Rule]:
    return [Rule(10 + i, f"nonfinite_{c}", ~is_finite(F.col(c).cast("double"))) for i, c in enumerate(values)]


def key_rules() -> list[Rule]:
    return [
        Rule(20, "blank_ticker", F.coalesce(F.trim("ticker"), F.lit("")) == ""),
        Rule(21, "missing_date", F.col("date").isNull()),
        Rule(22, "missing_retrieved_at", F.col("retrieved_at").isNull()),
    ]


def ohlc_rules() -> list[Rule]:
    ordered = (("high", "open"), ("high", "close"), ("high", "low"), ("open", "low"), ("close", "low"))
    names = ("high_below_open", "high_below_close", "high_below_low", "low_above_open", "low_above_close")
    # A comparison with a null is null, and a null predicate breaks nothing.
    return [
        Rule(60 + i, name, F.col(above) < F.col(below))
        for i, (name, (above, below)) in enumerate(zip(names, ordered))
    ]


def positive_rules(columns: tuple[str, ...]) -> list[Rule]:
    return [Rule(41 + i, f"nonpositive_{c}", F.col(c) <= 0) for i, c in enumerate(columns)]


def price_rules() -> list[Rule]:
    """All price row rules in reporting order."""
    return [
        *_finite_rules(PRICE_VALUES),
        *key_rules(),
        Rule(40, "no_market_value", F.coalesce(*PRICE_VALUES).isNull()),
        *positive_rules(POSITIVE_PRICES),
        Rule(50, "negative_volume", F.col("volume") < 0),
        *ohlc_rules(),
    ]


def share_rules() -> list[Rule]:
    # Shares check their keys before their values, and a dated null is valid.
    finite = [Rule(25, r.name, r.broken) for r in _finite_rules(SHARE_VALUES)]
    return [*key_rules(), *finite, *positive_rules(SHARE_VALUES)]


def row_violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per broken rule and input row, from a single pass over the table."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(r.broken, F.struct(F.lit(r.priority).alias("priority"), F.lit(r.name).alias("rule")))
                for r in rules
            ]
        )
    )
    return df.select(F.inline(hits), "ticker", "date")


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Row violations and duplicate keys of one table."""
    doubled = duplicate_keys(df).select(
        F.lit(30).alias("priority"), F.lit("duplicate_key").alias("rule"), "ticker", "date"
    )
    return row_violations(df, rules).unionByName(doubled)


def outside_window_rule(start: date, end: date) -> Rule:
    """The half-open request window; any row outside fails its whole ticker."""
    return Rule(70, "outside_request_window", (F.col("date") < F.lit(start)) | (F.col("date") >= F.lit(end)))


def outside_window(df: DataFrame, start: date, end: date) -> DataFrame:
    return row_violations(df, [outside_window_rule(start, end)])


def first_examples(found: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """The first examples of every rule by key.

    The limit on the rank reaches below the shuffle, so a rule that a third of all
    rows break still sends only a handful of rows per task.
    """
    order = Window.partitionBy("priority", "rule").orderBy(
        F.col("ticker").asc_nulls_first(), F.col("date").asc_nulls_first()
    )
    return found.withColumn("example", F.row_number().over(order)).where(F.col("example") <= limit)


def require_none(found: DataFrame, what: str) -> None:
    """Raise with the first rule in reporting order and its examples, or return."""
    rows = first_examples(found).orderBy("priority", "rule", "example").limit(EXAMPLES).collect()
    if rows:
        first = [f"{r['ticker']}@{r['date']}" for r in rows if r["rule"] == rows[0]["rule"]]
        raise ContractError(f"{what} break rule '{rows[0]['rule']}': {first}")


def validate_prices(df: DataFrame) -> None:
    require_none(violations(df, price_rules()), "price rows")


def validate_shares(df: DataFrame) -> None:
    require_none(violations(df, share_rules()), "share rows")


def lossy_casts(df: DataFrame, column: str, target: str) -> DataFrame:
    """Rows whose value would change in the cast; a wider type must hold every value."""
    source = df.schema[column].dataType.simpleString()
    round_trip = F.col(column).try_cast(target).try_cast(source)
    return df.where(~round_trip.eqNullSafe(F.col(column)))


def widen_losslessly(df: DataFrame, column: str, target: str) -> DataFrame:
    """Cast a column after checking that no value changes."""
    if not lossy_casts(df, column, target).isEmpty():
        raise ContractError(f"column '{column}' has values that {target} cannot hold exactly")
    return df.withColumn(column, F.col(column).cast(target))


WHOLE_AND_REAL = ("bigint", "decimal(20,0)", "double")


def common_numeric_type(frames: list[DataFrame], column: str) -> str:
    """The first type that holds every value of the column in all frames exactly.

    One aggregate per frame counts the values each type would change.
    """
    fits = set(WHOLE_AND_REAL)
    for df in frames:
        source = df.schema[column].dataType.simpleString()
        value = F.col(column)
        changed = [~value.try_cast(t).try_cast(source).eqNullSafe(value) for t in WHOLE_AND_REAL]
        counts = df.agg(*(F.count_if(c) for c in changed)).first()
        fits &= {t for t, n in zip(WHOLE_AND_REAL, counts, strict=True) if not n}
    for target in WHOLE_AND_REAL:
        if target in fits:
            return target
    raise ContractError(f"no common type holds every value of column '{column}' exactly")


def union_losslessly(frames: list[DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """Union tables whose numeric columns may differ in type, without changing a value."""
    for column in columns:
        target = common_numeric_type(frames, column)
        frames = [df.withColumn(column, F.col(column).cast(target)) for df in frames]
    combined = frames[0]
    for more in frames[1:]:
        combined = combined.unionByName(more)
    return combined
