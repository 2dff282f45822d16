from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import AT, bar, later, panel, sessions, wave
from tickerloom.operators import quality as ql
from tickerloom.operators import vintages as vt
from tickerloom.functions.digests import content_digest
from tickerloom.plans.publish import classify_runs
from tickerloom.schemas import PRICE_COLUMNS, PRICE_SCHEMA, PRICE_VALUES, SHARE_SCHEMA, ContractError, check_columns
from tickerloom.sources import tables as tb

DAY = date(2024, 1, 3)
DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PRICE_SCHEMA)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


def broken(spark, *rows, rules=None):
    return sorted(r["rule"] for r in ql.violations(table(spark, *rows), rules or ql.price_rules()).collect())


@pytest.mark.parametrize(
    "changes, rules",
    [
        ({}, []),
        ({"open": float("nan")}, ["high_below_open", "nonfinite_open"]),
        ({"volume": float("inf")}, ["nonfinite_volume"]),
        ({"ticker": "  "}, ["blank_ticker"]),
        ({"date": None}, ["missing_date"]),
        ({"retrieved_at": None}, ["missing_retrieved_at"]),
        ({c: None for c in PRICE_VALUES}, ["no_market_value"]),
        ({c: None for c in PRICE_VALUES if c != "volume"}, []),
        ({"adjusted_close": 0.0}, ["nonpositive_adjusted_close"]),
        ({"volume": 0.0}, []),
        ({"volume": -1.0}, ["negative_volume"]),
        ({"high": 8.0}, ["high_below_close", "high_below_low", "high_below_open"]),
        ({"low": 11.5}, ["low_above_close", "low_above_open"]),
        ({"high": None, "low": None}, []),
        ({"open": None, "high": 11.0}, []),
    ],
)
def test_price_rules(spark, changes, rules):
    assert broken(spark, bar(changes.pop("date", DAY), changes.pop("ticker", "A"), changes.pop("adjusted_close", 5.0), **changes)) == rules


def test_duplicate_keys_and_reporting_order(spark):
    rows = [bar(DAY, "A", 1.0), bar(DAY, "A", 1.0), bar(DAY, "B", -1.0)]
    assert broken(spark, *rows) == ["duplicate_key", "nonpositive_adjusted_close"]
    with pytest.raises(ContractError, match="duplicate_key"):
        ql.validate_prices(table(spark, *rows))
    ql.validate_prices(table(spark, rows[0]))


def test_examples_are_limited_below_the_shuffle(spark):
    many = table(spark, *[bar(DAY, f"T{i:04}", -1.0, volume=-1.0) for i in range(300)])
    limited = ql.first_examples(ql.violations(many, ql.price_rules()))
    found = sorted((r["rule"], r["ticker"]) for r in limited.collect())
    first = [f"T{i:04}" for i in range(5)]
    assert found == [(rule, t) for rule in ("negative_volume", "nonpositive_adjusted_close") for t in first]
    plan = limited._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_schema_checks(spark):
    good = table(spark, bar(DAY, "A", 1.0))
    assert check_columns(good.select(*reversed(good.columns)), PRICE_SCHEMA).columns == list(PRICE_COLUMNS)
    for bad in (
        good.drop("volume"),
        good.withColumn("extra", F.lit(1)),
        good.withColumn("open", F.lit(True)),
        good.withColumn("open", F.lit("1")),
        good.withColumn("open", F.lit(1).cast("decimal(10,2)")),
        good.select("*", F.lit(1).alias("open")),
        good.withColumn("date", F.col("date").cast("timestamp")),
    ):
        with pytest.raises(ContractError):
            check_columns(bad, PRICE_SCHEMA)
    check_columns(good.withColumn("volume", F.col("volume").cast("int")), PRICE_SCHEMA)
    check_columns(good.withColumn("volume", F.col("volume").cast("decimal(20,0)")), PRICE_SCHEMA)


def test_share_rules(spark):
    # A feed may still hold doubles; the store turns them into exact counts.
    schema = "date date, ticker string, shares_outstanding double, retrieved_at timestamp"
    check_columns(spark.createDataFrame([], schema), SHARE_SCHEMA)
    df = spark.createDataFrame(
        [(DAY, "A", None, AT), (DAY, "B", 0.0, AT), (DAY, "C", float("inf"), AT), (DAY, "D", 5.0, AT)], schema
    )
    found = {(r["ticker"], r["rule"]) for r in ql.violations(df, ql.share_rules()).collect()}
    assert found == {("B", "nonpositive_shares_outstanding"), ("C", "nonfinite_shares_outstanding")}


def test_lossless_types(spark):
    df = spark.createDataFrame([(2**53 + 1,), (None,)], "n bigint")
    assert [r["n"] for r in ql.lossy_casts(df, "n", "double").collect()] == [2**53 + 1]
    with pytest.raises(ContractError):
        ql.widen_losslessly(df, "n", "double")
    floats = spark.createDataFrame([(1.5,)], "n double")
    small = spark.createDataFrame([(7,)], "n int")
    assert ql.common_numeric_type([small, floats], "n") == "double"
    assert ql.common_numeric_type([small, df], "n") == "bigint"
    with pytest.raises(ContractError):
        ql.common_numeric_type([df, floats], "n")
    assert ql.union_losslessly([small, floats], ("n",)).schema["n"].dataType == T.DoubleType()


def test_deduplication(spark):
    rows = [
        bar(DAY, "A", 1.0, AT),
        bar(DAY, "A", 1.0, later(2)),
        bar(DAY, "B", None, AT),
        bar(DAY, "B", None, AT),
        bar(DAY, "C", 1.0, AT),
        bar(DAY, "C", None, AT),
        bar(DAY, "D", 1.0, AT),
        bar(DAY, "D", 2.0, AT),
    ]
    df = table(spark, *rows)
    kept = {r["ticker"]: r for r in vt.deduplicate(df, PRICE_VALUES).collect()}
    assert set(kept) == {"A", "B"} and kept["A"]["retrieved_at"] == later(2).replace(tzinfo=None)
    assert {r["ticker"] for r in vt.duplicate_conflicts(df, PRICE_VALUES).collect()} == {"C", "D"}
    with pytest.raises(ContractError):
        vt.deduplicate_strict(df, PRICE_VALUES)


@pytest.mark.parametrize(
    "old, new, action, value, hours",
    [
        ((5.0, 0), None, "existing_only", 5.0, 0),
        (None, (6.0, 1), "new", 6.0, 1),
        ((5.0, 1), (5.0, 1), "identical", 5.0, 1),
        ((5.0, 1), (5.0, 0), "identical", 5.0, 1),
        ((5.0, 0), (5.0, 1), "advance", 5.0, 1),
        ((None, 0), (None, 2), "advance", None, 2),
        ((5.0, 0), (None, 9), "lose", 5.0, 0),
        ((5.0, 2), (6.0, 1), "stale", 5.0, 2),
        ((5.0, 1), (6.0, 1), "conflict", 5.0, 1),
        ((5.0, 0), (6.0, 1), "revise", 6.0, 1),
        ((None, 0), (6.0, 1), "revise", 6.0, 1),
    ],
)
def test_vintage_actions(spark, old, new, action, value, hours):
    def side(cell):
        return table(spark, *([bar(DAY, "A", cell[0], later(cell[1]))] if cell else []))

    row = vt.vintage_actions(side(old), side(new), PRICE_VALUES).first()
    assert (row["action"], row["adjusted_close"]) == (action, value)
    assert row["retrieved_at"] == later(hours).replace(tzinfo=None)


def test_whole_row_is_replaced(spark):
    old = table(spark, bar(DAY, "A", 5.0, AT, open=None, volume=7.0))
    new = table(spark, bar(DAY, "A", 5.0, later(1), open=9.5, volume=8.0))
    row = vt.vintage_actions(old, new, PRICE_VALUES).first()
    assert row["action"] == "revise" and (row["open"], row["volume"]) == (9.5, 8.0)


def test_vanished_rows_only_for_success_inside_the_window(spark):
    days = sessions(4)
    stored = panel(spark, {t: [1.0] * 4 for t in ("OK", "FAILED", "OTHER")})
    statuses = spark.createDataFrame(
        [
            ("OK", "success", days[1], days[3], [days[1]]),
            ("FAILED", "failed", days[0], days[3], []),
        ],
        "ticker string, status string, query_start date, query_end date, returned_dates array<date>",
    )
    assert [tuple(r) for r in vt.vanished_rows(stored, statuses).collect()] == [("OK", days[2])]


def test_frame_difference_counts_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, [3])], "k int, v array<int>")
    b = spark.createDataFrame([(1, None), (2, [3])], "k int, v array<int>")
    assert [(r["k"], r["surplus"], r["only_in"]) for r in vt.frame_difference(a, b).collect()] == [(1, 1, "left")]
    assert vt.frame_difference(b, b).isEmpty()


def test_long_numbers_are_not_cut(spark):
    row = spark.range(1).select(
        tb.desk_name(F.lit(50_000_001)), tb.desk_name(F.lit(7)), tb.supplier_name(F.lit(10_000_000_001))
    ).first()
    assert tuple(row) == ("DESK50000001", "DESK0000007", "SUP10000000001")


def test_panel_counts_every_line(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    shipped = tb.shipped_lines(spark, "/root/testdata/sf0.001")
    assert shipped.count() == lines.count() and shipped.where("date is null").isEmpty()


def test_digest_sees_where_a_null_is(spark):
    schema = "ticker string, open double, high double"
    digests = [
        content_digest(spark.createDataFrame([row], schema)).first()["digest"]
        for row in (("A", None, 5.0), ("A", 5.0, None))
    ]
    assert digests[0] != digests[1]


def test_folder_names(spark):
    stem = "20240102T030405000006Z"
    names = [stem, f".{stem}.tmp-1", f"{stem}.invalid-1", "note.tmp-1", f".{stem}.invalid-1.tmp-1", "x"]
    rows = classify_runs(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert [r["kind"] for r in rows] == ["run", "temporary", "quarantined", "rejected", "temporary", "rejected"]
