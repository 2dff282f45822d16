"""The portable digest against a plain reading of its definition, and the tree that narrows differences."""

from __future__ import annotations

import hashlib
import math
import random
from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from tickerloom.functions import digests as dg
from tickerloom.operators.vintages import frame_difference
from tickerloom.plans import verify as vf


def plain_double(x):
    if math.isnan(x):
        return "nan"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x == 0:
        return "0"
    fraction, exponent = math.frexp(abs(x))
    return f"{'-' if x < 0 else ''}{int(math.ldexp(fraction, 53))}e{exponent - 1}"


def test_double_texts(spark):
    r = random.Random(6)
    values = [0.0, -0.0, 1.0, -1.0, 0.1, 2.0**52, 2.0**53 - 1, math.pi, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    values += [math.inf, -math.inf, math.nan, *(2.0**k for k in range(-1074, 1024, 7)), *(math.nextafter(2.0**k, 0) for k in range(-1000, 1000, 13))]
    values += [r.uniform(-1, 1) * 10 ** r.randrange(-300, 300) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", dg.double_text(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in rows] == [plain_double(r["x"]) for r in rows]


def test_digest_by_its_definition(spark):
    at = datetime(2024, 1, 2, 3, 4, 5, 678901, tzinfo=timezone.utc)
    rows = [("a:1", 1.5, date(2024, 1, 2), at, [1, None], True), (None, None, None, None, None, None), ("é", -0.25, date(1999, 12, 31), at, [], False)]
    schema = "s string, x double, d date, t timestamp, l array<bigint>, b boolean"

    def frame(x):
        return "n" if x is None else f"{len(x)}:{x}"

    def text(s, x, d, t, items, b):
        parts = [s, None if x is None else plain_double(x), d and d.isoformat(), t and str(int(t.timestamp()) * 10**6 + t.microsecond)]
        parts += [None if items is None else "".join(frame(None if i is None else str(i)) for i in items), None if b is None else str(b).lower()]
        return "".join(map(frame, parts))

    lanes = [0] * 4
    for row in rows + rows[:1]:
        h = hashlib.md5(text(*row).encode()).hexdigest()
        lanes = [(n + int(h[8 * i : 8 * i + 8], 16)) % 2**64 for i, n in enumerate(lanes)]
    found = dg.content_digest(spark.createDataFrame(rows[::-1] + rows[:1], schema).repartition(3)).first()
    assert tuple(found) == (4, ":".join(map(str, lanes)))
    assert tuple(dg.content_digest(spark.createDataFrame([], schema)).first()) == (0, "0:0:0:0")


def test_only_rows_of_differing_nodes_are_compared(spark):
    table = spark.range(5000).select(
        F.format_string("T%03d", F.col("id") % 50).alias("ticker"), F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") / 50).cast("int")).alias("signal_date"), F.sqrt("id").alias("x")
    )
    key = ["ticker", "signal_date"]
    assert dg.differing_nodes(table, table.repartition(7), key) is None
    odd = (F.col("ticker") == "T007") & (F.col("signal_date") == "2020-02-01")
    changed = table.withColumn("x", F.when(odd, F.col("x") + 1e-9).otherwise(F.col("x")))
    nodes = dg.differing_nodes(table, changed, key)
    assert nodes[0] == dg.DEPTH - 1 and len(nodes) == 2
    assert dg.in_nodes(table, key, nodes).count() <= 3
    found = {r["only_in"]: r["rows"] for r in vf.regeneration({"m": changed}, {"m": table}).collect()}
    assert found == {"left": 1, "right": 1}
    # A lost row, a repeated one, and tables that differ everywhere.
    assert {r["only_in"]: r["rows"] for r in vf.regeneration({"m": table.where(~odd)}, {"m": table}).collect()} == {"right": 1}
    doubled = table.unionByName(table.where(odd))
    assert {r["only_in"]: r["rows"] for r in vf.regeneration({"m": doubled}, {"m": table}).collect()} == {"left": 1}
    other = table.withColumn("x", F.col("x") + 1)
    assert len(dg.differing_nodes(table, other, key)) > dg.FANOUT // 4
    assert {r["only_in"]: r["rows"] for r in vf.regeneration({"m": other}, {"m": table}).collect()} == {"left": 5000, "right": 5000}
    assert vf.regeneration({"m": table}, {"m": table}).isEmpty()
    assert frame_difference(table, table).isEmpty()


def test_each_step_of_a_digest_is_computed_once_per_row(spark):
    frame = spark.range(9).select(F.col("id").cast("double").alias("x"), F.sqrt("id").alias("y.z"), F.array(F.lit(date(2024, 1, 2))).alias("l"))
    plan = dg.content_digest(frame)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("log2(") == 2 and plan.count("md5(") == 1 and plan.count("power(") + plan.count("pow(") == 8


def test_nulls_inside_nested_values_keep_their_mark(spark):
    rows = [(None, None, None), ([None, date(2024, 1, 2)], (None, None), [1.5, None]), ([], (0.1, ""), [math.inf])]
    frame = spark.createDataFrame(rows, "l array<date>, s struct<x: double, t: string>, xs array<double>")
    kinds = [f.dataType for f in frame.schema]
    texts = frame.select(*[dg.framed(dg.value_text(F.col(c), k)).alias(c) for c, k in zip(frame.columns, kinds, strict=True)]).collect()
    half = f"{len(plain_double(1.5))}:{plain_double(1.5)}"
    tenth = f"{len(plain_double(0.1))}:{plain_double(0.1)}0:"
    assert [tuple(r) for r in texts] == [
        ("n", "n", "n"),
        ("14:n10:2024-01-02", "2:nn", f"{len(half) + 1}:{half}n"),
        ("0:", f"{len(tenth)}:{tenth}", "5:3:inf"),
    ]


def test_rows_are_compared_without_their_texts(spark):
    rows = [(1, 0.0, None, None), (1, -0.0, None, None), (2, math.nan, [], "")]
    schema = "k int, x double, l array<date>, s string"
    day = date(1970, 1, 2)
    odd = [(3, None, [None], "a"), (3, None, [day], "a"), (3, None, [day, None], "a"), (3, None, [None, day], "a"), (3, 1.0, None, "a")]
    held, fresh = spark.createDataFrame(rows + odd, schema), spark.createDataFrame(rows[::-1], schema)
    assert dg.differing_nodes(held.limit(3), fresh, ["k"]) is None
    assert dg.row_hashes(held).distinct().count() == 2 + len(odd)
    plan = dg.row_hashes(held)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "md5(" not in plan and plan.count("xxhash64(") == 2
    assert {r["only_in"]: r["rows"] for r in dg.hash_difference(held, fresh).collect()} == {"left": len(odd)}
    assert dg.hash_difference(fresh, fresh).isEmpty()
