"""Provider JSON and wide or flat provider tables to canonical rows.

Landing data come as one payload text per requested ticker, with the response's
``retrieved_at``. Variants keep the JSON type of every value, so "numeric or null
only" can be checked without guessing from text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.labels import PROVIDER_FIELDS, REQUIRED_FIELDS
from tickerloom.functions.numeric import casts_losslessly, exact_decimal_text, exact_double, exact_value
from tickerloom.schemas import EXACT_SHARE_TYPE, PRICE_COLUMNS, PRICE_VALUES, SHARE_COLUMNS, ContractError

# Where a chart payload keeps its fields.
CHART_RESULT = "$.chart.result"
CHART_ERROR = "$.chart.error"
CHART_QUOTE = "$.chart.result[0].indicators.quote"
CHART_ADJUSTED = "$.chart.result[0].indicators.adjclose"
CHART_TIMES = "$.chart.result[0].timestamp"
SHARES_RESULT = "$.timeseries.result"
SHARES_ERROR = "$.finance.error"
SHARES_TIMES = "$.timeseries.result[0].timestamp"
SHARES_VALUES = "$.timeseries.result[0].shares_out"

EXACT_WHOLE = 2.0**53
_NUMBER = r"(VOID|BIGINT|FLOAT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\))"


def _kind(path: str) -> Column:
    """JSON type at a path; null when the path is absent."""
    return F.schema_of_variant(F.try_variant_get(F.col("v"), path, "variant"))


def _text(path: str) -> Column:
    return F.try_variant_get(F.col("v"), path, "string")


def _items(path: str) -> Column:
    return F.size(F.try_variant_get(F.col("v"), path, "array<variant>"))


def _is_object(path: str) -> Column:
    return F.coalesce(_kind(path).startswith("OBJECT"), F.lit(False))


def _absent(path: str) -> Column:
    kind = _kind(path)
    return kind.isNull() | (kind == "VOID")


def _number_list(path: str, whole: bool = False) -> Column:
    """True for a list of numbers and nulls (whole numbers only, if asked)."""
    kinds = r"(BIGINT|DECIMAL\([0-9]+,0\))" if whole else _NUMBER
    return F.coalesce(_kind(path).rlike(rf"^ARRAY<{kinds}>$") | (_items(path) == 0), F.lit(False))


def _no_nulls(path: str) -> Column:
    items = F.try_variant_get(F.col("v"), path, "array<variant>")
    return ~F.exists(items, lambda x: x.isNull() | F.is_variant_null(x))


def _inexact_wholes(path: str) -> Column:
    """True when a whole number in the list changes on its way to a double, or passes 64 bits."""
    texts = F.try_variant_get(F.col("v"), path, "array<string>")
    whole = F.filter(texts, lambda x: x.rlike("^-?[0-9]+$"))

    def exact(x: Column) -> Column:
        return F.coalesce(x.try_cast("double").try_cast("bigint") == x.try_cast("bigint"), F.lit(False))

    return F.coalesce(F.exists(whole, lambda x: ~exact(x)), F.lit(False))


def _first_issue(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(broken, F.lit(text)) for broken, text in checks])


def _valid_symbol(symbol: Column) -> Column:
    return F.coalesce((symbol != "") & (symbol == F.trim(symbol)), F.lit(False))


_LIST = "array<double>"
_CHART = (
    "chart struct<error: string, result: array<struct<"
    "meta: struct<symbol: string, exchangeTimezoneName: string>, timestamp: array<bigint>, "
    f"indicators: struct<quote: array<struct<{', '.join(f'{c}: {_LIST}' for c in REQUIRED_FIELDS)}>>, "
    f"adjclose: array<struct<adjclose: {_LIST}>>>>>>, bad string"
)


def _chart_type_issue() -> Column:
    """What has the wrong JSON type, for the payloads that did not fit the typed schema."""
    fields = {c: f"{CHART_QUOTE}[0].{c}" for c in REQUIRED_FIELDS}
    no_times = _absent(CHART_TIMES) | (_items(CHART_TIMES) == 0)
    adjusted = f"{CHART_ADJUSTED}[0].adjclose"
    return F.coalesce(
        _first_issue(
            (~_is_object("$"), "payload is not an object"),
            (~_is_object("$.chart"), "chart object is missing"),
            (~_absent(CHART_ERROR), "provider reported an error"),
            (_items(CHART_RESULT).isNull(), "result list is missing"),
            ((_items(CHART_RESULT) != 1) | ~_is_object(f"{CHART_RESULT}[0]"), "result must hold one object"),
            (~_is_object(f"{CHART_RESULT}[0].meta"), "meta object is missing"),
            (
                F.coalesce(_items(CHART_QUOTE) != 1, F.lit(True)) | ~_is_object(f"{CHART_QUOTE}[0]"),
                "quote indicator is missing",
            ),
            (
                ~no_times & ~(_number_list(CHART_TIMES, whole=True) & _no_nulls(CHART_TIMES)),
                "timestamps are not whole epochs",
            ),
            *[(~no_times & ~_number_list(p), f"field {c} is malformed") for c, p in fields.items()],
            (~no_times & ~_absent(CHART_ADJUSTED) & ~_number_list(adjusted), "adjusted close is malformed"),
        ),
        F.lit("payload has a value of the wrong type"),
    )


def chart_payloads(landed: DataFrame) -> DataFrame:
    """Parse price payloads: (ticker, payload, retrieved_at) → one row with lists or an error.

    A typed parse reads every payload once; only those with a value that does not fit
    are read again as variants, to say which value it is. Filter on ``issue`` only behind
    a written result: a filter pushed below the parse would repeat it.
    """
    parsed = landed.withColumn(
        "c", F.from_json("payload", _CHART, {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"})
    )
    misfit = F.col("c.bad").isNotNull() | F.col("c").isNull()
    parsed = parsed.withColumns(
        {
            "result": F.col("c.chart.result"),
            "first": F.get("c.chart.result", F.lit(0)),
            "quote": F.get("c.chart.result", F.lit(0))["indicators"]["quote"],
            "adjusted": F.get("c.chart.result", F.lit(0))["indicators"]["adjclose"],
        }
    )
    times = F.col("first.timestamp")
    count = F.size(times)
    some_times = times.isNotNull() & (count > 0)
    lists = {c: F.get("quote", F.lit(0))[c] for c in REQUIRED_FIELDS}
    closes = F.get("adjusted", F.lit(0))["adjclose"]
    symbol, zone = F.col("first.meta.symbol"), F.col("first.meta.exchangeTimezoneName")
    # Doubles hold whole numbers exactly up to 2^53; only beyond that the text is checked.
    huge = reduce(
        or_,
        [
            F.coalesce(F.exists(values, lambda x: F.abs(x) >= EXACT_WHOLE), F.lit(False))
            for values in (*lists.values(), closes)
        ],
    )
    parsed = parsed.withColumn("huge", huge)
    parsed = parsed.withColumn("v", F.when(misfit | F.col("huge"), F.try_parse_json("payload")))
    paths = {c: f"{CHART_QUOTE}[0].{c}" for c in REQUIRED_FIELDS} | {"adjusted close": f"{CHART_ADJUSTED}[0].adjclose"}

    def short(values: Column) -> Column:
        return values.isNull() | (F.size(values) != count)

    issue = F.when(misfit, _chart_type_issue()).otherwise(
        _first_issue(
            (F.col("c.chart").isNull(), "chart object is missing"),
            (F.col("c.chart.error").isNotNull(), "provider reported an error"),
            (F.col("result").isNull(), "result list is missing"),
            (F.size("result") == 0, "result list is empty"),
            ((F.size("result") != 1) | F.col("first").isNull(), "result must hold one object"),
            (F.col("first.meta").isNull(), "meta object is missing"),
            (~_valid_symbol(symbol), "symbol is missing or padded"),
            (symbol != F.upper("ticker"), "symbol differs from the requested ticker"),
            (F.coalesce(zone, F.lit("")) == "", "exchange timezone is missing"),
            (
                F.col("quote").isNull() | (F.size("quote") != 1) | F.get("quote", F.lit(0)).isNull(),
                "quote indicator is missing",
            ),
            (some_times & F.exists(times, lambda t: t.isNull()), "timestamps are not whole epochs"),
            *[(some_times & short(values), f"field {c} is malformed") for c, values in lists.items()],
            (
                some_times & F.col("adjusted").isNotNull() & ((F.size("adjusted") != 1) | short(closes)),
                "adjusted close is malformed",
            ),
            *[(F.col("huge") & _inexact_wholes(p), f"{c} does not fit a double exactly") for c, p in paths.items()],
        )
    )
    return parsed.select(
        "ticker",
        "retrieved_at",
        issue.alias("issue"),
        zone.alias("zone"),
        times.alias("stamp"),
        *[values.alias(c) for c, values in lists.items()],
        closes.alias("adjusted_close"),
    )


def market_date(stamp: Column, zone: Column) -> Column:
    """Exchange-local date of an epoch; a stamp at 22:00 or 23:00 sharp belongs to the next day."""
    local = F.from_utc_timestamp(F.timestamp_seconds(stamp), zone)
    before_midnight = (F.minute(local) == 0) & F.hour(local).isin(22, 23)
    return F.when(before_midnight, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))


def _unpacked(parsed: DataFrame, keep: tuple[str, ...], lists: Column) -> DataFrame:
    """One row per entry of the lists of the payloads without an issue.

    The parse is not followed by a filter that could be pushed below it and repeat it: lists
    of other payloads become null, and the row that the outer form gives for them goes by its
    missing stamp, which no entry lacks.
    """
    valid = F.when(F.col("issue").isNull(), lists)
    return parsed.select(*keep, F.inline_outer(valid)).where("stamp is not null")


def chart_rows(parsed: DataFrame) -> DataFrame:
    """Canonical price rows of the payloads without an issue; nothing is filled in."""
    empty = F.expr("cast(array() as array<double>)")
    adjusted = F.coalesce("adjusted_close", empty).alias("adjusted_close")
    lists = F.arrays_zip("stamp", *REQUIRED_FIELDS, adjusted)
    # Without stamps there are no rows, whatever the other lists hold.
    rows = _unpacked(parsed, ("ticker", "retrieved_at", "zone"), F.when(F.size("stamp") > 0, lists))
    return rows.withColumn("date", market_date(F.col("stamp"), F.col("zone"))).select(*PRICE_COLUMNS)


EXACT_SHARES = EXACT_SHARE_TYPE.simpleString()


def _count_texts() -> Column:
    """Share counts as the payload writes them: no count passes through a double."""
    return F.try_variant_get("v", SHARES_VALUES, "array<string>")


def _unheld_counts() -> Column:
    def unheld(text: Column) -> Column:
        return text.isNotNull() & exact_decimal_text(text, EXACT_SHARES).isNull()

    return F.coalesce(F.exists(_count_texts(), unheld), F.lit(False))


def share_payloads(landed: DataFrame) -> DataFrame:
    """Parse share payloads; a missing value list is a genuine empty answer."""
    parsed = landed.withColumn("v", F.try_parse_json("payload"))
    symbols = f"{SHARES_RESULT}[0].meta.symbol"
    symbol = _text(f"{symbols}[0]")
    nothing = _kind(SHARES_VALUES).isNull()
    issue = _first_issue(
        (~_is_object("$"), "payload is not an object"),
        (~_absent(SHARES_ERROR), "provider reported an error"),
        (~_is_object("$.timeseries"), "timeseries object is missing"),
        (_items(SHARES_RESULT).isNull(), "result list is missing"),
        (_items(SHARES_RESULT) == 0, "result list is empty"),
        (~_is_object(f"{SHARES_RESULT}[0]"), "result is not an object"),
        (~_is_object(f"{SHARES_RESULT}[0].meta"), "meta object is missing"),
        (F.coalesce(_items(symbols) != 1, F.lit(True)) | ~_valid_symbol(symbol), "one symbol is required"),
        (symbol != F.upper("ticker"), "symbol differs from the requested ticker"),
        (~nothing & (_items(SHARES_TIMES).isNull() | _items(SHARES_VALUES).isNull()), "lists are missing"),
        (~nothing & (_items(SHARES_TIMES) != _items(SHARES_VALUES)), "list lengths differ"),
        (~nothing & ~(_number_list(SHARES_TIMES) & _no_nulls(SHARES_TIMES)), "timestamps are not finite numbers"),
        (~nothing & ~_number_list(SHARES_VALUES), "share counts are not numbers"),
        (~nothing & _unheld_counts(), "a share count cannot be held exactly"),
    )
    return parsed.select(
        "ticker",
        "retrieved_at",
        issue.alias("issue"),
        F.try_variant_get("v", SHARES_TIMES, "array<double>").alias("stamp"),
        F.transform(_count_texts(), lambda t: exact_decimal_text(t, EXACT_SHARES)).alias("shares_outstanding"),
    )


def share_rows(parsed: DataFrame) -> DataFrame:
    """Canonical share rows; the date is the UTC date of the epoch, and nulls are kept."""
    lists = F.when(F.size("stamp") > 0, F.arrays_zip("stamp", "shares_outstanding"))
    rows = _unpacked(parsed, ("ticker", "retrieved_at"), lists)
    return rows.select(
        F.to_date(F.timestamp_seconds("stamp")).alias("date"),
        "ticker",
        "shares_outstanding",
        "retrieved_at",
    ).select(*SHARE_COLUMNS)


def _field_of(label: str) -> str | None:
    plain = " ".join(label.strip().casefold().replace("_", " ").split())
    return PROVIDER_FIELDS.get(plain)


def _fields_by_label(labels: list[str], where: str) -> dict[str, str]:
    fields: dict[str, str] = {}
    for label in labels:
        field = _field_of(label)
        if field in fields:
            raise ContractError(f"{where} repeats the price field '{field}'")
        if field:
            fields[field] = label
    missing = sorted(set(REQUIRED_FIELDS) - set(fields))
    if missing:
        raise ContractError(f"{where} lacks the fields {missing}")
    return fields


def _exact(table: DataFrame, label: str) -> Column:
    return exact_double(F.col(f"`{label}`"), table.schema[label].dataType.simpleString(), f"'{label}'")


def normalize_flat(table: DataFrame, ticker: str | Column, retrieved_at: Column, day: str = "date") -> DataFrame:
    """One ticker's flat provider table to canonical rows; an absent adjusted close stays null."""
    fields = _fields_by_label([c for c in table.columns if c != day], "flat table")
    named = F.lit(ticker) if isinstance(ticker, str) else ticker
    return table.select(
        F.to_date(day).alias("date"),
        named.alias("ticker"),
        *[
            (_exact(table, fields[c]) if c in fields else F.lit(None).cast("double")).alias(c)
            for c in PRICE_VALUES
        ],
        retrieved_at.alias("retrieved_at"),
    )


def inexact_prices(table: DataFrame, labels: list[str]) -> DataFrame:
    """Rows of a provider table with a value that a double cannot hold exactly."""
    broken = F.lit(False)
    for label in labels:
        source = table.schema[label].dataType.simpleString()
        broken = broken | ~casts_losslessly(F.col(f"`{label}`"), source, "double")
    return table.where(broken)


def split_wide_labels(labels: list[str], separator: str = "|") -> dict[str, dict[str, str]]:
    """Group 'field|ticker' or 'ticker|field' labels by ticker, whichever order they use."""
    pairs = [tuple(label.split(separator)) for label in labels]
    if any(len(p) != 2 for p in pairs):
        raise ContractError("wide labels must have exactly two levels")
    level = [i for i in (0, 1) if set(REQUIRED_FIELDS) <= {_field_of(p[i]) for p in pairs}]
    if len(level) != 1:
        raise ContractError("exactly one label level must hold the price fields")
    by_ticker: dict[str, list[str]] = {}
    for label, pair in zip(labels, pairs):
        by_ticker.setdefault(pair[1 - level[0]], []).append(label)
    return {
        ticker: {f: full for f, full in _wide_fields(own, separator, level[0], ticker).items()}
        for ticker, own in by_ticker.items()
    }


def _wide_fields(labels: list[str], separator: str, level: int, ticker: str) -> dict[str, str]:
    short = {label.split(separator)[level]: label for label in labels}
    return {f: short[s] for f, s in _fields_by_label(list(short), f"ticker {ticker}").items()}


def unpivot_wide(table: DataFrame, tickers: list[str], retrieved_at: Column, day: str = "date") -> DataFrame:
    """A wide (field × ticker) table to canonical rows, inside each row and without a shuffle.

    A requested ticker that the table lacks yields no rows.
    """
    groups = split_wide_labels([c for c in table.columns if c != day])
    wanted = []
    for ticker in tickers:
        found = [t for t in groups if t.strip().casefold() == ticker.casefold()]
        if len(found) > 1:
            raise ContractError(f"ambiguous wide labels for {ticker}")
        if found:
            wanted.append((ticker, groups[found[0]]))
    if not wanted:
        raise ContractError("the wide table holds none of the requested tickers")
    entries = [
        F.struct(
            F.lit(ticker).alias("ticker"),
            *[
                (_exact(table, fields[c]) if c in fields else F.lit(None).cast("double")).alias(c)
                for c in PRICE_VALUES
            ],
        )
        for ticker, fields in wanted
    ]
    rows = table.select(F.to_date(day).alias("date"), F.inline(F.array(*entries)))
    return rows.withColumn("retrieved_at", retrieved_at).select(*PRICE_COLUMNS)


def normalize_shares(series: DataFrame, ticker: str | Column, retrieved_at: Column) -> DataFrame:
    """A provider series of (stamp text with offset, value) to canonical rows, nulls kept.

    The date is the stamp's own local date: the offset is dropped, not converted.
    """
    named = F.lit(ticker) if isinstance(ticker, str) else ticker
    return series.select(
        F.to_date(F.substring("stamp", 1, 10)).alias("date"),
        named.alias("ticker"),
        exact_value(F.col("value"), series.schema["value"].dataType, EXACT_SHARE_TYPE, "'value'").alias(
            "shares_outstanding"
        ),
        retrieved_at.alias("retrieved_at"),
    )
