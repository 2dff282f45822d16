"""Small panels and brute-force references for the tests."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta, timezone

from tickerloom.schemas import PRICE_SCHEMA
from tickerloom.sources.calendar import SessionCalendar

AT = datetime(2024, 1, 1, 6, tzinfo=timezone.utc)
CALENDAR = SessionCalendar(date(2015, 1, 1), date(2026, 12, 31))


def sessions(count: int, start: date = date(2018, 1, 2)) -> list[date]:
    first = CALENDAR.index_from(start)
    return CALENDAR.sessions[first : first + count]


def bar(day: date, ticker: str, adjusted, at: datetime = AT, **changes):
    row = {
        "date": day,
        "ticker": ticker,
        "open": 10.0,
        "high": 12.0,
        "low": 9.0,
        "close": 11.0,
        "adjusted_close": adjusted,
        "volume": 100.0,
        "retrieved_at": at,
    }
    row.update(changes)
    return tuple(row[f.name] for f in PRICE_SCHEMA)


def panel(spark, series: dict[str, list], days: list[date] | None = None):
    """A price table; a value of "absent" leaves the row out, None leaves the value out."""
    longest = max(len(v) for v in series.values())
    days = days or sessions(longest)
    rows = [
        bar(day, ticker, value)
        for ticker, values in series.items()
        for day, value in zip(days, values)
        if not isinstance(value, str)
    ]
    return spark.createDataFrame(rows, PRICE_SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


def midrank(values: list[float | None], at: int, span: int = 755, minimum: int = 252):
    """Plain percentile of one value among its own earlier ones."""
    earlier = [x for x in values[max(0, at - span) : at] if x is not None]
    current = values[at]
    if current is None or len(earlier) < minimum:
        return len(earlier), None
    below = sum(x < current for x in earlier)
    equal = sum(x == current for x in earlier)
    return len(earlier), 100.0 * (below + 0.5 * equal) / len(earlier)


def wave(count: int, phase: float = 0.0) -> list[float]:
    return [100.0 + 10.0 * math.sin(i / 7.0 + phase) + 0.01 * i for i in range(count)]


def later(hours: int) -> datetime:
    return AT + timedelta(hours=hours)
