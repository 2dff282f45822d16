"""The exchange session calendar as a small dimension table.

A calendar holds about 253 rows per year, however much price data there is, so it
is the one table that is always broadcast.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.schemas import MOMENTUM_LAG, VOLATILITY_WINDOW, ContractError

EXCHANGE_TZ = "America/New_York"

# Unscheduled full-day closures of the exchange.
SPECIAL_CLOSURES = (
    "1985-09-27",
    "1994-04-27",
    "2001-09-11",
    "2001-09-12",
    "2001-09-13",
    "2001-09-14",
    "2004-06-11",
    "2007-01-02",
    "2012-10-29",
    "2012-10-30",
    "2018-12-05",
    "2025-01-09",
)
# Unscheduled 13:00 closes.
SPECIAL_EARLY_CLOSES = ("1997-12-26", "1999-12-31", "2003-12-26")

# The days the closure rules below are complete for, and bounded enough to broadcast.
FIRST_DAY, LAST_DAY = date(1985, 1, 1), date(2100, 12, 31)
PAD_BACK_DAYS = 6 * 366
PAD_AHEAD_DAYS = 370


def _nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def _good_friday(year: int) -> date:
    golden = year % 19
    century, rest = divmod(year, 100)
    skipped, leap = divmod(century, 4)
    moon = (19 * golden + century - skipped - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    quarter, tail = divmod(rest, 4)
    to_sunday = (32 + 2 * leap + 2 * quarter - moon - tail) % 7
    late = (golden + 11 * moon + 22 * to_sunday) // 451
    month, day = divmod(moon + to_sunday - 7 * late + 114, 31)
    return date(year, month, day + 1) - timedelta(days=2)


def _nearest_weekday(day: date) -> date:
    return day + timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0))


def closures(year: int) -> list[date]:
    """Full-day weekday closures of one year, from the holiday rules (1985 on)."""
    if year < FIRST_DAY.year:
        raise ContractError(f"closures before {FIRST_DAY.year} are not known")
    new_year = date(year, 1, 1)
    days = [
        new_year + timedelta(days=1) if new_year.weekday() == 6 else new_year,
        _nth_weekday(year, 2, 0, 3),
        _good_friday(year),
        date(year, 5, 31) - timedelta(days=date(year, 5, 31).weekday()),
        _nearest_weekday(date(year, 7, 4)),
        _nth_weekday(year, 9, 0, 1),
        _nth_weekday(year, 11, 3, 4),
        _nearest_weekday(date(year, 12, 25)),
    ]
    if year >= 1998:
        days.append(_nth_weekday(year, 1, 0, 3))
    if year >= 2022:
        days.append(_nearest_weekday(date(year, 6, 19)))
    days += [d for d in map(date.fromisoformat, SPECIAL_CLOSURES) if d.year == year]
    return sorted({d for d in days if d.weekday() < 5})


def early_closes(year: int) -> list[date]:
    """Days that end at 13:00 exchange time (1993 on)."""
    days = [_nth_weekday(year, 11, 3, 4) + timedelta(days=1)]
    before = date(year, 7, 3)
    if before.weekday() in (0, 1, 3) or (before.weekday() == 2 and year >= 2013):
        days.append(before)
    if date(year, 7, 5).weekday() == 4 and year < 2013:
        days.append(date(year, 7, 5))
    if date(year, 12, 24).weekday() < 4:
        days.append(date(year, 12, 24))
    days += [d for d in map(date.fromisoformat, SPECIAL_EARLY_CLOSES) if d.year == year]
    return sorted(set(days))


@dataclass(frozen=True)
class SessionCalendar:
    """Ordered sessions between two dates; positions count from the first session."""

    first: date
    last: date

    @classmethod
    def around(cls, start: date, end: date) -> SessionCalendar:
        """Enough sessions before ``start`` for every lookback and some after ``end``.

        The padding stops at the first and last day the holiday rules are known for; a range
        that itself lies outside is an error, because its sessions would be wrong.
        """
        if start < FIRST_DAY or end > LAST_DAY:
            raise ContractError(f"sessions are known from {FIRST_DAY} to {LAST_DAY} only")
        return cls(
            max(FIRST_DAY, start - timedelta(days=PAD_BACK_DAYS)),
            min(LAST_DAY, end + timedelta(days=PAD_AHEAD_DAYS)),
        )

    @cached_property
    def weekday_closures(self) -> list[date]:
        """Weekdays between the two dates on which the exchange is closed."""
        years = range(self.first.year, self.last.year + 1)
        return [d for y in years for d in closures(y) if self.first <= d <= self.last]

    @cached_property
    def sessions(self) -> list[date]:
        closed = set(self.weekday_closures)
        days = (self.first + timedelta(days=i) for i in range((self.last - self.first).days + 1))
        return [d for d in days if d.weekday() < 5 and d not in closed]

    def index_from(self, day: date) -> int:
        """Position of the first session on or after ``day``."""
        return bisect_left(self.sessions, day)

    def index_until(self, day: date) -> int:
        """Position of the last session on or before ``day``."""
        return bisect_right(self.sessions, day) - 1

    def is_session(self, day: date) -> bool:
        at = self.index_from(day)
        return at < len(self.sessions) and self.sessions[at] == day

    def session_array(self, start: date | None = None, end: date | None = None):
        """The sessions of a closed range as one array expression.

        It has only literals, so the optimizer folds it to a constant: picking or
        subtracting sessions inside an expression needs no join.
        """
        start, end = start or self.first, end or self.last
        days = f"sequence(date'{start}', date'{end}')"
        saturday = start + timedelta(days=(5 - start.weekday()) % 7)
        sunday = start + timedelta(days=(6 - start.weekday()) % 7)
        off = [
            f"sequence(date'{d}', date'{end}', interval 7 days)" for d in (saturday, sunday) if d <= end
        ]
        closed = ", ".join(f"date'{d}'" for d in self.weekday_closures)
        if closed:
            off.append(f"array({closed})")
        return F.expr(f"array_except({days}, concat({', '.join(off)}))" if off else days)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per session with its position and neighbours."""
        return (
            spark.range(1)
            .select(self.session_array().alias("days"))
            .select("days", F.posexplode("days").alias("pos", "session"))
            .selectExpr(
                "pos",
                "session",
                "get(days, pos + 1) AS next_session",
                f"get(days, pos - {VOLATILITY_WINDOW}) AS back_21",
                f"get(days, pos - {MOMENTUM_LAG}) AS back_252",
            )
        )

    def days(self, spark: SparkSession) -> DataFrame:
        """Every calendar day after the first session with the session on or after it."""
        return self.frame(spark).where("next_session is not null").select(
            F.explode(F.sequence(F.date_add("session", 1), "next_session")).alias("day"),
            F.col("next_session").alias("session"),
        )

    def with_closes(self, spark: SparkSession) -> DataFrame:
        """The session frame with the UTC close: 16:00 exchange time, 13:00 on early closes."""
        years = range(self.first.year, self.last.year + 1)
        early = ", ".join(f"date'{d}'" for y in years for d in early_closes(y))
        hours = f"IF(session IN ({early}), INTERVAL '13' HOUR, INTERVAL '16' HOUR)"
        close = f"to_utc_timestamp(CAST(session AS timestamp) + {hours}, '{EXCHANGE_TZ}')"
        return self.frame(spark).withColumn("close_utc", F.expr(close))

    def between(self, spark: SparkSession, start: date, end: date) -> DataFrame:
        """The sessions of a closed date range."""
        return self.frame(spark).where(F.col("session").between(F.lit(start), F.lit(end)))


@dataclass(frozen=True)
class EvaluationTarget:
    captured_at: datetime
    target_session: date
    request_start: date
    request_end: date


def resolve_targets(instants: DataFrame, calendar: SessionCalendar, history_start: date) -> DataFrame:
    """Latest session closed by each ``captured_at`` instant, with its request bounds.

    A close lies on its session's own exchange-local date, so only the session at or
    before that local date, or the one before it, can be the answer: an equi-join on
    the local date replaces a range join over all sessions.
    """
    spark = instants.sparkSession
    cal = calendar.with_closes(spark)
    by_day = cal.select(
        F.explode(
            F.sequence(
                "session",
                F.coalesce(F.date_sub("next_session", 1), F.col("session")),
            )
        ).alias("local_day"),
        "session",
        "close_utc",
        F.get(calendar.session_array(), F.col("pos") - 1).alias("prior_session"),
    )
    local_day = F.to_date(F.from_utc_timestamp("captured_at", EXCHANGE_TZ))
    target = F.when(F.col("close_utc") <= F.col("captured_at"), F.col("session")).otherwise(
        F.col("prior_session")
    )
    return (
        instants.withColumn("local_day", local_day)
        .join(F.broadcast(by_day), "local_day", "left")
        .select(
            *instants.columns,
            target.alias("target_session"),
            F.lit(history_start).alias("request_start"),
            F.date_add(target, 1).alias("request_end"),
        )
        .withColumn(
            "target_status",
            F.when(F.col("target_session").isNull(), "no_completed_session")
            .when(F.col("target_session") < F.col("request_start"), "precedes_history_start")
            .otherwise("resolved"),
        )
    )


def resolve_instants(instants: DataFrame, history_start: date) -> DataFrame:
    """As `resolve_targets`, over the calendar that the instants need.

    An instant that is null, or outside the years the session rules are known for, has a status of
    its own and no session; it changes nothing for the others.
    """
    known = F.coalesce(
        F.year(F.from_utc_timestamp("captured_at", EXCHANGE_TZ)).between(FIRST_DAY.year, LAST_DAY.year), F.lit(False)
    )
    inside = instants.where(known)
    low, high = inside.agg(F.to_date(F.min("captured_at")), F.to_date(F.max("captured_at"))).first()
    low, high = low or history_start, high or history_start
    margin = timedelta(days=370)
    calendar = SessionCalendar(max(low - margin, FIRST_DAY), min(high + margin, LAST_DAY))
    unknown = instants.where(~known).select(
        "*",
        F.lit(None).cast("date").alias("target_session"),
        F.lit(history_start).alias("request_start"),
        F.lit(None).cast("date").alias("request_end"),
        F.lit("outside_known_calendar").alias("target_status"),
    )
    return resolve_targets(inside, calendar, history_start).unionByName(unknown)


def resolve_target(
    spark: SparkSession, captured_at: datetime, history_start: date = date(2018, 1, 1)
) -> EvaluationTarget:
    """Resolve one time-zone-aware instant; raises where the batch form reports a status."""
    if captured_at.tzinfo is None or captured_at.utcoffset() is None:
        raise ValueError("the evaluation instant must be timezone-aware")
    day = captured_at.date()
    calendar = SessionCalendar(day - timedelta(days=370), day + timedelta(days=370))
    one = spark.createDataFrame([(captured_at,)], "captured_at timestamp")
    row = resolve_targets(one, calendar, history_start).first()
    if row["target_status"] != "resolved":
        raise ValueError(f"evaluation target {row['target_status']}: {row['target_session']}")
    return EvaluationTarget(
        captured_at, row["target_session"], row["request_start"], row["request_end"]
    )
