from datetime import date, datetime, timezone

import pytest

from tests.helpers import CALENDAR
from tickerloom.schemas import ContractError
from tickerloom.sources.calendar import SessionCalendar, closures, resolve_instants, resolve_target


@pytest.mark.parametrize(
    "instant, session",
    [
        ("2023-07-03T16:59:59Z", "2023-06-30"),  # a second before an early close
        ("2023-07-03T17:00:00Z", "2023-07-03"),
        ("2024-03-08T21:00:00Z", "2024-03-08"),  # the last close in winter time
        ("2024-03-11T19:59:59Z", "2024-03-08"),
        ("2024-03-11T20:00:00Z", "2024-03-11"),  # the first in summer time
        ("2019-12-24T18:00:00Z", "2019-12-24"),
        ("2019-12-25T15:00:00Z", "2019-12-24"),
        ("2021-09-06T22:00:00Z", "2021-09-03"),
    ],
)
def test_target_follows_scheduled_closes(spark, instant, session):
    target = resolve_target(spark, datetime.fromisoformat(instant))
    assert target.target_session == date.fromisoformat(session)
    assert (target.request_end - target.target_session).days == 1


def test_target_needs_an_aware_instant_after_the_history_start(spark):
    with pytest.raises(ValueError):
        resolve_target(spark, datetime(2023, 7, 3, 18))
    with pytest.raises(ValueError):
        resolve_target(spark, datetime.fromisoformat("2017-07-03T18:00:00Z"))


def test_closures_and_counts():
    assert not CALENDAR.is_session(date(2023, 9, 4)) and CALENDAR.is_session(date(2023, 9, 5))
    assert not CALENDAR.is_session(date(2020, 7, 3))
    assert date(2012, 10, 30) in closures(2012) and date(2001, 9, 11) in closures(2001)
    assert date(2023, 6, 19) in closures(2023) and date(2020, 6, 19) not in closures(2020)
    assert date(2015, 4, 3) in closures(2015)
    with pytest.raises(ContractError):
        closures(1984)
    with pytest.raises(ContractError):
        SessionCalendar.around(date(1984, 12, 31), date(1990, 1, 1))
    assert SessionCalendar.around(date(1986, 1, 2), date(1990, 1, 1)).first == date(1985, 1, 1)
    span = CALENDAR.index_until(date(2026, 8, 24)) - CALENDAR.index_from(date(2018, 1, 2)) + 1
    assert span == 2172


def test_frame_matches_the_list(spark):
    rows = CALENDAR.frame(spark).orderBy("pos").collect()
    assert [r["session"] for r in rows] == CALENDAR.sessions
    assert rows[300]["back_252"] == rows[48]["session"] and rows[30]["back_21"] == rows[9]["session"]
    assert rows[5]["next_session"] == rows[6]["session"] and rows[3]["back_21"] is None


def test_session_array_folds_to_a_constant(spark):
    plan = spark.range(1).select(CALENDAR.session_array().alias("days"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "array_except" not in plan


def test_every_day_has_the_session_on_or_after_it(spark):
    days = {r["day"]: r["session"] for r in CALENDAR.days(spark).collect()}
    assert days[date(2023, 7, 1)] == date(2023, 7, 3) and days[date(2023, 7, 4)] == date(2023, 7, 5)
    assert all(days[s] == s for s in CALENDAR.sessions[1:])


def test_instants_outside_the_known_years_have_a_status(spark):
    at = lambda y, m=6, d=3: datetime(y, m, d, 12, tzinfo=timezone.utc)
    instants = [(1, at(1900)), (2, at(2024)), (3, None), (4, at(2500)), (5, at(2020))]
    frame = spark.createDataFrame(instants, "k long, captured_at timestamp")
    rows = {r["k"]: r for r in resolve_instants(frame, date(2018, 1, 1)).collect()}
    assert {k: r["target_status"] for k, r in rows.items()} == {
        1: "outside_known_calendar", 2: "resolved", 3: "outside_known_calendar", 4: "outside_known_calendar", 5: "resolved"
    }
    assert rows[2]["target_session"] == date(2024, 5, 31) and rows[1]["target_session"] is None
    only = resolve_instants(frame.where("k = 1"), date(2018, 1, 1)).collect()
    assert [r["target_status"] for r in only] == ["outside_known_calendar"]
    assert resolve_instants(frame.where("false"), date(2018, 1, 1)).isEmpty()
