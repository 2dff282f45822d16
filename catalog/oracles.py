"""DuckDB statements equivalent to the registered queries.

Each statement is put together from named common table expressions; only those a
statement needs, directly or through others, go into its WITH clause.
"""

from __future__ import annotations

from tickerloom.schemas import MOMENTUM_COLUMNS, PRICE_COLUMNS, VOLATILITY_COLUMNS

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, *needs: str):
    def add(text: str) -> None:
        CTES[name] = (needs, text.strip())

    return add


def statement(select: str, *needs: str) -> str:
    """The select with the transitive closure of its table expressions in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return select.strip()
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n][1]}\n)" for n in ordered)
    return f"WITH {parts}\n{select.strip()}"


# ---------------------------------------------------------------- calendar

cte("span")(
    """
SELECT CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem
"""
)
cte("years")("SELECT CAST(unnest(generate_series(1985, 2030)) AS INTEGER) AS y")
cte("easter", "years")(
    """
SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS sunday
FROM (
  SELECT *, (a + 11 * h + 22 * l) // 451 AS m
  FROM (
    SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l
    FROM (
      SELECT y, y % 19 AS a, (y // 100) % 4 AS e, (y % 100) // 4 AS i, (y % 100) % 4 AS k,
             (19 * (y % 19) + y // 100 - (y // 100) // 4
              - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h
      FROM years
    )
  )
)
"""
)
cte("holidays", "years", "easter")(
    """
SELECT CASE WHEN isodow(make_date(y, 1, 1)) = 7 THEN make_date(y, 1, 2) ELSE make_date(y, 1, 1) END AS d FROM years
UNION SELECT make_date(y, 1, 15) + ((8 - isodow(make_date(y, 1, 15))) % 7)::INTEGER FROM years WHERE y >= 1998
UNION SELECT make_date(y, 2, 15) + ((8 - isodow(make_date(y, 2, 15))) % 7)::INTEGER FROM years
UNION SELECT sunday - 2 FROM easter
UNION SELECT make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INTEGER FROM years
UNION SELECT f + CASE isodow(f) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END
      FROM (SELECT make_date(y, 6, 19) AS f FROM years WHERE y >= 2022)
UNION SELECT f + CASE isodow(f) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END
      FROM (SELECT make_date(y, 7, 4) AS f FROM years)
UNION SELECT make_date(y, 9, 1) + ((8 - isodow(make_date(y, 9, 1))) % 7)::INTEGER FROM years
UNION SELECT make_date(y, 11, 22) + ((11 - isodow(make_date(y, 11, 22))) % 7)::INTEGER FROM years
UNION SELECT f + CASE isodow(f) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END
      FROM (SELECT make_date(y, 12, 25) AS f FROM years)
UNION SELECT CAST(unnest(['1985-09-27', '1994-04-27', '2001-09-11', '2001-09-12', '2001-09-13', '2001-09-14',
      '2004-06-11', '2007-01-02', '2012-10-29', '2012-10-30', '2018-12-05', '2025-01-09']) AS DATE)
"""
)
cte("early", "years")(
    """
SELECT make_date(y, 11, 22) + ((11 - isodow(make_date(y, 11, 22))) % 7)::INTEGER + 1 AS d FROM years
UNION SELECT make_date(y, 7, 3) FROM years
      WHERE isodow(make_date(y, 7, 3)) IN (1, 2, 4) OR (isodow(make_date(y, 7, 3)) = 3 AND y >= 2013)
UNION SELECT make_date(y, 7, 5) FROM years WHERE isodow(make_date(y, 7, 5)) = 5 AND y < 2013
UNION SELECT make_date(y, 12, 24) FROM years WHERE isodow(make_date(y, 12, 24)) <= 4
UNION SELECT CAST(unnest(['1997-12-26', '1999-12-31', '2003-12-26']) AS DATE)
"""
)
cte("cal", "span", "holidays", "early")(
    """
SELECT row_number() OVER (ORDER BY d) - 1 AS pos, d AS session,
       lead(d) OVER (ORDER BY d) AS next_session,
       lag(d, 21) OVER (ORDER BY d) AS back_21,
       lag(d, 252) OVER (ORDER BY d) AS back_252,
       d IN (SELECT d FROM early) AS is_early
FROM (SELECT CAST(unnest(generate_series(lo - 2196, hi + 370, INTERVAL 1 DAY)) AS DATE) AS d FROM span)
WHERE isodow(d) <= 5 AND d NOT IN (SELECT d FROM holidays)
"""
)

# ---------------------------------------------------------------- price panels

cte("day_session", "cal")(
    """
SELECT CAST(unnest(generate_series(before + 1, session, INTERVAL 1 DAY)) AS DATE) AS day, session
FROM (SELECT session, lag(session) OVER (ORDER BY session) AS before FROM cal) WHERE before IS NOT NULL
"""
)
cte("trades", "day_session")(
    """
SELECT l_suppkey AS suppkey, l_suppkey // 20 AS slot, session AS date,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS off,
       CAST(l_quantity AS BIGINT) AS units, l_linestatus AS side, l_returnflag AS flag, l_linenumber AS hour
FROM lineitem LEFT JOIN day_session ON day = CAST(l_shipdate AS DATE)
"""
)


def _bars(ticker: str, source: str, where: str = "true", shift: int = 21) -> str:
    return f"""
SELECT ticker, date,
       CASE WHEN open_n > 0 THEN CAST(open_total AS DOUBLE) / (open_n * 100.0::DOUBLE) END AS open,
       top / 100.0::DOUBLE AS high, bottom / 100.0::DOUBLE AS low,
       CAST(total AS DOUBLE) / (n * 100.0::DOUBLE) AS close,
       CASE WHEN net_n > 0 THEN CAST(net_total AS DOUBLE) / (net_n * 10000.0::DOUBLE) END AS adjusted_close,
       CAST(units AS DOUBLE) AS volume,
       CAST(date AS TIMESTAMP) + to_hours(CAST(hour + {shift} AS BIGINT)) AS retrieved_at
FROM (
  SELECT {ticker} AS ticker, date, max(cents) AS top, min(cents) AS bottom,
         CAST(sum(cents) AS BIGINT) AS total, count(*) AS n,
         CAST(sum(cents) FILTER (WHERE side = 'O') AS BIGINT) AS open_total, count(*) FILTER (WHERE side = 'O') AS open_n,
         CAST(sum(cents * (100 - off)) FILTER (WHERE off > 0) AS BIGINT) AS net_total,
         count(*) FILTER (WHERE off > 0) AS net_n, CAST(sum(units) AS BIGINT) AS units, max(hour) AS hour
  FROM {source} WHERE {where} GROUP BY ALL
)"""


DESK = "'DESK' || lpad(CAST(slot AS VARCHAR), CAST(greatest(length(CAST(slot AS VARCHAR)), 7) AS INTEGER), '0')"
SUPPLIER = "'SUP' || lpad(CAST(suppkey AS VARCHAR), CAST(greatest(length(CAST(suppkey AS VARCHAR)), 9) AS INTEGER), '0')"
cte("px", "trades")(_bars(DESK, "trades"))
cte("px_first", "trades")(_bars(DESK, "trades", "flag <> 'R'"))
cte("px_second", "trades")(_bars(DESK, "trades", "flag <> 'A'"))
cte("px_later", "trades")(_bars(DESK, "trades", shift=33))
cte("px_supplier", "trades")(_bars(SUPPLIER, "trades"))
def _midrank(source: str, raw: str) -> str:
    return f"""
SELECT a.ticker, a.pos, count(b.{raw}) AS refs,
       CASE WHEN a.{raw} IS NOT NULL AND count(b.{raw}) >= 252 THEN
         100.0::DOUBLE * (count(*) FILTER (WHERE b.{raw} < a.{raw})
                          + 0.5::DOUBLE * count(*) FILTER (WHERE b.{raw} = a.{raw})) / count(b.{raw}) END AS percentile
FROM {source} a LEFT JOIN {source} b
  ON b.ticker = a.ticker AND b.pos BETWEEN a.pos - 755 AND a.pos - 1 AND b.{raw} IS NOT NULL
GROUP BY a.ticker, a.pos, a.{raw}"""



cte("bounds", "px", "cal")(
    """
SELECT lo, hi, (SELECT pos FROM cal WHERE session = lo) AS lo_pos, (SELECT pos FROM cal WHERE session = hi) AS hi_pos
FROM (SELECT min(date) AS lo, max(date) AS hi FROM px)
"""
)


def signal_chain(p: str, px: str) -> None:
    """Grid, momentum and volatility of one price table, under a name prefix."""
    cte(f"{p}grid", px, "cal", "bounds")(
    f"""
SELECT t.ticker, c.pos, c.session, c.next_session, c.back_21, c.back_252,
       p.date IS NOT NULL AS row_present, p.adjusted_close AS adj
FROM (SELECT DISTINCT ticker FROM {px}) t
JOIN cal c ON true JOIN bounds b ON c.pos BETWEEN b.lo_pos - 253 AND b.hi_pos
LEFT JOIN {px} p ON p.ticker = t.ticker AND p.date = c.session
"""
)


    cte(f"{p}mom_raw", f"{p}grid")(
    f"""
SELECT *, CASE WHEN adj IS NOT NULL AND start_adj IS NOT NULL THEN ln(adj / start_adj) END AS raw
FROM (
  SELECT *, lag(adj, 252) OVER w AS start_adj, coalesce(lag(row_present, 252) OVER w, false) AS start_present
  FROM {p}grid WINDOW w AS (PARTITION BY ticker ORDER BY pos)
)
"""
)
    cte(f"{p}mom_rank", f"{p}mom_raw")(_midrank(f"{p}mom_raw", "raw"))
    cte(f"{p}mom_gaps", f"{p}grid")(
    f"""
SELECT ticker, pos, count(*) FILTER (WHERE NOT row_present) OVER w AS row_n,
       coalesce(string_agg(CAST(session AS VARCHAR), ',') FILTER (WHERE NOT row_present) OVER w, '') AS row_days,
       count(*) FILTER (WHERE row_present AND adj IS NULL) OVER w AS value_n,
       coalesce(string_agg(CAST(session AS VARCHAR), ',') FILTER (WHERE row_present AND adj IS NULL) OVER w, '') AS value_days
FROM {p}grid WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING)
"""
)
    cte(f"{p}mom", f"{p}mom_raw", f"{p}mom_rank", f"{p}mom_gaps", "bounds")(
    f"""
SELECT r.ticker, r.pos, r.session AS signal_date, r.back_252 AS endpoint_start_date, r.session AS endpoint_end_date,
       r.start_adj AS start_adjusted_close, r.adj AS end_adjusted_close, r.raw AS raw_momentum,
       CASE WHEN r.raw IS NOT NULL THEN 100.0::DOUBLE * (r.adj - r.start_adj) / r.start_adj END AS simple_return_pct,
       CASE WHEN r.raw IS NOT NULL THEN 'available' ELSE 'endpoint_ineligible' END AS simple_return_status,
       k.percentile AS momentum_percentile, k.refs AS normalization_reference_count,
       r.next_session AS first_prospective_session, r.raw IS NOT NULL AS endpoint_eligible,
       coalesce(nullif(concat_ws('|',
         CASE WHEN NOT r.start_present THEN 'missing_start_row' WHEN r.start_adj IS NULL THEN 'missing_start_adjusted_close' END,
         CASE WHEN NOT r.row_present THEN 'missing_end_row' WHEN r.adj IS NULL THEN 'missing_end_adjusted_close' END
       ), ''), 'eligible') AS endpoint_status,
       m.row_n AS interior_missing_row_count, m.row_days AS interior_missing_row_dates,
       m.value_n AS interior_missing_adjusted_close_count, m.value_days AS interior_missing_adjusted_close_dates
FROM {p}mom_raw r JOIN {p}mom_rank k USING (ticker, pos) JOIN {p}mom_gaps m USING (ticker, pos)
JOIN bounds b ON r.pos BETWEEN b.lo_pos AND b.hi_pos
"""
)
    cte(f"{p}vol_ret", f"{p}grid")(
    f"""
SELECT *, CASE WHEN adj IS NOT NULL AND prior IS NOT NULL THEN ln(adj / prior) END AS daily_return
FROM (SELECT *, lag(adj) OVER (PARTITION BY ticker ORDER BY pos) AS prior FROM {p}grid)
"""
)
    cte(f"{p}vol_raw", f"{p}vol_ret")(
    f"""
SELECT *, CASE WHEN n = 21 THEN deviation * sqrt(252.0::DOUBLE) END AS raw
FROM (
  SELECT *, count(daily_return) OVER w AS n, stddev_samp(daily_return) OVER w AS deviation
  FROM {p}vol_ret WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)
)
"""
)
    cte(f"{p}vol_rank", f"{p}vol_raw")(_midrank(f"{p}vol_raw", "raw"))
    cte(f"{p}vol_gaps", f"{p}grid")(
    f"""
SELECT ticker, pos, count(*) FILTER (WHERE NOT row_present) OVER w AS row_n,
       coalesce(string_agg(CAST(session AS VARCHAR), ',') FILTER (WHERE NOT row_present) OVER w, '') AS row_days,
       count(*) FILTER (WHERE row_present AND adj IS NULL) OVER w AS value_n,
       coalesce(string_agg(CAST(session AS VARCHAR), ',') FILTER (WHERE row_present AND adj IS NULL) OVER w, '') AS value_days
FROM {p}grid WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)
"""
)
    cte(f"{p}vol", f"{p}vol_raw", f"{p}vol_rank", f"{p}vol_gaps", "bounds")(
    f"""
SELECT r.ticker, r.pos, r.session AS signal_date, r.back_21 AS window_start_date, r.session AS window_end_date,
       r.raw AS raw_annualized_volatility, 100.0::DOUBLE * r.raw AS annualized_volatility_pct,
       k.percentile AS volatility_percentile, k.refs AS normalization_reference_count,
       r.next_session AS first_prospective_session, g.row_n = 0 AND g.value_n = 0 AS window_eligible,
       coalesce(nullif(concat_ws('|', CASE WHEN g.row_n > 0 THEN 'missing_price_rows' END,
                CASE WHEN g.value_n > 0 THEN 'missing_adjusted_close' END), ''), 'eligible') AS window_status,
       g.row_n AS missing_row_count, g.row_days AS missing_row_dates,
       g.value_n AS missing_adjusted_close_count, g.value_days AS missing_adjusted_close_dates
FROM {p}vol_raw r JOIN {p}vol_rank k USING (ticker, pos) JOIN {p}vol_gaps g USING (ticker, pos)
JOIN bounds b ON r.pos BETWEEN b.lo_pos AND b.hi_pos
"""
)


signal_chain("", "px")
signal_chain("first_", "px_first")

ORACLES: dict[str, str] = {}


def oracle(name: str, select: str, *needs: str) -> None:
    ORACLES[name] = statement(select, *needs)


def day(column: str, alias: str | None = None) -> str:
    return f"CAST({column} AS VARCHAR) AS {alias or column.split('.')[-1]}"


def instant(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {alias or column.split('.')[-1]}"


MOMENTUM_SELECT = f"""
SELECT ticker, {day('signal_date')}, {day('endpoint_start_date')}, {day('endpoint_end_date')},
       start_adjusted_close, end_adjusted_close, round(raw_momentum, 6) AS raw_momentum,
       round(simple_return_pct, 6) AS simple_return_pct, simple_return_status, momentum_percentile,
       normalization_reference_count, {day('first_prospective_session')}, endpoint_eligible, endpoint_status,
       interior_missing_row_count, interior_missing_row_dates,
       interior_missing_adjusted_close_count, interior_missing_adjusted_close_dates
FROM mom"""
VOLATILITY_SELECT = f"""
SELECT ticker, {day('signal_date')}, {day('window_start_date')}, {day('window_end_date')},
       round(raw_annualized_volatility, 6) AS raw_annualized_volatility,
       round(annualized_volatility_pct, 6) AS annualized_volatility_pct, volatility_percentile,
       normalization_reference_count, {day('first_prospective_session')}, window_eligible, window_status,
       missing_row_count, missing_row_dates, missing_adjusted_close_count, missing_adjusted_close_dates
FROM vol"""
oracle("momentum", MOMENTUM_SELECT, "mom")
oracle("volatility", VOLATILITY_SELECT, "vol")
oracle(
    "session_calendar",
    f"""
SELECT CAST(o.day AS VARCHAR) AS day, orders, {day('session')}, {day('next_session')}, {day('back_21')}, {day('back_252')},
       strftime(timezone('UTC', timezone('America/New_York', CAST(session AS TIMESTAMP)
                + CASE WHEN is_early THEN INTERVAL 13 HOURS ELSE INTERVAL 16 HOURS END)), '%Y-%m-%d %H:%M:%S') AS close_utc
FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1) o
LEFT JOIN day_session USING (day) LEFT JOIN cal USING (session)""",
    "cal",
    "day_session",
)
oracle(
    "scan_prices",
    f"SELECT {day('date')}, ticker, open, high, low, close, adjusted_close, volume, {instant('retrieved_at')} FROM px",
    "px",
)

# ---------------------------------------------------------------- signals

oracle(
    "momentum_raw",
    f"SELECT ticker, {day('signal_date')}, round(raw_momentum, 6) AS raw_momentum FROM mom WHERE raw_momentum IS NOT NULL",
    "mom",
)
oracle(
    "daily_log_return",
    f"""SELECT ticker, {day('session', 'signal_date')}, round(daily_return, 6) AS daily_return
FROM vol_ret JOIN bounds b ON pos BETWEEN b.lo_pos AND b.hi_pos WHERE daily_return IS NOT NULL""",
    "vol_ret",
    "bounds",
)
oracle(
    "volatility_raw",
    f"SELECT ticker, {day('signal_date')}, round(raw_annualized_volatility, 6) AS raw_volatility FROM vol WHERE raw_annualized_volatility IS NOT NULL",
    "vol",
)
oracle(
    "momentum_percentile",
    f"SELECT ticker, {day('signal_date')}, momentum_percentile, normalization_reference_count FROM mom",
    "mom",
)
oracle(
    "volatility_percentile",
    f"SELECT ticker, {day('signal_date')}, volatility_percentile, normalization_reference_count FROM vol",
    "vol",
)
oracle(
    "momentum_missing",
    f"""SELECT ticker, {day('signal_date')}, interior_missing_row_count, interior_missing_row_dates,
interior_missing_adjusted_close_count, interior_missing_adjusted_close_dates FROM mom""",
    "mom",
)
oracle(
    "volatility_missing",
    f"""SELECT ticker, {day('signal_date')}, missing_row_count, missing_row_dates,
missing_adjusted_close_count, missing_adjusted_close_dates FROM vol""",
    "vol",
)
oracle("momentum_bounded", MOMENTUM_SELECT + " WHERE signal_date BETWEEN DATE '2000-01-03' AND DATE '2000-12-29'", "mom")
oracle(
    "endpoint_status",
    "SELECT ticker, endpoint_status, endpoint_eligible, count(*) AS rows FROM mom GROUP BY ALL",
    "mom",
)
oracle(
    "window_status",
    "SELECT ticker, window_status, window_eligible, count(*) AS rows FROM vol GROUP BY ALL",
    "vol",
)
cte("endpoints")(
    """
SELECT l_orderkey, l_linenumber, l_extendedprice AS start,
       CASE WHEN l_linenumber > 3 THEN l_quantity ELSE l_extendedprice * (1.0::DOUBLE - l_discount) END AS "end"
FROM lineitem
"""
)
oracle(
    "stable_log_return",
    'SELECT l_orderkey, l_linenumber, start, round(ln("end" / start), 6) AS raw FROM endpoints',
    "endpoints",
)
oracle(
    "simple_return",
    """SELECT l_orderkey, l_linenumber, start, round(100.0::DOUBLE * ("end" - start) / start, 6) AS pct, 'available' AS status
FROM endpoints""",
    "endpoints",
)
oracle(
    "next_session",
    f"""SELECT {day('session')}, {day('next_session')}, lines FROM cal
JOIN (SELECT date AS session, count(*) AS lines FROM trades GROUP BY 1) USING (session)""",
    "cal",
    "trades",
)
oracle(
    "first_last_present",
    """SELECT ticker, CAST(min(signal_date) FILTER (WHERE volatility_percentile IS NOT NULL) AS VARCHAR) AS first_date,
CAST(max(signal_date) FILTER (WHERE volatility_percentile IS NOT NULL) AS VARCHAR) AS last_date FROM vol GROUP BY ticker""",
    "vol",
)
oracle(
    "latest_eligible",
    f"""SELECT ticker, {day('signal_date')}, momentum_percentile FROM (
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY signal_date DESC) AS r FROM mom WHERE momentum_percentile IS NOT NULL
) WHERE r = 1""",
    "mom",
)
cte("univ")(
    """
SELECT r_regionkey + 1 AS ord, 'IDX' || lpad(CAST(r_regionkey AS VARCHAR), CAST(greatest(length(CAST(r_regionkey AS VARCHAR)), 3) AS INTEGER), '0') AS ticker, r_name AS name,
       'Region index' AS category FROM region
UNION ALL
SELECT slot + 1 + (SELECT max(r_regionkey) + 1 FROM region), 'DESK' || lpad(CAST(slot AS VARCHAR), CAST(greatest(length(CAST(slot AS VARCHAR)), 7) AS INTEGER), '0'), 'Suppliers from ' || low, n_name
FROM (SELECT s_suppkey // 20 AS slot, min(s_suppkey) AS low, min(s_nationkey) AS nk FROM supplier GROUP BY 1)
JOIN nation ON n_nationkey = nk
"""
)
oracle(
    "staleness",
    f"""SELECT u.ticker, {day('latest')}, b.hi_pos - c.pos AS staleness_sessions, false AS not_a_session
FROM univ u LEFT JOIN (
  SELECT ticker, max(signal_date) AS latest FROM vol WHERE raw_annualized_volatility IS NOT NULL GROUP BY ticker
) USING (ticker) LEFT JOIN cal c ON c.session = latest, bounds b""",
    "univ",
    "vol",
    "cal",
    "bounds",
)
oracle(
    "target_observation",
    f"""SELECT u.ord, u.ticker, {day('signal_date')}, round(raw_momentum, 6) AS raw_momentum, momentum_percentile, endpoint_status
FROM univ u LEFT JOIN (SELECT * FROM mom JOIN bounds b ON signal_date = b.hi) m ON m.ticker = u.ticker""",
    "univ",
    "mom",
    "bounds",
)
oracle(
    "normalization_status",
    """SELECT ticker, CASE WHEN raw_momentum IS NULL THEN 'raw_ineligible'
WHEN momentum_percentile IS NULL THEN 'insufficient_reference_history' ELSE 'eligible' END AS status, count(*) AS rows
FROM mom GROUP BY ALL""",
    "mom",
)

# ---------------------------------------------------------------- flow and concentration

cte("share_levels")(
    f"""
SELECT ticker, date, CASE WHEN level > 0 AND top % 11 <> 0 THEN level END AS shares
FROM (
  SELECT ticker, date, top, CAST(sum(net) OVER (PARTITION BY ticker ORDER BY date) AS BIGINT) AS level
  FROM (
    SELECT {DESK} AS ticker, date, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS top,
           sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END) AS net
    FROM (SELECT *, l_suppkey // 20 AS slot, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_shipdate IS NOT NULL)
    GROUP BY 1, 2
  )
)
"""
)
cte("priced", "px")("SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS place FROM px")
cte("share_points", "share_levels", "priced")(
    """
SELECT s.ticker, s.date, s.shares, coalesce(p.place, 0) AS place,
       CASE WHEN s.date - p.date <= 4 THEN p.close END AS close,
       CASE WHEN s.date - p.date <= 4 THEN CAST(s.date - p.date AS BIGINT) END AS age,
       n.date AS next_date, n.place AS next_place
FROM share_levels s
ASOF LEFT JOIN priced p ON p.ticker = s.ticker AND p.date <= s.date
ASOF LEFT JOIN priced n ON n.ticker = s.ticker AND n.date > s.date
"""
)
_FACTORS = sorted({f for x in (1.25, 1.5, 2.0, 3.0, 4.0, 5.0, 10.0) for f in (x, 1.0 / x)})
cte("share_intervals", "share_points")(
    f"""
SELECT *, CASE {' '.join(f"WHEN ratio / {f!r}::DOUBLE <= 1.05::DOUBLE AND 1.0::DOUBLE / (ratio / {f!r}::DOUBLE) <= 1.05::DOUBLE THEN {f!r}::DOUBLE" for f in _FACTORS)} END AS factor,
       ratio >= 1.5::DOUBLE OR 1.0::DOUBLE / ratio >= 1.5::DOUBLE AS large, ratio * (close / start_close) AS notional
FROM (
  SELECT *, place - start_place AS n, CAST(shares AS DOUBLE) / CAST(start_shares AS DOUBLE) AS ratio
  FROM (
    SELECT *, lag(date) OVER w AS start_date, lag(shares) OVER w AS start_shares, lag(place) OVER w AS start_place,
           lag(close) OVER w AS start_close, lag(age) OVER w AS start_age
    FROM share_points WINDOW w AS (PARTITION BY ticker ORDER BY date)
  ) WHERE shares IS NOT NULL AND start_shares IS NOT NULL
)
"""
)
cte("share_flows", "share_intervals")(
    """
SELECT *, CASE WHEN status = 'eligible' THEN ln(CAST(shares AS DOUBLE) / CAST(start_shares AS DOUBLE)) / n END AS rate
FROM (
  SELECT *, CASE WHEN factor IS NOT NULL OR large THEN 'suspected_corporate_action' WHEN n < 1 THEN 'no_price_date'
                 WHEN n > 5 THEN 'too_many_price_dates' ELSE 'eligible' END AS status
  FROM share_intervals
)
"""
)
cte("flow_rank", "share_flows")(
    """
SELECT a.ticker, a.date, count(b.rate) AS refs,
       CASE WHEN count(b.rate) >= 252 THEN 100.0::DOUBLE * (count(*) FILTER (WHERE b.rate < a.rate)
         + 0.5::DOUBLE * count(*) FILTER (WHERE b.rate = a.rate)) / count(b.rate) END AS percentile
FROM share_flows a LEFT JOIN share_flows b
  ON b.ticker = a.ticker AND b.status = 'eligible' AND b.next_place BETWEEN a.next_place - 755 AND a.next_place - 1
WHERE a.status = 'eligible' AND a.next_place IS NOT NULL GROUP BY a.ticker, a.date, a.rate
"""
)
oracle(
    "flow_proxy",
    f"""SELECT ticker, {day('start_date')}, {day('date', 'end_date')}, start_shares, shares AS end_shares,
  shares - start_shares AS delta_shares,
  round(CAST(shares - start_shares AS DOUBLE) / CAST(start_shares AS DOUBLE), 6) AS interval_share_change, n AS price_dates,
  {day('next_date', 'signal_date')}, status, round(rate, 6) AS raw_flow_rate, refs AS reference_count,
  percentile AS flow_percentile, round(ratio, 6) AS share_ratio, factor AS matched_factor,
  nullif(concat_ws('|', CASE WHEN factor IS NOT NULL THEN 'common_factor' END, CASE WHEN large THEN 'large_ratio' END), '') AS quarantine_reason,
  start_close, start_age AS start_close_age, close AS end_close, age AS end_close_age, round(notional, 6) AS notional_ratio,
  CASE WHEN factor IS NULL AND NOT large THEN NULL WHEN notional IS NULL THEN 'price_missing'
       WHEN notional <= 1.1::DOUBLE AND 1.0::DOUBLE / notional <= 1.1::DOUBLE THEN 'price_confirmed' ELSE 'price_inconsistent' END AS price_evidence,
  round(CAST(shares - start_shares AS DOUBLE) * close, 6) AS dollar_flow
FROM share_flows LEFT JOIN flow_rank USING (ticker, date)""",
    "share_flows",
    "flow_rank",
)

cte("held")(
    f"""
SELECT fund, entity, sum(weight) FILTER (WHERE long AND entity IS NOT NULL) AS weight,
       sum(weight) FILTER (WHERE long AND entity IS NULL) AS unmapped, sum(weight) FILTER (WHERE NOT long) AS excluded
FROM (
  SELECT {DESK} AS fund, CASE WHEN p_size <= 45 THEN concat_ws(' ', p_brand, p_name) END AS entity, l_returnflag <> 'R' AS long,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS weight
  FROM (SELECT *, l_suppkey // 20 AS slot FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey
) GROUP BY fund, entity
"""
)
oracle(
    "holdings_concentration",
    """SELECT fund, count(*) FILTER (WHERE weight > 0) AS entities,
  CAST(coalesce(sum(weight) FILTER (WHERE weight > 0), 0) AS BIGINT) AS eligible_weight,
  CAST(coalesce(sum(unmapped), 0) AS BIGINT) AS unmapped_weight, CAST(coalesce(sum(excluded), 0) AS BIGINT) AS excluded_weight,
  round(sum(p * p), 6) AS raw_hhi, round(10000.0::DOUBLE * sum(p * p), 6) AS hhi_points,
  round(1.0::DOUBLE / sum(p * p), 6) AS effective_holdings,
  round(100.0::DOUBLE * sum(p) FILTER (WHERE rank <= 10), 6) AS top_10_weight_pct
FROM (
  SELECT *, CASE WHEN weight > 0 THEN CAST(weight AS DOUBLE) / sum(CASE WHEN weight > 0 THEN weight END) OVER (PARTITION BY fund) END AS p,
         row_number() OVER (PARTITION BY fund ORDER BY weight DESC NULLS LAST) AS rank FROM held
) GROUP BY fund""",
    "held",
)

# ---------------------------------------------------------------- quality

cte("quotes")(
    """
SELECT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN '  ' ELSE c_name END AS ticker,
       CASE WHEN shown THEN c_acctbal END AS open,
       CASE WHEN shown THEN o_totalprice END AS high,
       CASE WHEN shown AND o_orderstatus <> 'F' THEN c_acctbal / 2.0::DOUBLE END AS low,
       CASE WHEN shown AND o_orderstatus <> 'O' THEN o_totalprice / 4.0::DOUBLE END AS close,
       CASE WHEN shown AND o_orderpriority = '5-LOW' THEN 'not a number'
            WHEN shown AND o_orderpriority = '4-NOT SPECIFIED' THEN 'infinite'
            WHEN shown THEN 'finite' END AS adjusted_kind,
       CASE WHEN shown THEN c_acctbal - 500.0::DOUBLE END AS volume
FROM (SELECT *, NOT (o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM') AS shown FROM orders
      JOIN customer ON o_custkey = c_custkey)
"""
)
QUOTE_RULES = {
    "nonfinite_adjusted_close": "adjusted_kind IN ('not a number', 'infinite')",
    "blank_ticker": "trim(ticker) = ''",
    "missing_date": "date IS NULL",
    "no_market_value": "open IS NULL AND high IS NULL AND low IS NULL AND close IS NULL AND adjusted_kind IS NULL AND volume IS NULL",
    "nonpositive_open": "open <= 0",
    "nonpositive_high": "high <= 0",
    "nonpositive_low": "low <= 0",
    "nonpositive_close": "close <= 0",
    "negative_volume": "volume < 0",
    "high_below_open": "high < open",
    "high_below_close": "high < close",
    "high_below_low": "high < low",
    "low_above_open": "low > open",
    "low_above_close": "low > close",
}


def quote_rules(*names: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{n}' AS rule, ticker, {day('date')} FROM quotes WHERE {QUOTE_RULES[n]}" for n in names
    )


oracle("dq_nonfinite", quote_rules("nonfinite_adjusted_close"), "quotes")
oracle("dq_keys", quote_rules("blank_ticker", "missing_date"), "quotes")
oracle("dq_all_missing", quote_rules("no_market_value"), "quotes")
oracle("dq_positive", quote_rules("nonpositive_open", "nonpositive_high", "nonpositive_low", "nonpositive_close"), "quotes")
oracle("dq_volume", quote_rules("negative_volume"), "quotes")
oracle(
    "dq_ohlc",
    quote_rules("high_below_open", "high_below_close", "high_below_low", "low_above_open", "low_above_close"),
    "quotes",
)
oracle(
    "violation_examples",
    f"""SELECT rule, ticker, date, example FROM (
  SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ticker NULLS FIRST, date NULLS FIRST) AS example FROM (
    {quote_rules(*QUOTE_RULES)}
    UNION ALL SELECT 'duplicate_key', ticker, CAST(date AS VARCHAR) FROM quotes GROUP BY ticker, date HAVING count(*) > 1
  )
) WHERE example <= 5""",
    "quotes",
)
cte("line_rows", "trades")(
    f"SELECT {SUPPLIER} AS ticker, date, units, side, hour FROM trades"
)
oracle(
    "dq_duplicate_keys",
    f"SELECT ticker, {day('date')}, count(*) AS copies FROM line_rows GROUP BY ticker, date HAVING count(*) > 1",
    "line_rows",
)
oracle(
    "dq_shares_positive",
    """SELECT 'nonpositive_shares_outstanding' AS rule, c_name AS ticker, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND c_acctbal <= 0""",
)
oracle(
    "dq_off_calendar",
    f"""SELECT ticker, {day('date')}, lines FROM (
  SELECT 'DESK' || lpad(CAST(l_suppkey // 20 AS VARCHAR), CAST(greatest(length(CAST(l_suppkey // 20 AS VARCHAR)), 7) AS INTEGER), '0') AS ticker, CAST(l_shipdate AS DATE) AS date, count(*) AS lines
  FROM lineitem GROUP BY ALL
) WHERE date NOT IN (SELECT session FROM cal)""",
    "cal",
)
cte("raw_feed")(
    f"""
SELECT {DESK} AS ticker, CAST(l_shipdate AS DATE) AS date FROM (SELECT l_suppkey // 20 AS slot, l_shipdate FROM lineitem)
"""
)
oracle(
    "signal_input_violations",
    f"""SELECT 'duplicate_key' AS rule, ticker, {day('date')} FROM raw_feed GROUP BY ticker, date HAVING count(*) > 1
UNION ALL
SELECT 'off_calendar', ticker, {day('date')} FROM raw_feed WHERE date NOT IN (SELECT session FROM cal)""",
    "raw_feed",
    "cal",
)
oracle(
    "window_violations",
    """SELECT ticker, count(*) AS rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date
FROM px WHERE date < DATE '1996-01-02' OR date >= DATE '2001-01-02' GROUP BY ticker""",
    "px",
)
oracle(
    "lossless_cast",
    """SELECT o_orderkey, 'bigint to double' AS "cast" FROM orders
WHERE CAST(CAST(o_orderkey + 9007199254740992 AS DOUBLE) AS BIGINT) <> o_orderkey + 9007199254740992
UNION ALL SELECT o_orderkey, 'double to bigint' FROM orders WHERE trunc(o_totalprice) <> o_totalprice""",
)

# ---------------------------------------------------------------- vintages

PRICE_SELECT = f"SELECT {day('date')}, ticker, open, high, low, close, adjusted_close, volume, {instant('retrieved_at')} FROM"
oracle("dedupe_prices", f"{PRICE_SELECT} px", "px")
oracle(
    "dedupe_conflicts",
    f"""SELECT ticker, {day('date')}, count(*) AS copies FROM line_rows
GROUP BY ticker, date HAVING count(DISTINCT CAST(units AS VARCHAR) || (side = 'O')::VARCHAR) > 1""",
    "line_rows",
)


def _shares(where: str = "true") -> str:
    return f"""
SELECT date, ticker, CAST(cents + base AS VARCHAR) AS shares_outstanding, CAST(date AS TIMESTAMP) + to_hours(hour + 21) AS retrieved_at
FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, 'NATION' || lpad(CAST(c_nationkey AS VARCHAR), CAST(greatest(length(CAST(c_nationkey AS VARCHAR)), 3) AS INTEGER), '0') AS ticker,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderstatus <> 'O') AS cents,
         any_value(CASE c_nationkey WHEN 6 THEN 9007199254740993::HUGEINT WHEN 9 THEN 9223372036854775809::HUGEINT ELSE 0::HUGEINT END) AS base,
         max(CAST(substr(o_orderpriority, 1, 1) AS BIGINT)) AS hour
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE {where} GROUP BY 1, 2
)"""


cte("shares")(_shares())
cte("shares_first")(_shares("o_orderstatus <> 'F'"))
cte("shares_second")(_shares("o_orderstatus <> 'P'"))
oracle("scan_shares", f"SELECT {day('date')}, ticker, shares_outstanding, {instant('retrieved_at')} FROM shares", "shares")
oracle(
    "dedupe_shares",
    f"SELECT {day('date')}, ticker, shares_outstanding, {instant('retrieved_at + INTERVAL 12 HOURS', 'retrieved_at')} FROM shares",
    "shares",
)


def _merge(first: str, second: str, values: tuple[str, ...]) -> str:
    lose = " OR ".join(f"(e.{c} IS NOT NULL AND i.{c} IS NULL)" for c in values)
    same = " AND ".join(f"e.{c} IS NOT DISTINCT FROM i.{c}" for c in values)
    took = "action IN ('new', 'revise')"
    return f"""
SELECT ticker, date, action, {', '.join(f"CASE WHEN {took} THEN i_{c} ELSE e_{c} END AS {c}" for c in values)},
       CASE WHEN {took} OR action = 'advance' THEN i_at ELSE e_at END AS retrieved_at,
       {', '.join(f'e_{c}, i_{c}' for c in values)}
FROM (
  SELECT coalesce(e.ticker, i.ticker) AS ticker, coalesce(e.date, i.date) AS date,
         CASE WHEN i.ticker IS NULL THEN 'existing_only' WHEN e.ticker IS NULL THEN 'new' WHEN {lose} THEN 'lose'
              WHEN {same} AND i.retrieved_at > e.retrieved_at THEN 'advance' WHEN {same} THEN 'identical'
              WHEN i.retrieved_at < e.retrieved_at THEN 'stale' WHEN i.retrieved_at = e.retrieved_at THEN 'conflict'
              ELSE 'revise' END AS action,
         {', '.join(f'e.{c} AS e_{c}, i.{c} AS i_{c}' for c in values)}, e.retrieved_at AS e_at, i.retrieved_at AS i_at
  FROM {first} e FULL JOIN {second} i ON e.ticker = i.ticker AND e.date = i.date
)"""


VALUES = ("open", "high", "low", "close", "adjusted_close", "volume")
cte("merge_px", "px_first", "px_second")(_merge("px_first", "px_second", VALUES))
cte("merge_sh", "shares_first", "shares_second")(_merge("shares_first", "shares_second", ("shares_outstanding",)))
cte("merge_full", "px_first", "px")(_merge("px_first", "px", VALUES))
cte("shares_later", "shares")("SELECT * REPLACE (retrieved_at + INTERVAL 12 HOURS AS retrieved_at) FROM shares")
cte("persist_px", "px_first", "px_later")(_merge("px_first", "px_later", VALUES))
cte("persist_sh", "shares_first", "shares_later")(_merge("shares_first", "shares_later", ("shares_outstanding",)))
oracle("persist_prices", f"{PRICE_SELECT} persist_px", "persist_px")
oracle(
    "persist_revisions",
    "SELECT ticker, count(*) AS revised_rows FROM persist_px WHERE action = 'revise' GROUP BY ticker",
    "persist_px",
)
oracle("snapshot_rows", f"{PRICE_SELECT} px_first", "px_first")
oracle(
    "persist_shares",
    f"SELECT ticker, {day('date')}, shares_outstanding, {instant('retrieved_at')} FROM persist_sh",
    "persist_sh",
)
oracle(
    "stream_updates",
    f"""SELECT ticker, {day('date')}, adjusted_close, {instant('retrieved_at')}, 'held' AS outcome FROM merge_px
UNION ALL SELECT ticker, CAST(date AS VARCHAR), NULL, NULL, action FROM merge_px WHERE action IN ('lose', 'stale', 'conflict')""",
    "merge_px",
)
oracle(
    "harmonise_vintages",
    """SELECT o_orderkey, o_orderkey + 9007199254740992 AS units FROM orders
UNION ALL SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) FROM orders""",
)
oracle("merge_actions", f"SELECT ticker, {day('date')}, action FROM merge_px", "merge_px")
oracle("merge_prices", f"{PRICE_SELECT} merge_px", "merge_px")
oracle(
    "merge_shares",
    f"SELECT ticker, {day('date')}, shares_outstanding, {instant('retrieved_at')}, action FROM merge_sh",
    "merge_sh",
)
oracle(
    "revision_summary",
    "SELECT ticker, count(*) AS revised_rows FROM merge_px WHERE action = 'revise' GROUP BY ticker",
    "merge_px",
)
oracle(
    "vanished_rows",
    f"""SELECT e.ticker, {day('e.date')} FROM px_first e
WHERE e.ticker IN (SELECT ticker FROM px_second) AND e.date >= DATE '1996-01-02' AND e.date < DATE '2001-01-02'
AND NOT EXISTS (SELECT 1 FROM px_second i WHERE i.ticker = e.ticker AND i.date = e.date)""",
    "px_first",
    "px_second",
)
oracle(
    "common_keys",
    f"SELECT ticker, {day('date')} FROM px_first INTERSECT SELECT ticker, CAST(date AS VARCHAR) FROM px_second",
    "px_first",
    "px_second",
)
oracle(
    "missing_sessions",
    f"SELECT ticker, {day('session', 'date')} FROM grid JOIN bounds b ON session BETWEEN b.lo AND b.hi WHERE NOT row_present",
    "grid",
    "bounds",
)
oracle(
    "frame_diff",
    f"""SELECT ticker, {day('date')}, high, low, close, volume, CAST(sum(side) AS BIGINT) AS surplus,
CASE WHEN sum(side) > 0 THEN 'left' ELSE 'right' END AS only_in
FROM (SELECT *, 1 AS side FROM px_first UNION ALL SELECT *, -1 FROM px_second)
GROUP BY ticker, date, high, low, close, volume HAVING sum(side) <> 0""",
    "px_first",
    "px_second",
)
SHARED = "action NOT IN ('new', 'existing_only')"


def _changed(c: str) -> str:
    return f"(e_{c} IS NOT NULL AND i_{c} IS NOT NULL AND e_{c} <> i_{c})"


def _measure(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS measure, count(*) FILTER (WHERE {condition}) AS rows FROM merge_full"


def _signal_measures(component: str, frame: str, raw: str, percentile: str) -> str:
    changes = {"shared_signal_keys": "true", "raw_changed": raw, "percentile_changed": percentile}
    return "\nUNION ALL ".join(
        f"""SELECT '{component}_{name}', count(*) FILTER (WHERE {
            'true' if column == 'true' else f'a.{column} IS DISTINCT FROM b.{column}'
        }) FROM first_{frame} a JOIN {frame} b USING (ticker, signal_date)"""
        for name, column in changes.items()
    )


oracle(
    "vintage_diff",
    "\nUNION ALL ".join(
        [
            _measure("shared_keys", SHARED),
            _measure("added_keys", "action = 'new'"),
            _measure("removed_keys", "action = 'existing_only'"),
            _measure("changed_rows", f"{SHARED} AND (" + " OR ".join(_changed(c) for c in VALUES) + ")"),
            *[_measure(f"{c}_changed", f"{SHARED} AND {_changed(c)}") for c in VALUES],
            _signal_measures("momentum", "mom", "raw_momentum", "momentum_percentile"),
            _signal_measures("volatility", "vol", "raw_annualized_volatility", "volatility_percentile"),
        ]
    ),
    "merge_full",
    "mom",
    "vol",
    "first_mom",
    "first_vol",
)

# ---------------------------------------------------------------- sources

cte("answers")(
    f"""
SELECT 'SUP' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(length(CAST(s_suppkey AS VARCHAR)), 9) AS INTEGER), '0') AS ticker, s_nationkey AS nation,
       TIMESTAMP '2002-01-01 00:00:00' + to_hours(s_nationkey) AS answered_at,
       CASE WHEN s_acctbal < 0 THEN 'provider reported an error'
            WHEN s_nationkey = 3 THEN 'symbol differs from the requested ticker'
            WHEN s_nationkey = 11 THEN 'field volume is malformed' END AS issue
FROM supplier
"""
)
cte("chart_out", "answers", "px_supplier")(
    """
SELECT CASE WHEN nation = 13 THEN date - 3651 ELSE date END AS date, ticker, open, high, low, close, adjusted_close, volume,
       answered_at AS retrieved_at, nation
FROM px_supplier JOIN answers USING (ticker) WHERE issue IS NULL AND nation <> 7
"""
)
cte("batch", "answers", "chart_out", "bounds", "px_supplier")(
    """
SELECT ticker, CASE WHEN error IS NOT NULL THEN 'failed' WHEN n > 0 THEN 'success' ELSE 'empty' END AS status,
       CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS rows_received,
       CASE WHEN error IS NULL THEN lo END AS first_date, CASE WHEN error IS NULL THEN hi END AS last_date,
       CASE WHEN error IS NULL THEN answered_at END AS retrieved_at,
       CASE WHEN error IS NULL THEN coalesce(days, '') ELSE '' END AS returned_dates, error
FROM (
  SELECT a.ticker, a.answered_at, c.*EXCLUDE (ticker),
         CASE WHEN a.issue IS NOT NULL THEN 'PriceNormalizationError: ' || a.issue
              WHEN c.nation = 13 THEN 'PriceDataValidationError: outside_request_window' END AS error
  FROM answers a LEFT JOIN (
    SELECT ticker, any_value(nation) AS nation, count(*) AS n, min(date) AS lo, max(date) AS hi,
           string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS days FROM chart_out GROUP BY ticker
  ) c ON c.ticker = a.ticker
  WHERE a.ticker IN (SELECT ticker FROM px_supplier)
  UNION ALL
  SELECT 'IDX' || lpad(CAST(r_regionkey AS VARCHAR), CAST(greatest(length(CAST(r_regionkey AS VARCHAR)), 3) AS INTEGER), '0'), (SELECT max(answered_at) FROM answers WHERE ticker IN (SELECT ticker FROM px_supplier)), NULL, NULL, NULL, NULL, NULL, NULL FROM region
)
"""
)
oracle("ingest_chart_json", f"{PRICE_SELECT} chart_out", "chart_out")
WINDOW = "(SELECT CAST(lo - 10 AS VARCHAR) FROM bounds) AS query_start, (SELECT CAST(hi + 1 AS VARCHAR) FROM bounds) AS query_end"
oracle(
    "ingest_batch_status",
    f"""SELECT ticker, status, rows_received, {day('first_date')}, {day('last_date')}, {instant('retrieved_at')}, {WINDOW},
returned_dates, error FROM batch""",
    "batch",
    "bounds",
)
oracle(
    "status_summary",
    """SELECT status, count(*) AS tickers, CAST(sum(rows_received) AS BIGINT) AS rows_received,
CAST(min(first_date) AS VARCHAR) AS first_date, CAST(max(last_date) AS VARCHAR) AS last_date,
min(ticker) AS first_ticker, max(ticker) AS last_ticker FROM batch GROUP BY status""",
    "batch",
)
oracle(
    "batch_retrieved_at",
    "SELECT strftime(max(retrieved_at), '%Y-%m-%d %H:%M:%S') AS retrieved_at, count(*) AS tickers FROM batch",
    "batch",
)
oracle(
    "acquisition_view",
    f"{PRICE_SELECT} chart_out WHERE ticker IN (SELECT ticker FROM batch WHERE status = 'success')",
    "chart_out",
    "batch",
)
oracle(
    "dq_status_reconcile",
    f"""
WITH claimed AS (SELECT ticker, date, max(retrieved_at) OVER (PARTITION BY ticker) AS claimed_at FROM px_second)
SELECT rule, ticker, {day('date')} FROM (
  SELECT CASE WHEN i.ticker IS NULL THEN 'claimed_row_absent' WHEN c.ticker IS NULL THEN 'unclaimed_row'
              WHEN c.claimed_at <> i.retrieved_at THEN 'retrieval_time_differs' END AS rule,
         coalesce(c.ticker, i.ticker) AS ticker, coalesce(c.date, i.date) AS date
  FROM claimed c FULL JOIN px_first i ON c.ticker = i.ticker AND c.date = i.date
  UNION ALL SELECT 'unexpected_query_end', ticker, NULL FROM (SELECT DISTINCT ticker FROM px_second)
  UNION ALL SELECT 'status_missing', ticker, NULL FROM univ WHERE ticker NOT IN (SELECT ticker FROM px_second)
) WHERE rule IS NOT NULL""".strip(),
)
ORACLES["dq_status_reconcile"] = statement(
    ORACLES["dq_status_reconcile"].replace("WITH claimed AS", "SELECT * FROM (WITH claimed AS", 1) + ")",
    "px_first",
    "px_second",
    "univ",
)
cte("share_answers", "shares")(
    """
SELECT ticker, nation, TIMESTAMP '2002-01-01 00:00:00' + to_hours(nation) AS answered_at,
       CASE nation WHEN 4 THEN 'symbol differs from the requested ticker' WHEN 12 THEN 'list lengths differ' END AS issue,
       n, lo, hi, days
FROM (SELECT ticker, CAST(substr(ticker, 7, 3) AS BIGINT) AS nation, count(*) AS n, min(date) AS lo, max(date) AS hi,
             string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS days FROM shares GROUP BY ticker)
"""
)
oracle(
    "ingest_shares_json",
    f"""SELECT {day('date')}, ticker, shares_outstanding, {instant('answered_at', 'retrieved_at')}
FROM shares JOIN share_answers USING (ticker) WHERE issue IS NULL AND nation <> 8""",
    "shares",
    "share_answers",
)
oracle(
    "ingest_shares_status",
    """SELECT ticker, CASE WHEN issue IS NOT NULL THEN 'failed' WHEN nation = 8 THEN 'empty' ELSE 'success' END AS status,
CASE WHEN ok THEN n ELSE 0 END AS rows_received, CASE WHEN ok THEN CAST(lo AS VARCHAR) END AS first_date,
CASE WHEN ok THEN CAST(hi AS VARCHAR) END AS last_date,
CASE WHEN issue IS NULL THEN strftime(answered_at, '%Y-%m-%d %H:%M:%S') END AS retrieved_at,
CAST(NULL AS VARCHAR) AS query_start, CAST(NULL AS VARCHAR) AS query_end,
CASE WHEN ok THEN days ELSE '' END AS returned_dates, 'SharesNormalizationError: ' || issue AS error
FROM (SELECT *, issue IS NULL AND nation <> 8 AS ok FROM share_answers)""",
    "share_answers",
)
cte("region_trades", "trades")(
    """
SELECT t.*EXCLUDE (slot), n_regionkey AS slot FROM trades t JOIN supplier ON s_suppkey = suppkey
JOIN nation ON n_nationkey = s_nationkey
"""
)
cte("px_region", "region_trades")(_bars("'REG' || slot", "region_trades"))
cte("px_market", "trades")(_bars("'MARKET'", "trades"))
FIXED_SELECT = f"SELECT {day('date')}, ticker, open, high, low, close, adjusted_close, volume, '2002-01-01 06:00:00' AS retrieved_at FROM"
cte("wide", "px_region")(
    """
SELECT d.date, r.ticker, r.label, p.open, p.high, p.low, p.close, p.adjusted_close, p.volume
FROM (SELECT DISTINCT date FROM px_region) d
JOIN (SELECT unnest(['REG0', 'REG2', 'REG4']) AS ticker, unnest(['REG0', 'reg2', 'REG4']) AS label) r ON true
LEFT JOIN px_region p ON p.date = d.date AND p.ticker = r.ticker
"""
)
oracle("unpivot_wide_prices", FIXED_SELECT.replace("ticker,", "label AS ticker,", 1) + " wide", "wide")
oracle("normalize_flat_prices", f"{FIXED_SELECT} px_market", "px_market")
oracle(
    "normalize_shares",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'CUST' || o_custkey AS ticker,
CASE WHEN o_orderstatus <> 'O' THEN floor(o_totalprice) END AS shares_outstanding, '2002-01-01 06:00:00' AS retrieved_at
FROM orders""",
)
oracle(
    "universe_check",
    """SELECT 'blank_category' AS rule, CASE WHEN p_type = 'ECONOMY' THEN upper(p_name) ELSE p_name END AS ticker FROM part WHERE p_size < 3
UNION ALL
SELECT 'duplicate_ticker', min(CASE WHEN p_type = 'ECONOMY' THEN upper(p_name) ELSE p_name END) FROM part
GROUP BY lower(trim(p_name)) HAVING count(*) > 1""",
)
UNIVERSE_HASH = """SELECT sha256(string_agg(digest, '' ORDER BY block)) AS universe_sha256,
CAST(sum(n) AS BIGINT) AS instruments FROM (
  SELECT (ord - 1) // 10000 AS block, count(*) AS n, sha256('[' || string_agg(
    '{"category":"' || category || '","name":"' || name || '","ticker":"' || ticker || '"}', ',' ORDER BY ord) || ']') AS digest
  FROM univ GROUP BY 1
)"""
oracle("universe_hash", UNIVERSE_HASH, "univ")
oracle(
    "default_end_date",
    """SELECT event_id, CAST(CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS default_end FROM events""",
)
oracle(
    "shares_query_window",
    """
SELECT ticker, CAST(CAST(s AS DATE) AS VARCHAR) AS query_start,
       CAST(CAST(e AS DATE) + CASE WHEN CAST(CAST(e AS DATE) AS TIMESTAMP) = e THEN 0 ELSE 1 END AS VARCHAR) AS query_end,
       s_utc >= e_utc AS reversed
FROM (
  SELECT *, timezone(zone, timezone('UTC', e_utc)) AS e, timezone(zone, timezone('UTC', s_utc)) AS s
  FROM (
    SELECT *, coalesce(timezone('UTC', timezone(zone, CAST(start AS TIMESTAMP))), e_utc - INTERVAL 548 DAYS) AS s_utc
    FROM (
      SELECT CAST(event_id AS VARCHAR) AS ticker, zone, start,
             coalesce(timezone('UTC', timezone(zone, CAST("end" AS TIMESTAMP))), ts) AS e_utc
      FROM (
        SELECT event_id, ts,
               CASE event_type WHEN 'click' THEN 'Asia/Tokyo' WHEN 'view' THEN 'Europe/London' ELSE 'America/New_York' END AS zone,
               CASE event_type WHEN 'error' THEN CAST(ts AS DATE) - 30 WHEN 'purchase' THEN CAST(ts AS DATE) + 30 END AS start,
               CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(ts AS DATE) END AS "end"
        FROM events
      )
    )
  )
)""",
)
cte("event_cal", "holidays", "early")(
    """
SELECT d AS session,
       timezone('UTC', timezone('America/New_York', CAST(d AS TIMESTAMP)
         + CASE WHEN d IN (SELECT d FROM early) THEN INTERVAL 13 HOURS ELSE INTERVAL 16 HOURS END)) AS close_utc
FROM (SELECT CAST(unnest(generate_series(lo - 370, hi + 370, INTERVAL 1 DAY)) AS DATE) AS d
      FROM (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events))
WHERE isodow(d) <= 5 AND d NOT IN (SELECT d FROM holidays)
"""
)
oracle(
    "resolve_target",
    """SELECT event_id, CAST(max(session) AS VARCHAR) AS target_session, '2018-01-01' AS request_start,
CAST(max(session) + 1 AS VARCHAR) AS request_end, 'resolved' AS target_status
FROM events JOIN event_cal ON close_utc <= ts AND session >= CAST(ts AS DATE) - 15 WHERE event_type <> 'error' GROUP BY event_id
UNION ALL SELECT event_id, NULL, '2018-01-01', NULL, 'outside_known_calendar' FROM events WHERE event_type = 'error'""",
    "event_cal",
)
RUN = "strftime(ts, '%Y%m%dT%H%M%S%fZ')"
oracle("run_id", f"SELECT event_id, {RUN} AS run_id FROM events")
oracle(
    "classify_runs",
    f"""SELECT CASE event_type WHEN 'error' THEN {RUN} || '.invalid-1' WHEN 'view' THEN '.' || {RUN} || '.tmp-1'
WHEN 'signup' THEN 'note-' || event_id WHEN 'purchase' THEN 'note.tmp-' || event_id ELSE {RUN} END AS name,
CASE event_type WHEN 'error' THEN 'quarantined' WHEN 'view' THEN 'temporary' WHEN 'signup' THEN 'rejected' WHEN 'purchase' THEN 'rejected' ELSE 'run' END AS kind
FROM events""",
)


# ---------------------------------------------------------------- evaluation

cte("ev", "cal", "bounds")("SELECT session, pos FROM cal JOIN bounds b ON session BETWEEN b.lo - 10 AND b.hi")
oracle(
    "evaluation_slice",
    f"""SELECT ticker, {day('date')}, close, adjusted_close FROM px
WHERE date BETWEEN DATE '1996-01-02' AND DATE '2000-12-29' AND ticker IN (SELECT ticker FROM univ)""",
    "px",
    "univ",
)
cte("cov_px", "univ", "ev", "px", "bounds")(
    """
SELECT u.ticker, min(p.retrieved_at) AS input_first_retrieved_at, max(p.retrieved_at) AS input_last_retrieved_at,
       min(p.date) AS first_canonical_date, max(p.date) AS last_canonical_date,
       count(*) AS expected_xnys_observation_count, count(p.date) AS present_xnys_observation_count,
       count(*) - count(p.date) AS missing_canonical_count,
       coalesce(string_agg(CAST(session AS VARCHAR), ',' ORDER BY session) FILTER (WHERE p.date IS NULL), '') AS missing_canonical_dates,
       count(*) FILTER (WHERE p.date IS NOT NULL AND p.adjusted_close IS NULL) AS missing_adjusted_close_count,
       coalesce(string_agg(CAST(session AS VARCHAR), ',' ORDER BY session)
                FILTER (WHERE p.date IS NOT NULL AND p.adjusted_close IS NULL), '') AS missing_adjusted_close_dates,
       min(p.date) FILTER (WHERE p.adjusted_close IS NOT NULL) AS first_adjusted_close_date,
       max(p.date) FILTER (WHERE p.adjusted_close IS NOT NULL) AS last_adjusted_close_date,
       bool_or(session = b.hi AND p.date IS NOT NULL) AS target_price_row_present,
       bool_or(session = b.hi AND p.adjusted_close IS NOT NULL) AS target_adjusted_close_present
FROM univ u JOIN ev ON true JOIN bounds b ON true LEFT JOIN px p ON p.ticker = u.ticker AND p.date = session GROUP BY u.ticker
"""
)


def _signal_cov(prefix: str, frame: str, raw: str, display: str, display_name: str, percentile: str, status: str) -> str:
    return f"""
SELECT *, CASE WHEN NOT seen THEN 'ticker_unavailable' WHEN {prefix}_target_raw IS NULL THEN 'raw_ineligible'
               WHEN {prefix}_target_percentile IS NULL THEN 'insufficient_reference_history' ELSE 'eligible' END
          AS {prefix}_target_normalization_status,
       {prefix}_target_raw IS NOT NULL AS {prefix}_target_raw_eligible,
       {prefix}_target_percentile IS NOT NULL AS {prefix}_target_normalized_eligible,
       last_pos - (SELECT pos FROM cal c WHERE c.session = {prefix}_last_raw_date) AS {prefix}_raw_staleness_sessions,
       last_pos - (SELECT pos FROM cal c WHERE c.session = {prefix}_last_normalized_date) AS {prefix}_normalized_staleness_sessions
FROM (
  SELECT u.ticker, any_value(b.hi_pos) AS last_pos,
         min(s.signal_date) FILTER (WHERE s.{raw} IS NOT NULL) AS {prefix}_first_raw_date,
         max(s.signal_date) FILTER (WHERE s.{raw} IS NOT NULL) AS {prefix}_last_raw_date,
         min(s.signal_date) FILTER (WHERE s.{percentile} IS NOT NULL) AS {prefix}_first_normalized_date,
         max(s.signal_date) FILTER (WHERE s.{percentile} IS NOT NULL) AS {prefix}_last_normalized_date,
         round(max(s.{raw}) FILTER (WHERE s.signal_date = b.hi), 6) AS {prefix}_target_raw,
         round(max(s.{display}) FILTER (WHERE s.signal_date = b.hi), 6) AS {prefix}_target_{display_name},
         max(s.{percentile}) FILTER (WHERE s.signal_date = b.hi) AS {prefix}_target_percentile,
         coalesce(max(s.{status}) FILTER (WHERE s.signal_date = b.hi), 'ticker_unavailable') AS {prefix}_target_status,
         max(s.normalization_reference_count) FILTER (WHERE s.signal_date = b.hi) AS {prefix}_target_reference_count,
         count(s.ticker) > 0 AS seen
  FROM univ u JOIN bounds b ON true LEFT JOIN {frame} s ON s.ticker = u.ticker GROUP BY u.ticker
)"""


cte("cov_mom", "univ", "bounds", "mom", "cal")(
    _signal_cov("momentum", "mom", "raw_momentum", "simple_return_pct", "simple_return_pct", "momentum_percentile", "endpoint_status")
)
cte("cov_vol", "univ", "bounds", "vol", "cal")(
    _signal_cov(
        "volatility",
        "vol",
        "raw_annualized_volatility",
        "annualized_volatility_pct",
        "annualized_pct",
        "volatility_percentile",
        "window_status",
    )
)
cte("cov", "univ", "bounds", "cal", "cov_px", "cov_mom", "cov_vol")(
    """
SELECT u.ord, u.ticker, u.name, u.category, 'not_requested' AS acquisition_status,
       CAST(NULL AS VARCHAR) AS acquisition_error, CAST(NULL AS BIGINT) AS acquisition_rows_received,
       CAST(NULL AS VARCHAR) AS acquisition_retrieved_at, p.*EXCLUDE (ticker),
       b.lo - 10 AS request_start, b.hi + 1 AS request_end_exclusive, b.hi AS target_session,
       b.hi_pos - (SELECT pos FROM cal c WHERE c.session = p.last_adjusted_close_date) AS price_staleness_sessions,
       m.*EXCLUDE (ticker, last_pos, seen), v.*EXCLUDE (ticker, last_pos, seen)
FROM univ u JOIN cov_px p USING (ticker) JOIN cov_mom m USING (ticker) JOIN cov_vol v USING (ticker), bounds b
"""
)
COVERAGE_DATES = (
    "request_start request_end_exclusive target_session first_canonical_date last_canonical_date first_adjusted_close_date "
    "last_adjusted_close_date momentum_first_raw_date momentum_last_raw_date momentum_first_normalized_date "
    "momentum_last_normalized_date volatility_first_raw_date volatility_last_raw_date volatility_first_normalized_date "
    "volatility_last_normalized_date"
).split()
COVERAGE_INSTANTS = ("input_first_retrieved_at", "input_last_retrieved_at")
oracle(
    "coverage",
    "SELECT * REPLACE ("
    + ", ".join(
        [f"CAST({c} AS VARCHAR) AS {c}" for c in COVERAGE_DATES]
        + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in COVERAGE_INSTANTS]
    )
    + ") FROM cov",
    "cov",
)
PX_DATES = ("first_canonical_date", "last_canonical_date", "first_adjusted_close_date", "last_adjusted_close_date")
oracle(
    "coverage_prices",
    "SELECT * EXCLUDE (expected_xnys_observation_count, missing_canonical_count, missing_adjusted_close_count) REPLACE ("
    + ", ".join(
        [f"CAST({c} AS VARCHAR) AS {c}" for c in PX_DATES]
        + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in COVERAGE_INSTANTS]
    )
    + ") FROM cov_px WHERE present_xnys_observation_count > 0",
    "cov_px",
)
oracle(
    "coverage_missing_dates",
    "SELECT ticker, missing_canonical_dates FROM cov_px WHERE present_xnys_observation_count > 0",
    "cov_px",
)

# ---------------------------------------------------------------- dependence

cte("pairs", "mom", "vol", "univ")(
    """
SELECT u.ord, ticker, signal_date, momentum_percentile AS x, volatility_percentile AS y
FROM mom JOIN vol USING (ticker, signal_date) JOIN univ u USING (ticker)
WHERE momentum_percentile IS NOT NULL AND volatility_percentile IS NOT NULL
"""
)


def _correlated(group: str) -> str:
    return f"""
SELECT {group}, count(*) AS pair_count, min(signal_date) AS first_date, max(signal_date) AS last_date,
       string_agg(ticker, ',' ORDER BY ord) AS members,
       CASE WHEN count(*) < 3 THEN 'insufficient_pairs' WHEN min(x) = max(x) OR min(y) = max(y) THEN 'constant_input'
            ELSE 'available' END AS status,
       CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson,
       CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS spearman
FROM (
  SELECT *, rank() OVER (PARTITION BY {group} ORDER BY x) + (count(*) OVER (PARTITION BY {group}, x) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (PARTITION BY {group} ORDER BY y) + (count(*) OVER (PARTITION BY {group}, y) - 1) / 2.0::DOUBLE AS ry
  FROM pairs
) GROUP BY {group}"""


cte("by_ticker", "pairs")(_correlated("ticker"))
cte("by_session", "pairs")(_correlated("signal_date"))
oracle("dependence_pearson", "SELECT ticker, pair_count, status, round(pearson, 6) AS pearson FROM by_ticker", "by_ticker")
oracle("dependence_spearman", "SELECT ticker, pair_count, status, round(spearman, 6) AS spearman FROM by_ticker", "by_ticker")
cte("dep_ticker", "univ", "by_ticker")(
    """
SELECT 'per_etf' AS scope, estimator, u.ticker, CAST(NULL AS VARCHAR) AS signal_date, coalesce(pair_count, 0) AS pair_count,
       CAST(first_date AS VARCHAR) AS first_signal_date, CAST(last_date AS VARCHAR) AS last_signal_date,
       CASE WHEN pair_count > 0 THEN u.ticker ELSE '' END AS included_tickers, 'not_applicable' AS universe_status,
       coalesce(status, 'insufficient_pairs') AS status,
       CASE WHEN status = 'available' THEN round(CASE estimator WHEN 'pearson' THEN pearson ELSE spearman END, 6) END AS estimate
FROM univ u LEFT JOIN by_ticker USING (ticker), (SELECT unnest(['pearson', 'spearman']) AS estimator)
"""
)
cte("dep_session", "ev", "by_session", "univ")(
    """
SELECT 'per_session' AS scope, estimator, CAST(NULL AS VARCHAR) AS ticker, CAST(session AS VARCHAR) AS signal_date,
       coalesce(pair_count, 0) AS pair_count, CAST(first_date AS VARCHAR) AS first_signal_date,
       CAST(last_date AS VARCHAR) AS last_signal_date, coalesce(members, '') AS included_tickers,
       CASE WHEN pair_count = (SELECT count(*) FROM univ) THEN 'full_universe' ELSE 'incomplete_universe' END AS universe_status,
       coalesce(status, 'insufficient_pairs') AS status,
       CASE WHEN status = 'available' THEN round(CASE estimator WHEN 'pearson' THEN pearson ELSE spearman END, 6) END AS estimate
FROM ev LEFT JOIN by_session ON signal_date = session, (SELECT unnest(['pearson', 'spearman']) AS estimator)
"""
)
oracle("dependence_by_ticker", "SELECT * FROM dep_ticker", "dep_ticker")
oracle("dependence_by_session", "SELECT * FROM dep_session", "dep_session")
oracle("dependence", "SELECT * FROM dep_ticker UNION ALL SELECT * FROM dep_session", "dep_ticker", "dep_session")
oracle(
    "dependence_history",
    "SELECT signal_date, pair_count, universe_status, status, estimate FROM dep_session WHERE estimator = 'spearman'",
    "dep_session",
)

# ---------------------------------------------------------------- publication and verification

oracle(
    "publish_manifest",
    """
SELECT 'input_prices' AS artifact, 'input_prices.parquet' AS filename, 9 AS fields, count(*) AS row_count FROM px
UNION ALL SELECT 'coverage', 'coverage.parquet', 54, count(*) FROM univ
UNION ALL SELECT 'momentum', 'momentum.parquet', 18, count(*) FROM mom
UNION ALL SELECT 'volatility', 'volatility.parquet', 15, count(*) FROM vol
UNION ALL SELECT 'dependence', 'dependence.parquet', 11, (SELECT count(*) FROM dep_ticker) + (SELECT count(*) FROM dep_session)""",
    "px",
    "univ",
    "mom",
    "vol",
    "dep_ticker",
    "dep_session",
)
COVERAGE_SIGNALS = [
    f"{signal}_{field}"
    for signal, raw in (("momentum", "simple_return_pct"), ("volatility", "annualized_pct"))
    for field in (
        "first_raw_date", "last_raw_date", "first_normalized_date", "last_normalized_date", "target_raw_eligible",
        "target_normalized_eligible", "target_raw", f"target_{raw}", "target_percentile", "target_status",
        "target_normalization_status", "target_reference_count", "raw_staleness_sessions", "normalized_staleness_sessions",
    )
]
COVERAGE_FIELDS = (
    "ord", "ticker", "name", "category", "acquisition_status", "acquisition_error", "acquisition_rows_received",
    "acquisition_retrieved_at", "input_first_retrieved_at", "input_last_retrieved_at", "request_start", "request_end_exclusive",
    "target_session", "first_canonical_date", "last_canonical_date", "expected_xnys_observation_count",
    "present_xnys_observation_count", "missing_canonical_count", "missing_canonical_dates", "missing_adjusted_close_count",
    "missing_adjusted_close_dates", "first_adjusted_close_date", "last_adjusted_close_date", "target_price_row_present",
    "target_adjusted_close_present", "price_staleness_sessions", *COVERAGE_SIGNALS,
)
DEPENDENCE_FIELDS = (
    "scope", "estimator", "ticker", "signal_date", "pair_count", "first_signal_date", "last_signal_date",
    "included_tickers", "universe_status", "status", "estimate",
)


def _inventory(artifact: str, source: str, columns: tuple[str, ...]) -> str:
    def kind(c: str) -> str:
        if c.endswith("_dates"):
            return "array<date>"
        if c == "included_tickers":
            return "array<string>"
        if c in ("date", "first_prospective_session", "request_start", "request_end_exclusive", "target_session") or c.endswith("_date"):
            return "date"
        if c == "ord" or c.endswith(("_count", "_sessions", "_received")):
            return "bigint"
        if c.endswith(("_eligible", "_present")):
            return "boolean"
        if c.endswith("retrieved_at"):
            return "timestamp"
        texts = ("ticker", "name", "category", "scope", "estimator", "status", "acquisition_error")
        return "string" if c in texts or c.endswith("_status") else "double"

    fields = ", ".join(f"({i}, '{c}', '{kind(c)}')" for i, c in enumerate(columns, 1))
    return f"""SELECT '{artifact}' AS artifact, '{artifact}.parquet' AS filename, (SELECT count(*) FROM {source}) AS row_count,
position, field, type FROM (VALUES {fields}) AS t (position, field, type)"""


oracle(
    "artifact_inventory",
    "\nUNION ALL ".join(
        _inventory(*x)
        for x in (
            ("input_prices", "px", PRICE_COLUMNS),
            ("momentum", "mom", MOMENTUM_COLUMNS),
            ("volatility", "vol", VOLATILITY_COLUMNS),
            ("coverage", "univ", COVERAGE_FIELDS),
            ("dependence", "(SELECT ticker FROM dep_ticker UNION ALL SELECT NULL FROM dep_session)", DEPENDENCE_FIELDS),
        )
    ),
    "px",
    "mom",
    "vol",
    "univ",
    "dep_ticker",
    "dep_session",
)


def _double_text(c: str) -> str:
    """Sign, whole significand and exponent of a finite double."""
    near = f"floor(log2(abs({c})))"
    exponent = (
        f"CAST({near} + CASE WHEN abs({c}) >= pow(2.0::DOUBLE, {near} + 1) THEN 1 ELSE 0 END"
        f" - CASE WHEN abs({c}) < pow(2.0::DOUBLE, {near}) THEN 1 ELSE 0 END AS BIGINT)"
    )
    half = f"floor({exponent} / 2)"
    whole = f"abs({c}) * pow(2.0::DOUBLE, -{half}) * pow(2.0::DOUBLE, {half} - {exponent}) * pow(2.0::DOUBLE, 52)"
    return f"CASE WHEN {c} = 0 THEN '0' ELSE CASE WHEN {c} < 0 THEN '-' ELSE '' END || CAST(CAST({whole} AS BIGINT) AS VARCHAR) || 'e' || CAST({exponent} AS VARCHAR) END"


def _framed(text: str) -> str:
    return f"CASE WHEN ({text}) IS NULL THEN 'n' ELSE length({text}) || ':' || ({text}) END"


_PX_TEXT = [
    "CAST(date AS VARCHAR)", "ticker", *[_double_text(c) for c in VALUES], "CAST(epoch_us(retrieved_at) AS VARCHAR)"
]
oracle(
    "artifact_digest",
    f"""SELECT count(*) AS row_count, concat_ws(':', {', '.join(
        f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS UBIGINT)) % 18446744073709551616" for i in range(4))}) AS digest
FROM (SELECT md5({' || '.join(_framed(t) for t in _PX_TEXT)}) AS h FROM px)""",
    "px",
)
oracle(
    "verify_row_counts",
    """
SELECT artifact, row_count, row_count AS demanded FROM (
  SELECT 'coverage' AS artifact, count(*) AS row_count FROM univ
  UNION ALL SELECT 'momentum', (SELECT count(DISTINCT ticker) FROM px) * (SELECT hi_pos - lo_pos + 1 FROM bounds)
  UNION ALL SELECT 'volatility', (SELECT count(DISTINCT ticker) FROM px) * (SELECT hi_pos - lo_pos + 1 FROM bounds)
  UNION ALL SELECT 'dependence', 2 * ((SELECT count(*) FROM univ) + (SELECT count(*) FROM ev))
)""",
    "univ",
    "px",
    "bounds",
    "ev",
)
oracle(
    "verify_momentum_contract",
    f"""
SELECT 'percentile_out_of_range' AS rule, ticker, {day('signal_date')} FROM mom
WHERE isodow(signal_date) = 5 AND momentum_percentile IS NOT NULL
UNION ALL SELECT 'contradictory_status', ticker, CAST(signal_date AS VARCHAR) FROM mom
WHERE isodow(signal_date) = 1 AND endpoint_status = 'missing_start_row'
UNION ALL SELECT 'missing_row_dates', ticker, CAST(signal_date AS VARCHAR) FROM mom
WHERE isodow(signal_date) = 3 AND interior_missing_row_count > 0""",
    "mom",
)
oracle(
    "verify_volatility_contract",
    f"""
SELECT 'display_differs' AS rule, ticker, {day('signal_date')} FROM vol
WHERE isodow(signal_date) = 5 AND raw_annualized_volatility > 0
UNION ALL SELECT unnest(['eligibility_differs', 'value_contradicts_eligibility']), ticker, CAST(signal_date AS VARCHAR) FROM vol
WHERE isodow(signal_date) = 1 AND NOT window_eligible
UNION ALL SELECT 'percentile_contradicts_history', ticker, CAST(signal_date AS VARCHAR) FROM vol
WHERE isodow(signal_date) = 1 AND NOT window_eligible AND normalization_reference_count >= 252
UNION ALL SELECT 'prospective_session_differs', ticker, CAST(signal_date AS VARCHAR) FROM vol WHERE isodow(signal_date) = 3""",
    "vol",
)
oracle(
    "verify_key_population",
    """
SELECT CASE WHEN n IS NULL THEN 'ticker_without_rows' ELSE 'incomplete_sessions' END AS rule, ticker
FROM (SELECT DISTINCT ticker FROM px) LEFT JOIN (SELECT ticker, count(*) AS n FROM px_first GROUP BY ticker) USING (ticker), bounds b
WHERE n IS NULL OR n <> b.hi_pos - b.lo_pos + 1""",
    "px",
    "px_first",
    "bounds",
)
DIAGNOSED = (
    "endpoint_status start_adjusted_close end_adjusted_close interior_missing_row_dates interior_missing_adjusted_close_dates"
).split()
oracle(
    "verify_input_diagnostics",
    "\nUNION ALL ".join(
        f"SELECT ticker, CAST(signal_date AS VARCHAR) AS signal_date, '{c}' AS field FROM first_mom a JOIN mom b "
        f"USING (ticker, signal_date) WHERE a.{c} IS DISTINCT FROM b.{c}"
        for c in DIAGNOSED
    ),
    "first_mom",
    "mom",
)


def _surplus(name: str, frame: str) -> str:
    return (
        f"SELECT '{name}' AS artifact, 'left' AS only_in, count(*) AS rows FROM (SELECT * EXCLUDE (pos) FROM first_{frame} "
        f"EXCEPT ALL SELECT * EXCLUDE (pos) FROM {frame})\n"
        f"UNION ALL SELECT '{name}', 'right', count(*) FROM (SELECT * EXCLUDE (pos) FROM {frame} "
        f"EXCEPT ALL SELECT * EXCLUDE (pos) FROM first_{frame})"
    )


oracle(
    "verify_regeneration",
    _surplus("momentum", "mom") + "\nUNION ALL " + _surplus("volatility", "vol"),
    "first_mom",
    "mom",
    "first_vol",
    "vol",
)
oracle(
    "verify_coverage_counts",
    """
SELECT unnest(['counts_do_not_add_up', 'missing_dates_differ']) AS rule, ticker FROM cov
WHERE category <> 'NATION_1' AND missing_adjusted_close_count > 0
UNION ALL SELECT 'instrument_without_row', ticker FROM univ WHERE category = 'NATION_1'""",
    "cov",
    "univ",
)
oracle(
    "verify_coverage_fields",
    """
SELECT ticker, 'row_missing' AS field FROM univ WHERE category = 'NATION_1'
UNION ALL SELECT ticker, 'price_staleness_sessions' FROM cov WHERE category <> 'NATION_1' AND price_staleness_sessions IS NULL
UNION ALL SELECT ticker, 'momentum_target_status' FROM cov WHERE category <> 'NATION_1' AND target_price_row_present""",
    "cov",
    "univ",
)
oracle(
    "verify_dependence_contract",
    """
SELECT 'unknown_estimator' AS rule, scope, 'kendall' AS estimator, ticker, signal_date FROM dep_ticker WHERE ticker = 'IDX001'
UNION ALL SELECT unnest(['status_contradicts_estimate', 'too_few_pairs']), scope, estimator, ticker, signal_date
FROM dep_ticker WHERE ticker = 'IDX002'
UNION ALL SELECT 'duplicate_key', 'per_etf', 'kendall', 'IDX001', NULL
UNION ALL SELECT 'row_count_differs', NULL, NULL, NULL, NULL""",
    "dep_ticker",
)
cte("acquired", "px")(
    """
SELECT * REPLACE (CASE WHEN CAST(substr(ticker, 5, 7) AS BIGINT) % 2 = 0 THEN TIMESTAMP '2002-01-01 06:00:00'
                  ELSE retrieved_at END AS retrieved_at) FROM px
"""
)
oracle(
    "verify_provenance",
    """
SELECT unnest(list_filter([CASE WHEN seen <> n THEN 'row_count_differs' END,
                           CASE WHEN lo_seen IS DISTINCT FROM lo THEN 'first_date_differs' END,
                           CASE WHEN hi_seen IS DISTINCT FROM hi THEN 'last_date_differs' END], lambda x: x IS NOT NULL)) AS rule, ticker
FROM (
  SELECT a.ticker, c.n, c.lo, c.hi, count(*) FILTER (WHERE a.retrieved_at = c.at) AS seen,
         min(a.date) FILTER (WHERE a.retrieved_at = c.at) AS lo_seen, max(a.date) FILTER (WHERE a.retrieved_at = c.at) AS hi_seen
  FROM acquired a JOIN (
    SELECT ticker, count(*) AS n, min(date) AS lo, max(date) AS hi, max(retrieved_at) AS at FROM acquired GROUP BY ticker
  ) c USING (ticker) GROUP BY a.ticker, c.n, c.lo, c.hi
)""",
    "acquired",
)
oracle(
    "verify_ticker_metadata",
    """
SELECT 'query_window_differs' AS rule, ticker FROM (SELECT DISTINCT ticker FROM px)
UNION ALL SELECT 'status_contradicts_mode', NULL WHERE false
UNION ALL SELECT 'status_contradicts_mode', ticker FROM univ WHERE ticker NOT IN (SELECT ticker FROM px)""",
    "px",
    "univ",
)

# ---------------------------------------------------------------- reports


def _overview(c: str, display: str) -> str:
    return f"""
SELECT ord, ticker, name, category, CAST(target_session AS VARCHAR) AS target_session, {c}_target_raw AS raw,
       {c}_target_{display} AS display_pct, {c}_target_percentile AS percentile, {c}_target_status AS status,
       {c}_target_normalization_status AS normalization_status, {c}_target_raw_eligible AS raw_eligible,
       {c}_target_normalized_eligible AS normalized_eligible, {c}_target_reference_count AS reference_count,
       price_staleness_sessions, {c}_raw_staleness_sessions AS raw_staleness_sessions,
       {c}_normalized_staleness_sessions AS percentile_staleness_sessions, acquisition_status
FROM cov ORDER BY ord"""


oracle("overview_momentum", _overview("momentum", "simple_return_pct"), "cov")
oracle("overview_volatility", _overview("volatility", "annualized_pct"), "cov")
oracle(
    "current_percentiles",
    "\nUNION ALL ".join(
        f"SELECT ord, ticker, '{c}' AS component, {c}_target_percentile AS percentile, "
        f"{c}_target_normalization_status AS normalization_status FROM cov WHERE {c}_target_percentile IS NOT NULL"
        for c in ("momentum", "volatility")
    ),
    "cov",
)
oracle(
    "price_history_gaps",
    f"""
SELECT ticker, {day('session', 'date')}, adj AS adjusted_close, NOT row_present AS is_gap
FROM grid JOIN bounds b ON session BETWEEN b.lo AND b.hi""",
    "grid",
    "bounds",
)
MEASURES = (
    ("price_staleness_sessions", "acquisition_status"),
    ("momentum_raw_staleness_sessions", "momentum_target_status"),
    ("momentum_normalized_staleness_sessions", "momentum_target_normalization_status"),
    ("volatility_raw_staleness_sessions", "volatility_target_status"),
    ("volatility_normalized_staleness_sessions", "volatility_target_normalization_status"),
)
oracle(
    "staleness_table",
    "SELECT *, CASE WHEN sessions IS NULL THEN 'missing' WHEN sessions > 0 THEN 'stale' ELSE 'current' END AS flag FROM ("
    + "\nUNION ALL ".join(
        f"SELECT ord, ticker, '{n}' AS measure, {n} AS sessions, {v} AS verified_status FROM cov" for n, v in MEASURES
    )
    + ")",
    "cov",
)


def _number(c: str) -> str:
    return f"CAST(CAST(round({c}, 6) AS DECIMAL(38, 6)) AS VARCHAR)"


def _detail(source: str, columns: tuple[str, ...]) -> str:
    """One row per field of each target observation; one row that says so where there is none."""

    def shown(c: str) -> str:
        if c in ("raw_momentum", "simple_return_pct", "raw_annualized_volatility", "annualized_volatility_pct",
                 "start_adjusted_close", "end_adjusted_close", "momentum_percentile", "volatility_percentile"):
            return _number(c)
        return f"replace({c}, ',', ', ')" if c.endswith("_dates") else f"CAST({c} AS VARCHAR)"

    rows = [
        f"SELECT ticker, '{c}' AS field, {shown(c)} AS value FROM {source} JOIN bounds b ON signal_date = b.hi"
        for c in columns
        if c != "ticker"
    ]
    rows.append(
        f"SELECT ticker, 'signal_date', 'missing' FROM univ WHERE ticker NOT IN "
        f"(SELECT ticker FROM {source} JOIN bounds b ON signal_date = b.hi)"
    )
    return "\nUNION ALL ".join(rows)


oracle("observation_detail", _detail("mom", MOMENTUM_COLUMNS), "mom", "univ", "bounds")
oracle("observation_detail_volatility", _detail("vol", VOLATILITY_COLUMNS), "vol", "univ", "bounds")
oracle("verify_run", 'SELECT \'\' AS "check", \'\' AS rule, \'\' AS subject WHERE false')
oracle(
    "run_metadata",
    f"""
SELECT unnest(['run_id', 'target_session', 'captured_at', 'request_start', 'request_end_exclusive', 'mode', 'universe_sha256']) AS field,
       unnest([strftime(hi, '%Y%m%d') || 'T230000000000Z', CAST(hi AS VARCHAR), CAST(hi AS VARCHAR) || 'T23:00:00.000000Z',
               CAST(lo - 10 AS VARCHAR), CAST(hi + 1 AS VARCHAR), 'offline', universe_sha256]) AS value
FROM bounds, ({UNIVERSE_HASH})""",
    "bounds",
    "univ",
)
oracle(
    "verify_tampered_run",
    """
SELECT 'manifest' AS "check", 'differs_from_universe' AS rule, 'universe_sha256' AS subject
UNION ALL SELECT * FROM (VALUES ('artifacts', 'row_count_differs', 'dependence'), ('artifacts', 'row_count_differs', 'volatility'),
  ('artifacts', 'digest_differs', 'volatility'), ('artifacts', 'digest_differs', 'momentum'),
  ('regeneration', 'left', 'momentum'), ('regeneration', 'right', 'momentum'), ('regeneration', 'right', 'volatility'))
UNION ALL SELECT 'volatility_keys', 'incomplete_sessions', ticker FROM (SELECT DISTINCT ticker FROM px)
UNION ALL SELECT 'volatility_input', 'row_missing', ticker FROM (SELECT DISTINCT ticker FROM px)
UNION ALL SELECT 'momentum_contract', 'percentile_out_of_range', ticker FROM mom JOIN bounds ON signal_date = hi
WHERE momentum_percentile IS NOT NULL""",
    "px",
    "mom",
    "bounds",
)


# ---------------------------------------------------------------- incremental evaluation

cte("px_stale", "trades")(_bars(DESK, "trades", "NOT (slot % 2 = 0 AND flag = 'R' AND date >= DATE '2000-06-01')"))
cte("changed_px", "px", "px_stale", "cal")(
    f"""
SELECT n.ticker, pos FROM px n JOIN cal ON session = n.date LEFT JOIN px_stale o ON o.ticker = n.ticker AND o.date = n.date
WHERE o.ticker IS NULL OR {' OR '.join(f"o.{c} IS DISTINCT FROM n.{c}" for c in VALUES)}
"""
)
oracle("incremental_momentum", MOMENTUM_SELECT, "mom")
oracle("incremental_volatility", VOLATILITY_SELECT, "vol")
oracle(
    "incremental_reach",
    """SELECT ticker, count(DISTINCT place) AS recomputed_rows
FROM (SELECT ticker, unnest(generate_series(pos, least(pos + 1007, (SELECT hi_pos FROM bounds)))) AS place FROM changed_px)
GROUP BY ticker""",
    "changed_px",
    "bounds",
)

oracle(
    "verify_untouched",
    """SELECT 'momentum' AS artifact, side AS only_in, CAST(count(*) AS BIGINT) AS rows FROM mom, (VALUES ('left'), ('right')) AS t (side)
WHERE ticker = 'DESK0000001' AND strftime(signal_date, '%Y-%m') = '2001-03' GROUP BY side""",
    "mom",
)

ORACLES["evaluation_coverage"] = ORACLES["coverage"]
oracle(
    "evaluation_validated",
    """SELECT 'coverage' AS artifact, side AS only_in, CAST(count(*) AS BIGINT) AS rows FROM univ, (VALUES ('left'), ('right')) AS t (side)
WHERE category = 'NATION_1' GROUP BY side""",
    "univ",
)
oracle(
    "verify_order",
    """SELECT 'reversed' AS artifact, 'rows_out_of_order' AS rule, count(*) - 1 AS found FROM mom
UNION ALL SELECT 'swapped', 'file_begins_too_early', 1""",
    "mom",
)
