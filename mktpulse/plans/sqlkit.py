"""Building blocks of the DuckDB oracle SQL (see ``plans/oracle.py``).

The oracle reads the driver's pre-registered views (``events``, TPC-H
``orders``...), so the canonical marketing tables are re-derived here as CTEs
with the same expressions as ``sources/bindings.py``. TPC-H already owns the
name ``orders``; the marketing tables get an ``m_`` prefix.
"""

from __future__ import annotations

from mktpulse.sources.bindings import CAMPAIGNS, CHANNELS, EVENT_NAMES, MEDIUMS, SOURCES


def _lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _channel(e="event_id") -> str:
    return f"{_lst(CHANNELS)}[{e} % 4 + 1]"


def _campaign(e="event_id") -> str:
    return f"{_lst(CAMPAIGNS)}[({e} // 4) % 3 + 1]"


_EVENT_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAMES.items()) + " END"

BINDING_CTES = {
    "m_ads": f"""
  SELECT CAST(ts AS DATE) AS dt, {_channel()} AS channel, {_campaign()} AS campaign,
         CAST(1000 + event_id % 500 AS BIGINT) AS impressions, CAST(event_id % 50 AS BIGINT) AS clicks,
         CAST(value AS DECIMAL(18,4)) AS spend,
         CASE WHEN event_id % 20 < 3 THEN 'Control' ELSE 'Test' END AS holdout_group
  FROM events WHERE event_type IN ('view', 'click')""",
    "m_web": f"""
  SELECT 'U' || CAST(user_id AS VARCHAR) AS user_id,
         'S' || CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
         ts AS event_ts, {_EVENT_CASE} AS event_name,
         CASE WHEN event_id % 5 < 3 THEN 'mobile' ELSE 'desktop' END AS device,
         {_lst(SOURCES)}[event_id % 4 + 1] AS source, {_lst(MEDIUMS)}[event_id % 4 + 1] AS medium,
         {_campaign()} AS campaign
  FROM events WHERE event_type <> 'purchase'""",
    "m_orders": f"""
  SELECT 'O' || CAST(event_id AS VARCHAR) AS order_id, 'U' || CAST(user_id AS VARCHAR) AS user_id,
         ts AS order_ts, CAST(value AS DECIMAL(18,4)) AS revenue,
         CAST(value AS DECIMAL(18,4)) * CAST(0.55 AS DECIMAL(2,2)) AS cost,
         {_channel()} AS channel, {_campaign()} AS campaign
  FROM events WHERE event_type = 'purchase'""",
    "m_customers": """
  SELECT 'U' || CAST(user_id AS VARCHAR) AS user_id, MIN(ts) AS first_seen_ts FROM events GROUP BY 1""",
    "m_exposure": f"""
  SELECT 'U' || CAST(user_id AS VARCHAR) AS user_id, {_lst(CAMPAIGNS)}[user_id % 3 + 1] AS campaign,
         CASE WHEN user_id % 10 < 7 THEN 'Test' ELSE 'control' END AS "group",
         TIMESTAMP '2024-01-01 00:00:00' + CAST(user_id % 15 AS INTEGER) * INTERVAL 1 DAY AS exposure_ts
  FROM (SELECT DISTINCT user_id FROM events)""",
    "m_cohort_orders": """
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS user_id,
         o_orderdate AS order_ts, CAST(o_totalprice AS DECIMAL(18,4)) AS revenue
  FROM orders""",
}
BINDING_CTES["m_campaign_daily"] = """
  SELECT a.dt, a.campaign, a.impressions, a.clicks, CAST(a.spend AS DOUBLE) AS spend, o.orders,
         CAST(o.revenue AS DOUBLE) AS revenue, CAST(o.cost AS DOUBLE) AS cost
  FROM (SELECT dt, campaign, SUM(impressions) AS impressions, SUM(clicks) AS clicks, SUM(spend) AS spend
        FROM m_ads GROUP BY dt, campaign) a
  JOIN (SELECT CAST(order_ts AS DATE) AS dt, campaign, COUNT(*) AS orders, SUM(revenue) AS revenue,
               SUM(cost) AS cost
        FROM m_orders GROUP BY 1, 2) o
    ON a.dt = o.dt AND a.campaign = o.campaign"""


def with_bindings(body: str) -> str:
    """Prefix a query body (which may start with its own ``name AS (...)``
    CTE list, introduced by a comma-free ``WITH``) with the binding CTEs."""
    ctes = ",\n".join(f"{k} AS ({v}\n)" for k, v in BINDING_CTES.items())
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def ratio(num: str, den: str, on_zero: str = "null") -> str:
    n, dd = d(num), d(den)
    if on_zero == "null":
        return f"CASE WHEN {dd} > 0 THEN {n} / {dd} END"
    if on_zero == "zero":
        return f"CASE WHEN {dd} > 0 THEN {n} / {dd} ELSE 0.0 END"
    if on_zero == "unguarded":
        return f"CASE WHEN {dd} <> 0 THEN {n} / {dd} END"
    raise ValueError(on_zero)
