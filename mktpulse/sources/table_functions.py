"""F1, F2 and A9 as SQL table functions over the registered views (S3).

``register_functions`` makes them part of the session: analysts write ``SELECT ... FROM orders_in(DATE'2024-01-01', ...)``.
Spark inlines the body, so the date range reaches the parquet reader and an unused branch of the attribution is
removed while planning.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: view -> its time column and whether it has channels
_FACTS = {"ads_daily": ("dt", True), "orders": ("order_ts", True), "web_events": ("event_ts", False)}

_ATTRIBUTION = """CREATE OR REPLACE TEMPORARY FUNCTION attribution_by(model STRING, first DATE, last DATE)
RETURNS TABLE RETURN
WITH od AS (SELECT * FROM orders WHERE to_date(order_ts) BETWEEN first AND last),
touch AS (
  SELECT user_id, max_by(campaign, struct(event_ts, campaign)) AS campaign_lt FROM web_events
  WHERE campaign IS NOT NULL AND to_date(event_ts) BETWEEN first AND last GROUP BY user_id
), credit AS (
  SELECT od.order_id, od.user_id, od.revenue, coalesce(touch.campaign_lt, od.campaign) AS campaign
  FROM od LEFT JOIN touch USING (user_id) WHERE model = 'last_touch'
  UNION ALL
  SELECT order_id, user_id, revenue, campaign FROM od WHERE model = 'order_campaign'
)
SELECT campaign, CAST(sum(CAST(revenue AS DECIMAL(28,8))) AS DOUBLE) AS revenue,
       count(DISTINCT order_id) AS orders, count(DISTINCT user_id) AS buyers
FROM credit GROUP BY campaign"""


def register_functions(spark: SparkSession) -> list[str]:
    """``<view>_in(first, last, channels, campaigns)`` for each fact view (NULL or no list: no restriction; web events have
    no channels), ``attribution_by(model, first, last)`` with the models of A9. The views must be registered."""
    names = []
    for view, (at, channels) in _FACTS.items():
        lists = (["channels ARRAY<STRING> DEFAULT NULL"] if channels else []) + ["campaigns ARRAY<STRING> DEFAULT NULL"]
        rules = [f"to_date({at}) BETWEEN first AND last"]
        rules += ["(channels IS NULL OR array_contains(channels, channel))"] if channels else []
        rules += ["(campaigns IS NULL OR array_contains(campaigns, campaign))"]
        name = f"{view}_in"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(first DATE, last DATE, {', '.join(lists)}) "
                  f"RETURNS TABLE RETURN SELECT * FROM {view} WHERE {' AND '.join(rules)}")
        names.append(name)
    spark.sql(_ATTRIBUTION)
    return [*names, "attribution_by"]
