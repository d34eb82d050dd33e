"""DuckDB oracle SQL, one statement per key of ``plans/catalogue.QUERIES``.

Written independently from the DataFrame code, straight from the operator
semantics -- and, where the Spark operator uses a different (scalable) shape,
in the reference's own shape: attribution as the order x touch pair join with
window functions, incrementality as the exposure x order left join. Shared
conventions: money summed as DECIMAL and cast to DOUBLE last; every ratio via
``sqlkit.ratio``; explicit casts on integer outputs; explicit NULL ordering;
half-to-even rounding (``round_even``) where the reports round.
"""

from __future__ import annotations

from mktpulse.contracts import FUNNEL_STAGES, STAGE_LABELS
from mktpulse.operators.funnel import STAGE_TITLES
from mktpulse.plans.sqlkit import d, ratio as r, with_bindings
from mktpulse.sources.bindings import EVENT_NAMES

START, END = "2024-01-01", "2024-01-31"
SEL_CHANNELS = ["Meta", "Google", "Email"]
SEL_CAMPAIGNS = ["Winter_Sale", "New_Arrivals"]
P = 6  # FLOAT_PLACES of the catalogue


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_F = (f"WITH ads AS (SELECT * FROM m_ads WHERE dt BETWEEN DATE '{START}' AND DATE '{END}'),\n"
      f" od AS (SELECT * FROM m_orders WHERE CAST(order_ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'),\n"
      f" web AS (SELECT * FROM m_web WHERE CAST(event_ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}')")

# ------------------------------------------------------------------ paid
PAID_PERF_DAILY = _F + f""",
pk AS (SELECT dt, channel, campaign, SUM(impressions) AS impressions, SUM(clicks) AS clicks,
              SUM(spend) AS spend
       FROM ads GROUP BY dt, channel, campaign),
pd AS (SELECT CAST(order_ts AS DATE) AS dt, channel, campaign, COUNT(DISTINCT order_id) AS orders,
              SUM(revenue) AS revenue,
              SUM(CAST(revenue AS DECIMAL(18,4)) - CAST(cost AS DECIMAL(18,4))) AS margin,
              COUNT(DISTINCT user_id) AS buyers
       FROM od GROUP BY 1, 2, 3),
j AS (SELECT pk.dt, pk.channel, pk.campaign, CAST(pk.impressions AS BIGINT) AS impressions,
             CAST(pk.clicks AS BIGINT) AS clicks, {d('pk.spend')} AS spend,
             CAST(COALESCE(pd.orders, 0) AS BIGINT) AS orders, COALESCE({d('pd.revenue')}, 0.0) AS revenue,
             COALESCE({d('pd.margin')}, 0.0) AS margin, CAST(COALESCE(pd.buyers, 0) AS BIGINT) AS buyers
      FROM pk LEFT JOIN pd ON pk.dt = pd.dt AND pk.channel = pd.channel AND pk.campaign = pd.campaign)
SELECT dt, channel, campaign, impressions, clicks, spend,
       {r('clicks', 'impressions')} AS CTR, {r('spend', 'clicks')} AS CPC,
       {r('spend * 1000.0', 'impressions')} AS CPM,
       orders, revenue, margin, buyers,
       {r('orders', 'clicks')} AS CVR_click_to_order, {r('revenue', 'spend')} AS ROAS,
       {r('margin', 'spend')} AS GM_ROAS, {r('revenue', 'spend')} AS MER, {r('revenue', 'orders')} AS AOV
FROM j"""

# P5 before ratios, money still decimal
_PAID_EXACT = _F + """,
pa AS (SELECT dt, channel, campaign, SUM(impressions) AS impressions, SUM(clicks) AS clicks, SUM(spend) AS spend
       FROM ads GROUP BY dt, channel, campaign),
po AS (SELECT CAST(order_ts AS DATE) AS dt, channel, campaign, COUNT(DISTINCT order_id) AS orders,
              COUNT(DISTINCT user_id) AS buyers, SUM(revenue) AS revenue,
              SUM(CAST(cost AS DECIMAL(18,4))) AS cost
       FROM od GROUP BY 1, 2, 3),
px AS (SELECT pa.dt, pa.channel, pa.campaign, pa.impressions, pa.clicks, pa.spend,
              COALESCE(po.orders, 0) AS orders, COALESCE(po.buyers, 0) AS buyers,
              COALESCE(po.revenue, 0) AS revenue, COALESCE(po.cost, 0) AS cost
       FROM pa LEFT JOIN po ON pa.dt = po.dt AND pa.channel = po.channel AND pa.campaign = po.campaign)"""

PAID_DAILY_ZERO = _PAID_EXACT + f"""
SELECT dt, channel, campaign, CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks,
       {d('spend')} AS spend, CAST(orders AS BIGINT) AS orders, CAST(buyers AS BIGINT) AS buyers,
       {d('revenue')} AS revenue, {d('cost')} AS cost,
       {r('clicks', 'impressions', 'zero')} AS CTR, {r('orders', 'clicks', 'zero')} AS CVR,
       {r('revenue', 'spend', 'zero')} AS ROAS, {r('revenue - cost', 'spend', 'zero')} AS GM_ROAS,
       {r('revenue', 'orders', 'zero')} AS AOV
FROM px"""

DAILY_TREND = _PAID_EXACT + f""",
g AS (SELECT dt, SUM(spend) AS spend, SUM(revenue) AS revenue, SUM(clicks) AS clicks,
             SUM(impressions) AS impressions, SUM(orders) AS orders FROM px GROUP BY dt)
SELECT dt, {d('spend')} AS spend, {d('revenue')} AS revenue, CAST(clicks AS BIGINT) AS clicks,
       CAST(impressions AS BIGINT) AS impressions, CAST(orders AS BIGINT) AS orders,
       {r('clicks', 'impressions', 'zero')} AS CTR, {r('orders', 'clicks', 'zero')} AS CVR,
       {r('revenue', 'spend', 'zero')} AS ROAS
FROM g"""


def _rollup(keys: str) -> str:
    return _PAID_EXACT + f""",
g AS (SELECT {keys}, SUM(spend) AS spend, SUM(revenue) AS revenue, SUM(orders) AS orders,
             SUM(buyers) AS buyers, SUM(impressions) AS impressions, SUM(clicks) AS clicks
      FROM px GROUP BY {keys}),
t AS (SELECT {keys}, {d('spend')} AS spend, {d('revenue')} AS revenue, CAST(orders AS BIGINT) AS orders,
             CAST(buyers AS BIGINT) AS buyers, CAST(impressions AS BIGINT) AS impressions,
             CAST(clicks AS BIGINT) AS clicks,
             {r('clicks', 'impressions', 'zero')} AS CTR, {r('orders', 'clicks', 'zero')} AS CVR,
             {r('revenue', 'spend', 'zero')} AS ROAS, {r('spend', 'buyers')} AS CAC
      FROM g)"""


CAMPAIGN_TABLE = _rollup("channel, campaign") + "\nSELECT * FROM t"
TOP_CAMPAIGNS = _rollup("channel, campaign") + """
SELECT * FROM t ORDER BY revenue DESC, channel ASC NULLS LAST, campaign ASC NULLS LAST LIMIT 10"""
CHANNEL_SUMMARY = _rollup("channel") + "\nSELECT * FROM t"

KPI_CARDS = _PAID_EXACT + f""",
s AS (SELECT COALESCE({d('SUM(spend)')}, 0.0) AS total_spend, COALESCE({d('SUM(revenue)')}, 0.0) AS total_revenue,
             CAST(COALESCE(SUM(orders), 0) AS BIGINT) AS total_orders,
             CAST(COALESCE(SUM(buyers), 0) AS BIGINT) AS total_buyers,
             COALESCE(SUM(clicks), 0) AS clicks, COALESCE(SUM(impressions), 0) AS impressions FROM px)
SELECT total_spend, total_revenue, total_orders, total_buyers,
       {r('total_revenue', 'total_spend', 'zero')} AS ROAS, {r('clicks', 'impressions', 'zero')} AS CTR,
       {r('total_orders', 'clicks', 'zero')} AS CVR, {r('total_revenue', 'total_orders', 'zero')} AS AOV
FROM s"""

PAID_LATTICE = _PAID_EXACT + f""",
g AS (SELECT CASE GROUPING_ID(dt, channel, campaign) WHEN 3 THEN 'day' WHEN 4 THEN 'campaign' WHEN 5 THEN 'channel' ELSE 'total' END AS level,
             dt, channel, campaign, SUM(spend) AS spend, SUM(revenue) AS revenue, SUM(orders) AS orders, SUM(buyers) AS buyers,
             SUM(impressions) AS impressions, SUM(clicks) AS clicks
      FROM px GROUP BY GROUPING SETS ((dt), (channel, campaign), (channel), ()))
SELECT level, dt, channel, campaign, {d('spend')} AS spend, {d('revenue')} AS revenue, CAST(orders AS BIGINT) AS orders,
       CAST(buyers AS BIGINT) AS buyers, CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks,
       {r('clicks', 'impressions', 'zero')} AS CTR, {r('orders', 'clicks', 'zero')} AS CVR,
       {r('revenue', 'spend', 'zero')} AS ROAS, {r('spend', 'buyers')} AS CAC, {r('revenue', 'orders', 'zero')} AS AOV
FROM g"""

BUYERS_DISTINCT = _F + """,
days AS (SELECT CAST(order_ts AS DATE) AS dt, channel, campaign, COUNT(DISTINCT user_id) AS n FROM od GROUP BY 1, 2, 3),
a AS (SELECT channel, campaign, SUM(n) AS n FROM days GROUP BY 1, 2)
SELECT od.channel, od.campaign, CAST(MAX(a.n) AS BIGINT) AS buyers, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS buyers_distinct
FROM od JOIN a ON od.channel = a.channel AND od.campaign = a.campaign GROUP BY 1, 2"""

# P10 (channel script): unguarded ratios
_CHANNEL_KPI = _F + f""",
ka AS (SELECT channel, SUM(impressions) AS impressions, SUM(clicks) AS clicks, SUM(spend) AS spend
       FROM ads GROUP BY channel),
ko AS (SELECT channel, COUNT(order_id) AS orders, SUM(revenue) AS revenue, COUNT(DISTINCT user_id) AS customers
       FROM od GROUP BY channel),
kj AS (SELECT ka.channel, CAST(ka.impressions AS BIGINT) AS impressions, CAST(ka.clicks AS BIGINT) AS clicks,
              {d('ka.spend')} AS spend, CAST(COALESCE(ko.orders, 0) AS BIGINT) AS orders,
              COALESCE({d('ko.revenue')}, 0.0) AS revenue, CAST(COALESCE(ko.customers, 0) AS BIGINT) AS customers
       FROM ka LEFT JOIN ko ON ka.channel = ko.channel),
kr AS (SELECT *, {r('clicks', 'impressions', 'unguarded')} AS CTR, {r('orders', 'clicks', 'unguarded')} AS CVR,
              {r('spend', 'customers', 'unguarded')} AS CAC, {r('revenue', 'spend', 'unguarded')} AS ROAS,
              {r('revenue', 'orders', 'unguarded')} AS AOV FROM kj),
k AS (SELECT *, AOV * 3.0 AS LTV, AOV * 3.0 - CAC AS CLV FROM kr),
kw AS (SELECT *, CASE WHEN SUM(ROAS) OVER () <> 0 THEN ROAS / SUM(ROAS) OVER () END AS budget_weight FROM k)"""

CHANNEL_KPI = _CHANNEL_KPI + """
SELECT channel, impressions, clicks, round_even(spend, 2) AS spend, orders, round_even(revenue, 2) AS revenue,
       customers, round_even(CTR, 2) AS CTR, round_even(CVR, 2) AS CVR, round_even(CAC, 2) AS CAC,
       round_even(ROAS, 2) AS ROAS, round_even(AOV, 2) AS AOV, round_even(LTV, 2) AS LTV,
       round_even(CLV, 2) AS CLV, round_even(budget_weight, 2) AS budget_weight
FROM kw"""

KPI_CARDS_CHANNEL = _CHANNEL_KPI + f""",
s AS (SELECT SUM(CAST(spend AS DECIMAL(18,4))) AS ts, SUM(CAST(revenue AS DECIMAL(18,4))) AS tr, AVG(CAC) AS ac FROM k)
SELECT {d('ts')} AS total_spend, {d('tr')} AS total_revenue, {r('tr', 'ts', 'unguarded')} AS ROAS,
       round(ac, {P}) AS avg_CAC
FROM s"""

BUDGET_WEIGHT = _CHANNEL_KPI + """
SELECT channel, round_even(ROAS, 4) AS ROAS, round_even(budget_weight, 4) AS budget_weight FROM kw"""

FUNNEL_COARSE = _CHANNEL_KPI + """
SELECT 'Impressions' AS stage, CAST(SUM(impressions) AS BIGINT) AS "count" FROM k
UNION ALL SELECT 'Clicks', CAST(SUM(clicks) AS BIGINT) FROM k
UNION ALL SELECT 'Orders', CAST(SUM(orders) AS BIGINT) FROM k"""

CAMPAIGN_KPIS = f"""
SELECT dt, campaign, CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks, spend,
       CAST(orders AS BIGINT) AS orders, revenue, cost,
       {r('clicks', 'impressions', 'unguarded')} AS CTR, {r('orders', 'clicks', 'unguarded')} AS CVR,
       {r('revenue', 'spend', 'unguarded')} AS ROAS, {r('revenue - cost', 'spend', 'unguarded')} AS GM_ROAS,
       {r('revenue', 'orders', 'unguarded')} AS AOV
FROM m_campaign_daily
ORDER BY ROAS DESC NULLS LAST, dt, campaign"""

CAMPAIGN_CARDS = f"""
WITH s AS (SELECT SUM(CAST(spend AS DECIMAL(18,4))) AS ts, SUM(CAST(revenue AS DECIMAL(18,4))) AS tr,
                  SUM(orders) AS tn FROM m_campaign_daily)
SELECT {d('ts')} AS total_spend, {d('tr')} AS total_revenue, CAST(tn AS BIGINT) AS total_orders,
       {r('tr', 'ts', 'unguarded')} AS ROAS
FROM s"""

# ------------------------------------------------------------------ funnel
_STAGE_CASE = "CASE event_name " + " ".join(
    f"WHEN '{e}' THEN '{s}'" for e, s in zip(FUNNEL_STAGES, STAGE_LABELS)) + " END"

SESSIONS_DISTINCT = _F + f"""
SELECT funnel_stage, CAST(COUNT(DISTINCT session_id) AS BIGINT) AS sessions_distinct
FROM (SELECT *, {_STAGE_CASE} AS funnel_stage FROM web) x WHERE funnel_stage IS NOT NULL GROUP BY 1"""

FUNNEL_STAGE_DAILY = _F + f"""
SELECT CAST(event_ts AS DATE) AS dt, source, medium, campaign, funnel_stage,
       CAST(COUNT(DISTINCT session_id) AS BIGINT) AS sessions
FROM (SELECT *, {_STAGE_CASE} AS funnel_stage FROM web) x
WHERE funnel_stage IS NOT NULL
GROUP BY 1, 2, 3, 4, 5"""

_WIDE = _F + """,
per AS (SELECT campaign, event_name, COUNT(DISTINCT session_id) AS n FROM web
        WHERE event_name IN """ + _in(FUNNEL_STAGES) + """ GROUP BY 1, 2),
wide AS (SELECT campaign, """ + ", ".join(
    f"CAST(COALESCE(MAX(CASE WHEN event_name = '{s}' THEN n END), 0) AS BIGINT) AS {s}" for s in FUNNEL_STAGES
) + " FROM per GROUP BY campaign)"

FUNNEL_BY_CAMPAIGN = _WIDE + f"""
SELECT campaign, page_view, product_view, add_to_cart, begin_checkout,
       round_even({r('product_view', 'page_view', 'zero')}, 4) AS pdp_rate,
       round_even({r('add_to_cart', 'product_view', 'zero')}, 4) AS atc_rate,
       round_even({r('begin_checkout', 'add_to_cart', 'zero')}, 4) AS checkout_rate
FROM wide ORDER BY page_view DESC, campaign ASC NULLS LAST"""

FUNNEL_LONG = _WIDE + """,
pick AS (SELECT * FROM wide WHERE campaign = (SELECT MIN(campaign) FROM wide))
""" + "\nUNION ALL\n".join(
    f"SELECT campaign, '{t}' AS stage, {s} AS \"count\" FROM pick" for s, t in zip(FUNNEL_STAGES, STAGE_TITLES))

# ------------------------------------------------------------------ CAC
CAC_DAILY = _F + f""",
fo AS (SELECT user_id, CAST(MIN(order_ts) AS DATE) AS first_dt FROM m_orders GROUP BY user_id),
nb AS (SELECT first_dt AS dt, COUNT(user_id) AS new_buyers FROM fo
       WHERE first_dt >= DATE '{START}' AND first_dt <= DATE '{END}' GROUP BY 1),
sp AS (SELECT dt, SUM(spend) AS spend FROM ads GROUP BY dt)
SELECT sp.dt, {d('sp.spend')} AS spend, CAST(COALESCE(nb.new_buyers, 0) AS BIGINT) AS new_buyers,
       {r('sp.spend', 'COALESCE(nb.new_buyers, 0)')} AS CAC
FROM sp LEFT JOIN nb ON sp.dt = nb.dt"""

_CAC_RANGE = f""",
fo AS (SELECT user_id, CAST(MIN(order_ts) AS DATE) AS first_dt FROM od GROUP BY user_id),
nb AS (SELECT first_dt AS dt, COUNT(user_id) AS new_buyers FROM fo GROUP BY 1),
sp AS (SELECT dt, SUM(spend) AS spend FROM ads GROUP BY dt),
cac AS (SELECT sp.dt, {d('sp.spend')} AS spend, CAST(COALESCE(nb.new_buyers, 0) AS BIGINT) AS new_buyers,
               {r('sp.spend', 'COALESCE(nb.new_buyers, 0)')} AS CAC
        FROM sp LEFT JOIN nb ON sp.dt = nb.dt)"""
CAC_DAILY_RANGE = _F + _CAC_RANGE + "\nSELECT * FROM cac"


# ------------------------------------------------------------------ cohorts (binding B)
def _cohort_base(src: str) -> str:
    return f"""
co AS (SELECT user_id, CAST(order_ts AS DATE) AS order_dt, revenue FROM {src} WHERE user_id IS NOT NULL),
fp AS (SELECT user_id, MIN(order_dt) AS first_dt FROM co GROUP BY user_id),
cj AS (SELECT co.user_id, co.order_dt, co.revenue, fp.first_dt,
              CAST(date_trunc('month', fp.first_dt) AS DATE) AS cohort_month,
              CAST(date_trunc('month', co.order_dt) AS DATE) AS order_month,
              datediff('day', fp.first_dt, co.order_dt) AS since
       FROM co JOIN fp ON co.user_id = fp.user_id)"""


def _ltv(src: str, days: int, on_zero: str) -> str:
    return _cohort_base(src) + f""",
lt AS (SELECT cohort_month, COUNT(DISTINCT user_id) AS customers, SUM(revenue) AS rev
       FROM cj WHERE since BETWEEN 0 AND {days} GROUP BY cohort_month),
ltv AS (SELECT cohort_month, CAST(customers AS BIGINT) AS customers, {d('rev')} AS revenue_lookback,
               {r('rev', 'customers', on_zero)} AS LTV_lookback FROM lt)"""


LTV_BY_COHORT = "WITH " + _ltv("m_cohort_orders", 180, "null") + "\nSELECT * FROM ltv"

_RET = _cohort_base("m_cohort_orders") + f""",
act AS (SELECT DISTINCT user_id, cohort_month, order_month FROM cj),
rt AS (SELECT cohort_month, order_month, COUNT(user_id) AS active_customers FROM act GROUP BY 1, 2),
cs AS (SELECT CAST(date_trunc('month', first_dt) AS DATE) AS cohort_month, COUNT(DISTINCT user_id) AS cohort_size
       FROM fp GROUP BY 1),
rr AS (SELECT rt.cohort_month, rt.order_month, CAST(rt.active_customers AS BIGINT) AS active_customers,
              CAST(cs.cohort_size AS BIGINT) AS cohort_size,
              {d('rt.active_customers')} / {d('cs.cohort_size')} AS retention_rate,
              CAST(datediff('month', rt.cohort_month, rt.order_month) AS INTEGER) AS months_since_cohort
       FROM rt JOIN cs ON rt.cohort_month = cs.cohort_month)"""

RETENTION_RATES = "WITH " + _RET + "\nSELECT * FROM rr ORDER BY cohort_month, months_since_cohort"

# R4 in long form: every cohort and offset up to the largest one
RETENTION_MATRIX = "WITH " + _RET + """,
grid AS (SELECT c.cohort_month, CAST(g.i AS INTEGER) AS months_since_cohort
         FROM (SELECT DISTINCT cohort_month FROM rr) c, range((SELECT MAX(months_since_cohort) + 1 FROM rr)) AS g(i))
SELECT grid.cohort_month, grid.months_since_cohort, COALESCE(rr.retention_rate, 0.0) AS retention_rate
FROM grid LEFT JOIN rr ON grid.cohort_month = rr.cohort_month AND grid.months_since_cohort = rr.months_since_cohort"""

RETENTION_90D = "WITH " + _cohort_base("m_cohort_orders") + f""",
pu AS (SELECT user_id, MAX(CASE WHEN since BETWEEN 0 AND 90 THEN 1 ELSE 0 END) AS within,
              MAX(CASE WHEN since BETWEEN 1 AND 90 THEN 1 ELSE 0 END) AS rep
       FROM cj GROUP BY user_id),
s AS (SELECT COUNT(user_id) AS users, SUM(within) AS retained, SUM(rep) AS repeaters FROM pu)
SELECT CAST(users AS BIGINT) AS users, CAST(retained AS BIGINT) AS retained_users,
       CAST(repeaters AS BIGINT) AS repeat_users,
       {r('retained', 'users')} AS retention_rate, {r('repeaters', 'users')} AS repeat_rate
FROM s"""

GROWTH_SUMMARY = _F + _CAC_RANGE + "," + _ltv("od", 180, "zero") + f""",
g AS (SELECT COALESCE((SELECT AVG(LTV_lookback) FROM ltv), 0.0) AS a, (SELECT AVG(CAC) FROM cac) AS c)
SELECT round(a, {P}) AS avg_LTV, round(c, {P}) AS avg_CAC, round(a - c, {P}) AS CLV FROM g"""

LTV_TABLE = "WITH " + _ltv("m_cohort_orders", 180, "zero") + """
SELECT cohort_month, customers, round_even(revenue_lookback, 0) AS revenue_h,
       round_even(LTV_lookback, 0) AS LTV_horizon
FROM ltv ORDER BY cohort_month ASC NULLS LAST"""

# ------------------------------------------------------------------ attribution
ATTRIBUTION_MODELS = _F + """,
touches AS (SELECT user_id, event_ts, source AS touch_channel, campaign AS touch_campaign FROM web),
bo AS (SELECT order_id, user_id, order_ts, revenue FROM od),
j AS (SELECT bo.order_id, bo.revenue, t.touch_channel, t.touch_campaign, t.event_ts,
             (floor(epoch(bo.order_ts)) - floor(epoch(t.event_ts))) / 60.0 AS mins
      FROM bo JOIN touches t ON bo.user_id = t.user_id AND t.event_ts <= bo.order_ts),
w AS (SELECT *,
        row_number() OVER (PARTITION BY order_id ORDER BY event_ts DESC, touch_channel DESC NULLS LAST,
                                                          touch_campaign DESC NULLS LAST) AS rn_last,
        row_number() OVER (PARTITION BY order_id ORDER BY event_ts ASC, touch_channel ASC NULLS FIRST,
                                                          touch_campaign ASC NULLS FIRST) AS rn_first,
        COUNT(*) OVER (PARTITION BY order_id) AS touches,
        exp(-0.00048 * (mins - MIN(mins) OVER (PARTITION BY order_id))) AS wt
      FROM j),
w2 AS (SELECT *, SUM(wt) OVER (PARTITION BY order_id) AS wt_sum FROM w)
SELECT touch_channel AS channel, touch_campaign AS campaign,
       CAST(COUNT(DISTINCT CASE WHEN rn_last = 1 THEN order_id END) AS BIGINT) AS orders,
       CAST(COALESCE(SUM(CASE WHEN rn_last = 1 THEN revenue END), 0) AS DOUBLE) AS revenue_last_click,
       CAST(COALESCE(SUM(CASE WHEN rn_first = 1 THEN revenue END), 0) AS DOUBLE) AS revenue_first_click,
       round(SUM(CAST(revenue AS DOUBLE) / touches), 4) AS revenue_linear,
       round(SUM(CAST(revenue AS DOUBLE) * wt / wt_sum), 4) AS revenue_time_decay
FROM w2 GROUP BY 1, 2"""

ATTRIBUTION_LOOKBACK = ATTRIBUTION_MODELS.replace(
    "t.event_ts <= bo.order_ts", "t.event_ts BETWEEN bo.order_ts - INTERVAL 7 DAY AND bo.order_ts")

_LAST_TOUCH = _F + """,
lt AS (SELECT user_id, campaign AS campaign_lt FROM (
         SELECT user_id, campaign, row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC, campaign DESC) AS rn
         FROM web WHERE campaign IS NOT NULL) x WHERE rn = 1),
att AS (SELECT od.order_id, od.user_id, od.revenue, COALESCE(lt.campaign_lt, od.campaign) AS campaign
        FROM od LEFT JOIN lt ON od.user_id = lt.user_id),
lta AS (SELECT campaign, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(COUNT(DISTINCT order_id) AS BIGINT) AS orders,
               CAST(COUNT(DISTINCT user_id) AS BIGINT) AS buyers FROM att GROUP BY campaign)"""
LAST_TOUCH = _LAST_TOUCH + "\nSELECT * FROM lta ORDER BY revenue DESC, campaign ASC NULLS LAST"
ATTRIBUTION_TABLE = _LAST_TOUCH + """
SELECT campaign, round_even(revenue, 0) AS revenue, orders, buyers FROM lta
ORDER BY lta.revenue DESC, campaign ASC NULLS LAST"""

LAST_TOUCH_BEFORE_ORDER = _F + """,
bo AS (SELECT od.order_id, od.user_id, od.revenue, od.campaign, w.campaign AS touch,
              row_number() OVER (PARTITION BY od.order_id ORDER BY w.event_ts DESC NULLS LAST, w.campaign DESC NULLS LAST) AS rn
       FROM od LEFT JOIN (SELECT * FROM web WHERE campaign IS NOT NULL) w
         ON od.user_id = w.user_id AND w.event_ts <= od.order_ts)
SELECT COALESCE(touch, campaign) AS campaign, CAST(SUM(revenue) AS DOUBLE) AS revenue,
       CAST(COUNT(DISTINCT order_id) AS BIGINT) AS orders, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS buyers
FROM bo WHERE rn = 1 GROUP BY 1 ORDER BY revenue DESC, campaign ASC NULLS LAST"""


SQL_ORDERS_IN = f"""
SELECT order_id, channel, campaign, CAST(order_ts AS DATE) AS dt FROM m_orders
WHERE CAST(order_ts AS DATE) BETWEEN DATE '{START}' AND DATE '2024-01-20'
  AND channel IN {_in(SEL_CHANNELS)} AND campaign IN {_in(SEL_CAMPAIGNS)}"""

SQL_ADS_IN = """
SELECT channel, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks FROM m_ads
WHERE dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY channel"""

SQL_ATTRIBUTION_BY = _LAST_TOUCH + """
SELECT 'last_touch' AS model, campaign, revenue, orders, buyers FROM lta
UNION ALL
SELECT 'order_campaign', campaign, CAST(SUM(revenue) AS DOUBLE), CAST(COUNT(DISTINCT order_id) AS BIGINT),
       CAST(COUNT(DISTINCT user_id) AS BIGINT) FROM od GROUP BY campaign"""


def _subcent(sql: str) -> str:
    """The same statement over spend and revenue in fractions of a cent."""
    return (sql.replace("ads AS (SELECT *", "ads AS (SELECT * REPLACE (spend * CAST(0.13 AS DECIMAL(2,2)) AS spend)", 1)
            .replace("od AS (SELECT *", "od AS (SELECT * REPLACE (revenue * CAST(0.07 AS DECIMAL(2,2)) AS revenue)", 1)
            .replace("DECIMAL(18,4)", "DECIMAL(18,6)"))


PAID_PERF_SUBCENT = _subcent(PAID_PERF_DAILY)
ATTRIBUTION_SUBCENT = _subcent(ATTRIBUTION_MODELS)

ORDER_CAMPAIGN_CREDIT = _F + """
SELECT campaign, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(COUNT(DISTINCT order_id) AS BIGINT) AS orders,
       CAST(COUNT(DISTINCT user_id) AS BIGINT) AS buyers
FROM od GROUP BY campaign ORDER BY revenue DESC, campaign ASC NULLS LAST"""

# ------------------------------------------------------------------ incrementality
INCREMENTALITY_UPLIFT = _F + f""",
e AS (SELECT user_id, campaign, lower("group") AS grp, exposure_ts FROM m_exposure),
j AS (SELECT e.user_id, e.campaign, e.grp, o.order_ts, o.revenue,
             datediff('day', CAST(e.exposure_ts AS DATE), CAST(o.order_ts AS DATE)) AS days_after
      FROM e LEFT JOIN od o ON e.user_id = o.user_id AND e.campaign = o.campaign),
f AS (SELECT *, CASE WHEN order_ts IS NOT NULL THEN 1 ELSE 0 END AS converted,
             CASE WHEN order_ts IS NOT NULL THEN revenue ELSE 0 END AS rev
      FROM j WHERE order_ts IS NULL OR (days_after >= 0 AND days_after <= 30)),
ul AS (SELECT user_id, campaign, grp, MAX(converted) AS converted, SUM(rev) AS revenue FROM f GROUP BY 1, 2, 3),
c AS (SELECT campaign, grp, COUNT(DISTINCT user_id) AS users, SUM(converted) AS converters,
             SUM(revenue) AS revenue FROM ul GROUP BY 1, 2),
c2 AS (SELECT campaign, grp, users, {r('converters', 'users')} AS cvr, {r('revenue', 'users')} AS rpu FROM c)
SELECT t.campaign, CAST(t.users AS BIGINT) AS users_test, t.cvr AS cvr_test, t.rpu AS rpu_test,
       CAST(k.users AS BIGINT) AS users_control, k.cvr AS cvr_control, k.rpu AS rpu_control,
       t.cvr - k.cvr AS uplift_cvr_abs, t.rpu - k.rpu AS uplift_rpu_abs,
       (t.cvr - k.cvr) * t.users AS incremental_converters, (t.rpu - k.rpu) * t.users AS incremental_revenue
FROM c2 t JOIN c2 k ON t.campaign = k.campaign AND t.grp = 'test' AND k.grp = 'control'"""

INCREMENTALITY_KEEP_ALL = INCREMENTALITY_UPLIFT.replace(
    "ON e.user_id = o.user_id AND e.campaign = o.campaign)",
    "ON e.user_id = o.user_id AND e.campaign = o.campaign"
    " AND datediff('day', CAST(e.exposure_ts AS DATE), CAST(o.order_ts AS DATE)) BETWEEN 0 AND 30)")

_ARM = ("CASE WHEN CAST(CAST(('0x' || substr(md5(order_id), 1, 8)) AS BIGINT) AS DOUBLE) "
        "/ CAST(4294967296 AS DOUBLE) < 0.85 THEN 'Test' ELSE 'Control' END")
_HOLDOUT = _F + f""",
hs AS (SELECT holdout_group, SUM(spend) AS spend FROM ads GROUP BY 1),
hr AS (SELECT {_ARM} AS holdout_group, SUM(revenue) AS revenue FROM od GROUP BY 1),
hd AS (SELECT COALESCE(hs.holdout_group, hr.holdout_group) AS holdout_group,
              COALESCE({d('hs.spend')}, 0.0) AS spend, COALESCE({d('hr.revenue')}, 0.0) AS revenue
       FROM hs FULL JOIN hr ON hs.holdout_group = hr.holdout_group)"""
HOLDOUT_DETAIL = _HOLDOUT + f"""
SELECT holdout_group, round_even(spend, 0) AS spend, round_even(revenue, 0) AS revenue,
       round_even({r('revenue', 'spend', 'zero')}, 2) AS ROAS
FROM hd ORDER BY holdout_group ASC NULLS FIRST"""
HOLDOUT_SUMMARY = _HOLDOUT + f""",
s AS (SELECT SUM(CASE WHEN holdout_group = 'Test' THEN revenue ELSE 0.0 END) AS t,
             SUM(CASE WHEN holdout_group = 'Control' THEN revenue ELSE 0.0 END) AS c FROM hd)
SELECT 'Test revenue' AS metric, round(t, {P}) AS value FROM s
UNION ALL SELECT 'Control revenue', round(c, {P}) FROM s
UNION ALL SELECT 'Incremental lift', round(CASE WHEN c > 0 THEN (t - c) / c END, {P}) FROM s"""

# ------------------------------------------------------------------ budget
BUDGET_GUARDED = _rollup("channel") + f""",
s AS (SELECT SUM(ROAS) AS sr, COUNT(*) AS n FROM t),
cl AS (SELECT t.*, LEAST(GREATEST(CASE WHEN s.sr = 0 THEN CAST(1 AS DOUBLE) / s.n ELSE ROAS / s.sr END,
                                  0.05), 0.70) AS clip FROM t, s),
sc AS (SELECT SUM(clip) AS tot FROM cl)
SELECT channel, spend, revenue, round_even(ROAS, 2) AS ROAS, round_even(CAC, 0) AS CAC,
       round_even(CTR, 4) AS CTR, round_even(CVR, 4) AS CVR, round_even(clip / tot, 4) AS rec_share,
       round_even(clip / tot * 200000.0, 0) AS rec_budget
FROM cl, sc ORDER BY rec_budget DESC, channel ASC NULLS LAST"""

# ------------------------------------------------------------------ filters
FILTER_OPTIONS = """
SELECT 'channel' AS kind, channel AS value FROM (SELECT channel FROM m_ads UNION SELECT channel FROM m_orders) a
UNION ALL
SELECT 'campaign', campaign FROM (SELECT campaign FROM m_ads UNION SELECT campaign FROM m_orders
                                  UNION SELECT campaign FROM m_web) b"""

DATE_BOUNDS = """
SELECT MIN(d) AS min_dt, MAX(d) AS max_dt FROM (
  SELECT dt AS d FROM m_ads UNION ALL SELECT CAST(order_ts AS DATE) FROM m_orders
  UNION ALL SELECT CAST(event_ts AS DATE) FROM m_web) x"""

FILTERED_ORDERS = f"""
SELECT order_id, user_id, CAST(order_ts AS DATE) AS dt, CAST(revenue AS DOUBLE) AS revenue, channel, campaign
FROM m_orders
WHERE CAST(order_ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'
  AND channel IN {_in(SEL_CHANNELS)} AND campaign IN {_in(SEL_CAMPAIGNS)}"""

# ------------------------------------------------------------------ validation
_EV = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAMES.items()) + " END"
_RAW = f"""
WITH r_ads AS (
  SELECT CASE WHEN event_type = 'click' THEN strftime(ts, '%Y/%m/%d') ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS dt,
         CAST(1000 + event_id % 500 AS VARCHAR) AS impressions, CAST(event_id % 50 AS VARCHAR) AS clicks,
         CAST(value AS VARCHAR) AS spend
  FROM events WHERE event_type IN ('view', 'click')),
r_web AS (SELECT CAST(ts AS VARCHAR) AS event_ts, COALESCE({_EV}, event_type) AS event_name FROM events),
r_orders AS (SELECT CAST(order_ts AS VARCHAR) AS order_ts, CAST(revenue AS VARCHAR) AS revenue,
                    CAST(cost AS VARCHAR) AS cost FROM m_orders),
r_cust AS (SELECT CAST(first_seen_ts AS VARCHAR) AS first_seen_ts FROM m_customers),
r_exp AS (SELECT "group" AS grp, CAST(exposure_ts AS VARCHAR) AS exposure_ts FROM m_exposure)"""


def _date_bad(c, mode):
    return (f"TRY_STRPTIME({c}, '%Y-%m-%d') IS NULL" if mode == "coerce"
            else f"{c} IS NOT NULL AND TRY_STRPTIME({c}, '%Y-%m-%d') IS NULL")


def _ts_bad(c, mode):
    return (f"TRY_CAST({c} AS TIMESTAMP) IS NULL" if mode == "coerce"
            else f"{c} IS NOT NULL AND TRY_CAST({c} AS TIMESTAMP) IS NULL")


def _int_bad(c, mode):
    return f"TRY_CAST(TRY_CAST({c} AS DOUBLE) AS BIGINT) IS NULL"


def _float_bad(c, mode):
    return (f"TRY_CAST({c} AS DOUBLE) IS NULL" if mode == "coerce"
            else f"{c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL")


def _report(table: str, src: str, checks: list[tuple[str, str | None, str]]) -> str:
    parts = [f"SELECT '{table}' AS \"table\", '{chk}' AS \"check\", "
             + (f"'{col}'" if col else "CAST(NULL AS VARCHAR)")
             + f" AS \"column\", CAST(COUNT_IF({pred}) AS BIGINT) AS violations FROM {src}"
             for chk, col, pred in checks]
    parts.append(f"SELECT '{table}', 'non_empty', CAST(NULL AS VARCHAR), "
                 f"CAST(CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM {src}")
    return "\nUNION ALL\n".join(parts)


def _validation(mode: str) -> str:
    m = mode
    ads = _report("ads_daily", "r_ads", [("parse_date", "dt", _date_bad("dt", m)),
                                         ("parse_int", "impressions", _int_bad("impressions", m)),
                                         ("parse_int", "clicks", _int_bad("clicks", m)),
                                         ("parse_float", "spend", _float_bad("spend", m))])
    web_checks = [("parse_datetime", "event_ts", _ts_bad("event_ts", m))]
    if mode == "strict":
        web_checks.append(("domain", "event_name",
                           f"event_name IS NULL OR event_name NOT IN {_in(FUNNEL_STAGES)}"))
    web = _report("web_events", "r_web", web_checks)
    od = _report("orders", "r_orders", [("parse_datetime", "order_ts", _ts_bad("order_ts", m)),
                                        ("parse_float", "revenue", _float_bad("revenue", m)),
                                        ("parse_float", "cost", _float_bad("cost", m))])
    parts = [ads, web, od]
    if mode == "strict":
        parts.append(_report("customers", "r_cust", [("parse_datetime", "first_seen_ts",
                                                      _ts_bad("first_seen_ts", m))]))
        parts.append(_report("exposure_holdout", "r_exp", [
            ("parse_datetime", "exposure_ts", _ts_bad("exposure_ts", m)),
            ("domain", "group", "lower(grp) IS NULL OR lower(grp) NOT IN ('test', 'control')")]))
    return _RAW + "\n" + "\nUNION ALL\n".join(parts)


_CF_RAW = """
WITH r_cf AS (SELECT CAST(dt AS VARCHAR) AS dt, CAST(impressions AS VARCHAR) AS impressions,
                     CAST(clicks AS VARCHAR) AS clicks, CAST(spend AS VARCHAR) AS spend,
                     CAST(orders AS VARCHAR) AS orders, CAST(revenue AS VARCHAR) AS revenue,
                     CAST(cost AS VARCHAR) AS cost FROM m_campaign_daily)"""


def _num_bad(c):
    return f"{c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL"


def _int_num_bad(c):
    return f"{c} IS NOT NULL AND TRY_CAST(TRY_CAST({c} AS DOUBLE) AS BIGINT) IS NULL"


VALIDATE_CAMPAIGN_FILE = _CF_RAW + "\n" + _report("campaign_daily", "r_cf", [
    ("parse_date", "dt", _date_bad("dt", "coerce")),
    ("parse_int", "impressions", _int_num_bad("impressions")),
    ("parse_int", "clicks", _int_num_bad("clicks")),
    ("parse_float", "spend", _num_bad("spend")),
    ("parse_int", "orders", _int_num_bad("orders")),
    ("parse_float", "revenue", _num_bad("revenue")),
    ("parse_float", "cost", _num_bad("cost"))])

UNKNOWN_EVENTS = _RAW + f"""
SELECT DISTINCT COALESCE(event_name, 'nan') AS event_name FROM r_web
WHERE COALESCE(event_name, 'nan') NOT IN {_in(FUNNEL_STAGES)} ORDER BY event_name"""


ORACLE: dict[str, str] = {
    "paid_perf_daily": PAID_PERF_DAILY,
    "paid_daily_zero": PAID_DAILY_ZERO,
    "daily_trend": DAILY_TREND,
    "campaign_table": CAMPAIGN_TABLE,
    "top_campaigns": TOP_CAMPAIGNS,
    "channel_summary": CHANNEL_SUMMARY,
    "kpi_cards": KPI_CARDS,
    "channel_kpi": CHANNEL_KPI,
    "paid_lattice": PAID_LATTICE,
    "buyers_distinct": BUYERS_DISTINCT,
    "sessions_distinct": SESSIONS_DISTINCT,
    "sql_orders_in": SQL_ORDERS_IN,
    "sql_ads_in": SQL_ADS_IN,
    "sql_attribution_by": SQL_ATTRIBUTION_BY,
    "kpi_cards_channel": KPI_CARDS_CHANNEL,
    "campaign_kpis": CAMPAIGN_KPIS,
    "campaign_cards": CAMPAIGN_CARDS,
    "funnel_stage_daily": FUNNEL_STAGE_DAILY,
    "funnel_by_campaign": FUNNEL_BY_CAMPAIGN,
    "funnel_long": FUNNEL_LONG,
    "funnel_coarse": FUNNEL_COARSE,
    "cac_daily": CAC_DAILY,
    "cac_daily_range": CAC_DAILY_RANGE,
    "ltv_by_cohort": LTV_BY_COHORT,
    "retention_rates": RETENTION_RATES,
    "retention_matrix": RETENTION_MATRIX,
    "retention_90d": RETENTION_90D,
    "growth_summary": GROWTH_SUMMARY,
    "ltv_table": LTV_TABLE,
    "attribution_models": ATTRIBUTION_MODELS,
    "last_touch": LAST_TOUCH,
    "last_touch_before_order": LAST_TOUCH_BEFORE_ORDER,
    "paid_perf_subcent": PAID_PERF_SUBCENT,
    "attribution_subcent": ATTRIBUTION_SUBCENT,
    "attribution_lookback": ATTRIBUTION_LOOKBACK,
    "order_campaign_credit": ORDER_CAMPAIGN_CREDIT,
    "attribution_table": ATTRIBUTION_TABLE,
    "incrementality_uplift": INCREMENTALITY_UPLIFT,
    "incrementality_keep_all": INCREMENTALITY_KEEP_ALL,
    "holdout_detail": HOLDOUT_DETAIL,
    "holdout_summary": HOLDOUT_SUMMARY,
    "budget_weight": BUDGET_WEIGHT,
    "budget_guarded": BUDGET_GUARDED,
    "filter_options": FILTER_OPTIONS,
    "date_bounds": DATE_BOUNDS,
    "filtered_orders": FILTERED_ORDERS,
    "validate_report": _validation("strict"),
    "validate_report_coerce": _validation("coerce"),
    "unknown_events": UNKNOWN_EVENTS,
    "validate_campaign_file": VALIDATE_CAMPAIGN_FILE,
}

def oracle_sql() -> dict[str, str]:
    return {k: with_bindings(v) for k, v in ORACLE.items()}
