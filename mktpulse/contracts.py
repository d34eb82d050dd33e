"""Input-table contracts: required columns, declared types, allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values (must equal the reference's contract for identical results).
# Allowed web event names, in funnel order.
FUNNEL_STAGES = ["page_view", "product_view", "add_to_cart", "begin_checkout"]
# Stage labels of the daily funnel mart, one per event name above, same order.
STAGE_LABELS = ["session", "view", "atc", "checkout"]
# Holdout arm labels, compared lower-cased.
HOLDOUT_GROUPS = ["test", "control"]
# Time-decay attribution rate per minute before the order.
DECAY_PER_MINUTE = 0.00048
# Default knobs: LTV lookback 180 days (30..365), exposure window 30 days,
# budget 200000 with per-channel share guard rails 5 % .. 70 %, top-N 10 (5..30).
DEFAULT_LTV_LOOKBACK_DAYS = 180
DEFAULT_EXPOSURE_LOOKBACK_DAYS = 30
DEFAULT_TOTAL_BUDGET = 200000.0
MIN_SHARE = 0.05
MAX_SHARE = 0.70
DEFAULT_TOP_N = 10
# Share of orders put in the Test arm when no holdout label exists.
TEST_SHARE = 0.85

# Cells that a CSV reader of the dashboards takes for missing (fixed values).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
             "NULL", "NaN", "None", "n/a", "nan", "null"]


def _schema(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, t, True) for c, t in types.items()])


_DATE, _TIME, _INT, _FLOAT, _TEXT = T.DateType(), T.TimestampType(), T.LongType(), T.DoubleType(), T.StringType()

# One schema per upload: the required columns with their types. The names and types are fixed values.
ADS_DAILY = _schema(dt=_DATE, channel=_TEXT, campaign=_TEXT, impressions=_INT, clicks=_INT, spend=_FLOAT)
WEB_EVENTS = _schema(user_id=_TEXT, session_id=_TEXT, event_ts=_TIME, event_name=_TEXT, device=_TEXT, source=_TEXT,
                     medium=_TEXT, campaign=_TEXT)
ORDERS = _schema(order_id=_TEXT, user_id=_TEXT, order_ts=_TIME, revenue=_FLOAT, cost=_FLOAT, channel=_TEXT, campaign=_TEXT)
CUSTOMERS = _schema(user_id=_TEXT, first_seen_ts=_TIME)
EXPOSURE_HOLDOUT = _schema(user_id=_TEXT, campaign=_TEXT, group=_TEXT, exposure_ts=_TIME)
CAMPAIGN_DAILY = _schema(dt=_DATE, campaign=_TEXT, impressions=_INT, clicks=_INT, spend=_FLOAT, orders=_INT, revenue=_FLOAT,
                         cost=_FLOAT)
#: Columns that the ads upload may have besides.
OPTIONAL_COLUMNS = {"ads_daily": ["geo", "holdout_group"]}


class Dashboard:
    """What one dashboard asks of its uploads: tables, parse mode, and how it treats other columns."""

    def __init__(self, mode: str, mandatory: dict[str, T.StructType], optional: dict[str, T.StructType] | None = None,
                 allow_optional: bool = True, allow_extra: bool = False):
        self.mode, self.mandatory, self.optional = mode, mandatory, optional or {}
        self.allow_optional, self.allow_extra = allow_optional, allow_extra

    def schema(self, table: str) -> T.StructType:
        return {**self.mandatory, **self.optional}[table]


DASHBOARDS = {
    # four mandatory tables and the exposures; any other column is an error
    "main": Dashboard("strict", {"ads_daily": ADS_DAILY, "web_events": WEB_EVENTS, "orders": ORDERS, "customers": CUSTOMERS},
                      {"exposure_holdout": EXPOSURE_HOLDOUT}, allow_optional=False),
    # three tables; web events need no device; other columns are kept
    "growth": Dashboard("coerce", {
        "ads_daily": ADS_DAILY, "orders": ORDERS,
        "web_events": T.StructType([f for f in WEB_EVENTS.fields if f.name != "device"])}, allow_extra=True),
    "campaign": Dashboard("numeric", {"campaign_daily": CAMPAIGN_DAILY}, allow_extra=True),
}

#: The widest contract of each table, used where no dashboard is named.
SCHEMAS = {"ads_daily": ADS_DAILY, "web_events": WEB_EVENTS, "orders": ORDERS, "customers": CUSTOMERS,
           "exposure_holdout": EXPOSURE_HOLDOUT, "campaign_daily": CAMPAIGN_DAILY}


def schema_of(table: str, dashboard: str | None = None) -> T.StructType:
    return DASHBOARDS[dashboard].schema(table) if dashboard else SCHEMAS[table]


def parsed_columns(table: str, dashboard: str | None = None) -> dict[str, str]:
    """Columns that are parsed from text, with their kind: date, datetime, int, float."""
    kinds = {"date": "date", "timestamp": "datetime", "bigint": "int", "double": "float"}
    fields = schema_of(table, dashboard).fields
    return {f.name: kinds[f.dataType.simpleString()] for f in fields if f.dataType.simpleString() in kinds}
