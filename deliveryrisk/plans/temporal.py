"""Time queries T-1 to T-18."""

from deliveryrisk.operators import scope
from deliveryrisk.operators import temporal as T
from deliveryrisk.plans.registry import query, sql_rate
from deliveryrisk.plans.sqlparts import MONEY, ORDER_VALUE, PERIOD_CLOCK

RATE = sql_rate("SUM(items_missing)", "SUM(items_delivered)")
MONTH = "CAST(DATE_TRUNC('month', order_date) AS DATE)"
M = "CAST(SUM(items_missing) AS BIGINT) AS items_missing"
D = "CAST(SUM(items_delivered) AS BIGINT) AS items_delivered"
TI = "CAST(SUM(items_missing + items_delivered) AS BIGINT) AS total_items"
WM = "COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing"
HOUR_LABEL = (
    "CASE WHEN delivery_hour <= 6 THEN 'Night (0-6)' WHEN delivery_hour <= 12 THEN 'Morning (6-12)' "
    "WHEN delivery_hour <= 18 THEN 'Afternoon (12-18)' ELSE 'Evening (18-24)' END"
)
DAY_NUM = "CAST(EXTRACT(ISODOW FROM order_date) - 1 AS INTEGER)"

PERIODS = {
    "day": ("order_date", "INTERVAL 1 DAY", "CAST(s AS DATE)"),
    "week": ("CAST(DATE_TRUNC('week', order_date) AS DATE)", "INTERVAL 7 DAY", "CAST(s + INTERVAL 6 DAY AS DATE)"),
    "month": (MONTH, "INTERVAL 1 MONTH", "LAST_DAY(CAST(s AS DATE))"),
    "quarter": (
        "CAST(DATE_TRUNC('quarter', order_date) AS DATE)",
        "INTERVAL 3 MONTH",
        "LAST_DAY(CAST(s + INTERVAL 2 MONTH AS DATE))",
    ),
}
for _p, (_start, _step, _end) in PERIODS.items():

    @query(
        f"aggregate_by_{_p}",
        f"""WITH b AS (SELECT {_start} AS start, COUNT(*) AS total_orders, {MONEY} AS total_revenue, {D}, {M}, {TI},
  {RATE} AS missing_rate FROM ord GROUP BY 1),
sp AS (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(start) FROM b), (SELECT MAX(start) FROM b), {_step})) AS s)
SELECT {_end} AS period, COALESCE(total_orders, 0) AS total_orders, COALESCE(total_revenue, 0.0) AS total_revenue,
  COALESCE(items_delivered, 0) AS items_delivered, COALESCE(items_missing, 0) AS items_missing,
  COALESCE(total_items, 0) AS total_items, COALESCE(missing_rate, 0.0) AS missing_rate
FROM sp LEFT JOIN b ON b.start = CAST(sp.s AS DATE)""",
        "total_revenue missing_rate",
    )
    def _(t, p=_p):
        return T.aggregate_by_period(t.orders, p)


@query(
    "monthly_trends",
    f"""WITH b AS (SELECT {MONTH} AS month, COUNT(*) AS total_orders, {MONEY} AS total_revenue,
  {MONEY} / COUNT(*) AS avg_order_value, {D}, {M}, COUNT(DISTINCT driver_id) AS unique_drivers,
  COUNT(DISTINCT customer_id) AS unique_customers, {WM}, {TI}, {RATE} AS missing_rate FROM ord GROUP BY 1)
SELECT b.*, CAST(orders_with_missing AS DOUBLE) / total_orders * 100.0 AS pct_orders_with_missing,
  CAST(total_orders - LAG(total_orders) OVER w AS DOUBLE) / LAG(total_orders) OVER w * 100.0 AS orders_mom,
  (total_revenue - LAG(total_revenue) OVER w) / LAG(total_revenue) OVER w * 100.0 AS revenue_mom,
  missing_rate - LAG(missing_rate) OVER w AS missing_rate_change FROM b WINDOW w AS (ORDER BY month)""",
    "total_revenue avg_order_value missing_rate pct_orders_with_missing orders_mom revenue_mom missing_rate_change",
)
def _(t):
    return T.monthly_trends(t.orders)


@query(
    "weekly_patterns",
    f"""SELECT CAST(DATE_TRUNC('week', order_date) AS DATE) AS week, COUNT(*) AS total_orders, {MONEY} AS total_revenue,
  {D}, {M}, {TI}, {RATE} AS missing_rate FROM ord GROUP BY 1""",
    "total_revenue missing_rate",
)
def _(t):
    return T.weekly_patterns(t.orders)


DOW = f"""dow AS (SELECT {DAY_NUM} AS day_num, STRFTIME(order_date, '%A') AS day_of_week, COUNT(*) AS total_orders,
  {MONEY} AS total_revenue, {MONEY} / COUNT(*) AS avg_order_value, {D}, {M}, {TI}, {RATE} AS missing_rate,
  {DAY_NUM} >= 5 AS is_weekend FROM ord GROUP BY 1, 2, {DAY_NUM} >= 5)"""
HOURLY = f"""hr AS (SELECT delivery_hour AS hour, COUNT(*) AS total_orders, {MONEY} / COUNT(*) AS avg_order_value, {D}, {M},
  {TI}, {RATE} AS missing_rate, {HOUR_LABEL} AS period FROM ord GROUP BY delivery_hour)"""
MONTHLY = f"""mo AS (SELECT {MONTH} AS month, {RATE} AS missing_rate FROM ord GROUP BY 1)"""


@query("day_of_week_patterns", f"WITH {DOW} SELECT * FROM dow", "total_revenue avg_order_value missing_rate")
def _(t):
    return T.day_of_week_patterns(t.orders)


@query("hourly_patterns", f"WITH {HOURLY} SELECT * FROM hr", "avg_order_value missing_rate")
def _(t):
    return T.hourly_patterns(t.orders)


VIEW = f"""COUNT(*) AS orders_count, {WM}, CAST(SUM(items_delivered) AS BIGINT) AS total_items_delivered,
  CAST(SUM(items_missing) AS BIGINT) AS total_items_missing, {MONEY} AS total_order_value,
  ROUND(SUM(items_missing) / CAST(NULLIF(SUM(items_delivered), 0) AS DOUBLE) * 100.0, 2) AS missing_item_rate_pct"""


@query(
    "monthly_fraud_trends",
    f"""WITH {ORDER_VALUE},
b AS (SELECT {MONTH} AS month_start, {VIEW} FROM ord GROUP BY 1),
v AS (SELECT {MONTH} AS month_start, SUM(v) AS total_missing_value FROM ord JOIN ov USING (order_id) GROUP BY 1)
SELECT b.*, STRFTIME(b.month_start, '%B %Y') AS month_name, COALESCE(total_missing_value, 0.0) AS total_missing_value,
  ROUND(orders_with_missing / CAST(orders_count AS DOUBLE) * 100.0, 2) AS missing_order_rate_pct,
  LAG(total_items_missing) OVER w AS prev_month_missing,
  total_items_missing - LAG(total_items_missing) OVER w AS mom_missing_change
FROM b LEFT JOIN v USING (month_start) WINDOW w AS (ORDER BY b.month_start)""",
    "total_order_value total_missing_value missing_order_rate_pct missing_item_rate_pct",
)
def _(t):
    return T.monthly_fraud_trends(t.orders, t.missing_items, t.products)


@query(
    "hourly_fraud_patterns",
    f"""SELECT delivery_hour AS delivery_hour_int, CASE WHEN delivery_hour BETWEEN 6 AND 11 THEN 'Morning (6-11)'
  WHEN delivery_hour BETWEEN 12 AND 17 THEN 'Afternoon (12-17)' WHEN delivery_hour BETWEEN 18 AND 21
  THEN 'Evening (18-21)' ELSE 'Night (22-5)' END AS delivery_period, {VIEW} FROM ord GROUP BY delivery_hour""",
    "total_order_value missing_item_rate_pct",
)
def _(t):
    return T.hourly_fraud_patterns(t.orders)


@query(
    "day_of_week_fraud_patterns",
    f"""SELECT CAST(EXTRACT(DOW FROM order_date) AS INTEGER) AS day_of_week, STRFTIME(order_date, '%A') AS day_name,
  {VIEW} FROM ord GROUP BY 1, 2""",
    "total_order_value missing_item_rate_pct",
)
def _(t):
    return T.day_of_week_fraud_patterns(t.orders)


@query(
    "legacy_monthly_trends",
    f"""SELECT {MONTH} AS month, COUNT(*) AS total_orders, CAST(SUM(items_missing) AS BIGINT) AS total_items_missing,
  {MONEY} AS total_revenue, ROUND({RATE}, 2) AS missing_rate_pct FROM ord GROUP BY 1""",
    "total_revenue missing_rate_pct",
)
def _(t):
    return T.legacy_trends(t.orders, "month")


@query(
    "legacy_hourly_patterns",
    f"""SELECT delivery_hour AS hour_of_day, COUNT(*) AS total_orders,
  CAST(SUM(items_missing) AS BIGINT) AS total_items_missing, ROUND({RATE}, 2) AS missing_rate_pct
FROM ord WHERE delivery_hour IS NOT NULL GROUP BY 1""",
    "missing_rate_pct",
)
def _(t):
    return T.legacy_trends(t.orders, "hour")


def _moy(source):
    return f"""SELECT CAST(EXTRACT(MONTH FROM order_date) AS INTEGER) AS month, STRFTIME(order_date, '%b') AS month_name,
  COUNT(*) AS total_orders, {MONEY} AS total_revenue, {D}, {M}, {WM}, {RATE} AS missing_rate,
  COUNT(CASE WHEN items_missing > 0 THEN 1 END) * 100.0 / COUNT(*) AS pct_orders_with_missing FROM {source} GROUP BY 1, 2"""


def _wd(source):
    return f"""SELECT {DAY_NUM} AS day_num, STRFTIME(order_date, '%A') AS day_of_week, COUNT(*) AS total_orders,
  {MONEY} AS total_revenue, {D}, {M}, {RATE} AS missing_rate FROM {source} GROUP BY 1, 2"""


def _hr(source):
    return f"""SELECT delivery_hour AS hour, COUNT(*) AS total_orders, {D}, {M}, {RATE} AS missing_rate,
  {PERIOD_CLOCK} AS period FROM {source} GROUP BY delivery_hour"""


@query("temporal_trends_monthly", _moy("ord"), "total_revenue missing_rate pct_orders_with_missing")
def _(t):
    return T.trends_month_of_year(t.orders)


@query("temporal_trends_daily", _wd("ord"), "total_revenue missing_rate")
def _(t):
    return T.trends_weekday(t.orders)


@query("temporal_trends_hourly", _hr("ord"), "missing_rate")
def _(t):
    return T.trends_hour(t.orders)


def sql_anomalies(parts, k):
    return " UNION ALL ".join(
        f"""SELECT '{seg}' AS segment, {label} AS period, missing_rate,
  (SELECT AVG(missing_rate) + {k} * STDDEV_SAMP(missing_rate) FROM {src}) AS threshold,
  (missing_rate - (SELECT AVG(missing_rate) FROM {src})) / (SELECT STDDEV_SAMP(missing_rate) FROM {src}) AS deviation
FROM {src} WHERE missing_rate > (SELECT AVG(missing_rate) + {k} * STDDEV_SAMP(missing_rate) FROM {src})"""
        for seg, label, src in parts
    )


PARTS = [
    ("monthly", "STRFTIME(month, '%Y-%m')", "mo"),
    ("daily", "day_of_week", "dow"),
    ("hourly", "LPAD(CAST(hour AS VARCHAR), 2, '0') || ':00'", "hr"),
]
for _k in (2, 1):

    @query(
        f"temporal_anomalies_{_k}_sigma",
        f"WITH {MONTHLY}, {DOW}, {HOURLY} SELECT * FROM ({sql_anomalies(PARTS, _k)})",
        "missing_rate threshold deviation",
    )
    def _(t, k=_k):
        return T.temporal_anomalies(t.orders, float(k))


TREND = f"""{MONTHLY}, mi AS (SELECT *, ROW_NUMBER() OVER (ORDER BY month) - 1 AS i, COUNT(*) OVER () AS n FROM mo),
td0 AS (SELECT REGR_SLOPE(missing_rate, i) AS slope, AVG(CASE WHEN i < 3 THEN missing_rate END) AS first_period_avg,
  AVG(CASE WHEN i >= n - 3 THEN missing_rate END) AS last_period_avg,
  (SELECT month FROM mo ORDER BY missing_rate DESC, month LIMIT 1) AS peak_month, MAX(missing_rate) AS peak_rate,
  (SELECT month FROM mo ORDER BY missing_rate, month LIMIT 1) AS lowest_month, MIN(missing_rate) AS lowest_rate FROM mi),
td AS (SELECT *, CASE WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS direction,
  (last_period_avg - first_period_avg) / first_period_avg * 100.0 AS change_pct FROM td0)"""
TD_DOUBLES = "slope first_period_avg last_period_avg peak_rate lowest_rate change_pct"


@query("trend_direction", f"WITH {TREND} SELECT * FROM td", TD_DOUBLES)
def _(t):
    return T.trend_direction(T.monthly_rates(t.orders))


SUMMARY = f"""{TREND}, {DOW}, {HOURLY},
ts AS (SELECT td.*, (SELECT MIN(order_date) FROM ord) AS date_start, (SELECT MAX(order_date) FROM ord) AS date_end,
  (SELECT COUNT(*) FROM mo) AS total_months,
  (SELECT COUNT(*) FROM ({sql_anomalies(PARTS, 2)})) AS anomalies_total,
  (SELECT day_of_week FROM dow ORDER BY missing_rate DESC, day_num LIMIT 1) AS worst_day,
  (SELECT day_of_week FROM dow ORDER BY missing_rate, day_num LIMIT 1) AS best_day,
  (SELECT hour FROM hr ORDER BY missing_rate DESC, hour LIMIT 1) AS worst_hour,
  (SELECT hour FROM hr ORDER BY missing_rate, hour LIMIT 1) AS best_hour,
  (SELECT AVG(missing_rate) FROM dow WHERE is_weekend) AS weekend_rate,
  (SELECT AVG(missing_rate) FROM dow WHERE NOT is_weekend) AS weekday_rate FROM td)"""


@query("temporal_summary", f"WITH {SUMMARY} SELECT * FROM ts", TD_DOUBLES + " weekend_rate weekday_rate")
def _(t):
    return T.temporal_summary(t.orders)


@query(
    "trend_delta",
    f"""WITH m AS ({_moy('ord')}),
x AS (SELECT (SELECT missing_rate FROM m ORDER BY month DESC LIMIT 1) AS current_rate,
  (SELECT missing_rate FROM m ORDER BY month DESC LIMIT 1 OFFSET 1) AS previous_rate, AVG(missing_rate) AS avg_rate,
  (SELECT month_name FROM m ORDER BY missing_rate DESC, month LIMIT 1) AS peak_month, MAX(missing_rate) AS peak_rate FROM m)
SELECT *, current_rate - previous_rate AS delta_pp, (current_rate - previous_rate) / previous_rate * 100.0 AS delta_pct,
  CASE WHEN current_rate - previous_rate > 0.5 THEN 'up' WHEN current_rate - previous_rate < -0.5 THEN 'down'
    ELSE 'stable' END AS direction FROM x""",
    "current_rate previous_rate avg_rate peak_rate delta_pp delta_pct",
)
def _(t):
    return T.trend_delta(T.trends_month_of_year(t.orders))


BASELINE = f"""hb0 AS (SELECT delivery_hour AS hour, COUNT(*) AS orders, {M}, {TI}, {RATE} AS missing_rate
  FROM ord GROUP BY delivery_hour),
hb AS (SELECT *, AVG(missing_rate) OVER () AS baseline,
  AVG(missing_rate) OVER () + 2 * STDDEV_SAMP(missing_rate) OVER () AS upper_threshold,
  missing_rate > AVG(missing_rate) OVER () + 2 * STDDEV_SAMP(missing_rate) OVER () AS is_anomaly FROM hb0)"""


@query("hourly_baseline", f"WITH {BASELINE} SELECT * FROM hb", "missing_rate baseline upper_threshold")
def _(t):
    return T.hourly_baseline(t.orders)


@query(
    "hourly_watchtower",
    f"""WITH {BASELINE},
x AS (SELECT (SELECT AVG(missing_rate) FROM (SELECT missing_rate FROM hb ORDER BY hour DESC LIMIT 6)) AS current_rate,
  AVG(missing_rate) AS baseline_rate, STDDEV_SAMP(missing_rate) AS sd,
  COUNT(CASE WHEN is_anomaly THEN 1 END) AS active_anomalies, CAST(SUM(orders) AS BIGINT) AS total_orders,
  100.0 - AVG(missing_rate) AS clean_rate FROM hb),
y AS (SELECT * EXCLUDE (sd), (current_rate - baseline_rate) / sd AS sigma_deviation FROM x)
SELECT *, CASE WHEN sigma_deviation >= 2 THEN 'CRITICAL' WHEN sigma_deviation >= 1 THEN 'ELEVATED'
  WHEN sigma_deviation >= 0.5 THEN 'MODERATE' ELSE 'NORMAL' END AS threat_level FROM y""",
    "current_rate baseline_rate clean_rate sigma_deviation",
)
def _(t):
    return T.hourly_watchtower(T.hourly_baseline(t.orders))


SCOPED = "so AS (SELECT * FROM ord WHERE order_id IN (SELECT order_id FROM mis JOIN prd USING (product_id) WHERE category = 'STANDARD'))"
SCOPED_PARTS = [
    ("daily", "day_of_week", "sd"),
    ("hourly", "LPAD(CAST(hour AS VARCHAR), 2, '0') || ':00'", "sh"),
    ("monthly", "month_name", "sm"),
]
SCOPED_ALL = f"{SCOPED}, sd AS ({_wd('so')}), sh AS ({_hr('so')}), sm AS ({_moy('so')})"


def scoped(t):
    return scope.scope_orders_by_product(t.orders, t.missing_items, t.products, "STANDARD")


@query(
    "scoped_anomalies",
    f"WITH {SCOPED_ALL} SELECT * FROM ({sql_anomalies(SCOPED_PARTS, 1)})",
    "missing_rate threshold deviation",
)
def _(t):
    return T.scoped_anomalies(scoped(t), 1.0)


@query(
    "scoped_trend",
    f"""WITH {SCOPED_ALL},
x AS (SELECT AVG(CASE WHEN r <= n // 2 THEN missing_rate END) AS first_rate,
  AVG(CASE WHEN r > n - n // 2 THEN missing_rate END) AS last_rate
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY month) AS r, COUNT(*) OVER () AS n FROM sm)),
y AS (SELECT *, (last_rate - first_rate) / first_rate * 100.0 AS change_pct FROM x)
SELECT *, CASE WHEN change_pct > 0.5 THEN 'increasing' WHEN change_pct < -0.5 THEN 'decreasing' ELSE 'stable' END
  AS direction, (SELECT day_of_week FROM sd ORDER BY missing_rate DESC, day_num LIMIT 1) AS worst_day,
  (SELECT hour FROM sh ORDER BY missing_rate DESC, hour LIMIT 1) AS worst_hour FROM y""",
    "first_rate last_rate change_pct",
)
def _(t):
    return T.scoped_trend(scoped(t))


@query(
    "flatten_anomalies",
    f"""WITH {MONTHLY}, {DOW}, {HOURLY}, a AS ({sql_anomalies(PARTS, 1)})
SELECT UPPER(SUBSTR(segment, 1, 1)) || SUBSTR(segment, 2) AS segment, period, ROUND(missing_rate, 2) AS missing_rate_pct,
  ROUND(threshold, 2) AS threshold_pct, ROUND(missing_rate - threshold, 2) AS gap_pp FROM a""",
    "missing_rate_pct threshold_pct gap_pp",
)
def _(t):
    return T.flatten_anomalies(T.temporal_anomalies(t.orders, 1.0))


@query(
    "period_stats",
    f"""SELECT {PERIOD_CLOCK} AS period, COUNT(*) AS total_orders, {MONEY} AS total_revenue,
  {MONEY} / COUNT(*) AS avg_order_value, {D}, {M}, {WM}, {RATE} AS missing_rate FROM ord GROUP BY 1""",
    "total_revenue avg_order_value missing_rate",
)
def _(t):
    return T.period_stats(t.orders)
