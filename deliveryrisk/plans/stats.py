"""Statistics queries ST-1 to ST-11."""

from pyspark.sql import functions as F

from deliveryrisk.operators import drivers as D
from deliveryrisk.operators import features as O
from deliveryrisk.operators import regions as G
from deliveryrisk.operators import stats as S
from deliveryrisk.plans.drift import HALVES, sql_ks
from deliveryrisk.plans.features import ORDER_FEATURES
from deliveryrisk.plans.registry import query, sql_rate
from deliveryrisk.plans.sqlparts import DF_DOUBLES, DRIVER_FEATURES, DRIVER_SUMMARY, PERIOD_CUT, REGIONAL

CORR = ["age", "trips", "total_orders", "total_items_missing", "missing_rate", "pct_orders_with_missing"]
RATE = sql_rate("items_missing", "items_delivered")


def features(t):
    return D.driver_features(t.drivers, t.orders)


@query(
    "correlation_matrix",
    f"WITH {DRIVER_FEATURES} "
    + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, CORR({a}, {b}) AS r FROM df" for a in CORR for b in CORR),
    "r",
)
def _(t):
    return S.correlation_matrix(features(t), CORR)


@query(
    "safe_correlation",
    f"""WITH {DRIVER_FEATURES}
SELECT COUNT(*) AS sample_size, 'ok' AS status, CORR(trips, missing_rate) AS value FROM df
UNION ALL SELECT COUNT(*), 'insufficient_variance', NULL FROM df
UNION ALL SELECT COUNT(*), 'insufficient_sample', NULL FROM df WHERE driver_id < 5""",
    "value",
)
def _(t):
    df = features(t)
    flat = df.withColumn("one", F.lit(1))
    return (
        S.safe_correlation(df, "trips", "missing_rate")
        .union(S.safe_correlation(flat, "one", "missing_rate"))
        .union(S.safe_correlation(df.where("driver_id < 5"), "trips", "missing_rate"))
    )


@query(
    "correlation_strength",
    f"""WITH {DRIVER_FEATURES}, c AS ("""
    + " UNION ALL ".join(f"SELECT '{a}' AS feature, CORR({a}, missing_rate) AS r FROM df" for a in CORR)
    + """) SELECT feature, r, CASE WHEN ABS(r) >= 0.7 THEN 'Strong' WHEN ABS(r) >= 0.4 THEN 'Moderate'
  WHEN ABS(r) >= 0.2 THEN 'Weak' ELSE 'Very weak' END AS strength FROM c""",
    "r",
)
def _(t):
    cells = S.correlation_matrix(features(t), CORR).where("y = 'missing_rate'")
    return cells.select(F.col("x").alias("feature"), "r", S.correlation_strength(F.col("r")).alias("strength"))


@query(
    "outliers_iqr",
    f"""WITH {ORDER_FEATURES}, q AS (SELECT QUANTILE_CONT(missing_rate, 0.25) AS a, QUANTILE_CONT(missing_rate, 0.75) AS b
  FROM of)
SELECT order_id, missing_rate FROM of, q WHERE missing_rate < a - 0.5 * (b - a) OR missing_rate > b + 0.5 * (b - a)""",
    "missing_rate",
)
def _(t):
    return S.outliers(O.order_features(t.orders), "missing_rate", threshold=0.5).select("order_id", "missing_rate")


@query(
    "outliers_zscore",
    f"""WITH {DRIVER_FEATURES} SELECT df.* FROM df, (SELECT AVG(missing_rate) AS m, STDDEV_SAMP(missing_rate) AS s FROM df)
WHERE ABS((missing_rate - m) / s) > 1.5""",
    DF_DOUBLES,
)
def _(t):
    return S.outliers(features(t), "missing_rate", "zscore", 1.5)


@query(
    "h1_pearson",
    f"""WITH {DRIVER_SUMMARY}
SELECT COUNT(*) AS n, CORR(trips, missing_rate) AS r, AVG(CASE WHEN trips <= 25 THEN missing_rate END) AS novice_rate,
  AVG(CASE WHEN trips > 100 THEN missing_rate END) AS expert_rate FROM ds WHERE orders_completed > 0""",
    "r novice_rate expert_rate",
)
def _(t):
    return S.h1_pearson(D.driver_summary(t.drivers, t.orders)).drop("p_value", "status")


@query("h1_pearson_p")
def _(t):
    return S.h1_pearson(D.driver_summary(t.drivers, t.orders))


@query(
    "h2_hotspots",
    f"""WITH {REGIONAL}, s AS (SELECT AVG(missing_rate) + STDDEV_SAMP(missing_rate) AS h FROM rp)
SELECT COUNT(CASE WHEN missing_rate > h THEN 1 END) AS hotspots, MAX(h) AS threshold,
  CASE WHEN COUNT(CASE WHEN missing_rate > h THEN 1 END) > 0 THEN 'Validated' ELSE 'Rejected' END AS status FROM rp, s""",
    "threshold",
)
def _(t):
    return S.h2_hotspots(G.regional_performance(t.orders), 1.0)


@query(
    "h3_welch_t",
    f"""WITH r AS (SELECT {RATE} AS x, {PERIOD_CUT} = 'Night' AS night FROM ord),
s AS (SELECT AVG(CASE WHEN night THEN x END) AS mean_night, AVG(CASE WHEN NOT night THEN x END) AS mean_rest,
  COUNT(CASE WHEN night THEN 1 END) AS n_night, COUNT(CASE WHEN NOT night THEN 1 END) AS n_rest,
  VAR_SAMP(CASE WHEN night THEN x END) AS v1, VAR_SAMP(CASE WHEN NOT night THEN x END) AS v2 FROM r)
SELECT mean_night, mean_rest, n_night, n_rest, mean_night - mean_rest AS mean_gap,
  (mean_night - mean_rest) / SQRT(v1 / n_night + v2 / n_rest) AS t,
  POWER(v1 / n_night + v2 / n_rest, 2) / (POWER(v1 / n_night, 2) / (n_night - 1) + POWER(v2 / n_rest, 2) / (n_rest - 1)) AS df
FROM s""",
    "mean_night mean_rest mean_gap t df",
)
def _(t):
    return S.h3_welch_t(t.orders).drop("p_value")


@query("h3_welch_p")
def _(t):
    return S.h3_welch_t(t.orders)


@query(
    "h4_mann_whitney",
    f"""WITH r AS (SELECT {RATE} AS x, order_amount >= (SELECT QUANTILE_CONT(order_amount, 0.75) FROM ord) AS hi FROM ord),
k AS (SELECT *, RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM r),
ti AS (SELECT SUM(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT COUNT(*) AS c FROM r GROUP BY x)),
s AS (SELECT CAST(COUNT(CASE WHEN hi THEN 1 END) AS DOUBLE) AS n1, CAST(COUNT(CASE WHEN NOT hi THEN 1 END) AS DOUBLE) AS n2,
  SUM(CASE WHEN hi THEN rk END) AS r1 FROM k),
u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u FROM s)
SELECT n1, n2, u, (GREATEST(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5)
  / SQRT(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u, ti""",
    "n1 n2 u z",
)
def _(t):
    return S.h4_mann_whitney(t.orders).drop("p_value")


@query("h4_mann_whitney_p")
def _(t):
    return S.h4_mann_whitney(t.orders)


@query("ks_two_sample", f"WITH {HALVES} SELECT ks_stat, n_ref, n_curr FROM ({sql_ks('order_amount')})", "ks_stat")
def _(t):
    from deliveryrisk.operators.drift import time_halves

    return S.ks_two_sample(time_halves(t.orders), "order_amount", "is_current").drop("p_value")


TARGETS = ["order_amount", "items_delivered", "total_items", "missing_rate", "month", "day_of_week_num", "delivery_hour"]


@query(
    "top_correlates",
    f"""WITH e AS (SELECT *, items_delivered + items_missing AS total_items, {RATE} AS missing_rate,
  EXTRACT(MONTH FROM order_date) AS month, EXTRACT(ISODOW FROM order_date) - 1 AS day_of_week_num FROM ord),
c AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, CORR({c}, items_missing) AS correlation FROM e" for c in TARGETS)
    + ") SELECT * FROM c ORDER BY correlation DESC, feature LIMIT 5",
    "correlation",
)
def _(t):
    return S.top_correlates(O.orders_enriched(t.orders), "items_missing", TARGETS)


def sql_regression(columns, target):
    """Elimination on the matrix of covariances, a column at a time; c{i}_{j} is its cell, b{i} a slope."""
    names, k = [*columns, target], len(columns)
    cells = [(i, j) for i in range(k) for j in range(k + 1)]
    steps = ["e0 AS (SELECT " + ", ".join(f"COVAR_POP({names[i]}, {names[j]}) AS c{i}_{j}" for i, j in cells) + " FROM fit)"]
    for s in range(k):
        pivot = {(i, j): f"c{i}_{j} / c{s}_{s}" if i == s else f"c{i}_{j} - c{i}_{s} / c{s}_{s} * c{s}_{j}" for i, j in cells}
        steps.append(f"e{s + 1} AS (SELECT " + ", ".join(f"{v} AS c{i}_{j}" for (i, j), v in pivot.items()) + f" FROM e{s})")
    slopes = ", ".join(f"c{i}_{k} AS b{i}" for i in range(k))
    line = " + ".join(f"b{i} * {c}" for i, c in enumerate(columns))
    means = " + ".join(f"b{i} * (SELECT AVG({c}) FROM fit)" for i, c in enumerate(columns))
    terms = " UNION ALL ".join(f"SELECT '{c}' AS term, b{i} AS value FROM b" for i, c in enumerate(columns))
    return f"""{", ".join(steps)}, b0 AS (SELECT {slopes} FROM e{k}),
b AS (SELECT b0.*, (SELECT AVG({target}) FROM fit) - ({means}) AS a FROM b0),
r AS (SELECT AVG(({target} - a - ({line})) ** 2) AS e, VAR_POP({target}) AS v FROM test, b)
{terms} UNION ALL SELECT 'intercept', a FROM b UNION ALL SELECT 'r2', 1 - e / v FROM r UNION ALL SELECT 'rmse', SQRT(e) FROM r"""


REGRESSED = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0) AS {c}" for c in [*S.REGRESSION_FEATURES, "missing_rate"])


@query(
    "linear_regression",
    f"""WITH {DRIVER_FEATURES}, rows_ AS (
  SELECT {REGRESSED}, MD5(CAST(driver_id AS VARCHAR))[1] IN ('0', '4', '8', 'c') AS held FROM df WHERE total_orders > 0),
fit AS (SELECT * FROM rows_ WHERE NOT held), test AS (SELECT * FROM rows_ WHERE held), {sql_regression(S.REGRESSION_FEATURES, "missing_rate")}""",
    "value",
)
def _(t):
    return S.linear_regression(features(t).where("total_orders > 0"))
