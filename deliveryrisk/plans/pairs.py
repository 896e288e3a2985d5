"""Pair queries X-1 to X-6."""

from deliveryrisk.operators import pairs as P
from deliveryrisk.plans.registry import query
from deliveryrisk.plans.sqlparts import PAIRS


def pairs(t):
    return P.pair_interactions(t.orders)


@query("pair_interactions", f"WITH {PAIRS} SELECT * FROM pr", "missing_rate")
def _(t):
    return pairs(t)


@query(
    "suspicious_pairs",
    f"""WITH {PAIRS}
SELECT pr.*, d.driver_name, c.customer_name FROM pr LEFT JOIN drv d USING (driver_id) LEFT JOIN cus c USING (customer_id)
WHERE interactions > (SELECT AVG(interactions) FROM pr) AND missing_rate > (SELECT AVG(missing_rate) FROM pr) * 1.5""",
    "missing_rate",
)
def _(t):
    return P.suspicious_pairs(pairs(t), t.drivers, t.customers)


@query(
    "driver_customer_pairs",
    """SELECT o.driver_id, d.driver_name, o.customer_id, c.customer_name, COUNT(*) AS shared_orders,
  COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing,
  CAST(SUM(items_missing) AS BIGINT) AS total_items_missing, ROUND(SUM(order_amount), 2) AS total_order_value,
  ROUND(COUNT(CASE WHEN items_missing > 0 THEN 1 END) / CAST(COUNT(*) AS DOUBLE) * 100.0, 2) AS missing_order_rate_pct
FROM ord o JOIN drv d USING (driver_id) JOIN cus c USING (customer_id)
GROUP BY o.driver_id, d.driver_name, o.customer_id, c.customer_name HAVING COUNT(*) >= 2""",
    "total_order_value missing_order_rate_pct",
)
def _(t):
    return P.driver_customer_pairs(t.orders, t.drivers, t.customers)


for _name, _n, _rate in (("collusion_indicators", 3, 50), ("collusion_indicators_2_40", 2, 40)):

    @query(
        _name,
        f"""WITH {PAIRS}
SELECT CAST(driver_id AS VARCHAR) || '_' || CAST(customer_id AS VARCHAR) AS entity_id, driver_id, customer_id,
  interactions, items_missing, missing_rate, LEAST(missing_rate, 100.0) AS score
FROM pr WHERE interactions >= {_n} AND missing_rate >= {_rate}""",
        "missing_rate score",
    )
    def _(t, n=_n, rate=_rate):
        return P.collusion_indicators(pairs(t), n, float(rate))


@query(
    "pair_heatmap",
    f"""WITH {PAIRS},
td AS (SELECT driver_id FROM pr GROUP BY driver_id ORDER BY SUM(interactions) DESC, driver_id LIMIT 15),
tc AS (SELECT customer_id FROM pr GROUP BY customer_id ORDER BY SUM(interactions) DESC, customer_id LIMIT 15)
SELECT driver_id, customer_id, interactions, missing_rate FROM pr
WHERE driver_id IN (SELECT driver_id FROM td) AND customer_id IN (SELECT customer_id FROM tc)""",
    "missing_rate",
)
def _(t):
    return P.pair_heatmap(pairs(t))


@query(
    "interaction_distribution",
    f"""WITH {PAIRS}, k AS (SELECT interactions, COUNT(*) AS pairs FROM pr GROUP BY interactions)
SELECT interactions, pairs, pairs * 100.0 / (SELECT SUM(pairs) FROM k) AS pct_of_pairs,
  CAST(SUM(pairs) OVER (ORDER BY interactions DESC) AS BIGINT) AS pairs_at_least FROM k""",
    "pct_of_pairs",
)
def _(t):
    return P.interaction_distribution(pairs(t))
