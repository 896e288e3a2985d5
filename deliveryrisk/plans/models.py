"""Model and streaming queries M-0 to M-19, SS-1 and SS-2."""

from pyspark.sql import functions as F

from deliveryrisk.functions.materialize import materialize
from deliveryrisk.models import kmeans as K
from deliveryrisk.models import monitor as M
from deliveryrisk.models.dbscan import DBSCAN, cluster_info
from deliveryrisk.models.iforest import IsolationForest
from deliveryrisk.models.lof import LocalOutlierFactor
from deliveryrisk.models.prep import MONITORED_COLUMNS as MONITORED
from deliveryrisk.models.prep import ORDER_MODEL_COLUMNS as COLUMNS
from deliveryrisk.models.prep import Scaler, fraud_dataset
from deliveryrisk.models.windows import expanding_window_training
from deliveryrisk.operators import customers as C
from deliveryrisk.operators import drift as DR
from deliveryrisk.operators import drivers as D
from deliveryrisk.plans.features import ORDER_FEATURES
from deliveryrisk.plans.registry import query
from deliveryrisk.plans.sqlparts import CUSTOMER_FEATURES, DRIVER_FEATURES, PERIOD_CUT
from deliveryrisk.sources.canonical import SCHEMAS
from deliveryrisk.streaming import jobs

ENTITY_COLUMNS = ["missing_rate", "pct_orders_with_missing", "total_orders", "total_spent"]


def order_data(t):
    """One row per order with the model columns."""
    return materialize(fraud_dataset(t.orders, t.drivers, t.customers))


def customer_data(t):
    return materialize(C.customer_features(t.customers, t.orders))


def driver_data(t):
    return materialize(D.driver_features(t.drivers, t.orders))


def ensemble(df, columns, key):
    scaler = Scaler.fit(df, columns)
    forest = IsolationForest.fit(df, columns, key, scaler=scaler)
    return forest, M.ensemble_outlier(
        {
            "isolation_forest": forest.predict(df, key),
            "lof": LocalOutlierFactor(columns).fit_predict(df, key, scaler),
        }
    )


@query(
    "fraud_dataset",
    f"""WITH {ORDER_FEATURES}, {DRIVER_FEATURES}, {CUSTOMER_FEATURES}
SELECT of.*, delivery_hour AS hour, {PERIOD_CUT} AS period, CAST(EXTRACT(ISODOW FROM order_date) - 1 AS INTEGER) AS day_of_week_num,
  STRFTIME(order_date, '%B') AS month_name, CAST(EXTRACT(DAY FROM order_date) AS INTEGER) AS day_of_month,
  EXTRACT(DAY FROM order_date) <= 7 AS is_month_start, EXTRACT(DAY FROM order_date) >= 24 AS is_month_end,
  CAST(EXTRACT(QUARTER FROM order_date) AS INTEGER) AS quarter, df.age AS driver_age, df.trips,
  df.missing_rate AS driver_missing_rate, df.total_orders AS driver_total_orders,
  df.pct_orders_with_missing AS driver_pct_orders_with_missing, df.experience_level, cf.customer_age,
  cf.total_orders AS customer_total_orders, cf.missing_rate AS customer_missing_rate,
  cf.pct_orders_with_missing AS customer_pct_orders_with_missing, cf.customer_segment,
  CAST(has_missing AS INTEGER) AS is_fraud_candidate
FROM of LEFT JOIN df USING (driver_id) LEFT JOIN cf USING (customer_id)""",
    "order_amount missing_rate driver_missing_rate driver_pct_orders_with_missing customer_missing_rate "
    "customer_pct_orders_with_missing",
)
def _(t):
    return fraud_dataset(t.orders, t.drivers, t.customers)


@query(
    "preprocess",
    f"""WITH {CUSTOMER_FEATURES} SELECT customer_id, """
    + ", ".join(
        f"({c} - (SELECT AVG({c}) FROM cf)) / (SELECT STDDEV_POP({c}) FROM cf) AS {c}" for c in ENTITY_COLUMNS
    )
    + " FROM cf",
    " ".join(ENTITY_COLUMNS),
)
def _(t):
    df = customer_data(t)
    scaler = Scaler.fit(df, ENTITY_COLUMNS)
    return df.select("customer_id", *[scaler.standardized(c).alias(c) for c in ENTITY_COLUMNS])


@query("isolation_forest")
def _(t):
    df = order_data(t)
    return IsolationForest.fit(df, COLUMNS, "order_id").risk_scores(df, "order_id")


def standard_sql(columns):
    """z: id and the array v of standardised columns of the frame f."""
    parts = ", ".join(
        f"(COALESCE({c}, (SELECT MEDIAN({c}) FROM f)) - (SELECT AVG({c}) FROM f)) / (SELECT COALESCE(NULLIF(STDDEV_POP({c}), 0), 1.0) FROM f)"
        for c in columns
    )
    return f"z AS (SELECT id, [{parts}] AS v FROM f)"


# From z: distances of all pairs of rows, the 20 nearest (equal rows first, then by the smallest id of a point's copies).
LOF_SQL = """p AS MATERIALIZED (SELECT id, v, MIN(id) OVER (PARTITION BY v) AS pid FROM z),
near AS MATERIALIZED (
  SELECT id, nid, dist FROM (
    SELECT a.id, b.id AS nid, LIST_DISTANCE(a.v, b.v) AS dist,
           ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY LIST_DISTANCE(a.v, b.v), b.pid, b.id) AS rn
    FROM p a JOIN p b ON a.id <> b.id) WHERE rn <= 20),
reach AS (SELECT id, MAX(dist) AS k_dist FROM near GROUP BY id),
dense AS (
  SELECT near.id, 1.0 / (AVG(GREATEST(dist, k_dist)) + 1e-10) AS lrd FROM near JOIN reach ON reach.id = near.nid GROUP BY near.id),
lof AS (
  SELECT near.id, -AVG(other.lrd) / MAX(own.lrd) AS score
  FROM near JOIN dense own ON own.id = near.id JOIN dense other ON other.id = near.nid GROUP BY near.id)
SELECT id, score, CAST(CASE WHEN score < (SELECT QUANTILE_CONT(score, 0.1) FROM lof) THEN -1 ELSE 1 END AS INTEGER) AS prediction
FROM lof"""

# From z: pairs within 0.5, cores with ten of them, the smallest core reached through cores.
DBSCAN_SQL = """near AS MATERIALIZED (
  SELECT a.id, b.id AS nid FROM z a JOIN z b ON ABS(a.v[1] - b.v[1]) <= 0.5 AND LIST_DISTANCE(a.v, b.v) <= 0.5),
core AS MATERIALIZED (SELECT id FROM near GROUP BY id HAVING COUNT(*) >= 10),
link AS MATERIALIZED (SELECT near.id, nid FROM near SEMI JOIN core ON core.id = near.id SEMI JOIN core c ON c.id = near.nid),
reached AS (SELECT id, id AS label FROM core UNION SELECT link.nid, reached.label FROM reached JOIN link ON link.id = reached.id),
label AS MATERIALIZED (SELECT id, MIN(label) AS label FROM reached GROUP BY id),
touched AS (SELECT near.id, MIN(label.label) AS label FROM near JOIN label ON label.id = near.nid GROUP BY near.id),
done AS (
  SELECT z.id, CASE WHEN label.id IS NOT NULL THEN 'core' WHEN touched.id IS NOT NULL THEN 'border' ELSE 'noise' END AS role,
         COALESCE(label.label, touched.label, -1) AS cluster
  FROM z LEFT JOIN label ON label.id = z.id LEFT JOIN touched ON touched.id = z.id)"""

CUSTOMER_ROWS = f"WITH RECURSIVE {CUSTOMER_FEATURES}, f AS (SELECT customer_id AS id, {', '.join(ENTITY_COLUMNS)} FROM cf)"


@query("local_outlier_factor", f"{CUSTOMER_ROWS}, {standard_sql(ENTITY_COLUMNS)}, {LOF_SQL}", "score")
def _(t):
    return LocalOutlierFactor(ENTITY_COLUMNS).fit_predict(customer_data(t), "customer_id")


@query(
    "local_outlier_factor_embeddings",
    f"""WITH RECURSIVE e AS (
  SELECT vec_id AS id, UNNEST(embedding)::DOUBLE AS x, GENERATE_SUBSCRIPTS(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, AVG(x) AS m, STDDEV_POP(x) AS d FROM e GROUP BY i),
z AS (SELECT id, LIST((x - m) / d ORDER BY i) AS v FROM e JOIN s USING (i) GROUP BY id), {LOF_SQL}""",
    "score",
)
def _(t):
    wide = t.raw("embeddings").select("vec_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    return LocalOutlierFactor([f"e{i}" for i in range(64)]).fit_predict(wide, "vec_id")


@query("ensemble_outlier")
def _(t):
    _forest, out = ensemble(customer_data(t), ENTITY_COLUMNS, "customer_id")
    return out


@query("kmeans")
def _(t):
    df = customer_data(t)
    clustered = K.FraudKMeans.fit(df, ENTITY_COLUMNS, 5).transform(df)
    return clustered.select("customer_id", "cluster", "cluster_distance")


@query("kmeans_find_k")
def _(t):
    return K.find_k(customer_data(t), ENTITY_COLUMNS)


@query("cluster_statistics")
def _(t):
    df = driver_data(t)
    columns = ["missing_rate", "pct_orders_with_missing", "total_items_missing", "total_orders"]
    clustered = K.FraudKMeans.fit(df, columns, 4).transform(df)
    return K.cluster_statistics(clustered, columns)


@query(
    "driver_clusters",
    """SELECT COUNT(DISTINCT driver_id) AS drivers, CAST(SUM(items_missing) AS BIGINT) AS items_missing, TRUE AS ordered,
  TRUE AS apart FROM drv LEFT JOIN ord USING (driver_id)""",
)
def _(t):
    """Totals over the clusters, whether they rise by missing rate, and whether the silhouette is positive."""
    found = K.cluster_drivers(driver_data(t), n_init=3)
    rates = F.array_sort(F.collect_list(F.struct("cluster", "missing_rate")))["missing_rate"]
    return found.stats.agg(
        F.sum("drivers").alias("drivers"),
        F.sum("total_items_missing").alias("items_missing"),
        (rates == F.array_sort(rates)).alias("ordered"),
        F.lit(found.silhouette > 0).alias("apart"),
    )


@query("driver_cluster_importance")
def _(t):
    return K.cluster_drivers(driver_data(t), n_init=3).importance


@query("dbscan", f"{CUSTOMER_ROWS}, {standard_sql(ENTITY_COLUMNS)}, {DBSCAN_SQL} SELECT * FROM done")
def _(t):
    return DBSCAN(ENTITY_COLUMNS).fit_predict(customer_data(t), "customer_id")


@query("dbscan_info")
def _(t):
    return cluster_info(DBSCAN(COLUMNS).fit_predict(order_data(t), "order_id"))


@query("score_orders")
def _(t):
    df = order_data(t)
    _forest, out = ensemble(df, COLUMNS, "order_id")
    clustered = K.FraudKMeans.fit(df, COLUMNS, 5).transform(df)
    return M.score_orders(df, out, clustered)


@query("predict_voting")
def _(t):
    df = customer_data(t)
    _forest, out = ensemble(df, ENTITY_COLUMNS, "customer_id")
    clustered = K.FraudKMeans.fit(df, ENTITY_COLUMNS, 5).transform(df).select(F.col("customer_id").alias("id"), "cluster")
    joined = out.select("id", "isolation_forest", F.col("prediction").alias("ensemble")).join(clustered, "id")
    return M.vote(joined, ["isolation_forest", "cluster", "ensemble"])


@query("predict_with_details")
def _(t):
    df = customer_data(t)
    _forest, out = ensemble(df, ENTITY_COLUMNS, "customer_id")
    clustered = K.FraudKMeans.fit(df, ENTITY_COLUMNS, 5).transform(df)
    return M.predict_with_details(out, clustered, "customer_id")


def flags(t):
    df = order_data(t)
    scaler = Scaler.fit(df, COLUMNS)
    forest = IsolationForest.fit(df, COLUMNS, "order_id", scaler=scaler).predict(df, "order_id")
    lof = LocalOutlierFactor(COLUMNS).fit_predict(df, "order_id", scaler)
    noise = DBSCAN(COLUMNS).fit_predict(df, "order_id", scaler)

    def flag(part, column, value, name):
        return part.select(F.col("id").alias("order_id"), (F.col(column) == value).alias(name))

    return materialize(
        df.join(flag(forest, "prediction", -1, "isolation_forest"), "order_id")
        .join(flag(lof, "prediction", -1, "lof"), "order_id")
        .join(flag(noise, "cluster", -1, "dbscan_noise"), "order_id")
    )


METHODS = ["isolation_forest", "lof", "dbscan_noise"]


@query("consensus")
def _(t):
    return M.consensus_summary(M.consensus(flags(t), METHODS))


@query("method_comparison")
def _(t):
    return M.method_comparison(flags(t), METHODS)


@query("feature_importance")
def _(t):
    rows = flags(t)
    return M.feature_importance(rows, COLUMNS, [*METHODS, "has_missing"], K.FraudKMeans.fit(rows, COLUMNS, 5))


def scored_orders(t):
    df = order_data(t)
    model = IsolationForest.fit(df, COLUMNS, "order_id")
    predicted = model.predict(df, "order_id").withColumnRenamed("id", "order_id")
    return df.join(predicted, "order_id")


@query("monthly_model_metrics")
def _(t):
    return M.monthly_model_metrics(scored_orders(t))


@query("retraining_triggers")
def _(t):
    monthly = materialize(M.monthly_model_metrics(scored_orders(t)))
    return M.retraining_triggers(DR.drift_by_halves(t.orders), monthly)


@query("expanding_window_training")
def _(t):
    return expanding_window_training(order_data(t), MONITORED, "order_id")


@query("champion_challenger")
def _(t):
    df = order_data(t)
    split = F.lit("1998-06-30").cast("date")
    champion = IsolationForest.fit(df.where(F.col("order_date") <= split), COLUMNS, "order_id", seed=1)
    challenger = IsolationForest.fit(df, COLUMNS, "order_id", seed=2)
    return M.champion_challenger(champion, challenger, df.where(F.col("order_date") > split), "order_id")


@query("model_health")
def _(t):
    monthly = materialize(M.monthly_model_metrics(scored_orders(t)))
    training = expanding_window_training(order_data(t), MONITORED, "order_id")
    return M.model_health(monthly, DR.drift_by_halves(t.orders), training)


@query("save_load_model", "SELECT COUNT(*) AS rows_scored, 0 AS changed_rows FROM ord")
def _(t):
    df = order_data(t)
    model = IsolationForest.fit(df, COLUMNS, "order_id")
    path = jobs.new_folder(t.spark)
    model.save(t.spark, path)
    again = IsolationForest.load(t.spark, path)
    a = model.predict(df, "order_id")
    b = again.predict(df, "order_id").select("id", F.col("score").alias("_score"), F.col("prediction").alias("_p"))
    changed = (F.col("score") != F.col("_score")) | (F.col("prediction") != F.col("_p"))
    return a.join(b, "id").agg(
        F.count(F.lit(1)).alias("rows_scored"), F.count(F.when(changed, 1)).cast("int").alias("changed_rows")
    )


def event_stream(t):
    stream = jobs.read_stream(t.spark, t.path, SCHEMAS["events"], "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_hourly_watchtower",
    """WITH w AS (SELECT DATE_TRUNC('hour', ts) AS window_start, COUNT(*) AS events,
  COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS bad_events,
  COUNT(CASE WHEN event_type = 'error' THEN 1 END) * 100.0 / COUNT(*) AS bad_rate FROM events GROUP BY 1),
b AS (SELECT AVG(bad_rate) + 2 * STDDEV_SAMP(bad_rate) AS upper_threshold FROM w)
SELECT CAST(window_start AS TIMESTAMP) AS window_start, events, bad_events, bad_rate, upper_threshold,
  bad_rate > upper_threshold AS is_anomaly FROM w, b
WHERE window_start + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 2 HOUR""",
    "bad_rate upper_threshold",
)
def _(t):
    batch = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    watch = jobs.hourly_watchtower_stream(event_stream(t), jobs.rate_baseline(batch))
    folder = jobs.new_folder(t.spark)
    jobs.drain(watch, f"{folder}/out", f"{folder}/state")
    schema = (
        "window_start timestamp, events bigint, bad_events bigint, bad_rate double, upper_threshold double, "
        "is_anomaly boolean"
    )
    done = t.spark.read.schema(schema).parquet(f"{folder}/out")
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_upsert_orders",
    """SELECT user_id AS order_id, value AS order_amount, event_type AS status, event_id AS change_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "order_amount",
)
def _(t):
    # time first, then the whole event number; a struct compares field by field
    version = F.struct(F.unix_micros("ts").alias("at"), "event_id")
    changes = event_stream(t).select(
        F.col("user_id").alias("order_id"),
        F.col("value").alias("order_amount"),
        F.col("event_type").alias("status"),
        F.col("event_id").alias("change_id"),
        version.alias("version"),
        "ts",
    )
    schema = "order_id bigint, order_amount double, status string, change_id bigint, version struct<at: bigint, event_id: bigint>"
    latest = jobs.LatestOrders(t.spark, jobs.new_folder(t.spark), schema)
    return latest.run(changes).drop("version")
