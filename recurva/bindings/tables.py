"""Views of the test tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recurva.operators.periods import formula_inputs, subscription_flags
from recurva.operators.series import daily_series
from recurva.sources.envelope import unite


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


NUDGE = 1e-9


def number(value: Column | str, digits: int = 4) -> Column:
    """A double rounded for comparison. The nudge, also in the SQL, settles ties the same way on both sides."""
    return F.round(F.col(value) + NUDGE if isinstance(value, str) else value + NUDGE, digits)


def day(value: Column | str) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


# --- subscriptions: one per customer and priority, the market segment as tenant; tenants use the same customer ids ----


def subscription_history(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("tenant_id"),
        F.floor(F.col("o_custkey") / 3).alias("customer_entity_id"),
        F.col("o_orderpriority").alias("subscription_id"),
        F.when(F.col("o_orderstatus") == "F", "canceled").otherwise("active").alias("status"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderkey").alias("sequence"),
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Subscription periods with all flags: the entities of the metrics."""
    return subscription_flags(subscription_history(spark, folder))


def metric_inputs(flags: DataFrame) -> DataFrame:
    return formula_inputs(flags)


SUBSCRIPTION_SQL = """
history AS (
  SELECT c_mktsegment AS tenant_id, o_custkey // 3 AS customer, o_orderpriority AS subscription,
         CASE WHEN o_orderstatus = 'F' THEN 'canceled' ELSE 'active' END AS status,
         o_totalprice AS amount, o_orderdate AS happened, o_orderkey AS sequence
  FROM orders JOIN customer ON o_custkey = c_custkey),
periods AS (
  SELECT tenant_id, customer, subscription, CAST(date_trunc('month', happened) AS DATE) AS period_date,
         arg_max(status, {'happened': happened, 'sequence': sequence}) AS status, CAST(sum(CAST(amount AS DECIMAL(32,6))) AS DOUBLE) AS mrr_amount,
         min(happened) AS created_at, max(CASE WHEN status = 'canceled' THEN happened END) AS canceled_at
  FROM history GROUP BY 1, 2, 3, 4),
started AS (
  SELECT *, CAST(CAST(mrr_amount AS DECIMAL(32,6)) - lag(CAST(mrr_amount AS DECIMAL(32,6))) OVER (PARTITION BY tenant_id, customer, subscription ORDER BY period_date) AS DOUBLE) AS delta,
         min(created_at) OVER (PARTITION BY tenant_id, customer, subscription) AS subscription_start,
         min(created_at) OVER (PARTITION BY tenant_id, customer) AS customer_start
  FROM periods),
subscriptions AS (
  SELECT *,
         subscription_start >= period_date AND subscription_start < period_date + INTERVAL 1 MONTH AS created_in_period,
         customer_start < period_date AS existing_customer,
         status = 'canceled' AND canceled_at >= period_date AND canceled_at < period_date + INTERVAL 1 MONTH
           AS canceled_in_period
  FROM started)
"""

METRICS_SQL = SUBSCRIPTION_SQL + """,
direct AS (
  SELECT tenant_id, period_date, count(*) AS entity_count,
         coalesce(CAST(sum(CAST(mrr_amount AS DECIMAL(32,6))) FILTER (status = 'active') AS DOUBLE), 0) AS mrr,
         coalesce(CAST(sum(CAST(mrr_amount AS DECIMAL(32,6))) FILTER (status = 'active' AND created_in_period) AS DOUBLE), 0) AS new_mrr,
         coalesce(CAST(sum(CAST(greatest(0, coalesce(delta, 0)) AS DECIMAL(32,6))) FILTER (status = 'active' AND existing_customer) AS DOUBLE), 0) AS expansion_mrr,
         abs(coalesce(CAST(sum(CAST(least(0, coalesce(delta, 0)) AS DECIMAL(32,6))) FILTER (status = 'active' AND existing_customer) AS DOUBLE), 0)) AS contraction_mrr,
         coalesce(CAST(sum(CAST(mrr_amount AS DECIMAL(32,6))) FILTER (status = 'canceled' AND canceled_in_period) AS DOUBLE), 0) AS churn_mrr,
         CAST(count(DISTINCT customer) FILTER (status = 'active') AS DOUBLE) AS active_customers
  FROM subscriptions GROUP BY 1, 2),
active AS (SELECT DISTINCT tenant_id, period_date, customer FROM subscriptions WHERE status = 'active'),
churn AS (
  SELECT b.tenant_id, CAST(b.period_date + INTERVAL 1 MONTH AS DATE) AS period_date,
         CAST(count(*) AS DOUBLE) AS active_customers_start,
         CAST(count(*) FILTER (n.customer IS NULL) AS DOUBLE) AS churned_customers
  FROM active b LEFT JOIN active n
    ON n.tenant_id = b.tenant_id AND n.customer = b.customer AND n.period_date = b.period_date + INTERVAL 1 MONTH
  GROUP BY 1, 2),
inputs AS (
  SELECT d.*, p.mrr AS mrr_previous, churned_customers, active_customers_start
  FROM direct d
  LEFT JOIN direct p ON p.tenant_id = d.tenant_id AND d.period_date = p.period_date + INTERVAL 1 MONTH
  LEFT JOIN churn c ON c.tenant_id = d.tenant_id AND c.period_date = d.period_date),
wide AS (
  SELECT *,
         coalesce((mrr + expansion_mrr - contraction_mrr - churn_mrr) / nullif(mrr_previous, 0) * 100, 0) AS nrr,
         coalesce(mrr / nullif(active_customers, 0), 0) AS arpu,
         coalesce((new_mrr + expansion_mrr) / nullif(contraction_mrr + churn_mrr, 0), 0) AS quick_ratio,
         coalesce(churned_customers / nullif(active_customers_start, 0) * 100, 0) AS logo_churn_rate
  FROM inputs),
registry(metric_id, name, category, unit, direction) AS (VALUES
  ('mrr', 'Monthly Recurring Revenue', 'revenue', 'currency', 'up_good'),
  ('new_mrr', 'New MRR', 'growth', 'currency', 'up_good'),
  ('expansion_mrr', 'Expansion MRR', 'growth', 'currency', 'up_good'),
  ('contraction_mrr', 'Contraction MRR', 'retention', 'currency', 'down_good'),
  ('churn_mrr', 'Churned MRR', 'retention', 'currency', 'down_good'),
  ('nrr', 'Net Revenue Retention', 'retention', 'percent', 'up_good'),
  ('active_customers', 'Active Customers', 'growth', 'count', 'up_good'),
  ('arpu', 'Average Revenue Per User', 'efficiency', 'currency', 'up_good'),
  ('quick_ratio', 'Quick Ratio', 'efficiency', 'ratio', 'up_good'),
  ('logo_churn_rate', 'Logo Churn Rate', 'retention', 'percent', 'down_good')),
metrics AS (
  SELECT tenant_id, period_date, entity_count, metric_id, value FROM wide
  UNPIVOT (value FOR metric_id IN (mrr, new_mrr, expansion_mrr, contraction_mrr, churn_mrr, nrr, active_customers,
                                   arpu, quick_ratio, logo_churn_rate))),
changes AS (
  SELECT *, value - previous_value AS change_absolute,
         (value - previous_value) / nullif(previous_value, 0) * 100 AS change_percent
  FROM (SELECT *, lag(value) OVER (PARTITION BY tenant_id, metric_id ORDER BY period_date) AS previous_value FROM metrics))
"""


# --- series: daily event values -------------------------------------------------------------------


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """One series per event type."""
    events = table(spark, folder, "events")
    return daily_series(events, F.col("event_type"), F.col("ts"), F.col("value"))


def user_series(spark: SparkSession, folder: str) -> DataFrame:
    """One series per user."""
    events = table(spark, folder, "events")
    return daily_series(events, F.col("user_id").cast("string"), F.col("ts"), F.col("value"))


def tenant_series(spark: SparkSession, folder: str) -> DataFrame:
    """One series per event type for every group of users."""
    events = table(spark, folder, "events").withColumn("tenant_id", F.col("user_id") % 50)
    return daily_series(events, F.col("event_type"), F.col("ts"), F.col("value"), ["tenant_id"])


def series_sql(metric: str) -> str:
    return f"""
daily AS (
  SELECT {metric} AS metric_id, CAST(ts AS DATE) AS period_date, sum(value) AS value FROM events GROUP BY 1, 2)
"""


STATISTICS_SQL = """
stepped AS (
  SELECT *, lag(value) OVER w AS before, count(value) OVER h AS history_count,
         avg(value) OVER t AS mean, stddev_pop(value) OVER t AS std, count(value) OVER t AS baseline_count,
         lead(period_date) OVER w IS NULL AS is_latest
  FROM daily
  WINDOW w AS (PARTITION BY metric_id ORDER BY period_date),
         h AS (PARTITION BY metric_id ORDER BY period_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         t AS (PARTITION BY metric_id ORDER BY period_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
changed AS (
  SELECT *, (value - before) / nullif(abs(before), 0) AS change,
         CASE WHEN history_count >= 2 THEN before END AS previous FROM stepped),
points AS (
  SELECT *, count(change) OVER h AS change_count, avg(change) OVER h AS mean_change, stddev_pop(change) OVER h AS std_change
  FROM changed
  WINDOW h AS (PARTITION BY metric_id ORDER BY period_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (
  SELECT *, (value - mean) / nullif(std, 0) AS z, (change - mean_change) / nullif(std_change, 0) AS z_change FROM points),
hits AS (
  SELECT metric_id, period_date, is_latest, 'z_score' AS detection_method, least(1.0, abs(z) / 5.0) AS severity, z AS deviation,
         mean AS baseline_value, value AS actual_value, CASE WHEN z > 0 THEN 'above' ELSE 'below' END AS direction
  FROM judged WHERE history_count >= 7 AND abs(z) >= 2.5
  UNION ALL
  SELECT metric_id, period_date, is_latest, 'rate_of_change', least(1.0, abs(change) / 0.5), change, previous, value, 'unknown'
  FROM judged WHERE previous IS NOT NULL AND change_count < 7 AND abs(change) > 0.15
  UNION ALL
  SELECT metric_id, period_date, is_latest, 'rate_of_change', least(1.0, abs(z_change) / 4.0), z_change, previous, value, 'unknown'
  FROM judged WHERE previous IS NOT NULL AND change_count >= 7 AND abs(z_change) >= 2.0)
"""


def forest_sql(points: str = "points", contamination: float = 0.05, trees: int = 100) -> str:
    """The forest over the rows `(name, place, feature, value, n)`: `isolated(name, score, is_outlier)` judges the last place of each name.

    Trees grow level by level. A row per tree, place and feature sees the bounds of its node; the feature with the largest draw
    among those that vary is cut where the node's own draw says.
    """
    def draw(feature: str) -> str:
        return f"CAST('0x' || substr(md5(concat(name, '|', tree, '|', node, '|', {feature})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"

    def path(size: str) -> str:
        return f"CASE WHEN {size} > 2 THEN 2.0 * (ln({size} - 1.0) + 0.5772156649015329) - 2.0 * ({size} - 1.0) / {size} WHEN {size} = 2 THEN 1.0 ELSE 0.0 END::DOUBLE"

    return f"""
walk(name, tree, place, n, node, depth, level, is_open) AS (
  SELECT DISTINCT name, CAST(t AS BIGINT), place, n, CAST(1 AS BIGINT), 0, 0, true FROM {points}, range({trees}) r(t)
  UNION ALL
  SELECT name, tree, place, n, CASE WHEN is_open AND high > low THEN node * 2 + CAST(value > low + {draw("''")} * (high - low) AS BIGINT) ELSE node END,
         depth + CAST(is_open AND high > low AS INTEGER), level + 1, is_open AND high > low
  FROM (
    SELECT *, row_number() OVER (PARTITION BY name, tree, place ORDER BY high > low DESC, {draw("feature")} DESC) AS choice FROM (
      SELECT w.*, p.feature, p.value, min(p.value) OVER node_feature AS low, max(p.value) OVER node_feature AS high
      FROM walk w JOIN {points} p ON p.name = w.name AND p.place = w.place WHERE w.level < ceil(log2(greatest(w.n, 2)))
      WINDOW node_feature AS (PARTITION BY w.name, w.tree, w.node, p.feature)))
  WHERE choice = 1),
leaves AS (SELECT *, count(*) OVER (PARTITION BY name, tree, node) AS size FROM walk WHERE level = ceil(log2(greatest(n, 2)))),
scores AS (SELECT name, place, any_value(n) AS n, -pow(2.0, -round(avg(depth + {path("size")}), 9) / greatest({path("any_value(n)")}, 1e-9)) AS score FROM leaves GROUP BY 1, 2),
isolated AS (
  SELECT name, max(score) FILTER (place = n) AS score, max(score) FILTER (place = n) < quantile_cont(score, {contamination}) AS is_outlier FROM scores GROUP BY 1)"""


# --- records: customers, suppliers and parts as three sources ------------------------------------


def _record(rows: DataFrame, source: str, letter: str, key: str, domain: Column, user: Column, odd: Column, days: Column,
            amount: str, seats: Column) -> DataFrame:
    word = F.floor(domain / 2) + F.when(odd, 1_000_000).otherwise(0)
    return rows.select(
        F.lit(source).alias("source_type"),
        F.concat(F.lit(letter), F.col(key).cast("string")).alias("record_id"),
        F.struct(
            F.format_string("u%d@d%d.com", user, domain).alias("email"),
            F.concat(F.substr(F.md5(F.concat(F.lit("n"), word.cast("string"))), F.lit(1), F.lit(12)), F.lit(" Inc")).alias("company_name"),
            F.concat(F.lit("+1 (555) "), F.lpad(F.col(key).cast("string"), 7, "0")).alias("phone"),
            F.date_add(F.lit("2020-01-01").cast("date"), days.cast("int")).cast("string").alias("created_at"),
            F.col(amount).alias("mrr"),
            seats.cast("long").alias("seats"),
        ).alias("data"),
    )


def stripe_records(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return _record(table(spark, folder, "customer"), "stripe", "c", "c_custkey", F.floor(k / 2), k % 4, k % 5 == 0, k % 9,
                   "c_acctbal", F.lit(None))


def postgres_records(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _record(table(spark, folder, "supplier"), "postgres", "s", "s_suppkey", k * 7, (k * 14) % 4, k % 5 == 0,
                   (k * 14) % 9 + 1, "s_acctbal", k % 50)


def csv_records(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return _record(table(spark, folder, "part"), "csv", "p", "p_partkey", F.floor(k / 2), k % 4, k % 7 == 0, k % 11,
                   "p_retailprice", F.when(k % 3 != 0, k % 20))


def records(spark: SparkSession, folder: str) -> DataFrame:
    return unite(stripe_records(spark, folder), postgres_records(spark, folder), csv_records(spark, folder))


def _renamed(rows: DataFrame, names: dict[str, str], key: str) -> DataFrame:
    """Records with other field names, without the fields not named, and with a status."""
    number_ = F.substr("record_id", F.lit(2)).cast("long")
    status = F.when(number_ % 3 == 0, "canceled").otherwise("active").alias(key)
    return rows.withColumn("data", F.struct(*[F.col(f"data.{old}").alias(new) for old, new in names.items()], status))


def mixed_records(spark: SparkSession, folder: str, amounts: tuple[str, str, str] = ("mrr", "mrr", "mrr")) -> list[DataFrame]:
    """The three sources as their own systems would deliver them: hardly a field has the same name in two."""
    first, second, third = amounts
    return [
        _renamed(stripe_records(spark, folder), {"email": "email", "company_name": "company_name", "created_at": "created_at", "mrr": first}, "status"),
        _renamed(postgres_records(spark, folder), {"email": "email_address", "company_name": "company", "phone": "phone_number",
                                                   "created_at": "created_at", "mrr": second, "seats": "seats"}, "status"),
        _renamed(csv_records(spark, folder), {"email": "contact_email", "company_name": "name", "phone": "tel", "created_at": "signup_date", "mrr": third}, "status"),
    ]


def _record_sql(rows: str, source: str, letter: str, key: str, domain: str, user: str, odd: str, days: str, amount: str,
                seats: str) -> str:
    return f"""
  SELECT '{source}' AS source_type, '{letter}' || {key} AS record_id, CAST({domain} AS BIGINT) AS domain_no,
         'u' || ({user}) || '@d' || CAST({domain} AS BIGINT) || '.com' AS email,
         substr(md5('n' || (CAST({domain} AS BIGINT) // 2 + CASE WHEN {odd} THEN 1000000 ELSE 0 END)), 1, 12) || ' Inc' AS company_name,
         '+1 (555) ' || lpad(CAST({key} AS VARCHAR), 7, '0') AS phone,
         CAST(DATE '2020-01-01' + CAST({days} AS INTEGER) AS VARCHAR) AS created_at,
         {amount} AS mrr, CAST({seats} AS BIGINT) AS seats, CASE WHEN {key} % 3 = 0 THEN 'canceled' ELSE 'active' END AS status
  FROM {rows}"""


RECORDS_SQL = "records AS (" + "\n  UNION ALL".join((
    _record_sql("customer", "stripe", "c", "c_custkey", "c_custkey // 2", "c_custkey % 4", "c_custkey % 5 = 0",
                "c_custkey % 9", "c_acctbal", "NULL"),
    _record_sql("supplier", "postgres", "s", "s_suppkey", "s_suppkey * 7", "(s_suppkey * 14) % 4", "s_suppkey % 5 = 0",
                "(s_suppkey * 14) % 9 + 1", "s_acctbal", "s_suppkey % 50"),
    _record_sql("part", "csv", "p", "p_partkey", "p_partkey // 2", "p_partkey % 4", "p_partkey % 7 = 0",
                "p_partkey % 11", "p_retailprice", "CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 20 END"),
)) + ")"

# Names that differ share less than half of their letters here, so only equal names score.
MATCHES_SQL = RECORDS_SQL + """,
sides AS (
  SELECT a.source_type AS a_source, a.record_id AS a_id, b.source_type AS b_source, b.record_id AS b_id,
         a.source_type || ':' || a.record_id AS a_node, b.source_type || ':' || b.record_id AS b_node,
         CASE WHEN a.email = b.email THEN 1.0 ELSE 0.8 END AS email_score,
         CASE WHEN a.company_name = b.company_name THEN 1.0 ELSE 0.0 END AS name_score,
         abs(date_diff('day', CAST(b.created_at AS DATE), CAST(a.created_at AS DATE))) AS days,
         abs(a.mrr - b.mrr) / nullif(greatest(abs(a.mrr), abs(b.mrr)), 0) AS gap, a.mrr AS a_mrr, b.mrr AS b_mrr
  FROM records a JOIN records b ON a.domain_no = b.domain_no AND a.source_type < b.source_type),
scored AS (
  SELECT *, CASE WHEN days <= 3 THEN 1.0 - days / 4.0 ELSE 0.0 END AS temporal_score,
         CASE WHEN a_mrr = 0 AND b_mrr = 0 THEN 0.5 WHEN gap <= 0.05 THEN 1.0 WHEN gap <= 0.10 THEN 0.7 ELSE 0.0 END
           AS amount_score FROM sides),
matches AS (
  SELECT * FROM (SELECT *, round(CAST(email_score AS DOUBLE) * 0.35 + name_score * 0.25 + temporal_score * 0.10
                                 + amount_score * 0.10, 4) AS total_score FROM scored)
  WHERE total_score >= 0.5),
edges AS (SELECT a_node AS u, b_node AS v FROM matches UNION ALL SELECT b_node, a_node FROM matches),
reach AS (SELECT u AS node, u AS label FROM edges UNION SELECT e.v, r.label FROM reach r JOIN edges e ON e.u = r.node),
components AS (SELECT node, min(label) AS cluster_id FROM reach GROUP BY 1),
confidence AS (
  SELECT cluster_id, max(total_score) AS max_confidence, avg(total_score) AS avg_confidence, count(*) AS pairs
  FROM matches JOIN components ON node = a_node GROUP BY 1),
members AS (
  SELECT cluster_id, r.* FROM records r JOIN components ON node = source_type || ':' || record_id)
"""
