"""Time-series rules and the isolation forest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recurva.bindings.metrics import with_lag
from recurva.bindings.tables import (
    METRICS_SQL, STATISTICS_SQL, day, event_series, forest_sql, number, series_sql, table, tenant_series, user_series,
)
from recurva.functions.labels import joint_metric_id
from recurva.operators import forest, series
from recurva.plans.detect import detect_anomalies

QUERIES, ORACLES = {}, {}

EVENTS = series_sql("event_type")
USERS = series_sql("CAST(user_id AS VARCHAR)")
_HIT_SQL = """SELECT metric_id, CAST(period_date AS VARCHAR) AS period, detection_method, round(severity + 1e-9, 4) AS severity,
       round(deviation + 1e-9, 4) AS deviation, round(baseline_value + 1e-9, 4) AS baseline_value, round(actual_value + 1e-9, 4) AS actual_value, direction
FROM hits"""


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


def _shown(hits, *more):
    return hits.select(*more, "metric_id", day("period_date").alias("period"), "detection_method",
                       *[number(c).alias(c) for c in ("severity", "deviation", "baseline_value", "actual_value")], "direction")


@query("w1_trailing_zscore", f"""WITH {EVENTS}, {STATISTICS_SQL}
SELECT metric_id, CAST(period_date AS VARCHAR) AS period, round(value + 1e-9, 4) AS value, round(mean + 1e-9, 4) AS mean, round(std + 1e-9, 4) AS std,
       CAST(baseline_count AS BIGINT) AS baseline_count, round(CASE WHEN history_count >= 7 THEN z END + 1e-9, 4) AS z_score,
       coalesce(history_count >= 7 AND abs(z) >= 2.5, false) AS is_hit FROM judged""")
def w1(spark, folder):
    points = series.series_statistics(event_series(spark, folder))
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    return points.select(
        "metric_id", day("period_date").alias("period"), number("value").alias("value"), number("mean").alias("mean"),
        number("std").alias("std"), "baseline_count",
        number(F.when(F.col("history_count") >= series.MIN_HISTORY, z)).alias("z_score"),
        series.zscore_hit().isNotNull().alias("is_hit"))


@query("w2_previous_value", f"""WITH {EVENTS}, {STATISTICS_SQL}
SELECT metric_id, CAST(period_date AS VARCHAR) AS period, round(previous + 1e-9, 4) AS previous FROM judged""")
def w2(spark, folder):
    points = series.series_statistics(event_series(spark, folder))
    return points.select("metric_id", day("period_date").alias("period"), number("previous").alias("previous"))


@query("w3_relative_changes", f"""WITH {USERS}, {STATISTICS_SQL}
SELECT metric_id, CAST(period_date AS VARCHAR) AS period, round(change + 1e-9, 4) AS change, CAST(change_count AS BIGINT) AS change_count FROM judged""")
def w3(spark, folder):
    points = series.series_statistics(user_series(spark, folder))
    return points.select("metric_id", day("period_date").alias("period"), number("change").alias("change"), "change_count")


@query("w4_short_history_change", f"""WITH {USERS}, {STATISTICS_SQL} {_HIT_SQL} JOIN (
  SELECT metric_id, period_date FROM judged WHERE change_count < 7) USING (metric_id, period_date) WHERE detection_method = 'rate_of_change'""")
def w4(spark, folder):
    points = series.series_statistics(user_series(spark, folder))
    hits = points.select("metric_id", "period_date", F.inline(F.array_compact(F.array(series.short_change_hit()))))
    return _shown(hits)


@query("w5_change_zscore", f"""WITH {USERS}, {STATISTICS_SQL} {_HIT_SQL} JOIN (
  SELECT metric_id, period_date FROM judged WHERE change_count >= 7) USING (metric_id, period_date) WHERE detection_method = 'rate_of_change'""")
def w5(spark, folder):
    points = series.series_statistics(user_series(spark, folder))
    hits = points.select("metric_id", "period_date", F.inline(F.array_compact(F.array(series.change_zscore_hit()))))
    return _shown(hits)


@query("w6_change_threshold", f"""WITH {METRICS_SQL}
SELECT tenant_id, metric_id, CAST(period_date AS VARCHAR) AS period, 'change_threshold' AS detection_method,
       round(least(1.0, abs(change_percent) / 50), 4) AS severity, round(value + 1e-9, 4) AS actual_value,
       round(change_percent + 1e-9, 4) AS change_percent, CASE WHEN change_percent > 0 THEN 'increase' ELSE 'decrease' END AS direction
FROM changes WHERE abs(change_percent) > 15""")
def w6(spark, folder):
    hits = series.change_threshold(with_lag(spark, folder))
    return hits.select("tenant_id", "metric_id", day("period_date").alias("period"), "detection_method",
                       *[number(c).alias(c) for c in ("severity", "actual_value", "change_percent")], "direction")


@query("w7_all_rules", f"WITH {USERS}, {STATISTICS_SQL} {_HIT_SQL}")
def w7(spark, folder):
    return _shown(series.detect_series(user_series(spark, folder)))


@query("w7_newest_points", f"WITH {USERS}, {STATISTICS_SQL} {_HIT_SQL} WHERE is_latest")
def w7_newest(spark, folder):
    return _shown(series.detect_series(user_series(spark, folder), latest_only=True))


@query("w8_components", f"""WITH {METRICS_SQL},
daily AS (
  SELECT tenant_id || '/' || metric_id AS metric_id, period_date, value FROM metrics
  WHERE metric_id IN ('new_mrr', 'expansion_mrr', 'contraction_mrr', 'churn_mrr')),
{STATISTICS_SQL} SELECT split_part(metric_id, '/', 1) AS tenant_id, split_part(metric_id, '/', 2) AS metric_id,
  CAST(period_date AS VARCHAR) AS period, detection_method, round(severity + 1e-9, 4) AS severity, round(deviation + 1e-9, 4) AS deviation,
  round(baseline_value + 1e-9, 4) AS baseline_value, round(actual_value + 1e-9, 4) AS actual_value, direction, 'mrr' AS parent_metric,
  split_part(metric_id, '/', 2) AS component FROM hits""")
def w8(spark, folder):
    rows = with_lag(spark, folder).select("tenant_id", "metric_id", "period_date", "value")
    hits = series.detect_components(rows, "mrr", ["tenant_id"])
    return _shown(hits, "tenant_id", "parent_metric", "component")


_FOREST_SQL = f"""
judged_series AS (
  SELECT metric_id, count(*) AS n, arg_max(value, period_date) AS current, max(period_date) AS newest FROM daily GROUP BY 1 HAVING count(value) > 7),
points AS (
  SELECT '42|' || metric_id AS name, row_number() OVER (PARTITION BY metric_id ORDER BY period_date) AS place, '' AS feature, value, n
  FROM daily JOIN judged_series USING (metric_id)),
{forest_sql()},
history AS (SELECT metric_id, avg(value) AS mean, stddev_pop(value) AS std FROM daily JOIN judged_series USING (metric_id) WHERE period_date < newest GROUP BY 1),
forest_hits AS (
  SELECT metric_id, newest AS period_date, least(1.0, 2 * abs(score)) AS severity, current - mean AS deviation, mean AS baseline_value, current AS actual_value
  FROM judged_series JOIN history USING (metric_id) JOIN isolated ON name = '42|' || metric_id
  WHERE is_outlier AND NOT (abs(current - mean) < 1 AND std > 0 AND abs(current - mean) < 2 * std))
"""


@query("i1_forest", f"""WITH RECURSIVE {USERS}, {_FOREST_SQL}
SELECT metric_id, CAST(period_date AS VARCHAR) AS period, 'isolation_forest' AS detection_method, round(severity + 1e-9, 4) AS severity,
       round(deviation + 1e-9, 4) AS deviation, round(baseline_value + 1e-9, 4) AS baseline_value, round(actual_value + 1e-9, 4) AS actual_value,
       'unknown' AS direction FROM forest_hits""")
def i1(spark, folder):
    return _shown(forest.detect_forest(user_series(spark, folder)))


@query("i2_joint_forest", f"""WITH RECURSIVE daily AS (
  SELECT user_id % 50 AS tenant_id, event_type AS metric_id, CAST(ts AS DATE) AS period_date, sum(value) AS value FROM events GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, metric_id ORDER BY period_date) AS place, count(*) OVER (PARTITION BY tenant_id, metric_id) AS n FROM daily),
grouped AS (
  SELECT tenant_id, n, max(period_date) AS newest, list_sort(list(DISTINCT metric_id)) AS ids FROM placed WHERE n > 7 GROUP BY 1, 2 HAVING count(DISTINCT metric_id) >= 2),
points AS (
  SELECT '42|' || tenant_id || '|' || n AS name, place, metric_id AS feature, value, n FROM placed JOIN grouped USING (tenant_id, n)),
{forest_sql()}
SELECT tenant_id, 'multivariate_' || array_to_string(ids[1:3], '_') || CASE WHEN len(ids) > 3 THEN '_etc' ELSE '' END AS metric_id,
       CAST(newest AS VARCHAR) AS period, 'isolation_forest_multivariate' AS detection_method, round(least(1.0, 2 * abs(score)) + 1e-9, 4) AS severity,
       0.0::DOUBLE AS deviation, 0.0::DOUBLE AS baseline_value, 0.0::DOUBLE AS actual_value, 'unknown' AS direction, 'several' AS metrics
FROM grouped JOIN isolated ON name = '42|' || tenant_id || '|' || n WHERE is_outlier""")
def i2(spark, folder):
    hits = forest.detect_joint_forest(tenant_series(spark, folder), ["tenant_id"])
    return _shown(hits, "tenant_id").withColumn("metrics", F.lit("several"))


_GAPS = USERS.replace("sum(value) AS value", "CASE WHEN CAST(ts AS DATE) <> DATE '2024-01-30' AND day(CAST(ts AS DATE)) % 5 <> 0 THEN sum(value) END AS value")


@query("w7_newest_with_gaps", f"""WITH {_GAPS}, {STATISTICS_SQL}
SELECT metric_id, CAST(period_date AS VARCHAR) AS period, round(value + 1e-9, 4) AS value, CAST(history_count AS BIGINT) AS history_count FROM judged WHERE is_latest""")
def w7_gaps(spark, folder):
    gap = (F.col("period_date") == F.lit("2024-01-30").cast("date")) | (F.dayofmonth("period_date") % 5 == 0)
    rows = user_series(spark, folder).withColumn("value", F.when(~gap, F.col("value")))
    points = series.series_statistics(rows).where("is_latest")
    return points.select("metric_id", day("period_date").alias("period"), number("value").alias("value"), "history_count")


@query("i1_forest_planted", f"""WITH {USERS}
SELECT metric_id, CAST(max(period_date) AS VARCHAR) AS period, 'isolation_forest' AS detection_method, CAST(1000000 AS DOUBLE) AS actual_value
FROM (SELECT *, lead(period_date) OVER (PARTITION BY metric_id ORDER BY period_date) IS NULL AS is_newest FROM daily)
WHERE CAST(metric_id AS BIGINT) % 2 = 1 GROUP BY 1 HAVING count(*) FILTER (day(period_date) % 9 <> 0 OR is_newest) > 7""")
def i1_planted(spark, folder):
    """Users with odd ids get an extreme newest point, the others are constant. Some points in between have no value."""
    odd = F.col("metric_id").cast("long") % 2 == 1
    newest = F.lead("period_date").over(Window.partitionBy("metric_id").orderBy("period_date")).isNull()
    rows = user_series(spark, folder).withColumn("value", F.when(~odd, 5.0).when(newest, 1e6).when(F.dayofmonth("period_date") % 9 != 0, F.col("value")))
    hits = forest.detect_forest(rows)
    return hits.select("metric_id", day("period_date").alias("period"), "detection_method", "actual_value")


@query("i2_joint_planted", """WITH daily AS (
  SELECT user_id % 50 AS tenant_id, event_type AS metric_id, CAST(ts AS DATE) AS period_date FROM events GROUP BY ALL),
lengths AS (SELECT tenant_id, metric_id, count(*) AS length FROM daily GROUP BY ALL),
judged AS (SELECT tenant_id, length FROM lengths WHERE length > 7 AND tenant_id % 2 = 1 GROUP BY ALL HAVING count(*) >= 2)
SELECT tenant_id, CAST(count(*) AS BIGINT) AS hits FROM judged GROUP BY 1""")
def i2_planted(spark, folder):
    """Odd tenants get an extreme newest point in every series, even ones are constant."""
    newest = F.lead("period_date").over(Window.partitionBy("tenant_id", "metric_id").orderBy("period_date")).isNull()
    odd = F.col("tenant_id") % 2 == 1
    rows = tenant_series(spark, folder).withColumn("value", F.when(~odd, 5.0).when(newest, 1e6).otherwise(F.col("value")))
    return forest.detect_joint_forest(rows, ["tenant_id"]).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("hits"))


@query("n17_joint_ids", """WITH ids AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS ids FROM orders GROUP BY 1)
SELECT o_custkey, 'multivariate_' || array_to_string(ids[1:3], '_') || CASE WHEN len(ids) > 3 THEN '_etc' ELSE '' END AS joint_id FROM ids""")
def n17(spark, folder):
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("ids"))
    return rows.select("o_custkey", joint_metric_id(F.col("ids")).alias("joint_id"))


@query("i3_rules_without_forest", f"WITH {USERS}, {STATISTICS_SQL} {_HIT_SQL} WHERE is_latest")
def i3(spark, folder):
    rows = user_series(spark, folder).withColumn("change_percent", F.lit(None).cast("double"))
    return _shown(detect_anomalies(rows, use_forest=False))
