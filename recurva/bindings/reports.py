"""Composite jobs, labels and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recurva.bindings.metrics import KEYS, with_lag
from recurva.bindings.series import _HIT_SQL, EVENTS, USERS
from recurva.bindings.tables import (
    METRICS_SQL, STATISTICS_SQL, day, event_series, forest_sql, metric_inputs, number, subscriptions, table, user_series,
)
from recurva.functions import labels
from recurva.operators.metrics import describe_metrics
from recurva.operators.series import detect_series
from recurva.plans import report
from recurva.plans.compute import compute_saas_metrics
from recurva.plans.detect import detect_anomalies, name_anomalies

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


def _rounded(hits):
    return hits.withColumns({c: number(c) for c in ("severity", "deviation", "baseline_value", "actual_value")})


def user_anomalies(spark, folder):
    return _rounded(name_anomalies(detect_series(user_series(spark, folder))))


_LABEL = "CASE WHEN severity > 0.7 THEN 'Critical' WHEN severity > 0.4 THEN 'Warning' ELSE 'Info' END"
_SHOWN = f"shown AS ({_HIT_SQL})"


@query("n12_severity_labels", f"""WITH {USERS}, {STATISTICS_SQL}, {_SHOWN}
SELECT detection_method, {_LABEL} AS severity, direction, CAST(count(*) AS BIGINT) AS n FROM shown GROUP BY 1, 2, 3""")
def n12(spark, folder):
    rows = report.summarise(user_anomalies(spark, folder).withColumn("tenant_id", F.col("direction")))
    return rows.groupBy("detection_method", "severity", F.col("tenant_id").alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("n13_anomaly_sentences", f"""WITH {USERS}, {STATISTICS_SQL}, {_SHOWN}
SELECT metric_id AS metric, period, detection_method, metric_id || ' ' || direction || ' to ' || CAST(actual_value AS VARCHAR) AS what_happened FROM shown""")
def n13(spark, folder):
    rows = report.summarise(user_anomalies(spark, folder))
    return rows.select("metric", day("period_date").alias("period"), "detection_method", "what_happened")


@query("n13_large_amounts", """
SELECT o_orderkey, 'orders above to ' || CAST(CAST(round(o_totalprice) AS BIGINT) * 1000 AS VARCHAR) || '.0' AS what_happened FROM orders""")
def n13_large(spark, folder):
    amount = F.floor(F.col("o_totalprice") + 0.5) * 1000.0
    sentence = labels.anomaly_sentence(F.lit("orders"), F.lit("above"), amount.cast("double"))
    return table(spark, folder, "orders").select("o_orderkey", sentence.alias("what_happened"))


_SUMMARY = f"""SELECT metric_id AS metric, period, {_LABEL} AS severity, severity AS severity_score, detection_method, deviation,
  baseline_value AS baseline, actual_value AS actual FROM shown"""


def _summary(rows):
    return rows.select("metric", day("period_date").alias("period"), "severity", "severity_score", "detection_method", "deviation", "baseline", "actual")


@query("o1_severity_ranking", f"WITH {USERS}, {STATISTICS_SQL}, {_SHOWN} {_SUMMARY}")
def o1(spark, folder):
    return _summary(report.ranked(report.summarise(user_anomalies(spark, folder))))


@query("o2_most_severe", f"WITH {USERS}, {STATISTICS_SQL}, {_SHOWN} {_SUMMARY} ORDER BY severity_score DESC, metric, detection_method, period LIMIT 1")
def o2(spark, folder):
    return _summary(report.most_severe(report.summarise(user_anomalies(spark, folder))))


@query("r4_explanations", f"""WITH {EVENTS}, {STATISTICS_SQL}, {_SHOWN} {_SUMMARY}
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL WHERE NOT EXISTS (SELECT * FROM shown)""")
def r4(spark, folder):
    return _summary(report.explain_anomalies(_rounded(name_anomalies(detect_series(event_series(spark, folder))))))


@query("r4_no_anomalies", f"""WITH {EVENTS}, {STATISTICS_SQL}, {_SHOWN}
SELECT 'No anomalies detected. All metrics are within normal ranges.' AS what_happened, CAST(count(*) AS BIGINT) AS n FROM shown WHERE severity > 2""")
def r4_quiet(spark, folder):
    none = _rounded(name_anomalies(detect_series(event_series(spark, folder)))).where(F.col("severity") > 2)
    return report.explain_anomalies(none).select("what_happened", F.lit(0).cast("long").alias("n"))


_REPORT = """SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, name AS metric,
  CASE unit WHEN 'currency' THEN format('${:,}', CAST(round_even(value, 0) AS BIGINT)) WHEN 'percent' THEN printf('%.1f%%', value)
            WHEN 'ratio' THEN printf('%.2f', value) ELSE format('{:,}', CAST(round_even(value, 0) AS BIGINT)) END AS value,
  CASE WHEN change_percent IS NULL THEN '—' ELSE CASE WHEN change_percent > 0 THEN '↑' WHEN change_percent < 0 THEN '↓' ELSE '→' END
       || printf(' %.1f%%', abs(change_percent)) END AS change,
  CASE WHEN change_percent IS NULL THEN 'dim' WHEN (change_percent > 0) = (direction = 'up_good') THEN 'green' ELSE 'red' END AS style,
  CASE direction WHEN 'up_good' THEN '📈' WHEN 'down_good' THEN '📉' ELSE '➡️' END AS direction
FROM (SELECT * REPLACE (round(value + 1e-9, 4) AS value, round(change_percent + 1e-9, 4) AS change_percent) FROM changes) JOIN registry USING (metric_id)"""


@query("r5_metric_report", f"WITH {METRICS_SQL} {_REPORT}")
def r5(spark, folder):
    metrics = with_lag(spark, folder).withColumns({c: number(c) for c in ("value", "change_percent")})
    rows = report.metric_report(describe_metrics(metrics))
    return rows.withColumn("period", day("period_date")).drop("period_date")


@query("n14_value_text", f"WITH {METRICS_SQL} SELECT tenant_id, period, metric, value, change FROM ({_REPORT})")
def n14(spark, folder):
    return r5(spark, folder).select("tenant_id", "period", "metric", "value", "change")


@query("r5_anomaly_report", f"""WITH {USERS}, {STATISTICS_SQL}
SELECT CAST(period_date AS VARCHAR) AS period, CASE WHEN severity > 0.7 THEN 'red' WHEN severity > 0.4 THEN 'yellow' ELSE 'blue' END AS band,
       metric_id || ' — ' || direction || printf(' (severity: %.2f)', severity) AS line FROM hits""")
def r5_anomalies(spark, folder):
    rows = report.anomaly_report(name_anomalies(detect_series(user_series(spark, folder))))
    return rows.select(day("period_date").alias("period"), "band", "line")


@query("r2_metric_tables", f"""WITH {METRICS_SQL}
SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, metric_id, name, unit, direction, round(value + 1e-9, 4) AS value FROM metrics JOIN registry USING (metric_id)""")
def r2(spark, folder):
    flags = subscriptions(spark, folder)
    rows = compute_saas_metrics(flags, KEYS, extra=metric_inputs(flags)).metrics
    return rows.select("tenant_id", day("period_date").alias("period"), "metric_id", "name", "unit", "direction", number("value").alias("value"))


_ALL_HITS = f"""WITH {METRICS_SQL},
daily AS (SELECT tenant_id || '/' || metric_id AS metric_id, period_date, value FROM metrics), {STATISTICS_SQL},
every AS (
  SELECT split_part(metric_id, '/', 1) AS tenant_id, split_part(metric_id, '/', 2) AS metric_id, period_date, is_latest, detection_method, severity,
         deviation, actual_value, direction FROM hits)"""


@query("r3_anomalies", f"""{_ALL_HITS}
SELECT tenant_id, metric_id, name AS metric_name, CAST(period_date AS VARCHAR) AS period, detection_method, round(severity + 1e-9, 4) AS severity,
       round(deviation + 1e-9, 4) AS deviation, round(actual_value + 1e-9, 4) AS actual_value, e.direction FROM every e JOIN registry USING (metric_id)""")
def r3(spark, folder):
    hits = detect_anomalies(with_lag(spark, folder), ["tenant_id"], latest_only=False, use_forest=False)
    return hits.select("tenant_id", "metric_id", "metric_name", day("period_date").alias("period"), "detection_method",
                       *[number(c).alias(c) for c in ("severity", "deviation", "actual_value")], "direction")


@query("r3_anomalies_with_forest", f"""{_ALL_HITS.replace('WITH ', 'WITH RECURSIVE ', 1)},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, metric_id ORDER BY period_date) AS place, count(*) OVER (PARTITION BY tenant_id, metric_id) AS n FROM metrics),
long AS (SELECT * FROM placed WHERE n > 7),
grouped AS (
  SELECT tenant_id, n, max(period_date) AS newest, list_sort(list(DISTINCT metric_id)) AS ids FROM long GROUP BY 1, 2 HAVING count(DISTINCT metric_id) >= 2),
forest_points AS (
  SELECT '42|' || tenant_id || '|' || metric_id AS name, place, '' AS feature, value, n FROM long
  UNION ALL SELECT '42|' || tenant_id || '|' || n, place, metric_id, value, n FROM long JOIN grouped USING (tenant_id, n)),
{forest_sql('forest_points')},
single AS (
  SELECT tenant_id, metric_id, max(period_date) AS period_date, max(value) FILTER (place = n) AS current, avg(value) FILTER (place < n) AS mean,
         stddev_pop(value) FILTER (place < n) AS std FROM long GROUP BY 1, 2),
found AS (
  SELECT tenant_id, metric_id, period_date, detection_method, severity, direction FROM every WHERE is_latest
  UNION ALL
  SELECT tenant_id, metric_id, period_date, 'isolation_forest', least(1.0, 2 * abs(score)), 'unknown' FROM single
  JOIN isolated ON name = '42|' || tenant_id || '|' || metric_id
  WHERE is_outlier AND NOT (abs(current - mean) < 1 AND std > 0 AND abs(current - mean) < 2 * std)
  UNION ALL
  SELECT tenant_id, 'multivariate_' || array_to_string(ids[1:3], '_') || CASE WHEN len(ids) > 3 THEN '_etc' ELSE '' END, newest, 'isolation_forest_multivariate',
         least(1.0, 2 * abs(score)), 'unknown' FROM grouped JOIN isolated ON isolated.name = '42|' || tenant_id || '|' || n WHERE is_outlier)
SELECT tenant_id, metric_id, CASE WHEN detection_method = 'isolation_forest_multivariate' THEN 'Multivariate Anomaly' ELSE coalesce(name, metric_id) END AS metric_name,
       CAST(period_date AS VARCHAR) AS period, detection_method, round(severity + 1e-9, 4) AS severity, found.direction FROM found LEFT JOIN registry USING (metric_id)""")
def r3_forest(spark, folder):
    hits = detect_anomalies(with_lag(spark, folder), ["tenant_id"])
    return hits.select("tenant_id", "metric_id", "metric_name", day("period_date").alias("period"), "detection_method",
                       number("severity").alias("severity"), "direction")
