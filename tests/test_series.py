import datetime

import pytest

from recurva.operators import forest, series
from recurva.plans import report
from recurva.plans.detect import detect_anomalies

DAY0 = datetime.date(2024, 1, 1)


def make(spark, **histories):
    rows = [(m, DAY0 + datetime.timedelta(days=i), None if v is None else float(v)) for m, vs in histories.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "metric_id string, period_date date, value double")


def wave(n=30, step=5):
    return [100 + i % step for i in range(n)]


def hits(frame):
    return {(r["metric_id"], r["detection_method"]): r for r in frame.collect()}


def test_zscore_and_change(spark):
    data = make(spark, flat=[100] * 30 + [101], up=wave() + [200], down=wave() + [1], far=wave() + [99999], big=wave() + [500], short=[100] * 5 + [200])
    found = hits(series.detect_series(data, latest_only=True))
    assert ("flat", "z_score") not in found and ("short", "z_score") not in found
    assert found["up", "z_score"]["deviation"] == pytest.approx(69.2965, abs=1e-3) and found["up", "z_score"]["direction"] == "above"
    assert found["down", "z_score"]["deviation"] == pytest.approx(-71.4178, abs=1e-3) and found["down", "z_score"]["direction"] == "below"
    assert found["far", "z_score"]["severity"] == 1.0
    assert found["big", "z_score"]["context"]["z_score"] == pytest.approx(281.4285, abs=1e-3)
    assert found["big", "rate_of_change"]["deviation"] == pytest.approx(208.5487, abs=1e-3)
    assert found["big", "rate_of_change"]["baseline_value"] == 104.0


def test_short_histories(spark):
    data = make(spark, one=[100, 200], none=[100], jump=[100, 100, 200], calm=[100, 100, 101], zero=[5, 0, 100], pair=[90, 95, 100])
    found = hits(series.detect_series(data, latest_only=True))
    assert set(found) == {("jump", "rate_of_change")}
    assert found["jump", "rate_of_change"]["deviation"] == 1.0 and found["jump", "rate_of_change"]["severity"] == 1.0


def test_every_point_equals_the_last_point_of_every_prefix(spark):
    import random

    rng = random.Random(3)
    values = [round(100 + rng.gauss(0, 3) + (40 if i % 11 == 0 else 0), 2) for i in range(45)]
    whole = {(r["period_date"], r["detection_method"], round(r["deviation"], 6)) for r in series.detect_series(make(spark, m=values)).collect()}
    prefixes = make(spark, **{f"p{n}": values[:n] for n in range(1, 46)})
    single = {(r["period_date"], r["detection_method"], round(r["deviation"], 6)) for r in series.detect_series(prefixes, latest_only=True).collect()}
    assert whole == single and whole


def test_change_threshold(spark):
    rows = spark.createDataFrame([("a", 10.0, 16.0), ("b", 10.0, -60.0), ("c", 10.0, 15.0), ("d", 10.0, None)], "metric_id string, value double, change_percent double")
    found = hits(series.change_threshold(rows))
    assert set(found) == {("a", "change_threshold"), ("b", "change_threshold")}
    assert (found["a", "change_threshold"]["severity"], found["a", "change_threshold"]["direction"]) == (0.32, "increase")
    assert (found["b", "change_threshold"]["severity"], found["b", "change_threshold"]["direction"]) == (1.0, "decrease")


def test_components(spark):
    data = make(spark, mrr=[1000] * 31, new_mrr=wave() + [900], churn_mrr=wave(10))
    found = hits(series.detect_components(data, "mrr", latest_only=True))
    assert found["new_mrr", "z_score"]["parent_metric"] == "mrr" and found["new_mrr", "z_score"]["component"] == "new_mrr"
    assert not any(m == "expansion_mrr" for m, _ in found)
    filled = series.component_series(data, "mrr").groupBy("metric_id").count().collect()
    assert {(r["metric_id"], r["count"]) for r in filled} == {(m, 31) for m in ("new_mrr", "expansion_mrr", "contraction_mrr", "churn_mrr")}


def test_forest(spark):
    data = make(spark, calm=wave(30, 2) + [100.5], spike=wave() + [500], drop=wave() + [10], short=[100] * 4 + [300])
    found = hits(forest.detect_forest(data, contamination=0.1))
    assert set(found) == {("spike", "isolation_forest"), ("drop", "isolation_forest")}
    assert found["spike", "isolation_forest"]["severity"] > 0.5 and found["spike", "isolation_forest"]["deviation"] == pytest.approx(398.0)
    again = hits(forest.detect_forest(data.repartition(3), contamination=0.1))
    assert {k: r["severity"] for k, r in again.items()} == {k: r["severity"] for k, r in found.items()}


def test_forest_and_points_without_a_value(spark):
    """NULL and NaN in a history change nothing; a series whose newest point is NULL is not judged."""
    gap = [None, float("nan")]
    data = make(spark, whole=wave() + [9999.0], gaps=wave()[:10] + gap + wave()[10:] + [9999.0], open=wave() + [9999.0, None], few=[100.0] * 6 + [None] * 9 + [500.0])
    assert set(hits(forest.detect_forest(data, contamination=0.1))) == {("whole", "isolation_forest"), ("gaps", "isolation_forest")}
    pair = make(spark, mrr=[1000 + 10 * i for i in range(30)] + [1300], churn=[5 + i % 2 for i in range(12)] + [None] + [5 + i % 2 for i in range(18)] + [15])
    row, = forest.detect_joint_forest(pair, metrics=["mrr", "churn"], contamination=0.1).collect()
    assert set(row["involved_metrics"]) == {"mrr", "churn"}


def test_joint_forest(spark):
    data = make(spark, mrr=[1000 + 10 * i for i in range(30)] + [1300], churn=[5 + i % 2 for i in range(30)] + [15], other=[1] * 12)
    with pytest.raises(ValueError, match="name the keys"):
        forest.detect_joint_forest(data)
    assert forest.detect_joint_forest(data, metrics=["mrr", "other"], contamination=0.1).count() == 0
    row, = forest.detect_joint_forest(data, metrics=["mrr", "churn", "other"], contamination=0.1).collect()
    assert row["metric_id"] == "multivariate_churn_mrr" and set(row["involved_metrics"]) == {"mrr", "churn"}
    assert row["current_values"] == {"mrr": 1300.0, "churn": 15.0}


def test_forest_draws_for_all_nodes_of_a_level_at_once(monkeypatch):
    import numpy as np

    trees, nodes = np.arange(40) % 7, np.arange(40) + 1
    assert forest._draws("42|x", trees, nodes, "f").tolist() == [forest._draw("42|x", t, n, "f") for t, n in zip(trees, nodes)]
    single = []
    monkeypatch.setattr(forest, "_draw", lambda *names: single.append(names) or 0.5)
    points = np.random.default_rng(2).normal(size=(30, 2))
    assert forest.forest_scores(points, "42|x", features=["a", "b"]).shape == (30,) and not single


def test_forest_scores_are_bounded():
    import numpy as np

    points = np.random.default_rng(0).normal(size=(700, 3))
    points[13] = 50
    scores = forest.forest_scores(points, 7)
    assert scores.argmin() == 13 and (scores < 0).all() and (scores >= -1).all()


def test_all_rules_and_report(spark):
    data = make(spark, mrr=wave() + [500], arpu=[7], nrr=wave() + [102])
    rows = data.join(spark.createDataFrame([("arpu", 40.0)], "metric_id string, change_percent double"), "metric_id", "left")
    found = detect_anomalies(rows)
    by_key = hits(found)
    assert {("mrr", "z_score"), ("mrr", "rate_of_change"), ("mrr", "isolation_forest"), ("arpu", "change_threshold")} <= set(by_key)
    assert by_key["mrr", "z_score"]["metric_name"] == "Monthly Recurring Revenue"
    told = report.explain_anomalies(found).collect()
    assert [r["severity_score"] for r in told] == sorted((r["severity_score"] for r in told), reverse=True)
    assert report.most_severe(report.summarise(found)).first()["severity"] == "Critical"
    quiet = report.explain_anomalies(found.limit(0)).collect()
    assert len(quiet) == 1 and quiet[0]["what_happened"].startswith("No anomalies")
    assert {r["band"] for r in report.anomaly_report(found).collect()} <= {"red", "yellow", "blue"}
