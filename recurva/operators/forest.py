"""Isolation forest on metric series, after Liu, Ting and Zhou (2008).

Spark finds the series, their lengths and their groups; a task only sees the points of one series, or of
the few metrics of one tenant, which the calendar and the registry bound. Choices are drawn by hashes of the place
they are made at, so that the values can be repeated, also in SQL; they differ from those of other libraries.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurva.functions.labels import joint_metric_id
from recurva.operators.series import MIN_HISTORY

EULER = 0.5772156649015329


def _expected_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    path = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, path, np.where(n == 2, 1.0, 0.0))


def _draw(*names: object) -> float:
    """A number between 0 and 1 that follows from the names: the first 52 bits of their digest."""
    return int(hashlib.md5("|".join(map(str, names)).encode()).hexdigest()[:13], 16) / 2.0 ** 52


def _draws(seed: object, trees: np.ndarray, nodes: np.ndarray, name: str) -> np.ndarray:
    """`_draw` of the seed, a tree, a node and a name, for many nodes."""
    start, md5 = f"{seed}|", hashlib.md5
    digests = b"".join([md5(f"{start}{t}|{n}|{name}".encode()).digest()[:8] for t, n in zip(trees.tolist(), nodes.tolist())])
    return (np.frombuffer(digests, dtype=">u8") >> np.uint64(12)).astype(float) / 2.0 ** 52


def forest_scores(points: np.ndarray, seed: object, trees: int = 100, sample: int | None = None, features: Sequence[str] = ()) -> np.ndarray:
    """Score per row, near −1 for isolated rows. All trees grow level by level in the same arrays.

    Nothing is random: a node's feature and the place of its cut are drawn from the seed, the tree, the node and the feature's
    name, so that any engine grows the same trees. A node is 1 at the root, and 2n or 2n + 1 below n. Each tree grows on all
    rows, or on the `sample` rows with the smallest draws.
    """
    n, width = points.shape
    features = list(features) or [str(f) if width > 1 else "" for f in range(width)]
    drawn = n if sample is None else min(sample, n)
    used = np.ones((trees, n), dtype=bool)
    if drawn < n:
        order = np.array([[_draw(seed, tree, "row", row) for row in range(n)] for tree in range(trees)]).argsort(axis=1)
        np.put_along_axis(used, order[:, drawn:], False, axis=1)
    node = np.ones((trees, n), dtype=np.int64)
    depth = np.zeros((trees, n))
    open_ = np.ones((trees, n), dtype=bool)
    levels = max(1, int(np.ceil(np.log2(max(drawn, 2)))))
    # a tree has no more nodes than fit its levels, at most four times its rows, so each has a place of its own
    of_tree = np.arange(trees)[:, None] << (levels + 1)
    nodes = trees << (levels + 1)
    column = np.broadcast_to(np.arange(n), node.shape)
    for _ in range(levels):
        place = of_tree + node
        grow = used & open_
        low, high = np.full((nodes, width), np.inf), np.full((nodes, width), -np.inf)
        at, rows = place[grow], points[column[grow]]
        for f in range(width):
            np.minimum.at(low[:, f], at, rows[:, f])
            np.maximum.at(high[:, f], at, rows[:, f])
        varies = high > low
        can = varies.any(axis=1)
        open_ &= can[place]
        drawn_for = np.flatnonzero(can)
        tree, own = drawn_for >> (levels + 1), drawn_for & ((1 << levels + 1) - 1)
        feature, cut = np.zeros(nodes, dtype=int), np.zeros(nodes)
        if width > 1:
            best = np.full(len(drawn_for), -np.inf)
            for f in range(width):
                draws = np.full(len(drawn_for), -np.inf)
                able = varies[drawn_for, f]
                draws[able] = _draws(seed, tree[able], own[able], features[f])
                better = draws > best
                feature[drawn_for[better]], best[better] = f, draws[better]
        first, last = low[drawn_for, feature[drawn_for]], high[drawn_for, feature[drawn_for]]
        cut[drawn_for] = first + _draws(seed, tree, own, "") * (last - first)
        right = points[np.arange(n)[None, :], feature[place]] > cut[place]
        node = np.where(open_, node * 2 + right, node)
        depth += open_
    place = of_tree + node
    size = np.bincount(place[used], minlength=nodes)
    paths = (depth + _expected_path(size[place])).mean(axis=0).round(9)
    return -np.power(2.0, -paths / max(float(_expected_path(np.array(drawn))), 1e-9))


_FOREST_KINDS = (
    pa.field("period_date", pa.date32()), pa.field("detection_method", pa.string()),
    *[pa.field(c, pa.float64()) for c in ("severity", "deviation", "baseline_value", "actual_value")],
    pa.field("direction", pa.string()), pa.field("context", pa.map_(pa.string(), pa.float64())),
)


def _seen(value: object, kind: pa.DataType) -> object:
    """A key as it goes into the seed: a missing number is no number."""
    return float("nan") if value is None and (pa.types.is_integer(kind) or pa.types.is_floating(kind)) else value


def _seed(seed: int, *names: object) -> str:
    return "|".join([str(seed), *map(str, names)])


def _last_is_outlier(scores: np.ndarray, contamination: float) -> bool:
    return bool(scores[-1] < np.percentile(scores, 100.0 * contamination))


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows placed by key on all shuffle partitions: a forest is much work for few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _judged(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """The points with a value, and their number as `length`, of series that end in such a point and have enough before it.

    NULL and NaN are no values. A series whose newest point has none is not judged.
    """
    own = Window.partitionBy(*names)
    known = F.when(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")), F.col("period_date"))
    marked = series.withColumns({"_newest": F.max("period_date").over(own), "_known": F.max(known).over(own), "length": F.count(known).over(own)})
    ready = (F.col("_newest") == F.col("_known")) & (F.col("length") > MIN_HISTORY) & known.isNotNull()
    return marked.where(ready).drop("_newest", "_known")


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[name] for name in names]


def detect_forest(series: DataFrame, keys: Sequence[str] = (), contamination: float = 0.05, seed: int = 42,
                  trees: int = 100, guard: float = 1.0, sample: int | None = None) -> DataFrame:
    """Judge the newest point of every series with at least seven earlier ones.

    Points without a value are left out; see `_judged`. Trees grow on all points of a series; `sample` lowers that to a number of points for each tree. A point closer to the mean than `guard` and than two standard deviations is never flagged.
    """
    names = [*keys, "metric_id"]

    def judge(points: pa.Table) -> pa.Table:
        points = points.sort_by("period_date")
        kinds = pa.schema([*[points.schema.field(c) for c in names], *_FOREST_KINDS])
        values = points["value"].to_numpy()
        history, current = values[:-1], values[-1]
        row = {c: points[c][-1].as_py() for c in names}
        scores = forest_scores(values[:, None], _seed(seed, *[_seen(v, kinds.field(c).type) for c, v in row.items()]), trees, sample)
        gap, spread = current - history.mean(), history.std()
        tiny = abs(gap) < guard and spread > 0 and abs(gap) < 2 * spread
        if tiny or not _last_is_outlier(scores, contamination):
            return kinds.empty_table()
        return pa.Table.from_pylist([row | {
            "period_date": points["period_date"][-1].as_py(), "detection_method": "isolation_forest",
            "severity": min(1.0, 2.0 * abs(scores[-1])), "deviation": gap, "baseline_value": history.mean(),
            "actual_value": current, "direction": "unknown",
            "context": [("isolation_forest_score", float(scores[-1])), ("model_contamination", contamination)],
        }], schema=kinds)

    schema = T.StructType([
        *_fields(series, names),
        T.StructField("period_date", T.DateType()),
        T.StructField("detection_method", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("severity", "deviation", "baseline_value", "actual_value")],
        T.StructField("direction", T.StringType()),
        T.StructField("context", T.MapType(T.StringType(), T.DoubleType())),
    ])
    ready = _judged(_spread(series, names), names).select(*names, "period_date", F.col("value").cast("double").alias("value"))
    return ready.groupBy(*names).applyInArrow(judge, schema)  # frames of pandas cost more than the forest of a short series


def detect_joint_forest(series: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] | None = None,
                        contamination: float = 0.05, seed: int = 42, trees: int = 100, sample: int | None = None) -> DataFrame:
    """Judge the newest time point over all metrics of a key that have equally long series.

    Points are matched by position, as series of equal length; groups need at least two metrics. A group is one task's
    work, so its size must be known: either `keys` split the series, or `metrics` lists those that are judged
    together. Without both, nothing bounds the group and the call is refused.
    """
    if not keys and metrics is None:
        raise ValueError("name the keys that split the series, or the metrics to judge together")
    if metrics is not None:
        series = series.where(F.col("metric_id").isin(*metrics))
    order = Window.partitionBy(*keys, "metric_id").orderBy("period_date")
    placed = _judged(series, [*keys, "metric_id"]).withColumn("position", F.row_number().over(order))
    group = [*keys, "length"]

    def judge(points: pd.DataFrame) -> pd.DataFrame:
        grid = points.pivot(index="position", columns="metric_id", values="value").sort_index()
        row = {c: points[c].iloc[0] for c in group}
        found = False
        score = 0.0
        if grid.shape[1] >= 2:
            scores = forest_scores(grid.to_numpy(dtype=float), _seed(seed, *row.values()), trees, sample, list(map(str, grid.columns)))
            found, score = _last_is_outlier(scores, contamination), float(scores[-1])
        ids = [str(m) for m in grid.columns]
        result = row | {
            "period_date": points["period_date"].max(), "severity": min(1.0, 2.0 * abs(score)),
            "isolation_forest_score": score, "involved_metrics": ids,
            "current_values": dict(zip(ids, map(float, grid.iloc[-1]))),
        }
        return pd.DataFrame([result]) if found else pd.DataFrame([result]).iloc[:0]

    schema = T.StructType([
        *_fields(placed, group),
        T.StructField("period_date", T.DateType()),
        T.StructField("severity", T.DoubleType()),
        T.StructField("isolation_forest_score", T.DoubleType()),
        T.StructField("involved_metrics", T.ArrayType(T.StringType())),
        T.StructField("current_values", T.MapType(T.StringType(), T.DoubleType())),
    ])
    hits = _spread(placed.select(*group, "position", "metric_id", "period_date", "value"), group).groupBy(*group)
    zero = F.lit(0.0)
    return hits.applyInPandas(judge, schema).select(
        *keys,
        joint_metric_id(F.col("involved_metrics")).alias("metric_id"),
        "period_date",
        F.lit("isolation_forest_multivariate").alias("detection_method"),
        "severity",
        zero.alias("deviation"),
        zero.alias("baseline_value"),
        zero.alias("actual_value"),
        F.lit("unknown").alias("direction"),
        F.map_from_arrays(F.array(F.lit("isolation_forest_score")), F.array("isolation_forest_score")).alias("context"),
        "involved_metrics",
        "current_values",
    )


# Executors get the code of the functions themselves, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
