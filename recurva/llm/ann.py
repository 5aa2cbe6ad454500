"""Approximate nearest neighbours by an inverted file with an adaptive scan of dimensions.

Vectors of each length are searched by themselves. Centroids come from a bounded sample; every row is put into the list of
its nearest centroid. How many lists a query probes is measured on the sample, by a target of recall. Rows are dealt to groups
of fixed size by a position that counts list after list, so a list lies in one group or a few neighbouring ones and a
list with a third of all rows is simply many groups. A query goes to the groups its probed lists touch, and once to
each, in blocks of queries.

A group keeps its unit vectors randomly rotated (Gao and Long 2023), in blocks of columns. For a query, the rows of
its nearest list present are measured in full and give a first bound. The other probed lists follow, the nearest first, in
shares that double: of their rows only the first block of dimensions is read, and those whose partial distance, scaled up,
exceeds the bound by more than chance allows are abandoned; the rest read the next block, and so on. What a share leaves
tightens the bound of the next. All that is left is scored exactly on the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurva.session import checkpointed

#: Bounds of what the driver sees: vectors the centroids are fitted on, and centroids.
SAMPLE_ROWS, MOST_LISTS = 16_384, 4096
#: Rows in a group, and queries that meet a group at once.
GROUP_ROWS, QUERY_ROWS = 8192, 2048
COLUMN_BLOCK = 16
#: Rows of the sample on which the number of probes is measured.
TRIED = 256
#: Strictness of the test that abandons a row; larger abandons fewer.
EPSILON = 2.1
#: Rows of the first share of the lists that come after a query's nearest one.
FIRST_SHARE = 512

_FOUND = "query_id long, vec_id long, score double"


def _array(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Spherical k-means; an empty list keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centroids[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centroids


def measured_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, seed: int) -> int:
    """Lists to probe so that `recall` of the true neighbours within the sample lie in them.

    In the whole table neighbours are nearer than in the sample, so their lists come earlier.
    """
    tried = np.random.default_rng(seed).permutation(len(sample))[:TRIED]
    lists = (sample @ centroids.T).argmax(axis=1)
    order = np.argsort(-(sample[tried] @ centroids.T), axis=1, kind="stable")
    places = np.empty_like(order)
    np.put_along_axis(places, order, np.arange(len(centroids))[None, :], axis=1)
    near = sample[tried] @ sample.T
    near[np.arange(len(tried)), tried] = -np.inf
    found = np.argsort(-near, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    ranks = np.take_along_axis(places, lists[found], axis=1).ravel()
    return int(np.quantile(ranks, recall, method="higher")) + 1 if len(ranks) else 1


def _rotation(dimensions: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dimensions]).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def _probed(unit: np.ndarray, centroids: np.ndarray, probes: int, sizes: np.ndarray, rows: int) -> list[np.ndarray]:
    """Each row's nearest lists, nearest first: `probes` of them, or as many as hold `rows` rows."""
    order = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")
    enough = (np.cumsum(sizes[order], axis=1) < rows).sum(axis=1) + 1
    return [lists[:max(probes, n)] for lists, n in zip(order, enough)]


class _Group:
    """The rows of a group, sorted by list."""

    def __init__(self, rows: pd.DataFrame, seed: int):
        rows = rows.sort_values("list", kind="stable")
        self.ids, self.lists = rows["vec_id"].to_numpy(np.int64), rows["list"].to_numpy()
        self.vectors = _array(rows["vec"])
        dimensions = self.vectors.shape[1]
        rotated = _unit(self.vectors) @ _rotation(dimensions, seed)
        self.blocks = [np.ascontiguousarray(rotated[:, i:i + COLUMN_BLOCK]) for i in range(0, dimensions, COLUMN_BLOCK)]

    def rows_of(self, lists: np.ndarray) -> list[np.ndarray]:
        ends = np.searchsorted(self.lists, np.stack([lists, lists + 1]))
        return [np.arange(a, b) for a, b in zip(*ends) if b > a]

    def survivors(self, rows: np.ndarray, query: list[np.ndarray], bound: float) -> np.ndarray:
        """Rows that may be nearer than `bound`, a squared distance, by tests on growing parts of the dimensions."""
        every, read, partial = sum(len(q) for q in query), 0, np.zeros(len(rows))
        for block, part in zip(self.blocks, query):
            apart = block[rows] - part
            partial, read = partial + (apart * apart).sum(axis=1), read + len(part)
            strict = 1 + EPSILON / math.sqrt(read) if read < every else 1 + 1e-9
            near = partial <= bound * read / every * strict * strict + 1e-12
            rows, partial = rows[near], partial[near]
        return rows

    def _apart(self, rows: np.ndarray, query: list[np.ndarray]) -> np.ndarray:
        """Squared distances."""
        return sum((((block[rows] - part) ** 2).sum(axis=1) for block, part in zip(self.blocks, query)), np.zeros(len(rows)))

    def nearest(self, own: int, vector: np.ndarray, query: list[np.ndarray], lists: np.ndarray, k: int):
        """Ids and cosines of the `k` nearest found, ties to the smaller id."""
        parts = self.rows_of(lists)
        seeds, used = [], 0
        while used < len(parts) and sum(map(len, seeds)) < k + 1:  # one of them may be the query itself
            seeds.append(parts[used])
            used += 1
        chosen = np.concatenate([np.empty(0, np.int64), *seeds])
        chosen = chosen[self.ids[chosen] != own]
        apart = self._apart(chosen, query)
        rest = np.concatenate([np.empty(0, np.int64), *parts[used:]])
        rest, start, share = rest[self.ids[rest] != own], 0, FIRST_SHARE
        while start < len(rest):
            rows, start, share = rest[start:start + share], start + share, 2 * share
            if len(chosen) >= k:
                rows = self.survivors(rows, query, np.partition(apart, k - 1)[k - 1])
            chosen, apart = np.concatenate([chosen, rows]), np.concatenate([apart, self._apart(rows, query)])
        found = self.vectors[chosen]
        scores = (found * vector).sum(axis=1) / (np.sqrt((found * found).sum(axis=1)) * np.sqrt((vector * vector).sum()))
        order = np.lexsort((self.ids[chosen], -scores))[:k]
        return self.ids[chosen][order], scores[order]


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
            probe_share: float | None = None, recall: float = 0.97, seed: int = 42) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` rows of `df` with the largest cosine found for each row of `queries`.

    Vectors of different lengths are never neighbours; each length has lists of its own and is searched by jobs of its own. There
    are about 4·√n lists, `MOST_LISTS` at most; a query probes as many as hold `recall` of the neighbours within the
    sample, or `probe_share` of them if given, and more until they hold `k` others. Vectors without any structure need more than half of
    the lists, clustered ones far fewer. A row with the query's id is not its neighbour. Ties go to the smaller id; with
    fewer candidates all are returned.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows with a NULL id take no part, neither as
    queries nor as candidates. Rows that repeat an id count once, with the smallest of their vectors. An empty table gives an
    empty result; other columns are not read.
    """
    def sound(frame: DataFrame) -> DataFrame:
        values = F.transform(F.col("vec"), lambda x: x.cast("double"))
        fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
        rows = frame.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vec")).where("vec_id IS NOT NULL").where(fine)
        return rows.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("length", F.size("vec"))

    spark = df.sparkSession
    rows, asked = checkpointed(sound(df)), checkpointed(sound(queries))
    found = spark.createDataFrame([], _FOUND)
    for one in rows.groupBy("length").count().orderBy("length").collect():  # a row per length
        length = one["length"]
        found = found.unionAll(_searched(rows.where(F.col("length") == length).drop("length"), asked.where(F.col("length") == length).drop("length"),
                                         length, one["count"], k, probe_share, recall, seed))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, asked: DataFrame, length: int, n: int, k: int, probe_share: float | None, recall: float, seed: int) -> DataFrame:
    """`query_id, vec_id, score` of the `k` nearest of every group of `n` sound rows of one length."""
    spark = rows.sparkSession
    share = min(1.0, SAMPLE_ROWS / n)
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))  # about SAMPLE_ROWS
    sample = _unit(_array(r["vec"] for r in picked.orderBy("vec_id").collect() or rows.limit(1).collect()))
    lists = max(1, min(MOST_LISTS, round(4 * math.sqrt(n))))
    centroids = fit_centroids(sample, lists, seed=seed)
    probes = measured_probes(sample, centroids, k, recall, seed) if probe_share is None else max(1, math.ceil(probe_share * len(centroids)))

    def assign(batches):
        for batch in batches:
            if len(batch):
                unit = _unit(_array(batch["vec"]))
                yield batch.assign(list=(unit @ centroids.T).argmax(axis=1).astype("int32"))

    placed = checkpointed(rows.mapInPandas(assign, "vec_id long, vec array<double>, list int"))
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # a row per list
    full = np.array([sizes.get(i, 0) for i in range(len(centroids))], np.int64)
    starts = np.concatenate([[0], np.cumsum(full)])
    bounds = spark.createDataFrame([(i, int(starts[i]), int(full[i])) for i in range(len(full)) if full[i]], "list int, start long, size long")
    position = F.col("start") + F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("size"))
    candidates = placed.join(F.broadcast(bounds), "list").withColumn("group", F.floor(position / GROUP_ROWS).cast("int"))

    query_blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))

    def visits(batches):
        """A query and each group that holds rows of a list it probes."""
        for batch in batches:
            if len(batch):
                probed = _probed(_unit(_array(batch["vec"])), centroids, probes, full, k + 1)
                groups = []
                for lists_of in probed:
                    present = lists_of[full[lists_of] > 0]
                    first, last = starts[present] // GROUP_ROWS, (starts[present + 1] - 1) // GROUP_ROWS
                    groups.append(np.unique(np.concatenate([np.empty(0, np.int64), *(np.arange(a, b + 1) for a, b in zip(first, last))])))
                yield batch.assign(groups=groups)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        members, found = rows[rows["list"] >= 0], {"query_id": [], "vec_id": [], "score": []}
        wanted = rows[rows["list"] < 0]
        if len(members) and len(wanted):
            group, vectors = _Group(members, seed), _array(wanted["vec"])
            unit = _unit(vectors)
            rotated, probed = unit @ _rotation(length, seed), _probed(unit, centroids, probes, full, k + 1)
            for i, own in enumerate(wanted["vec_id"].to_numpy(np.int64)):
                parts = [rotated[i, j:j + COLUMN_BLOCK] for j in range(0, length, COLUMN_BLOCK)]
                ids, scores = group.nearest(own, vectors[i], parts, probed[i], k)
                found["query_id"] += [own] * len(ids)
                found["vec_id"] += ids.tolist()
                found["score"] += scores.tolist()
        return pd.DataFrame(found).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    asked = asked.mapInPandas(visits, "vec_id long, vec array<double>, groups array<int>")
    asked = asked.select("vec_id", "vec", F.lit(-1).alias("list"), F.explode("groups").alias("group"),
                         F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(query_blocks)).cast("int").alias("block"))
    held = candidates.select("vec_id", "vec", "list", "group", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"))
    return held.unionAll(asked).groupBy("group", "block").applyInPandas(search, _FOUND)
