"""Embedding near-dedup by Euclidean p-stable hashing (Datar et al. 2004).

Vectors are normalised, so that a cosine is a distance. A table hashes a vector to the cells of a few random Gaussian
projections, each shifted and cut to a fixed width; vectors of one label that share all cells of a table share a
bucket. The hashes are written once, as a short code per table. Buckets with one vector are gone after a count of
codes, before any vector is moved.

Buckets are dealt out in blocks of rows, so that a task compares two blocks however full a bucket is. A task computes
cosines blockwise and returns, per row, the number of links and the root of its component within the task; pairs are
never listed. A pair that meets in several tables counts in the first of them. Equal vectors of a label are collapsed
first and stand for their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurva.operators.clustering import connected_components
from recurva.session import checkpointed

#: Rows of a bucket in one block. A tile holds one block or two; a group holds about four blocks' rows, so that many
#: small buckets share one call.
BLOCK_ROWS = 1024
TILE = ["label", "table", "code", "low", "high"]


def projections(dimensions: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dimensions])
    return rng.standard_normal((dimensions, tables * hashes)) / width, rng.random(tables * hashes)


def _codes(vectors: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit code of the cells per row and table."""
    directions, shifts = projections(vectors.shape[1], tables, hashes, width, seed)
    cells = np.floor(vectors @ directions + shifts).astype(np.int64).reshape(len(vectors), tables, hashes)
    mixers = np.random.default_rng([seed, 1]).integers(1 << 62, size=hashes, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        code = np.zeros(cells.shape[:2], np.int64)
        for i in range(hashes):
            code = (code ^ cells[:, :, i]) * mixers[i]
            code ^= (code >> 29)
    return code


def _unit(vectors: list) -> np.ndarray:
    found = np.array([np.asarray(v, np.float64) for v in vectors])
    largest = np.abs(found).max(axis=1, keepdims=True)
    found = found / largest  # so that squares of very large or very small components stay within range
    return found / np.sqrt((found * found).sum(axis=1, keepdims=True))


def _hashed(vectors: DataFrame, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """`node` with `codes`, one per table. Vectors of different lengths never share a table's code but by chance, and
    the cosine is only taken between equal lengths."""
    def work(batches):
        for batch in batches:
            codes = np.empty((len(batch), tables), np.int64)
            lengths = batch["vec"].map(len).to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                codes[at] = _codes(_unit(batch["vec"].iloc[at].tolist()), tables, hashes, width, seed)
            yield pd.DataFrame({"node": batch["node"], "codes": list(codes)})

    return vectors.select("node", "vec").mapInPandas(work, "node long, codes array<long>")


def _roots(links: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each, for a symmetric matrix of links, by spreading minima."""
    root = np.arange(len(links))
    while True:
        low = np.where(links, root[None, :], len(links)).min(axis=1)
        low = np.minimum(low, root)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(threshold: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        """Links within the block of each tile, or between its two blocks where it has two."""
        rows = rows.sort_values("second", kind="stable", ignore_index=True)
        left = int((~rows["second"]).sum())
        nodes, copies = rows["node"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
        tables, lengths = rows["table"].to_numpy(np.int64), rows["vec"].map(len).to_numpy()
        codes = np.array(rows["codes"].tolist(), np.int64)
        units = np.zeros((len(rows), lengths.max(initial=1)))
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            units[at, :length] = _unit(rows["vec"].iloc[at].tolist())
        ends = [], [], []
        for at in rows.groupby(TILE, sort=False).indices.values():
            first = int(np.searchsorted(at, left))
            links = units[at] @ units[at].T >= threshold
            np.fill_diagonal(links, False)
            if first < len(at):
                links[:first, :first] = links[first:, first:] = False
            if not links.any():
                continue
            links &= lengths[at][:, None] == lengths[at][None, :]
            for earlier in range(tables[at[0]]):  # pairs that an earlier table has counted
                links &= codes[at, earlier][:, None] != codes[at, earlier][None, :]
            hit = links.any(axis=1)
            for end, found in zip(ends, (nodes[at], (links * copies[at][None, :]).sum(axis=1), nodes[at][_roots(links)])):
                end.append(found[hit])
        return pd.DataFrame({name: np.concatenate([np.empty(0, np.int64), *end]) for name, end in zip(("node", "links", "root"), ends)})
    return work


def embedding_groups(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label",
                     threshold: float = 0.98, tables: int = 24, hashes: int = 12, width: float = 1.6, seed: int = 42) -> DataFrame:
    """A row per row of `df`: `vec_id, n_links, component_id, kept`.

    Rows link if their labels are equal and not NULL and their cosine in double precision is at least `threshold`;
    without a label column all rows may link. `n_links` counts the other rows linked directly, `component_id` is the
    smallest id reachable, itself included, and `kept` marks it. Vectors that are NULL, empty, zero or hold NULL or
    non-finite components link with nothing, nor do vectors of different lengths. Repeated rows, also with equal ids,
    are rows of their own and link with each other; rows with a NULL id count as links, and their component's id is
    NULL, and `kept` false, only if no linked row has one. An empty table gives an empty table.

    A pair at the threshold is missed with a probability of about 3 in 10,000 at the default number of tables.
    """
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.col(vector).isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (
        F.exists(values, lambda x: x != 0))
    group = F.lit("") if label is None else F.col(label).cast("string")
    usable = F.coalesce(sound, F.lit(False)) & group.isNotNull()
    rows = checkpointed(df.select(
        F.col(vec_id).alias("vec_id"), F.when(usable, group).alias("label"), F.when(usable, F.col(vector)).alias("vec"),
    ).withColumns({"h1": F.xxhash64(F.lit(1), "label", "vec"), "h2": F.xxhash64(F.lit(2), "label", "vec")}))
    distinct = rows.where("vec IS NOT NULL").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("smallest"))
    nodes = checkpointed(distinct.withColumn("node", F.monotonically_increasing_id()))  # fixed by the writing
    codes = checkpointed(_hashed(nodes, tables, hashes, width, seed))

    keys = codes.join(nodes.select("node", "label"), "node").select("node", "label", F.posexplode("codes").alias("table", "code"))
    sizes = checkpointed(keys.groupBy("label", "table", "code").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = checkpointed(keys.join(sizes, ["label", "table", "code"]).withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK_ROWS).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), "blocks").cast("int")))
    moved = members.agg(F.sum("blocks")).first()[0] or 0
    full = members.join(codes, "node").join(nodes.select("node", "vec", "copies"), "node")
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    low = full.withColumn("high", F.explode(F.filter(blocks, lambda b: b >= F.col("block")))).withColumnRenamed("block", "low")
    high = full.withColumn("low", F.explode(F.filter(blocks, lambda b: b < F.col("block")))).withColumnRenamed("block", "high")
    group = F.pmod(F.xxhash64(*TILE), F.lit(1 + moved // (4 * BLOCK_ROWS))).alias("group")
    side = [group, *TILE, "node", "vec", "copies", "codes"]
    tiles = low.select(*side, F.lit(False).alias("second")).unionAll(high.select(*side, F.lit(True).alias("second")))
    found = checkpointed(tiles.groupBy("group").applyInPandas(_compare(threshold), "node long, links long, root long"))

    linked = connected_components(found.where("node != root"), "node", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.select("node", "copies", "smallest").join(counts, "node", "left").join(linked, "node", "left").withColumn(
        "cluster_id", F.coalesce("cluster_id", "node"))
    named = placed.groupBy("cluster_id").agg(F.min("smallest").alias("component_id"))
    result = placed.join(named, "cluster_id").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    usable_rows = rows.where("vec IS NOT NULL").select("vec_id", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).join(
        result, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable_rows.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
