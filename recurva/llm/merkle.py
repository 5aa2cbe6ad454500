"""Merkle manifests of datasets: a content-addressed graph of digests, and proofs by descent through it.

Rows are leaves. Within a group (a language) they are ranked by their id, and every `fan` consecutive digests become one,
until one is left; the groups' roots become the root in the same way. The records that are stored map a digest to its children,
level by level, and a digest is stored once however often it occurs.

Proofs are found from the root downwards. A leaf's rank in base `fan` names the child to take on every level, and the
children not taken are the proof. Leaves below one node share the way to it, so a level is one join of as many rows as it has
nodes, and only the last one has a row per leaf, which is hashed where it arises. The segments of a way are
collected from the root on and reversed in the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.operators.ranking import ranked, same
from recurva.session import checkpointed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: each value as its number of bytes, a colon and its text, or `-` where it is NULL."""
    return digest(F.concat(*map(_framed, values)))


@dataclass(frozen=True)
class Tree:
    """Trees of one kind: `levels[i]` holds the records `digest, children` of level i + 1, `tops` a row `tree, top, depth` per tree."""

    levels: list[DataFrame]
    tops: DataFrame


@dataclass(frozen=True)
class Manifest:
    """`leaves` with rank and members per group, the trees of the groups, and the tree over their roots, `group_ranks`."""

    leaves: DataFrame
    groups: Tree
    roots: Tree
    group_ranks: DataFrame
    fan: int


def _grow(nodes: DataFrame, fan: int) -> Tree:
    """Trees over `tree, rank, members, digest`. Every level is written before the next is built from it."""
    levels, tops, depth = [], [], 0
    while True:
        tops.append(nodes.where("members = 1").select("tree", F.col("digest").alias("top"), F.lit(depth).alias("depth")))
        inner = nodes.where("members > 1")
        parent = F.floor(F.col("rank") / fan).cast("long")
        runs = inner.groupBy("tree", parent.alias("rank"), F.ceil(F.col("members") / fan).cast("long").alias("members")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run"))  # at most `fan`
        children = F.transform("run", lambda node: node["digest"])
        nodes = checkpointed(runs.withColumn("children", children).withColumn("digest", digest(F.array_join("children", ""))).drop("run"))
        if nodes.isEmpty():
            break
        depth += 1
        levels.append(nodes.select("digest", "children").dropDuplicates(["digest"]))
    found = tops[0]
    for part in tops[1:]:
        found = found.unionByName(part)
    return Tree(levels, checkpointed(found))


def build_manifest(df: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", fan: int = 8,
                   **carried: Column) -> Manifest:
    """The manifest of all rows of `df`. Leaves carry `group`, `order` and the columns named in `carried`.

    Groups follow each other by their UTF-8 bytes, and rows by `order`; NULL comes first in both. Rows with equal
    `order` follow by their digest, so that only equal rows tie. Repeated rows are leaves of their own. NULL values differ from
    empty texts. Texts of any length are hashed within their row. An empty table has no leaf and no root. Columns other than
    `fields` and `carried` play no part, whatever their names.
    """
    leaf = leaf_digest(*[F.col(f"`{f}`") for f in fields])
    rows = df.select(F.col(f"`{group}`").alias("tree"), F.col(f"`{order}`").alias("key"), leaf.alias("digest"),
                     *[c.alias(name) for name, c in carried.items()])
    leaves = checkpointed(ranked(rows, ["tree"], ["key", "digest"]))
    groups = _grow(leaves.select("tree", "rank", "members", "digest"), fan)
    ranks = checkpointed(ranked(groups.tops, [], ["tree"]))
    roots = _grow(ranks.select(F.lit(0).alias("tree"), "rank", "members", F.col("top").alias("digest")), fan)
    return Manifest(leaves, groups, roots, ranks.select("tree", "rank", "top", "depth"), fan)


def _segment(children: Column, place: Column) -> Column:
    """The children not taken, as the texts before and after the one that is."""
    return F.struct(F.array_join(F.slice(children, 1, place), "").alias("left"),
                    F.array_join(F.slice(children, place + 2, F.size(children)), "").alias("right"))


def _step(state: DataFrame, level: DataFrame, fan: int, *carried: str) -> DataFrame:
    """One level down: each node gives way to its children, which know the way that led to them."""
    met = state.join(level, "digest").select(*carried, "rank", "way", "children", F.posexplode("children").alias("place", "digest"))
    return met.select(*carried, (F.col("rank") * fan + F.col("place")).alias("rank"), "digest",
                      F.array_append("way", _segment(F.col("children"), F.col("place"))).alias("way"))


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The leaves, or those that share `tree` and `rank` with a row of `requests`, with `subroot`, `root` and `proof`.

    A proof lists, from the leaf to the root, the digests left and right of the way on every level.
    """
    fan, leaves = manifest.fan, manifest.leaves
    if requests is not None:
        asked = requests.select(F.col("tree").alias("__tree"), F.col("rank").alias("__rank")).distinct()
        leaves = leaves.join(asked, same([(F.col("tree"), F.col("__tree")), (F.col("rank"), F.col("__rank"))]), "left_semi")
    way = F.array().cast("array<struct<left:string,right:string>>")
    state = manifest.roots.tops.select(F.col("top").alias("root"), F.lit(0).cast("long").alias("rank"), F.col("top").alias("digest"), way.alias("way"))
    for level in reversed(manifest.roots.levels):
        state = _step(state, level, fan, "root")
    entered = checkpointed(state.select("root", "way", "rank").join(manifest.group_ranks, "rank").select(
        "root", "way", "tree", "depth", F.lit(0).cast("long").alias("rank"), F.col("top").alias("digest"), F.col("top").alias("subroot")))

    carried = ("tree", "root", "subroot")
    at = lambda depth: entered.where(F.col("depth") == depth).select(*carried, "rank", "digest", "way")
    alone = at(0).withColumn("children", F.array("digest"))
    state = None
    for depth in range(len(manifest.groups.levels), 0, -1):
        state = at(depth) if state is None else at(depth).unionByName(_step(state, manifest.groups.levels[depth], fan, *carried))
    if state is not None:
        lowest = state.join(manifest.groups.levels[0], "digest").select(*alone.columns)
        alone = alone.unionByName(lowest)
    # the last level: a leaf meets the node above it, named by all but the last digit of its rank
    above = alone.select(F.col("tree").alias("__tree"), F.col("rank").alias("__rank"), "root", "subroot", "way", "children")
    met = leaves.join(above, same([(F.col("tree"), F.col("__tree")), (F.floor(F.col("rank") / fan).cast("long"), F.col("__rank"))]))
    place = F.pmod("rank", F.lit(fan)).cast("int")
    whole = F.when(F.col("members") > 1, F.array_append("way", _segment(F.col("children"), place))).otherwise(F.col("way"))
    return met.withColumn("proof", F.reverse(whole)).drop("__tree", "__rank", "way", "children")


def proof_text(proof: Column) -> Column:
    """All digests of a proof, one after the other."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))
