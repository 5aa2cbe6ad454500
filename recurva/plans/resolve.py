"""Entity resolution from records to entities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurva.operators import clustering, golden
from recurva.operators.blocking import STRATEGIES, Strategy, latest_records, with_source
from recurva.operators.matching import (
    DOMAIN_ONLY_BEST, MATCH_THRESHOLD, TILE_ROWS, match_links, match_nodes, match_pairs, needed_tiles, record_profiles, similar_names,
)
from recurva.session import checkpointed


@dataclass(frozen=True)
class Resolution:
    """`entities` has one row per entity, `lineage` one per record, `pairs` one per match."""

    entities: DataFrame
    lineage: DataFrame
    clusters: DataFrame
    pairs: DataFrame

    def counters(self) -> DataFrame:
        """Entities, clusters, sources and records in one row."""
        one = F.lit(1).alias("one")
        per_entity = self.lineage.agg(
            F.count_distinct("entity_id").alias("entity_count"), F.count_distinct("source_type").alias("source_count"),
            F.count(F.lit(1)).alias("record_count"), one)
        found = self.clusters.agg(F.count(F.lit(1)).alias("clusters_found"), one)
        return per_entity.join(found, "one").drop("one")


def resolve_entities(records: DataFrame, threshold: float = MATCH_THRESHOLD, source_order: Sequence[str] = (),
                     unique_ids: bool = False, tile_rows: int = TILE_ROWS, strategies: Sequence[Strategy] = STRATEGIES) -> Resolution:
    """Find the records of different sources that are one entity and merge them.

    Records in no cluster stay as entities of their own; with a single source that is all of them. Say
    `unique_ids` where every (source, id) occurs once, to save the pass that keeps the newest copy. Only records that
    share a key under one of `strategies` can match. Sources whose records differ in their fields can be handed in as
    `envelope.unite` returns them.

    The records without their older copies, the narrow matching columns, the similar names and the members are
    checkpointed, as several steps read them; the list of matches is not: clusters come from links, and the scores go
    straight into the confidence of each cluster.
    """
    latest = with_source(records) if unique_ids else checkpointed(latest_records(records))
    profiles = checkpointed(record_profiles(latest, source_order, strategies))
    nodes = checkpointed(match_nodes(profiles))
    if threshold > DOMAIN_ONLY_BEST:
        tiles = needed_tiles(nodes, tile_rows)
        names = checkpointed(similar_names(nodes, tiles))
        links = match_links(nodes, names, threshold, tiles)
    else:
        tiles, names = tile_rows, None
        links = match_pairs(nodes, threshold, tiles)
    components = clustering.connected_components(links, "a_node", "b_node")
    placed = checkpointed(nodes.join(components, "node"))
    pairs = match_pairs(placed, threshold, tiles, names)
    confidence = checkpointed(clustering.cluster_confidence(pairs, components))
    members = checkpointed(clustering.cluster_members(profiles, nodes, components))
    merged = golden.golden_records(members, latest, confidence)
    return Resolution(
        entities=merged.unionByName(golden.unmatched_records(latest, members)),
        lineage=golden.lineage(members, profiles),
        clusters=confidence,
        pairs=pairs.drop("a_cluster_id"),
    )
