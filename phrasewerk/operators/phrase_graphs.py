"""Phrase graphs from clusters, end to end: select, merge, weigh, prune, unroll, annotate.

All graphs are one pair of tables, nodes (graph_id, node_id, label, documents, ...) and edges (graph_id, src, dst,
weight, ...), so every step works on all of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewerk.functions import vectors as VF
from phrasewerk.operators import concepts as C
from phrasewerk.operators import graph as G
from phrasewerk.operators import pairs as R
from phrasewerk.operators import provenance as V
from phrasewerk.operators import whole_graphs as W
from phrasewerk.operators.numbering import numbered
from phrasewerk.sources.store import written


@dataclass
class GraphSettings:
    """How graphs are made from clusters; the values of a step's defaults."""

    cluster_distance: float = 0.6
    cluster_min_size: int = 1
    cluster_exclusion_ids: list | None = None
    graph_cosine_weight: float = 0.5
    graph_merge_threshold: float = 0.95
    graph_weight_cut_off: float = 0.5
    graph_simplify: float = 0.5
    graph_simplify_alg: str = "weight"
    graph_unroll: bool = True
    graph_sub_clustering: float | None = None
    restrict_to_cluster: bool = True

    def __post_init__(self) -> None:
        if self.graph_simplify_alg not in ("weight", "significance"):
            raise ValueError(f"graphs are simplified by weight or significance, not by {self.graph_simplify_alg}")


def selected(members: DataFrame, settings: GraphSettings) -> DataFrame:
    """The members (graph_id, node_id, embedding, ...) near the centre of their cluster, without excluded and small clusters.

    With *restrict_to_cluster* off every phrase joins each cluster whose centre is near; the other columns go along.
    """
    rows = members.where(VF.usable(F.col("embedding")))
    centre = C.centres(rows, "graph_id", "embedding")
    if settings.restrict_to_cluster:
        near = C.near_own_centre(rows, centre, "graph_id", "embedding", settings.cluster_distance).drop("cosine")
    else:
        each = rows.drop("graph_id").dropDuplicates(["node_id"])
        near = C.near_centres(each, centre, "graph_id", "node_id", "embedding", settings.cluster_distance).select("graph_id", "node_id").join(each, "node_id")
    if settings.cluster_exclusion_ids:
        near = near.where(~F.col("graph_id").isin(settings.cluster_exclusion_ids))
    sizes = near.groupBy("graph_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= settings.cluster_min_size).select("graph_id")
    return near.join(sizes, "graph_id", "left_semi")


def merged(members: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(members that stay, with the documents of those merged into them; (graph_id, removed, kept))."""
    members = written(members, "members")
    stay, gone = _staying(members, threshold)
    return _handed(members, stay, gone), gone


def _staying(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members that stay as they are; (graph_id, removed, kept))."""
    sized = members.select("graph_id", "node_id", F.coalesce(F.size(V._docs()), F.lit(0)).alias("n_documents"))
    similar = written(R.close_labels(members.select("graph_id", "node_id", "label"), threshold, "node_id", "graph_id"), "similar")
    gone = R.merged_phrases(similar, sized)
    return members.join(gone.select("graph_id", F.col("removed").alias("node_id")), ["graph_id", "node_id"], "left_anti"), gone


def _handed(members: DataFrame, stay: DataFrame, gone: DataFrame) -> DataFrame:
    """*stay* with the documents of the members that are gone."""
    handed = members.select("graph_id", F.col("node_id").alias("removed"), "documents").join(gone, ["graph_id", "removed"])
    key = lambda rows, node: rows.select(F.struct("graph_id", F.col(node).alias("node_id")).alias("key"), "documents")
    taking = stay.join(gone.select("graph_id", F.col("kept").alias("node_id")).distinct(), ["graph_id", "node_id"], "left_semi")
    more = V.merged(key(taking, "node_id"), key(handed, "kept"), "key").select("key.graph_id", "key.node_id", F.col("documents").alias("_more"))
    return stay.join(more, ["graph_id", "node_id"], "left").withColumn("documents", F.coalesce("_more", "documents")).drop("_more")


def built(members: DataFrame, settings: GraphSettings) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): near-duplicate labels merged, every pair of what stays weighed, edges from the cut-off on. Nodes without edges stay."""
    nodes, _ = merged(members, settings.graph_merge_threshold)
    return _weighed(written(nodes, "nodes"), settings)


def _weighed(nodes: DataFrame, settings: GraphSettings) -> tuple[DataFrame, DataFrame]:
    edges = R.weighted_pairs(nodes, settings.graph_cosine_weight, settings.graph_weight_cut_off, "node_id", "graph_id", "embedding")
    return nodes.drop("embedding"), written(edges, "edges")


def post_processed(nodes: DataFrame, edges: DataFrame, settings: GraphSettings) -> tuple[DataFrame, DataFrame]:
    """Significances if edges go by them, simplified, unrolled (then simplified again by weight), sub-clusters if both are asked for; graphs without edges fall out."""
    if settings.graph_simplify_alg == "significance":
        edges = written(G.significances(edges), "significances")
    whole, reference = nodes, edges
    if 0 < settings.graph_simplify < 1:
        nodes, edges = G.simplified(nodes, edges, settings.graph_simplify, settings.graph_simplify_alg)
    if settings.graph_unroll:
        nodes, edges = G.unrolled(written(nodes, "nodes"), written(edges, "edges"), reference)
        if settings.graph_sub_clustering is not None:
            nodes, edges = G.sub_clusters(written(nodes, "nodes"), written(edges, "edges"), reference, settings.graph_sub_clustering)
    edges = written(edges, "edges")
    return nodes.join(edges.select("graph_id").distinct(), "graph_id", "left_semi"), edges


def _trees(members: DataFrame, settings: GraphSettings) -> tuple[DataFrame, DataFrame]:
    """As built and post_processed for graphs that are unrolled without sub-clusters: those of up to WHOLE nodes are made in a task each, from which only trees come."""
    members = written(members, "members")
    stay, gone = _staying(members, settings.graph_merge_threshold)
    nodes = _handed(members, stay, gone)
    large = [r.graph_id for r in stay.groupBy("graph_id").count().where(F.col("count") > W.WHOLE).collect()]  # fewer than a row in WHOLE
    fits = ~F.col("graph_id").isin(large) if large else F.lit(True)
    edges = written(W.trees(stay.where(fits), settings.graph_cosine_weight, settings.graph_weight_cut_off, settings.graph_simplify, settings.graph_simplify_alg), "edges")
    linked = G.mirrored(edges).select("graph_id", F.col("node").alias("node_id")).distinct()
    own = nodes.where(fits).drop("embedding").join(linked, ["graph_id", "node_id"], "left_semi")
    if not large:
        return own, edges
    more, further = post_processed(*_weighed(written(nodes.where(~fits), "nodes"), settings), settings)
    return own.unionByName(more), edges.unionByName(further)


def concept_graphs(members: DataFrame, settings: GraphSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all graphs, from clusters (graph_id, node_id, label, embedding, documents), with graph_no from 0 on in order of graph_id."""
    settings = settings or GraphSettings()
    members = selected(members, settings)
    if settings.graph_unroll and settings.graph_sub_clustering is None and settings.graph_weight_cut_off > 0:
        nodes, edges = _trees(members, settings)
    else:
        nodes, edges = post_processed(*built(members, settings), settings)
    nos = numbered(edges.select("graph_id").distinct(), ["graph_id"], "graph_no")
    return nodes.join(nos, "graph_id"), edges.join(nos, "graph_id")


def document_concepts(nodes: DataFrame, edges: DataFrame, weights: DataFrame, tolerance: float = 1e-6, normalise: bool = False) -> DataFrame:
    """(document, graph_id, score): the document-concept matrix as a long table, by the PageRank of documents linked to their phrases.

    *weights* (graph_id, document, node_id, weight) has the scaled TF-IDF of each phrase in each document; documents
    are numbers. Links to phrases that are in no graph fall out.
    """
    links = weights.join(nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
    return G.page_rank_scores(nodes, edges, written(links, "links"), tolerance=tolerance, normalise=normalise)
