"""Which documents a phrase comes from: adding, merging, finding and removing, on (id, documents) tables.

documents is ARRAY<STRUCT<id STRING, offsets ARRAY<ARRAY<INT>>>>; null counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENTS = "array<struct<id:string,offsets:array<array<int>>>>"


def _docs(col: str = "documents"):
    return F.coalesce(F.col(col), F.array().cast(DOCUMENTS))


def exploded(entries: DataFrame, key: str) -> DataFrame:
    """(key, document, offset): one row for each place; a null offset for documents without one."""
    rows = entries.select(key, F.explode("documents").alias("d")).where("d is not null and d.id is not null")
    return rows.select(key, F.col("d.id").alias("document"), F.explode_outer("d.offsets").alias("offset"))


def merged_rows(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, document, offsets): documents of both, one row for each, the offsets united without repeats and in order."""
    rows = exploded(existing, key).unionByName(exploded(new, key)).distinct()
    return rows.groupBy(key, "document").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))


def merged(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, documents): as merged_rows, the documents of a key nested in order of their ids, as the store keeps them."""
    out = merged_rows(existing, new, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("document").alias("id"), "offsets"))).alias("documents"))
    keys = existing.select(key).unionByName(new.select(key)).distinct()
    return keys.join(out, key, "left").select(key, _docs().cast(DOCUMENTS).alias("documents"))


def upserted(nodes: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, label, documents): new phrases are added; a known one takes the new documents unless it has one of them already."""
    both = nodes.select(key, "label", "documents").join(new.select(key, F.col("label").alias("_l"), F.col("documents").alias("_d")), key, "full_outer")
    overlap = F.arrays_overlap(F.transform(_docs(), lambda d: d["id"]), F.transform(_docs("_d"), lambda d: d["id"]))
    known = F.col("label").isNotNull() | F.col("documents").isNotNull()
    docs = F.when(~known, _docs("_d")).when(F.coalesce(overlap, F.lit(False)), _docs()).otherwise(F.concat(_docs(), _docs("_d")))
    return both.select(key, F.coalesce("label", "_l").alias("label"), docs.alias("documents"))


def holding(entries: DataFrame, document: str, key: str) -> DataFrame:
    """(key): entries that name *document*."""
    return entries.where(F.exists(_docs(), lambda d: d["id"] == document)).select(key)


def without(entries: DataFrame, document: str, drop_empty: bool = False) -> DataFrame:
    """*entries* without *document*; with *drop_empty* those that named it and no other fall out."""
    had = F.exists(_docs(), lambda d: d["id"] == document)
    rows = entries.withColumn("_had", had).withColumn("documents", F.filter(_docs(), lambda d: ~F.coalesce(d["id"] == document, F.lit(False))))
    return (rows.where(~(F.col("_had") & (F.size("documents") == 0))) if drop_empty else rows).drop("_had")


def removal_report(entries: DataFrame, document: str, group: str) -> DataFrame:
    """One row: references removed, entries left without documents, groups affected."""
    hit = F.exists(_docs(), lambda d: d["id"] == document)
    rest = F.size(F.filter(_docs(), lambda d: ~F.coalesce(d["id"] == document, F.lit(False))))
    n = F.size(F.filter(_docs(), lambda d: d["id"] == document))
    return entries.where(hit).agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("references_removed"), F.count_if(rest == 0).alias("nodes_removed"), F.countDistinct(group).alias("groups_affected"))


def inverted(entries: DataFrame, key: str) -> DataFrame:
    """(document, n_phrases, first_key, last_key) by document."""
    return exploded(entries, key).groupBy("document").agg(F.countDistinct(key).alias("n_phrases"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def edges_without(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose both ends are in *kept* (graph_id, node_id)."""
    a, b = kept.select("graph_id", F.col("node_id").alias("src")), kept.select("graph_id", F.col("node_id").alias("dst"))
    return edges.join(a, ["graph_id", "src"], "left_semi").join(b, ["graph_id", "dst"], "left_semi")


def folded_additions(results: DataFrame) -> DataFrame:
    """(phrase_id, graph_id, text, documents): one row for each phrase of added documents: its smallest graph and text, all documents by id."""
    by = results.groupBy("phrase_id").agg(F.min("graph_id").alias("graph_id"), F.min("text").alias("text"), F.sort_array(F.collect_set("document")).alias("documents"))
    return by
