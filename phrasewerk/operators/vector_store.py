"""A store of phrase vectors: a versioned table (entry_id, phrase, vector, graph_cluster, documents, source).

Every change writes a new version beside the old one and then names it the present one, so an interrupted change leaves
the store as it was, and a reader keeps the version it began with.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewerk.functions import vectors as VF
from phrasewerk.operators import concepts as C
from phrasewerk.operators import provenance as V
from phrasewerk.operators.numbering import numbered
from phrasewerk.sources.store import ArtifactStore, written

ENTRY = f"entry_id long, phrase string, vector array<float>, graph_cluster array<string>, documents {V.DOCUMENTS}, source string"
#: Rows of one side of a block of pairs.
BLOCK = 2_000


@dataclass
class IndexSettings:
    """What a store's table is made for; vectors are kept as given."""

    dim: int = 768
    normalise: bool = False
    updatable: bool = True


class EmbeddingStore(Protocol):
    """What a document store needs of a vector store."""

    def entries(self) -> DataFrame: ...

    def store(self, rows: DataFrame, check_for_same: bool = False) -> tuple[DataFrame, DataFrame]: ...

    def update(self, changes: DataFrame) -> None: ...

    def delete(self, ids: DataFrame) -> None: ...


class DocumentStore(Protocol):
    """Adds documents given as (document, phrase, vector, offsets)."""

    def add_documents(self, rows: DataFrame) -> dict[str, DataFrame]: ...


def _cells(rows: DataFrame, group: str, side: str, sizes: DataFrame) -> DataFrame:
    """Rows of one side once for each block of the other side of their group."""
    mine, other = ("i", "j") if side == "a" else ("j", "i")
    both = rows.join(sizes, group).withColumn(mine, F.pmod(F.xxhash64("id"), F.col(f"n{side}")).cast("int"))
    return both.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("nb" if side == "a" else "na") - 1))).select(group, "i", "j", F.lit(side).alias("side"), "id", "v")


def duplicates(asks: DataFrame, rows: DataFrame, least: float = 0.999, group: str | None = None) -> DataFrame:
    """(ask, entry_id, cosine): rows (entry_id, v) whose cosine to an asking row (ask, v) is at least *least*, itself left out.

    Exact, in blocks of both sides within the *group* (all rows, if None), so no task holds more than a block of each.
    """
    group = group or "_g"
    side = lambda df, key: (df if group in df.columns else df.withColumn(group, F.lit(0))).where(VF.usable(F.col("v")) & F.col(key).isNotNull()).select(group, F.col(key).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).dropDuplicates([group, "id"])
    a, b = side(asks, "ask"), side(rows, "entry_id")
    count = lambda df, name: df.groupBy(group).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    sizes = written(count(a, "na").join(count(b, "nb"), group), "sizes")
    cells = _cells(a, group, "a", sizes).unionByName(_cells(b, group, "b", sizes))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"ask": [], "entry_id": [], "cosine": []})]
        for _, part in pdf.groupby(pdf["v"].map(len)):
            x = np.stack(part["v"].to_numpy())
            x = x / np.sqrt((x * x).sum(1))[:, None]
            ids, first = part["id"].to_numpy(), (part["side"] == "a").to_numpy()
            s = x[first] @ x[~first].T
            i, j = np.nonzero((s >= least - 1e-12) & (ids[first][:, None] != ids[~first][None, :]))
            out.append(pd.DataFrame({"ask": ids[first][i], "entry_id": ids[~first][j], "cosine": s[i, j]}))
        return pd.concat(out[1:] or out)

    return cells.groupBy(group, "i", "j").applyInPandas(meet, "ask long, entry_id long, cosine double")


class VectorStore:
    """The versioned table under *root*/*name*."""

    def __init__(self, spark: SparkSession, root: str, name: str = "vectors", settings: IndexSettings | None = None):
        self.spark, self.store_of, self.name = spark, ArtifactStore(spark, root), name
        self.settings = settings or IndexSettings()

    @classmethod
    def existing(cls, spark: SparkSession, config: dict) -> VectorStore:
        """Attaches to the store of a configuration {root, name}; one that is not there is an error."""
        own = cls(spark, config["root"], config.get("name", "vectors"))
        if not own.is_accessible():
            raise FileNotFoundError(f"no store {own.name} under {config['root']}")
        own.settings = IndexSettings(**own.store_of.properties(own.name))
        return own

    def is_accessible(self) -> bool:
        return self.store_of.present(self.name) is not None

    def create(self) -> VectorStore:
        """An empty store; one that is there is replaced."""
        self._put(self.spark.createDataFrame([], ENTRY))
        self.store_of.set_properties(self.name, asdict(self.settings))
        return self

    def entries(self) -> DataFrame:
        return self.store_of.read_present(self.name)

    def size(self) -> int:
        return self.entries().count()

    def _put(self, rows: DataFrame) -> None:
        self.store_of.put(rows, self.name)

    def read_back(self, ids: list[int] | None = None) -> DataFrame:
        """(entry_id, vector) of some ids, or of all, in order."""
        rows = self.entries() if ids is None else self.entries().where(F.col("entry_id").isin(ids))
        return rows.select("entry_id", "vector").orderBy("entry_id")

    def _numbered(self, rows: DataFrame, order: str) -> DataFrame:
        first = (self.entries().agg(F.max("entry_id")).first()[0] if self.is_accessible() else None)
        return numbered(rows, [order], "entry_id", 0 if first is None else int(first) + 1)

    def store(self, rows: DataFrame, check_for_same: bool = False, least: float = 0.999) -> tuple[DataFrame, DataFrame]:
        """Appends rows (nr, phrase, vector; graph_cluster, documents, source if there) with ids behind the largest, in order of nr.

        (added (nr, entry_id), retained (nr, entry_id)): with *check_for_same* a row of cosine *least* or more to a
        stored one is not stored; the smallest such entry stands for it. Vectors of another length are refused.
        """
        if not rows.where(F.col("vector").isNotNull() & (F.size("vector") != self.settings.dim)).isEmpty():
            raise ValueError(f"vectors of {self.settings.dim} values are needed")
        retained = self.spark.createDataFrame([], "nr long, entry_id long")
        if check_for_same:
            same = duplicates(rows.select((-F.col("nr") - 1).alias("ask"), F.col("vector").alias("v")), self.entries().select("entry_id", F.col("vector").alias("v")), least)
            retained = written(same.groupBy((-F.col("ask") - 1).alias("nr")).agg(F.min("entry_id").alias("entry_id")), "retained")
        fresh = written(self._numbered(rows.join(retained.select("nr"), "nr", "left_anti"), "nr"), "fresh")
        kinds = {f.name: f.dataType.simpleString() for f in self.entries().schema}
        whole = fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        self._put(self.entries().unionByName(whole))
        return fresh.select("nr", "entry_id"), retained

    def update(self, changes: DataFrame) -> None:
        """Puts the columns of *changes* (entry_id, ...) in place of the stored ones; unknown ids are passed over."""
        new = changes.dropDuplicates(["entry_id"]).select("entry_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != "entry_id"])
        rows = self.entries().join(new, "entry_id", "left")
        pick = lambda c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c != "entry_id" else F.col(c)
        self._put(rows.select(*[pick(c) for c in self.entries().columns]))

    def delete(self, ids: DataFrame) -> None:
        """Deletes the entries of *ids* (entry_id)."""
        self._put(self.entries().join(ids.select("entry_id").distinct(), "entry_id", "left_anti"))

    def add_provenance(self, new: DataFrame) -> None:
        """Unites documents (entry_id, documents) with those of the entries; unknown ids are passed over."""
        known = new.join(self.entries().select("entry_id"), "entry_id", "left_semi")
        touched = self.entries().join(known.select("entry_id").distinct(), "entry_id", "left_semi")
        self.update(written(V.merged(touched.select("entry_id", "documents"), known, "entry_id"), "provenance"))

    def entries_of(self, document: str) -> DataFrame:
        """(entry_id): all entries that name a document, wherever their ids lie."""
        return V.holding(self.entries(), document, "entry_id")

    def remove_provenance(self, document: str, delete_unreferenced: bool = False, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(updated (entry_id), deleted (entry_id)): takes a document out of its entries (or those of *ids*); entries that named no other go if asked for. Deleted ids are among the updated ones."""
        held = self.entries_of(document)
        held = written(held if ids is None else held.join(ids, "entry_id", "left_semi"), "held")
        mine = self.entries().join(held, "entry_id", "left_semi")
        left = V.without(mine, document, delete_unreferenced)
        deleted = written(held.join(left.select("entry_id"), "entry_id", "left_anti"), "deleted")
        self._put(self.entries().join(held, "entry_id", "left_anti").unionByName(left.select(*self.entries().columns)))
        return held, deleted

    def best_graphs(self, asks: DataFrame, share: float = 0.5, k: int = 10) -> DataFrame:
        """(entry_id, graph, fused): the best graph of stored entries by their *k* nearest neighbours."""
        rows = self.entries().withColumn("_all", F.lit(0))
        near = C.nearest(rows, rows.join(asks.select("entry_id"), "entry_id", "left_semi"), "entry_id", "vector", "_all", k)
        return C.best_graph(C.predicted_graphs(near, self.entries(), "entry_id", "other", share), "entry_id")


class VectorDocumentStore:
    """Adds documents to a vector store: duplicates retained, provenance written, graphs predicted for what is new."""

    def __init__(self, store: VectorStore):
        self.store = store

    def add_documents(self, rows: DataFrame, least: float = 0.999) -> dict[str, DataFrame]:
        """Adds phrases (nr, document, phrase, vector, offsets), all documents in one pass.

        Tables (nr, document, phrase, entry_id[, graph]): with_graph_added, with_graph_incorporated,
        without_graph_added, without_graph_incorporated. Equal vectors within one call are each added.
        """
        rows = written(rows, "additions")
        docs = F.array(F.struct(F.col("document").cast("string").alias("id"), F.coalesce("offsets", F.array().cast("array<array<int>>")).alias("offsets"))).cast(V.DOCUMENTS)
        added, retained = self.store.store(rows.select("nr", "phrase", "vector", docs.alias("documents"), F.lit("document_addition").alias("source")), True, least)
        added = written(added, "added")
        own = rows.select("nr", "document", "phrase", docs.alias("documents"))
        back = retained.join(own, "nr")
        if not retained.isEmpty():
            each = back.select("entry_id", F.explode("documents").alias("d")).groupBy("entry_id", F.col("d.id").alias("id")).agg(F.flatten(F.collect_list("d.offsets")).alias("offsets"))
            self.store.add_provenance(written(each.groupBy("entry_id").agg(F.collect_list(F.struct("id", "offsets")).cast(V.DOCUMENTS).alias("documents")), "retained"))
        best = written(self.store.best_graphs(added), "graphs")
        self.store.update(best.select("entry_id", F.array("graph").alias("graph_cluster")))
        new = added.join(own.drop("documents"), "nr").join(best.select("entry_id", "graph"), "entry_id", "left")
        known = self.store.entries().select("entry_id", F.get("graph_cluster", F.lit(0)).alias("graph"))
        old = back.drop("documents").join(known, "entry_id", "left")
        cols = ["nr", "document", "phrase", "entry_id", "graph"]
        return {
            "with_graph_added": new.where("graph is not null").select(*cols), "with_graph_incorporated": old.where("graph is not null").select(*cols),
            "without_graph_added": new.where("graph is null").select(*cols[:4]), "without_graph_incorporated": old.where("graph is null").select(*cols[:4]),
        }


def embedding_rows(phrases: DataFrame, vectors: DataFrame, key: str = "phrase_id") -> DataFrame:
    """(nr, document, phrase, vector, offsets): one row for each document of a phrase, with its vector."""
    each = phrases.join(vectors, key).select(key, "phrase", "vector", F.explode("documents").alias("d")).where("d.id is not null")
    return numbered(each.select(F.col("d.id").alias("document"), "phrase", "vector", F.col("d.offsets").alias("offsets"), key).dropDuplicates(["document", key]), ["document", key], "nr").drop(key)
