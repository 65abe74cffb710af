"""The engine: every operation of the service as a method, without a web server."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewerk.operators import concepts as C
from phrasewerk.operators import expansion as E
from phrasewerk.operators import graph as G
from phrasewerk.operators import lines as L
from phrasewerk.operators import negation as N
from phrasewerk.operators import phrase_graphs as H
from phrasewerk.operators import phrases as P
from phrasewerk.operators import provenance as V
from phrasewerk.operators import rag as A
from phrasewerk.operators import retrieval as R
from phrasewerk.operators import vector_store as VS
from phrasewerk.operators.numbering import numbered
from phrasewerk.plans.pipeline import STEPS, Process, Step
from phrasewerk.sources import config as K
from phrasewerk.sources import readers
from phrasewerk.sources.store import ArtifactStore, Loader, written


@dataclass
class DataSettings:
    """How phrases are taken from documents."""

    case_sensitive: bool = False
    head_only: bool = False
    prepend_head: bool = False
    omit_negated_chunks: bool = True
    keep_unseen: bool = False
    negation: N.NegationConfig = field(default_factory=N.NegationConfig)
    min_df: int = 1
    max_df: float = 1.0
    stop: list | None = None


@dataclass
class EmbeddingSettings:
    dims: int = R.DIMS


@dataclass
class ClusteringSettings:
    algorithm: str = "kmeans"
    k: int | None = None
    detect: bool = False
    seed: int = 1


@dataclass
class Settings:
    """A process's settings, typed; unknown keys of a request are refused."""

    data: DataSettings = field(default_factory=DataSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    clustering: ClusteringSettings = field(default_factory=ClusteringSettings)
    graph: H.GraphSettings = field(default_factory=H.GraphSettings)

    @classmethod
    def of(cls, given: dict | None) -> Settings:
        kinds = {"data": DataSettings, "embedding": EmbeddingSettings, "clustering": ClusteringSettings, "graph": H.GraphSettings}
        out = {}
        for step, own in (given or {}).items():
            if step not in kinds or set(own) - {f.name for f in fields(kinds[step])}:
                raise ValueError(f"unknown settings of {step}: {', '.join(sorted(own))}")
            own = dict(own)
            if step == "data" and isinstance(own.get("negation"), dict):
                own["negation"] = N.NegationConfig.of(own["negation"])
            out[step] = kinds[step](**own)
        return cls(**out)


@dataclass
class EngineContext:
    """What an engine holds: its stores, and the processes and indexes that were opened."""

    store: ArtifactStore
    configs: K.ConfigStore
    running: dict[str, Process] = field(default_factory=dict)
    rags: dict[str, A.Rag] = field(default_factory=dict)
    loaders: dict[str, Loader] = field(default_factory=dict)


class PhraseEngine:
    """Processes under *root*: documents to phrases, vectors, clusters, graphs, answers."""

    def __init__(self, spark: SparkSession, root: str, encoder: R.Encoder = R.encoded, document_store: type = VS.VectorDocumentStore):
        self.spark, self.root, self.encoder, self.document_store = spark, root.rstrip("/"), encoder, document_store
        store = ArtifactStore(spark, root)
        self.context = EngineContext(store, K.ConfigStore(store))

    # the steps

    def phrases_of(self, documents: DataFrame, settings: DataSettings) -> DataFrame:
        """(phrase, doc_id, n, offsets) of documents (doc_id, text), ids as strings."""
        docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        lines = L.exploded_lines(docs, "doc_id", "text")
        chunks = P.clean_chunks(P.chunks_of(lines))
        if settings.omit_negated_chunks:
            terms = N.TermSet(settings.negation.terms).terms
            words = N.negated_words(lines, "doc_id", "line_no", terms=terms, scope=settings.negation.scope)
            chunks = N.negated_chunks(chunks, words)
            if settings.negation.prefixes:
                chunks = chunks.withColumn("negated", F.col("negated") | N.negated_prefix(F.col("chunk"), terms))
            chunks = P.skip_negated(chunks)
        found = P.occurrences(chunks, head_only=settings.head_only, prepend_head=settings.prepend_head, case_sensitive=settings.case_sensitive)
        if settings.min_df > 1 or settings.max_df < 1 or settings.stop:
            found = written(found, "found")
            kept = P.frequency_filter(P.phrase_table(found), docs.count(), settings.min_df, settings.max_df, settings.stop)
            found = P.allowed(found, kept)
        return P.provenance(found)

    def _data(self, documents: DataFrame, settings: DataSettings):
        def run(made: dict[str, DataFrame]) -> DataFrame:
            own = self.phrases_of(documents, settings)
            docs = F.struct(F.col("doc_id").alias("id"), F.transform("offsets", lambda o: F.array(o["b"].cast("int"), o["e"].cast("int"))).alias("offsets"))
            by = own.groupBy("phrase").agg(F.sort_array(F.collect_list(docs)).cast(V.DOCUMENTS).alias("documents"), F.sum("n").alias("n_occurrences"), F.min(F.struct("doc_id", F.col("offsets")[0]["b"].alias("b"))).alias("_first"))
            return numbered(by.select("phrase", "documents", "n_occurrences", F.col("_first.doc_id").alias("_d"), F.col("_first.b").alias("_b")), ["_d", "_b", "phrase"], "phrase_id").drop("_d", "_b")

        return run

    def _embedding(self, settings: EmbeddingSettings):
        def run(made: dict[str, DataFrame]) -> DataFrame:
            return self.vectors_of(made["data"].select("phrase_id", "phrase"), "phrase_id", settings.dims)

        return run

    def vectors_of(self, rows: DataFrame, key: str, dims: int) -> DataFrame:
        """(key, vector): the encoder's sparse vectors as arrays of *dims* values; texts without any have zeros."""
        sparse = self.encoder(rows.withColumnRenamed("phrase", "text"), key, "text")
        sparse = sparse.groupBy(key, (F.col("dim") % dims).alias("dim")).agg(F.sum("weight").alias("weight"))
        by = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("m"))  # at most dims entries
        dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at("m", d.cast(by.schema["m"].dataType.keyType)), F.lit(0.0)).cast("float"))
        return rows.select(key).join(by, key, "left").select(key, F.coalesce(dense, F.array_repeat(F.lit(0.0).cast("float"), dims)).alias("vector"))

    def _clustering(self, settings: ClusteringSettings):
        def run(made: dict[str, DataFrame]) -> DataFrame:
            rows, k = made["embedding"], settings.k
            if settings.detect:
                k = C.chosen_k(C.reduced(rows, "phrase_id", "vector", 8), "reduced", seed=settings.seed)
            return C.clustered(rows, "phrase_id", "vector", settings.algorithm, k, settings.seed)

        return run

    def _graph(self, settings: H.GraphSettings):
        def run(made: dict[str, DataFrame]) -> DataFrame:
            rows = made["clustering"].join(made["embedding"], "phrase_id").join(made["data"], "phrase_id")
            members = rows.select(F.col("cluster_id").cast("string").alias("graph_id"), F.col("phrase_id").alias("node_id"), F.col("phrase").alias("label"), F.col("vector").alias("embedding"), "documents")
            nodes, edges = H.concept_graphs(members, settings)
            none = lambda kind: F.lit(None).cast(kind)
            a = nodes.select("graph_no", F.col("node_id").alias("src"), none("long").alias("dst"), none("double").alias("weight"), "label", F.col("documents").cast(V.DOCUMENTS).alias("documents"))
            b = edges.select("graph_no", "src", "dst", "weight", none("string").alias("label"), none(V.DOCUMENTS).alias("documents"))
            return a.unionByName(b)

        return run

    def _integration(self, name: str):
        def run(made: dict[str, DataFrame]) -> DataFrame:
            """Phrases into the vector store, with the graphs that they are nodes of."""
            graphs = made["graph"].where("dst is null").groupBy(F.col("src").alias("phrase_id")).agg(F.transform(F.sort_array(F.collect_set("graph_no")), lambda g: g.cast("string")).alias("graph_cluster"))
            rows = made["data"].join(made["embedding"], "phrase_id").join(graphs, "phrase_id", "left")
            dim = rows.select(F.max(F.size("vector"))).first()[0] or 0
            store = VS.VectorStore(self.spark, self.root, f"{name}_vectors", VS.IndexSettings(dim=dim)).create()
            added, _ = store.store(rows.select(F.col("phrase_id").alias("nr"), "phrase", "vector", "graph_cluster", "documents", F.lit("pipeline").alias("source")))
            return added.withColumnRenamed("nr", "phrase_id")

        return run

    # POST /pipeline, GET /pipeline/configuration

    def run_pipeline(self, name: str, documents: DataFrame | str, config: dict | None = None, skip_present: bool = True, omit: str | list | None = None, wait: bool = True, language: str = "en") -> Process:
        """Runs the steps on documents (doc_id, text); a process that is running is refused."""
        running = self.context.running.get(name)
        if running and running._thread and running._thread.is_alive():
            raise RuntimeError(f"{name} is running")
        settings = Settings.of(config)
        docs = documents if isinstance(documents, DataFrame) else readers.read(self.spark, documents, {"name": "doc_id", "content": "text"})
        bodies = {"data": self._data(docs, settings.data), "embedding": self._embedding(settings.embedding), "clustering": self._clustering(settings.clustering), "graph": self._graph(settings.graph), "integration": self._integration(name)}
        process = Process(self.spark, name, self.context.store, [Step(s, bodies[s]) for s in STEPS])
        for step in STEPS[:4]:
            self.context.configs.save(name, step, {"language": K.language(language), **K.flattened(asdict(getattr(settings, step)), "n_process")})
        self.context.running[name] = process
        self.context.loaders.pop(name, None)
        thread = process.start(skip_present=skip_present, omit=K.omitted_steps(omit, STEPS))
        if wait:
            thread.join()
        return process

    def default_config(self, language: str = "en") -> dict:
        return {"name": "default", "language": K.language(language), "config": asdict(Settings())}

    def configuration(self, name: str) -> dict:
        return self.context.configs.all(name, STEPS)

    def _load(self, name: str, step: str) -> DataFrame:
        return self.context.loaders.setdefault(name, Loader(self.context.store, name)).load(step)

    # GET /preprocessing, /embedding, /clustering, /graph

    def phrases(self, name: str) -> DataFrame:
        return self._load(name, "data").select("phrase_id", "phrase", F.size("documents").alias("n_documents"), "n_occurrences")

    def corpus_statistics(self, name: str) -> DataFrame:
        """One row: documents with phrases, phrases."""
        data = self._load(name, "data")
        return data.agg(F.count("*").alias("n_phrases")).crossJoin(data.select(F.explode("documents.id").alias("d")).agg(F.countDistinct("d").alias("n_documents")))  # one row by one row

    def embedding_statistics(self, name: str) -> DataFrame:
        return self._load(name, "embedding").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))

    def concepts(self, name: str, top_k: int = 15, distance: float = 0.6) -> DataFrame:
        """(cluster_id, phrases): each concept's most typical phrases."""
        rows = self._load(name, "clustering").join(self._load(name, "embedding"), "phrase_id")
        near = C.near_centres(rows, C.centres(rows, "cluster_id", "vector"), "cluster_id", "phrase_id", "vector", distance)
        return C.concept_phrases(C.representatives(near, "cluster_id", "phrase_id", top_k), self._load(name, "data"), "cluster_id", "phrase_id", "phrase")

    def graph_tables(self, name: str) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a process's graphs, by graph_id from 0 on."""
        rows = self._load(name, "graph").withColumnRenamed("graph_no", "graph_id")
        return rows.where("dst is null").select("graph_id", F.col("src").alias("node_id"), "label", "documents"), rows.where("dst is not null").select("graph_id", "src", "dst", "weight")

    def graph_statistics(self, name: str) -> DataFrame:
        return G.statistics(*self.graph_tables(name))

    def graph(self, name: str, graph_id: int, draw: bool = False) -> DataFrame | str:
        """A graph's adjacency, or its drawing; an unknown number is an error."""
        nodes, edges = self.graph_tables(name)
        found = G.one_graph(nodes, edges, graph_id)
        return G.drawn(nodes, edges, graph_id) if draw else found

    # POST and DELETE /graph/document

    def _save_graphs(self, name: str, nodes: DataFrame, edges: DataFrame) -> None:
        none = lambda kind: F.lit(None).cast(kind)
        a = nodes.select(F.col("graph_id").alias("graph_no"), F.col("node_id").alias("src"), none("long").alias("dst"), none("double").alias("weight"), "label", F.col("documents").cast(V.DOCUMENTS).alias("documents"))
        b = edges.select(F.col("graph_id").alias("graph_no"), "src", "dst", "weight", none("string").alias("label"), none(V.DOCUMENTS).alias("documents"))
        self.context.store.save(written(a.unionByName(b), "graphs"), name, "graph")
        self.context.loaders.pop(name, None)

    def vector_store(self, name: str) -> VS.VectorStore:
        return VS.VectorStore.existing(self.spark, {"root": self.root, "name": f"{name}_vectors"})

    def add_documents(self, name: str, documents: DataFrame) -> dict[str, DataFrame]:
        """Takes documents (doc_id, text) into a process: phrases by its settings, duplicates retained, graphs predicted, nodes added. Needs the vector store."""
        store = self.vector_store(name)
        own = self.context.configs.read(name, "data")
        settings = Settings.of({"data": {k: v for k, v in own.items() if k in {f.name for f in fields(DataSettings)} - {"negation", "min_df", "max_df"}}}).data
        found = self.phrases_of(documents, settings)
        rows = written(numbered(found.select("phrase", "doc_id", F.transform("offsets", lambda o: F.array(o["b"].cast("int"), o["e"].cast("int"))).alias("offsets")), ["doc_id", "phrase"], "nr"), "additions")
        vectors = self.vectors_of(rows.select("nr", "phrase"), "nr", store.settings.dim)
        out = self.document_store(store).add_documents(rows.join(vectors, "nr").select("nr", F.col("doc_id").alias("document"), "phrase", "vector", "offsets"))
        placed = out["with_graph_added"].unionByName(out["with_graph_incorporated"])
        known = self._load(name, "integration").select("entry_id", "phrase_id")
        first = int(self._load(name, "data").agg(F.max("phrase_id")).first()[0] or 0) + 1
        ids = placed.join(known, "entry_id", "left").withColumn("node_id", F.coalesce("phrase_id", F.col("entry_id") + first))
        ids = ids.join(rows.select("nr", "offsets"), "nr")
        docs = F.collect_list(F.struct(F.col("document").alias("id"), "offsets"))
        new = ids.groupBy(F.col("graph").cast("long").alias("graph_id"), "node_id").agg(F.min("phrase").alias("label"), docs.cast(V.DOCUMENTS).alias("documents")).where("graph_id is not null")
        nodes, edges = self.graph_tables(name)
        key = F.struct(F.col("graph_id").cast("long").alias("graph_id"), "node_id").alias("key")
        merged = V.upserted(nodes.select(key, "label", "documents"), new.select(key, "label", "documents"), "key")
        self._save_graphs(name, merged.select("key.graph_id", "key.node_id", "label", "documents"), edges)
        return out

    def delete_document(self, name: str, document: str, remove_unreferenced_nodes: bool = True, delete_unreferenced_embeddings: bool = False) -> dict[str, int]:
        """Takes a document out of the vector store, if there is one, and out of the graphs; what was removed. A document that is nowhere is an error."""
        updated = deleted = 0
        try:
            a, b = self.vector_store(name).remove_provenance(document, delete_unreferenced_embeddings)
            updated, deleted = a.count(), b.count()
        except FileNotFoundError:
            pass
        nodes, edges = self.graph_tables(name)
        report = V.removal_report(nodes, document, "graph_id").first()
        if not report.references_removed and not updated:
            raise KeyError(document)
        if report.references_removed:
            kept = written(V.without(nodes, document, remove_unreferenced_nodes), "kept")
            self._save_graphs(name, kept, V.edges_without(edges, kept))
        return {"references_removed": report.references_removed, "nodes_removed": report.nodes_removed if remove_unreferenced_nodes else 0, "graphs_affected": report.groups_affected, "embeddings_updated": updated, "embeddings_deleted": deleted}

    # GET /processes, /status, stop, delete

    def processes(self) -> list[str]:
        """Processes with tables, and those that run."""
        path, fs = self.context.store._at("")
        there = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
        return sorted({p for p in there if set(self.context.store.steps(p)) & set(STEPS)} | set(self.context.running))

    def status(self, name: str) -> list[tuple[str, str, int, str]]:
        if name in self.context.running:
            return self.context.running[name].status_rows()
        done = self.context.store.steps(name)
        return [(name, s, i, "finished" if s in done else "pending") for i, s in enumerate(STEPS)]

    def stop(self, name: str, hard: bool = False) -> None:
        self.context.running[name].stop(hard)

    def delete(self, name: str) -> bool:
        """Waits for the process and deletes its tables and its vector store."""
        process = self.context.running.pop(name, None)
        if process and process._thread:
            process.stop()
            process._thread.join()
        self.context.loaders.pop(name, None)
        self.context.rags.pop(name, None)
        self.context.store.delete(f"{name}_vectors")
        return self.context.store.delete(name)

    # /status/document-server, /status/rag, /rag, /query-expansion

    def source_reachable(self, config: dict) -> bool:
        return readers.server_reachable(K.server(config)) is not None

    def rag_init(self, name: str, documents: DataFrame, chatter: A.Chatter | None = None, language: str = "en", config: dict | None = None, force: bool = False, store: A.ChunkStore | None = None) -> str:
        """Fills the chunk index of a process from documents (doc_id, name, text); its state."""
        own = store or A.TableChunkStore(self.spark, self.root, f"{name}_chunks", self.encoder)
        self.context.rags[name] = A.Rag.of(own, chatter, language, config)
        return self.context.rags[name].fill(documents, force)

    def rag_status(self, name: str) -> str:
        return self.context.rags[name].state if name in self.context.rags else A.NEW

    def ask(self, name: str, questions: DataFrame, doc_ids: list[str] | None = None, limit: int = 15) -> DataFrame:
        """(question, answer, error, n_sources) for questions (question, q_text)."""
        ids = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string") if doc_ids else None
        return self.context.rags[name].ask(questions, ids, limit)

    def expand(self, request: E.Request, generator: E.CandidateGenerator, profile: dict | None = None, terms: list[DataFrame] | None = None) -> DataFrame:
        return E.expanded(self.spark, request, E.generated(self.spark, request, generator, profile), terms)
