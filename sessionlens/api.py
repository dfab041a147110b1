"""The engine's public calls: what a user of the command line or of the tool server runs.

Store tables are DataFrames in a dict by name (see sessionlens.sources.tables); every call returns a DataFrame or,
for tools, its rows as JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions import text as T
from sessionlens.operators import cluster, entities, graph, postings, retrieval, vector_index
from sessionlens.operators.seams import Embedder, HashedWords

Store = dict[str, DataFrame]


class Engine:
    """Search, graph, clustering and upkeep over a store."""

    def __init__(self, store: Store, embedder: Embedder | None = None, chunk_index: str | None = None) -> None:
        """chunk_index: a folder that `index_chunks` wrote for the store's records."""
        self.store = store
        self.chunk_index = chunk_index
        self.embedder = embedder or HashedWords()

    def _vector(self, query: str) -> list[float]:
        return self.embedder.embed_batch([query[:2000]])[0]

    def recall(self, query: str, top_k: int = 5, memory_type: str | None = None, workspace: str | None = None, include_graph: bool = False, method: str = "hybrid", metric: str = "l2") -> DataFrame:
        """Memories for a query: filtered first (type, workspace, not superseded), then both legs, then fusion."""
        m = self.store["memories"].where(~F.col("status").eqNullSafe("superseded"))
        if memory_type:
            m = m.where(F.col("memory_type") == memory_type)
        if workspace:
            m = m.where(T.like_literal(F.col("workspace_id"), workspace))
        vec = self.store["memory_embeddings"].join(m.select("id"), "id", "left_semi")
        top = retrieval.hybrid(m, vec, "id", "content", "embedding", query, self._vector(query), top_k, metric=metric, method=method)
        out = m.join(top, "id").select("id", "content", "memory_type", F.round("score", 6).alias("score"))
        if not include_graph:
            return out.orderBy(F.desc("score"), "id")
        seeds = out.orderBy(F.desc("score"), "id").limit(3).collect()
        for s in seeds:
            found = self.graph_walk(s["id"], depth=1).select(F.col("memory_id").alias("id"))
            more = self.store["memories"].join(found, "id").select("id", "content", "memory_type", F.lit(s["score"] * retrieval.DECAY).alias("score"))
            out = out.unionByName(more.join(out.select("id"), "id", "left_anti"))
        return out.orderBy(F.desc("score"), "id")

    def index_chunks(self, folder: str) -> None:
        """Index the chunks that `folder` doesn't have yet: their postings, and their vectors by l2 with the session.

        Searches by l2 read the index from then on, as long as it has all chunks; after more of them came, index again.
        """
        r = self.store["records"]
        spark = r.sparkSession
        there = f"{folder}/ids"
        at = spark._jvm.org.apache.hadoop.fs.Path(there)
        old = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        new = r.join(spark.read.parquet(there), "id", "left_anti") if old else r
        vec = self.store["record_embeddings"].join(new.select("id", "session_id"), "id").select("id", "session_id", "embedding")
        if not old:
            postings.written(new, "id", "chunk_text", folder)
            vector_index.written(vec, "id", "embedding", f"{folder}/vectors", keep=["session_id"])
        elif not new.isEmpty():
            postings.added(new, "id", "chunk_text", folder)
            vector_index.added(vec, "embedding", f"{folder}/vectors")
        new.select("id").write.mode("append").parquet(there)
        self.chunk_index = folder

    def _indexed(self) -> bool:
        """Does the index have every chunk of the store?"""
        if not self.chunk_index:
            return False
        r = self.store["records"]
        return r.sparkSession.read.parquet(f"{self.chunk_index}/ids").count() == r.count()

    def chunk_search(self, query: str, top_k: int = 10, session: str | None = None, include_graph: bool = False, method: str = "hybrid", metric: str = "l2") -> DataFrame:
        r = self.store["records"]
        if session:
            r = r.where(F.col("session_id").startswith(session))
        vec = self.store["record_embeddings"].join(r.select("id"), "id", "left_semi")
        lexical = semantic = None
        if self._indexed():
            if not session and method != "semantic":
                lexical = postings.bm25(r.sparkSession, self.chunk_index, "id", query, 5 * top_k)
            if metric == "l2" and method != "lexical":
                where = F.col("session_id").startswith(session) if session else None
                semantic = vector_index.Index(r.sparkSession, f"{self.chunk_index}/vectors").knn(self._vector(query), 5 * top_k, where)
        top = retrieval.hybrid(r, vec, "id", "chunk_text", "embedding", query, self._vector(query), top_k, metric=metric, method=method, lexical=lexical, semantic=semantic)
        out = r.join(top, "id").select("id", "session_id", "chunk_index", F.left("chunk_text", F.lit(500)).alias("chunk_text"), F.round("score", 6).alias("score"))
        if not include_graph:
            return out.orderBy(F.desc("score"), "id")
        for s in out.orderBy(F.desc("score"), "id").limit(3).collect():
            found = retrieval.chunk_expansion(self.store["occurrences"], s["id"], s["score"]).withColumnRenamed("record_id", "id")
            more = self.store["records"].join(found, "id").select("id", "session_id", "chunk_index", F.left("chunk_text", F.lit(500)).alias("chunk_text"), "score")
            out = out.unionByName(more.join(out.select("id"), "id", "left_anti"))
        return out.orderBy(F.desc("score"), "id")

    def graph_walk(self, memory_id: str, depth: int = 2) -> DataFrame:
        m = self.store["memories"].select(F.col("id").alias("memory_id"), F.col("evidence_count").alias("evidence"), F.col("access_count").alias("access"))
        return retrieval.graph_walk(self.store["session_graph_edges"], self.store["memory_sources"], m, memory_id, depth)

    def tool(self, name: str, **args) -> list[str]:
        """A tool call's rows as JSON text; what comes back is as long as the call's own top_k."""
        calls = {"recall": self.recall, "chunk_search": self.chunk_search, "graph_walk": self.graph_walk}
        df = calls[name](**args)
        return [r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect()]

    def stats(self) -> DataFrame:
        out = None
        for name, df in self.store.items():
            row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
            out = row if out is None else out.unionByName(row)
        return out

    def recalculated_confidence(self) -> DataFrame:
        e = self.store["entities"].select(F.col("id").alias("entity_id"), "confidence")
        return entities.confidence_after(self.store["occurrences"], e)

    def dropped_session(self, session_id: str) -> Store:
        """The store without a session: its rows, memories and entities left without any source, recounted degrees."""
        gone = F.col("session_id") == session_id
        s = dict(self.store)
        for name in ("records", "occurrences", "memory_sources", "step_scores", "critical_steps", "session_inflections"):
            if name in s:
                s[name] = s[name].where(~gone)
        s["sessions"] = s["sessions"].where(F.col("id") != session_id)
        s["session_graph_edges"] = s["session_graph_edges"].where((F.col("src") != session_id) & (F.col("tgt") != session_id))
        had = self.store["memory_sources"].select(F.col("memory_id").alias("id")).distinct()
        has = s["memory_sources"].select(F.col("memory_id").alias("id")).distinct()
        s["memories"] = s["memories"].join(had.join(has, "id", "left_anti"), "id", "left_anti")
        degree = s["occurrences"].groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("session_id").alias("__d"))
        s["entities"] = s["entities"].join(degree, "id").withColumn("degree_count", F.col("__d")).drop("__d")
        return s

    def clustered_sessions(self, least: int = 3) -> DataFrame:
        return cluster.session_types(cluster.clustered(self.store["session_structural_embeddings"], "id", "embedding", least))

    def similarity_edges(self, top_k: int = 8, least: float = 0.5) -> DataFrame:
        e = graph.similarity_edges(self.store["session_structural_embeddings"], "id", "embedding", top_k, least)
        return e.withColumn("edge_type", F.lit("structural_similarity"))
