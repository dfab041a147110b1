"""Retrieval, graph and clustering queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionlens.functions import text as T
from sessionlens.functions import vectors as V
from sessionlens.operators import cluster as C
from sessionlens.operators import communities as M
from sessionlens.operators import graph as G
from sessionlens.operators import postings as P
from sessionlens.operators import retrieval as R
from sessionlens.operators import similarity as S
from sessionlens.operators import vector_index as X
from sessionlens.plans import standing
from sessionlens.plans.registry import add

QUERY = "the threa ouen inor of nting"
SEED_VECTOR = 3
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = f"regexp_extract_all({LOWER}, '[a-z0-9\\x{{{{80}}}}-\\x{{{{ffff}}}}]+')"
TERMS = T.query_terms(QUERY)


def _bm25_sql(source: str, key: str, text: str, limit: int) -> str:
    """BM25 in SQL over a relation: (key, score)."""
    toks = TOKENS.format(text).replace("{{", "{").replace("}}", "}")
    terms = ", ".join(f"'{t}'" for t in TERMS)
    return f"""
      SELECT {key}, score FROM (
        SELECT t.{key}, sum(greatest(ln((s.n - d.df + 0.5) / (d.df + 0.5)), 1e-6) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / s.avgdl))) AS score
        FROM (SELECT {key}, len(toks) AS dl, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM (SELECT {key}, {toks} AS toks FROM {source}), (SELECT unnest([{terms}]) AS term)) t
        JOIN (SELECT term, count(*) AS df FROM (SELECT {key}, {toks} AS toks FROM {source}), (SELECT unnest([{terms}]) AS term) WHERE list_contains(toks, term) GROUP BY 1) d ON t.term = d.term
        CROSS JOIN (SELECT count(*) AS n, avg(len({toks})) AS avgdl FROM {source}) s
        WHERE t.tf > 0 GROUP BY 1) ORDER BY score DESC, {key} LIMIT {limit}"""


def _knn_sql(where: str, limit: int) -> str:
    return f"""
      SELECT record_id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM vectors WHERE record_id = {SEED_VECTOR})) AS distance
      FROM vectors {where} ORDER BY distance, record_id LIMIT {limit}"""


def _fused_sql(lex: str, sem: str, k: int) -> str:
    return f"""
      lex AS (SELECT record_id, row_number() OVER (ORDER BY score DESC, record_id) AS rank FROM ({lex})),
      sem AS (SELECT record_id, row_number() OVER (ORDER BY distance, record_id) AS rank FROM ({sem})),
      fused AS (SELECT record_id, sum(1.0 / (60 + rank)) AS score, min((leg, rank)) AS seen, max(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS first
        FROM (SELECT record_id, rank, 0 AS leg FROM lex UNION ALL SELECT record_id, rank, 1 AS leg FROM sem) GROUP BY 1),
      placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, seen, record_id) AS pos FROM fused),
      coming AS (SELECT count(*) AS c FROM placed WHERE pos > {k} AND first = 1),
      staying AS (SELECT record_id, score, row_number() OVER (ORDER BY pos DESC) AS low FROM placed WHERE pos <= {k} AND first = 0),
      chosen AS (SELECT record_id, score FROM placed WHERE pos <= {k} AND first = 1
        UNION ALL SELECT record_id, score FROM staying, coming WHERE low > c
        UNION ALL SELECT record_id, score FROM placed, coming WHERE pos > {k} AND first = 1 AND c <= (SELECT count(*) FROM staying))"""


def _query_vector(vectors) -> list[float]:
    rows = vectors.where(F.col("record_id") == SEED_VECTOR).select("embedding").limit(1).collect()
    return list(rows[0][0]) if rows else []


@add("r1_query_terms", "region", "SELECT unnest(['" + "', '".join(TERMS) + "']) AS term")
def r1(region):
    return region.limit(1).select(F.explode(F.array(*map(F.lit, T.query_terms(QUERY)))).alias("term"))


@add("r2_bm25", "records", f"SELECT record_id, round(score, 6) AS score FROM ({_bm25_sql('records', 'record_id', 'chunk_text', 50)})")
def r2(records):
    return R.bm25(records, "record_id", "chunk_text", QUERY, 50).select("record_id", F.round("score", 6).alias("score"))


def _postings(records) -> str:
    return standing.index(records, "postings", lambda folder: P.written(records, "record_id", "chunk_text", folder))


def _cells(vectors) -> X.Index:
    return X.Index(vectors.sparkSession, standing.index(vectors, "vectors", lambda folder: X.written(vectors, "record_id", "embedding", folder, keep=["label"])))


@add("r2_index_write", "records", f"SELECT count(*) AS n, round(avg(len({TOKENS.format('chunk_text').replace('{{', '{').replace('}}', '}')})), 6) AS avgdl FROM records")
def r2w(records):
    """Writes the postings where none stand for these files; documents and their mean length."""
    found = P.stats(records.sparkSession, _postings(records))
    return records.sparkSession.createDataFrame([(found["n"], found["avgdl"])], "n bigint, avgdl double").select("n", F.round("avgdl", 6).alias("avgdl"))


@add("r2_indexed_lookup", "records", f"SELECT record_id, round(score, 6) AS score FROM ({_bm25_sql('records', 'record_id', 'chunk_text', 50)})")
def r2i(records):
    """A lookup reads the buckets of its terms in the standing index."""
    return P.bm25(records.sparkSession, _postings(records), "record_id", QUERY, 50).select("record_id", F.round("score", 6).alias("score"))


@add("r2_bm25_stemmed", "records")
def r2s(records):
    return R.bm25(records, "record_id", "chunk_text", QUERY, 50, stem=True)


@add("r2_postings", "records", f"SELECT doc, term, count(*) AS tf, max(dl) AS dl FROM (SELECT record_id AS doc, len(toks) AS dl, unnest(toks) AS term FROM (SELECT record_id, {TOKENS.format('chunk_text').replace('{{', '{').replace('}}', '}')} AS toks FROM records)) GROUP BY 1, 2")
def r2p(records):
    return R.postings(records, "record_id", "chunk_text").select("doc", "term", "tf", "dl")


@add("r3_rrf_guaranteed", "records vectors", "WITH " + _fused_sql(_bm25_sql("records", "record_id", "chunk_text", 25), _knn_sql("", 25), 5) + " SELECT record_id, round(score, 8) AS score FROM chosen")
def r3(records, vectors):
    lex = R.ranked(R.bm25(records, "record_id", "chunk_text", QUERY, 25), "record_id", [F.desc("score"), "record_id"], "lexical")
    sem = R.ranked(R.knn(vectors, "record_id", "embedding", _query_vector(vectors), 25), "record_id", ["distance", "record_id"], "semantic")
    return R.rrf(lex, sem, "record_id", 5).select("record_id", F.round("score", 8).alias("score"))


@add("r4_knn", "vectors", f"SELECT record_id, round(distance, 6) AS distance FROM ({_knn_sql('', 20)})")
def r4(vectors):
    return R.knn(vectors, "record_id", "embedding", _query_vector(vectors), 20).select("record_id", F.round("distance", 6).alias("distance"))


@add("r4_index_write", "vectors", "SELECT label, count(*) AS n FROM vectors GROUP BY 1")
def r4w(vectors):
    """Writes the cells where none stand for these files; vectors by label, read from them."""
    return _cells(vectors).rows().groupBy("label").agg(F.count("*").alias("n"))


@add("r4_indexed_knn", "vectors", f"SELECT record_id, round(distance, 6) AS distance FROM ({_knn_sql('', 20)})")
def r4i(vectors):
    return _cells(vectors).knn(_query_vector(vectors), 20).select("record_id", F.round("distance", 6).alias("distance"))


@add("t4_indexed_knn", "vectors", f"SELECT record_id, round(distance, 6) AS distance FROM ({_knn_sql('WHERE label = 2', 10)})")
def t4i(vectors):
    return _cells(vectors).knn(_query_vector(vectors), 10, F.col("label") == 2).select("record_id", F.round("distance", 6).alias("distance"))


@add("t4_knn_filtered_first", "vectors", f"SELECT record_id, round(distance, 6) AS distance FROM ({_knn_sql('WHERE label = 2', 10)})")
def t4(vectors):
    return R.knn(vectors.where("label = 2"), "record_id", "embedding", _query_vector(vectors), 10).select("record_id", F.round("distance", 6).alias("distance"))


_MEM_LEX = _bm25_sql("live", "record_id", "content", 25)


@add("r5_recall", "memories vectors", "WITH live AS (SELECT memory_id AS record_id, content, memory_type FROM memories WHERE status IS DISTINCT FROM 'superseded' AND workspace IN ('src0', 'src1', 'src2', 'src3', 'src4')), " + _fused_sql(_MEM_LEX, _knn_sql("WHERE record_id IN (SELECT record_id FROM live)", 25), 5) + " SELECT c.record_id AS memory_id, l.memory_type, round(c.score, 6) AS score, substr(l.content, 1, 500) AS content FROM chosen c JOIN live l ON c.record_id = l.record_id")
def r5(memories, vectors):
    live = memories.where(~F.col("status").eqNullSafe("superseded") & F.col("workspace").isin("src0", "src1", "src2", "src3", "src4")).withColumnRenamed("memory_id", "record_id")
    near = vectors.join(live, "record_id", "left_semi")
    top = R.hybrid(live, near, "record_id", "content", "embedding", QUERY, _query_vector(vectors), 5)
    return live.join(top, "record_id").select(F.col("record_id").alias("memory_id"), "memory_type", F.round("score", 6).alias("score"), F.left("content", F.lit(500)).alias("content"))


@add("r6_chunk_search", "records vectors", "WITH " + _fused_sql(_bm25_sql("records", "record_id", "chunk_text", 50), _knn_sql("", 50), 10) + " SELECT c.record_id, r.session_id, round(c.score, 6) AS score, substr(r.chunk_text, 1, 500) AS chunk_text FROM chosen c JOIN records r ON c.record_id = r.record_id")
def r6(records, vectors):
    top = R.hybrid(records, vectors, "record_id", "chunk_text", "embedding", QUERY, _query_vector(vectors), 10)
    return records.join(top, "record_id").select("record_id", "session_id", F.round("score", 6).alias("score"), F.left("chunk_text", F.lit(500)).alias("chunk_text"))


@add("r6_indexed_search", "records vectors", "WITH " + _fused_sql(_bm25_sql("records", "record_id", "chunk_text", 50), _knn_sql("", 50), 10) + " SELECT c.record_id, r.session_id, round(c.score, 6) AS score, substr(r.chunk_text, 1, 500) AS chunk_text FROM chosen c JOIN records r ON c.record_id = r.record_id")
def r6i(records, vectors):
    """Both legs from the standing indexes; the texts of the ten chunks found are all that is read of the corpus."""
    query = _query_vector(vectors)
    lexical, semantic = P.bm25(records.sparkSession, _postings(records), "record_id", QUERY, 50), _cells(vectors).knn(query, 50)
    top = R.hybrid(records, vectors, "record_id", "chunk_text", "embedding", QUERY, query, 10, lexical=lexical, semantic=semantic)
    found = {r["record_id"]: r["score"] for r in top.collect()}
    scores = F.create_map(*[F.lit(x) for pair in found.items() for x in pair]) if found else F.lit(None).cast("map<bigint,double>")
    near = records.where(F.col("record_id").isin(list(found)))
    return near.select("record_id", "session_id", F.round(scores[F.col("record_id")], 6).alias("score"), F.left("chunk_text", F.lit(500)).alias("chunk_text"))


@add("r7_session_search", "records vectors")
def r7(records, vectors):
    sessions = records.groupBy("session_id").agg(F.min_by("chunk_text", "chunk_index").alias("summary"))
    mean = V.mean_vectors(vectors.join(records.select("record_id", "session_id"), "record_id"), "session_id", "embedding")
    top = R.hybrid(sessions, mean, "session_id", "summary", "mean_vec", QUERY, _query_vector(vectors), 5, over=3, metric="cosine")
    return top.select("session_id", F.round("score", 6).alias("score"))


_EDGES = "SELECT a.session_id AS src, b.session_id AS tgt, a.entity_id AS via, 1.0 / n.n AS weight FROM (SELECT DISTINCT session_id, entity_id FROM occurrences) a JOIN (SELECT DISTINCT session_id, entity_id FROM occurrences) b ON a.entity_id = b.entity_id AND a.session_id <> b.session_id JOIN (SELECT entity_id, count(DISTINCT session_id) AS n FROM occurrences GROUP BY 1) n ON a.entity_id = n.entity_id"


@add("g1_structural_edges", "occurrences", f"SELECT src, tgt, via, round(weight, 8) AS weight FROM ({_EDGES})")
def g1(occ):
    return G.shared_edges(occ, "session_id", "entity_id", 8).select("src", "tgt", F.col("entity_id").alias("via"), "weight")


@add("j11_sessions_sharing", "occurrences", f"SELECT src, tgt, count(*) AS shared FROM ({_EDGES}) GROUP BY 1, 2")
def j11(occ):
    return G.pairs_sharing(occ, "session_id", "entity_id").select("src", "tgt", F.size("shared").cast("long").alias("shared"))


@add("g2_workspace_edges", "customer", "SELECT a.c_custkey AS src, b.c_custkey AS tgt, round(1.0 / n, 8) AS weight FROM (SELECT c_custkey, concat(c_nationkey, c_mktsegment) AS w, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) a JOIN (SELECT c_custkey, concat(c_nationkey, c_mktsegment) AS w FROM customer) b ON a.w = b.w AND a.c_custkey <> b.c_custkey")
def g2(customer):
    rows = customer.select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("w"))
    return G.group_edges(rows, "c_custkey", "w", 8)


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@add("g3_similarity_edges", "vectors", f"SELECT src, tgt, round(w, 6) AS weight FROM (SELECT a.record_id AS src, b.record_id AS tgt, {_COS} AS w, row_number() OVER (PARTITION BY a.record_id ORDER BY round({_COS}, 12) DESC, b.record_id) AS r FROM vectors a JOIN vectors b ON a.record_id <> b.record_id WHERE {_COS} >= 0.25) WHERE r <= 8")
def g3(vectors):
    return G.similarity_edges(vectors, "record_id", "embedding", 8, 0.25).select("src", "tgt", F.round("weight", 6).alias("weight"))


@add("w16_top_k_per_group", "occurrences", "SELECT session_id, entity_id, n FROM (SELECT session_id, entity_id, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, entity_id) AS r FROM occurrences GROUP BY 1, 2) WHERE r <= 3")
def w16(occ):
    by = occ.groupBy("session_id", "entity_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("session_id").orderBy(F.desc("n"), "entity_id")
    return by.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@add("g4_shared_memory_edges", "memberships memory_sources", "WITH s AS (SELECT DISTINCT cluster_id, session_id FROM memberships JOIN memory_sources ON member_id = memory_id), n AS (SELECT cluster_id, count(*) AS n FROM s GROUP BY 1) SELECT a.session_id AS src, b.session_id AS tgt, a.cluster_id, round(1.0 / n.n, 8) AS weight FROM s a JOIN s b ON a.cluster_id = b.cluster_id AND a.session_id <> b.session_id JOIN n ON a.cluster_id = n.cluster_id")
def g4(c, x):
    s = c.join(x, c["member_id"] == x["memory_id"])
    return G.shared_edges(s, "session_id", "cluster_id", 8).select("src", "tgt", "cluster_id", "weight")


_TYPED = "SELECT l_suppkey AS src, l_partkey % 100 AS tgt, l_shipdate, CASE l_returnflag WHEN 'A' THEN 'structural' WHEN 'N' THEN 'workspace' ELSE 'shared_memory' END AS edge_type FROM lineitem"


def _typed(lineitem):
    kind = F.when(F.col("l_returnflag") == "A", "structural").when(F.col("l_returnflag") == "N", "workspace").otherwise("shared_memory")
    return lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("tgt"), kind.alias("edge_type"))


@add("g5_undirected_pairs", "lineitem", f"SELECT a, b, count(*) AS weight, string_agg(edge_type, ',' ORDER BY edge_type) AS types FROM (SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b, edge_type FROM ({_TYPED}) WHERE src <> tgt) GROUP BY 1, 2")
def g5(lineitem):
    return G.undirected(_typed(lineitem))


@add("g6_communities", "lineitem")
def g6(lineitem):
    return M.communities(G.undirected(_typed(lineitem)))


@add("g7_community_summary", "sessions", "SELECT session_type AS community, count(*) AS size, CASE WHEN count(DISTINCT workspace) > 4 THEN array_to_string(list_sort(list(DISTINCT workspace))[1:4], ', ') || ' +' || CAST(count(DISTINCT workspace) - 4 AS VARCHAR) || ' more' ELSE array_to_string(list_sort(list(DISTINCT workspace)), ', ') END AS workspaces, string_agg(DISTINCT plugin, ',' ORDER BY plugin) AS harnesses FROM sessions GROUP BY 1")
def g7(s):
    ws = F.array_sort(F.collect_set("workspace"))
    by = s.groupBy(F.col("session_type").alias("community")).agg(F.count("*").alias("size"), ws.alias("ws"), F.array_join(F.array_sort(F.collect_set("plugin")), ",").alias("harnesses"))
    more = F.concat(F.array_join(F.slice("ws", 1, 4), ", "), F.lit(" +"), (F.size("ws") - 4).cast("string"), F.lit(" more"))
    return by.select("community", "size", F.when(F.size("ws") > 4, more).otherwise(F.array_join("ws", ", ")).alias("workspaces"), "harnesses")


# over things that few sessions share, so that edges are heavy enough to be walked
_WALKED = f"""
    p AS (SELECT DISTINCT session_id, entity_id FROM rare_occurrences),
    n AS (SELECT entity_id, count(*) AS n FROM p GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4),
    e AS (SELECT a.session_id AS src, b.session_id AS tgt, 1.0 / n AS weight FROM p a JOIN n ON a.entity_id = n.entity_id JOIN p b ON a.entity_id = b.entity_id AND a.session_id <> b.session_id)"""


def _walk(occ, sources, memories, seed, depth):
    edges = lambda sessions: G.edges_from(occ, "session_id", "entity_id", sessions, round(1 / R.MIN_WEIGHT) - 1)
    return R.graph_walk(edges, sources, memories.select("memory_id", "evidence", "access"), seed, depth=depth)


@add("r8_graph_walk", "rare_occurrences memory_sources memories", f"""WITH {_WALKED},
    seed AS (SELECT min(memory_id) AS m FROM memory_sources),
    zero AS (SELECT DISTINCT session_id AS tgt FROM memory_sources JOIN seed ON memory_id = m),
    one AS (SELECT tgt FROM (SELECT tgt, max(weight) AS w FROM e WHERE src IN (FROM zero) AND tgt NOT IN (FROM zero) GROUP BY 1 ORDER BY w DESC, tgt LIMIT 10)),
    two AS (SELECT tgt FROM (SELECT tgt, max(weight) AS w FROM e WHERE src IN (FROM one) AND tgt NOT IN (FROM zero) AND tgt NOT IN (FROM one) GROUP BY 1 ORDER BY w DESC, tgt LIMIT 10)),
    found AS (SELECT DISTINCT memory_id FROM memory_sources, seed WHERE session_id IN (FROM one UNION FROM two) AND memory_id <> m)
    SELECT memory_id, evidence, access FROM memories WHERE memory_id IN (FROM found) ORDER BY evidence DESC, access DESC, memory_id LIMIT 30""")
def r8(occ, sources, memories):
    seed = sources.agg(F.min("memory_id")).first()[0]
    return _walk(occ, sources, memories, seed, 2).select("memory_id", "evidence", "access")


@add("set3_visited_difference", "occurrences", "WITH e AS (SELECT DISTINCT a.session_id AS src, b.session_id AS tgt FROM occurrences a JOIN occurrences b ON a.entity_id = b.entity_id AND a.session_id <> b.session_id), one AS (SELECT DISTINCT tgt FROM e WHERE src = 0), two AS (SELECT DISTINCT e.tgt FROM e JOIN one ON e.src = one.tgt) SELECT tgt FROM two WHERE tgt <> 0 AND tgt NOT IN (SELECT tgt FROM one)")
def set3(occ):
    start = occ.sparkSession.createDataFrame([(0,)], f"src {occ.schema['session_id'].dataType.simpleString()}")
    hop = lambda sessions: G.edges_from(occ, "session_id", "entity_id", sessions).select("tgt").distinct()
    one = hop(start)
    two = hop(one.withColumnRenamed("tgt", "src"))
    return two.where("tgt <> 0").join(one, "tgt", "left_anti")


@add("r9_recall_expansion", "rare_occurrences memory_sources memories", f"""WITH {_WALKED},
    seeds AS (SELECT memory_id AS m, row_number() OVER (ORDER BY memory_id) - 1 AS seed FROM (SELECT DISTINCT memory_id FROM memory_sources) ORDER BY memory_id LIMIT 3),
    zero AS (SELECT DISTINCT seed, session_id AS tgt FROM memory_sources JOIN seeds ON memory_id = m),
    hop AS (SELECT z.seed, e.tgt, max(weight) AS w FROM e JOIN zero z ON e.src = z.tgt WHERE NOT EXISTS (SELECT 1 FROM zero y WHERE y.seed = z.seed AND y.tgt = e.tgt) GROUP BY ALL),
    one AS (SELECT seed, tgt FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY w DESC, tgt) AS r FROM hop) WHERE r <= 10),
    found AS (SELECT DISTINCT o.seed, x.memory_id FROM one o JOIN memory_sources x ON x.session_id = o.tgt JOIN seeds s ON s.seed = o.seed WHERE x.memory_id <> s.m),
    best AS (SELECT f.seed, m.memory_id, row_number() OVER (PARTITION BY f.seed ORDER BY evidence DESC, access DESC, m.memory_id) AS r FROM found f JOIN memories m ON f.memory_id = m.memory_id)
    SELECT memory_id, round(0.5 / (min(seed) + 1), 8) AS score FROM best WHERE r <= 30 GROUP BY 1""")
def r9(occ, sources, memories):
    seeds = sources.select("memory_id").distinct().orderBy("memory_id").limit(3).collect()
    out = None
    for i, s in enumerate(seeds):
        found = _walk(occ, sources, memories, s[0], 1)
        found = found.select("memory_id", F.lit(i).alias("seed"), F.lit(R.DECAY / (i + 1)).alias("score"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return memories.select("memory_id", F.lit(0.0).alias("score")).limit(0)
    w = Window.partitionBy("memory_id").orderBy("seed")
    return out.withColumn("r", F.row_number().over(w)).where("r = 1").select("memory_id", F.round("score", 8).alias("score"))


@add("r10_chunk_expansion", "occurrences", "WITH p AS (SELECT DISTINCT record_id, entity_id FROM occurrences), mine AS (SELECT entity_id FROM p WHERE record_id = (SELECT min(record_id) FROM p)), near AS (SELECT p.* FROM p JOIN mine ON p.entity_id = mine.entity_id), k AS (SELECT entity_id, 1.0 / count(*) AS w FROM near GROUP BY 1), c AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY record_id) AS r FROM near WHERE record_id <> (SELECT min(record_id) FROM p)) SELECT record_id, round(0.5 * max(w), 8) AS score FROM c JOIN k ON c.entity_id = k.entity_id WHERE r <= 10 GROUP BY 1 ORDER BY max(w) DESC, record_id LIMIT 30")
def r10(occ):
    seed = occ.agg(F.min("record_id")).first()[0]
    return R.chunk_expansion(occ, seed, 1.0).select("record_id", F.round("score", 8).alias("score"))


@add("r11_session_expansion", "occurrences", f"SELECT tgt, round(0.8 * 0.5 * max(weight), 8) AS score FROM ({_EDGES}) WHERE src = 0 GROUP BY 1")
def r11(occ):
    # only the seed's own entities take part
    near = occ.join(occ.where("session_id = 0").select("entity_id").distinct(), "entity_id", "left_semi")
    return R.session_expansion(G.shared_edges(near, "session_id", "entity_id"), 0, 0.8).select("tgt", F.round("score", 8).alias("score"))


@add("r12_access_counts", "memories retrievals", "SELECT m.memory_id, m.access + coalesce(r.n, 0) AS access FROM memories m LEFT JOIN (SELECT memory_id, count(*) AS n FROM retrievals GROUP BY 1) r ON m.memory_id = r.memory_id")
def r12(m, r):
    n = r.groupBy("memory_id").agg(F.count("*").alias("n"))
    return m.join(n, "memory_id", "left").select("memory_id", (F.col("access") + F.coalesce("n", F.lit(0))).alias("access"))


@add("r13_related_with_reasons", "occurrences entities", "WITH p AS (SELECT DISTINCT session_id, entity_id FROM occurrences), e AS (SELECT a.session_id AS src, b.session_id AS tgt, n.canonical_name AS reason FROM p a JOIN p b ON a.entity_id = b.entity_id AND a.session_id <> b.session_id JOIN entities n ON a.entity_id = n.entity_id) SELECT src, tgt, count(DISTINCT reason) AS reasons, array_to_string(list_sort(list(DISTINCT reason))[1:5], ', ') AS named FROM e GROUP BY 1, 2")
def r13(occ, ent):
    """All related sessions and why: each pair meets once, with the names of all that it shares."""
    named = occ.select("session_id", "entity_id").distinct().join(ent.select("entity_id", "canonical_name"), "entity_id")
    found = G.pairs_sharing(named.select("session_id", F.struct("entity_id", "canonical_name").alias("thing")), "session_id", "thing")
    names = found.select("src", "tgt", F.array_sort(F.array_distinct(F.filter("shared.canonical_name", lambda x: x.isNotNull()))).alias("all"))
    return names.select("src", "tgt", F.size("all").cast("long").alias("reasons"), F.array_join(F.slice("all", 1, 5), ", ").alias("named"))


@add("r14_similar_sessions", "vectors", f"SELECT b.record_id, round({_COS}, 6) AS similarity FROM vectors a JOIN vectors b ON a.record_id <> b.record_id WHERE a.record_id = {SEED_VECTOR} ORDER BY {_COS} DESC, b.record_id LIMIT 8")
def r14(v):
    q = V.literal(_query_vector(v))
    rows = v.where(F.col("record_id") != SEED_VECTOR).select("record_id", V.cosine(F.col("embedding"), q).alias("s"))
    return rows.orderBy(F.desc("s"), "record_id").limit(8).select("record_id", F.round("s", 6).alias("similarity"))


@add("r15_similarity_matrix", "vectors", f"SELECT a.record_id AS a, b.record_id AS b, CASE WHEN a.record_id = b.record_id THEN 1.0 ELSE round({_COS}, 3) END AS similarity FROM vectors a, vectors b WHERE a.record_id < 12 AND b.record_id < 12")
def r15(v):
    # a view of one chosen set of sessions: the set's vectors are one array on every row
    few = v.where("record_id < 12")
    every = few.agg(F.collect_list(F.struct("record_id", "embedding")).alias("all"))
    pairs = few.select("record_id", "embedding", F.lit(1).alias("k")).join(every.withColumn("k", F.lit(1)), "k").withColumn("o", F.explode("all"))
    sim = F.when(F.col("record_id") == F.col("o.record_id"), F.lit(1.0)).otherwise(F.round(V.cosine(F.col("embedding"), F.col("o.embedding")), 3))
    return pairs.select(F.col("record_id").alias("a"), F.col("o.record_id").alias("b"), sim.alias("similarity"))


@add("r16_status_filter", "memories", "SELECT memory_id, status FROM (SELECT memory_id, status FROM memories ORDER BY evidence DESC, memory_id LIMIT 50) WHERE status IN ('open', 'resolved')")
def r16(m):
    return m.orderBy(F.desc("evidence"), "memory_id").limit(50).where(F.col("status").isin("open", "resolved")).select("memory_id", "status")


@add("r17_tool_payload", "records", "SELECT record_id, '{\"id\":' || CAST(record_id AS VARCHAR) || ',\"session\":\"' || session_id || '\"}' AS payload FROM records")
def r17(r):
    return r.select("record_id", F.to_json(F.struct(F.col("record_id").alias("id"), F.col("session_id").alias("session"))).alias("payload"))


@add("t5_merged_top", "records vectors", "WITH " + _fused_sql(_bm25_sql("records", "record_id", "chunk_text", 10), _knn_sql("", 10), 3) + " SELECT record_id, round(score, 8) AS score FROM chosen")
def t5(records, vectors):
    lex = R.ranked(R.bm25(records, "record_id", "chunk_text", QUERY, 10), "record_id", [F.desc("score"), "record_id"], "lexical")
    sem = R.ranked(R.knn(vectors, "record_id", "embedding", _query_vector(vectors), 10), "record_id", ["distance", "record_id"], "semantic")
    return R.rrf(lex, sem, "record_id", 3).select("record_id", F.round("score", 8).alias("score"))


@add("r18_answer", "records")
def r18(records):
    """An answer from retrieved chunks, by the offline provider: its seam is where a model goes."""
    from sessionlens.operators.seams import completed

    top = records.join(R.bm25(records, "record_id", "chunk_text", QUERY, 5), "record_id")
    prompt = F.concat(F.lit(f"Answer from the context: {QUERY}\n\n"), F.left("chunk_text", F.lit(400)))
    return completed(top.select("record_id", prompt.alias("prompt")), "prompt").select("record_id", "answer")


@add("p31_context_builder", "records", "SELECT session_id, string_agg('[' || CAST(r AS VARCHAR) || '] ' || substr(chunk_text, 1, 80), chr(10) ORDER BY r) AS context FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY chunk_index) AS r FROM records) WHERE r <= 5 GROUP BY 1")
def p31(r):
    w = Window.partitionBy("session_id").orderBy("chunk_index")
    rows = r.withColumn("r", F.row_number().over(w)).where("r <= 5")
    line = F.concat(F.lit("["), F.col("r").cast("string"), F.lit("] "), F.left("chunk_text", F.lit(80)))
    by = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))).alias("all"))
    return by.select("session_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("context"))


@add("c1_session_clusters", "vectors")
def c1(v):
    return C.session_types(C.clustered(v, "record_id", "embedding", 3))


@add("c2_cluster_labels", "sessions", "SELECT session_type, CASE WHEN session_type = 'noise' THEN 'Unclustered' ELSE session_type || ': ' || CAST(count(*) AS VARCHAR) || ' sessions' END AS label FROM sessions GROUP BY 1")
def c2(s):
    by = s.groupBy("session_type").agg(F.count("*").alias("n"))
    return by.select("session_type", F.when(F.col("session_type") == "noise", "Unclustered").otherwise(F.concat("session_type", F.lit(": "), F.col("n").cast("string"), F.lit(" sessions"))).alias("label"))


@add("c3_within_session_clusters", "vectors")
def c3(v):
    return C.clustered(v, "record_id", "embedding", 2, by="label")


@add("c4_cross_session_clusters", "vectors records")
def c4(v, r):
    got = C.clustered(v, "record_id", "embedding", 3)
    seen = got.join(r.select("record_id", "session_id"), "record_id").where("cluster >= 0")
    keep = seen.groupBy("cluster").agg(F.countDistinct("session_id").alias("evidence")).where("evidence >= 2")
    return got.join(keep, "cluster").select("record_id", "cluster", "evidence")


_C5 = "members AS (SELECT label AS cluster, record_id AS member, record_id % 7 AS session_id, embedding FROM vectors), ev AS (SELECT cluster, count(DISTINCT session_id) AS evidence FROM members GROUP BY 1 HAVING count(DISTINCT session_id) >= 2), mean AS (SELECT cluster, list(m ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM members) GROUP BY 1, 2) GROUP BY 1)"


@add("c5_cluster_prep", "vectors", f"WITH {_C5} SELECT m.cluster, m.member, row_number() OVER (PARTITION BY m.cluster ORDER BY round(list_distance(CAST(m.embedding AS DOUBLE[]), mean.c), 9), m.member) AS place, ev.evidence FROM members m JOIN ev ON m.cluster = ev.cluster JOIN mean ON m.cluster = mean.cluster")
def c5(v):
    members = v.select(F.col("label").alias("cluster"), F.col("record_id").alias("member"), (F.col("record_id") % 7).alias("session_id"))
    return C.prepared(members, v.select(F.col("record_id").alias("member"), F.col("embedding").alias("vec")))


@add("c6_minted_memories", "vectors memories", f"WITH {_C5}, r AS (SELECT m.cluster, m.member, row_number() OVER (PARTITION BY m.cluster ORDER BY round(list_distance(CAST(m.embedding AS DOUBLE[]), mean.c), 9), m.member) AS place FROM members m JOIN mean ON m.cluster = mean.cluster) SELECT 'cluster:' || CAST(r.cluster AS VARCHAR) AS memory_id, k.memory_type, substr(k.content, 1, 200) AS content, 'default' AS workspace FROM r JOIN memories k ON r.member = k.memory_id WHERE r.place = 1")
def c6(v, m):
    place = C.prepared(v.select(F.col("label").alias("cluster"), F.col("record_id").alias("member"), (F.col("record_id") % 7).alias("session_id")), v.select(F.col("record_id").alias("member"), F.col("embedding").alias("vec")))
    medoid = place.where("place = 1").join(m.select(F.col("memory_id").alias("member"), "memory_type", "content"), "member")
    return medoid.select(F.concat(F.lit("cluster:"), F.col("cluster").cast("string")).alias("memory_id"), "memory_type", F.left("content", F.lit(200)).alias("content"), F.lit("default").alias("workspace"))


@add("c7_superseded_clusters", "memberships", "WITH o AS (SELECT cluster_id AS old_cluster, member_id AS member FROM memberships), w AS (SELECT member_id % 3 AS new_cluster, member_id AS member FROM memberships WHERE member_id % 5 <> 0), s AS (SELECT old_cluster, count(DISTINCT member) AS size FROM o GROUP BY 1), h AS (SELECT old_cluster, new_cluster, count(DISTINCT o.member) AS hit FROM o JOIN w ON o.member = w.member GROUP BY 1, 2) SELECT h.old_cluster, min(new_cluster) AS new_cluster FROM h JOIN s ON h.old_cluster = s.old_cluster WHERE hit / CAST(size AS DOUBLE) >= 0.3 GROUP BY 1")
def c7(c):
    old = c.select(F.col("cluster_id").alias("old_cluster"), F.col("member_id").alias("member"))
    new = c.where("member_id % 5 <> 0").select((F.col("member_id") % 3).alias("new_cluster"), F.col("member_id").alias("member"))
    return C.superseded(new, old, 0.3)


@add("c8_projection_2d", "vectors")
def c8(v):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = v.select("record_id", array_to_vector(V.doubles(F.col("embedding"))).alias("f"))
    out = PCA(k=2, inputCol="f", outputCol="xy").fit(rows).transform(rows).select("record_id", vector_to_array("xy").alias("xy"))
    return out.select("record_id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


@add("c9_cluster_status", "memories memberships", "SELECT m.memory_id, CASE WHEN c.level IS NULL THEN 'unclustered' WHEN m.status = 'superseded' THEN 'superseded' ELSE c.level END AS cluster_status FROM memories m LEFT JOIN memberships c ON m.memory_id = c.member_id")
def c9(m, c):
    rows = m.join(c.select(F.col("member_id").alias("memory_id"), "level"), "memory_id", "left")
    return rows.select("memory_id", F.when(F.col("level").isNull(), "unclustered").when(F.col("status") == "superseded", "superseded").otherwise(F.col("level")).alias("cluster_status"))


def _pair_means(v, *by):
    """Sums of cosines over all pairs from sums of unit vectors: (sum of v)² minus the squares, no pairs made."""
    unit = v.withColumn("n", V.norm(F.col("embedding")))
    return unit.select(*by, F.posexplode(F.transform(V.doubles(F.col("embedding")), lambda x: x / F.col("n"))).alias("pos", "x"))


@add("c10_within_between", "vectors", f"SELECT a.label = b.label AS same, round(avg({_COS}), 6) AS mean_cosine FROM vectors a JOIN vectors b ON a.record_id < b.record_id GROUP BY 1")
def c10(v):
    long = _pair_means(v, "label")
    by_pos = long.groupBy("label", "pos").agg(F.sum("x").alias("s"))
    within = by_pos.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(v.groupBy("label").agg(F.count("*").alias("n")), "label")
    within = within.agg(F.sum((F.col("q") - F.col("n")) / 2).alias("w"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("wp"), F.sum("n").alias("n"), F.lit(1).alias("k"))
    total = by_pos.groupBy("pos").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.lit(1).alias("k"))
    one = within.join(total, "k").withColumn("all", (F.col("q") - F.col("n")) / 2).withColumn("ap", F.col("n") * (F.col("n") - 1) / 2)
    rows = F.array(F.struct(F.lit(True).alias("same"), (F.col("w") / F.col("wp")).alias("m")), F.struct(F.lit(False).alias("same"), ((F.col("all") - F.col("w")) / (F.col("ap") - F.col("wp"))).alias("m")))
    return one.select(F.explode(rows).alias("r")).select("r.same", F.round("r.m", 6).alias("mean_cosine"))


@add("a38_similarity_spread", "vectors", f"SELECT round(avg({_COS}), 6) AS mean, round(max({_COS}), 6) AS max, round(min({_COS}), 6) AS min FROM vectors a JOIN vectors b ON a.record_id < b.record_id")
def a38(v):
    """Over all pairs: the mean from the sum of all vectors, the ends by bounds."""
    least, most = S.extremes(v, "record_id", "embedding")
    row = (S.mean_cosine(v, "record_id", "embedding"), most, least)
    return v.sparkSession.createDataFrame([row], "mean double, max double, min double").select(*[F.round(c, 6).alias(c) for c in ("mean", "max", "min")])
