"""Hybrid retrieval: postings, BM25, exact nearest neighbours, rank fusion, graph expansion."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions import text as T
from sessionlens.functions import vectors as V
from sessionlens.operators.shared import written

K1, B = 1.2, 0.75
#: Weight of a term that half of the documents or more have.
IDF_FLOOR = 1e-6
RRF_K = 60
DECAY = 0.5
HOP_NEIGHBOURS = 10
EXPANSION_MEMORIES = 30
ENTITY_NEIGHBOURS = 10
EXPANSION_RECORDS = 30
MIN_WEIGHT = 0.2


def postings(docs: DataFrame, key: str, text: str, stem: bool = False) -> DataFrame:
    """(key, term, tf, dl): one row for each term of a document. Materialise it once for many queries."""
    # texts are dealt by document, so that its terms are counted where they are
    dealt = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartition("doc")
    toks = dealt.select("doc", T.tokens(F.col("text")).alias("toks")).withColumn("dl", F.size("toks").cast("long"))
    long = toks.select("doc", "dl", F.explode("toks").alias("term"))
    if stem:
        long = long.groupBy("doc", "dl", "term").agg(F.count("*").alias("n")).withColumn("term", T.stemmed(F.col("term")))
        return long.groupBy("doc", "term").agg(F.sum("n").alias("tf"), F.max("dl").alias("dl"))
    return long.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def bm25(docs: DataFrame, key: str, text: str, query: str, top_k: int, stem: bool = False) -> DataFrame:
    """(key, score): BM25 of the OR of the query's terms, best first; no terms give no rows.

    Only the query's terms are counted, as array filters over each document's tokens, so nothing is exploded
    and the corpus statistics are one aggregate row.
    """
    terms = T.query_terms(query)
    if stem:
        return _bm25_stemmed(docs, key, text, terms, top_k)
    toks = docs.select(F.col(key).alias(key), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"))

    def times(term: str):
        return F.size(F.filter("toks", lambda x: x == F.lit(term))).cast("long")

    cols = [times(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    # both the corpus statistics and the ranking need these few numbers of each document, not its text
    rows = toks.select(key, F.size("toks").cast("long").alias("dl"), *cols).persist()
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    if not terms or not stats["n"]:
        return docs.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    import math

    parts = []
    for i in range(len(terms)):
        idf = math.log((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        idf = idf if idf > 0 else IDF_FLOOR
        tf = F.col(f"tf{i}")
        parts.append(F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avgdl"] or 1.0))))
    hit = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    score = reduce(lambda a, b: a + b, parts)
    return rows.where(hit).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(top_k)


def _bm25_stemmed(docs: DataFrame, key: str, text: str, terms: list[str], top_k: int) -> DataFrame:
    """Each distinct term of the corpus is stemmed once; only terms of the query's stems are counted by document."""
    stems = sorted({T._stem(t) for t in terms})
    toks = docs.select(F.col(key).alias("doc"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks")).withColumn("dl", F.size("toks").cast("long"))
    about = toks.agg(F.count("*").alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl")).first()
    n, avgdl = about["n"], about["avgdl"] or 1.0
    # dealt by number, as stemming a few bytes takes its time; written, as the filter would be pushed down to every token
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = written(toks.select(F.explode("toks").alias("term")).distinct().repartition(parts, "term"))
    same = written(vocabulary.withColumn("stem", T.stemmed(F.col("term"))).where(F.col("stem").isin(stems)))
    hits = toks.select("doc", "dl", F.explode("toks").alias("term")).join(same, "term").groupBy("doc", "stem").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    hits = written(hits)
    df = hits.groupBy("stem").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    out = hits.join(df, "stem").groupBy("doc").agg(F.sum(one).alias("score"))
    return out.select(F.col("doc").alias(key), "score").orderBy(F.desc("score"), key).limit(top_k)


def knn(rows: DataFrame, key: str, vector: str, query: list[float], top_k: int, metric: str = "l2") -> DataFrame:
    """(key, distance): exact nearest rows, nearest first. Filter before, not after."""
    q = V.literal(query)
    dist = V.l2(F.col(vector), q) if metric == "l2" else 1 - V.cosine(F.col(vector), q)
    return rows.select(key, dist.alias("distance")).orderBy("distance", key).limit(top_k)


def ranked(leg: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """(key, rank, leg): 1-based ranks of a short, truncated leg."""
    return leg.select(key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"), F.lit(name).alias("leg"))


def rrf(lexical: DataFrame, semantic: DataFrame, key: str, top_k: int | None = None, k: int = RRF_K) -> DataFrame:
    """(key, score): reciprocal rank fusion of two legs of (key, rank).

    Ties go by first appearance (lexical leg first). After the cut each leg's first is given a slot: it takes the
    place of the lowest that isn't a leg's first, as long as there is one.
    """
    legs = lexical.select(key, "rank", F.lit(0).alias("leg")).unionByName(semantic.select(key, "rank", F.lit(1).alias("leg")))
    by = legs.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("seen"), F.max((F.col("rank") == 1).cast("int")).alias("first"), F.min(F.when(F.col("rank") == 1, F.col("leg"))).alias("first_leg"))
    if not top_k:
        return by.select(key, "score").orderBy(F.desc("score"), "seen", key)
    one = Window.partitionBy(F.lit(0))
    order = [F.desc("score"), F.asc("seen"), F.asc(key)]
    by = by.withColumn("at", F.row_number().over(one.orderBy(*order)))
    inside = by.withColumn("inside", F.col("at") <= top_k)
    missing = F.sum(F.when(~F.col("inside") & (F.col("first") == 1), 1).otherwise(0)).over(one)
    # those that may have to go, lowest first; those that come in, by leg
    from_below = F.row_number().over(Window.partitionBy("inside", "first").orderBy(F.desc("at")))
    coming = F.row_number().over(Window.partitionBy("inside", "first").orderBy("first_leg"))
    evictable = F.sum(F.when(F.col("inside") & (F.col("first") == 0), 1).otherwise(0)).over(one)
    inside = inside.withColumn("missing", missing).withColumn("evictable", evictable).withColumn("low", from_below).withColumn("coming", coming)
    keep = (F.col("inside") & ((F.col("first") == 1) | (F.col("low") > F.least("missing", "evictable")))) | (~F.col("inside") & (F.col("first") == 1) & (F.col("coming") <= F.col("evictable")))
    return inside.where(keep).select(key, "score").orderBy(F.desc("score"), key)


def hybrid(docs: DataFrame, vectors: DataFrame, key: str, text: str, vector: str, query: str, query_vec: list[float], top_k: int, over: int = 5, metric: str = "l2", method: str = "hybrid", lexical: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """(key, score): BM25 and nearest-neighbour legs of over * top_k rows each, fused; `lexical` (key, score) and
    `semantic` (key, distance) are legs that an index gave already."""
    empty = docs.select(key, F.lit(1).alias("rank")).limit(0)
    lex = sem = empty
    if method != "semantic":
        leg = bm25(docs, key, text, query, over * top_k) if lexical is None else lexical
        lex = ranked(leg, key, [F.desc("score"), key], "lexical")
    if method != "lexical":
        leg = knn(vectors, key, vector, query_vec, over * top_k, metric) if semantic is None else semantic
        sem = ranked(leg, key, ["distance", key], "semantic")
    return rrf(lex, sem, key, top_k)


def chunk_expansion(occ: DataFrame, seed, seed_score: float, record: str = "record_id", entity: str = "entity_id", per_entity: int = ENTITY_NEIGHBOURS, most: int = EXPANSION_RECORDS) -> DataFrame:
    """(record, score): chunks that share an entity with the seed chunk; an entity weighs one by its chunks."""
    pairs = occ.select(record, entity).distinct()
    mine = pairs.where(F.col(record) == F.lit(seed)).select(entity)
    near = pairs.join(mine, entity, "left_semi")
    spread = near.groupBy(entity).agg((F.lit(1.0) / F.count("*")).alias("weight"))
    capped = near.where(F.col(record) != F.lit(seed)).withColumn("at", F.row_number().over(Window.partitionBy(entity).orderBy(record))).where(F.col("at") <= per_entity)
    best = capped.join(spread, entity).groupBy(record).agg(F.max("weight").alias("weight"))
    best = best.orderBy(F.desc("weight"), record).limit(most)
    return best.select(record, (F.lit(seed_score) * DECAY * F.col("weight")).alias("score"))


def session_expansion(edges: DataFrame, seed, seed_score: float) -> DataFrame:
    """(tgt, score): one hop along session edges, the strongest edge to each."""
    hop = edges.where(F.col("src") == F.lit(seed)).groupBy("tgt").agg(F.max("weight").alias("weight"))
    return hop.select("tgt", (F.lit(seed_score) * DECAY * F.col("weight")).alias("score"))


def graph_walk(edges: DataFrame | Callable[[DataFrame], DataFrame], sources: DataFrame, memories: DataFrame, seed_memory, depth: int = 2, per_hop: int = HOP_NEIGHBOURS, most: int = EXPANSION_MEMORIES) -> DataFrame:
    """(memory_id, evidence, access): breadth-first from a memory's sessions, the strongest `per_hop` new
    sessions a hop, then the memories of the sessions reached. edges: src, tgt, weight; sources: memory_id,
    session_id; memories: memory_id, evidence, access. A hop's frontier has at most `per_hop` sessions.

    edges may be a function that gives the edges out of the sessions in a column src (graph.edges_from), so that
    no edge is built that the walk doesn't meet."""

    def out_of(sessions: DataFrame) -> DataFrame:
        found = edges(sessions) if callable(edges) else edges.join(F.broadcast(sessions), "src", "left_semi")
        return found.where(F.col("weight") > MIN_WEIGHT)

    seeds = sources.where(F.col("memory_id") == F.lit(seed_memory)).select("session_id").distinct()
    new = out_of(seeds.withColumnRenamed("session_id", "src"))
    reached: list = []
    for _ in range(depth):
        new = new.join(seeds.withColumnRenamed("session_id", "tgt"), "tgt", "left_anti")
        if reached:
            new = new.where(~F.col("tgt").isin(reached))
        best = new.groupBy("tgt").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "tgt").limit(per_hop)
        frontier = [r["tgt"] for r in best.collect()]
        if not frontier:
            break
        reached += frontier
        new = out_of(sources.sparkSession.createDataFrame([(x,) for x in frontier], f"src {seeds.schema['session_id'].dataType.simpleString()}"))
    found = sources.where(F.col("session_id").isin(reached) if reached else F.lit(False)).select("memory_id").distinct()
    found = found.where(F.col("memory_id") != F.lit(seed_memory))
    return memories.join(found, "memory_id").orderBy(F.desc("evidence"), F.desc("access"), "memory_id").limit(most)
