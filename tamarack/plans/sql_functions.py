"""SQL table functions: searches, citation chains and session statistics that SQL users call by name.

register() makes temporary views of the tables and temporary functions over them. The functions are SQL, so Catalyst inlines
a call, folds its arguments and pushes what they filter down to the scans; nothing runs until the calling query does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import EDGES_SQL, chunks, edges, table
from .registry import ORACLE, query

# Cosine similarity as the DataFrame form computes it, term by term from the left.
_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)"
_COSINE = f"round(try_divide({_DOT.format(a='embedding', b='query_vector')}, sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='query_vector', b='query_vector')})), 6)"
_WORDS = r"array_remove(split(lower(content), '[^\\p{L}\\p{N}]+'), '')"
_HOLDS = "forall(query_words, w -> array_contains(t, w)) AND size(query_words) > 0"
_TF = "CAST(size(filter(t, x -> array_contains(query_words, x))) AS BIGINT)"

FUNCTIONS = {
    "hybrid_document_chunk_search": f"""
(query_words ARRAY<STRING>, query_vector ARRAY<FLOAT>, p_jurisdiction STRING DEFAULT NULL, p_tenant BIGINT DEFAULT NULL, match_count INT DEFAULT 10, rrf_k INT DEFAULT 60)
RETURNS TABLE (id BIGINT, sem_rank BIGINT, kw_rank BIGINT, score DOUBLE)
RETURN
WITH ok AS (SELECT * FROM document_chunks WHERE status = 'active' AND review_status = 'approved' AND (p_jurisdiction IS NULL OR jurisdiction = p_jurisdiction) AND (tenant_id IS NULL OR tenant_id = p_tenant)),
near AS (SELECT chunk_id AS id, {_COSINE} AS s FROM ok JOIN chunk_vectors ON vec_id = chunk_id ORDER BY s DESC, id LIMIT 80),
sem AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS sem_rank FROM near),
held AS (SELECT chunk_id AS id, {_TF} AS tf FROM (SELECT chunk_id, {_WORDS} AS t FROM ok) WHERE {_HOLDS} ORDER BY tf DESC, id LIMIT 80),
kw AS (SELECT id, row_number() OVER (ORDER BY tf DESC, id) AS kw_rank FROM held),
both AS (SELECT id, CAST(sem_rank AS BIGINT) AS sem_rank, CAST(NULL AS BIGINT) AS kw_rank, 1.0D / (rrf_k + sem_rank) AS sem_part, CAST(NULL AS DOUBLE) AS kw_part FROM sem
  UNION ALL SELECT id, NULL, CAST(kw_rank AS BIGINT), NULL, 1.0D / (rrf_k + kw_rank) FROM kw),
fused AS (SELECT id, min(sem_rank) AS sem_rank, min(kw_rank) AS kw_rank, round(coalesce(sum(sem_part), 0.0D) + coalesce(sum(kw_part), 0.0D), 9) AS score FROM both GROUP BY id)
SELECT id, sem_rank, kw_rank, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM fused) WHERE place <= match_count""",
    "hybrid_legal_search": f"""
(query_words ARRAY<STRING>, query_vector ARRAY<FLOAT>, p_jurisdiction STRING DEFAULT NULL, match_count INT DEFAULT 10, rrf_k INT DEFAULT 60)
RETURNS TABLE (kind STRING, id BIGINT, sem_rank BIGINT, kw_rank BIGINT, score DOUBLE)
RETURN
WITH c AS (SELECT *, CASE WHEN chunk_id % 2 = 0 THEN 'law' ELSE 'case' END AS kind FROM document_chunks),
near AS (SELECT kind, chunk_id AS id, {_COSINE} AS s FROM c JOIN chunk_vectors ON vec_id = chunk_id WHERE kind = 'case' OR p_jurisdiction IS NULL OR jurisdiction = p_jurisdiction),
sem AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY s DESC, id) AS sem_rank FROM near),
held AS (SELECT kind, chunk_id AS id, {_TF} AS tf FROM (SELECT kind, chunk_id, {_WORDS} AS t FROM c) WHERE {_HOLDS}),
kw AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY tf DESC, id) AS kw_rank FROM held),
both AS (SELECT kind, id, CAST(sem_rank AS BIGINT) AS sem_rank, CAST(NULL AS BIGINT) AS kw_rank, 1.0D / (rrf_k + sem_rank) AS sem_part, CAST(NULL AS DOUBLE) AS kw_part FROM sem WHERE sem_rank <= 40
  UNION ALL SELECT kind, id, NULL, CAST(kw_rank AS BIGINT), NULL, 1.0D / (rrf_k + kw_rank) FROM kw WHERE kw_rank <= 40),
fused AS (SELECT kind, id, min(sem_rank) AS sem_rank, min(kw_rank) AS kw_rank, round(coalesce(sum(sem_part), 0.0D) + coalesce(sum(kw_part), 0.0D), 9) AS score FROM both GROUP BY kind, id)
SELECT kind, id, sem_rank, kw_rank, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM fused) WHERE place <= match_count""",
    "get_precedent_chain": """
(p_start BIGINT)
RETURNS TABLE (source_id BIGINT, cited_id BIGINT, depth INT, path ARRAY<BIGINT>)
RETURN
WITH one AS (SELECT source_id, cited_id, 1 AS depth, array(source_id) AS path FROM citation_edges WHERE source_id = p_start AND cited_id IS NOT NULL),
two AS (SELECT e.source_id, e.cited_id, 2 AS depth, array_append(path, e.source_id) AS path FROM one JOIN citation_edges e ON e.source_id = one.cited_id WHERE NOT array_contains(path, e.cited_id)),
three AS (SELECT e.source_id, e.cited_id, 3 AS depth, array_append(path, e.source_id) AS path FROM two JOIN citation_edges e ON e.source_id = two.cited_id WHERE NOT array_contains(path, e.cited_id))
SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three""",
    "get_session_stats": """
(p_tenant BIGINT, p_days INT, p_as_of TIMESTAMP_NTZ)
RETURNS TABLE (total_sessions BIGINT, total_queries BIGINT, avg_latency DOUBLE, avg_confidence DOUBLE, escalation_rate DOUBLE, total_cents BIGINT)
RETURN
SELECT count(DISTINCT s.session_id), count(*), round(avg(m.latency), 4), round(avg(m.confidence), 6), round(avg(CASE WHEN m.escalated THEN 1.0D ELSE 0.0D END), 6), sum(s.cents)
FROM case_sessions s JOIN messages m ON m.session_id = s.session_id AND m.role = 'assistant'
WHERE s.tenant_id = p_tenant AND s.created_at >= p_as_of - make_interval(0, 0, 0, p_days)""",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views (document_chunks, chunk_vectors, citation_edges, case_sessions, messages) and FUNCTIONS."""
    chunks(spark, sf_dir).createOrReplaceTempView("document_chunks")
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("chunk_vectors")
    edges(spark, sf_dir).createOrReplaceTempView("citation_edges")
    sessions = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sessions.select(F.col("o_orderkey").alias("session_id"), F.col("c_nationkey").cast("long").alias("tenant_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderdate").alias("created_at")).createOrReplaceTempView("case_sessions")
    lines = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_returnflag") == "R", "assistant").otherwise("user")
    lines.select(F.col("l_orderkey").alias("session_id"), role.alias("role"), F.col("l_extendedprice").alias("latency"), F.col("l_discount").alias("confidence"), (F.col("l_linestatus") == "F").alias("escalated")).createOrReplaceTempView("messages")
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


@query(ORACLE["hybrid_rrf_chunks"])
def sql_chunk_search(spark, sf_dir) -> DataFrame:
    """S4, R1 as a table function."""
    register(spark, sf_dir)
    return spark.sql("SELECT * FROM hybrid_document_chunk_search(array('the', 'and'), (SELECT embedding FROM chunk_vectors WHERE vec_id = 7), 'en', 1)")


@query(ORACLE["hybrid_rrf_four_branch"])
def sql_legal_search(spark, sf_dir) -> DataFrame:
    """S4, R2 as a table function."""
    register(spark, sf_dir)
    return spark.sql("SELECT * FROM hybrid_legal_search(array('the'), (SELECT embedding FROM chunk_vectors WHERE vec_id = 7), 'en')")


@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()},
p AS (SELECT source_id AS start_id, source_id, cited_id, 1 AS depth, [source_id] AS path FROM edges WHERE source_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 50 = 3)
  UNION ALL SELECT start_id, e.source_id, e.cited_id, depth + 1, list_append(path, e.source_id) FROM p JOIN edges e ON e.source_id = p.cited_id WHERE depth < 3 AND NOT list_contains(path, e.cited_id))
SELECT start_id, source_id, cited_id, depth, array_to_string(path, '>') AS path FROM p""")
def sql_precedent_chain(spark, sf_dir) -> DataFrame:
    """S4, J5 as a table function, called for each row of a table of starts."""
    register(spark, sf_dir)
    table(spark, sf_dir, "supplier").where("s_suppkey % 50 = 3").createOrReplaceTempView("chain_starts")
    return spark.sql("SELECT s_suppkey AS start_id, c.source_id, c.cited_id, c.depth, array_join(transform(c.path, x -> CAST(x AS STRING)), '>') AS path FROM chain_starts, LATERAL get_precedent_chain(s_suppkey) c")


@query("""
SELECT n_nationkey AS tenant_id, count(DISTINCT o_orderkey) AS total_sessions, count(o_orderkey) AS total_queries, round(avg(l_extendedprice), 4) AS avg_latency, round(avg(l_discount), 6) AS avg_confidence,
  round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 WHEN l_linestatus IS NOT NULL THEN 0.0 END), 6) AS escalation_rate, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total_cents
FROM nation LEFT JOIN (SELECT * FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 900 DAY) ON c_nationkey = n_nationkey GROUP BY 1""")
def sql_session_stats(spark, sf_dir) -> DataFrame:
    """S4, A2 as a table function, for each tenant."""
    register(spark, sf_dir)
    table(spark, sf_dir, "nation").createOrReplaceTempView("tenants")
    return spark.sql("SELECT n_nationkey AS tenant_id, s.* FROM tenants, (SELECT max(o.created_at) AS as_of FROM case_sessions o), LATERAL get_session_stats(CAST(n_nationkey AS BIGINT), 900, as_of) s")


