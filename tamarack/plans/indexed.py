"""Queries over indexes that are built from the tables: keywords, vectors, both fused; citations found by substring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import precedent_chains
from ..operators.inverted_index import KeywordIndex
from ..operators.substring_join import filters, first_hits
from ..operators.vector_index import VectorIndex
from ..shared import new_path
from ..tables import EDGES_SQL, chunks, edges, table
from .registry import ORACLE, query
from .retrieval import _SIM, _TOKENS, _one, fused


def _keyword_index(spark, sf_dir) -> KeywordIndex:
    return KeywordIndex.build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query(ORACLE["keyword_match_topk"])
def keyword_index_topk(spark, sf_dir):
    """P6, W2 with posting lists: equal to the scan of all rows."""
    return _keyword_index(spark, sf_dir).search(["the", "and"], 20)


@query(f"""
WITH t AS (SELECT doc_id AS id, {_TOKENS.format("text")} AS t FROM documents),
w AS (SELECT item_id AS query_id, list_distinct(list_slice({_TOKENS.format("text")}, 1, 2)) AS words FROM benchmark),
tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(t) AS token FROM t) GROUP BY ALL),
m AS (SELECT query_id, id, sum(tf)::BIGINT AS tf FROM (SELECT query_id, words, unnest(words) AS token FROM w) JOIN tf USING (token) GROUP BY query_id, id, words HAVING count(*) = len(words))
SELECT * FROM (SELECT query_id, id, tf, row_number() OVER (PARTITION BY query_id ORDER BY tf DESC, id) AS kw_rank FROM m) WHERE kw_rank <= 10""")
def keyword_index_many(spark, sf_dir):
    """P6, R5 for a table of queries: the first words of every benchmark item."""
    from ..functions import legal_text as L

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(L.tokens(F.col("text")), 1, 2).alias("words"))
    return _keyword_index(spark, sf_dir).search_many(asked, 10)


@query(ORACLE["hybrid_rrf_chunks"])
def hybrid_indexed_chunks(spark, sf_dir):
    """R1 with both branches from indexes; who may see a chunk is a facet of each index."""
    facets = ("jurisdiction", "status", "review_status", "tenant_id")
    rows = chunks(spark, sf_dir)
    visible = searchable_condition("en", 1)
    words = KeywordIndex.build(rows.select(F.col("chunk_id").alias("id"), "content", *facets), facets=facets)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    joined = new_path(spark, "joined")  # building reads it more than once
    vectors.join(rows.select(F.col("chunk_id").alias("id"), *facets), "id").write.parquet(joined)
    near = VectorIndex.build(spark.read.parquet(joined), facets=facets)
    one = _one(spark, sf_dir, 7).select(F.lit(0).alias("query_id"), "query")
    sem = near.search(one, 80, exact=True, where=visible).select("id", F.col("rk").alias("sem_rank"))
    return fused([sem, words.search(["the", "and"], 80, where=visible).select("id", "kw_rank")], 10)


def searchable_condition(jurisdiction: str, tenant_id: int):
    """searchable() as a condition on facets."""
    return (F.col("jurisdiction") == jurisdiction) & (F.col("status") == "active") & (F.col("review_status") == "approved") & (F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant_id))


def _vector_queries(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return VectorIndex.build(vectors.select(F.col("vec_id").alias("id"), "embedding")), asked


@query(f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, id, similarity, rk FROM (
  SELECT query_id, vec_id AS id, {_SIM.format(a="embedding", b="qe")} AS similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY {_SIM.format(a="embedding", b="qe")} DESC, vec_id) AS rk
  FROM embeddings, q) WHERE rk <= 10""")
def vector_index_knn(spark, sf_dir):
    """J12, W1 with a vector index, exact: cells that can't hold a neighbour are left out."""
    index, asked = _vector_queries(spark, sf_dir)
    return index.search(asked, 10, exact=True)


@query(None)
def vector_index_probed(spark, sf_dir):
    """J12, W1 with a vector index: as many cells as bring a sample's recall to 0.9."""
    from ..operators.vector_index import calibrated

    index, asked = _vector_queries(spark, sf_dir)
    return index.search(asked, 10, calibrated(index, asked, 10)[0])


_REFS = """
refs AS (SELECT item_id AS ref_id, trim(regexp_replace(CASE item_id % 4 WHEN 0 THEN substr(text, 8, 40) WHEN 1 THEN 'Law of src' || (item_id % 20) WHEN 2 THEN 'Section ' || substr(text, 20, 12) ELSE 'no such law, article ' || item_id || 'x' END, '\\s+', ' ', 'g')) AS ref FROM benchmark),
s AS (SELECT ref_id, ref, nullif(regexp_extract(ref, '(?i)(?:ມາດຕາ|มาตรา|article|art\\.?|section|sec\\.?)\\s*([0-9A-Za-z/.-]+)', 1), '') AS sec FROM refs)"""


@query(f"""
WITH {_REFS.strip()},
laws AS (SELECT doc_id AS id, 'Law of ' || source AS title, text AS full_text, doc_id::VARCHAR || 'x' AS section_number FROM documents WHERE doc_id % 2 = 0),
cases AS (SELECT doc_id AS id, source || '/' || doc_id AS case_no, text AS ruling FROM documents WHERE doc_id % 2 = 1),
lf AS (SELECT ref_id, place, field, lower(substr(term, 1, 80)) AS term FROM (
  SELECT ref_id, 0 AS place, 'title' AS field, ref AS term FROM s UNION ALL SELECT ref_id, 1, 'full_text', ref FROM s UNION ALL SELECT ref_id, 2, 'title', sec FROM s UNION ALL SELECT ref_id, 3, 'full_text', sec FROM s UNION ALL SELECT ref_id, 4, 'section_number', sec FROM s) WHERE term <> ''),
cf AS (SELECT ref_id, place, field, lower(substr(term, 1, 80)) AS term FROM (
  SELECT ref_id, 0 AS place, 'case_no' AS field, ref AS term FROM s UNION ALL SELECT ref_id, 1, 'ruling', ref FROM s UNION ALL SELECT ref_id, 2, 'case_no', sec FROM s UNION ALL SELECT ref_id, 3, 'ruling', sec FROM s) WHERE term <> ''),
l AS (SELECT ref_id, min((place, id)) AS b FROM lf JOIN (SELECT id, 'title' AS field, lower(title) AS text FROM laws UNION ALL SELECT id, 'full_text', lower(full_text) FROM laws UNION ALL SELECT id, 'section_number', section_number FROM laws) t ON t.field = lf.field AND contains(t.text, lf.term) GROUP BY 1),
c AS (SELECT ref_id, min((place, id)) AS b FROM cf JOIN (SELECT id, 'case_no' AS field, lower(case_no) AS text FROM cases UNION ALL SELECT id, 'ruling', lower(ruling) FROM cases) t ON t.field = cf.field AND contains(t.text, cf.term) GROUP BY 1)
SELECT ref_id, CASE WHEN ref_id % 10 = 0 THEN 'chunk' WHEN l.b IS NOT NULL THEN 'law' WHEN c.b IS NOT NULL THEN 'case' END AS tier,
  CASE WHEN ref_id % 10 = 0 THEN ref_id WHEN l.b IS NOT NULL THEN l.b[2] ELSE c.b[2] END AS id, CASE WHEN ref_id % 10 = 0 THEN NULL WHEN l.b IS NOT NULL THEN l.b[1] ELSE c.b[1] END::INT AS place
FROM s LEFT JOIN l USING (ref_id) LEFT JOIN c USING (ref_id)""")
def citation_matches(spark, sf_dir):
    """Citations by chunk id, else by substring of laws' titles, texts and sections, else of cases; the first filter
    that hits wins."""
    item, text = F.col("item_id"), F.col("text")
    ref = F.when(item % 4 == 0, F.substring(text, 8, 40)).when(item % 4 == 1, F.concat(F.lit("Law of src"), (item % 20).cast("string"))).when(item % 4 == 2, F.concat(F.lit("Section "), F.substring(text, 20, 12)))
    ref = ref.otherwise(F.concat(F.lit("no such law, article "), item.cast("string"), F.lit("x")))
    refs = table(spark, sf_dir, "benchmark").select(item.alias("ref_id"), F.trim(F.regexp_replace(ref, r"\s+", " ")).alias("ref"), F.when(item % 10 == 0, item).alias("chunk_id"))
    d = table(spark, sf_dir, "documents")
    by_chunk = refs.join(d.select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi").select("ref_id", F.lit("chunk").alias("tier"), F.col("chunk_id").alias("id"), F.lit(None).cast("int").alias("place"))

    def columns(rows, names: dict):
        return rows.select(F.col("doc_id").alias("id"), F.inline(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("text")) for n, v in names.items()])))

    laws = columns(d.where("doc_id % 2 = 0"), {"title": F.concat(F.lit("Law of "), "source"), "full_text": F.col("text"), "section_number": F.concat(F.col("doc_id").cast("string"), F.lit("x"))})
    cases = columns(d.where("doc_id % 2 = 1"), {"case_no": F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), "ruling": F.col("text")})
    left = refs.join(by_chunk, "ref_id", "left_anti")
    by_law = first_hits(filters(left, ["title", "full_text"], "section_number"), laws).select("ref_id", F.lit("law").alias("tier"), "id", "place")
    left = left.join(by_law, "ref_id", "left_anti")
    by_case = first_hits(filters(left, ["case_no", "ruling"]), cases).select("ref_id", F.lit("case").alias("tier"), "id", "place")
    return refs.select("ref_id").join(by_chunk.unionByName(by_law).unionByName(by_case), "ref_id", "left")


_CHAINS = """
WITH RECURSIVE {edges},
p AS (SELECT source_id AS start_id, source_id, cited_id, 1 AS depth, [source_id] AS path FROM edges WHERE source_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 50 = 3) AND cited_id IS NOT NULL
  UNION ALL SELECT start_id, e.source_id, e.cited_id, depth + 1, list_append(path, e.source_id) FROM p JOIN edges e ON e.source_id = p.cited_id
  WHERE depth < 3 AND NOT list_contains(path, {test}))
SELECT start_id, source_id, cited_id, depth, array_to_string(path, '>') AS path FROM p"""


def _chains(spark, sf_dir, test_source: bool):
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey % 50 = 3").select(F.col("s_suppkey").alias("start_id"))
    found = precedent_chains(edges(spark, sf_dir), seeds, 3, test_source)
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(_CHAINS.format(edges=EDGES_SQL.strip(), test="e.cited_id"))
def precedent_chains_v2(spark, sf_dir):
    """J5, U2 from a table of start nodes."""
    return _chains(spark, sf_dir, False)


@query(_CHAINS.format(edges=EDGES_SQL.strip(), test="e.source_id"))
def precedent_chains_v1(spark, sf_dir):
    """J5, U2 from a table of start nodes, the older variant."""
    return _chains(spark, sf_dir, True)
