"""Records around the corpus: rows for target tables, normalised results, versions, queues, memory, access, cascades."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import legal_text as L
from ..operators.access import POLICIES, may_read, readable
from ..tables import CHUNKS_SQL, chunks, table
from .registry import query
from .retrieval import keyword_top

# Types of documents by target table; roles of users, the strongest first.
CASE_TYPES, FORM_TYPES = ["case", "case_law", "judgment"], ["form", "template"]
ROLES = ["super_admin", "admin", "lawyer", "paralegal", "client", "viewer"]


def target_table(doc_type: Column) -> Column:
    kind = F.lower(F.coalesce(doc_type, F.lit("")))
    return F.when(kind.isin(CASE_TYPES), "cases").when(kind.isin(FORM_TYPES), "legal_forms").otherwise("laws")


def _literals(vectors: pa.Array) -> pa.Array:
    """Python's formatting rounds the number as it is stored, exact halves to even; Java's rounds its shortest decimal form
    up."""
    return pa.array([None if v is None else "[" + ",".join(f"{x:.8f}" for x in v if x is not None) + "]" for v in vectors.to_pylist()], pa.string())


def vector_literal(vector: Column) -> Column:
    """The vector as text, eight decimals a number; null components are left out."""
    return F.arrow_udf(_literals, "string")(vector.cast("array<double>"))


def next_versions(versions: DataFrame, key: str, version: str) -> DataFrame:
    """For each key the version that a new row of it gets."""
    return versions.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def activate(versions: DataFrame, key: str, chosen: Column, order: Column) -> DataFrame:
    """versions with is_active set on the last chosen row of each key (by order) and cleared on its siblings; keys
    without a chosen row keep what they have."""
    last = F.max(F.when(chosen, order)).over(W.partitionBy(key))
    return versions.withColumn("is_active", F.when(last.isNull(), F.col("is_active")).otherwise(F.coalesce(order == last, F.lit(False))))


def priority(confidence: Column) -> Column:
    """Priority of a review, by confidence: the less, the more urgent."""
    return F.when(confidence < 0.4, 1).when(confidence < 0.5, 2).when(confidence < 0.6, 3).when(confidence < 0.7, 4).otherwise(5)


def live(entries: DataFrame, namespace: str, written_at: str, as_of: Column, ttl: dict[str, int]) -> DataFrame:
    """Cache entries that haven't outlived the seconds that their namespace allows."""
    seconds = F.coalesce(*[F.when(F.col(namespace) == k, F.lit(v)) for k, v in ttl.items()])
    return entries.where(F.unix_timestamp(as_of) - F.unix_timestamp(written_at) < seconds)


def session_memory(messages: DataFrame, session: str, order: str, last: int = 10) -> DataFrame:
    """For each session its last messages (role, text) in order, white space squeezed, as one text, with its digest."""
    rank = F.row_number().over(W.partitionBy(session).orderBy(F.desc(order)))
    kept = messages.withColumn("_rank", rank).where(F.col("_rank") <= last)
    line = F.concat("role", F.lit(": "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    lines = kept.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("lines"))
    memory = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return lines.select(session, F.size("lines").cast("long").alias("n_messages"), F.sha2(memory.cast("binary"), 256).alias("digest"))


def cascade(tiers: list[DataFrame], key: str, limit: int) -> DataFrame:
    """The first tier that has rows, at most `limit` of each: (key, score, tier). Tiers are lazy; one job reads them."""
    shaped = [t.select(key, F.col("score").cast("double").alias("score"), F.lit(i).alias("tier")).orderBy(F.desc("score"), key).limit(limit) for i, t in enumerate(tiers)]
    every = shaped[0]
    for t in shaped[1:]:
        every = every.union(t)
    first = every.agg(F.min("tier").alias("tier"))
    return every.join(F.broadcast(first), "tier").select(key, "score", "tier")  # one row


def supplemented(rows: DataFrame, more: DataFrame, key: str, limit: int) -> DataFrame:
    """Two retrieved sets (key, score) as one: the better score of each key, the best `limit` keys."""
    both = rows.select(key, "score").union(more.select(key, "score"))
    return both.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(limit)


@query("""
SELECT doc_id, CASE WHEN lang = 'de' THEN 'cases' WHEN lang = 'es' THEN 'legal_forms' ELSE 'laws' END AS target,
  CASE WHEN lang IN ('en', 'fr') THEN source END AS law_title, CASE WHEN lang = 'de' THEN source END AS case_no, CASE WHEN lang = 'es' THEN source END AS form_name,
  sha256(text) AS checksum, greatest(1, length(text) // 4) AS token_count FROM documents""")
def target_payloads(spark, sf_dir):
    """Documents shaped for the table that their type belongs to."""
    kind = F.when(F.col("lang") == "de", "Case_Law").when(F.col("lang") == "es", "template").otherwise("statute")
    d = table(spark, sf_dir, "documents").withColumn("target", target_table(kind))
    own = lambda name: F.when(F.col("target") == name, F.col("source"))
    return d.select(
        "doc_id", "target", own("laws").alias("law_title"), own("cases").alias("case_no"), own("legal_forms").alias("form_name"),
        F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.greatest(F.lit(1), F.floor(F.char_length("text") / 4)).cast("long").alias("token_count"),
    )


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def vector_literals(spark, sf_dir):
    """S29."""
    return table(spark, sf_dir, "embeddings").select("vec_id", vector_literal(F.col("embedding")).alias("literal"))


@query("SELECT l_suppkey, max(l_linenumber) + 1 AS next_version FROM lineitem GROUP BY 1")
def next_version(spark, sf_dir):
    """A27."""
    return next_versions(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber")


@query("""
WITH v AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'O' AS a, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS last FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN last IS NULL THEN a ELSE o_orderkey = last END AS is_active FROM v""")
def activate_version(spark, sf_dir):
    """Activating one version of a group deactivates the others."""
    v = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderstatus") == "O").alias("is_active"))
    return activate(v, "o_custkey", F.col("o_orderstatus") == "F", F.col("o_orderkey")).select("o_orderkey", "o_custkey", "is_active")


@query("""
WITH e AS (SELECT event_id, user_id, value / 500 AS c FROM events WHERE event_type = 'error')
SELECT event_id, user_id, CASE WHEN c < 0.4 THEN 1 WHEN c < 0.5 THEN 2 WHEN c < 0.6 THEN 3 WHEN c < 0.7 THEN 4 ELSE 5 END AS priority, count(*) OVER (PARTITION BY user_id) AS session_flags FROM e""")
def expert_flags(spark, sf_dir):
    """K6: reviews asked for, with their priority; flags of the session."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("event_id", "user_id", priority(F.col("value") / 500).alias("priority"), F.count("*").over(W.partitionBy("user_id")).alias("session_flags"))


@query("""
SELECT event_id, event_type FROM events WHERE date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-30 00:00:00') <
  CASE event_type WHEN 'click' THEN 86400 WHEN 'view' THEN 3600 WHEN 'error' THEN 21600 WHEN 'purchase' THEN 900 END""")
def cache_live(spark, sf_dir):
    """Entries within their namespace's time to live."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ttl = {"click": 86400, "view": 3600, "error": 21600, "purchase": 900}
    return live(e, "event_type", "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"), ttl).select("event_id", "event_type")


@query(r"""
WITH r AS (SELECT conv_id, turn, role || ': ' || trim(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g')) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, count(*) AS n_messages, sha256(string_agg(line, chr(10) ORDER BY turn, line)) AS digest FROM r WHERE rn <= 10 GROUP BY conv_id""")
def session_digest(spark, sf_dir):
    """The last ten messages of each conversation as memory, and its digest."""
    return session_memory(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""
WITH u AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'lawyer' WHEN 'HOUSEHOLD' THEN 'client' ELSE 'viewer' END AS role FROM customer),
r AS (SELECT unnest(['super_admin', 'admin', 'lawyer', 'paralegal', 'client', 'viewer']) AS role)
SELECT role, count(u.role) AS users FROM r LEFT JOIN u USING (role) GROUP BY role""")
def role_user_counts(spark, sf_dir):
    """Users of each of the six roles."""
    seg = F.col("c_mktsegment")
    role = F.when(seg == "BUILDING", "admin").when(seg == "MACHINERY", "lawyer").when(seg == "HOUSEHOLD", "client").otherwise("viewer")
    counts = table(spark, sf_dir, "customer").groupBy(role.alias("role")).agg(F.count("*").alias("users"))
    every = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"))
    return every.join(counts, "role", "left").fillna(0, ["users"])


@query("SELECT event_id, user_id FROM events WHERE user_id % 3 = 1 AND user_id % 3 <> 0 AND user_id = 7")
def own_feedback(spark, sf_dir):
    """A client sees its own rows of the feedback, within its tenant; rows of no tenant stay hidden."""
    rows = table(spark, sf_dir, "events").withColumn("tenant_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3))
    return readable(rows, POLICIES["feedback"], 1, "client", 7).select("event_id", "user_id")


@query("""
WITH r AS (SELECT unnest(['super_admin', 'admin', 'auditor', 'lawyer', 'client']) AS role), e AS (SELECT *, CASE WHEN user_id % 3 <> 0 THEN user_id % 3 END AS tenant_id, event_type = 'error' AS is_privileged FROM events)
SELECT role, count(*) FILTER (WHERE tenant_id = 1 AND role IN ('super_admin', 'admin', 'auditor')) AS audit_log, count(*) FILTER (WHERE tenant_id = 1 AND role IN ('super_admin', 'admin', 'lawyer')) AS expert_reviews,
  count(*) FILTER (WHERE tenant_id = 1 AND (role IN ('super_admin', 'admin') OR user_id = 7)) AS feedback, count(*) FILTER (WHERE tenant_id = 1 AND role IN ('super_admin', 'admin')) AS query_analytics,
  count(*) FILTER (WHERE tenant_id = 1 AND (NOT is_privileged OR role IN ('super_admin', 'admin', 'lawyer'))) AS documents FROM r, e GROUP BY role""")
def role_visibility(spark, sf_dir):
    """How many rows of each policed table a reader of tenant 1 sees, by role; a super admin is an admin of its
    own tenant, no more."""
    rows = table(spark, sf_dir, "events").withColumns({"tenant_id": F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3), "is_privileged": F.col("event_type") == "error"})
    names = ("audit_log", "expert_reviews", "feedback", "query_analytics", "documents")
    told = [F.struct(F.lit(role).alias("role"), *[F.count_if(may_read(POLICIES[n], 1, role, 7)).alias(n) for n in names]) for role in ("super_admin", "admin", "auditor", "lawyer", "client")]
    return rows.agg(F.array(*told).alias("told")).select(F.inline("told"))


@query("""
WITH a AS (SELECT user_id, list_sort(list_distinct(list(json_extract_string(props, '$.k')))) AS refs FROM events WHERE event_type = 'click' GROUP BY user_id),
b AS (SELECT user_id, list_sort(list_distinct(list(json_extract_string(props, '$.k')))) AS refs FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_filter(coalesce(a.refs, []), lambda x: NOT list_contains(coalesce(b.refs, []), x))), ',') AS added, list_has_any(coalesce(a.refs, []), coalesce(b.refs, [])) AS overlap FROM a FULL JOIN b USING (user_id)""")
def new_references(spark, sf_dir):
    """References of one set that the remembered one lacks; whether they overlap."""
    k = F.get_json_object("props", "$.k")
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).groupBy("user_id").agg(
        F.collect_set(F.when(F.col("event_type") == "click", k)).alias("a"), F.collect_set(F.when(F.col("event_type") == "view", k)).alias("b")
    )
    return e.select("user_id", F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("added"), F.arrays_overlap("a", "b").alias("overlap"))


@query(r"""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Law on ' || source ELSE source END AS title, CASE WHEN doc_id % 2 = 0 THEN 'cases' ELSE 'laws' END AS st, CASE WHEN lang = 'fr' THEN 'https://laoofficialgazette.gov.la/x' END AS url, text FROM documents)
SELECT doc_id, CASE WHEN st = 'cases' AND regexp_matches(lower(title), 'law|statute|act|code|decree|regulation|article') THEN 'law' WHEN st = 'cases' THEN 'precedent' ELSE 'law' END AS type, url IS NOT NULL AS official FROM r""")
def normalised_rows(spark, sf_dir):
    """Types of retrieved rows (a row of cases that reads like a statute is law), official sources."""
    d = table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Law on "), "source")).otherwise(F.col("source"))
    url = F.when(F.col("lang") == "fr", "https://laoofficialgazette.gov.la/x")
    like = L.statute_like(title, F.lit(""))
    kind = F.when((F.col("doc_id") % 2 == 0) & ~like, "precedent").otherwise("law")
    return d.select("doc_id", kind.alias("type"), F.coalesce(L.official_source(url), F.lit(False)).alias("official"))


@query(r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
a AS (SELECT doc_id, len(list_filter(t, lambda x: x = 'the'))::DOUBLE AS score FROM t WHERE list_contains(t, 'the') ORDER BY score DESC, doc_id LIMIT 20),
b AS (SELECT doc_id, len(list_filter(t, lambda x: x = 'license'))::DOUBLE AS score FROM t WHERE list_contains(t, 'license') ORDER BY score DESC, doc_id LIMIT 20),
m AS (SELECT doc_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10)
SELECT doc_id, score, 1 AS tier FROM m""")
def retrieval_cascade(spark, sf_dir):
    """A search that finds nothing gives way to the next one: keywords, with a supplement merged in."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))

    def search(words: list[str]) -> DataFrame:
        return keyword_top(rows, words, 20).select(F.col("id").alias("doc_id"), F.col("tf").cast("double").alias("score"))

    found = supplemented(search(["the"]), search(["license"]), "doc_id", 10)
    return cascade([search(["no-such-word"]), found], "doc_id", 10)


@query(f"""
WITH {CHUNKS_SQL.strip()},
gone AS (SELECT n FROM (SELECT chunk_id AS n FROM chunks WHERE status = 'superseded'))
SELECT e.event_id, CASE WHEN g.n IS NULL THEN e.user_id END AS chunk_id FROM events e LEFT JOIN gone g ON g.n = e.user_id WHERE e.event_type <> 'error' OR g.n IS NULL""")
def delete_cascade(spark, sf_dir):
    """Removing chunks deletes one child's rows (errors) and clears the reference in the others."""
    gone = chunks(spark, sf_dir).where("status = 'superseded'").select(F.col("chunk_id").alias("user_id"))
    e = table(spark, sf_dir, "events")
    kept = e.where("event_type = 'error'").join(gone, "user_id", "left_anti").select("event_id", F.col("user_id").alias("chunk_id"))
    others = e.where("event_type <> 'error'").join(gone.withColumn("gone", F.lit(True)), "user_id", "left")
    return kept.union(others.select("event_id", F.when(F.col("gone").isNull(), F.col("user_id")).alias("chunk_id")))
